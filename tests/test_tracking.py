import json
from collections import namedtuple
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwright.operators.tracking import ball, players, single, world
from trackwright.operators.tracking.runner import track
from trackwright.plans.analyze import RequestError, analyze, validate
from trackwright.plans.tracking_queries import COURT_M, FLAT
from trackwright.sources import detections as src
from trackwright.streaming.tracks import stream_tracks

BALL = "video_id string, frame bigint, det int, x1 double, y1 double, x2 double, y2 double, conf double"


def ball_rows(points, conf=0.8, video="v"):
    """points: for each frame a list of centres."""
    rows = []
    for f, some in enumerate(points):
        rows += [(video, f, i, x - 5.0, y - 5.0, x + 5.0, y + 5.0, conf) for i, (x, y) in enumerate(some)] or [(video, f, None, None, None, None, None, None)]
    return rows


def run_ball(spark, points):
    df = spark.createDataFrame(ball_rows(points), BALL)
    return track(df, lambda: ball.BallTracker(ball.BallSettings(FLAT, COURT_M)), ball.SCHEMA).orderBy("frame", "track_id").collect()


def test_steady_ball_has_one_active_track(spark):
    rows = run_ball(spark, [[(50.0 + 8 * f, 100.0 + 4 * f)] for f in range(30)])
    assert {r.track_id for r in rows} == {1}
    assert all(r.is_active for r in rows[1:])
    assert rows[-1].speed == pytest.approx(np.hypot(8, 4) * 30)


def test_ball_survives_a_gap_and_dies_after_a_long_one(spark):
    gap = [[(50.0 + 8 * f, 100.0)] if not 10 <= f < 15 else [] for f in range(25)]
    assert {r.track_id for r in run_ball(spark, gap)} == {1}
    lost = run_ball(spark, [[(50.0, 100.0)], [(58.0, 100.0)]] + [[]] * 14)
    assert max(r.frame for r in lost) == 11
    assert max(r.missed for r in lost) == 10


def test_moving_ball_wins_over_a_still_one(spark):
    rows = run_ball(spark, [[(300.0, 300.0), (50.0 + 10 * f, 100.0)] for f in range(20)])
    active = [r for r in rows if r.is_active and r.frame > 3]
    assert len(active) == 16
    assert all(r.y1 < 200 for r in active)


def test_at_most_one_active_ball_in_a_frame(spark):
    rng = np.random.default_rng(0)
    rows = run_ball(spark, [[tuple(p) for p in rng.uniform(0, 600, (rng.integers(0, 6), 2)).tolist()] for _ in range(60)])
    frames = [r.frame for r in rows if r.is_active]
    assert len(frames) == len(set(frames))
    assert max(sum(r.frame == f for r in rows) for f in range(60)) <= 10


def test_pairing_prefers_mutual_nearest():
    assert sorted(ball.pair_up(np.array([[1.0, 2.0], [0.5, np.inf]]))) == [(0, 1), (1, 0)]
    assert ball.pair_up(np.zeros((0, 3))) == []


def test_players_one_for_each_half(spark):
    rows = [("v", f, d, x - 20.0, y - 60.0, x + 20.0, float(y), 0.9) for f in range(40) for d, (x, y) in enumerate([(200 + f * 3, 150), (300 - f * 3, 600), (250, 640)])]
    got = track(spark.createDataFrame(rows, BALL), lambda: players.PlayerTracker(players.PlayerSettings(FLAT)), players.SCHEMA).collect()
    for f in range(40):
        here = [r for r in got if r.frame == f]
        assert sorted(r.label for r in here) == ["player1", "player2"]
        assert {r.position for r in here if r.v <= 23.77 / 2} == {"top"}


def test_players_are_followed_on_plain_floats():
    """Numpy calls for a frame's few boxes took most of the tracker's time; its numbers stay those of numpy."""
    rng = np.random.default_rng(2)
    a, b = (np.concatenate([x, x + rng.uniform(-5, 60, (40, 2))], axis=1) for x in (rng.uniform(0, 60, (40, 2)), rng.uniform(0, 60, (40, 2))))
    a[0, 1], b[1, 2] = np.nan, np.inf
    got = [[players._iou(tuple(x), tuple(y)) for y in b.tolist()] for x in a.tolist()]
    assert np.array_equal(np.array(got), ball.overlaps(a, b), equal_nan=True)
    one = namedtuple("One", "x1 y1 x2 y2 conf")
    t = players.PlayerTracker(players.PlayerSettings(FLAT))
    for f in range(4):
        out = t.step(f, [one(180.0 + 10 * f, 90.0, 220.0 + 10 * f, 150.0, 0.9), one(280.0, 540.0, 320.0, 600.0, 0.9), one(1.0, 2.0, 3.0, 4.0, None)])
    assert [r[0] for r in out] == [1, 2]
    assert all(type(v) in (int, float, str) for r in out for v in r)
    assert all(type(v) is float for p in t.players for v in (*p.box, *p.drift, *p.uv, p.pace))


def test_nearly_level_players_keep_their_labels():
    t = players.PlayerTracker(players.PlayerSettings(FLAT))
    one, two = players.Player(1, np.array([0, 0, 10, 100.0]), np.zeros(4), 1, 0), players.Player(2, np.array([0, 0, 10, 120.0]), np.zeros(4), 1, 0)
    assert t._label(0, [one, two]) == {1: "player1", 2: "player2"}
    one.box, two.box = np.array([0, 0, 10, 121.0]), np.array([0, 0, 10, 119.0])
    assert t._label(1, [one, two]) == {1: "player1", 2: "player2"}
    one.box = np.array([0, 0, 10, 300.0])
    assert t._label(2, [one, two]) == {2: "player1", 1: "player2"}
    assert t._label(3, [two]) == {2: "player1"}


def world_rows(spark, xs, **settings):
    df = spark.createDataFrame([("v", f, 0, "ball", 1, x, 0.0, x, 0.0) for f, x in enumerate(xs)], "video_id string, frame bigint, det int, kind string, track_id bigint, x1 double, y1 double, x2 double, y2 double")
    return track(df, lambda: world.WorldSpeed(world.WorldSettings(FLAT, **settings)), world.SCHEMA).orderBy("frame").collect()


def test_speed_of_a_steady_ball(spark):
    rows = world_rows(spark, [10.0 * f for f in range(40)])
    assert rows[0].mps is None
    assert rows[-1].mps == pytest.approx(10 * 0.02 * 30, rel=1e-6)
    assert rows[-1].kmh == pytest.approx(rows[-1].mps * 3.6)
    halved = world_rows(spark, [10.0 * f for f in range(40)], ticks=2)
    assert halved[-1].mps == pytest.approx(rows[-1].mps / 2)


def test_jump_is_rejected(spark):
    rows = world_rows(spark, [10.0 * f + (2000 if f == 20 else 0) for f in range(30)])
    assert [r.frame for r in rows if r.rejected][0] == 20


def test_stream_gives_the_batch_tracks(spark, tmp_path):
    rng = np.random.default_rng(1)
    points = [[tuple(p) for p in rng.uniform(0, 600, (rng.integers(0, 4), 2)).tolist()] for _ in range(24)]
    rows = ball_rows(points) + ball_rows(points[::-1], video="w")
    make = lambda: ball.BallTracker(ball.BallSettings(FLAT, COURT_M))
    want = track(spark.createDataFrame(rows, BALL), make, ball.SCHEMA)
    for k in range(3):
        some = [r for r in rows if r[1] // 8 == k]
        spark.createDataFrame(some, BALL).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(BALL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = stream_tracks(stream, make, ball.SCHEMA).writeStream.format("memory").queryName("tracks_out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("tracks_out").collect())) == sorted(map(str, want.collect()))


def test_request_rules():
    good = {"video_id": "7", "video_url": "https://a.example/v.mp4", "features": []}
    assert validate(good)["video_id"] == 7
    with pytest.raises(RequestError, match="MatchSectioning needs DeadTimeDetection"):
        validate(good | {"features": ["MatchSectioning"]})
    with pytest.raises(RequestError, match="unknown feature"):
        validate(good | {"features": ["Nothing"]})
    with pytest.raises(RequestError, match="not a url"):
        validate(good | {"video_url": "nowhere"})


def test_analysis_end_to_end(spark):
    moving = [(200.0 + 4 * (f % 80), 80.0 + 6 * (f % 80)) for f in range(240)]
    rows = [("v", f, "ball", 0, x - 5, y - 5, x + 5, y + 5, 0.8, 0) for f, (x, y) in enumerate(moving) if 60 <= f < 210]
    rows += [("v", f, "player", d, 150.0 + f, y - 60.0, 190.0 + f, y, 0.9, 0) for f in range(240) for d, y in enumerate((150.0, 600.0))]
    found = spark.createDataFrame(rows, src.DETECTIONS)
    videos = spark.createDataFrame([("v", 240)], "video_id string, total_frames bigint")
    out = analyze(found, videos, FLAT, COURT_M)
    assert out.facts.count() == 240
    assert out.rows == {
        "tracks": out.rows["tracks"], "frame-facts": 240, "sections": 1, "ball-speeds": out.ball_speeds.count(), "player-speeds": out.player_speeds.count()
    }
    assert out.rows["tracks"] >= 2 * 240
    assert set(out.seconds) == {"tracking", "sections", "speeds"}
    sections = out.sections.collect()
    assert len(sections) == 1
    assert 0 <= sections[0].start_index < sections[0].end_index <= 240
    assert out.player_speeds.where("player = 'p1'").count() == 16
    posted = []
    assert src.send(out.sections, lambda path, body: posted.append((path, json.loads(body))) or 200, "sections", "v") == 1
    assert posted[0][1]["data"][0]["section_idx"] == 0
    with pytest.raises(src.SendError):
        src.send(out.sections, lambda path, body: 500, "sections", "v")


def test_line_annotations(spark, tmp_path):
    raw = {"images": [{"id": 1, "file_name": "a", "height": 10, "width": 20}], "annotations": [{"id": 5, "image_id": 1, "category_id": 0, "line": [15, 5, 10, 2]}]}
    (tmp_path / "a.json").write_text(json.dumps(raw))
    row = src.read_line_annotations(spark, str(tmp_path / "a.json")).first()
    assert (row.x1, row.y1, row.x2, row.y2) == (15, 5, 20, 7)


def test_fallback_only_sees_failures(spark):
    first = spark.createDataFrame([(1, 5.0), (2, None)], "video_id int, kp double")
    images = spark.createDataFrame([(1, b"a"), (2, b"b")], "video_id int, image binary")
    second = lambda missing: missing.select("video_id", F.length("image").cast("double").alias("kp"))
    assert sorted(map(tuple, src.fallback(first, images, second, ["video_id"], "kp").collect())) == [(1, 5.0), (2, 1.0)]


def run_single(frames, confs=0.8):
    """frames: for each frame the centres of its boxes."""
    tracker = single.SingleTracker(single.SingleSettings(FLAT, COURT_M))
    out = []
    for f, some in enumerate(frames):
        rows = [SimpleNamespace(frame=f, det=i, x1=x - 5.0, y1=y - 5.0, x2=x + 5.0, y2=y + 5.0, conf=confs) for i, (x, y) in enumerate(some)]
        out.append(tracker.step(f, rows or [SimpleNamespace(frame=f, det=None, x1=None, y1=None, x2=None, y2=None, conf=None)]))
    return out


def test_single_ball_is_followed_and_held():
    path = [(50.0 + 8 * f, 100.0 + 6 * f) for f in range(12)]
    got = run_single([[p] for p in path] + [[]] * 13)
    assert got[0] == []
    for f in range(2, 12):
        (row,) = got[f]
        assert row[0] == 1
        assert row[1:5] == (path[f][0] - 5, path[f][1] - 5, path[f][0] + 5, path[f][1] + 5)
        assert row[6] == pytest.approx(300.0)
        assert row[7:9] == pytest.approx((path[f][0] * 0.02, path[f][1] * 0.035))
    for missed in range(1, 13):
        (row,) = got[11 + missed]
        assert row[5] == pytest.approx(0.8 * 0.9**missed)
        assert row[9] == missed
    assert got[24] == []


def test_single_ball_gives_way_to_a_clearly_faster_one():
    slow, fast = [(50.0 + 8 * f, 100.0) for f in range(20)], [(60.0 + 25 * f, 400.0) for f in range(20)]
    got = run_single([[s, *([q] if f >= 8 else [])] for f, (s, q) in enumerate(zip(slow, fast, strict=True))])
    assert all(got[f][0][2] == 95.0 for f in range(2, 9))
    assert all(got[f][0][2] == 395.0 for f in range(9, 20))
    level = run_single([[s, *([(60.0 + 8.5 * f, 400.0)] if f >= 8 else [])] for f, s in enumerate(slow)])
    assert all(level[f][0][2] == 95.0 for f in range(2, 20))


def test_single_ball_hides_a_still_one():
    assert run_single([[(300.0, 300.0)]] * 20) == [[]] * 20


def test_analysis_of_nothing(spark):
    out = analyze(spark.createDataFrame([], src.DETECTIONS), spark.createDataFrame([], "video_id string, total_frames bigint"), FLAT, COURT_M)
    assert set(out.rows.values()) == {0}
