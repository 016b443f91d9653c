"""What SQL can't express of courts, lines, cameras and requests, against brute force."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwright.functions import camera, court, homography
from trackwright.functions import geometry as g
from trackwright.operators import boxes as bx
from trackwright.operators import court_search as cs
from trackwright.operators import grids, lines, series
from trackwright.plans.analyze import RequestError, answer, dispatch
from trackwright.sources import detections as src

LINES = "image bigint, line bigint, x1 double, y1 double, x2 double, y2 double, score double"


def random_segments(spark, n, images=2, seed=0, spread=100.0):
    rng = random.Random(seed)
    rows = [(i % images, i, *(rng.uniform(0, spread) for _ in range(4)), rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, LINES)


def point_gap(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1])


def score_by_hand(h, segments):
    """One court's score, line by line and segment by segment."""
    place = [tuple((h @ [x, y, 1])[:2] / (h @ [x, y, 1])[2]) for x, y in cs.MODEL_POINTS]
    left, total = list(range(len(segments))), 0.0
    for i, j in cs.MODEL_LINES:
        a, b = place[i], place[j]
        best, least = None, 1e5
        for k in left:
            p, q = segments[k]
            dot = ((b[0] - a[0]) * (q[0] - p[0]) + (b[1] - a[1]) * (q[1] - p[1])) / math.dist(a, b) / math.dist(p, q)
            angle = math.degrees(math.acos(min(1.0, abs(dot))))
            gap = min(point_gap(p, a, b), point_gap(q, a, b), point_gap(a, p, q), point_gap(b, p, q))
            if angle < 4 and gap < 50:
                apart = min(math.dist(a, p) ** 2, math.dist(a, q) ** 2) + min(math.dist(b, p) ** 2, math.dist(b, q) ** 2)
                cost = (4 - angle) * 200 + apart**2 + gap**2
                if cost < least:
                    best, least = k, cost
        if best is not None:
            left.remove(best)
        total += 1000 - least
    return total


def test_court_search_finds_a_court_and_agrees_with_brute_force(spark):
    true = np.array([[1.6, 0.2, 180.0], [0.05, 0.6, 60.0], [0.0001, 0.0006, 1.0]])
    seen = homography.project(true, cs.MODEL_POINTS)
    rows = [(0, k, *seen[i].tolist(), *seen[j].tolist(), 0.9) for k, (i, j) in enumerate(cs.MODEL_LINES[:6])]
    rows += [(1, 10 + k, *r[2:6], 0.5) for k, r in enumerate(random_segments(spark, 4, 1, 5, 300)[0])] + [(2, 20, 0.0, 0.0, 1.0, 1.0, 0.5)]
    found = {r.image: r for r in cs.find_courts(spark.createDataFrame(rows, LINES), attempts=400, block=37).collect()}
    assert set(found) == {0, 1}
    for image in (0, 1):
        segments = [((r[2], r[3]), (r[4], r[5])) for r in rows if r[0] == image]
        tried = itertools.islice(((m, s) for m in itertools.combinations(range(9), 2) for s in itertools.combinations(range(len(segments)), 2)), 400)
        best = -math.inf
        for m, s in tried:
            model = np.array([cs.MODEL_POINTS[cs.MODEL_LINES[k][e]] for e in (0, 1) for k in m])
            image_points = np.array([segments[k][e] for e in (0, 1) for k in s])
            h = cs.homographies(model[None], image_points[None])[0]
            if np.isfinite(h).all():
                best = max(best, score_by_hand(h, segments))
        assert found[image].score == pytest.approx(best, rel=1e-9, abs=1e-3)
    assert homography.project(np.array(found[0].h).reshape(3, 3), cs.MODEL_POINTS) == pytest.approx(seen, abs=1e-3)


def test_clipped_lines_are_those_not_covered(spark):
    """Dense points along each line: those at its ends that a better kept line covers go, and no others."""
    rows = [(0, 1, 0.0, 0.0, 10.0, 0.0, 0.9), (0, 2, 5.0, 0.1, 20.0, 0.1, 0.8), (0, 3, 2.0, 0.1, 8.0, 0.1, 0.7), (0, 4, 18.0, 0.0, 30.0, 0.0, 0.6), (0, 5, -5.0, 0.05, 40.0, 0.05, 0.5), (1, 6, 0.0, 5.0, 3.0, 9.0, 0.1)]
    got = {r.line: r for r in lines.clip_overlaps(spark.createDataFrame(rows, LINES), threshold=0.5, slack=0.0).collect()}
    assert set(got) == {1, 2, 4, 5, 6}
    assert (got[2].x1, got[2].x2) == pytest.approx((10.0, 20.0))
    assert (got[4].x1, got[4].x2) == pytest.approx((20.0, 30.0))
    assert (got[5].x1, got[5].x2) == pytest.approx((-5.0, 40.0))
    rng = np.random.default_rng(1)
    for _ in range(200):
        covers = np.sort(rng.uniform(-0.3, 1.3, (rng.integers(0, 6), 2)), axis=1)
        start, end = lines.uncovered(covers)
        at = np.linspace(0, 1, 2001)[1:-1]
        free = np.flatnonzero(~((at[:, None] > covers[:, 0]) & (at[:, None] < covers[:, 1])).any(axis=1)) if len(covers) else np.arange(len(at))
        if start < end:
            assert (at[free[0]], at[free[-1]]) == pytest.approx((max(start, at[0]), min(end, at[-1])), abs=2e-3)
        else:
            assert len(free) <= 1


def test_merged_lines_against_a_plain_fold(spark):
    rows, df = random_segments(spark, 60, 2, 3, 60)
    want = []
    for image in (0, 1):
        kept = []
        for s in sorted(r[2:6] for r in rows if r[0] == image):
            for k, o in enumerate(kept):
                if math.dist(s[:2], o[:2]) < 20 and math.dist(s[2:], o[2:]) < 20:
                    kept[k] = tuple((a + b) / 2 for a, b in zip(o, s, strict=True))
                    break
            else:
                kept.append(s)
        want += [(image, *k) for k in kept]
    got = sorted((r.image, r.x1, r.y1, r.x2, r.y2) for r in lines.merge_close(df, 20).collect())
    assert np.array(got) == pytest.approx(np.array(sorted(want)))


def test_camera_pose_is_found_again():
    rng = np.random.default_rng(4)
    for _ in range(20):
        turn = camera._turn(np.array([math.pi / 2 + 0.4, 0, 0]) + rng.normal(0, 0.15, 3))
        shift = np.array([-5.0, 3.0, 35.0]) + rng.normal(0, 2, 3)
        pixels = camera._seen(turn, shift, camera.CORNERS) * 1200 + [640, 360]
        found_turn, found_shift, error = camera.solve_pose(pixels, 1200.0, np.array([640.0, 360.0]))
        assert error < 1e-6
        assert found_turn == pytest.approx(turn, abs=1e-6)
        assert found_shift == pytest.approx(shift, abs=1e-5)
    assert camera.solve_pose(np.zeros((4, 2)), 1000.0, np.zeros(2)) is None


def test_quad_homographies_meet_their_corners(spark):
    quad = [(F.lit(100.0), F.lit(80.0)), (F.lit(500.0), F.lit(90.0)), (F.lit(600.0), F.lit(400.0)), (F.lit(50.0), F.lit(420.0))]
    h = g.quad_to_court(quad)
    there = [v for p in quad for v in g.project(p, h, eps=0.0)]
    back = [v for u, w in ((0.0, 0.0), (10.97, 0.0), (10.97, 23.77), (0.0, 23.77)) for v in g.project((F.lit(u), F.lit(w)), g.inverse(h), eps=0.0)]
    row = spark.range(1).select(*(v.alias(f"c{i}") for i, v in enumerate(there + back))).first()
    assert list(row[:8]) == pytest.approx([0, 0, 10.97, 0, 10.97, 23.77, 0, 23.77], abs=1e-9)
    assert list(row[8:]) == pytest.approx([100, 80, 500, 90, 600, 400, 50, 420], abs=1e-6)


def test_polygon_warp_fails_without_an_image(spark):
    points = lambda rows: spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in rows],)], "p array<struct<x:double,y:double>>")
    h = [1.0, 0, 0, 0, 1.0, 0, 1.0, 0, -5.0]
    assert len(points([(0, 0), (1, 0), (1, 1)]).select(g.warp_polygon(F.col("p"), h)).first()[0]) == 3
    for bad in ([(0, 0), (5, 0), (1, 1)], [(0, 0), (1, 1)]):
        with pytest.raises(Exception, match="no image"):
            points(bad).select(g.warp_polygon(F.col("p"), h)).collect()


def test_court_tables(spark):
    assert court.court_segment_table(spark).count() == 10
    assert court.calibration_table(spark).count() == 12
    assert court.template_choices(spark).groupBy("choice").count().where("count <> 4").isEmpty()
    assert {tuple(r)[1:] for r in court.template_lines(spark).collect() if r.name == "middle"} == {(832.0, 1110.0, 832.0, 2386.0)}
    with pytest.raises(ValueError, match="unknown mode"):
        court.calibration_points("5corners")


def test_numbers_follow_the_order_over_tasks(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("image"), F.lit(0).alias("line"))
    assert all(r.n == r.image for r in grids.numbered(df, ["image", "line"], "n").collect())


def test_calibrations_are_checked(spark, tmp_path):
    good, bad = [float(v) for v in (1, 0, 0, 0, 2, 0, 0, 0, 1)], [float(v) for v in (1, 0, 0, 2, 0, 0, 0, 0, 1)]
    rows = [("a", good, "m", 1.0, 2.0), ("b", bad, "m", 1.0, 2.0), ("c", good[:8], "m", 1.0, 2.0), ("d", None, "m", 1.0, 2.0)]
    src.write_calibration(spark.createDataFrame(rows, src.CALIBRATION), f"{tmp_path}/c")
    got = {r.video_id: r.h for r in src.read_calibration(spark, f"{tmp_path}/c", strict=False).collect()}
    assert got["a"] == good
    assert got["b"] == got["c"] == got["d"] == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    with pytest.raises(Exception, match="not a homography"):
        src.read_calibration(spark, f"{tmp_path}/c").collect()


def test_checkpoints_json_and_probes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert src.write_checkpoint(df, f"{tmp_path}/p").collect() == df.collect()
    assert src.read_json_or_empty(spark, f"{tmp_path}/none.json", "k int").count() == 0
    (tmp_path / "one.json").write_text('{"k": 4}\n')
    assert src.read_json_or_empty(spark, f"{tmp_path}/one.json", "k int").first().k == 4
    probes = spark.createDataFrame([(1, "{}"), (2, None), (3, '{"streams":[{"codec_type":"video","width":4,"height":2,"r_frame_rate":"0/0"}]}')], "video_id int, probe string")
    got = {r.video_id: tuple(r)[1:] for r in src.video_info(probes).collect()}
    assert got == {1: (None,) * 4, 2: (None,) * 4, 3: (0.0, 4.0, 2.0, None)}


def test_videos_without_any_value_fail(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, None)], "video_id string, frame bigint, v double")
    assert series.require_any(df.where("video_id = 'a'"), "v").count() == 2
    with pytest.raises(Exception, match="no value in video b"):
        series.require_any(df, "v").collect()
    assert [r.smooth for r in series.ema(df, "v", "smooth", 0.3).orderBy("video_id", "frame").collect()] == [1.0, 1.0, None]


def test_average_over_nulls(spark):
    rows = [("v", i, x) for i, x in enumerate([None, 10.0, None, 20.0, *[None] * 300, 20.0])]
    got = [r.y for r in series.ema(spark.createDataFrame(rows, "video_id string, frame bigint, x double"), "x", "y", 0.3).orderBy("frame").collect()]
    assert got[:4] == [None, 10.0, 10.0, pytest.approx(13.0)]
    assert got[303] == pytest.approx(13.0)
    assert got[304] == pytest.approx(15.1)


def test_detection_checks(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 1.0, 1.5)], "frame int, det int, x1 double, y1 double, x2 double, y2 double, conf double")
    with pytest.raises(Exception, match="out of range"):
        bx.valid_detections(df).collect()


def write_down(folder):
    def post(path, body):
        name = f"{folder}/{path}-{json.loads(body)['video_id']}.json"
        with open(name, "w") as f:
            f.write(body)
        return 200

    return post


def test_request_is_answered(spark, tmp_path):
    from trackwright.plans.tracking_queries import COURT_M, FLAT

    moving = [(200.0 + 4 * (f % 80), 80.0 + 6 * (f % 80)) for f in range(240)]
    rows = [("7", f, "ball", 0, x - 5, y - 5, x + 5, y + 5, 0.8, 0) for f, (x, y) in enumerate(moving) if 60 <= f < 210]
    load = lambda request: {
        "detections": spark.createDataFrame(rows, src.DETECTIONS), "videos": spark.createDataFrame([(str(request["video_id"]), 240)], "video_id string, total_frames bigint"),
        "homography": FLAT, "court": COURT_M,
    }
    request = {"video_id": 7, "video_url": "https://a.example/v.mp4", "features": []}
    out = dispatch("analyze", request, load, write_down(tmp_path))
    assert set(out.seconds) == {"tracking", "sections", "speeds", "send sections", "send ball_speeds", "send player_speeds"}
    sent = {p.name: json.loads(p.read_text())["data"] for p in tmp_path.glob("*.json")}
    assert set(sent) == {"sections-7.json", "ball_speeds-7.json"}
    assert sent["sections-7.json"] == [r.asDict() for r in out.sections.select("start_index", "start_time", "end_index", "end_time").collect()]
    assert len(sent["ball_speeds-7.json"]) == 16
    with pytest.raises(Exception, match="status 500"):
        answer(request, load, lambda path, body: 500)
    with pytest.raises(RequestError, match="unsupported task"):
        dispatch("nothing", request)


def test_streams_are_sent_and_forgotten(spark, tmp_path):
    from trackwright.operators.tracking import single
    from trackwright.streaming.tracks import send_stream, stream_speeds, stream_tracks

    rows = [("v", f, 0, f / 10.0, 0.0, 1.0 if f else None) for f in range(40)] + [("w", f, 0, 0.5, 0.0, 1.0 if f else None) for f in range(3)]
    schema = "video_id string, frame bigint, det int, x double, y double, raw double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    clamped = stream_tracks(source, single.ClampSteps, single.CLAMP_SCHEMA, idle="30 minutes")
    query = send_stream(clamped, write_down(tmp_path), "steps", ["frame", "x"], ["frame"], f"{tmp_path}/cp")
    query.awaitTermination(120)
    sent = json.loads((tmp_path / "steps-v.json").read_text())["data"]
    assert [r["frame"] for r in sent] == list(range(40))
    assert [r["x"] for r in sent] == pytest.approx([f / 10 for f in range(40)])
    assert len(json.loads((tmp_path / "steps-w.json").read_text())["data"]) == 3

    timed = source.withColumns({"at": F.timestamp_seconds(F.col("frame") / 10), "kmh": F.col("x")})
    done = stream_speeds(timed, "at", 0.5).writeStream.outputMode("complete").format("memory").queryName("speeds").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    done.awaitTermination(120)
    got = {(r.video_id, r.start.timestamp() * 10): (r.n, r.top_kmh) for r in spark.table("speeds").collect()}
    assert sum(n for n, _ in got.values()) == 43
    assert max(top for _, top in got.values()) == pytest.approx(3.9)
