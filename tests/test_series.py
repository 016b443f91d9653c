import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackwright.operators import segments as g
from trackwright.operators import series as s


def series(spark, values, name="speed"):
    kind = "boolean" if isinstance(next((v for v in values if v is not None), None), bool) else "double"
    return spark.createDataFrame([("v", i, v) for i, v in enumerate(values)], f"video_id string, frame bigint, {name} {kind}")


def column(df, name):
    return [r[name] for r in df.orderBy("frame").collect()]


def test_nearest_fill_prefers_the_earlier(spark):
    assert column(s.nearest_fill(series(spark, [None, 1.0, None, None, 2.0, None]), "speed"), "speed") == [1, 1, 1, 2, 2, 2]
    assert column(s.nearest_fill(series(spark, [1.0, None, 2.0]), "speed"), "speed") == [1, 1, 2]


def test_lerp_holds_the_ends(spark):
    assert column(s.lerp_gaps(series(spark, [None, 1.0, None, 3.0, None]), "speed"), "speed") == [1, 1, 2, 3, 3]


def test_sampled_frames(spark):
    frames = spark.range(100).withColumn("frame", F.col("id")).where(s.is_sampled(F.col("id"), 30, 0.5))
    assert [r.id for r in frames.orderBy("id").collect()] == [0, 15, 30, 45, 60, 75, 90]


def test_centred_window():
    assert s.centred(7) == (3, 3)
    assert s.centred(6) == (3, 2)


def test_slope_uses_squared_weights(spark):
    df = spark.createDataFrame([("v", i, float(t), float(x)) for i, (t, x) in enumerate([(-1, 0), (0, 2), (1, 3)])], "video_id string, frame bigint, t double, x double")
    assert column(s.weighted_slope(df, "t", "x"), "slope")[-1] == pytest.approx(1.3812692653)


@pytest.mark.parametrize("chunk", [4, 16])
def test_chunks_do_not_change_results(spark, chunk):
    rng = np.random.default_rng(chunk)
    values = [None if rng.random() < 0.4 else float(round(v, 2)) for v in rng.random(60)]
    df = series(spark, values)
    want = pd.Series([np.nan if v is None else v for v in values])
    forward = column(s.filled(df, F.col("speed"), "f", True, chunk).withColumn("f", F.col("f.value")), "f")
    backward = column(s.filled(df, F.col("speed"), "f", False, chunk).withColumn("f", F.col("f.value")), "f")
    total = column(s.running_sum(df, F.coalesce("speed", F.lit(0.0)), "t", chunk), "t")
    assert [np.nan if v is None else v for v in forward] == pytest.approx(want.ffill().tolist(), nan_ok=True)
    assert [np.nan if v is None else v for v in backward] == pytest.approx(want.bfill().tolist(), nan_ok=True)
    assert total == pytest.approx(want.fillna(0).cumsum().tolist())
    windows = s.with_windows(df, 3, 2, chunk, m=F.avg("speed").over(s.part_window().rowsBetween(-3, 2)))
    mean = [want[max(0, i - 3) : i + 3].mean() for i in range(60)]
    assert [np.nan if v is None else v for v in column(windows, "m")] == pytest.approx(mean, nan_ok=True)


def test_ema_over_many_chunks(spark):
    values = [float(v) for v in np.random.default_rng(0).random(700)]
    got = column(s.ema(series(spark, values), "speed", "y", 0.3), "y")
    assert got == pytest.approx(pd.Series(values).ewm(alpha=0.3, adjust=False).mean().tolist())


def test_suppress_then_dead_then_active(spark):
    flags = [True, True, False, True, True, True, True, True, False]
    df = series(spark, flags, "ok")
    kept = g.suppress_short(df, F.col("ok"), 10, 2)
    assert column(kept, "value") == [False] * 3 + [True] * 5 + [False]
    dead = g.false_runs(kept, F.col("value"), 4, 2)
    assert [(r.start, r.end) for r in dead.collect()] == [(0, 2)]
    videos = spark.createDataFrame([("v", 540)], "video_id string, total_frames bigint")
    active = g.active_intervals(dead, videos, 2, 30).collect()
    assert [(r.start_index, r.end_index) for r in active] == [(121, 540)]
    assert active[0].start_time == pytest.approx(121 / 30)
    assert active[0].end_time == 18


def test_one_rally(spark):
    df = spark.range(300).select(F.lit("v").alias("video_id"), F.col("id").alias("frame"), F.lit(None).cast("double").alias("kmh"))
    got = g.rally_sections(df, F.col("frame").between(60, 209), F.col("kmh")).collect()
    assert [(r.start_index, r.start_time, r.end_index, r.end_time) for r in got] == [(0, 0.0, 270, 9.0)]


def reference_rallies(present, speed, p):
    """The section rules frame by frame."""
    raw, start, empty, n = [], None, 0, len(present)
    for i in range(n):
        missing = not present[i] or (i > 0 and speed[i] is not None and speed[i] < p.min_kmh)
        if not missing:
            start = i if start is None else start
        elif start is not None:
            empty += 1
            if empty > p.max_gap * p.fps:
                if i - start > p.min_seconds * p.fps and empty / (i - start) < p.null_ratio:
                    raw.append((start, i))
                start, empty = None, 0
    if start is not None and n - start > p.min_seconds * p.fps:
        raw.append((start, n))
    out = []
    for a, b in raw:
        end = int(min(b + p.after * p.fps, n))
        if out and a - out[-1][1] < p.min_between * p.fps:
            out[-1][1] = end
        else:
            out.append([int(max(a - p.before * p.fps, 0)), end])
    return [tuple(x) for x in out]


def test_rallies_match_a_loop(spark):
    rng = np.random.default_rng(5)
    p = g.Rally(fps=4)
    rows, want = [], {}
    for video in range(30):
        present = rng.random(90) < rng.uniform(0.4, 0.95)
        speed = [None if rng.random() < 0.3 else float(rng.uniform(0, 60)) for _ in range(90)]
        rows += [(video, i, bool(present[i]), speed[i]) for i in range(90)]
        want[video] = reference_rallies(present, speed, p)
    df = spark.createDataFrame(rows, "video_id bigint, frame bigint, present boolean, speed double")
    got = {v: [] for v in want}
    for r in g.rally_sections(df, F.col("present"), F.col("speed"), p).orderBy("video_id", "section_idx").collect():
        got[r.video_id].append((r.start_index, r.end_index))
    assert got == want


def test_keypoint_step_rounds_half_to_even(spark):
    row = spark.range(1).select(g.keypoint_step(F.lit(0.0), F.lit(1500.0), 300.0, F.lit(6)).alias("k")).first()
    assert row.k == 2


def test_serves_after_the_first_shot(spark):
    shots = spark.createDataFrame([("p1", 10, "serve"), ("p1", 90, "serve"), ("p2", 50, "forehand")], "player string, frame bigint, shot_type string").withColumn("section", F.lit(1))
    assert column(g.relabel_serves(shots, ["section"]), "shot_type") == ["serve", "forehand", "forehand"]


def test_empty_series(spark):
    empty = series(spark, [1.0]).where("false")
    assert s.smooth_speed(empty).count() == 0
    assert g.rally_sections(empty, F.col("speed").isNotNull(), F.col("speed")).count() == 0
    assert s.nearest_fill(empty, "speed").count() == 0


def test_all_null_video_has_no_speeds(spark):
    df = series(spark, [1.0, None, None]).withColumn("speed", F.lit(None).cast("double"))
    assert s.smooth_speed(df).count() == 0
