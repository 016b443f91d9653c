"""Folds by blocks against plain loops over whole videos."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackwright.operators import folds
from trackwright.operators import segments as sg
from trackwright.operators.series import ema


def frames(spark, videos):
    rows = [(v, i, x) for v, values in videos.items() for i, x in enumerate(values)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["video_id", "frame", "x"]), "video_id long, frame long, x double").repartition(4)


def flags(seed, n, stay):
    """Values with runs of nulls."""
    rnd, out, on = random.Random(seed), [], True
    for i in range(n):
        on = on if rnd.random() < stay else not on
        out.append(float((i * 13 + rnd.randrange(3) * 40) % 400) if on else float("nan"))
    return out


def rally_by_hand(values, p):
    allowed, total = int(p.max_gap * p.fps), len(values)
    raw, start, empty = [], None, 0
    for i, x in enumerate(values):
        gone = x != x or (i > 0 and x < p.min_kmh)
        if not gone:
            start = i if start is None else start
        elif start is not None:
            empty += 1
            if empty > allowed:
                if i - start > p.min_seconds * p.fps and empty / (i - start) < p.null_ratio:
                    raw.append((start, i))
                start, empty = None, 0
    if start is not None and total - start > p.min_seconds * p.fps:
        raw.append((start, total))
    out = []
    for s, e in raw:
        end = int(min(e + p.after * p.fps, total))
        if out and s - out[-1][1] < p.min_between * p.fps:
            out[-1][1] = end
        else:
            out.append([int(max(s - p.before * p.fps, 0)), end])
    return [(i, s, e) for i, (s, e) in enumerate(out)]


def tracks_by_hand(values, max_gap, max_jump, least):
    runs = []
    for i, x in enumerate(values):
        if runs and runs[-1][0] == (x == x):
            runs[-1][2] = i
        else:
            runs.append([x == x, i, i])
    begin, out = 0, []
    for (_, _, b), (on, first, last), (_, a, _) in zip(runs, runs[1:], runs[2:], strict=False):
        n = last - first + 1
        if not on and (n >= max_gap or abs(values[b] - values[a]) / n > max_jump) and first - begin > least:
            out.append((begin, first))
            begin = last
    if len(values) - begin > least:
        out.append((begin, len(values)))
    return [(i, s, e) for i, (s, e) in enumerate(out)]


def kept_by_hand(marks, gap):
    last, kept = 0, []
    for i in marks:
        if i - last > gap:
            kept.append(i)
            last = i
    return kept


@pytest.mark.parametrize("chunk", [16, 4096])
def test_folds_against_loops(spark, monkeypatch, chunk):
    monkeypatch.setattr(folds.kept_chain, "__defaults__", (chunk,))
    monkeypatch.setattr(folds.gap_sections, "__defaults__", (chunk,))
    videos = {1: flags(1, 6000, 0.9), 2: flags(2, 3000, 0.99), 3: [float("nan")] * 50, 4: [50.0] * 200, 5: flags(5, 9000, 0.6), 6: [float("nan")] * 5000 + [50.0] * 100}
    df = frames(spark, videos).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    p = sg.Rally()
    got = sg.rally_sections(df, F.col("x").isNotNull(), F.col("x"), p).collect()
    cut = sg.split_tracks(df, F.col("x").isNotNull(), F.col("x"), F.lit(0.0), 3, 80.0, 5).collect()
    marked = sg.debounce(df, F.col("x") > 300, 60).collect()
    for v, values in videos.items():
        assert sorted((r.section_idx, r.start_index, r.end_index) for r in got if r.video_id == v) == rally_by_hand(values, p)
        assert sorted((r.track_idx, r.start, r.end) for r in cut if r.video_id == v) == tracks_by_hand(values, 3, 80.0, 5)
        assert sorted(r.frame for r in marked if r.video_id == v) == kept_by_hand([i for i, x in enumerate(values) if x > 300], 60)


def test_one_long_video(spark):
    """A video of a million frames: no task folds more than a block's runs."""
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.lit(7).cast("long").alias("video_id"), F.col("id").alias("frame"), F.when(F.pmod(F.xxhash64(F.floor(F.col("id") / 5)), F.lit(3)) > 0, 50.0).alias("x"))
    rows = df.orderBy("frame").toPandas()["x"].tolist()
    p = sg.Rally(max_gap=0.2)
    got = sg.rally_sections(df, F.col("x").isNotNull(), F.col("x"), p).collect()
    want = rally_by_hand(rows, p)
    assert len(want) > 100
    assert sorted((r.section_idx, r.start_index, r.end_index) for r in got) == want
    plan = sg.debounce(df, F.col("x").isNotNull(), 60)
    assert [r.frame for r in plan.orderBy("frame").collect()] == kept_by_hand([i for i, x in enumerate(rows) if x == x], 60)


def test_average_of_weight_one_is_the_value(spark):
    df = frames(spark, {1: [1.0, float("nan"), 5.0, float("nan")], 2: [float("nan"), 2.0]}).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    assert {(r.video_id, r.frame): r.y for r in ema(df, "x", "y", 1.0).collect()} == {(1, 0): 1.0, (1, 1): 1.0, (1, 2): 5.0, (1, 3): 5.0, (2, 0): None, (2, 1): 2.0}
    with pytest.raises(ValueError):
        ema(df, "x", "y", 0.0)
