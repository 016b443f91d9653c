"""Ranking and matching by hand, in images without truth too."""

import math

import pytest
from pyspark.sql import functions as F

from trackwright.operators import matching as mt


def points(spark, rows):
    return spark.createDataFrame(rows, "image long, p long, x double, score double")


def nearest(spark):
    pred = points(spark, [(1, 1, 0.0, 0.9), (1, 2, 5.0, 0.8), (2, 3, 1.0, 0.7), (1, 4, 1.0, 0.6)])
    truth = spark.createDataFrame([(1, 10, 0.5), (1, 11, 5.5), (3, 12, 0.0)], "image long, t long, tx double")
    return mt.nearest_truth(pred, truth, ["image"], "p", F.abs(F.col("x") - F.col("tx")), ["score"]), truth


def test_predictions_without_truth_are_misses(spark):
    found, truth = nearest(spark)
    assert {r.p: (r.dist, r.t) for r in found.collect()} == {1: (0.5, 10), 2: (0.5, 11), 3: (None, None), 4: (0.5, 10)}
    claimed = mt.first_claims(found, ["image"], "t", [F.desc("score"), F.col("p")], F.col("dist") < 1)
    assert {r.p: r.tp for r in claimed.collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    curve = mt.precision_recall(claimed.withColumn("k", F.lit(0)), ["k"], [F.desc("score"), F.col("p")], truth)
    # By hand: hits 1, 2, 2, 2 of 3 at places 1 to 4; image 2's prediction takes the third place.
    rows = sorted((r.place, r.p, round(r.precision, 6), round(r.recall, 6), r.envelope) for r in curve.collect())
    assert rows == [(1, 1, 1.0, 0.333333, 1.0), (2, 2, 1.0, 0.666667, 1.0), (3, 3, 0.666667, 0.666667, 2 / 3), (4, 4, 0.5, 0.666667, 0.5)]
    (area,) = mt.average_precision(curve, ["k"]).collect()
    assert area.ap == pytest.approx(2 / 3)
    assert area.f_score == pytest.approx(0.8)


def test_ranking_over_many_stretches(spark):
    """One threshold's ranking over all tasks, against a plain loop."""
    rows = [(i % 2, (i * 7919) % 1009 / 1009, i, int((i * 31) % 7 < 3)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k long, score double, i long, tp int").repartition(5)
    truth = spark.range(4000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.i): (r.place, r.precision, r.recall, r.envelope) for r in mt.precision_recall(frame, ["k"], [F.desc("score"), F.col("i")], truth).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in (0, 1):
        own, hits, curve = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 0, []
        for place, (_, _, i, tp) in enumerate(own, 1):
            hits += tp
            curve.append((i, place, hits / place, hits / 4000))
        best = 0.0
        for i, place, precision, recall in reversed(curve):
            best = max(best, precision)
            assert got[k, i] == pytest.approx((place, precision, recall, best))


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().lower()


def test_no_envelope_looks_at_all_later_rows_for_each_row(spark):
    """A frame that ends with its partition takes time with the square of a stretch."""
    frame = spark.createDataFrame([(0, 0.5, 1, 1)], "k long, score double, i long, tp int")
    assert "unboundedfollowing" not in plan_of(mt.precision_recall(frame, ["k"], [F.desc("score"), F.col("i")], spark.range(1)))
    points, edges = "image long, point long, x double, y double, z double, score double", "image long, a long, b long, score double"
    pred, chain = spark.createDataFrame([(1, 1, 0.0, 0.0, -1.0, 0.9)], points), spark.createDataFrame([(1, 1, 2, 0.9)], edges)
    assert "unboundedfollowing" not in plan_of(mt.wireframe(pred, pred, chain, chain, 5.0))


def test_wireframe_keeps_images_without_truth(spark):
    cols = "image long, point long, x double, y double, z double, score double"
    pred = spark.createDataFrame([(1, 1, 0.0, 0.0, -1.0, 0.9), (1, 2, 10.0, 0.0, -1.0, 0.8), (2, 3, 0.0, 0.0, -1.0, 0.7)], cols)
    truth = spark.createDataFrame([(1, 7, 1.0, 0.0, -1.0, 1.0), (1, 8, 9.0, 0.0, -1.0, 1.0)], cols)
    edges = lambda rows: spark.createDataFrame(rows, "image long, a long, b long, score double")
    rows = {r.image: r for r in mt.wireframe(pred, truth, edges([(1, 1, 2, 0.5)]), edges([(1, 7, 8, 1.0)]), 5.0).collect()}
    assert (rows[1].hits, rows[1].l1, rows[1].ap) == (2, 0.0, pytest.approx(10 / 8))
    assert (rows[2].hits, rows[2].l1, rows[2].ap) == (0, None, 0.0)


def test_meters_against_a_loop(spark):
    values = [None if i % 7 == 3 else math.sin(i) * 10 for i in range(9000)]
    rows = mt.meters(spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "video_id long, frame long, v double"), "v", 5).collect()
    got = {r.frame: r for r in rows}
    n, total = 0, 0.0
    for i, v in enumerate(values):
        n, total = n + (v is not None), total + (v or 0.0)
        recent = [x for x in values[max(0, i - 4) : i + 1] if x is not None]
        assert (got[i].n, got[i].total, got[i].mean, got[i].recent_max) == (n, pytest.approx(total, abs=1e-9), pytest.approx(total / n, abs=1e-9), max(recent))
