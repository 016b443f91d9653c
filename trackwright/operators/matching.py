"""Matching of rows by nearness, and metrics that rest on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .series import part_window, running_sum, with_windows


def gated_pairs(left: DataFrame, right: DataFrame, on: list[str], cost: Column, gate: Column) -> DataFrame:
    """Pairs of one frame (left has a, right has b) that pass the gate, with their cost."""
    return left.join(right, on).withColumn("cost", cost).where(gate)


def mutual_nearest(pairs: DataFrame, on: list[str]) -> DataFrame:
    """Pairs in which each side is the other's cheapest (of equals the smallest a, b)."""
    by_a = Window.partitionBy(*on, "a").orderBy("cost", "b")
    by_b = Window.partitionBy(*on, "b").orderBy("cost", "a")
    ranked = pairs.withColumns({"__a": F.row_number().over(by_a), "__b": F.row_number().over(by_b)})
    return ranked.where("__a = 1 and __b = 1").drop("__a", "__b")


def first_claims(nearest: DataFrame, on: list[str], truth: str, rank: list[Column], hit: Column) -> DataFrame:
    """nearest (each prediction with its one truth row, or none) with tp: the first in rank order that hits its truth row."""
    w = Window.partitionBy(*on, truth, "hit").orderBy(*rank)
    marked = nearest.withColumn("hit", F.coalesce(hit, F.lit(False)))
    return marked.withColumn("tp", (F.col("hit") & (F.row_number().over(w) == 1)).cast("int")).drop("hit")


def nearest_truth(pred: DataFrame, truth: DataFrame, on: list[str], row: str, distance: Column, keep: list[str]) -> DataFrame:
    """Each prediction with dist and t of the nearest truth of its group (of equals the smallest t); both null in a group without truth."""
    pairs = pred.join(truth, on, "left").withColumn("dist", distance)
    return pairs.groupBy(*on, row, *keep).agg(F.min(F.struct("dist", "t")).alias("m")).select(*on, row, *keep, "m.*")


def first_match(rows: str, wanted: Callable[[Column], Column]) -> Column:
    """The first element of an array that is wanted, or null."""
    return F.get(F.filter(rows, wanted), F.lit(0))


def wireframe(pred: DataFrame, truth: DataFrame, pred_edges: DataFrame, truth_edges: DataFrame, limit: float, deep: bool = False) -> DataFrame:
    """For each image: hits (points claimed within limit), depth losses of the hits, and the average precision of edges by length.

    pred, truth: image, point, x, y, z (depth, below 0), score; edges: image, a, b, score. deep counts depth in the distance. A
    predicted edge is right if its ends claimed the ends of a true edge.
    """
    sq = lambda *names: sum((F.pow(F.col(c) - F.col(f"t{c}"), 2) for c in names), F.lit(0.0))
    other = truth.select("image", F.col("point").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    near = nearest_truth(pred, other, ["image"], "point", F.sqrt(sq("x", "y", *(["z"] if deep else []))), ["score", "z"])
    claimed = first_claims(near, ["image"], "t", [F.desc("score"), F.col("point")], F.col("dist") < limit)
    choice = claimed.join(other.select("image", "t", "tz"), ["image", "t"], "left").withColumn("choice", F.when(F.col("tp") == 1, F.col("t")))
    lost = depth_losses(F.when(F.col("tp") == 1, F.col("tz")), F.col("z"))
    points = choice.groupBy("image").agg(F.count("choice").alias("hits"), *(c.alias(n) for n, c in lost.items()))

    at = lambda rows, c: rows.select("image", F.col("point").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    length = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    sized = lambda edges, rows: edges.join(at(rows, "a"), ["image", "a"]).join(at(rows, "b"), ["image", "b"]).withColumn("length", length)
    true_edges = sized(truth_edges, truth).select("image", F.least("a", "b").alias("ca"), F.greatest("a", "b").alias("cb"), "length")
    named = lambda c: choice.select("image", F.col("point").alias(c), F.col("choice").alias(f"{c}_choice"))
    edges = sized(pred_edges, pred).join(named("a"), ["image", "a"]).join(named("b"), ["image", "b"])
    both = F.col("a_choice").isNotNull() & F.col("b_choice").isNotNull()
    edges = edges.withColumns({"ca": F.when(both, F.least("a_choice", "b_choice")), "cb": F.when(both, F.greatest("a_choice", "b_choice"))})
    edges = edges.join(true_edges.select("image", "ca", "cb", F.lit(1.0).alias("hit")), ["image", "ca", "cb"], "left")
    whole = edges.join(true_edges.groupBy("image").agg(F.sum("length").alias("total")), "image")
    up = Window.partitionBy("image").orderBy(F.desc("score"), "a")
    right, seen = F.sum(F.coalesce("hit", F.lit(0.0)) * F.col("length")).over(up), F.sum("length").over(up)
    gain = F.coalesce("hit", F.lit(0.0)) * F.col("length") / F.col("total")
    curve = whole.withColumns({"place": F.row_number().over(up), "recall": right / F.col("total"), "precision": right / seen, "gain": gain})
    down = Window.partitionBy("image").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    areas = average_precision(curve.withColumn("envelope", F.max("precision").over(down)), ["image"])
    return points.join(areas.select("image", "ap"), "image", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def line_set_losses(pred: DataFrame, truth: DataFrame, least_score: float) -> DataFrame:
    """One row: cardinality_error, how far an image's count of confident lines is from its truth, and line_l1, the mean distance to the nearest true line."""
    counts = pred.where(F.col("score") > least_score).select("image", F.lit(1).alias("n")).unionByName(truth.select("image", F.lit(-1).alias("n")))
    images = pred.select("image").unionByName(truth.select("image")).distinct()
    miss = images.join(counts.groupBy("image").agg(F.sum("n").alias("n")), "image", "left").agg(F.avg(F.abs(F.coalesce("n", F.lit(0)))).alias("cardinality_error"))
    names = ("x1", "y1", "x2", "y2")
    other = truth.select("image", F.col("line").alias("t"), *(F.col(c).alias(f"t{c}") for c in names))
    l1 = sum((F.abs(F.col(c) - F.col(f"t{c}")) for c in names), F.lit(0.0))
    return miss.join(nearest_truth(pred, other, ["image"], "line", l1, []).agg(F.avg("dist").alias("line_l1")))


def precision_recall(rows: DataFrame, by: list[str], order: list[Column], truth: DataFrame) -> DataFrame:
    """rows (tp) of each of by, ranked by order, with place, precision, recall, gain (in recall) and envelope, the largest precision from
    here on. truth has a row for each thing to find.

    The whole ranking is dealt by range, so each task holds a stretch of it. Counts are carried from stretch to stretch forwards, and
    the largest precision backwards, over one row for each task.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = materialise(dealt.withColumns({"__task": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "ranking")
    stretch = Window.partitionBy(*by, "__task").orderBy("__row")
    earlier = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    # From the last row backwards: Spark works a frame out anew for each row if it ends with the partition.
    later = Window.partitionBy(*by).orderBy(F.desc("__task")).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "__task").agg(F.count("*").alias("n"), F.sum("tp").alias("hits"))
    carried = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    counts = counts.select(*by, "__task", carried("n").alias("__n"), carried("hits").alias("__hits"))
    up = stretch.rowsBetween(Window.unboundedPreceding, 0)
    n_truth = truth.agg(F.count("*")).scalar()
    found = dealt.join(counts, [*by, "__task"]).withColumns({"place": F.col("__n") + F.row_number().over(stretch), "__hits": F.col("__hits") + F.sum("tp").over(up)})
    found = found.withColumns({"recall": F.col("__hits") / n_truth, "precision": F.col("__hits") / F.col("place"), "gain": F.col("tp") / n_truth})
    found = materialise(found.drop("__n", "__hits"), "ranking-precision")
    best = found.groupBy(*by, "__task").agg(F.max("precision").alias("best")).select(*by, "__task", F.max("best").over(later).alias("__best"))
    down = Window.partitionBy(*by, "__task").orderBy(F.desc("__row")).rowsBetween(Window.unboundedPreceding, 0)
    return found.join(best, [*by, "__task"]).withColumn("envelope", F.greatest(F.max("precision").over(down), "__best")).drop("__task", "__row", "__best")


def average_precision(curve: DataFrame, by: list[str]) -> DataFrame:
    """Area under the envelope, and the best F-score of any point."""
    f = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    return curve.groupBy(*by).agg(F.sum(F.col("gain") * F.col("envelope")).alias("ap"), F.max(f).alias("f_score"))


def top_k_accuracy(scores: DataFrame, row: str, k: int) -> DataFrame:
    """Share of rows whose truth is among their k best classes. scores: row, cls, score, truth."""
    w = Window.partitionBy(row).orderBy(F.desc("score"), "cls")
    ranked = scores.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return ranked.groupBy(row).agg(F.max((F.col("cls") == F.col("truth")).cast("int")).alias("hit")).agg(F.avg("hit").alias("accuracy"))


def meters(df: DataFrame, value: str, window: int = 20) -> DataFrame:
    """Running meter of each frame: count, total and mean so far, and median, mean, largest of the last window values."""
    so_far = running_sum(running_sum(df, F.col(value).isNotNull().cast("long"), "n"), F.coalesce(value, F.lit(0)), "total")
    so_far = so_far.withColumn("total", F.when(F.col("n") > 0, F.col("total"))).withColumn("mean", F.col("total") / F.nullif("n", F.lit(0)))
    recent = part_window().rowsBetween(-(window - 1), 0)
    return with_windows(
        so_far, window - 1, 0, recent_median=F.percentile(value, 0.5).over(recent), recent_mean=F.avg(value).over(recent), recent_max=F.max(value).over(recent)
    )


def line_pair_distance(p: list[Column], q: list[Column]) -> Column:
    """Sum of squared endpoint distances of two lines (x1, y1, x2, y2), in the better of both directions."""
    sq = lambda i, j: F.pow(p[i] - q[j], 2) + F.pow(p[i + 1] - q[j + 1], 2)
    return F.least(sq(0, 0) + sq(2, 2), sq(0, 2) + sq(2, 0))


def depth_losses(truth: Column, guess: Column) -> dict[str, Column]:
    """Aggregates: mean absolute and squared error, and the scale-invariant error of logarithms."""
    log = F.ln(F.greatest(-guess, F.lit(1e-10))) - F.ln(-truth)
    return {"l1": F.avg(F.abs(truth - guess)), "l2": F.avg((truth - guess) * (truth - guess)), "scale_free": F.avg(log * log) - F.avg(log) * F.avg(log)}


def class_losses(p: Column, label: Column, alpha: float = 0.25, gamma: float = 2.0) -> dict[str, Column]:
    """Aggregates for a probability p and a 0/1 label: cross-entropy and focal loss."""
    held = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    right = F.when(label == 1, held).otherwise(1 - held)
    weight = F.when(label == 1, alpha).otherwise(1 - alpha)
    return {"cross_entropy": F.avg(-F.ln(right)), "focal": F.avg(-weight * F.pow(1 - right, F.lit(gamma)) * F.ln(right))}
