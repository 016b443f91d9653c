"""Operators on heatmap cells, junctions and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .series import filled, part_window, with_windows


def junction_peaks(cells: DataFrame, weight: float = 1.0, least: float = 1e-2, top: int = 1000) -> DataFrame:
    """Cells (image, row, col, score) whose score is that of no neighbour times weight or less; each image's top by score."""
    moves = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c))
    around = cells.select("image", "score", "row", "col", F.explode(moves).alias("m"))
    around = around.groupBy("image", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col")).agg(F.max("score").alias("beside"))
    peaks = cells.join(around, ["image", "row", "col"], "left").where((F.col("score") >= least) & (F.coalesce("beside", F.lit(0.0)) * weight < F.col("score")))
    ranked = peaks.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("score"), "row", "col")))
    return ranked.where(F.col("rank") <= top).drop("beside")


def new_pairs(points: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of one image's points (a < b) that are not in known (image, a, b)."""
    pairs = points.select("image", F.col("point").alias("a")).join(points.select("image", F.col("point").alias("b")), "image").where("a < b")
    return pairs.join(known.select("image", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["image", "a", "b"], "left_anti")


def trim_repeats(rows: DataFrame, same: list[str]) -> DataFrame:
    """Rows (image, idx) before the first later one that repeats the first row's values: cyclic padding goes."""
    first = rows.where("idx = 0").select("image", F.struct(*same).alias("__first"))
    marked = rows.join(first, "image").withColumn("__again", (F.struct(*same) == F.col("__first")) & (F.col("idx") > 0))
    cut = marked.groupBy("image").agg(F.min(F.when(F.col("__again"), F.col("idx"))).alias("__cut"))
    return marked.join(cut, "image").where(F.col("__cut").isNull() | (F.col("idx") < F.col("__cut"))).select(*rows.columns)


def threshold_sweep(scored: DataFrame, thresholds: list[float], hit: Column) -> DataFrame:
    """For each threshold: rows above it, hits among them and their share."""
    limits = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col("score") > F.col("threshold"))
    return limits.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.avg(hit.cast("int")).alias("precision"))


def changes(readings: DataFrame, value: str) -> DataFrame:
    """Readings that differ from the one before, the first included; null readings are skipped by their producer."""
    return with_windows(readings, 1, 0, __last=F.lag(value).over(part_window())).where(~F.col(value).eqNullSafe(F.col("__last"))).drop("__last")


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """name: each row's place, from 0, in the order of by over the whole table.

    Rows are dealt by range and numbered in their task; the tasks' counts, one row for each, give where a task begins.
    """
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = materialise(dealt.withColumns({"__task": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__task").agg(F.count("*").alias("n")).select("__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return dealt.join(F.broadcast(starts), "__task").withColumn(name, F.col("__start") + F.col("__row")).drop("__task", "__row", "__start")


def junction_ids(ends: DataFrame, order: list[str]) -> DataFrame:
    """ends (image, x, y and others) with junction: one number, from 0, for each different point of an image."""
    return ends.withColumn("junction", F.dense_rank().over(Window.partitionBy("image").orderBy(*order)) - 1)


def ranked_negatives(pairs: DataFrame, overlap: Column, most: int) -> DataFrame:
    """Each image's most pairs (image, a, b) with the largest overlap, with their rank."""
    w = Window.partitionBy("image").orderBy(F.desc("overlap"), "a", "b")
    return pairs.withColumn("overlap", overlap).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def sampled(rows: DataFrame, by: list[str], key: Column, most: int) -> DataFrame:
    """At most most rows of each group, drawn by the digest of key: the same ones in every run."""
    w = Window.partitionBy(*by).orderBy(F.md5(key.cast("string")))
    return rows.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= most)


def prediction_grid(lines: DataFrame, width: float, height: float, size: int = 128) -> DataFrame:
    """Lines on a grid of size x size cells as (y1, x1, y2, x2), each image's best score first (rank)."""
    scaled = {f"g{c}{i}": F.col(f"{c}{i}") * size / side for i in (1, 2) for c, side in (("y", height), ("x", width))}
    return lines.withColumns(scaled).withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("score"), "line")))


def frame_triples(frames: DataFrame, value: str) -> DataFrame:
    """triple: the values of a frame and of the two before it; null in a video's first two frames."""
    w = part_window()
    three = F.array(F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w))
    return with_windows(frames, 2, 0, triple=F.when(F.col("frame") >= 2, three))


def scoreboard(readings: DataFrame, value: str, fps: float) -> DataFrame:
    """Each change of a reading as index, time and reading; frames without a reading (null) are passed over."""
    seen = with_windows(filled(readings, F.col(value), "__seen", forward=True), 1, 0, __before=F.lag("__seen").over(part_window()))
    new = seen.where(F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col("__before.value")))
    return new.select("video_id", F.col("frame").alias("index"), (F.col("frame") / fps).alias("time"), F.col(value).alias("reading"))
