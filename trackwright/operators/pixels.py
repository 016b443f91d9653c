"""Lines as pixels, one-to-one matching of predicted and true pixels, and the precision that follows."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Pixel = tuple[int, int]


def line_pixels(lines: DataFrame) -> DataFrame:
    """image, row, col, score of the cells that lines (image, x1, y1, x2, y2, score) go through, one for each unit of a line's longer side;
    score is the largest of the lines there. Lines without finite ends have no cells."""
    ends = ("x1", "y1", "x2", "y2")
    sane = F.lit(True)
    for c in ends:
        sane &= F.abs(c) < 1e9
    steps = F.greatest(F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))), F.lit(1)).cast("int")
    each = lines.where(sane).withColumn("n", steps).select("image", "score", *ends, "n", F.explode(F.sequence(F.lit(0), "n")).alias("k"))
    cell = lambda c: F.floor(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * (F.col("k") / F.col("n")) + 0.5).cast("int")
    return each.groupBy("image", cell("y").alias("row"), cell("x").alias("col")).agg(F.max("score").alias("score"))


def gains(pixels: list[Pixel], truth: set[Pixel], near: list[Pixel]) -> list[int]:
    """For each pixel in turn, 1 if the largest one-to-one matching of the pixels up to it is larger by one, else 0.

    Each pixel looks for an augmenting path. What a search without success has met can't lie on a later path, so it is not met again.
    """
    owner: dict[Pixel, Pixel] = {}
    taken: dict[Pixel, Pixel] = {}
    dead: set[Pixel] = set()
    out = []
    for start in pixels:
        came: dict[Pixel, Pixel] = {}
        queue, free = deque([start]), None
        while queue and free is None:
            p = queue.popleft()
            for dr, dc in near:
                q = (p[0] + dr, p[1] + dc)
                if q in truth and q not in came and q not in dead:
                    came[q] = p
                    if q not in owner:
                        free = q
                        break
                    queue.append(owner[q])
        out.append(int(free is not None))
        if free is None:
            dead.update(came)
        while free is not None:
            p = came[free]
            owner[free] = p
            taken[p], free = free, taken.get(p)
    return out


def claimed_pixels(pred: DataFrame, truth: DataFrame, radius: float) -> DataFrame:
    """pred (image, row, col, score; a cell once for each image) with tp, 1 where the pixel adds to the largest one-to-one matching, within
    radius, of those at or before it by score, row and col. So the tp of all pixels above any threshold sum up to the size of
    that threshold's largest matching, and one pass serves all thresholds. A task holds the pixels of one image at a time."""
    far = range(-int(radius), int(radius) + 1)
    near = sorted(((r, c) for r in far for c in far if math.hypot(r, c) <= radius), key=lambda m: (math.hypot(*m), m))

    def run(p, t):
        p = p.sort_values(["score", "row", "col"], ascending=[False, True, True])
        cells = lambda x: zip(x["row"].tolist(), x["col"].tolist(), strict=True)
        return p.assign(tp=gains(list(cells(p)), set(cells(t)), near))

    columns = ["image", "row", "col", "score"]
    kind = pred.schema["image"].dataType.simpleString()
    both = pred.select(*columns).groupBy("image").cogroup(truth.select("image", "row", "col").groupBy("image"))
    return both.applyInPandas(run, f"image {kind}, row int, col int, score double, tp int")


def pixel_sums(claimed: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, gt over all images: pixels with a score above each threshold, matched and not, and true pixels."""
    limits = F.array(*(F.lit(float(t)) for t in sorted(thresholds)))
    # Pixels are summed up by how many thresholds they pass before they are counted for each of those.
    passed = claimed.groupBy(F.size(F.filter(limits, lambda t: t < F.col("score"))).alias("n")).agg(F.sum("tp").alias("tp"), F.count("*").alias("all")).where("n > 0")
    counted = passed.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "tp", "all").groupBy("i").agg(F.sum("tp").alias("tp"), F.sum("all").alias("all"))
    rows = claimed.sparkSession.range(1).select(F.posexplode(limits).alias("i", "threshold")).join(counted, "i", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = truth.agg(F.count("*")).scalar()
    return rows.select("threshold", zero("tp").alias("tp"), (zero("all") - zero("tp")).alias("fp"), total.alias("gt"))


def pixel_precision(sums: DataFrame) -> DataFrame:
    """One row: ap, the area under the precision envelope over recall, from the highest threshold to the lowest, and the best f_score; null
    without true pixels. A row for each threshold goes through one task."""
    known = sums.withColumns({"recall": F.col("tp") / F.nullif("gt", F.lit(0)), "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1e-9))})
    down = Window.orderBy(F.desc("threshold"))
    later = down.rowsBetween(0, Window.unboundedFollowing)
    curve = known.withColumns({"gain": F.col("recall") - F.coalesce(F.lag("recall").over(down), F.lit(0.0)), "envelope": F.max("precision").over(later)})
    f = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    return curve.agg(F.sum(F.col("gain") * F.col("envelope")).alias("ap"), F.max(f).alias("f_score"))
