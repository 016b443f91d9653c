"""Points from heatmaps and refinement of points by lines: rows of cells (image, row, col, score), by votes that are joined and summed.

Cells vote for circle centres and for lines; votes of an image meet by bin, never as a whole image in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .lines import merge_close


def _offsets(low: float, high: float) -> list[tuple[int, int]]:
    """Steps (row, col) to cells at a distance from low to high, rounded to whole cells."""
    far = range(-math.ceil(high), math.ceil(high) + 1)
    return [(r, c) for r in far for c in far if low <= math.floor(math.hypot(r, c) + 0.5) <= high]


def _steps(moves: list[tuple[int, int]], a: str = "dr", b: str = "dc") -> Column:
    return F.explode(F.array(*(F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x, y in moves)))


def outline(cells: DataFrame, threshold: float) -> DataFrame:
    """Cells above the threshold with a neighbour, beside, above or below, that is not, or with none there."""
    lit = cells.where(F.col("score") > threshold).select("image", "row", "col")
    around = lit.select("image", F.col("row").alias("r0"), F.col("col").alias("c0"), _steps([(0, 1), (1, 0), (0, -1), (-1, 0)]).alias("m"))
    around = around.select("image", "r0", "c0", (F.col("r0") + F.col("m.dr")).alias("row"), (F.col("c0") + F.col("m.dc")).alias("col"))
    full = around.join(lit, ["image", "row", "col"]).groupBy("image", F.col("r0").alias("row"), F.col("c0").alias("col")).agg(F.count("*").alias("n")).where("n = 4")
    return lit.join(full, ["image", "row", "col"], "left_anti")


def circle_votes(cells: DataFrame, threshold: float, min_radius: float, max_radius: float) -> DataFrame:
    """image, row, col, votes: outline cells at a distance from min_radius to max_radius of each cell of the image."""
    votes = outline(cells, threshold).select("image", "row", "col", _steps(_offsets(min_radius, max_radius)).alias("m"))
    votes = votes.groupBy("image", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col")).agg(F.count("*").alias("votes"))
    return votes.join(cells.select("image", "row", "col"), ["image", "row", "col"], "left_semi")


def heatmap_points(cells: DataFrame, threshold: float, min_radius: float = 10, max_radius: float = 30, scale: float = 2, least: int = 2) -> DataFrame:
    """image, x, y of every image: the centre with the most votes (of equals the first by row and column) times scale, null below least."""
    found = circle_votes(cells, threshold, min_radius, max_radius).where(F.col("votes") >= least)
    best = found.groupBy("image").agg(F.max_by(F.struct("row", "col"), F.struct("votes", -F.col("row"), -F.col("col"))).alias("b"))
    images = cells.select("image").distinct()
    return images.join(best, "image", "left").select("image", (F.col("b.col") * scale).alias("x"), (F.col("b.row") * scale).alias("y"))


def around_points(cells: DataFrame, points: DataFrame, threshold: float, reach: int) -> DataFrame:
    """image, point, x, y of the cells above the threshold within reach of a point (x, y), counted from the window's corner at the point less
    reach or the image's edge. Both sides meet by blocks of reach cells."""
    lit = cells.where(F.col("score") > threshold).select("image", "row", "col", F.floor(F.col("row") / reach).alias("br"), F.floor(F.col("col") / reach).alias("bc"))
    low = points.withColumns({"x0": F.greatest(F.col("x") - reach, F.lit(0)), "y0": F.greatest(F.col("y") - reach, F.lit(0))})
    block = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach)))
    wide = low.select("image", "point", "x", "y", "x0", "y0", block(F.col("x0"), F.col("x") + reach).alias("bc")).withColumn("br", block(F.col("y0"), F.col("y") + reach))
    met = wide.join(lit, ["image", "br", "bc"])
    inside = (F.col("col") >= F.col("x0")) & (F.col("col") < F.col("x") + reach) & (F.col("row") >= F.col("y0")) & (F.col("row") < F.col("y") + reach)
    return met.where(inside).select("image", "point", (F.col("col") - F.col("x0")).alias("x"), (F.col("row") - F.col("y0")).alias("y"))


def line_votes(cells: DataFrame, angles: int = 180) -> DataFrame:
    """image, point, angle (of the normal, in steps of 180 degrees / angles), offset, votes, and where along the line its first and last
    cell lies (low, high). cells: image, point, x, y."""
    turn = F.col("angle") * (math.pi / angles)
    each = cells.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))))
    each = each.withColumns({"offset": F.floor(F.col("x") * F.cos(turn) + F.col("y") * F.sin(turn) + 0.5).cast("int"), "along": F.col("y") * F.cos(turn) - F.col("x") * F.sin(turn)})
    return each.groupBy("image", "point", "angle", "offset").agg(F.count("*").alias("votes"), F.min("along").alias("low"), F.max("along").alias("high"))


def line_peaks(votes: DataFrame, least: int, apart: int = 2, angles: int = 180) -> DataFrame:
    """Bins with least votes or more that no bin within apart steps of angle and offset outvotes (of equals the first by angle and offset
    stays). The angle after the last is the first, with the offset's sign turned."""
    strong = votes.where(F.col("votes") >= least)
    moves = [(a, o) for a in range(-apart, apart + 1) for o in range(-apart, apart + 1) if a or o]
    other = strong.select("image", "point", F.col("votes").alias("v"), F.col("angle").alias("a0"), F.col("offset").alias("o0"), _steps(moves, "da", "do").alias("m"))
    angle = F.col("a0") + F.col("m.da")
    wrapped = (angle < 0) | (angle >= angles)
    other = other.select("image", "point", "v", "a0", "o0", F.pmod(angle, F.lit(angles)).alias("angle"), (F.when(wrapped, -F.col("o0")).otherwise(F.col("o0")) + F.col("m.do")).alias("offset"))
    before = F.struct("a0", "o0") < F.struct("angle", "offset")
    beaten = strong.join(other, ["image", "point", "angle", "offset"]).where((F.col("v") > F.col("votes")) | ((F.col("v") == F.col("votes")) & before))
    return strong.join(beaten.select("image", "point", "angle", "offset").distinct(), ["image", "point", "angle", "offset"], "left_anti")


def refined_points(cells: DataFrame, points: DataFrame, threshold: float = 155, reach: int = 40, least: int = 30, near: float = 20, angles: int = 180) -> DataFrame:
    """points (image, point, x, y) moved to where two lines cross: lines of the lit cells around each, close ones merged. Where there are not
    exactly two, or they don't cross inside the window, a point stays."""
    peaks = line_peaks(line_votes(around_points(cells, points, threshold, reach), angles), least, angles=angles)
    turn = F.col("angle") * (math.pi / angles)
    end = lambda t: (F.col("offset") * F.cos(turn) - t * F.sin(turn), F.col("offset") * F.sin(turn) + t * F.cos(turn))
    (ax, ay), (bx, by) = end(F.col("low")), end(F.col("high"))
    swap = (ax > bx) | ((ax == bx) & (ay > by))  # ends in order, so that like segments have like ends
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    number = F.col("angle") * 100_000 + F.col("offset")
    segments = peaks.select(F.struct("image", "point").alias("image"), number.alias("line"), pick(ax, bx).alias("x1"), pick(ay, by).alias("y1"), pick(bx, ax).alias("x2"), pick(by, ay).alias("y2"))
    merged = merge_close(segments, near).groupBy("image").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("two")).where(F.size("two") == 2)
    box = lambda i: tuple(F.col("two")[i][c] for c in ("x1", "y1", "x2", "y2"))
    cx, cy = g.line_intersection(box(0), box(1))
    crossing = merged.select("image.image", "image.point", F.floor(cx).alias("cx"), F.floor(cy).alias("cy"))
    joined = points.join(crossing, ["image", "point"], "left")
    x0, y0 = (F.greatest(F.col(c) - reach, F.lit(0)) for c in ("x", "y"))
    inside = (F.col("cx") > 0) & (F.col("cy") > 0) & (x0 + F.col("cx") < F.col("x") + reach) & (y0 + F.col("cy") < F.col("y") + reach)
    move = lambda c, low, by: F.when(inside, low + F.col(by)).otherwise(F.col(c)).cast("double").alias(c)
    return joined.select("image", "point", move("x", x0, "cx"), move("y", y0, "cy"), F.coalesce(inside, F.lit(False)).alias("moved"))


def patches(cells: DataFrame, values: list[str]) -> DataFrame:
    """image, row, col and, for each value v, v00, v01, v10, v11: the values of the cell, of that to its right, of those below both; null
    where there is none."""
    each = cells.select("image", "row", "col", *values, _steps([(0, 0), (0, 1), (1, 0), (1, 1)]).alias("m"))
    corner = lambda v, r, c: F.max(F.when((F.col("m.dr") == r) & (F.col("m.dc") == c), F.col(v))).alias(f"{v}{r}{c}")
    place = [(F.col(c) - F.col(f"m.d{c[0]}")).alias(c) for c in ("row", "col")]
    return each.groupBy("image", *place).agg(*(corner(v, r, c) for v in values for r in (0, 1) for c in (0, 1)))


def candidate_lines(points: DataFrame) -> DataFrame:
    """image, a, b, x1, y1, x2, y2 of the lines between an image's points (image, point, x, y), a before b. Images have few points: see
    junction_peaks's top."""
    one = lambda name, i: points.select("image", F.col("point").alias(name), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    return one("a", 1).join(one("b", 2), "image").where("a < b")


def pooled_lines(cells: DataFrame, lines: DataFrame, values: list[str], rows: int, cols: int, points: int = 32, pools: int = 8) -> DataFrame:
    """lines (image, a, b, x1, y1, x2, y2) with pooled: of each value the largest in each of pools stretches of the line.

    A value is taken at points places from the second end to the first, between the middles of the four cells around, of an image of rows x
    cols cells (missing ones are 0). Before the first middle the two nearest are drawn out; behind the last the value is 0. A place meets
    its four cells as one row (patches), so only places go through the join, and the pools are made before the shuffle by line.
    """
    t = F.col("k") / (points - 1)
    at = lambda c: (F.col(f"{c}1") * t + F.col(f"{c}2") * (1 - t) - 0.5).alias(c)
    each = lines.select("image", "a", "b", "x1", "y1", "x2", "y2", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).select("image", "a", "b", "k", at("x"), at("y"))
    held = lambda c, size: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(size - 1)).cast("int")
    met = each.withColumns({"row": held("y", rows), "col": held("x", cols)}).join(patches(cells, values), ["image", "row", "col"], "left")
    bottom, right = F.col("row") == rows - 1, F.col("col") == cols - 1
    up, left = F.when(bottom, F.col("row")).otherwise(F.col("row") + 1) - F.col("y"), F.when(right, F.col("col")).otherwise(F.col("col") + 1) - F.col("x")
    down, over = F.col("y") - F.col("row"), F.col("x") - F.col("col")

    def value(v: str) -> Column:
        cell = lambda r, c: F.coalesce(F.col(f"{v}{r}{c}"), F.lit(0.0))
        beside, below = F.when(right, cell(0, 0)).otherwise(cell(0, 1)), F.when(bottom, cell(0, 0)).otherwise(cell(1, 0))
        across = F.when(right, below).when(bottom, beside).otherwise(cell(1, 1))
        return cell(0, 0) * up * left + below * down * left + beside * up * over + across * down * over

    pool = F.floor(F.col("k") / (points // pools))
    found = met.select("image", "a", "b", pool.alias("pool"), *(value(v).alias(v) for v in values)).groupBy("image", "a", "b")
    return found.agg(F.array(*(F.max(F.when(F.col("pool") == i, F.col(v))) for v in values for i in range(pools))).alias("pooled"))


def scored_lines(pooled: DataFrame, weights: list[float], bias: float, least: float = 0.5) -> DataFrame:
    """pooled with score, the logistic of the weighted pools, where it is above least, and rank: each image's best first."""
    total = sum((F.col("pooled")[i] * w for i, w in enumerate(weights)), F.lit(float(bias)))
    kept = pooled.withColumn("score", 1 / (1 + F.exp(-total))).where(F.col("score") > least)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc(F.round("score", 9)), "a", "b")))


def padded_lines(ranked: DataFrame, n: int) -> DataFrame:
    """The n rows (idx, from 0) of each image that its ranked lines give when they are taken over and over; trim_repeats takes them back."""
    sized = ranked.withColumn("__n", F.count("*").over(Window.partitionBy("image"))).where(F.col("rank") <= n)
    again = F.sequence(F.col("rank").cast("int") - 1, F.lit(n - 1), F.col("__n").cast("int"))
    return sized.withColumn("idx", F.explode(again)).drop("__n")
