"""Operators on line segments: rows keyed by image, with line, x1, y1, x2, y2, score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import materialise
from .boxes import box


def _others(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("image", *(F.col(c).alias(f"o_{c}") for c in ("line", "x1", "y1", "x2", "y2", *extra)))


def without_duplicates(df: DataFrame, min_length: float, degrees: float = 5.0, near: float = 10.0) -> DataFrame:
    """Lines of min_length or more, but for those with a longer line of nearly the same direction and an endpoint nearby."""
    s = df.withColumns({"length": F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), "angle": g.segment_angle(box())}).where(F.col("length") >= min_length)
    o = _others(s, "length", "angle")
    ends = lambda p: [(F.col(f"{p}x1"), F.col(f"{p}y1")), (F.col(f"{p}x2"), F.col(f"{p}y2"))]
    touch = F.least(*(g.distance(a, b) for a in ends("") for b in ends("o_"))) <= near
    longer = (F.col("o_length") > F.col("length")) | ((F.col("o_length") == F.col("length")) & (F.col("o_line") < F.col("line")))
    cond = (s["image"] == o["image"]) & (F.col("o_line") != F.col("line")) & longer & (g.angle_between(F.col("angle"), F.col("o_angle")) <= degrees) & touch
    return s.join(o, cond, "left_anti")


def crossing_pairs(df: DataFrame, reach: float = 0.0) -> DataFrame:
    """Pairs of one image's segments (a < b) that meet once each is lengthened by reach of its length at both ends."""
    a = df.select("image", F.col("line").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")))
    b = df.select("image", F.col("line").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    p, q = box("a_"), box("b_")
    ux, uy, vx, vy = p[2] - p[0], p[3] - p[1], q[2] - q[0], q[3] - q[1]
    det = ux * vy - uy * vx
    t = ((q[0] - p[0]) * vy - (q[1] - p[1]) * vx) / det
    s = ((q[0] - p[0]) * uy - (q[1] - p[1]) * ux) / det
    return a.join(b, "image").where((F.col("a") < F.col("b")) & (det != 0) & t.between(-reach, 1 + reach) & s.between(-reach, 1 + reach)).select("image", "a", "b")


def line_components(df: DataFrame, edges: DataFrame) -> DataFrame:
    """image, line, component: the smallest line that a chain of crossing pairs (image, a, b) reaches."""
    both = materialise(edges.select("image", "a", "b").union(edges.select("image", "b", "a")), "line-edges")
    labels = materialise(df.select("image", "line", F.col("line").alias("component")), "line-labels")
    while True:
        near = both.join(labels.select("image", F.col("line").alias("b"), "component"), ["image", "b"]).groupBy("image", F.col("a").alias("line")).agg(F.min("component").alias("near"))
        moved = materialise(
            labels.join(near, ["image", "line"], "left")
            .select("image", "line", F.least("component", F.coalesce("near", "component")).alias("component"), (F.col("near") < F.col("component")).alias("moved")),
            "line-labels",
        )
        labels = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return labels


def largest_components(components: DataFrame, most: int = 2, least_lines: int = 3) -> DataFrame:
    """The lines of each image's largest components."""
    from pyspark.sql import Window

    sizes = components.groupBy("image", "component").agg(F.count("*").alias("size")).where(F.col("size") >= least_lines)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("size"), "component"))).where(F.col("rank") <= most)
    return components.join(ranked, ["image", "component"])


def merge_close(df: DataFrame, near: float = 20.0) -> DataFrame:
    """Segments in order of x1; each is averaged into the first earlier one whose both ends are within near.

    An image's segments are folded as one array; an image has a bounded number of them.
    """
    one = F.struct("x1", "y1", "x2", "y2", "line")
    close = lambda k, s: (g.distance((k["x1"], k["y1"]), (s["x1"], s["y1"])) < near) & (g.distance((k["x2"], k["y2"]), (s["x2"], s["y2"])) < near)
    mean = lambda k, s: F.struct(*((((k[c] + s[c]) / 2).alias(c)) for c in ("x1", "y1", "x2", "y2")), k["line"].alias("line"))

    def add(kept, s):
        hits = F.transform(kept, lambda k: close(k, s))
        first = F.array_position(hits, True)
        return F.when(first == 0, F.concat(kept, F.array(s))).otherwise(F.transform(kept, lambda k, i: F.when(i == first - 1, mean(k, s)).otherwise(k)))

    grouped = df.groupBy("image").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return grouped.select("image", F.explode(F.aggregate("all", F.slice("all", 1, 0), add)).alias("s")).select("image", "s.*")


def hungarian(costs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one assignment of least total cost in each group: keys, a, b, cost. A group is one image's pairs.

    Shortest augmenting paths with row and column potentials; a missing pair cannot be chosen.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.sort(group["a"].unique()), np.sort(group["b"].unique())
        flip = len(rows) > len(cols)
        if flip:
            rows, cols = cols, rows
        first, second = ("b", "a") if flip else ("a", "b")
        worst = float(np.abs(group["cost"]).sum()) + 1.0
        c = np.full((len(rows), len(cols)), worst)
        c[np.searchsorted(rows, group[first]), np.searchsorted(cols, group[second])] = group["cost"]
        n, m = c.shape
        row_price, col_price, match = np.zeros(n), np.zeros(m), np.full(m, -1)
        for i in range(n):
            reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
            row, last, base = i, -1, 0.0
            while True:
                step = base + c[row] - row_price[row] - col_price
                better = ~done & (step < reach)
                reach[better], via[better] = step[better], last
                col = int(np.where(done, np.inf, reach).argmin())
                base, done[col] = reach[col], True
                if match[col] < 0:
                    break
                row, last = match[col], col
            for j in np.flatnonzero(done):
                if match[j] >= 0:
                    row_price[match[j]] += base - reach[j]
                col_price[j] -= base - reach[j]
            row_price[i] += base
            while col >= 0:
                before = via[col]
                match[col] = match[before] if before >= 0 else i
                col = before
        chosen = [(rows[match[j]], cols[j]) for j in range(m) if match[j] >= 0 and c[match[j], j] < worst]
        pairs = pd.DataFrame(chosen, columns=[first, second])
        return pairs.merge(group, on=["a", "b"])[[*keys, "a", "b", "cost"]]

    return costs.select(*keys, "a", "b", "cost").groupBy(*keys).applyInPandas(solve, costs.select(*keys, "a", "b", "cost").schema)


def uncovered(covers: np.ndarray) -> tuple[float, float]:
    """What is left of [0, 1] when intervals (low, high) that reach its ends, one by one or joined together, are taken away.

    Intervals strictly inside what is left do not cut it in two. Start is not below end if nothing is left.
    """
    start, end = 0.0, 1.0
    for low, high in covers[covers[:, 0].argsort()]:
        if low > start:
            break
        start = max(start, high)
    for low, high in covers[covers[:, 1].argsort()[::-1]]:
        if high < end:
            break
        end = min(end, low)
    return start, end


def clip_overlaps(df: DataFrame, threshold: float = 0.01, slack: float = 1e9) -> DataFrame:
    """Lines of each image, best score first, less what better lines cover at their ends; image, line, x1, y1, x2, y2, score.

    A line covers its shadow on another one, lengthened by slack at both ends, if all ends of the one lie within threshold of the
    other's line. Whether better lines cover a line depends on what was kept of them, so an image's lines are taken in turn.
    """
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("image", "line"))

    def places(ends: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Where the feet of ends (... x 2 x 2) fall on lines (... x 2 x 2): 0 at the start, 1 at the end."""
        way = on[..., 1, :] - on[..., 0, :]
        return ((ends - on[..., :1, :]) * way[..., None, :]).sum(axis=-1) / np.maximum((way * way).sum(axis=-1), 1e-12)[..., None]

    def apart(ends: np.ndarray, on: np.ndarray) -> np.ndarray:
        feet = on[..., :1, :] + places(ends, on)[..., None] * (on[..., 1:, :] - on[..., :1, :])
        return np.linalg.norm(feet - ends, axis=-1).max(axis=-1)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["score", "line"], ascending=[False, True])
        kept, out = np.zeros((0, 2, 2)), []
        for row, own in zip(ordered.itertuples(index=False), ordered[["x1", "y1", "x2", "y2"]].to_numpy(float).reshape(-1, 2, 2), strict=True):
            same = kept[np.minimum(apart(kept, own), apart(np.broadcast_to(own, kept.shape), kept)) <= threshold] if len(kept) else kept
            start, end = uncovered(np.sort(places(same, own), axis=1) + np.array([-slack, slack]))
            if start < end:
                rest = own[0] + np.array([[start], [end]]) * (own[1] - own[0])
                kept = np.concatenate([kept, rest[None]])
                out.append((row.image, row.line, *rest.ravel().tolist(), row.score))
        return pd.DataFrame(out, columns=["image", "line", "x1", "y1", "x2", "y2", "score"])

    picked = df.select("image", "line", "x1", "y1", "x2", "y2", F.col("score").cast("double").alias("score"))
    return picked.groupBy("image").applyInPandas(run, f"{kind}, x1 double, y1 double, x2 double, y2 double, score double")
