"""Operators on detections: rows keyed by (video_id, frame), with x1, y1, x2, y2, conf, cls, det."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def box(prefix: str = "") -> g.Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def valid_detections(df: DataFrame) -> DataFrame:
    """df, failing on a confidence outside [0, 1] or a negative size."""
    good = F.col("conf").between(0, 1) & (F.col("x2") >= F.col("x1")) & (F.col("y2") >= F.col("y1"))
    return df.withColumn("conf", F.when(good, F.col("conf")).otherwise(F.raise_error(F.lit("detection out of range")).cast("double")))


def filter_top(df: DataFrame, keys: list[str], cls: Column | None = None, min_conf: float = 0.0, top: int | None = None) -> DataFrame:
    """Rows of one class with enough confidence, and of those the top most confident of each frame (rank counts from 1)."""
    kept = df.where((F.lit(True) if cls is None else cls) & (F.col("conf") >= min_conf))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("conf"), "det")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def nms(df: DataFrame, keys: list[str], threshold: float = 0.7) -> DataFrame:
    """Greedy suppression in order of confidence: a box stays if it meets no box that stayed with IoU of threshold or more.

    A frame's boxes are folded as one array; a frame holds what a detector returns for one image.
    """
    fields = ("x1", "y1", "x2", "y2", "conf", "det")
    one = F.struct((-F.col("conf")).alias("order"), F.col("det").alias("tie"), *(F.col(c) for c in fields))
    ordered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"))
    as_box = lambda s: (s["x1"], s["y1"], s["x2"], s["y2"])
    kept = F.aggregate(
        "all", F.slice("all", 1, 0),
        lambda keep, b: F.when(F.exists(keep, lambda k: g.iou(as_box(k), as_box(b)) >= threshold), keep).otherwise(F.concat(keep, F.array(b))),
    )
    return ordered.select(*keys, F.explode(kept).alias("b")).select(*keys, *(F.col(f"b.{c}").alias(c) for c in fields))


def iou_pairs(df: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """Pairs of one frame's boxes (det_a < det_b) whose IoU is above least."""
    a = df.select(*keys, *(F.col(c).alias(f"a_{c}") for c in ("det", "x1", "y1", "x2", "y2")))
    b = df.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ("det", "x1", "y1", "x2", "y2")))
    pairs = a.join(b, keys).where(F.col("a_det") < F.col("b_det")).withColumn("iou", g.iou(box("a_"), box("b_")))
    return pairs.where(F.col("iou") > least).select(*keys, F.col("a_det").alias("det_a"), F.col("b_det").alias("det_b"), "iou")


def without_near_duplicates(df: DataFrame, keys: list[str], overlap: float, near: float) -> DataFrame:
    """Rows with no box of smaller det in their frame that overlaps so much or has its centre so near."""
    other = df.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("det", "x1", "y1", "x2", "y2")))
    close = (g.iou(box(), box("o_")) >= overlap) | (g.distance(g.exact_center(box()), g.exact_center(box("o_"))) <= near)
    same = [df[k] == other[k] for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return df.join(other, cond & (F.col("o_det") < F.col("det")) & close, "left_anti")


def best_of_half(df: DataFrame, keys: list[str], v: Column, score: Column, length: float = g.COURT_LENGTH) -> DataFrame:
    """The best-scored row on each side of the net in every frame."""
    half = F.when(v <= length / 2, "top").otherwise("bottom")
    ranked = df.withColumns({"half": half, "score": score})
    w = Window.partitionBy(*keys, "half").orderBy(F.desc("score"), "det")
    return ranked.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def track_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """place: position of each track in its frame, active ones first, then faster ones."""
    w = Window.partitionBy(*keys).orderBy(F.desc("is_active"), F.desc("speed"), "det")
    return df.withColumn("place", F.row_number().over(w))


def frame_facts(tracks: DataFrame) -> DataFrame:
    """One row for each frame: position and speed of the ball and of the two players, from rows with label."""
    pick = lambda label, c: F.min_by(F.when(F.col("label") == label, F.col(c)), F.when(F.col("label") == label, F.col("det")))
    names = {"ball": "ball", "p1": "player1", "p2": "player2"}
    return tracks.groupBy("video_id", "frame").agg(*(pick(label, c).alias(f"{n}_{c}") for n, label in names.items() for c in ("x", "y", "kmh")))


def as_lists(df: DataFrame) -> DataFrame:
    """values: centre, size, confidence and class number of each detection as one array; n: detections of its frame."""
    values = F.array(*(c.cast("double") for c in (*g.to_xywh(box()), F.col("conf"), F.col("cls"))))
    return df.withColumns({"values": values, "n": F.count("*").over(Window.partitionBy("frame"))})


def bucketed(df: DataFrame, name: Column, buckets: dict[str, str]) -> DataFrame:
    """bucket by the class name in any case; rows of other classes go."""
    chosen = F.coalesce(*(F.when(F.lower(name) == k, v) for k, v in buckets.items()))
    return df.withColumn("bucket", chosen).where(F.col("bucket").isNotNull())


def top_rows(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """The n rows of the largest value; NaN counts as less than any number, and null as less than that."""
    return df.orderBy(F.when(F.isnan(value), float("-inf")).otherwise(F.col(value)).desc_nulls_last(), F.isnan(value), tie).limit(n)


def largest(df: DataFrame, keys: list[str], size: Column, columns: list[str], tie: str) -> DataFrame:
    """The row of the largest size in each group (of equals the smallest tie)."""
    best = F.max_by(F.struct(tie, *columns), F.struct(size.alias("size"), (-F.col(tie)).alias("tie")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def with_labels(tracks: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """tracks with the label that labels has for them, or null."""
    return tracks.join(labels.select(*keys, "label"), keys, "left")


def nearest_before(points: DataFrame, keys: list[str], dt: float, radius: float, most: float) -> DataFrame:
    """speed of each point (x, y, det) from the nearest point of the frame before: null if that is beyond radius and faster than most."""
    last = points.select(*keys, (F.col("frame") + 1).alias("frame"), F.col("x").alias("px"), F.col("y").alias("py"))
    pairs = points.join(last, [*keys, "frame"]).withColumn("d", g.distance((F.col("x"), F.col("y")), (F.col("px"), F.col("py"))))
    near = pairs.groupBy(*keys, "frame", "det").agg(F.min("d").alias("d"))
    speed = F.when((F.col("d") <= radius) | (F.col("d") / dt <= most), F.col("d") / dt)
    return points.join(near, [*keys, "frame", "det"], "left").withColumn("speed", speed)


def candidate_pairs(tracks: DataFrame, detections: DataFrame, keys: list[str], dt: float, radius: float, most: float, least_cos: float) -> DataFrame:
    """Tracks (a, x, y, vx, vy) and detections (b, bx, by) of one frame within radius and speed most, and not against the track's way."""
    pairs = tracks.join(detections, keys)
    dx, dy = F.col("bx") - F.col("x"), F.col("by") - F.col("y")
    far, pace = F.hypot(dx, dy), F.hypot("vx", "vy")
    along = (dx * F.col("vx") + dy * F.col("vy")) / (far * pace)
    aligned = F.when((far > 1e-9) & (pace > 1e-9), along >= least_cos).otherwise(True)
    return pairs.withColumn("cost", far).where((far <= radius) & (far / dt <= most) & aligned)


def court_gates(points: DataFrame, polygon: list[g.Point], h: list, slow_outside: float, slow_inside: float) -> DataFrame:
    """inside, projectable, inside_count of the frame, and whether a point is kept: not slow outside the court, and, where several are inside, not still inside."""
    p = (F.col("x"), F.col("y"))
    marked = points.withColumns({"inside": g.in_polygon(p, polygon), "projectable": g.project(p, h)[0].isNotNull()})
    counted = marked.withColumn("inside_count", F.count_if("inside").over(Window.partitionBy("frame")))
    still = F.when(F.col("inside"), (F.col("inside_count") > 1) & (F.col("speed") < slow_inside)).otherwise(F.col("speed") < slow_outside)
    return counted.withColumn("kept", F.col("projectable") & ~still)


RECORD = "struct<bbox:array<double>,conf:double,class:int>"


def parsed(records: DataFrame, size: tuple[float, float], layout: str = "xyxy", normalized: bool = False, only_class: int | None = None) -> DataFrame:
    """records with x1, y1, x2, y2, conf, cls instead of record and values: a detector's rows made boxes in pixels inside the image.

    record: JSON text with bbox, conf (1 if missing) and class; values: an array of four numbers, conf and, perhaps, class. Either may be
    null, record goes first. layout is xyxy or xywh (centre and size); normalized numbers are shares of the image's size. Boxes of other
    classes than only_class, boxes without four numbers, and those without area inside the image are dropped.
    """
    if layout not in ("xyxy", "xywh"):
        raise ValueError(f"unknown layout {layout}")
    width, height = size
    named = F.from_json("record", RECORD)
    at = lambda i: F.get(F.coalesce(named["bbox"], F.col("values")), F.lit(i)) * (size[i % 2] if normalized else 1.0)
    a, b, c, d = map(at, range(4))
    raw = (a, b, c, d) if layout == "xyxy" else (a - c / 2, b - d / 2, a + c / 2, b + d / 2)
    x1, y1, x2, y2 = (F.least(F.greatest(v, F.lit(0.0)), F.lit(side - 1.0)) for v, side in zip(raw, (width, height, width, height), strict=True))
    is_named = named["bbox"].isNotNull()
    conf = F.when(is_named, F.coalesce(named["conf"], F.lit(1.0))).otherwise(F.get("values", F.lit(4)))
    cls = F.when(is_named, named["class"]).otherwise(F.get("values", F.lit(5)).cast("int"))
    # A null in any of the four makes least and greatest skip it, so it is asked for.
    whole = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    rows = records.select("*", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), conf.alias("conf"), cls.alias("cls"), whole.alias("__whole"))
    kept = rows.where(F.col("__whole") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    if only_class is not None:
        kept = kept.where(F.col("cls") == only_class)
    return kept.drop("__whole", "record", "values")
