"""Operators on per-frame series: rows keyed by (video_id, frame), frames dense from 0.

A video may hold any share of all rows, so no window here spans a whole video. Windows of bounded reach run over chunks of
frames that carry a copy of their neighbours' edge rows (halo). Fills and running sums take two steps: inside the chunk, and a
carry over one summary row for each chunk.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, ORDER, CHUNK = "video_id", "frame", 4096


def chunk_of(frame: Column, chunk: int = CHUNK) -> Column:
    return F.floor(frame / chunk)


def in_chunks(df: DataFrame, before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """df with part, each row also in the neighbouring parts whose rows reach it; core marks the row's own part."""
    first, last = chunk_of(F.col(ORDER) - after, chunk), chunk_of(F.col(ORDER) + before, chunk)
    parts = df.withColumn("part", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return parts.withColumn("core", F.col("part") == chunk_of(F.col(ORDER), chunk))


def part_window() -> Window:
    return Window.partitionBy(KEY, "part").orderBy(ORDER)


def with_windows(df: DataFrame, before: int, after: int, chunk: int = CHUNK, **columns: Column) -> DataFrame:
    """Add columns that are window expressions over part_window() and reach no further than before and after rows."""
    return in_chunks(df, before, after, chunk).withColumns(columns).where("core").drop("part", "core")


def running_sum(df: DataFrame, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """name: the sum of value over this and all earlier frames of the video."""
    parts = df.withColumn("__v", value).withColumn("part", chunk_of(F.col(ORDER), chunk))
    before = Window.partitionBy(KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(KEY, "part").agg(F.sum("__v").alias("sum"))
    carry = sums.select(KEY, "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("carry"))
    local = F.sum("__v").over(part_window().rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(carry, [KEY, "part"]).withColumn(name, F.col("carry") + F.coalesce(local, F.lit(0))).drop("part", "carry", "__v")


def around(df: DataFrame, value: Column, last: str, following: str, chunk: int = CHUNK) -> DataFrame:
    """last and following: struct(frame, value) of the nearest row with a value at or before each row, and at or after it."""
    return around_each(df, [(value, last, following)], chunk)


def around_each(df: DataFrame, values: list[tuple[Column, str, str]], chunk: int = CHUNK) -> DataFrame:
    """around for several values (value, last, following) in one pass."""
    at = {f"__at{i}": F.when(v.isNotNull(), F.struct(F.col(ORDER).alias("frame"), v.alias("value"))) for i, (v, _, _) in enumerate(values)}
    parts = df.withColumns(at).withColumn("part", chunk_of(F.col(ORDER), chunk))
    ends = parts.groupBy(KEY, "part").agg(*(f(c).alias(f"{n}{c}") for c in at for n, f in (("hi", F.max), ("lo", F.min))))
    by_part = Window.partitionBy(KEY).orderBy("part")
    before, after = by_part.rowsBetween(Window.unboundedPreceding, -1), by_part.rowsBetween(1, Window.unboundedFollowing)
    carry = ends.select(
        KEY, "part", *(F.last(f"hi{c}", ignorenulls=True).over(before).alias(f"__before{c}") for c in at), *(F.first(f"lo{c}", ignorenulls=True).over(after).alias(f"__after{c}") for c in at)
    )
    up, down = part_window().rowsBetween(Window.unboundedPreceding, 0), part_window().rowsBetween(0, Window.unboundedFollowing)
    found = {}
    for c, (_, last, following) in zip(at, values, strict=True):
        found[last] = F.coalesce(F.last(c, ignorenulls=True).over(up), F.col(f"__before{c}"))
        found[following] = F.coalesce(F.first(c, ignorenulls=True).over(down), F.col(f"__after{c}"))
    return parts.join(carry, [KEY, "part"]).withColumns(found).drop("part", *at, *(f"__before{c}" for c in at), *(f"__after{c}" for c in at))


def filled(df: DataFrame, value: Column, name: str, forward: bool, chunk: int = CHUNK) -> DataFrame:
    """name: only one of the two that around gives."""
    return around(df, value, *((name, "__other") if forward else ("__other", name)), chunk).drop("__other")


def centred(width: int) -> tuple[int, int]:
    """Rows before and after in a centred window, the extra row of an even width before."""
    return width - 1 - (width - 1) // 2, (width - 1) // 2


def rolling_mean(df: DataFrame, value: str, name: str, width: int) -> DataFrame:
    """Mean of the non-null values in a centred window; null if there is none."""
    before, after = centred(width)
    return with_windows(df, before, after, **{name: F.avg(value).over(part_window().rowsBetween(-before, after))})


def back_then_forward(df: DataFrame, value: str) -> DataFrame:
    """Nulls of value take the next value, or without one the last."""
    both = around(df, F.col(value), "__last", "__next")
    return both.withColumn(value, F.coalesce(F.col("__next.value"), F.col("__last.value"))).drop("__next", "__last")


def is_sampled(frame: Column, fps: float, step: float) -> Column:
    """Frames int(i * step * fps) for i = 0, 1, 2, ..."""
    size = step * fps
    return F.floor(F.ceil(frame / F.lit(size)) * size) == frame


def smooth_speed(df: DataFrame, speed: str = "speed", fps: float = 30, step: float = 0.5, low: float = 0, high: float = 200) -> DataFrame:
    """video_id, frame, smooth: rolling mean, filled, clipped and sampled. Videos without any speed give no rows."""
    means = back_then_forward(rolling_mean(df, speed, "smooth", int(fps * step * 0.5)), "smooth")
    clipped = F.least(F.greatest("smooth", F.lit(float(low))), F.lit(float(high)))
    return means.where(is_sampled(F.col(ORDER), fps, step) & F.col("smooth").isNotNull()).select(KEY, ORDER, clipped.alias("smooth"))


def ema(df: DataFrame, value: str, name: str, alpha: float, dense: bool = False) -> DataFrame:
    """Exponential moving average of non-null values: y = alpha * x + (1 - alpha) * previous y, beginning with the first x.

    A null leaves the average as it is; before the first value it is null. dense says that value is null in all frames of a
    video or in none, which saves counting the values.

    With alpha 1 the average is the last value itself.

    The n-th value of a video has place n. A chunk of places is so long that what comes from before the previous chunk is below
    double precision. Inside a chunk, y[k] = q**k * sum(c[j] * q**-j) with q = 1 - alpha.
    """
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must be above 0 and at most 1, not {alpha}")
    if alpha == 1:
        return last_known(df, value, name)
    q = 1 - alpha
    length = max(16, math.ceil(45 / -math.log(q)))
    placed = df.withColumn("__n", F.col(ORDER) + 1) if dense else running_sum(df, F.col(value).isNotNull().cast("long"), "__n")
    place = F.col("__n") - 1
    k = F.pmod(place, F.lit(length))
    share = F.when(place == 0, F.col(value)).otherwise(alpha * F.col(value))
    parts = placed.withColumn("part", chunk_of(place, length))
    inside = part_window().rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("__y", F.pow(F.lit(q), k) * F.sum(share * F.pow(F.lit(q), -k)).over(inside))
    ends = parts.groupBy(KEY, (F.col("part") + 1).alias("part")).agg(F.max_by("__y", ORDER).alias("__before"))
    joined = parts.join(ends, [KEY, "part"], "left")
    return joined.withColumn(name, F.col("__y") + F.coalesce(F.pow(F.lit(q), k + 1) * F.col("__before"), F.lit(0.0))).drop("part", "__n", "__y", "__before")


def distance_speed(df: DataFrame, distance: Column, fps: float, step: float, max_kmh: float, alpha: float = 0.3) -> DataFrame:
    """video_id, frame, kmh from the distance to the previous frame's point (null where a side is missing).

    distance is a window expression over part_window() that reaches one row back. Capped, rolled over three frames, filled,
    averaged exponentially, clipped, sampled.
    """
    most = max_kmh / (fps * 3.6)
    steps = with_windows(df, 1, 0, dist=F.when(F.col(ORDER) == 0, 0.0).otherwise(F.when(distance.isNotNull(), F.least(distance, F.lit(most)))))
    smooth = ema(back_then_forward(rolling_mean(steps, "dist", "mean", 3), "mean"), "mean", "smooth", alpha, dense=True)
    kmh = F.least(F.greatest("smooth", F.lit(0.0)), F.lit(most)) * fps * 3.6
    return smooth.where(is_sampled(F.col(ORDER), fps, step)).select(KEY, ORDER, kmh.alias("kmh"))


def nearest_fill(df: DataFrame, value: str) -> DataFrame:
    """value of the nearest frame that has one; of two equally near the earlier. Null in videos without any."""
    both = around(df, F.col(value), "__last", "__next")
    back, ahead = F.col(ORDER) - F.col("__last.frame"), F.col("__next.frame") - F.col(ORDER)
    use_last = F.col("__next").isNull() | (back <= ahead)
    return both.withColumn(value, F.when(use_last, F.col("__last.value")).otherwise(F.col("__next.value"))).drop("__next", "__last")


def lerp_gaps(df: DataFrame, *values: str) -> DataFrame:
    """Nulls of each of values between two of its values are interpolated; before the first and after the last the nearest value holds."""
    both = around_each(df, [(F.col(v), f"__last_{v}", f"__next_{v}") for v in values])
    whole = {}
    for v in values:
        last, following = F.col(f"__last_{v}"), F.col(f"__next_{v}")
        span = following["frame"] - last["frame"]
        between = last["value"] + (following["value"] - last["value"]) * (F.col(ORDER) - last["frame"]) / span
        whole[v] = F.coalesce(F.when(span > 0, between), last["value"], following["value"])
    return both.withColumns(whole).drop(*(f"__{side}_{v}" for v in values for side in ("next", "last")))


def weighted_slope(df: DataFrame, t: str, x: str, samples: int = 7, gamma: float = 0.7, least: int = 2) -> DataFrame:
    """slope of x over t in the last samples rows by least squares with weights gamma ** (2 * age)."""
    w = part_window().rowsBetween(-(samples - 1), 0)
    rows = in_chunks(df, samples - 1, 0).withColumn("__r", F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).alias("x"))).over(w)).where("core").drop("part", "core")
    weight = lambda i: F.pow(F.lit(gamma), 2.0 * (F.size("__r") - 1 - i))
    total = lambda f: F.aggregate(F.transform("__r", lambda s, i: weight(i) * f(s["t"] - F.col(t), s["x"])), F.lit(0.0), lambda a, v: a + v)
    sums = rows.withColumns({
        "__w": total(lambda a, b: F.lit(1.0)), "__t": total(lambda a, b: a), "__x": total(lambda a, b: b), "__tt": total(lambda a, b: a * a), "__tx": total(lambda a, b: a * b)
    })
    below = F.col("__w") * F.col("__tt") - F.col("__t") * F.col("__t")
    slope = F.when((F.size("__r") >= least) & (below > 0), (F.col("__w") * F.col("__tx") - F.col("__t") * F.col("__x")) / below)
    return sums.withColumn("slope", slope).drop("__r", "__w", "__t", "__x", "__tt", "__tx")


def curvature(df: DataFrame, value: str, unit: float = 1.0) -> DataFrame:
    """Second derivative of the quadratic through the last 7 values (fixed least-squares weights); null before the 7th. unit is what
    of value makes one; it divides the sum, so values that are exact in their own unit are rounded once."""
    weights = [5, 0, -3, -4, -3, 0, 5]
    w = part_window()
    terms = [c * F.lag(value, 6 - i).over(w) for i, c in enumerate(weights) if c]
    return with_windows(df, 6, 0, curvature=sum(terms[1:], terms[0]) / F.lit(float(unit)) / 42.0)


def hampel(df: DataFrame, value: str, window: int = 24, least: int = 7, k: float = 3.0) -> DataFrame:
    """outlier: value is further than k scaled median deviations from the median of the last window values, itself included."""
    w = part_window().rowsBetween(-(window - 1), 0)
    rows = with_windows(df, window - 1, 0, __r=F.collect_list(value).over(w), __m=F.percentile(value, 0.5).over(w))
    ordered = F.array_sort(F.transform("__r", lambda v: F.abs(v - F.col("__m"))))
    middle = (F.get(ordered, F.floor((F.size("__r") - 1) / 2).cast("int")) + F.get(ordered, F.floor(F.size("__r") / 2).cast("int"))) / 2
    far = F.abs(F.col(value) - F.col("__m")) > k * (1.4826 * middle + 1e-9)
    return rows.withColumn("outlier", F.coalesce((F.size("__r") >= least) & far, F.lit(False))).drop("__r", "__m")


def drop_jumps(df: DataFrame, value: str, distance: str, most: float = 100.0) -> DataFrame:
    """Null values that a jump leads to and another jump (or distance -1, a missing point) leads away from; or, if the jump comes
    right after distance -1, the value before it."""
    w = part_window()
    d, after, before = F.col(distance), F.lead(distance).over(w), F.lag(distance).over(w)
    away = (d > most) & ((after > most) | (after == -1))
    prior = (d > most) & ~F.coalesce(away, F.lit(False)) & (before == -1)
    flags = with_windows(df, 2, 2, __away=F.coalesce(away, F.lit(False)), __prior=F.coalesce(prior, F.lit(False)))
    both = with_windows(flags, 0, 1, __gone=F.col("__away") | F.coalesce(F.lead("__prior").over(w), F.lit(False)))
    return both.withColumn(value, F.when(~F.col("__gone"), F.col(value))).drop("__away", "__prior", "__gone")


def rolling_pool(df: DataFrame, value: str, size: int = 30) -> DataFrame:
    """pool: the last size non-null values in order, for rows that complete one. Missing frames are skipped."""
    dense = running_sum(df.where(F.col(value).isNotNull()), F.lit(1), "__n").withColumnRenamed(ORDER, "__frame").withColumn(ORDER, F.col("__n") - 1)
    w = part_window().rowsBetween(-(size - 1), 0)
    rows = with_windows(dense, size - 1, 0, pool=F.collect_list(value).over(w))
    return rows.where(F.size("pool") == size).drop(ORDER, "__n").withColumnRenamed("__frame", ORDER)


def bounce_flags(df: DataFrame, velocity: str, acceleration: str, fast: float = 200.0, hard: float = 0.45) -> DataFrame:
    """bounce: vertical velocity turns with both sides fast, or acceleration is hard."""
    last = F.lag(velocity).over(part_window())
    turned = (last * F.col(velocity) < 0) & (F.abs(last) >= fast) & (F.abs(F.col(velocity)) >= fast)
    return with_windows(df, 1, 0, bounce=F.coalesce(turned, F.lit(False)) | F.coalesce(F.abs(F.col(acceleration)) >= hard, F.lit(False)))


def idle_and_recency(df: DataFrame, value: str, least: float, horizon: float = 30.0) -> DataFrame:
    """idle: frames since value last moved by least or more; recency: exp(-gap / horizon) to the previous non-null frame."""
    moved = F.abs(F.col(value) - F.lag(value).over(part_window())) >= least
    rows = with_windows(df, 1, 0, __moved=F.when(F.coalesce(moved, F.lit(False)) | (F.col(ORDER) == 0), True))
    rows = filled(rows, F.col("__moved"), "__turned", forward=True)
    rows = filled(rows, F.col(value), "__seen", forward=True)
    rows = with_windows(rows, 1, 0, __before=F.lag("__seen").over(part_window()))
    gap = F.col(ORDER) - F.col("__before.frame")
    return rows.withColumn("idle", F.col(ORDER) - F.col("__turned.frame")).withColumn("recency", F.exp(-gap / horizon)).drop("__moved", "__turned", "__seen", "__before")


def scaled_by_max(df: DataFrame, value: str) -> DataFrame:
    """value divided by the video's largest."""
    most = df.groupBy(KEY).agg(F.max(value).alias("__max"))
    return df.join(most, KEY).withColumn(value, F.col(value) / F.col("__max")).drop("__max")


def trails(df: DataFrame, value: str, size: int = 40) -> DataFrame:
    """trail: the last size values up to each frame."""
    return with_windows(df, size - 1, 0, trail=F.collect_list(value).over(part_window().rowsBetween(-(size - 1), 0)))


def strided(df: DataFrame, start: int, end: int, n: int) -> DataFrame:
    """Every n-th frame of [start, end)."""
    return df.where((F.col(ORDER) >= start) & (F.col(ORDER) < end) & ((F.col(ORDER) - start) % n == 0))


def frame_chunk(df: DataFrame, k: int, size: int = 1000) -> DataFrame:
    return df.where((F.col(ORDER) >= k * size) & (F.col(ORDER) < (k + 1) * size))


def lower_rate(df: DataFrame, fps: float, target: float, offset: int = 0) -> DataFrame:
    """Every int(fps / target)-th frame from offset on."""
    return df.where((F.col(ORDER) >= offset) & ((F.col(ORDER) - offset) % int(fps / target) == 0))


def expanding(df: DataFrame, value: str) -> DataFrame:
    """last and mean of the non-null values up to each frame."""
    rows = running_sum(running_sum(df, F.coalesce(value, F.lit(0.0)), "__sum"), F.col(value).isNotNull().cast("long"), "__n")
    rows = filled(rows, F.col(value), "__seen", forward=True)
    mean = F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n"))
    return rows.withColumns({"last": F.col("__seen.value"), "mean": mean}).drop("__sum", "__n", "__seen")


def last_known(df: DataFrame, value: str, name: str) -> DataFrame:
    """name: the value of the last frame, up to this one, that has one."""
    return filled(df, F.col(value), "__seen", forward=True).withColumn(name, F.col("__seen.value")).drop("__seen")


def require_any(df: DataFrame, value: str) -> DataFrame:
    """df, failing in a video that has no value at all."""
    have = df.groupBy(KEY).agg(F.count(value).alias("__n"))
    good = F.when(F.col("__n") > 0, F.col(KEY)).otherwise(F.raise_error(F.concat(F.lit("no value in video "), F.col(KEY).cast("string"))).cast(df.schema[KEY].dataType))
    return df.join(have.select(good.alias(KEY)), KEY)


def airborne_flags(df: DataFrame, x: str, y: str, fps: float, least_bend: float = 0.45, rolling: float = 120.0, units: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """airborne: the height bends; floor_like: slow, and known not to bend. Speeds are pixels a second from the frame before.

    units: what of x and of y makes a pixel. Differences are taken before they are scaled, so a bend of just least_bend is seen as one."""
    step = lambda c, unit: (F.col(c) - F.lag(c).over(part_window())) / F.lit(float(unit))
    moving = with_windows(df, 1, 0, speed=F.hypot(step(x, units[0]), step(y, units[1])) * fps)
    bent = curvature(moving, y, units[1])
    bends = F.abs(F.col("curvature")) >= least_bend
    return bent.withColumns({"airborne": F.coalesce(bends, F.lit(False)), "floor_like": F.coalesce((F.col("speed") < rolling) & ~bends, F.lit(False))})


def shot_rows(df: DataFrame, fps: float) -> DataFrame:
    """Frames with a shot_type as index, time and shot_type."""
    return df.where(F.col("shot_type").isNotNull()).select(KEY, F.col(ORDER).alias("index"), (F.col(ORDER) / fps).alias("time"), "shot_type")
