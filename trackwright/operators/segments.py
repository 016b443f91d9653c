"""Runs, intervals and rally sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .folds import gap_sections, kept_chain
from .series import KEY, ORDER, chunk_of, last_known, lerp_gaps, part_window, running_sum, with_windows


def runs(df: DataFrame, flag: Column, name: str = "run") -> DataFrame:
    """df with flag as column value and name: a number that grows by one wherever value changes."""
    marked = df.withColumn("value", flag)
    turned = F.coalesce(F.lag("value").over(part_window()) != F.col("value"), F.lit(False))
    return running_sum(with_windows(marked, 1, 0, __turn=turned.cast("long")), F.col("__turn"), name).drop("__turn")


def run_lengths(df: DataFrame, flag: Column) -> DataFrame:
    """video_id, run, value, first, last, n: one row for each run of equal values."""
    return runs(df, flag).groupBy(KEY, "run", "value").agg(F.min(ORDER).alias("first"), F.max(ORDER).alias("last"), F.count("*").alias("n"))


def suppress_short(df: DataFrame, flag: Column, seconds: float, step: float) -> DataFrame:
    """video_id, frame, value: runs of true of less than seconds // step rows become false."""
    least = int(seconds // step)
    marked = runs(df, flag)
    short = marked.groupBy(KEY, "run", "value").agg(F.count("*").alias("n")).where(F.col("value") & (F.col("n") < least)).select(KEY, "run", F.lit(True).alias("short"))
    return marked.join(short, [KEY, "run"], "left").select(KEY, ORDER, (F.col("value") & F.col("short").isNull()).alias("value"))


def false_runs(df: DataFrame, flag: Column, seconds: float, step: float) -> DataFrame:
    """video_id, start, end (both inclusive) of runs of false of seconds // step rows or more."""
    return run_lengths(df, flag).where(~F.col("value") & (F.col("n") >= int(seconds // step))).select(KEY, F.col("first").alias("start"), F.col("last").alias("end"))


def active_intervals(dead: DataFrame, videos: DataFrame, step: float, fps: float) -> DataFrame:
    """What dead intervals (video_id, start, end in samples) leave of videos (video_id, total_frames), in frames and seconds."""
    scale = step * fps
    ends = dead.select(KEY, (F.col("start") * scale).alias("s"), (F.col("end") * scale).alias("e"))
    tail = videos.select(KEY, F.col("total_frames").cast("double").alias("s"), F.lit(None).cast("double").alias("e"))
    w = Window.partitionBy(KEY).orderBy(F.col("e").isNull(), "s")
    begun = ends.unionByName(tail).withColumn("begin", F.coalesce(F.lag("e").over(w) + 1, F.lit(0.0)))
    stop = F.when(F.col("e").isNull(), F.col("s")).otherwise(F.col("s") - 1)
    return begun.where(F.col("begin") < F.col("s")).select(
        KEY, F.col("begin").alias("start_index"), (F.col("begin") / fps).alias("start_time"), stop.alias("end_index"), (stop / fps).alias("end_time")
    )


def dead_time(frames: DataFrame, valid: Column, videos: DataFrame, step: float, fps: float, true_seconds: float, false_seconds: float) -> DataFrame:
    """Active intervals of sampled rows: short valid runs are dropped, then long invalid runs are dead."""
    kept = suppress_short(frames, valid, true_seconds, step)
    return active_intervals(false_runs(kept, F.col("value"), false_seconds, step), videos, step, fps)


@dataclass(frozen=True)
class Rally:
    fps: float = 30
    min_seconds: float = 1.5
    null_ratio: float = 0.75
    min_between: float = 1
    before: float = 2
    after: float = 1
    max_gap: float = 1
    min_kmh: float = 10


def rally_sections(frames: DataFrame, present: Column, speed: Column, p: Rally = Rally()) -> DataFrame:
    """video_id, section_idx, start_index, start_time, end_index, end_time.

    A section begins at a frame with a ball and ends at the empty frame that takes its count of empty frames over max_gap
    seconds. The count starts anew with each section only. A slow ball counts as empty, save in a video's first frame.
    Sections that are too short or too empty are dropped; the rest are widened, and joined if they come close.

    Frames are first summed up into runs, and the runs are folded by blocks, so no task sees a whole video.
    """
    slow = (F.col(ORDER) > 0) & F.coalesce(speed < p.min_kmh, F.lit(False))
    lengths = materialise(run_lengths(frames, ~present | slow), "runs")
    allowed, least, int_fps = int(p.max_gap * p.fps // 1), p.min_seconds * p.fps, int(p.fps)
    totals = lengths.groupBy(KEY).agg((F.max("last") + 1).alias("total"))
    length = F.col("end") - F.col("start")
    found = gap_sections(lengths, allowed).join(totals, KEY)
    closed = F.col("end").isNotNull() & (length > least) & ((allowed + 1) / length < p.null_ratio)
    raw = found.where(closed | (F.col("end").isNull() & (F.col("total") - F.col("start") > least))).withColumn("end", F.coalesce("end", "total"))
    end = F.least(F.col("end") + p.after * p.fps, F.col("total")).cast("long")
    # Sections in order are numbered; one that begins soon after the one before it ended continues that one.
    wide = raw.select(KEY, F.col("start").alias(ORDER), F.greatest(F.col("start") - p.before * p.fps, F.lit(0)).cast("long").alias("low"), end.alias("high"))
    before = around_others(materialise(wide, "raw-sections"), F.col("high"), "__prior")
    new = F.coalesce(F.col(ORDER) - F.col("__prior.value") >= p.min_between * p.fps, F.lit(True))
    numbered = running_sum(before.withColumn("__new", new), F.col("__new").cast("long"), "section")
    out = numbered.groupBy(KEY, (F.col("section") - 1).alias("section_idx")).agg(F.min("low").alias("start_index"), F.max("high").alias("end_index"))
    return out.select(KEY, "section_idx", "start_index", (F.col("start_index") / int_fps).alias("start_time"), "end_index", (F.col("end_index") / int_fps).alias("end_time"))


def around_others(df: DataFrame, value: Column, name: str) -> DataFrame:
    """name: struct(frame, value) of the row before each row."""
    parts = df.withColumn("__seen", F.struct(F.col(ORDER).alias("frame"), value.alias("value"))).withColumn("part", chunk_of(F.col(ORDER)))
    inside = F.lag("__seen").over(part_window())
    ends = parts.groupBy(KEY, "part").agg(F.max("__seen").alias("__end"))
    carry = ends.select(KEY, "part", F.lag("__end").over(Window.partitionBy(KEY).orderBy("part")).alias("__carry"))
    return parts.join(carry, [KEY, "part"]).withColumn(name, F.coalesce(inside, "__carry")).drop("part", "__seen", "__carry")


def section_frames(sections: DataFrame, frames: DataFrame, size: int = 1000) -> DataFrame:
    """Frames of each section [start_index, end_index): both sides meet by video and block of frames, then by range."""
    blocks = F.sequence(F.floor(F.col("start_index") / size), F.floor((F.col("end_index") - 1) / size))
    left = sections.where("end_index > start_index").withColumn("__block", F.explode(blocks))
    right = frames.withColumn("__block", F.floor(F.col(ORDER) / size))
    joined = left.join(right, [KEY, "__block"]).where((F.col(ORDER) >= F.col("start_index")) & (F.col(ORDER) < F.col("end_index")))
    return joined.drop("__block")


def keypoint_step(start: Column, end: Column, step: float, n: Column) -> Column:
    """Index of the keypoints nearest to a section's middle second; halves go to the even one."""
    return F.least(F.bround(F.floor((start + end) / 2) / step).cast("long"), n - 1)


def pad_gaps(sections: DataFrame, frames: DataFrame, videos: DataFrame, columns: list[str]) -> DataFrame:
    """All frames of videos (video_id, total_frames); columns are null outside the sections."""
    inside = section_frames(sections, frames).select(KEY, ORDER, *columns).dropDuplicates([KEY, ORDER])
    spine = videos.select(KEY, F.explode(F.expr("sequence(0L, total_frames - 1)")).alias(ORDER))
    return spine.join(inside, [KEY, ORDER], "left")


def debounce(events: DataFrame, accepted: Column, gap: int = 60) -> DataFrame:
    """Rows accepted more than gap frames after the last one kept; the first must come after frame gap.

    Only accepted rows reach the fold, which runs by blocks.
    """
    rows = events.where(accepted).select(KEY, ORDER).distinct()
    return kept_chain(rows, ORDER, ORDER, gap)


def relabel_serves(shots: DataFrame, by: list[str], serve: str = "serve", instead: str = "forehand") -> DataFrame:
    """Serves after a section's first shot, of either player, become another stroke."""
    first = shots.groupBy(*by).agg(F.min(ORDER).alias("__first"))
    late = (F.col("shot_type") == serve) & (F.col(ORDER) > F.col("__first"))
    return shots.join(first, by).withColumn("shot_type", F.when(late, instead).otherwise(F.col("shot_type"))).drop("__first")


def split_tracks(df: DataFrame, present: Column, x: Column, y: Column, max_gap: int = 4, max_jump: float = 80.0, min_track: int = 5) -> DataFrame:
    """video_id, track_idx, start, end (exclusive): tracks are cut at long gaps, and at gaps over which the ball moved too fast.

    Frames are summed up into runs, and the gaps that may cut are folded by blocks.
    """
    marked = runs(df.withColumns({"__x": x, "__y": y}), present)
    lengths = marked.groupBy(KEY, "run", "value").agg(
        F.min(ORDER).alias("first"), F.count("*").alias("n"), F.min_by("__x", ORDER).alias("x0"), F.min_by("__y", ORDER).alias("y0"),
        F.max_by("__x", ORDER).alias("x1"), F.max_by("__y", ORDER).alias("y1"),
    )
    lengths = materialise(lengths, "runs")
    # A gap and its neighbours meet by the number of the run.
    side = lambda by, c: lengths.where("value").select(KEY, (F.col("run") + by).alias("run"), F.col(f"x{c}").alias(f"sx{c}"), F.col(f"y{c}").alias(f"sy{c}"))
    gaps = lengths.where(~F.col("value")).select(KEY, "run", "first", "n").join(side(1, 1), [KEY, "run"]).join(side(-1, 0), [KEY, "run"])
    jump = F.hypot(F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0")) / F.col("n")
    cuts = gaps.where((F.col("n") >= max_gap) | (jump > max_jump)).select(KEY, "first", (F.col("first") + F.col("n") - 1).alias("until"))
    kept = kept_chain(materialise(cuts, "cuts"), "first", "until", min_track)
    totals = lengths.groupBy(KEY).agg((F.max(F.col("first") + F.col("n"))).alias("total"))
    # A track runs from the cut before it to its own; the last one to the video's end.
    ends = kept.select(KEY, F.col("first").alias(ORDER), "until").unionByName(totals.select(KEY, F.col("total").alias(ORDER), F.col("total").alias("until")))
    begun = around_others(materialise(ends, "cuts-kept"), F.col("until"), "__prior").withColumn("start", F.coalesce("__prior.value", F.lit(0)))
    tracks = begun.where(F.col(ORDER) - F.col("start") > min_track)
    numbered = running_sum(tracks, F.lit(1).cast("long"), "number")
    return numbered.select(KEY, (F.col("number") - 1).alias("track_idx"), "start", F.col(ORDER).alias("end"))


def streaks(df: DataFrame, flag: Column) -> DataFrame:
    """streak: frames in a row, up to each, in which flag is true; 0 where it is not."""
    marked = runs(df, F.coalesce(flag, F.lit(False)))
    begins = marked.groupBy(KEY, "run").agg(F.min(ORDER).alias("__begin"))
    joined = marked.join(begins, [KEY, "run"])
    return joined.withColumn("streak", F.when(F.col("value"), F.col(ORDER) - F.col("__begin") + 1).otherwise(0)).drop("run", "value", "__begin")


def interpolate_tracks(df: DataFrame, x: str, y: str, **settings: float) -> DataFrame:
    """x and y with gaps filled inside each track of split_tracks: linear between points, level at a track's ends."""
    tracks = materialise(split_tracks(df, F.col(x).isNotNull(), F.col(x), F.col(y), **settings), "tracks")
    numbers = tracks.select(KEY, "track_idx", F.col("start").alias("start_index"), F.col("end").alias("end_index"))
    # A frame in which one track ends and the next begins belongs to one of them only, as the ends are exclusive.
    inside = section_frames(numbers, df.select(KEY, ORDER, x, y))
    each = inside.select(F.struct(KEY, "track_idx").alias(KEY), ORDER, x, y)
    filled_in = lerp_gaps(materialise(each, "tracks-frames"), x, y)
    found = filled_in.select(F.col(f"{KEY}.{KEY}").alias(KEY), ORDER, F.col(x).alias("__x"), F.col(y).alias("__y"), F.lit(True).alias("__in"))
    joined = df.join(found, [KEY, ORDER], "left")
    return joined.withColumns({x: F.when(F.col("__in"), F.col("__x")).otherwise(F.col(x)), y: F.when(F.col("__in"), F.col("__y")).otherwise(F.col(y))}).drop("__x", "__y", "__in")


def overlay(frames: DataFrame, shots: DataFrame, by: list[str]) -> DataFrame:
    """frames with the shot made in the frame (the first of several) and the last one made so far, for each of by."""
    first = shots.groupBy(*by, ORDER).agg(F.min_by("shot_type", "shot").alias("shot_type"))
    return last_known(frames.join(first, [*by, ORDER], "left"), "shot_type", "current")


def with_latest_homography(frames: DataFrame, steps: DataFrame, size: int) -> DataFrame:
    """frames with h, the homography of the last step (of size frames) up to theirs that has one; steps: video_id, step_idx (dense from 0), h."""
    known = last_known(steps.withColumnRenamed("step_idx", ORDER), "h", "known").select(KEY, F.col(ORDER).alias("__step"), F.col("known").alias("h"))
    return frames.withColumn("__step", F.floor(F.col(ORDER) / size)).join(known, [KEY, "__step"], "left").drop("__step")
