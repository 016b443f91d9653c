"""Structured Streaming forms of the trackers and of windowed speeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tracking.runner import Tracker, late_rows, track_in_order, track_stream
from ..sources.detections import send_all


def stream_tracks(detections: DataFrame, make: Callable[[], Tracker], schema: str, idle: str | None = None) -> DataFrame:
    """Tracks of a stream of detections; each video's tracker is kept in the state store between micro-batches, and dropped after idle."""
    return track_stream(detections, make, schema, idle=idle)


def stream_tracks_in_order(detections: DataFrame, make: Callable[[], Tracker], schema: str, event_time: str, late: str = "2 seconds", idle: str | None = None) -> DataFrame:
    """The same where micro-batches may bring frames in any order and in parts; see track_in_order. late_rows counts what came too late."""
    return track_in_order(detections, make, schema, event_time, late, idle=idle)


def send_stream(
    rows: DataFrame, post: Callable[[str, str], int], path: str, columns: list[str], order: list[str], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Post what a stream brings, video by video, after each micro-batch; every, such as "10 seconds", sets how often there is one.

    A micro-batch that fails is sent again, so receivers get each row once or more.
    """

    def send(batch: DataFrame, _: int) -> None:
        send_all(batch, post, path, columns, order).collect()

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(send)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_speeds(rows: DataFrame, event_time: str, seconds: float = 0.5, late: str = "10 seconds") -> DataFrame:
    """Count, mean and largest speed of each video in tumbling windows, with late rows accepted for a while."""
    return (
        rows.withWatermark(event_time, late)
        .groupBy("video_id", F.window(event_time, f"{int(seconds * 1000)} milliseconds"))
        .agg(F.count("kmh").alias("n"), F.avg("kmh").alias("mean_kmh"), F.max("kmh").alias("top_kmh"))
        .select("video_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean_kmh", "top_kmh")
    )
