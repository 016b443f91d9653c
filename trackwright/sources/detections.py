"""Reading detections, annotations and calibrations; sending results."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import valid_homography

#: Tables that start the engine.
VIDEO_INFO = "video_id string, fps double, width double, height double, total_frames bigint"
DETECTIONS = "video_id string, frame bigint, kind string, det int, x1 double, y1 double, x2 double, y2 double, conf double, cls int"
_ANNOTATIONS = (
    "images array<struct<id:bigint,file_name:string,height:double,width:double>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,line:array<double>>>"
)


def read_detections(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:  # noqa: A002
    return spark.read.schema(DETECTIONS).format(format).load(path)


def read_line_annotations(spark: SparkSession, path: str) -> DataFrame:
    """image_id, line, x1, y1, x2, y2 of JSON annotations with lines (x, y, dx, dy), held inside their image."""
    raw = spark.read.schema(_ANNOTATIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    images = raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.width", "i.height")
    lines = raw.select(F.explode("annotations").alias("a")).select("a.image_id", F.col("a.id").alias("line"), F.col("a.line").alias("v"))
    hold = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    v, w, h = F.col("v"), F.col("width"), F.col("height")
    return lines.join(images, "image_id").select(
        "image_id", "line", hold(v[0], w).alias("x1"), hold(v[1], h).alias("y1"), hold(v[0] + v[2], w).alias("x2"), hold(v[1] + v[3], h).alias("y2")
    )


def write_checkpoint(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path.startswith("/") and not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def with_empty_frames(detections: DataFrame, videos: DataFrame) -> DataFrame:
    """detections and, for each frame of videos (video_id, total_frames) without one, a row of nulls."""
    spine = videos.select("video_id", F.explode(F.expr("sequence(0L, total_frames - 1)")).alias("frame"))
    return spine.join(detections, ["video_id", "frame"], "left")


def detect(frames: DataFrame, make: Callable[[], Callable[[bytes], list[tuple]]], kind: str) -> DataFrame:
    """Detections of a model over frames (video_id string, frame, image). make loads the model once in each task."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        model = make()
        for batch in batches:
            rows = [(v, f, kind, i, *box) for v, f, image in batch.itertuples(index=False) for i, box in enumerate(model(image))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")])

    return frames.select("video_id", "frame", "image").mapInPandas(run, DETECTIONS)


def fallback(first: DataFrame, images: DataFrame, second: Callable[[DataFrame], DataFrame], keys: list[str], value: str) -> DataFrame:
    """first (keys, value), with second run on the images of rows whose value is null, and only those."""
    missing = images.join(first.where(F.col(value).isNull()).select(*keys), keys, "left_semi")
    return first.where(F.col(value).isNotNull()).unionByName(second(missing).select(*first.columns))


class SendError(RuntimeError):
    pass


def payloads(rows: DataFrame, columns: list[str], order: list[str], unless_null: str | None = None) -> DataFrame:
    """video_id, n and body: a JSON list of each video's rows in order. A result has a row for each section or sample of a video.

    unless_null: videos in which this column is always null have no payload.
    """
    one = F.struct(*order, *(c for c in columns if c not in order))
    lists = rows.groupBy("video_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("__rows"), (F.count(unless_null) if unless_null else F.count("*")).alias("__known")
    )
    body = F.to_json(F.transform("__rows", lambda x: F.struct(*(x[c].alias(c) for c in columns))), {"ignoreNullFields": "false"})
    return lists.where("__known > 0").select("video_id", "n", body.alias("body"))


def send(rows: DataFrame, post: Callable[[str, str], int], path: str, video_id: str) -> int:
    """Post one video's finished result as JSON from the driver; post gives the HTTP status. Its rows, one for each section or sample, are collected."""
    data = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).toLocalIterator()]
    status = post(path, json.dumps({"video_id": video_id, "data": data}))
    if status != 200:
        raise SendError(f"{path}: status {status}")
    return len(data)


def send_all(rows: DataFrame, post: Callable[[str, str], int], path: str, columns: list[str], order: list[str], unless_null: str | None = None) -> DataFrame:
    """Post each video's payload from its task: post gives the HTTP status. Returns video_id, n and status; a status but 200 fails."""
    ready = payloads(rows, columns, order, unless_null)
    kind = ready.schema["video_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for video_id, n, body in batch.itertuples(index=False):
                status = post(path, json.dumps({"video_id": video_id if isinstance(video_id, str) else int(video_id), "data": json.loads(body)}))
                if status != 200:
                    raise SendError(f"{path}: status {status}")
                out.append((video_id, n, status))
            yield pd.DataFrame(out, columns=["video_id", "n", "status"])

    return ready.mapInPandas(run, f"video_id {kind}, n bigint, status int")


CALIBRATION = "video_id string, h array<double>, mode string, width double, height double"


def read_calibration(spark: SparkSession, path: str, strict: bool = True, least_det: float = 1e-12) -> DataFrame:
    """Homographies (nine numbers, row by row). One that is not finite or has no inverse fails, or becomes the identity."""
    raw = spark.read.schema(CALIBRATION).parquet(path)
    other = F.raise_error(F.lit("not a homography")).cast("array<double>") if strict else F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))
    return raw.withColumn("h", F.when(valid_homography(F.col("h"), least_det), F.col("h")).otherwise(other))


def write_calibration(calibrations: DataFrame, path: str) -> None:
    calibrations.select(*(c.split()[0] for c in CALIBRATION.split(", "))).write.mode("overwrite").parquet(path)


def needs_transcoding(width: Column, height: Column, fps: Column, size: tuple[int, int] = (1280, 720), target: float = 30.0) -> Column:
    """Whether a video is of another size, or its frame rate differs by more than 0.1."""
    return ~((width == size[0]) & (height == size[1]) & (F.abs(fps - target) <= 0.1))


_PROBE = "streams array<struct<codec_type:string,width:int,height:int,r_frame_rate:string,nb_frames:string>>"


def video_info(probes: DataFrame, probe: str = "probe") -> DataFrame:
    """The columns of VIDEO_INFO from what a media probe says as JSON (the first video stream); null where it says nothing."""
    streams = F.filter(F.from_json(probe, _PROBE)["streams"], lambda s: s["codec_type"] == "video")
    rate = lambda i: F.split_part(F.col("__s.r_frame_rate"), F.lit("/"), F.lit(i)).try_cast("double")
    return probes.withColumn("__s", F.get(streams, F.lit(0))).select(
        "video_id", (rate(1) / F.coalesce(F.nullif(rate(2), F.lit(0.0)), F.lit(1.0))).alias("fps"), F.col("__s.width").cast("double").alias("width"),
        F.col("__s.height").cast("double").alias("height"), F.col("__s.nb_frames").try_cast("bigint").alias("total_frames"),
    )


def frame_at(frames: DataFrame, index: Column, total: Column) -> DataFrame:
    """The rows of one frame; an index outside the video means its nearest frame."""
    return frames.where(F.col("frame") == F.greatest(F.least(index, total - 1), F.lit(0)))
