"""Registered queries over the driver's tables, each with the DuckDB SQL that must give the same rows.

The tables hold no video, so they stand in for it: events is a per-frame series for each user, lineitem holds boxes (an order is
a frame), embeddings hold line segments, orders hold sections, labels hold scored predictions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL for the stand-in tables, to be followed by more.
FRAMES = """with f as (
  select user_id as video_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as frame, event_id, event_type, value,
    case when event_type <> 'error' then value end as speed
  from events
)"""
BOXES = """with b as (
  select l_orderkey as frame, l_linenumber as det, l_quantity * 10 as x1, l_linenumber * 25.0::double as y1,
    l_quantity * 10 + 60 + l_discount * 400 as x2, l_linenumber * 25.0::double + 40 + l_tax * 500 as y2, round(1 - l_discount, 2) as conf, l_returnflag as cls
  from lineitem
)"""
SEGMENTS = """with s as (
  select vec_id as line, (vec_id // 25)::bigint as image, embedding[1] * 100 as x1, embedding[2] * 100 as y1, embedding[3] * 100 as x2, embedding[4] * 100 as y2,
    embedding[5]::double as score
  from (select vec_id, list_transform(embedding, lambda e: e::double) as embedding from embeddings)
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, event_id, event_type, value, speed (null where the event is an error)."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "video_id")
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("ts", "event_id")) - 1
    speed = F.when(F.col("event_type") != "error", F.col("value"))
    return events.select("video_id", number.cast("long").alias("frame"), "event_id", "event_type", "value", speed.alias("speed"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, det, x1, y1, x2, y2, conf, cls."""
    x, y = F.col("l_quantity") * 10, F.col("l_linenumber") * 25.0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("det"), x.alias("x1"), y.alias("y1"), (x + 60 + F.col("l_discount") * 400).alias("x2"),
        (y + 40 + F.col("l_tax") * 500).alias("y2"), F.round(1 - F.col("l_discount"), 2).alias("conf"), F.col("l_returnflag").alias("cls"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, image, x1, y1, x2, y2, score."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("line"), F.floor(F.col("vec_id") / 25).alias("image"), (at(0) * 100).alias("x1"), (at(1) * 100).alias("y1"),
        (at(2) * 100).alias("x2"), (at(3) * 100).alias("y2"), at(4).alias("score"),
    )


def videos(series: DataFrame) -> DataFrame:
    return series.groupBy("video_id").agg(F.count("*").alias("total_frames"))


def r(column, digits: int = 6):
    return F.round(column, digits)
