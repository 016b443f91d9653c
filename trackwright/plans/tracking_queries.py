"""Queries that run the trackers. SQL can't express them; tests hold them against what they must do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import project
from ..functions.homography import TEMPLATE, court_homographies
from ..operators.tracking import ball, players, single, world
from ..operators.tracking.runner import track
from .catalog import FRAMES, frames, query, r

#: Pixels to court metres for a camera straight above: 0.02 m for each pixel, and that court in metres.
FLAT = (0.02, 0.0, 0.0, 0.0, 0.035, 0.0, 0.0, 0.0, 1.0)
COURT_M = ((0.0, 0.0), (10.97, 0.0), (10.97, 23.77), (0.0, 23.77))


def ball_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ball that crosses the court at a pace of its video, missing where the event is an error."""
    series = frames(spark, sf_dir)
    seen = F.col("event_type") != "error"
    x = F.pmod(F.col("frame") * (6 + F.col("video_id") % 5), F.lit(500)) + F.col("value") / 100
    y = 100 + F.pmod(F.col("frame") * 9, F.lit(400)).cast("double")
    at = lambda c: F.when(seen, c)
    return series.select(
        "video_id", "frame", at(F.lit(0)).alias("det"), at(x - 5).alias("x1"), at(y - 5).alias("y1"), at(x + 5).alias("x2"), at(y + 5).alias("y2"), at(F.lit(0.8)).alias("conf")
    )


@query()
def ball_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(ball_boxes(spark, sf_dir), lambda: ball.BallTracker(ball.BallSettings(FLAT, COURT_M)), ball.SCHEMA)


@query()
def player_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two players of each video who sway, by as much as the frame's value says, at both ends of the court."""
    series = frames(spark, sf_dir).select("video_id", "frame", "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("det"))
    x, y = 200 + F.col("value") / 25 + 60 * F.sin(F.col("frame") / 9 + F.col("det")), 80 + 450 * F.col("det") + 10 * F.sin(F.col("frame") / 5)
    rows = series.select("video_id", "frame", "det", (x - 20).alias("x1"), (y - 60).alias("y1"), (x + 20).alias("x2"), y.alias("y2"), F.lit(0.9).alias("conf"))
    return track(rows, lambda: players.PlayerTracker(players.PlayerSettings(FLAT)), players.SCHEMA)


@query()
def pixel_to_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ball_boxes(spark, sf_dir).where("conf is not null").withColumns({"kind": F.lit("ball"), "track_id": F.lit(1)})
    return track(rows, lambda: world.WorldSpeed(world.WorldSettings(FLAT)), world.SCHEMA)


@query(FRAMES + """, s as (select video_id, frame // 20 as step_idx, 1 + 1110 * (1 + floor(avg(value)) / 100) * 1e-5::double as w from f group by all)
select video_id, step_idx::int as step_idx, round((832 * 0.4::double + 100) / w, 3) as x, round((1110 * 0.2::double + 50) / w, 3) as y, 0.0::double as error from s""")
def court_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the homography found for each step puts the middle of a service line; the court is seen by a camera that tilts with the step's values."""
    steps = frames(spark, sf_dir).groupBy("video_id", F.floor(F.col("frame") / 20).cast("int").alias("step_idx")).agg(F.floor(F.avg("value")).alias("tilt"))
    places = F.array(*(F.struct(F.lit(i).alias("point"), F.lit(float(x)).alias("u"), F.lit(float(y)).alias("v")) for i, (x, y) in enumerate(TEMPLATE)))
    w = 1 + F.col("p.v") * (1 + F.col("tilt") / 100) * 1e-5
    seen = steps.select("video_id", "step_idx", "tilt", F.explode(places).alias("p"))
    found = court_homographies(seen.select("video_id", "step_idx", "p.point", ((F.col("p.u") * 0.4 + 100) / w).alias("x"), ((F.col("p.v") * 0.2 + 50) / w).alias("y")))
    x, y = project((F.lit(832.0), F.lit(1110.0)), [F.col("h")[i] for i in range(9)])
    return found.select("video_id", "step_idx", r(x, 3).alias("x"), r(y, 3).alias("y"), F.abs(r("error", 3)).alias("error"))


@query()
def single_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(ball_boxes(spark, sf_dir), lambda: single.SingleTracker(single.SingleSettings(FLAT, COURT_M)), single.SCHEMA)


@query(FRAMES.replace("with f", "with recursive f") + """,
p as (select video_id, frame, value / 500 as x, lag(value) over (partition by video_id order by frame) is not null as has from f),
c as (select video_id, frame, x, has from p where frame = 0
  union all select p.video_id, p.frame, case when p.has and c.has and abs(p.x - c.x) > 0.1::double then c.x + sign(p.x - c.x) * 0.1::double else p.x end, p.has
  from c join p on p.video_id = c.video_id and p.frame = c.frame + 1)
select video_id, frame, round(x, 6) as x from c
""")  # fmt: skip
def velocity_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("video_id", "frame", F.lit(0).alias("det"), (F.col("value") / 500).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("frame") > 0, F.lit(1.0)).alias("raw"))
    return track(rows, single.ClampSteps, single.CLAMP_SCHEMA).select("video_id", "frame", F.round("x", 6).alias("x"))
