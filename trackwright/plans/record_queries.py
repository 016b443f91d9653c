"""Queries over video records, requests, detections as a detector names them, and what is sent on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import valid_homography
from ..operators import boxes as bx
from ..operators import grids, series
from ..sources import detections as src
from ..session import table
from .analyze import request_problems as problems_of
from .catalog import BOXES, FRAMES, SEGMENTS, boxes, frames, query, r, segments

_VIDEOS = "with v as (select s_suppkey as video_id, case when s_suppkey % 3 = 0 then 1920 else 1280 end as width, case when s_suppkey % 5 = 0 then 1080 else 720 end as height, (2970 + 10 * (s_suppkey % 7)) / 100::double as fps, 900 + 7 * s_suppkey as total_frames from supplier)"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    width, height = F.when(k % 3 == 0, 1920).otherwise(1280), F.when(k % 5 == 0, 1080).otherwise(720)
    stream = F.struct(
        F.lit("video").alias("codec_type"), width.alias("width"), height.alias("height"),
        F.concat((2970 + 10 * (k % 7)).cast("string"), F.lit("/100")).alias("r_frame_rate"), (900 + 7 * k).cast("string").alias("nb_frames"),
    )
    sound = F.struct(F.lit("audio").alias("codec_type"))
    both = F.concat(F.lit('{"streams":['), F.to_json(sound), F.lit(","), F.to_json(stream), F.lit("]}"))
    return table(spark, sf_dir, "supplier").select(k.alias("video_id"), both.alias("probe"))


@query(_VIDEOS + " select video_id, fps, width::double as width, height::double as height, total_frames::bigint as total_frames, not (width = 1280 and height = 720 and abs(fps - 30) <= 0.1::double) as transcode from v")
def video_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = src.video_info(probes(spark, sf_dir))
    return info.withColumn("transcode", src.needs_transcoding(F.col("width"), F.col("height"), F.col("fps")))


@query(FRAMES + ", n as (select video_id, count(*) as n from f group by video_id) select video_id, frame, event_id from f join n using (video_id) where frame = greatest(least(video_id * 3 - 60, n - 1), 0)")
def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    sized = rows.join(rows.groupBy("video_id").agg(F.count("*").alias("n")), "video_id")
    return src.frame_at(sized, F.col("video_id") * 3 - 60, F.col("n")).select("video_id", "frame", "event_id")


@query(FRAMES + "select video_id, list(frame order by frame) filter (frame % 50 = 0) as l, count(*) filter (frame % 50 = 0) as n from f where video_id % 4 <> 1 group by video_id".replace(
    "select video_id, list", "select video_id, n, '[' || list_aggregate(list_transform(l, lambda i: '{\"frame\":' || i || ',\"k\":' || (i % 7) || '}'), 'string_agg', ',') || ']' as body from (select video_id, list", 1) + ")")
def speed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of sampled rows; videos without any speed send none."""
    rows = frames(spark, sf_dir).where("frame % 50 = 0").withColumns({"k": F.col("frame") % 7, "speed": F.when(F.col("video_id") % 4 != 1, 1.0)})
    return src.payloads(rows, ["frame", "k"], ["frame", "speed"], unless_null="speed")


_FEATURES = "['DeadTimeDetection', 'MatchSectioning', 'TrackBallSpeed', 'ClassifyShotType']"


@query(f"""with q as (select event_id, case when event_id % 11 = 0 then null else user_id end as video_id, case when event_id % 7 = 0 then 'ftp://x' else 'https://example.com/' || event_id end as video_url,
  list_filter({_FEATURES}, lambda x: (event_id // (case x when 'DeadTimeDetection' then 1 when 'MatchSectioning' then 2 when 'TrackBallSpeed' then 4 else 8 end)) % 2 = 1) as features from events)
select event_id, video_id is null as no_id, not regexp_matches(video_url, '^https?://[^/]+') as no_url,
  (case when (list_contains(features, 'MatchSectioning') or list_contains(features, 'TrackBallSpeed') or list_contains(features, 'ClassifyShotType')) and not list_contains(features, 'DeadTimeDetection') then 1 else 0 end
  + case when (list_contains(features, 'TrackBallSpeed') or list_contains(features, 'ClassifyShotType')) and not list_contains(features, 'MatchSectioning') then 1 else 0 end)::int as missing from q""")
def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["DeadTimeDetection", "MatchSectioning", "TrackBallSpeed", "ClassifyShotType"]
    k = F.col("event_id")
    chosen = F.array_compact(F.array(*(F.when(F.floor(k / 2**i) % 2 == 1, n) for i, n in enumerate(names))))
    requests = table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 11 != 0, F.col("user_id")).alias("video_id"),
        F.when(k % 7 == 0, "ftp://x").otherwise(F.concat(F.lit("https://example.com/"), k.cast("string"))).alias("video_url"), chosen.alias("features"),
    )
    return problems_of(requests).select("event_id", "no_id", "no_url", F.size("missing").alias("missing"))


@query(SEGMENTS + ", h as (select line, x1 / 100 as a, y1 / 100 as b, x2 / 100 as c, y2 / 100 as d, score from s) select line, line % 9 <> 0 and abs(a * d - b * c) >= 0.001::double as good from h")
def calibration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.col(c) / 100
    h = F.array(at("x1"), at("y1"), F.lit(0.0), at("x2"), at("y2"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.when(F.col("line") % 9 == 0, float("nan")).otherwise(1.0))
    return segments(spark, sf_dir).select("line", valid_homography(h, 1e-3).alias("good"))


@query(BOXES + "select frame, det, round((x1 + x2) / 2, 6) as xc, round(y2 - y1, 6) as h, conf, count(*) over (partition by frame) as n from b")
def detection_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bx.as_lists(bx.valid_detections(boxes(spark, sf_dir)).withColumn("cls", F.ascii("cls")))
    v = F.col("values")
    return rows.select("frame", "det", r(v[0]).alias("xc"), r(v[3]).alias("h"), v[4].alias("conf"), "n")


@query("select l_orderkey as frame, l_linenumber as det, case l_returnflag when 'N' then 'players' when 'R' then 'rackets' end as bucket from lineitem where l_returnflag in ('N', 'R')")
def class_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("cls") == "N", "Player").when(F.col("cls") == "R", "RACKET").otherwise("umpire")
    return bx.bucketed(boxes(spark, sf_dir), names, {"player": "players", "racket": "rackets"}).select("frame", "det", "bucket")


@query(FRAMES + "select video_id, frame, case when frame >= 2 then event_id end as e0, case when frame >= 2 then lag(event_id, 1) over w end as e1, case when frame >= 2 then lag(event_id, 2) over w end as e2 from f window w as (partition by video_id order by frame)")
def frame_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("triple")
    return grids.frame_triples(frames(spark, sf_dir), "event_id").select("video_id", "frame", t[0].alias("e0"), t[1].alias("e1"), t[2].alias("e2"))


@query(BOXES + ", k as (select *, row_number() over (partition by frame order by round((x2 - x1) * (y2 - y1), 6) desc, det, conf desc) as k from b) select frame, det, conf from k where k = 1")
def largest_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = r((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return bx.largest(boxes(spark, sf_dir), ["frame"], F.struct(area, -F.col("det"), "conf"), ["conf"], "det")


@query("select event_id, value from (select event_id, case when event_id % 3 = 0 then 'nan'::double else value end as value from events) order by case when isnan(value) then '-infinity'::double else value end desc nulls last, event_id limit 25")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    return bx.top_rows(rows, "value", 25, "event_id")


@query(FRAMES + """, s as (select *, case when event_type <> 'error' then event_type end as reading from f),
k as (select *, lag(reading ignore nulls) over (partition by video_id order by frame) as last from s)
select video_id, frame as index, round(frame / 30::double, 6) as time, reading from k where reading is not null and (last is null or last <> reading)""")
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("reading", F.when(F.col("event_type") != "error", F.col("event_type")))
    return grids.scoreboard(rows, "reading", 30.0).withColumn("time", r("time"))


@query(FRAMES + "select video_id, frame as index, round(frame / 25::double, 6) as time, case event_type when 'purchase' then 'serve' else 'forehand' end as shot_type from f where event_type in ('purchase', 'click')")
def shot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shot = F.when(F.col("event_type") == "purchase", "serve").when(F.col("event_type") == "click", "forehand")
    return series.shot_rows(frames(spark, sf_dir).withColumn("shot_type", shot), 25.0).withColumn("time", r("time"))


_ENDS = SEGMENTS + ", e as (select image, line, 0 as side, round(x1 / 25) as x, round(y1 / 25) as y from s union all select image, line, 1, round(x2 / 25), round(y2 / 25) from s)"


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda i: F.struct(F.lit(i - 1).alias("side"), F.round(F.col(f"x{i}") / 25).alias("x"), F.round(F.col(f"y{i}") / 25).alias("y"))
    return segments(spark, sf_dir).select("image", "line", F.explode(F.array(side(1), side(2))).alias("e")).select("image", "line", "e.*")


@query(_ENDS + " select image, line, side, (dense_rank() over (partition by image order by y, x) - 1)::int as junction from e")
def junction_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.junction_ids(ends(spark, sf_dir), ["y", "x"]).select("image", "line", "side", "junction")


@query(SEGMENTS + """, p as (select a.image, a.line as a, b.line as b, round(least(abs(a.x1 - b.x1), 90) + a.y1 / 100, 6) as overlap from s a join s b on a.image = b.image and a.line < b.line),
k as (select *, row_number() over (partition by image order by overlap desc, a, b)::int as rank from p) select image, a, b, overlap, rank from k where rank <= 40""")
def ranked_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    points = s.select("image", F.col("line").alias("point"))
    pairs = grids.new_pairs(points, points.where("false").select("image", F.col("point").alias("a"), F.col("point").alias("b")))
    at = lambda c: s.select("image", F.col("line").alias(c), F.col("x1").alias(f"{c}x"), F.col("y1").alias(f"{c}y"))
    placed = pairs.join(at("a"), ["image", "a"]).join(at("b"), ["image", "b"])
    overlap = r(F.least(F.abs(F.col("ax") - F.col("bx")), F.lit(90.0)) + F.col("ay") / 100)
    return grids.ranked_negatives(placed, overlap, 40).select("image", "a", "b", "overlap", "rank")


@query(SEGMENTS + ", k as (select image, line, line % 3 = 0 as positive, row_number() over (partition by image, line % 3 = 0 order by md5(line::varchar))::int as draw from s) select image, line, positive from k where draw <= 4")
def sampled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("positive", F.col("line") % 3 == 0)
    return grids.sampled(rows, ["image", "positive"], F.col("line"), 4).select("image", "line", "positive")


@query(SEGMENTS + "select image, line, round(y1 * 128 / 360, 6) as gy1, round(x2 * 128 / 640, 6) as gx2, row_number() over (partition by image order by score desc, line)::int as rank from s")
def prediction_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.prediction_grid(segments(spark, sf_dir), 640.0, 360.0).select("image", "line", r("gy1").alias("gy1"), r("gx2").alias("gx2"), "rank")
