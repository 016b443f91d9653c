"""Queries over heatmap cells, readings and flights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flight, sql
from ..operators import grids, heatmaps
from ..session import table
from .catalog import FRAMES, SEGMENTS, frames, query, r, segments

_CELLS = "with c as (select vec_id as image, (i // 8)::int as row, (i % 8)::int as col, embedding[i + 1]::double as score from (select vec_id, embedding, unnest(range(0, 64)) as i from embeddings))"


@query(_CELLS + """, p as (select c.* from c where score >= 0.01 and not exists (select 1 from c n where n.image = c.image and abs(n.row - c.row) <= 1 and abs(n.col - c.col) <= 1 and (n.row <> c.row or n.col <> c.col) and n.score >= c.score)),
k as (select *, row_number() over (partition by image order by score desc, row, col)::int as rank from p) select image, row, col, rank from k where rank <= 5""")
def junction_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "score"))
    placed = cells.select("image", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), F.col("score").cast("double").alias("score"))
    return grids.junction_peaks(placed, top=5).select("image", "row", "col", "rank")


@query(SEGMENTS + "select a.image, a.line as a, b.line as b from s a join s b on a.image = b.image and a.line < b.line where not (b.line = a.line + 1)")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = segments(spark, sf_dir).select("image", F.col("line").alias("point"))
    known = points.select("image", (F.col("point") + 1).alias("a"), F.col("point").alias("b"))
    return grids.new_pairs(points, known)


@query(SEGMENTS + ", r as (select image, (line - image * 25)::bigint as idx, (line - image * 25) % 7 as v from s) select image, idx from r where idx < 7")
def cyclic_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.col("line") - F.col("image") * 25
    return grids.trim_repeats(segments(spark, sf_dir).select("image", idx.alias("idx"), (idx % 7).alias("v")), ["v"]).select("image", "idx")


@query(SEGMENTS + ", t as (select unnest([-0.5, 0.0, 0.25])::double as threshold) select threshold, count(*) as n, count(*) filter (line % 3 = 0) as hits, round(avg((line % 3 = 0)::int), 6) as precision from s join t on score > threshold group by threshold")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.threshold_sweep(segments(spark, sf_dir), [-0.5, 0.0, 0.25], F.col("line") % 3 == 0).withColumn("precision", r("precision"))


@query(FRAMES + ", l as (select *, lag(event_type) over (partition by video_id order by frame) as last from f) select video_id, frame, event_type from l where last is null or last <> event_type")
def reading_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.changes(frames(spark, sf_dir), "event_type").select("video_id", "frame", "event_type")


_CAMERA, _TURN, _SHIFT = [[1000.0, 0, 640], [0, 1000, 360], [0, 0, 1]], [[1.0, 0, 0], [0, 0, -1], [0, 1, 0]], [0.0, 3.0, 20.0]


@query(FRAMES + """, h as (select video_id, frame, value as x, value + 500 as y, greatest(0.1, abs((value + 500 - 540) / 540) * 2.0::double) as z from f),
d as (select *, (x - 640) / 1000 as u, (y - 360) / 1000 as v from h) select video_id, frame, round((z - 3.0::double) / (-v) * u, 6) as x_m, round(z, 6) as z_m from d""")
def ball_in_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("value") + 500
    place = flight.ray_at_height((F.col("value"), y), _CAMERA, _TURN, _SHIFT, flight.ball_height(y))
    return frames(spark, sf_dir).select("video_id", "frame", r(place[0]).alias("x_m"), r(place[2]).alias("z_m"))


@query()
def launch_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", F.lit(1.5).alias("height"), (1 + F.col("value") / 1000).alias("seconds"), (20 + F.col("value") / 50).alias("metres"))
    return flight.launches(flights, "height", "seconds", "metres")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as heatmaps of 8 x 8 cells."""
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "score"))
    return flat.select("image", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), F.col("score").cast("double").alias("score"))


@query(_CELLS + """, lit as (select image, row, col from c where score > 0.05::double),
edge as (select l.* from lit l where (select count(*) from lit o where o.image = l.image and abs(o.row - l.row) + abs(o.col - l.col) = 1) < 4),
m as (select r, k from (select unnest(range(-3, 4)) as r), (select unnest(range(-3, 4)) as k) where floor(sqrt(r * r + k * k) + 0.5) between 2 and 3),
v as (select image, row + r as row, col + k as col, count(*) as votes from edge, m group by all having count(*) >= 2),
b as (select v.*, row_number() over (partition by image order by votes desc, row, col) as place from v where row between 0 and 7 and col between 0 and 7)
select i.image, (b.col * 2)::double as x, (b.row * 2)::double as y from (select distinct image from c) i left join b on b.image = i.image and place = 1""")
def heatmap_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heatmaps.heatmap_points(cells(spark, sf_dir), 0.05, 2, 3, 2)
    return found.select("image", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


#: 64 embeddings one below the other are a heatmap of 64 x 64 cells, and each of its 8 x 8 blocks has a point in its middle.
_WIDE = """with c as (select (vec_id // 64)::bigint as image, (vec_id % 64)::int as row, i::int as col, embedding[i + 1]::double as score from (select vec_id, embedding, unnest(range(0, 64)) as i from embeddings)),
p as (select distinct image, 8 * (row // 8) + (col // 8) as point, 8 * (col // 8) + 4 as x, 8 * (row // 8) + 4 as y from c),
w as (select p.image, point, c.col - greatest(x - 6, 0) as x, c.row - greatest(y - 6, 0) as y from p join c on c.image = p.image and score > 0.15::double and c.col >= x - 6 and c.col < x + 6 and c.row >= y - 6 and c.row < y + 6),
a as (select w.*, angle::int as angle, angle * (pi() / 36) as t from w, (select unnest(range(0, 36)) as angle)),
v as (select image, point, angle, floor(x * cos(t) + y * sin(t) + 0.5)::int as "offset", count(*) as votes, min(y * cos(t) - x * sin(t)) as low, max(y * cos(t) - x * sin(t)) as high from a group by all)"""


def wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cells and points of _WIDE."""
    flat = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 64).cast("int").alias("row"), F.floor(F.col("vec_id") / 64).alias("image"), F.posexplode("embedding").alias("col", "score"))
    placed = flat.select("image", "row", "col", F.col("score").cast("double").alias("score"))
    br, bc = F.floor(F.col("row") / 8), F.floor(F.col("col") / 8)
    return placed, placed.select("image", (8 * br + bc).alias("point"), (8 * bc + 4).alias("x"), (8 * br + 4).alias("y")).distinct()


@query(_WIDE + """, s as (select * from v where votes >= 4),
o as (select s.image, s.point, s.votes, s.angle as a0, s."offset" as o0, (s.angle + da + 36) % 36 as angle, case when s.angle + da < 0 or s.angle + da >= 36 then -s."offset" else s."offset" end + d as "offset"
  from s, (select unnest(range(-2, 3)) as da), (select unnest(range(-2, 3)) as d) where da <> 0 or d <> 0)
select image, point, angle, "offset", votes, round(low, 6) as low, round(high, 6) as high from s where not exists (select 1 from o where o.image = s.image and o.point = s.point and o.angle = s.angle and o."offset" = s."offset"
  and (o.votes > s.votes or (o.votes = s.votes and (o.a0 < s.angle or (o.a0 = s.angle and o.o0 < s."offset")))))""")
def line_vote_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, points = wide(spark, sf_dir)
    votes = heatmaps.line_votes(heatmaps.around_points(placed, points, 0.15, 6), 36)
    return heatmaps.line_peaks(votes, 4, angles=36).select("image", "point", "angle", "offset", "votes", r("low").alias("low"), r("high").alias("high"))


@query()
def keypoint_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, points = wide(spark, sf_dir)
    return heatmaps.refined_points(placed, points, 0.15, 6, 5, 4, 36)


@query("""with b as (select l_orderkey as frame, l_linenumber as det, l_quantity * 10 as x1, l_linenumber * 25.0::double as y1, l_quantity * 10 + 60 + l_discount * 400 as x2, l_linenumber * 25.0::double + 40 + l_tax * 500 as y2 from lineitem),
p as (select a.frame, a.det as a, o.det as b, greatest(least(a.x2, o.x2) - greatest(a.x1, o.x1), 0) * greatest(least(a.y2, o.y2) - greatest(a.y1, o.y1), 0) as i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) as s, sqrt(pow((a.x1 + a.x2) / 2 - (o.x1 + o.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (o.y1 + o.y2) / 2, 2)) as d,
  (a.x1 + a.x2) / 2 as cx, (a.y1 + a.y2) / 2 as cy from b a join b o on a.frame = o.frame and a.det < o.det)
select frame, a, b, round(i / (s - i), 6) as iou, round(d, 4) as apart, round((0.02::double * cx + 0.5::double) / (0.0001::double * cy + 1), 6) as court_x from p where i / (s - i) > 0.1::double""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of a frame, their distance and place on the court, in SQL text alone."""
    sql.register(spark)
    return spark.sql(
        """
        WITH b AS (
          SELECT l_orderkey AS frame, l_linenumber AS det, double(l_quantity * 10) AS x1, double(l_linenumber * 25) AS y1,
            double(l_quantity * 10 + 60 + l_discount * 400) AS x2, double(l_linenumber * 25 + 40 + l_tax * 500) AS y2
          FROM {lineitem}
        ),
        p AS (
          SELECT a.frame, a.det AS a, o.det AS b, tw_iou(a.x1, a.y1, a.x2, a.y2, o.x1, o.y1, o.x2, o.y2) AS iou,
            tw_distance((a.x1 + a.x2) / 2, (a.y1 + a.y2) / 2, (o.x1 + o.x2) / 2, (o.y1 + o.y2) / 2) AS apart,
            tw_project_x(array(0.02D, 0D, 0.5D, 0D, 0.035D, 0D, 0D, 0.0001D, 1D), (a.x1 + a.x2) / 2, (a.y1 + a.y2) / 2) AS court_x
          FROM b a JOIN b o ON a.frame = o.frame AND a.det < o.det
        )
        SELECT frame, a, b, round(iou, 6) AS iou, round(apart, 4) AS apart, round(court_x, 6) AS court_x FROM p WHERE iou > 0.1D
        """,
        lineitem=table(spark, sf_dir, "lineitem"),
    )
