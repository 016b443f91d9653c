"""Queries over candidate lines and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids, heatmaps, pixels
from .catalog import SEGMENTS, query, r, segments
from .misc_queries import _CELLS, cells


@query(_CELLS + """, p as (select c.* from c where score >= 0.01 and not exists (select 1 from c n where n.image = c.image and abs(n.row - c.row) <= 1 and abs(n.col - c.col) <= 1 and (n.row <> c.row or n.col <> c.col) and n.score >= c.score)),
k as (select *, row * 8 + col as point, row_number() over (partition by image order by score desc, row, col) as rank from p),
l as (select a.image, a.point as a, b.point as b, a.row + 0.5::double as y1, a.col + 0.5::double as x1, b.row + 0.5::double as y2, b.col + 0.5::double as x2 from k a join k b on a.image = b.image and a.point < b.point where a.rank <= 6 and b.rank <= 6),
s as (select image, a, b, k, y1 * (k / 7::double) + y2 * (1 - k / 7::double) - 0.5::double as y, x1 * (k / 7::double) + x2 * (1 - k / 7::double) - 0.5::double as x from l cross join (select unnest(range(0, 8)) as k)),
g as (select *, least(greatest(floor(y), 0), 7)::int as r0, least(greatest(floor(x), 0), 7)::int as c0 from s),
v as (select g.image, a, b, k, sum(c.score * case dr when 0 then least(r0 + 1, 7) - y else y - r0 end * case dc when 0 then least(c0 + 1, 7) - x else x - c0 end) as v
  from g cross join (select unnest([0, 1]) as dr) cross join (select unnest([0, 1]) as dc) join c on c.image = g.image and c.row = least(r0 + dr, 7) and c.col = least(c0 + dc, 7) group by g.image, a, b, k),
m as (select image, a, b, max(v) filter (k // 2 = 0) as p0, max(v) filter (k // 2 = 1) as p1, max(v) filter (k // 2 = 2) as p2, max(v) filter (k // 2 = 3) as p3 from v group by image, a, b),
z as (select *, 1 / (1 + exp(-(-1 + 6 * p0 - 2 * p1 + 4 * p2 + 8 * p3))) as score from m)
select image, a, b, round(p0, 6) as p0, round(p1, 6) as p1, round(p2, 6) as p2, round(p3, 6) as p3, round(score, 6) as score, row_number() over (partition by image order by round(score, 9) desc, a, b)::int as rank from z where score > 0.5""")
def line_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between the best peaks of each heatmap, scored by what lies along them."""
    placed = cells(spark, sf_dir)
    peaks = grids.junction_peaks(placed, top=6)
    points = peaks.select("image", (F.col("row") * 8 + F.col("col")).alias("point"), (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    pooled = heatmaps.pooled_lines(placed, heatmaps.candidate_lines(points), ["score"], 8, 8, 8, 4)
    found = heatmaps.scored_lines(pooled, [6.0, -2.0, 4.0, 8.0], -1.0)
    return found.select("image", "a", "b", *(r(F.col("pooled")[i]).alias(f"p{i}") for i in range(4)), r("score").alias("score"), "rank")


@query(SEGMENTS + """, i as (select image, (line - image * 25)::bigint as idx, line, floor(score * 20) as v from s),
n as (select a.image, min(b.idx) as cut from i a join i b on a.image = b.image and a.idx = 0 and b.idx > 0 and b.v = a.v group by a.image)
select image, idx, line from i left join n using (image) where cut is null or idx < cut""")
def score_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists cut where the first score comes again, whatever the line."""
    rows = segments(spark, sf_dir).select("image", (F.col("line") - F.col("image") * 25).alias("idx"), "line", F.floor(F.col("score") * 20).alias("v"))
    return grids.trim_repeats(rows, ["v"]).select("image", "idx", "line")


@query(SEGMENTS + """, n as (select *, greatest(ceil(greatest(abs(x2 - x1), abs(y2 - y1))), 1)::int as n from s),
k as (select *, unnest(range(0, n + 1)) as k from n)
select image, floor(y1 + (y2 - y1) * (k / n::double) + 0.5)::int as row, floor(x1 + (x2 - x1) * (k / n::double) + 0.5)::int as col, round(max(score), 6) as score from k group by 1, 2, 3""")
def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.line_pixels(segments(spark, sf_dir)).withColumn("score", r("score"))


def _claimed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, sf_dir)
    truth = pixels.line_pixels(s.where("line % 3 = 0"))
    return pixels.claimed_pixels(pixels.line_pixels(s.where("line % 3 <> 0")), truth, 1.81), truth


@query()
def pixel_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched and unmatched pixels of predicted lines by threshold."""
    claimed, truth = _claimed(spark, sf_dir)
    return pixels.pixel_sums(claimed, truth, [-0.2, -0.1, 0.0, 0.05, 0.1, 0.2])


@query()
def pixel_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed, truth = _claimed(spark, sf_dir)
    return pixels.pixel_precision(pixels.pixel_sums(claimed, truth, [-0.2, -0.1, 0.0, 0.05, 0.1, 0.2]))
