"""Queries over boxes, points, line segments and scored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boxes as bx
from ..operators import lines as ln
from ..operators import matching as mt
from ..session import table
from .catalog import BOXES, FRAMES, SEGMENTS, boxes, frames, query, r, segments

#: A homography from pixels to court metres, and a court polygon in pixels.
H = [0.021, 0.004, -1.2, -0.003, 0.09, -2.5, 0.0002, 0.0011, 1.0]
COURT = [(80.0, 60.0), (420.0, 50.0), (500.0, 210.0), (40.0, 220.0)]
_W = f"({H[6]}::double * x + {H[7]}::double * y + 1)"
_U, _V = f"({H[0]}::double * x + {H[1]}::double * y + {H[2]}::double)", f"({H[3]}::double * x + {H[4]}::double * y + {H[5]}::double)"
_POINTS = BOXES + ", p as (select frame, det, (x1 + x2) / 2 as x, y2 as y from b)"
_PLANE = _POINTS + f", q as (select frame, det, x, y, {_U} / {_W} as u, {_V} / {_W} as v from p)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = g.bottom_center(bx.box())
    return boxes(spark, sf_dir).select("frame", "det", x.alias("x"), y.alias("y"))


def plane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = g.project((F.col("x"), F.col("y")), H)
    return points(spark, sf_dir).withColumns({"u": u, "v": v})


@query(BOXES + """select frame, det, trunc((x1 + x2) / 2)::int as cx, trunc((y1 + y2) / 2)::int as cy, trunc(y2)::int as foot_y, round(y2 - y1, 6) as height,
  round((x1 + x2) / 2, 6) as xc, round((y1 + y2) / 2, 6) as yc, round(x2 - x1, 6) as w, round(y2 - y1, 6) as h from b""")
def bbox_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bx.box()
    (cx, cy), (_, foot_y), (xc, yc, w, h) = g.center(b), g.foot(b), g.to_xywh(b)
    return boxes(spark, sf_dir).select(
        "frame", "det", cx.alias("cx"), cy.alias("cy"), foot_y.alias("foot_y"), r(g.height(b)).alias("height"), r(xc).alias("xc"), r(yc).alias("yc"), r(w).alias("w"), r(h).alias("h")
    )


@query(BOXES + """, c as (select frame, det, least(greatest(x1, 0), 299) as x1, least(greatest(y1, 0), 149) as y1, least(greatest(x2, 0), 299) as x2, least(greatest(y2, 0), 149) as y2 from b)
select frame, det, case when x2 > x1 and y2 > y1 then round(x1, 6) end as x1, case when x2 > x1 and y2 > y1 then round(y2, 6) end as y2 from c""")
def bbox_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1, _, _, y2 = g.clipped(bx.box(), 300, 150)
    return boxes(spark, sf_dir).select("frame", "det", r(x1).alias("x1"), r(y2).alias("y2"))


_IOU = """greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"""
_UNION = f"""greatest((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IOU}, 1e-9::double)"""


@query(BOXES + f"select a.frame, a.det as det_a, b.det as det_b, round({_IOU} / {_UNION}, 6) as iou from b a join b on a.frame = b.frame and a.det < b.det where {_IOU} / {_UNION} > 0")
def bbox_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bx.iou_pairs(boxes(spark, sf_dir), ["frame"]).withColumn("iou", r("iou"))


@query(BOXES + "select frame, det, conf, rank from (select *, row_number() over (partition by frame order by conf desc, det)::int as rank from b where cls = 'N' and conf >= 0.94::double) where rank <= 2")
def yolo_filter_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bx.filter_top(boxes(spark, sf_dir), ["frame"], F.col("cls") == "N", 0.94, 2).select("frame", "det", "conf", "rank")


@query(BOXES.replace("with b", "with recursive b") + f""",
k as (select *, row_number() over (partition by frame order by conf desc, det, x1, y1, x2, y2) as k from b),
n as (
  select frame, k, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det': det}}] as kept from k where k = 1
  union all
  select b.frame, b.k, case when len(list_filter(n.kept, lambda a: {_IOU} / {_UNION} >= 0.21::double)) > 0 then n.kept
    else list_append(n.kept, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'det': b.det}}) end
  from n join k b on b.frame = n.frame and b.k = n.k + 1
),
l as (select frame, kept from n where k = (select max(k) from k where k.frame = n.frame))
select frame, s.det as det, round(s.x1, 6) as x1 from (select frame, unnest(kept) as s from l)
""")  # fmt: skip
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bx.nms(boxes(spark, sf_dir), ["frame"], 0.21).select("frame", "det", r("x1").alias("x1"))


@query(BOXES + f"select frame, det, conf from b where not exists (select 1 from b a where a.frame = b.frame and a.det < b.det and ({_IOU} / {_UNION} >= 0.3::double or sqrt(pow((a.x1 + a.x2 - b.x1 - b.x2) / 2, 2) + pow((a.y1 + a.y2 - b.y1 - b.y2) / 2, 2)) <= 40))")
def anti_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bx.without_near_duplicates(boxes(spark, sf_dir), ["frame"], 0.3, 40).select("frame", "det", "conf")


@query(_PLANE + "select frame, det, round(u, 6) as u, round(v, 6) as v from q")
def homography_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_points(spark, sf_dir).select("frame", "det", r("u").alias("u"), r("v").alias("v"))


def _edge(a: tuple[float, float], b: tuple[float, float]) -> str:
    (ax, ay), (bx_, by) = a, b
    return f"(({ay}::double > y) <> ({by}::double > y) and x < ({bx_} - {ax}) * (y - {ay}) / ({by} - {ay})::double + {ax})::int"


_INSIDE = " + ".join(_edge(a, b) for a, b in zip(g.inflate(COURT, 0.1), g.inflate(COURT, 0.1)[1:] + g.inflate(COURT, 0.1)[:1], strict=True))


@query(_POINTS + f"select frame, det, ({_INSIDE}) % 2 = 1 as inside from p")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = g.in_polygon((F.col("x"), F.col("y")), g.inflate(COURT, 0.1))
    return points(spark, sf_dir).select("frame", "det", inside.alias("inside"))


@query(_PLANE + "select frame, det, round(sqrt(pow(greatest(-0.75 - u, u - 11.72, 0), 2) + pow(greatest(-0.75 - v, v - 24.52, 0), 2)), 6) as outside from q")
def rect_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_points(spark, sf_dir).select("frame", "det", r(g.outside_court((F.col("u"), F.col("v")))).alias("outside"))


@query(_PLANE + "select frame, det, u between 0 and 10.97 and v between 0 and 23.77 as in_court, abs(v - 11.885::double) <= 1.2::double and u between -1 and 11.97 as near_net from q")
def near_net_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("u"), F.col("v"))
    return plane_points(spark, sf_dir).select("frame", "det", g.in_court(p).alias("in_court"), g.near_net(p).alias("near_net"))


@query(_POINTS + f""", j as (select frame, det, ({H[0]}::double * {_W} - {_U} * {H[6]}::double) / pow({_W}, 2) as a, ({H[1]}::double * {_W} - {_U} * {H[7]}::double) / pow({_W}, 2) as b,
  ({H[3]}::double * {_W} - {_V} * {H[6]}::double) / pow({_W}, 2) as c, ({H[4]}::double * {_W} - {_V} * {H[7]}::double) / pow({_W}, 2) as d from p),
t as (select frame, det, a*a + b*b + c*c + d*d as t, abs(a*d - b*c) as k from j), l as (select *, sqrt((t + sqrt(greatest(t*t - 4*k*k, 0))) / 2) as big from t)
select frame, det, round(big, 6) as largest, round(k / big, 6) as smallest from l""")
def jacobian_svals(spark: SparkSession, sf_dir: str) -> DataFrame:
    big, small = g.jacobian_singular_values((F.col("x"), F.col("y")), H)
    return points(spark, sf_dir).select("frame", "det", r(big).alias("largest"), r(small).alias("smallest"))


@query(_PLANE + """, s as (select frame, det, case when v <= 11.885::double then 'top' else 'bottom' end as half,
  2.5::double * (u between 0 and 10.97 and v between 0 and 23.77)::int - 0.9::double * sqrt(pow(greatest(-0.75 - u, u - 11.72, 0), 2) + pow(greatest(-0.75 - v, v - 24.52, 0), 2)) as score from q),
k as (select *, row_number() over (partition by frame, half order by round(score, 6) desc, det) as k from s)
select frame, half, det, round(score, 6) as score from k where k = 1""")
def best_of_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("u"), F.col("v"))
    score = r(2.5 * g.in_court(p).cast("int") - 0.9 * g.outside_court(p))
    return bx.best_of_half(plane_points(spark, sf_dir), ["frame"], F.col("v"), score).select("frame", "half", "det", "score")


@query(BOXES + "select frame, det, row_number() over (partition by frame order by (cls = 'N') desc, conf desc, det)::int as place from b")
def track_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumns({"is_active": F.col("cls") == "N", "speed": F.col("conf")})
    return bx.track_order(rows, ["frame"]).select("frame", "det", "place")


_LABELS = {"view": "ball", "click": "player1", "purchase": "player2"}


@query("""with e as (select user_id % 25 as video_id, (event_id // 20)::bigint as frame, event_id, value, case event_type when 'view' then 'ball' when 'click' then 'player1' when 'purchase' then 'player2' end as label from events)
select video_id, frame, """ + ", ".join(f"arg_min({v}, event_id) filter (label = '{label}') as {n}_{c}" for n, label in (("ball", "ball"), ("p1", "player1"), ("p2", "player2")) for c, v in (("x", "value"), ("y", "value * 2"), ("kmh", "round(value / 10, 6)"))) + " from e group by all")
def frame_facts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "view", "ball").when(F.col("event_type") == "click", "player1").when(F.col("event_type") == "purchase", "player2")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 25).alias("video_id"), F.floor(F.col("event_id") / 20).alias("frame"), F.col("event_id").alias("det"), label.alias("label"),
        F.col("value").alias("x"), (F.col("value") * 2).alias("y"), r(F.col("value") / 10).alias("kmh"),
    )
    return bx.frame_facts(rows)


@query("""with e as (select event_id, (event_id // 8)::bigint as frame, value from events),
p as (select a.frame + 1 as frame, a.event_id as a, b.event_id as b, abs(a.value - b.value) as cost from e a join e b on b.frame = a.frame + 1 where abs(a.value - b.value) <= 60),
k as (select *, row_number() over (partition by frame, a order by cost, b) as ka, row_number() over (partition by frame, b order by cost, a) as kb from p)
select frame, a, b, round(cost, 6) as cost from k where ka = 1 and kb = 1""")
def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 8).alias("frame"), "event_id", "value")
    left = e.select((F.col("frame") + 1).alias("frame"), F.col("event_id").alias("a"), F.col("value").alias("va"))
    right = e.select("frame", F.col("event_id").alias("b"), F.col("value").alias("vb"))
    pairs = mt.gated_pairs(left, right, ["frame"], F.abs(F.col("va") - F.col("vb")), F.col("cost") <= 60)
    return mt.mutual_nearest(pairs, ["frame"]).select("frame", "a", "b", r("cost").alias("cost"))


_AP = SEGMENTS + """, truth as (select image, line as t, x1, y1, x2, y2 from s where line % 3 = 0), pred as (select * from s where line % 3 <> 0),
d as (select p.image, p.line, p.score, t, least(pow(p.x1 - g.x1, 2) + pow(p.y1 - g.y1, 2) + pow(p.x2 - g.x2, 2) + pow(p.y2 - g.y2, 2),
  pow(p.x1 - g.x2, 2) + pow(p.y1 - g.y2, 2) + pow(p.x2 - g.x1, 2) + pow(p.y2 - g.y1, 2)) as dist from pred p left join truth g using (image)),
n as (select *, row_number() over (partition by line order by dist, t) as k from d),
h as (select image, line, score, t, dist, m.limit_ as limit_, coalesce(dist < m.limit_, false) as hit from n, (select unnest([500, 1000, 1500])::double as limit_) m where k = 1),
c as (select *, (hit and row_number() over (partition by limit_, image, t, hit order by score desc, line) = 1)::int as tp from h),
o as (select *, row_number() over (partition by limit_ order by score desc, line) as place, (select count(*) from truth) as n_truth from c),
q as (select *, sum(tp) over (partition by limit_ order by place)::double / n_truth as recall, sum(tp) over (partition by limit_ order by place)::double / place as precision from o),
e as (select *, max(precision) over (partition by limit_ order by place rows between current row and unbounded following) as envelope, recall - coalesce(lag(recall) over (partition by limit_ order by place), 0) as gain from q),
ap as (select limit_, sum(gain * envelope) as ap, max(2 * precision * recall / (precision + recall + 1e-9::double)) as f_score from e group by limit_)
"""


def _line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ap and f_score for three distance limits of predicted against true segments."""
    s = segments(spark, sf_dir)
    names = ("x1", "y1", "x2", "y2")
    truth = s.where("line % 3 = 0").select("image", F.col("line").alias("t"), *(F.col(c).alias(f"t_{c}") for c in names))
    distance = mt.line_pair_distance([F.col(c) for c in names], [F.col(f"t_{c}") for c in names])
    nearest = mt.nearest_truth(s.where("line % 3 <> 0"), truth, ["image"], "line", distance, ["score"])
    limits = nearest.withColumn("limit_", F.explode(F.array(*(F.lit(float(x)) for x in (500, 1000, 1500)))))
    claimed = mt.first_claims(limits, ["limit_", "image"], "t", [F.desc("score"), F.col("line")], F.col("dist") < F.col("limit_"))
    return mt.average_precision(mt.precision_recall(claimed, ["limit_"], [F.desc("score"), F.col("line")], truth), ["limit_"])


@query(_AP + "select limit_, round(ap, 6) as ap, round(f_score, 6) as f_score from ap")
def gt_match_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_scores(spark, sf_dir).select("limit_", r("ap").alias("ap"), r("f_score").alias("f_score"))


@query(_AP + "select round(100 * avg(ap), 6) as mean_ap from ap")
def map_over_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_scores(spark, sf_dir).agg(r(100 * F.avg("ap")).alias("mean_ap"))


@query("""with c as (select vec_id, label, unnest(range(0, 10)) as cls, embedding from embeddings), s as (select vec_id, label, cls, embedding[cls + 1] as score from c),
k as (select *, row_number() over (partition by vec_id order by score desc, cls) as k from s), h as (select vec_id, max((cls = label)::int) as hit from k where k <= 3 group by vec_id)
select round(avg(hit), 6) as accuracy from h""")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"), F.posexplode(F.slice("embedding", 1, 10)).alias("cls", "score"))
    return mt.top_k_accuracy(e, "vec_id", 3).select(r("accuracy").alias("accuracy"))


@query(FRAMES + """select video_id, frame, count(speed) over a as n, round(sum(speed) over a, 4) as total, round(avg(speed / 7.3::double) over a, 6) as mean, round(quantile_cont(speed, 0.5) over w, 6) as recent_median, round(max(speed) over w, 6) as recent_max
from f window a as (partition by video_id order by frame rows between unbounded preceding and current row), w as (partition by video_id order by frame rows between 19 preceding and current row)""")
def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mt.meters(frames(spark, sf_dir), "speed").withColumn("mean", F.col("mean") / 7.3)
    return rows.select("video_id", "frame", "n", r("total", 4).alias("total"), r("mean").alias("mean"), r("recent_median").alias("recent_median"), r("recent_max").alias("recent_max"))


_LINES = SEGMENTS + """, l as (select *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) as length, case when degrees(atan2(y2 - y1, x2 - x1)) < 0 then degrees(atan2(y2 - y1, x2 - x1)) + 180 when degrees(atan2(y2 - y1, x2 - x1)) >= 180 then degrees(atan2(y2 - y1, x2 - x1)) - 180 else degrees(atan2(y2 - y1, x2 - x1)) end as angle from s),
k as (select * from l where length >= 10)"""


@query(_LINES + """ select image, line, round(length, 6) as length from k a where not exists (select 1 from k o where o.image = a.image and o.line <> a.line and (o.length > a.length or (o.length = a.length and o.line < a.line))
  and least(abs(a.angle - o.angle), 180 - abs(a.angle - o.angle)) <= 30 and least(sqrt(pow(a.x1 - o.x1, 2) + pow(a.y1 - o.y1, 2)), sqrt(pow(a.x1 - o.x2, 2) + pow(a.y1 - o.y2, 2)), sqrt(pow(a.x2 - o.x1, 2) + pow(a.y2 - o.y1, 2)), sqrt(pow(a.x2 - o.x2, 2) + pow(a.y2 - o.y2, 2))) <= 12)""")
def line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.without_duplicates(segments(spark, sf_dir), 10, 30, 12).select("image", "line", r("length").alias("length"))


_CROSS = SEGMENTS.replace("with s", "with recursive s") + """,
c as (select a.image, a.line as a, b.line as b, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) as det, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) as tn,
  (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) as sn from s a join s b on a.image = b.image and a.line < b.line),
edges as (select image, a, b from c where det <> 0 and tn / det between -0.05 and 1.05 and sn / det between -0.05 and 1.05)"""


@query(_CROSS + """, both_ways as (select image, a, b from edges union all select image, b, a from edges), reach as (select image, line, line as to_ from s union select r.image, r.line, e.b from reach r join both_ways e on e.image = r.image and e.a = r.to_)
select image, line, min(to_) as component from reach group by all""")
def line_graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return ln.line_components(s, ln.crossing_pairs(s, 0.05))


@query(SEGMENTS + """, p as (select a.image, a.line as a, b.line as b, a.x1 * a.y2 - a.y1 * a.x2 as da, b.x1 * b.y2 - b.y1 * b.x2 as db, (a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2) as det,
  a.x1 - a.x2 as ax, b.x1 - b.x2 as bx from s a join s b on a.image = b.image and b.line = a.line + 1) select image, a, b, round((da * bx - ax * db) / det, 3) as x from p where abs(det) > 100""")
def line_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    other = s.select("image", (F.col("line") - 1).alias("line"), F.col("line").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    p, q = bx.box(), bx.box("b_")
    det = (p[0] - p[2]) * (q[1] - q[3]) - (p[1] - p[3]) * (q[0] - q[2])
    return s.join(other, ["image", "line"]).where(F.abs(det) > 100).select("image", F.col("line").alias("a"), "b", r(g.line_intersection(p, q)[0], 3).alias("x"))


@query(SEGMENTS + """, p as (select *, ((10 - x1) * (x2 - x1) + (5 - y1) * (y2 - y1)) / greatest(pow(x2 - x1, 2) + pow(y2 - y1, 2), 1e-12::double) as t from s),
c as (select *, least(greatest(t, 0), 1) as k from p)
select line, round(sqrt(pow(10 - x1 - k * (x2 - x1), 2) + pow(5 - y1 - k * (y2 - y1), 2)), 6) as to_segment, round(pow(10 - x1 - t * (x2 - x1), 2) + pow(5 - y1 - t * (y2 - y1), 2), 4) as to_line from c""")
def segment_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.lit(10.0), F.lit(5.0))
    return segments(spark, sf_dir).select("line", r(g.segment_distance(p, bx.box())).alias("to_segment"), r(g.line_sq_distance(p, bx.box()), 4).alias("to_line"))


@query(SEGMENTS + "select line, round(640 - x2, 6) as flip_x, round(360 - y2, 6) as flip_y, round(640 - x1, 6) as ccw_y, round(360 - y1, 6) as cw_x from s")
def line_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bx.box()
    return segments(spark, sf_dir).select(
        "line", r(g.flip_horizontal(s, 640)[0]).alias("flip_x"), r(g.flip_vertical(s, 360)[1]).alias("flip_y"), r(g.rotate_ccw(s, 640)[1]).alias("ccw_y"), r(g.rotate_cw(s, 360)[0]).alias("cw_x")
    )


@query()
def line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.merge_close(segments(spark, sf_dir), 20)


@query(SEGMENTS + """, p as (select a.image, a.line as a, b.line as b, round(5 * (abs(a.x1 - b.x1) + abs(a.y1 - b.y1) + abs(a.x2 - b.x2) + abs(a.y2 - b.y2)) / 100 - 1 / (1 + exp(-b.score)), 6) as cost
  from s a join s b on a.image = b.image where a.line % 2 = 0 and b.line % 2 = 1) select image, a, b, cost from p""")
def softmax_l1_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir)


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    names = ("x1", "y1", "x2", "y2")
    b = s.where("line % 2 = 1").select("image", F.col("line").alias("b"), F.col("score").alias("b_score"), *(F.col(c).alias(f"b_{c}") for c in names))
    l1 = sum((F.abs(F.col(c) - F.col(f"b_{c}")) for c in names[1:]), F.abs(F.col("x1") - F.col("b_x1")))
    cost = r(5 * l1 / 100 - 1 / (1 + F.exp(-F.col("b_score"))))
    return s.where("line % 2 = 0").withColumnRenamed("line", "a").join(b, "image").select("image", "a", "b", cost.alias("cost"))


@query()
def hungarian_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.hungarian(_costs(spark, sf_dir), ["image"])


@query()
def line_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.clip_overlaps(segments(spark, sf_dir), threshold=3.0, slack=0.05)


@query("""with p as (select 1 / (1 + exp(-embedding[1]::double)) as p, label % 2 as y, -1 - abs(embedding[2]::double) as t, -1 - abs(embedding[3]::double) as g from embeddings),
h as (select *, case when y = 1 then p else 1 - p end as r, ln(-g) - ln(-t) as l from p)
select round(avg(-ln(r)), 6) as cross_entropy, round(avg(-(case when y = 1 then 0.25::double else 0.75::double end) * pow(1 - r, 2) * ln(r)), 6) as focal,
  round(avg(abs(t - g)), 6) as l1, round(avg(pow(t - g, 2)), 6) as l2, round(avg(l * l) - avg(l) * avg(l), 6) as scale_free from h""")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf_dir, "embeddings").select((1 / (1 + F.exp(-at(0)))).alias("p"), (F.col("label") % 2).alias("y"), (-1 - F.abs(at(1))).alias("t"), (-1 - F.abs(at(2))).alias("g"))
    parts = mt.class_losses(F.col("p"), F.col("y")) | mt.depth_losses(F.col("t"), F.col("g"))
    return rows.agg(*(r(c).alias(n) for n, c in parts.items()))


@query("""with d as (select l_orderkey as frame, l_linenumber as det, l_quantity / 50 as cx, l_linenumber / 8.0::double as cy, l_discount * 4 as w, l_tax * 4 as h, (ascii(l_returnflag) % 3)::int as cls,
  case when l_linenumber % 2 = 0 then 1.0::double else round(1 - l_discount, 2) end as conf from lineitem),
b as (select frame, det, cls, conf, least(greatest((cx * 1280 - w * 1280 / 2), 0), 1279) as x1, least(greatest((cy * 720 - h * 720 / 2), 0), 719) as y1,
  least(greatest((cx * 1280 + w * 1280 / 2), 0), 1279) as x2, least(greatest((cy * 720 + h * 720 / 2), 0), 719) as y2 from d where cls <> 1)
select frame, det, cls, conf, round(x1, 4) as x1, round(y1, 4) as y1, round(x2, 4) as x2, round(y2, 4) as y2 from b where x2 > x1 and y2 > y1""")
def parsed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of odd number as arrays, of even number as JSON without a confidence."""
    rows = table(spark, sf_dir, "lineitem")
    box = F.array(F.col("l_quantity") / 50, F.col("l_linenumber") / 8.0, F.col("l_discount") * 4, F.col("l_tax") * 4)
    cls = (F.ascii("l_returnflag") % 3).cast("int")
    as_text = F.when(F.col("l_linenumber") % 2 == 0, F.to_json(F.struct(box.alias("bbox"), cls.alias("class"))))
    as_array = F.when(F.col("l_linenumber") % 2 == 1, F.concat(box, F.array(F.round(1 - F.col("l_discount"), 2), cls.cast("double"))))
    records = rows.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("det"), as_text.alias("record"), as_array.alias("values"))
    found = bx.parsed(records, (1280, 720), "xywh", normalized=True)
    return found.where("cls <> 1").select("frame", "det", "cls", "conf", *(r(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")))
