"""Queries over candidate pairs, tracks and metrics of points and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boxes as bx
from ..operators import court_search, series
from ..operators import lines as ln
from ..operators import matching as mt
from ..operators import segments as sg
from ..session import materialise, table
from .box_queries import _CROSS, _INSIDE, _POINTS, _W, COURT, H, points
from .catalog import FRAMES, SEGMENTS, frames, query, r, segments


@query(_POINTS + f""", m as (select frame, det, x, y, x % 60 as speed, ({_INSIDE}) % 2 = 1 as inside, abs({_W}) >= 1e-9::double as projectable from p),
c as (select *, count(*) filter (inside) over (partition by frame) as inside_count from m)
select frame, det, inside, inside_count, projectable and not (case when inside then inside_count > 1 and speed < 10 else speed < 30 end) as kept from c""")
def court_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("speed", F.col("x") % 60)
    return bx.court_gates(rows, g.inflate(COURT, 0.1), H, 30.0, 10.0).select("frame", "det", "inside", "inside_count", "kept")


_MOVING = "with e as (select event_id, (event_id // 8)::bigint as frame, value as x, (event_id % 8) * 40::double as y, (event_id % 5 - 2) * 1.5::double as vx, (event_id % 3 - 1) * 2::double as vy from events)"


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.floor(k / 8).alias("frame"), F.col("value").alias("x"), ((k % 8) * 40.0).alias("y"), ((k % 5 - 2) * 1.5).alias("vx"), ((k % 3 - 1) * 2.0).alias("vy")
    )


@query(_MOVING + """, p as (select b.frame, a.event_id as a, b.event_id as b, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) as cost, ((b.x - a.x) * a.vx + (b.y - a.y) * a.vy) as dot, sqrt(a.vx * a.vx + a.vy * a.vy) as pace
  from e a join e b on b.frame = a.frame + 1)
select frame, a, b, round(cost, 6) as cost from p where cost <= 150 and cost / 0.5::double <= 260 and (cost <= 1e-9::double or pace <= 1e-9::double or dot / (cost * pace) >= 0.2::double)""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = moving(spark, sf_dir)
    tracks = e.select((F.col("frame") + 1).alias("frame"), F.col("event_id").alias("a"), "x", "y", "vx", "vy")
    found = e.select("frame", F.col("event_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return bx.candidate_pairs(tracks, found, ["frame"], 0.5, 150.0, 260.0, 0.2).select("frame", "a", "b", r("cost").alias("cost"))


@query(_MOVING + """, d as (select b.event_id, min(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2))) as d from e a join e b on b.frame = a.frame + 1 group by b.event_id)
select frame, event_id, case when d <= 60 or d / 0.5::double <= 150 then round(d / 0.5::double, 6) end as speed from e left join d using (event_id)""")
def nearest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moving(spark, sf_dir).withColumns({"det": F.col("event_id"), "video": F.lit(0)})
    return bx.nearest_before(rows, ["video"], 0.5, 60.0, 150.0).select("frame", "event_id", r("speed").alias("speed"))


@query(_MOVING + " select frame, event_id, case event_id % 8 when 0 then 'player1' when 1 then 'player2' end as label from e")
def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moving(spark, sf_dir)
    names = rows.where("event_id % 8 < 2").select("frame", "event_id", F.when(F.col("event_id") % 8 == 0, "player1").otherwise("player2").alias("label"))
    return bx.with_labels(rows, names, ["frame", "event_id"]).select("frame", "event_id", "label")


@query(SEGMENTS + " select image, min(line) filter (score > 0.2::double) as line from s group by image")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = segments(spark, sf_dir).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("line", "score"))).alias("rows"))
    return lists.select("image", mt.first_match("rows", lambda s: s["score"] > 0.2)["line"].alias("line"))


@query(FRAMES + """, t as (select video_id, frame, case event_type when 'purchase' then 'serve' when 'click' then 'backhand' end as shot_type from f)
select video_id, frame, shot_type, last_value(shot_type ignore nulls) over (partition by video_id order by frame rows between unbounded preceding and current row) as current from t""")
def shot_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    kind = F.when(F.col("event_type") == "purchase", "serve").when(F.col("event_type") == "click", "backhand")
    shots = rows.select("video_id", "frame", kind.alias("shot_type"), F.col("event_id").alias("shot")).where("shot_type is not null")
    return sg.overlay(rows.select("video_id", "frame"), shots, ["video_id"]).select("video_id", "frame", "shot_type", "current")


@query(FRAMES + """select video_id, frame, last_value(speed ignore nulls) over w as last, round(avg(speed / 7.3::double) over w, 6) as mean from f window w as (partition by video_id order by frame rows between unbounded preceding and current row)""")
def player_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.expanding(frames(spark, sf_dir), "speed").select("video_id", "frame", "last", r(F.col("mean") / 7.3).alias("mean"))


@query(FRAMES.replace("with f", "with recursive f") + """, n as (select *, row_number() over (partition by video_id order by frame) as n from f where speed is not null),
e as (select video_id, n, frame, speed / 7.3::double as y from n where n = 1
  union all select n.video_id, n.n, n.frame, 0.35::double * (n.speed / 7.3::double) + 0.65::double * e.y from e join n on n.video_id = e.video_id and n.n = e.n + 1)
select f.video_id, f.frame, round(last_value(y ignore nulls) over (partition by f.video_id order by f.frame rows between unbounded preceding and current row), 6) as smooth from f left join e on e.video_id = f.video_id and e.frame = f.frame""")
def ema_over_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("speed", F.col("speed") / 7.3)
    return series.ema(rows, "speed", "smooth", 0.35).select("video_id", "frame", r("smooth").alias("smooth"))


@query(FRAMES + """, t as (select *, coalesce(speed >= 150, false) as flag from f), c as (select *, sum((not flag)::int) over (partition by video_id order by frame) as part from t)
select video_id, frame, (case when flag then row_number() over (partition by video_id, part order by frame) - (case when part = 0 then 0 else 1 end) else 0 end)::bigint as streak from c""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.streaks(frames(spark, sf_dir), F.col("speed") >= 150).select("video_id", "frame", F.col("streak").cast("long").alias("streak"))


@query(FRAMES + """, m as (select video_id, frame, sqrt(pow((value - lag(value) over w) / 5, 2) + pow((value - lag(value) over w) / 300, 2)) * 30 as speed,
  (5 * lag(value, 6) over w - 3 * lag(value, 4) over w - 4 * lag(value, 3) over w - 3 * lag(value, 2) over w + 5 * value) / 300 / 42.0::double as bend from f window w as (partition by video_id order by frame))
select video_id, frame, coalesce(abs(bend) >= 0.1::double, false) as airborne, coalesce(speed < 400 and abs(bend) < 0.1::double, false) as floor_like from m""")
def airborne_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("video_id", "frame", F.col("value").alias("x"), F.col("value").alias("y"))
    return series.airborne_flags(rows, "x", "y", 30.0, 0.1, 400.0, (5.0, 300.0)).select("video_id", "frame", "airborne", "floor_like")


@query(FRAMES + """, k as (select *, frame // 20 as step_idx from f), h as (select distinct video_id, step_idx, case when step_idx % 4 <> 1 then 1 + (step_idx + video_id) % 3 end as scale from k),
l as (select *, last_value(scale ignore nulls) over (partition by video_id order by step_idx rows between unbounded preceding and current row) as known from h)
select video_id, frame, round(value * 0.02::double * known, 6) as u, round(frame * 0.035::double, 6) as v from k join l using (video_id, step_idx)""")
def homography_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    scale = 0.02 * (1 + (F.col("step_idx") + F.col("video_id")) % 3)
    zero, one = F.lit(0.0), F.lit(1.0)
    h = F.array(scale, zero, zero, zero, F.lit(0.035), zero, zero, zero, one)
    steps = rows.select("video_id", F.floor(F.col("frame") / 20).alias("step_idx")).distinct().withColumn("h", F.when(F.col("step_idx") % 4 != 1, h))
    placed = sg.with_latest_homography(rows, steps, 20)
    u, v = g.project((F.col("value"), F.col("frame").cast("double")), [F.col("h")[i] for i in range(9)])
    return placed.select("video_id", "frame", r(u).alias("u"), r(v).alias("v"))


_TRACKS = FRAMES.replace("with f", "with recursive f") + """,
c as (select video_id, frame, speed, value, coalesce((lag(speed) over w is null) <> (speed is null), false)::int * (frame > 0)::int as turn from f window w as (partition by video_id order by frame)),
k as (select *, sum(turn) over (partition by video_id order by frame) as run from c),
u as (select video_id, run, min(frame) as first, count(*) as n, bool_or(speed is not null) as present from k group by video_id, run),
z as (select video_id, max(frame) + 1 as total from f group by video_id),
i as (select u.*, abs(a.value - b.value) / u.n as jump, row_number() over (partition by u.video_id order by first) as j from u
  join f a on a.video_id = u.video_id and a.frame = u.first - 1 join f b on b.video_id = u.video_id and b.frame = u.first + u.n where not present),
st as (select video_id, 0::bigint as j, 0::bigint as begin, null::bigint as s, null::bigint as e from z
  union all
  select i.video_id, i.j, case when (i.n >= 2 or jump > 80) and first - begin > 5 then first + i.n - 1 else begin end, case when (i.n >= 2 or jump > 80) and first - begin > 5 then begin end,
    case when (i.n >= 2 or jump > 80) and first - begin > 5 then first end from st join i on i.video_id = st.video_id and i.j = st.j + 1),
tr as (select video_id, s, e from st where s is not null
  union all select z.video_id, begin, total from (select video_id, arg_max(begin, j) as begin from st group by video_id) b join z using (video_id) where total - begin > 5)"""


@query(_TRACKS + ' select video_id, row_number() over (partition by video_id order by s) - 1 as track_idx, s as start, e as "end" from tr')
def split_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.split_tracks(frames(spark, sf_dir), F.col("speed").isNotNull(), F.col("value"), F.lit(0.0), max_gap=2)


@query(_TRACKS + """, ins as (select tr.video_id, tr.s, frame, speed, case when speed is not null then frame end as seen from tr join f on f.video_id = tr.video_id and frame >= tr.s and frame < tr.e),
b as (select *, last_value(seen ignore nulls) over (partition by video_id, s order by frame rows between unbounded preceding and current row) as pf, last_value(speed ignore nulls) over (partition by video_id, s order by frame rows between unbounded preceding and current row) as ps,
  first_value(seen ignore nulls) over (partition by video_id, s order by frame rows between current row and unbounded following) as nf, first_value(speed ignore nulls) over (partition by video_id, s order by frame rows between current row and unbounded following) as ns from ins),
x as (select video_id, frame, coalesce(case when nf > pf then ps + (ns - ps) * (frame - pf) / (nf - pf) end, ps, ns) as x from b)
select f.video_id, f.frame, round(case when x.frame is not null then x.x else f.speed end, 6) as x from f left join x on x.video_id = f.video_id and x.frame = f.frame""")
def interpolate_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("video_id", "frame", F.col("speed").alias("x"), F.when(F.col("speed").isNotNull(), 0.0).alias("y"))
    return sg.interpolate_tracks(materialise(rows, "series"), "x", "y", max_gap=2).select("video_id", "frame", r("x").alias("x"))


@query(_CROSS + """, both_ways as (select image, a, b from edges union all select image, b, a from edges), reach as (select image, line, line as to_ from s union select r.image, r.line, e.b from reach r join both_ways e on e.image = r.image and e.a = r.to_),
comp as (select image, line, min(to_) as component from reach group by all), n as (select image, component, count(*) as size from comp group by all having count(*) >= 3),
k as (select *, row_number() over (partition by image order by size desc, component)::int as rank from n)
select image, line, component, size, rank from comp join k using (image, component) where rank <= 2""")
def largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return ln.largest_components(ln.line_components(s, ln.crossing_pairs(s, 0.05))).select("image", "line", "component", "size", "rank")


_JUNCTIONS = SEGMENTS + """, truth as (select image, line as t, x1 as x, y1 as y, -1 - abs(y2) / 100 as z from s where line % 3 = 0), pred as (select image, line, x1 as x, y1 as y, -1 - abs(x2) / 100 as z, score from s where line % 3 <> 0),
d as (select p.image, p.line, p.score, p.z, t, g.z as gz, sqrt(pow(p.x - g.x, 2) + pow(p.y - g.y, 2)) as dist from pred p left join truth g using (image)),
n as (select *, row_number() over (partition by line order by dist, t) as k from d)"""


@query(_JUNCTIONS + """, h as (select image, line, score, t, m.limit_ as limit_, coalesce(dist < m.limit_, false) as hit from n, (select unnest([15, 30])::double as limit_) m where k = 1),
c as (select *, (hit and row_number() over (partition by limit_, image, t, hit order by score desc, line) = 1)::int as tp from h),
o as (select *, row_number() over (partition by limit_ order by score desc, line) as place, (select count(*) from truth) as n_truth from c),
q as (select *, sum(tp) over (partition by limit_ order by place)::double / n_truth as recall, sum(tp) over (partition by limit_ order by place)::double / place as precision from o),
e as (select *, max(precision) over (partition by limit_ order by place rows between current row and unbounded following) as envelope, recall - coalesce(lag(recall) over (partition by limit_ order by place), 0) as gain from q)
select limit_, round(sum(gain * envelope), 6) as ap from e group by limit_""")
def junction_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    truth = s.where("line % 3 = 0").select("image", F.col("line").alias("t"), F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    nearest = mt.nearest_truth(s.where("line % 3 <> 0"), truth, ["image"], "line", g.distance((F.col("x1"), F.col("y1")), (F.col("tx"), F.col("ty"))), ["score"])
    limits = nearest.withColumn("limit_", F.explode(F.array(F.lit(15.0), F.lit(30.0))))
    claimed = mt.first_claims(limits, ["limit_", "image"], "t", [F.desc("score"), F.col("line")], F.col("dist") < F.col("limit_"))
    curve = mt.precision_recall(claimed, ["limit_"], [F.desc("score"), F.col("line")], truth)
    return mt.average_precision(curve, ["limit_"]).select("limit_", r("ap").alias("ap"))


def _wireframe_sql(distance: str) -> str:
    return _JUNCTIONS.replace("sqrt(pow(p.x - g.x, 2) + pow(p.y - g.y, 2))", distance) + """,
c as (select *, case when dist < 40 and row_number() over (partition by image, t, dist < 40 order by score desc, line) = 1 then t end as choice from n where k = 1),
l as (select image, count(choice) as hits, avg(abs(gz - z)) filter (choice is not null) as l1, avg(pow(gz - z, 2)) filter (choice is not null) as l2,
  avg(pow(ln(-z) - ln(-gz), 2)) filter (choice is not null) - pow(avg(ln(-z) - ln(-gz)) filter (choice is not null), 2) as scale_free from c group by image),
te as (select image, least(t, o) as a, greatest(t, o) as b, sqrt(pow(x - nx, 2) + pow(y - ny, 2)) as length from (select image, t, x, y, lead(t) over w as o, lead(x) over w as nx, lead(y) over w as ny from truth window w as (partition by image order by t)) where o is not null),
pe as (select image, line, o, score, sqrt(pow(x - nx, 2) + pow(y - ny, 2)) as length from (select image, line, score, x, y, lead(line) over w as o, lead(x) over w as nx, lead(y) over w as ny from pred window w as (partition by image order by line)) where o is not null),
m as (select pe.image, pe.line, pe.score, pe.length, te.a is not null as hit from pe join c u on u.line = pe.line join c v on v.line = pe.o
  left join te on te.image = pe.image and te.a = least(u.choice, v.choice) and te.b = greatest(u.choice, v.choice) and u.choice is not null and v.choice is not null),
total as (select image, sum(length) as total from te group by image),
q as (select image, line, sum(case when hit then length else 0 end) over w / total as recall, sum(case when hit then length else 0 end) over w / sum(length) over w as precision, row_number() over w as place from m join total using (image) window w as (partition by image order by score desc, line)),
e as (select *, max(precision) over (partition by image order by place rows between current row and unbounded following) as envelope, recall - coalesce(lag(recall) over (partition by image order by place), 0) as gain from q),
ap as (select image, sum(gain * envelope) as ap from e group by image)
select image, hits, round(l1, 6) as l1, round(l2, 6) as l2, round(scale_free, 6) as scale_free, round(coalesce(ap, 0), 6) as ap from l left join ap using (image)"""


def _wireframe(spark: SparkSession, sf_dir: str, deep: bool) -> DataFrame:
    s = segments(spark, sf_dir)
    points_of = lambda rows, z: rows.select("image", F.col("line").alias("point"), F.col("x1").alias("x"), F.col("y1").alias("y"), (-1 - F.abs(z) / 100).alias("z"), "score")
    truth, pred = points_of(s.where("line % 3 = 0"), F.col("y2")), points_of(s.where("line % 3 <> 0"), F.col("x2"))
    chain = lambda rows: rows.withColumn("b", F.lead("point").over(Window.partitionBy("image").orderBy("point"))).where("b is not null").select("image", F.col("point").alias("a"), "b", "score")
    found = mt.wireframe(pred, truth, chain(pred), chain(truth), 40.0, deep)
    return found.select("image", "hits", *(r(c).alias(c) for c in ("l1", "l2", "scale_free", "ap")))


@query(_wireframe_sql("sqrt(pow(p.x - g.x, 2) + pow(p.y - g.y, 2))"))
def wireframe_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wireframe(spark, sf_dir, False)


@query(_wireframe_sql("sqrt(pow(p.x - g.x, 2) + pow(p.y - g.y, 2) + pow(p.z - g.z, 2))"))
def wireframe_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wireframe(spark, sf_dir, True)


@query(SEGMENTS + """, c as (select image, abs(count(*) filter (line % 3 <> 0 and score > 0.1::double) - count(*) filter (line % 3 = 0)) as miss from s group by image),
d as (select p.line, min(abs(p.x1 - t.x1) + abs(p.y1 - t.y1) + abs(p.x2 - t.x2) + abs(p.y2 - t.y2)) as l1 from s p join s t on t.image = p.image and t.line % 3 = 0 where p.line % 3 <> 0 group by p.line)
select (select round(avg(miss), 6) from c) as cardinality_error, (select round(avg(l1), 6) from d) as line_l1""")
def line_set_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return mt.line_set_losses(s.where("line % 3 <> 0"), s.where("line % 3 = 0"), 0.1).select(r("cardinality_error").alias("cardinality_error"), r("line_l1").alias("line_l1"))


@query()
def court_search_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts among the segments, set apart as a picture's are."""
    s = segments(spark, sf_dir)
    placed = s.select("image", "line", (320 + 6 * F.col("x1")).alias("x1"), (180 + 4 * F.col("y1")).alias("y1"), (320 + 6 * F.col("x2")).alias("x2"), (180 + 4 * F.col("y2")).alias("y2"))
    return court_search.find_courts(placed)
