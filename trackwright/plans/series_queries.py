"""Queries over per-frame series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments as g
from ..operators import series as s
from ..session import materialise
from .catalog import FRAMES, frames, query, r, videos

#: Frames per second and seconds between samples of the stand-in series.
FPS, STEP = 4.0, 1.75

_SMOOTH = f"""{FRAMES},
m as (select *, avg(speed) over (partition by video_id order by frame rows between 1 preceding and 1 following) as a from f),
filled as (select *, coalesce(first_value(a ignore nulls) over (partition by video_id order by frame rows between current row and unbounded following),
  last_value(a ignore nulls) over (partition by video_id order by frame rows between unbounded preceding and current row)) as b from m)
"""


@query(_SMOOTH + "select video_id, frame, round(least(greatest(b, 20), 400), 6) as smooth from filled where floor(ceil(frame / 7.0) * 7.0) = frame and b is not null")
def smooth_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.smooth_speed(frames(spark, sf_dir), fps=FPS, step=STEP, low=20, high=400).withColumn("smooth", r("smooth"))


@query(FRAMES + "select video_id, frame, round(speed, 6) as speed from f where floor(ceil(frame / 7.0) * 7.0) = frame")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where(s.is_sampled(F.col("frame"), FPS, STEP)).select("video_id", "frame", r("speed").alias("speed"))


@query(FRAMES.replace("with f", "with recursive f") + """,
d as (select video_id, frame, case when frame = 0 then 0 when speed - lag(speed) over w is not null then least(abs(speed - lag(speed) over w), 100 / (4.0::double * 3.6::double)) end as dist from f window w as (partition by video_id order by frame)),
m as (select *, avg(dist) over (partition by video_id order by frame rows between 1 preceding and 1 following) as a from d),
x as (select video_id, frame, coalesce(first_value(a ignore nulls) over (partition by video_id order by frame rows between current row and unbounded following),
  last_value(a ignore nulls) over (partition by video_id order by frame rows between unbounded preceding and current row)) as x from m),
e as (select video_id, frame, x as y from x where frame = 0
  union all select x.video_id, x.frame, 0.3::double * x.x + 0.7::double * e.y from e join x on x.video_id = e.video_id and x.frame = e.frame + 1)
select video_id, frame, round(least(greatest(y, 0), 100 / (4.0::double * 3.6::double)) * 4.0::double * 3.6::double, 6) as kmh from e where floor(ceil(frame / 7.0) * 7.0) = frame
""")  # fmt: skip
def dist_to_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = F.abs(F.col("speed") - F.lag("speed").over(s.part_window()))
    return s.distance_speed(frames(spark, sf_dir), distance, FPS, STEP, 100).withColumn("kmh", r("kmh"))


@query(FRAMES.replace("with f", "with recursive f") + """,
e as (select video_id, frame, value / 7.3::double as y from f where frame = 0
  union all select f.video_id, f.frame, 0.35::double * (f.value / 7.3::double) + 0.65::double * e.y from e join f on f.video_id = e.video_id and f.frame = e.frame + 1)
select video_id, frame, round(y, 6) as smooth from e
""")  # fmt: skip
def ema_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = frames(spark, sf_dir).withColumn("value", F.col("value") / 7.3)
    return s.ema(series, "value", "smooth", 0.35, dense=True).select("video_id", "frame", r("smooth").alias("smooth"))


@query(FRAMES + """,
n as (select f.video_id, f.frame, p.frame - f.frame as t, p.value as x, pow(0.7::double, 2 * (f.frame - p.frame)) as w
  from f join f p on p.video_id = f.video_id and p.frame between f.frame - 6 and f.frame),
a as (select video_id, frame, count(*) as n, sum(w) as w, sum(w * t) as t, sum(w * x) as x, sum(w * t * t) as tt, sum(w * t * x) as tx from n group by all)
select video_id, frame, round(case when n >= 2 then (w * tx - t * x) / (w * tt - t * t) end, 6) as slope from a
""")  # fmt: skip
def weighted_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.weighted_slope(frames(spark, sf_dir), "frame", "value").select("video_id", "frame", r("slope").alias("slope"))


@query(FRAMES + """
select video_id, frame, round((5 * lag(value, 6) over w - 3 * lag(value, 4) over w - 4 * lag(value, 3) over w - 3 * lag(value, 2) over w + 5 * value) / 42.0::double, 6) as curvature
from f window w as (partition by video_id order by frame)
""")  # fmt: skip
def curvature7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.curvature(frames(spark, sf_dir), "value").select("video_id", "frame", r("curvature").alias("curvature"))


@query(FRAMES + """,
m as (select video_id, frame, value, list(value) over w as v, quantile_cont(value, 0.5) over w as m
  from f window w as (partition by video_id order by frame rows between 23 preceding and current row)),
d as (select *, list_sort(list_transform(v, lambda x: abs(x - m))) as d from m)
select video_id, frame, len(v) >= 7 and abs(value - m) > 3 * (1.4826::double * (d[(len(d) + 1) // 2] + d[len(d) // 2 + 1]) / 2 + 1e-9::double) as outlier from d
""")  # fmt: skip
def hampel_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.hampel(frames(spark, sf_dir), "value").select("video_id", "frame", "outlier")


_AROUND = f"""{FRAMES},
n as (select video_id, frame, speed,
  last_value(case when speed is not null then frame end ignore nulls) over before as lf, last_value(speed ignore nulls) over before as lv,
  first_value(case when speed is not null then frame end ignore nulls) over ahead as nf, first_value(speed ignore nulls) over ahead as nv
  from f window before as (partition by video_id order by frame rows between unbounded preceding and current row),
    ahead as (partition by video_id order by frame rows between current row and unbounded following))
"""


@query(_AROUND + "select video_id, frame, round(case when nf is null or frame - lf <= nf - frame then lv else nv end, 6) as speed from n")
def nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.nearest_fill(frames(spark, sf_dir), "speed").select("video_id", "frame", r("speed").alias("speed"))


@query(_AROUND + "select video_id, frame, round(coalesce(case when nf > lf then lv + (nv - lv) * (frame - lf) / (nf - lf) end, lv, nv), 6) as speed from n")
def lerp_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.lerp_gaps(frames(spark, sf_dir), "speed").select("video_id", "frame", r("speed").alias("speed"))


@query(FRAMES + """,
d as (select video_id, frame, speed, coalesce(abs(speed - lag(speed) over w), -1) as dist from f window w as (partition by video_id order by frame)),
k as (select *, coalesce(dist > 200 and (lead(dist) over w > 200 or lead(dist) over w = -1), false) as away, coalesce(lag(dist) over w = -1, false) as fresh from d window w as (partition by video_id order by frame)),
p as (select *, dist > 200 and not away and fresh as prior from k)
select video_id, frame, case when not (away or coalesce(lead(prior) over w, false)) then round(speed, 6) end as speed from p window w as (partition by video_id order by frame)
""")  # fmt: skip
def outlier_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.coalesce(F.abs(F.col("speed") - F.lag("speed").over(s.part_window())), F.lit(-1.0))
    rows = s.with_windows(frames(spark, sf_dir), 1, 0, dist=step)
    return s.drop_jumps(rows, "speed", "dist", 200).select("video_id", "frame", r("speed").alias("speed"))


@query(FRAMES + """,
n as (select video_id, frame, list(value) over (partition by video_id order by frame rows between 9 preceding and current row) as pool from f where speed is not null)
select video_id, frame, round(list_sum(list_transform(range(1, 11), lambda i: i * pool[i])), 4) as weighted from n where len(pool) = 10
""")  # fmt: skip
def rolling_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = F.aggregate(F.transform("pool", lambda v, i: (i + 1) * v), F.lit(0.0), lambda a, v: a + v)
    return s.rolling_pool(frames(spark, sf_dir), "speed", 10).select("video_id", "frame", r(weighted, 4).alias("weighted"))


@query(FRAMES + """,
v as (select video_id, frame, value - lag(value) over w as vy from f window w as (partition by video_id order by frame)),
a as (select *, (vy - lag(vy) over w) / 900 as ay, lag(vy) over w as last from v window w as (partition by video_id order by frame))
select video_id, frame, coalesce(last * vy < 0 and abs(last) >= 100 and abs(vy) >= 100, false) or coalesce(abs(ay) >= 0.45::double, false) as bounce from a
""")  # fmt: skip
def bounce_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = s.part_window()
    moved = s.with_windows(frames(spark, sf_dir), 1, 0, vy=F.col("value") - F.lag("value").over(w))
    turned = s.with_windows(moved, 1, 0, ay=(F.col("vy") - F.lag("vy").over(w)) / 900)
    return s.bounce_flags(turned, "vy", "ay", fast=100).select("video_id", "frame", "bounce")


@query(FRAMES + """,
m as (select *, case when frame = 0 or coalesce(abs(speed - lag(speed) over w) >= 150, false) then frame end as mf, case when speed is not null then frame end as sf from f window w as (partition by video_id order by frame)),
l as (select *, last_value(mf ignore nulls) over w as turned, last_value(sf ignore nulls) over w as seen from m window w as (partition by video_id order by frame rows between unbounded preceding and current row))
select video_id, frame, frame - turned as idle, round(exp(-(frame - lag(seen) over (partition by video_id order by frame)) / 30.0::double), 6) as recency from l
""")  # fmt: skip
def idle_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.idle_and_recency(frames(spark, sf_dir), "speed", 150).select("video_id", "frame", "idle", r("recency").alias("recency"))


@query(FRAMES + "select video_id, frame, round(value / max(value) over (partition by video_id), 6) as value from f")
def scaled_by_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.scaled_by_max(frames(spark, sf_dir), "value").select("video_id", "frame", r("value").alias("value"))


@query(FRAMES + """,
t as (select video_id, frame, list(event_id) over (partition by video_id order by frame rows between 6 preceding and current row) as t from f)
select video_id, frame, len(t) as n, t[1] as oldest from t
""")  # fmt: skip
def trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.trails(frames(spark, sf_dir), "event_id", 7).select("video_id", "frame", F.size("trail").cast("long").alias("n"), F.col("trail")[0].alias("oldest"))


@query(FRAMES + "select video_id, frame, event_id from f where frame >= 5 and frame < 50 and (frame - 5) % 4 = 0")
def strided_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.strided(frames(spark, sf_dir), 5, 50, 4).select("video_id", "frame", "event_id")


@query(FRAMES + "select video_id, frame, event_id from f where frame // 20 = 2")
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.frame_chunk(frames(spark, sf_dir), 2, 20).select("video_id", "frame", "event_id")


@query(FRAMES + "select video_id, frame, event_id from f where frame >= 2 and (frame - 2) % 3 = 0")
def lower_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.lower_rate(frames(spark, sf_dir), 30, 10, 2).select("video_id", "frame", "event_id")


@query(FRAMES + "select video_id, count(*) as total_frames, ceil(count(*) / 10.0)::bigint as chunks from f group by video_id")
def chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos(frames(spark, sf_dir)).withColumn("chunks", F.ceil(F.col("total_frames") / 10))


_RUNS = f"""{FRAMES},
ok as (select video_id, frame, event_type in ('view', 'click', 'purchase') as value from f),
c as (select *, coalesce(lag(value) over (partition by video_id order by frame) <> value, false)::int as turn from ok),
k as (select *, sum(turn) over (partition by video_id order by frame) as run from c),
kept as (select video_id, frame, value and count(*) over (partition by video_id, run) >= 3 as value from k)
"""
_FALSE = """,
c2 as (select *, coalesce(lag(value) over (partition by video_id order by frame) <> value, false)::int as turn from kept),
k2 as (select *, sum(turn) over (partition by video_id order by frame) as run from c2),
dead as (select video_id, min(frame) as start, max(frame) as "end" from k2 where not value group by video_id, run having count(*) >= 4)
"""
_VALID = ["view", "click", "purchase"]


@query(_RUNS + "select video_id, frame, value from kept")
def suppress_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.suppress_short(frames(spark, sf_dir), F.col("event_type").isin(*_VALID), 6, 2)


@query(_RUNS + _FALSE + 'select video_id, start, "end" from dead')
def false_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = g.suppress_short(frames(spark, sf_dir), F.col("event_type").isin(*_VALID), 6, 2)
    return g.false_runs(kept, F.col("value"), 8, 2)


@query(_RUNS + _FALSE + """,
e as (select video_id, start * 60.0::double as s, "end" * 60.0::double as e, false as tail from dead union all select video_id, count(*) * 60.0::double, null, true from f group by video_id),
b as (select *, coalesce(lag(e) over (partition by video_id order by tail, s) + 1, 0) as begin from e)
select video_id, begin as start_index, begin / 30 as start_time, case when tail then s else s - 1 end as end_index, case when tail then s else s - 1 end / 30 as end_time from b where begin < s
""")  # fmt: skip
def deadtime_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = frames(spark, sf_dir)
    whole = videos(series).withColumn("total_frames", F.col("total_frames") * 60)
    return g.dead_time(series, F.col("event_type").isin(*_VALID), whole, step=2, fps=30, true_seconds=6, false_seconds=8)


_RALLY = FRAMES.replace("with f", "with recursive f") + """,
t as (select video_id, frame, count(*) over (partition by video_id) as n, event_type = 'error' or (frame > 0 and value / 10 < 10) as empty from f),
w as (
  select video_id, frame, n, case when empty then null else frame end as start, 0 as empties, null::bigint as s, null::bigint as e from t where frame = 0
  union all
  select t.video_id, t.frame, t.n,
    case when w.start is null then (case when t.empty then null else t.frame end) when t.empty and w.empties + 1 > 2 then null else w.start end,
    case when w.start is not null and t.empty and w.empties + 1 <= 2 then w.empties + 1 when w.start is not null and not t.empty then w.empties else 0 end,
    case when w.start is not null and t.empty and w.empties + 1 > 2 and t.frame - w.start > 3 and (w.empties + 1) / (t.frame - w.start)::double < 0.75 then w.start end,
    t.frame
  from w join t on t.video_id = w.video_id and t.frame = w.frame + 1
),
raw as (
  select video_id, n, s, e from w where s is not null
  union all select video_id, n, start, n from w where frame = n - 1 and start is not null and n - start > 3
),
g as (select *, case when lag(e) over o is null or s - least(lag(e) over o + 2, n) >= 2 then 1 else 0 end as fresh from raw window o as (partition by video_id order by s)),
i as (select *, sum(fresh) over (partition by video_id order by s) - 1 as section_idx from g),
sections as (select video_id, section_idx::bigint as section_idx, greatest(min(s) - 4, 0)::bigint as start_index, least(max(e) + 2, max(n))::bigint as end_index from i group by video_id, section_idx)
"""
_RALLY_SETTINGS = g.Rally(fps=2)


def _rallies(series: DataFrame) -> DataFrame:
    return g.rally_sections(series, F.col("event_type") != "error", F.col("value") / 10, _RALLY_SETTINGS)


@query(_RALLY + "select video_id, section_idx, start_index, start_index / 2 as start_time, end_index, end_index / 2 as end_time from sections")
def rally_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rallies(frames(spark, sf_dir))


@query(_RALLY + "select s.video_id, section_idx, frame, event_id from sections s join f on f.video_id = s.video_id and frame >= start_index and frame < end_index")
def section_frame_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = materialise(frames(spark, sf_dir), "series")
    return g.section_frames(_rallies(series), series).select("video_id", "section_idx", "frame", "event_id")


@query(_RALLY + ", inside as (select distinct s.video_id, frame from sections s join f on f.video_id = s.video_id and frame >= start_index and frame < end_index) select f.video_id, f.frame, case when inside.frame is not null then event_id end as event_id from f left join inside on inside.video_id = f.video_id and inside.frame = f.frame")
def gap_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = materialise(frames(spark, sf_dir), "series")
    return g.pad_gaps(_rallies(series), series, videos(series), ["event_id"])


@query(_RALLY + """select video_id, section_idx, least(round_even(floor((start_index + end_index) / 2 / 2) / 3.0::double, 0)::bigint, 6) as step_idx from sections""")
def keypoint_for_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _rallies(frames(spark, sf_dir))
    return sections.select("video_id", "section_idx", g.keypoint_step(F.col("start_time"), F.col("end_time"), 3.0, F.lit(7)).alias("step_idx"))


@query(FRAMES.replace("with f", "with recursive f") + """,
a as (select video_id, frame from f where event_type = 'purchase'),
k as (select video_id, min(frame) as frame from a where frame > 5 group by video_id
  union all select k.video_id, (select min(a.frame) from a where a.video_id = k.video_id and a.frame > k.frame + 5) from k where k.frame is not null)
select video_id, frame from k where frame is not null
""")  # fmt: skip
def debounce_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.debounce(frames(spark, sf_dir), F.col("event_type") == "purchase", 5)


@query(FRAMES + """,
s as (select video_id, frame // 20 as section_idx, frame, case event_type when 'purchase' then 'serve' when 'click' then 'backhand' else 'forehand' end as shot from f where event_type in ('purchase', 'click', 'signup'))
select video_id, section_idx, frame, case when shot = 'serve' and frame > min(frame) over (partition by video_id, section_idx) then 'forehand' else shot end as shot_type from s
""")  # fmt: skip
def serve_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.relabel_serves(_shots(spark, sf_dir), ["video_id", "section_idx"]).select("video_id", "section_idx", "frame", "shot_type")


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "serve").when(F.col("event_type") == "click", "backhand").otherwise("forehand")
    rows = frames(spark, sf_dir).where(F.col("event_type").isin("purchase", "click", "signup"))
    return rows.select("video_id", F.floor(F.col("frame") / 20).alias("section_idx"), "frame", kind.alias("shot_type"))


@query(FRAMES + """,
s as (select video_id, frame // 20 as section_idx, case event_type when 'purchase' then 'serve' when 'click' then 'backhand' else 'forehand' end as shot from f where event_type in ('purchase', 'click', 'signup'))
select video_id, section_idx, count(*) as shots, count(*) filter (shot = 'serve') as serves, string_agg(distinct shot, ',' order by shot) as kinds from s group by all
""")  # fmt: skip
def shot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_join(F.array_sort(F.collect_set("shot_type")), ",")
    return _shots(spark, sf_dir).groupBy("video_id", "section_idx").agg(
        F.count("*").alias("shots"), F.count_if(F.col("shot_type") == "serve").alias("serves"), kinds.alias("kinds")
    )


@query(FRAMES + "select video_id, count(speed) as n, round(min(speed), 6) as low, round(max(speed), 6) as high, round(avg(speed), 6) as mean from f group by video_id")
def speed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("video_id").agg(
        F.count("speed").alias("n"), r(F.min("speed")).alias("low"), r(F.max("speed")).alias("high"), r(F.avg("speed")).alias("mean")
    )


@query(_RALLY + """,
m as (select *, avg(speed) over (partition by video_id order by frame rows between 1 preceding and 1 following) as a from f),
filled as (select *, coalesce(first_value(a ignore nulls) over (partition by video_id order by frame rows between current row and unbounded following),
  last_value(a ignore nulls) over (partition by video_id order by frame rows between unbounded preceding and current row)) as b from m),
smooth as (select video_id, frame, least(greatest(b, 20), 400) as smooth from filled where floor(ceil(frame / 7.0) * 7.0) = frame and b is not null)
select s.video_id, section_idx, start_index, end_index, count(frame) as samples, round(avg(smooth), 6) as mean_speed, round(max(smooth), 6) as top_speed
from sections s left join smooth m on m.video_id = s.video_id and frame >= start_index and frame < end_index group by all
""")  # fmt: skip
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: rally sections with the smoothed, sampled speeds inside each."""
    series = materialise(frames(spark, sf_dir), "series")
    sections = materialise(_rallies(series), "sections")
    smooth = s.smooth_speed(series, fps=FPS, step=STEP, low=20, high=400)
    keys = ["video_id", "section_idx", "start_index", "end_index"]
    inside = g.section_frames(sections.select(*keys), smooth).groupBy(*keys).agg(
        F.count("*").alias("samples"), r(F.avg("smooth")).alias("mean_speed"), r(F.max("smooth")).alias("top_speed")
    )
    return sections.select(*keys).join(inside, keys, "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
