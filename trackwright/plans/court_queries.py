"""Queries over court corners, planes and conversions. Embeddings stand in for the four court corners seen in an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera, court, flight
from ..functions import geometry as g
from ..operators import boxes as bx
from ..operators import grids
from ..session import table
from .box_queries import H
from .catalog import BOXES, FRAMES, SEGMENTS, boxes, frames, query, r, segments

#: Corners (top-left, top-right, bottom-right, bottom-left) and one more point of each image.
_BASE = [(100.0, 100.0), (500.0, 110.0), (560.0, 410.0), (60.0, 400.0), (300.0, 250.0)]
QUADS = "with q as (select vec_id as image, " + ", ".join(f"{v}::double + 10 * e[{2 * i + j + 1}]::double as {'xy'[j]}{i}" for i, p in enumerate(_BASE) for j, v in enumerate(p)) + " from (select vec_id, embedding as e from embeddings))"
_SQUARE = QUADS + """,
d as (select *, x0 - x1 + x2 - x3 as sx, y0 - y1 + y2 - y3 as sy, x1 - x2 as ux, y1 - y2 as uy, x3 - x2 as vx, y3 - y2 as vy from q),
k as (select *, (sx * vy - vx * sy) / (ux * vy - vx * uy) as g, (ux * sy - sx * uy) / (ux * vy - vx * uy) as k from d),
m as (select *, x1 - x0 + g * x1 as a, x3 - x0 + k * x3 as b, y1 - y0 + g * y1 as d, y3 - y0 + k * y3 as e from k),
o as (select *, (d * k - e * g) * x4 + (b * g - a * k) * y4 + a * e - b * d as w from m),
u as (select image, ((e - y0 * k) * x4 + (x0 * k - b) * y4 + b * y0 - x0 * e) / w as s, ((y0 * g - d) * x4 + (a - x0 * g) * y4 + x0 * d - a * y0) / w as t from o)
"""


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i, j: (F.lit(_BASE[i][j]) + 10 * F.col("embedding")[2 * i + j].cast("double")).alias(f"{'xy'[j]}{i}")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), *(at(i, j) for i in range(5) for j in range(2)))


def corner(i: int) -> g.Point:
    return F.col(f"x{i}"), F.col(f"y{i}")


def corners() -> list[g.Point]:
    return [corner(i) for i in range(4)]


def _seen(spark: SparkSession, sf_dir: str, h: list) -> DataFrame:
    u, v = g.project(corner(4), h, eps=0.0)
    return quads(spark, sf_dir).select("image", r(u).alias("u"), r(v).alias("v"))


@query(_SQUARE + "select image, round(s * 10.97::double, 6) as u, round(t * 23.77::double, 6) as v from u")
def quad_to_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir, g.quad_to_court(corners()))


@query(_SQUARE + "select image, round((s - 0.5::double) * 10.97::double, 6) as u, round((t - 0.5::double) * 23.77::double, 6) as v from u")
def quad_to_centred_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir, g.quad_to_centred_court(corners()))


@query(_SQUARE + "select image, round(2 * s - 1, 6) as u, round(2 * t - 1, 6) as v from u")
def quad_to_mini_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir, g.quad_to_mini_court(corners()))


@query(_SQUARE + "select image, round(sqrt(pow((2 * s - 1) * 5.485::double, 2) + pow((2 * t - 1) * 11.885::double, 2)), 6) as metres from u")
def mini_court_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = g.project(corner(4), g.quad_to_mini_court(corners()), eps=0.0)
    return quads(spark, sf_dir).select("image", r(g.mini_court_metres(p, (F.lit(0.0), F.lit(0.0)))).alias("metres"))


def players_on_mini_court(players: DataFrame, corners: DataFrame, on: list[str], points: list[g.Point]) -> DataFrame:
    """players (x1, y1, x2, y2) with the place u, v of their feet on the normalised court of their section."""
    u, v = g.project(tuple(c.cast("double") for c in g.foot(bx.box("b_"))), g.quad_to_mini_court(points), eps=0.0)
    renamed = players.select(*on, "det", "frame", *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    return renamed.join(corners, on).select("frame", "det", u.alias("u"), v.alias("v"))


@query(BOXES + ", " + _SQUARE.removeprefix("with ").replace("q as (", "z as (", 1).replace(
    ",\nd as", """,
q as (select b.frame, b.det, z.x0, z.y0, z.x1, z.y1, z.x2, z.y2, z.x3, z.y3, trunc((b.x1 + b.x2) / 2) as x4, trunc(b.y2) as y4 from b join z on z.image = b.frame % 40),
d as""", 1).replace("u as (select image,", "u as (select frame, det,") + "select frame, det, round(2 * s - 1, 6) as u, round(2 * t - 1, 6) as v from u")
def mini_court_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumn("image", F.col("frame") % 40)
    placed = players_on_mini_court(rows, quads(spark, sf_dir), ["image"], corners())
    return placed.select("frame", "det", r("u").alias("u"), r("v").alias("v"))


_COURT_CORNERS = [(0.0, 0.0), (10.97, 0.0), (10.97, 23.77), (0.0, 23.77)]
_AT = lambda x, y, row: f"({H[3 * row]}::double * {x} + {H[3 * row + 1]}::double * {y} + {H[3 * row + 2]}::double)"


@query(QUADS + " select image, round(sqrt((" + " + ".join(
    f"pow({_AT(f'x{i}', f'y{i}', 0)} / {_AT(f'x{i}', f'y{i}', 2)} - {u}::double, 2) + pow({_AT(f'x{i}', f'y{i}', 1)} / {_AT(f'x{i}', f'y{i}', 2)} - {v}::double, 2)" for i, (u, v) in enumerate(_COURT_CORNERS)
) + ") / 4), 6) as metres from q")
def warp_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [(F.lit(u), F.lit(v)) for u, v in _COURT_CORNERS]
    return quads(spark, sf_dir).select("image", r(g.warp_error(corners(), targets, H)).alias("metres"))


_BACK = g.inverse(H)
_TO_PIXEL = lambda x, y, row: f"({_BACK[3 * row]!r}::double * {x} + {_BACK[3 * row + 1]!r}::double * {y} + {_BACK[3 * row + 2]!r}::double)"


@query(SEGMENTS + ", p as (select line, 3 + x1 / 100 as x1, 9 + y1 / 100 as y1, 7 + x2 / 100 as x2, 12 + y2 / 100 as y2 from s) select line, " + ", ".join(
    f"round_even({_TO_PIXEL(f'x{e}', f'y{e}', row)} / {_TO_PIXEL(f'x{e}', f'y{e}', 2)}, 0)::int as {'xy'[row]}{e}" for e in (1, 2) for row in (0, 1)
) + " from p")
def warp_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    metres = (3 + F.col("x1") / 100, 9 + F.col("y1") / 100, 7 + F.col("x2") / 100, 12 + F.col("y2") / 100)
    return s.select("line", *(v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), g.warp_segment(metres, _BACK), strict=True)))


def _points() -> F.Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners()))


@query(QUADS + ", c as (" + " union all ".join(f"select image, {i} as corner, x{i} as x, y{i} as y from q" for i in range(4)) + f") select image, corner, round({_AT('x', 'y', 0)} / {_AT('x', 'y', 2)}, 6) as u, round({_AT('x', 'y', 1)} / {_AT('x', 'y', 2)}, 6) as v from c")
def warp_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = quads(spark, sf_dir).select("image", F.posexplode(g.warp_polygon(_points(), H)).alias("corner", "p"))
    return placed.select("image", "corner", r("p.x").alias("u"), r("p.y").alias("v"))


@query(QUADS + """, c as (select image, x0 as x, y3 - 4 * (x0 - 100) as y from q union all select image, x2, y2 from q union all select image, x1, y1 from q union all select image, x3 + 30 * (y0 - 100), y0 from q),
n as (select *, row_number() over (partition by image order by y, x) as k from c),
w as (select *, row_number() over (partition by image, k <= 2 order by x, y) as j from n),
p as (select image, x, y, (case when k <= 2 then j else 5 - j end)::int - 1 as corner from w),
a as (select p.image, sum(p.x * o.y - o.x * p.y) as area from p join p o on o.image = p.image and o.corner = (p.corner + 1) % 4 group by p.image)
select image, case when area <= 0 and corner % 2 = 1 then 4 - corner else corner end as corner, round(x, 6) as x, round(y, 6) as y from p join a using (image)""")
def quad_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads(spark, sf_dir)
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners()
    mixed = [(x0, y3 - 4 * (x0 - 100)), (x2, y2), (x1, y1), (x3 + 30 * (y0 - 100), y0)]
    points = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in mixed))
    return q.select("image", F.posexplode(g.ordered_quad(points)).alias("corner", "p")).select("image", "corner", r("p.x").alias("x"), r("p.y").alias("y"))


@query(QUADS + ", c as (" + " union all ".join(f"select image, {i} as point, {k} as k, abs(y4 + 80 * (x4 - 300) / 10 - y{i}) as d from q" for k, i in enumerate((0, 2, 3, 1))) + ") select image, arg_min(point, (d, k)) as point from c group by image")
def closest_keypoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("y4") + 80 * (F.col("x4") - 300) / 10
    return quads(spark, sf_dir).select("image", g.closest_keypoint(y, _points(), [0, 2, 3, 1]).alias("point"))


@query(QUADS + " select image, round(abs(x0 - x4), 6) as dx, round(abs(y0 - y4), 6) as dy, round(abs(x0 - x4) * 10.97::double / (x1 - x0), 6) as metres, round(abs(y0 - y4) / 100 * (x1 - x0) / 10.97::double, 6) as pixels from q")
def pixel_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = g.axis_distances(corner(0), corner(4))
    known = F.col("x1") - F.col("x0")
    return quads(spark, sf_dir).select(
        "image", r(dx).alias("dx"), r(dy).alias("dy"), r(g.to_metres(dx, g.COURT_WIDTH, known)).alias("metres"), r(g.to_pixels(dy / 100, g.COURT_WIDTH, known)).alias("pixels")
    )


@query(QUADS + ", c as (" + " union all ".join(f"select image, {i} as corner, x{i} as x, y{i} as y from q" for i in range(4)) + ") select image, corner, case when corner <> 2 then round(x * 2, 6) end as x, case when corner <> 2 then round(y * 1.5::double, 6) end as y from c")
def scaled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.transform(_points(), lambda p, i: F.struct(F.when(i != 2, p["x"]).alias("x"), F.when(i != 2, p["y"]).alias("y")))
    placed = quads(spark, sf_dir).select("image", F.posexplode(g.scale_points(points, 2.0, 1.5)).alias("corner", "p"))
    return placed.select("image", "corner", r("p.x").alias("x"), r("p.y").alias("y"))


@query(FRAMES + "select video_id, frame, round(frame / 29::double, 6) as seconds, case when speed >= 20 then printf('%.1f km/h', case when frame % 3 = 0 then speed else speed / 4 * 3.6::double end) end as label from f")
def speed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of km/h, which every third frame has; others come from metres per second."""
    own = F.when(F.col("frame") % 3 == 0, F.col("speed"))
    label = F.when(F.col("speed") >= 20, g.speed_label(own, F.lit(None).cast("double"), F.col("speed") / 4))
    return frames(spark, sf_dir).select("video_id", "frame", r(g.frame_time(F.col("frame"), F.lit(29.97))).alias("seconds"), label.alias("label"))


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else str(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, row)) + ')' for row in rows)}) t({names})"


@query(_values([
    ("baselines", 0, 0.0, 0.0, 10.97, 0.0), ("baselines", 1, 0.0, 23.77, 10.97, 23.77), ("doubles", 0, 0.0, 0.0, 0.0, 23.77), ("doubles", 1, 10.97, 0.0, 10.97, 23.77),
    ("service", 0, 0.0, 5.485, 10.97, 5.485), ("service", 1, 0.0, 18.285, 10.97, 18.285), ("center_serv", 0, 5.485, 5.485, 5.485, 18.285), ("net", 0, 0.0, 11.885, 10.97, 11.885),
    ("singles", 0, 1.37, 0.0, 1.37, 23.77), ("singles", 1, 9.6, 0.0, 9.6, 23.77),
], "kind, idx, u1, v1, u2, v2"))
def court_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return court.court_segment_table(spark).select("kind", "idx", *(r(c).alias(c) for c in ("u1", "v1", "u2", "v2")))


@query(_values([(mode, i, label, u, v) for mode, n in (("4corners", 4), ("8points", 8)) for i, (label, u, v) in enumerate([
    ("near-left singles corner", 0.0, 0.0), ("near-right singles corner", 8.23, 0.0), ("far-right singles corner", 8.23, 23.77), ("far-left singles corner", 0.0, 23.77),
    ("near service line @ left sideline", 0.0, 5.485), ("near service line @ right sideline", 8.23, 5.485), ("far service line @ right sideline", 8.23, 18.285), ("far service line @ left sideline", 0.0, 18.285),
][:n])], "mode, idx, label, u, v"))
def calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return court.calibration_table(spark).select("mode", "idx", "label", r("u").alias("u"), r("v").alias("v"))


@query(QUADS + ", f as (select *, greatest(greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3), greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3)) * 2.2::double as wide from q) select image, round(greatest(wide, 1000), 6) as focal, round((x0 + x1 + x2 + x3) / 4, 6) as cx, round((y0 + y1 + y2 + y3) / 4, 6) as cy from f")
def camera_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    focal, cx, cy = camera.matrix_of([(x * 2.2, y * 2.2) for x, y in corners()])
    return quads(spark, sf_dir).select("image", r(focal).alias("focal"), r(cx / 2.2).alias("cx"), r(cy / 2.2).alias("cy"))


@query()
def camera_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = quads(spark, sf_dir)
    focal, cx, cy = camera.matrix_of(corners())
    return camera.camera_poses(seen.withColumns({"focal": focal, "cx": cx, "cy": cy}), "image")


_PLACE = "case when y0 > y3 - 300 then [8, 11, 0, 3, 9, 1, 10, 2, 6, 7, 4, 5, 13, 12] else [0, 3, 8, 11, 1, 9, 2, 10, 4, 5, 6, 7, 12, 13] end"


@query(QUADS + f", o as (select image, y3 - y0 as low, unnest(range(0, 14)) as place, {_PLACE} as c from q) select image, place::int as place, round(low * (c[place + 1] = 0)::int + c[place + 1], 6) as x from o")
def keypoint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen points whose x is their number (the first's a little more); the first's height decides the order."""
    low = F.col("y3") - F.col("y0")
    points = F.array(*(F.struct((F.lit(float(i)) + (low if i == 0 else 0.0)).alias("x"), (F.col("y0") if i == 0 else F.col("y3") - 300).alias("y")) for i in range(14)))
    placed = quads(spark, sf_dir).select("image", F.posexplode(flight.reordered_keypoints(points)).alias("place", "p"))
    return placed.select("image", "place", r("p.x").alias("x"))


_CROP = SEGMENTS + """, o as (select line, least(x1, x2) + 5 as x1, case when x1 <= x2 then y1 else y2 end + 3 as y1, greatest(x1, x2) + 5 as x2, case when x1 <= x2 then y2 else y1 end + 3 as y2 from s),
k as (select *, (y2 - y1) / (x2 - x1 + 1e-12::double) as m, not (x2 < 0 or x1 > 20) and not ((y1 < 0 and y2 < 0) or (y1 > 12 and y2 > 12)) as kept from o),
a as (select line, kept, m, case when x1 < 0 then 0 else x1 end as x1, case when x1 < 0 then y2 - x2 * m else y1 end as y1, x2, y2 from k),
b as (select line, kept, m, case when y1 < 0 then x2 - y2 / m else x1 end as x1, case when y1 < 0 then 0 else y1 end as y1, x2, y2 from a),
c as (select line, kept, m, x1, y1, case when x2 > 20 then 20 else x2 end as x2, case when x2 > 20 then y1 + (20 - x1) * m else y2 end as y2 from b),
d as (select line, kept, x1, y1, case when y2 > 12 then x1 + (12 - y1) / m else x2 end as x2, case when y2 > 12 then 12 else y2 end as y2 from c)
"""


@query(_CROP + "select line, " + ", ".join(f"case when kept then round({c}, 6) end as {c}" for c in ("x1", "y1", "x2", "y2")) + " from d")
def crop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bx.box()
    swap = s[0] <= s[2]
    ordered = (F.least(s[0], s[2]), F.when(swap, s[1]).otherwise(s[3]), F.greatest(s[0], s[2]), F.when(swap, s[3]).otherwise(s[1]))
    cut = g.crop_segment(ordered, -5.0, -3.0, 20.0, 12.0)
    return segments(spark, sf_dir).select("line", *(r(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), cut, strict=True)))


@query(SEGMENTS + " select line, " + ", ".join(f"round({c} * {k}::double, 6) as {c}" for c, k in (("x1", 999 / 1280), ("y1", 562 / 720), ("x2", 999 / 1280), ("y2", 562 / 720))) + " from s")
def resize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a picture of 1280 x 720 whose shorter side would become 800, but the longer one may have 1000."""
    w, h = g.resized(1280, 720, 800, 1000)
    scaled = g.scale_segment(bx.box(), w / 1280, h / 720)
    return segments(spark, sf_dir).select("line", *(r(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), scaled, strict=True)))


@query(SEGMENTS + " select line, row_number() over (order by image, line) - 1 as id, round(case when x1 < x2 or (x1 = x2 and y1 < y2) then x1 else x2 end, 6) as x, round(case when x1 < x2 or (x1 = x2 and y1 < y2) then y1 else y2 end, 6) as y, round(abs(x2 - x1), 6) as dx, round(case when x1 < x2 or (x1 = x2 and y1 < y2) then y2 - y1 else y1 - y2 end, 6) as dy from s")
def line_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = g.left_to_right(bx.box())
    rows = segments(spark, sf_dir).select("image", "line", *(r(v).alias(c) for c, v in zip(("x", "y", "dx", "dy"), ends, strict=True)))
    return grids.numbered(rows, ["image", "line"], "id").select("line", "id", "x", "y", "dx", "dy")


@query(QUADS + """, k as (select image, 17 - image % 3 as n, unnest(range(0, 17)) as i, x0, y0, x2, y2, x4, y4 from q)
select image, i::int as i, round(greatest(trunc(x0)::int, 0) + (i / 17.0::double) * least(trunc(x2)::int - trunc(x0)::int, 520 - greatest(trunc(x0)::int, 0)), 6) as x,
  round(greatest(trunc(y0)::int, 0) + (1 - i / 17.0::double) * least(trunc(y2)::int - trunc(y0)::int, 380 - greatest(trunc(y0)::int, 0)), 6) as y from k""")
def pose_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quads(spark, sf_dir).select("image", "x0", "y0", "x2", "y2", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("i"))
    x, y = g.from_crop(F.col("i") / 17.0, 1 - F.col("i") / 17.0, (F.col("x0"), F.col("y0"), F.col("x2"), F.col("y2")), 520.0, 380.0)
    return rows.select("image", "i", r(x).alias("x"), r(y).alias("y"))
