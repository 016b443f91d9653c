"""Column functions for boxes, points, polygons and planar homographies. All are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
Point = tuple[Column, Column]

#: Court sizes in metres (fixed values): doubles width, length, singles width, net to service line.
COURT_WIDTH, COURT_LENGTH, SINGLES_WIDTH, SERVICE = 10.97, 23.77, 8.23, 6.40
KMH_PER_MPS, MPH_PER_MPS = 3.6, 2.2369362920544


def center(b: Box) -> Point:
    """Centre, cut to whole pixels."""
    return ((b[0] + b[2]) / 2).cast("int"), ((b[1] + b[3]) / 2).cast("int")


def exact_center(b: Box) -> Point:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def foot(b: Box) -> tuple[Column, Column]:
    """Whole-pixel horizontal centre at the lower edge."""
    return ((b[0] + b[2]) / 2).cast("int"), b[3].cast("int")


def bottom_center(b: Box) -> Point:
    return (b[0] + b[2]) / 2, b[3]


def height(b: Box) -> Column:
    return b[3] - b[1]


def distance(p: Point, q: Point) -> Column:
    return F.hypot(p[0] - q[0], p[1] - q[1])


def axis_distances(p: Point, q: Point) -> tuple[Column, Column]:
    return F.abs(p[0] - q[0]), F.abs(p[1] - q[1])


def closest_keypoint(y: Column, keypoints: Column, indices: list[int]) -> Column:
    """Of the keypoints (array of x, y) at indices the one nearest in height; of two equally near the first in indices."""
    near = F.array_min(F.array(*(F.struct(F.abs(y - keypoints[i]["y"]).alias("d"), F.lit(k).alias("k")) for k, i in enumerate(indices))))
    return F.array(*map(F.lit, indices))[near["k"]]


def to_xywh(b: Box) -> Box:
    """Centre and size, with corners in either order."""
    x1, x2, y1, y2 = F.least(b[0], b[2]), F.greatest(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[1], b[3])
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def to_xyxy(b: Box) -> Box:
    return b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2


def clipped(b: Box, width: float, height_: float) -> Box:
    """Box inside a frame; all null if nothing is left."""
    hold = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(most - 1.0))
    x1, y1, x2, y2 = hold(b[0], width), hold(b[1], height_), hold(b[2], width), hold(b[3], height_)
    good = (x2 > x1) & (y2 > y1)
    return tuple(F.when(good, v) for v in (x1, y1, x2, y2))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes that do not meet."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda r: F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))
    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-9))


def inflate(polygon: list[tuple[float, float]], margin: float) -> list[tuple[float, float]]:
    """Corners moved away from their mean."""
    cx, cy = sum(x for x, _ in polygon) / len(polygon), sum(y for _, y in polygon) / len(polygon)
    return [(cx + (x - cx) * (1 + margin), cy + (y - cy) * (1 + margin)) for x, y in polygon]


def in_polygon(p: Point, polygon: list[tuple[float, float]], eps: float = 1e-9) -> Column:
    """Even-odd test, with edges inside. The polygon is a parameter; its edges are unrolled into one expression."""
    x, y = p
    on_edge, crossings = F.lit(False), F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        between = (x >= min(ax, bx) - eps) & (x <= max(ax, bx) + eps) & (y >= min(ay, by) - eps) & (y <= max(ay, by) + eps)
        on_edge = on_edge | ((F.abs(cross) <= eps) & between)
        if ay != by:
            meets = ((y < ay) != (y < by)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            crossings = crossings + meets.cast("int")
    return on_edge | (crossings % 2 == 1)


def project(p: Point, h: list[float], eps: float = 1e-9) -> Point:
    """Point by a row-major 3x3 homography; null at the line that has no image."""
    x, y = p
    w = h[6] * x + h[7] * y + h[8]
    good = F.abs(w) >= eps
    return F.when(good, (h[0] * x + h[1] * y + h[2]) / w), F.when(good, (h[3] * x + h[4] * y + h[5]) / w)


def inverse(h: list) -> list:
    """The homography back, up to scale, from numbers or columns: the adjugate needs no division."""
    a, b, c, d, e, f, g, k, i = h
    return [e * i - f * k, c * k - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * k - e * g, b * g - a * k, a * e - b * d]


def square_to_quad(q: list[Point]) -> list[Column]:
    """Homography from the unit square's corners (0, 0), (1, 0), (1, 1), (0, 1) to four points in that order."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = q
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    ux, uy, vx, vy = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    det = ux * vy - vx * uy
    g, k = (sx * vy - vx * sy) / det, (ux * sy - sx * uy) / det
    return [x1 - x0 + g * x1, x3 - x0 + k * x3, x0, y1 - y0 + g * y1, y3 - y0 + k * y3, y0, g, k, F.lit(1.0)]


def quad_to_rect(q: list[Point], left: float, top: float, right: float, bottom: float) -> list[Column]:
    """Homography from four points (top-left, top-right, bottom-right, bottom-left) to a rectangle's corners in that order."""
    h = inverse(square_to_quad(q))
    w, l = right - left, bottom - top
    return [w * h[i] + left * h[6 + i] for i in range(3)] + [l * h[3 + i] + top * h[6 + i] for i in range(3)] + h[6:]


def quad_to_court(q: list[Point]) -> list[Column]:
    """To metres of the doubles court, from its top-left corner."""
    return quad_to_rect(q, 0.0, 0.0, COURT_WIDTH, COURT_LENGTH)


def quad_to_centred_court(q: list[Point]) -> list[Column]:
    """To metres from the court's centre."""
    return quad_to_rect(q, -COURT_WIDTH / 2, -COURT_LENGTH / 2, COURT_WIDTH / 2, COURT_LENGTH / 2)


def quad_to_mini_court(q: list[Point]) -> list[Column]:
    """To the normalised court [-1, 1] x [-1, 1]."""
    return quad_to_rect(q, -1.0, -1.0, 1.0, 1.0)


def warp_error(points: list[Point], targets: list[Point], h: list) -> Column:
    """Root mean square distance of the points' images from their targets."""
    square = [F.pow(u - a, 2) + F.pow(v - b, 2) for (u, v), (a, b) in zip((project(p, h) for p in points), targets, strict=True)]
    return F.sqrt(sum(square[1:], square[0]) / len(square))


def warp_segment(s: Box, h: list) -> Box:
    """Both ends by a homography, in whole pixels (halves go to the even one)."""
    ends = (*project((s[0], s[1]), h), *project((s[2], s[3]), h))
    return tuple(F.rint(v).cast("int") for v in ends)


def warp_polygon(points: Column, h: list) -> Column:
    """Array of points by a homography; a polygon with fewer than three corners, or one that has no image, fails."""
    place = F.transform(points, lambda p: F.struct(*(v.alias(n) for n, v in zip("xy", project((p["x"], p["y"]), h), strict=True))))
    bad = (F.size(points) < 3) | F.exists(place, lambda p: p["x"].isNull() | p["y"].isNull())
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a polygon has no image"))).otherwise(place)


def valid_homography(h: Column, least_det: float = 1e-12) -> Column:
    """Whether an array is nine finite numbers with an inverse."""
    a, b, c, d, e, f, g, k, i = (F.get(h, F.lit(n)) for n in range(9))
    det = a * (e * i - f * k) - b * (d * i - f * g) + c * (d * k - e * g)
    finite = (F.size(h) == 9) & F.forall(h, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.abs(det) >= least_det), F.lit(False))


def jacobian_singular_values(p: Point, h: list[float]) -> tuple[Column, Column]:
    """Largest and smallest stretch of the homography at a point."""
    x, y = p
    w = h[6] * x + h[7] * y + h[8]
    u, v = h[0] * x + h[1] * y + h[2], h[3] * x + h[4] * y + h[5]
    a, b = (h[0] * w - u * h[6]) / (w * w), (h[1] * w - u * h[7]) / (w * w)
    c, d = (h[3] * w - v * h[6]) / (w * w), (h[4] * w - v * h[7]) / (w * w)
    trace, det = a * a + b * b + c * c + d * d, F.abs(a * d - b * c)
    spread = F.sqrt(F.greatest(trace * trace - 4 * det * det, F.lit(0.0)))
    largest = F.sqrt((trace + spread) / 2)
    return largest, F.when(largest > 0, det / largest).otherwise(0.0)


def outside_court(p: Point, pad: float = 0.75, width: float = COURT_WIDTH, length: float = COURT_LENGTH) -> Column:
    """Distance in metres from the padded court, 0 inside."""
    u, v = p
    du = F.greatest(-pad - u, u - (width + pad), F.lit(0.0))
    dv = F.greatest(-pad - v, v - (length + pad), F.lit(0.0))
    return F.hypot(du, dv)


def in_court(p: Point, width: float = COURT_WIDTH, length: float = COURT_LENGTH) -> Column:
    return p[0].between(0, width) & p[1].between(0, length)


def near_net(p: Point, band: float = 1.2, lateral: float = 1.0, width: float = COURT_WIDTH, length: float = COURT_LENGTH) -> Column:
    """Within band metres of the net, and no further beside the court than lateral."""
    return (F.abs(p[1] - length / 2) <= band) & p[0].between(-lateral, width + lateral)


def line_intersection(a: Box, b: Box) -> Point:
    """Where the lines through two segments (x1, y1, x2, y2) meet; null if they are parallel."""
    da, db = a[0] * a[3] - a[1] * a[2], b[0] * b[3] - b[1] * b[2]
    det = (a[0] - a[2]) * (b[1] - b[3]) - (a[1] - a[3]) * (b[0] - b[2])
    return (
        F.when(det != 0, (da * (b[0] - b[2]) - (a[0] - a[2]) * db) / det),
        F.when(det != 0, (da * (b[1] - b[3]) - (a[1] - a[3]) * db) / det),
    )


def segment_parameter(p: Point, s: Box) -> Column:
    """Where p's foot falls on a segment: 0 at its start, 1 at its end."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    return ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))


def segment_distance(p: Point, s: Box) -> Column:
    t = F.least(F.greatest(segment_parameter(p, s), F.lit(0.0)), F.lit(1.0))
    return F.hypot(p[0] - (s[0] + t * (s[2] - s[0])), p[1] - (s[1] + t * (s[3] - s[1])))


def line_sq_distance(p: Point, s: Box) -> Column:
    t = segment_parameter(p, s)
    return F.pow(p[0] - (s[0] + t * (s[2] - s[0])), 2) + F.pow(p[1] - (s[1] + t * (s[3] - s[1])), 2)


def segment_angle(s: Box) -> Column:
    """Direction in degrees, from 0 to 180."""
    return F.pmod(F.degrees(F.atan2(s[3] - s[1], s[2] - s[0])), F.lit(180.0))


def angle_between(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 180.0 - d)


def flip_horizontal(s: Box, width: float) -> Box:
    return width - s[2], s[1], width - s[0], s[3]


def flip_vertical(s: Box, height_: float) -> Box:
    return s[0], height_ - s[3], s[2], height_ - s[1]


def rotate_ccw(s: Box, width: float) -> Box:
    return s[1], width - s[0], s[3], width - s[2]


def rotate_cw(s: Box, height_: float) -> Box:
    return height_ - s[1], s[0], height_ - s[3], s[2]


def scale_points(points: Column, sx: float, sy: float) -> Column:
    """Array of points (x, y) in another resolution; null coordinates stay null."""
    return F.transform(points, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))


def frame_time(frame: Column, fps: Column) -> Column:
    """Seconds by whole frames and whole frames per second."""
    return frame.cast("int") / fps.cast("int")


def mini_court_metres(p: Point, q: Point) -> Column:
    """Distance of two points of the normalised court [-1, 1] x [-1, 1]."""
    return F.hypot((p[0] - q[0]) * (COURT_WIDTH / 2), (p[1] - q[1]) * (COURT_LENGTH / 2))


def ordered_quad(points: Column) -> Column:
    """Four points as top-left, top-right, bottom-right, bottom-left; the other way round if that encloses no positive area."""
    low = F.array_sort(F.transform(points, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    row = lambda first: F.array_sort(F.transform(F.slice(low, first, 2), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    quad = F.concat(row(1), F.reverse(row(3)))
    area = lambda q: sum((q[i]["x"] * q[(i + 1) % 4]["y"] - q[(i + 1) % 4]["x"] * q[i]["y"] for i in range(4)), F.lit(0.0))
    turned = lambda q: F.array(q[0], q[3], q[2], q[1])
    return F.element_at(F.transform(F.array(quad), lambda q: F.when(area(q) <= 0, turned(q)).otherwise(q)), 1)


def to_metres(pixels: Column, reference_metres: float, reference_pixels: Column) -> Column:
    """Length by a reference of known length."""
    return pixels * reference_metres / reference_pixels


def to_pixels(metres: Column, reference_metres: float, reference_pixels: Column) -> Column:
    return metres * reference_pixels / reference_metres


def crop_segment(s: Box, left: float, top: float, width: float, height_: float) -> Box:
    """A segment (x1 <= x2) in the coordinates of a crop, cut where it leaves it; all null if it lies beside the crop.

    The cuts are made one after another: left, top, right, bottom; each is at the place where the segment's slope meets that side.
    """
    x1, y1, x2, y2 = s[0] - left, s[1] - top, s[2] - left, s[3] - top
    kept = ~((x2 < 0) | (x1 > width)) & ~(((y1 < 0) & (y2 < 0)) | ((y1 > height_) & (y2 > height_)))
    slope = (y2 - y1) / (x2 - x1 + 1e-12)
    x1, y1 = F.when(x1 < 0, 0.0).otherwise(x1), F.when(x1 < 0, y2 - x2 * slope).otherwise(y1)
    x1, y1 = F.when(y1 < 0, x2 - y2 / slope).otherwise(x1), F.when(y1 < 0, 0.0).otherwise(y1)
    x2, y2 = F.when(x2 > width, width).otherwise(x2), F.when(x2 > width, y1 + (width - x1) * slope).otherwise(y2)
    x2, y2 = F.when(y2 > height_, x1 + (height_ - y1) / slope).otherwise(x2), F.when(y2 > height_, height_).otherwise(y2)
    return tuple(F.when(kept, v) for v in (x1, y1, x2, y2))


def resized(width: int, height_: int, size: int, most: int | None = None) -> tuple[int, int]:
    """Width and height that make the shorter side size, or as much as keeps the longer one within most."""
    short, long = min(width, height_), max(width, height_)
    if most is not None and long / short * size > most:
        size = round(most * short / long)
    return (size, int(size * height_ / width)) if width <= height_ else (int(size * width / height_), size)


def scale_segment(s: Box, sx: float, sy: float) -> Box:
    return s[0] * sx, s[1] * sy, s[2] * sx, s[3] * sy


def left_to_right(s: Box) -> Box:
    """A segment as its left end (of two the upper one) and the way to the other end: x, y, dx, dy."""
    ahead = (s[0] < s[2]) | ((s[0] == s[2]) & (s[1] < s[3]))
    x, y = F.when(ahead, s[0]).otherwise(s[2]), F.when(ahead, s[1]).otherwise(s[3])
    return x, y, F.abs(s[2] - s[0]), F.when(ahead, s[3] - s[1]).otherwise(s[1] - s[3])


def from_crop(x: Column, y: Column, b: Box, width: float, height_: float) -> Point:
    """A pose point, given as a share of a box, in the frame's pixels. The box counts in whole pixels inside the frame."""
    left, top = (F.greatest(v.cast("int"), F.lit(0)) for v in b[:2])
    w = F.least(b[2].cast("int") - b[0].cast("int"), width - left)
    h = F.least(b[3].cast("int") - b[1].cast("int"), height_ - top)
    return left + x * w, top + y * h


def speed_label(kmh: Column, mph: Column, mps: Column, unit: str = "kmh", least: float = 0.0) -> Column:
    """Text such as "12.3 km/h", from metres per second where the unit's own value is missing; null below least."""
    factor, own, name = (KMH_PER_MPS, kmh, "km/h") if unit == "kmh" else (MPH_PER_MPS, mph, "mph")
    value = F.coalesce(own, mps * factor)
    return F.when(value >= least, F.concat(F.format_number(value, 1), F.lit(f" {name}")))


def ray_plane(p: Point, focal: float, cx: float, cy: float, height_: Column) -> tuple[Column, Column, Column]:
    """Point at height height_ below a camera that looks along z: the ray through a pixel cut by that plane."""
    dx, dy = (p[0] - cx) / focal, (p[1] - cy) / focal
    scale = F.when(F.abs(dy) > 1e-12, height_ / dy)
    return dx * scale, height_, scale


def radians(degrees: float) -> float:
    return math.radians(degrees)
