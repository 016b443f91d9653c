"""Several ball hypotheses, of which one is the ball in play.

In each frame: suppress overlapping detections, put them on the court plane, match them to tracks inside speed-dependent gates
(mutual nearest first, then cheapest first, then a second chance with a wider speed cap), age the rest, start tracks from what
is left, merge tracks that meet, drop lost ones, and choose the track in play.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import hypot, inf, sqrt
from typing import Any

import numpy as np

SCHEMA = (
    "track_id bigint, is_active boolean, x1 double, y1 double, x2 double, y2 double, conf double, speed double, smooth_speed double, "
    "speed_known boolean, in_court boolean, plane_x double, plane_y double, mps double, missed int, age int"
)


@dataclass(frozen=True)
class BallSettings:
    homography: tuple[float, ...]
    court: tuple[tuple[float, float], ...]
    fps: float = 30.0
    size: tuple[int, int] = (1280, 720)
    strict_court: bool = False
    max_missed: int = 10
    max_speed: float = 8000.0
    radius_share: float = 0.04
    size_gate: float = 1.5
    gate_seconds: float = 0.1
    cap_growth: float = 0.15
    second_chance: float = 2.5
    bounce_frames: int = 5
    bounce_cap: float = 3.0
    bounce_speed: float = 200.0
    bounce_curve: float = 0.45
    slow_outside: float = 30.0
    slow_inside: float = 10.0
    near_margin: float = 0.08
    unknown_conf: float = 0.25
    max_tracks: int = 10
    spawn_conf: float = 0.10
    nms: float = 0.7
    block_iou: float = 0.70
    block_share: float = 0.02
    merge_iou: float = 0.80
    merge_share: float = 0.015
    alpha: float = 0.35
    decay: float = 0.95
    max_kmh: float = 300.0
    guard: float = 2.0
    trust_margin: float = 0.05
    max_condition: float = 50.0
    trace: int = 24


Box = tuple[float, float, float, float]
Point = tuple[float, float]


def overlap(a: Box, b: Box) -> float:
    """IoU of two boxes."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = w * h if w > 0 and h > 0 else 0.0
    area = lambda r: max(r[2] - r[0], 0.0) * max(r[3] - r[1], 0.0)
    return shared / max(area(a) + area(b) - shared, 1e-9)


def suppress(boxes: list[tuple], threshold: float) -> list[tuple]:
    """Rows (x1, y1, x2, y2, conf) that greedy suppression keeps, most confident first."""
    kept: list[tuple] = []
    for box in sorted(boxes, key=lambda r: -r[4]):
        if all(overlap(k, box) < threshold for k in kept):
            kept.append(box)
    return kept


def within(x: float, y: float, corners: list[Point], eps: float = 1e-9) -> bool:
    """Even-odd test, edges included."""
    odd, (ax, ay) = False, corners[-1]
    for bx, by in corners:
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        if abs(cross) <= eps and min(ax, bx) - eps <= x <= max(ax, bx) + eps and min(ay, by) - eps <= y <= max(ay, by) + eps:
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
        ax, ay = bx, by
    return odd


def inside(point: np.ndarray, polygon: np.ndarray) -> bool:
    return within(float(point[0]), float(point[1]), polygon.tolist())


def widened(polygon: np.ndarray, margin: float) -> np.ndarray:
    middle = polygon.mean(axis=0)
    return middle + (polygon - middle) * (1 + margin)


def on_plane(h: np.ndarray, p: np.ndarray) -> np.ndarray | None:
    v = h @ np.array([p[0], p[1], 1.0])
    return v[:2] / v[2] if abs(v[2]) >= 1e-9 else None


def middle(box: np.ndarray) -> np.ndarray:
    return (box[:2] + box[2:4]) / 2


def center(box: tuple) -> Point:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def stretch(h: tuple[float, ...], x: float, y: float) -> tuple[float, float]:
    """Smallest and largest stretch of a homography (nine numbers) at a point."""
    u, v, w = h[0] * x + h[1] * y + h[2], h[3] * x + h[4] * y + h[5], h[6] * x + h[7] * y + h[8]
    w = w if abs(w) >= 1e-12 else 1e-12
    a, b, c, d = ((h[i] * w - m * h[6 + j]) / (w * w) for i, j, m in ((0, 0, u), (1, 1, u), (3, 0, v), (4, 1, v)))
    total, area = a * a + b * b + c * c + d * d, abs(a * d - b * c)
    large = sqrt((total + sqrt(max(total * total - 4 * area * area, 0.0))) / 2)
    return (area / large if large > 0 else 0.0), large


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box in a with every box in b."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:4], b[None, :, 2:4])
    shared = np.clip(high - low, 0, None).prod(axis=2)
    area = lambda r: np.clip(r[:, 2:4] - r[:, :2], 0, None).prod(axis=1)
    return shared / np.maximum(area(a)[:, None] + area(b)[None, :] - shared, 1e-9)


def pair_up(cost: np.ndarray) -> list[tuple[int, int]]:
    """match_up of the finite cells of a matrix."""
    rows, cols = np.nonzero(np.isfinite(cost))
    return match_up(list(zip(cost[rows, cols].tolist(), rows.tolist(), cols.tolist(), strict=True)))


def match_up(costs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Of costs (cost, row, column) the pairs that are each other's cheapest first, then the cheapest of the rest, each side once."""
    cheapest_row: dict[int, tuple] = {}
    cheapest_col: dict[int, tuple] = {}
    for one in costs:
        cost, row, col = one
        if row not in cheapest_row or (cost, col) < (cheapest_row[row][0], cheapest_row[row][2]):
            cheapest_row[row] = one
        if col not in cheapest_col or (cost, row) < cheapest_col[col][:2]:
            cheapest_col[col] = one
    chosen, rows, cols = [], set(), set()
    for _, _, row, col in sorted((cheapest_row[one[1]] is not one or cheapest_col[one[2]] is not one, *one) for one in costs):
        if row not in rows and col not in cols:
            chosen.append((row, col))
            rows.add(row)
            cols.add(col)
    return chosen


@dataclass(slots=True)
class Ball:
    id: int
    box: Box
    conf: float
    points: list[Point]
    plane: Point | None
    size: Point
    speed: float = 0.0
    smooth: float = 0.0
    mps: float = 0.0
    smooth_mps: float = 0.0
    missed: int = 0
    age: int = 0
    cooldown: int = 0

    @property
    def known(self) -> bool:
        return len(self.points) >= 2


@dataclass
class BallTracker:
    """A frame has few boxes and few tracks, so plain numbers are faster here than arrays."""

    s: BallSettings
    balls: list[Ball] = field(default_factory=list)
    next_id: int = 1
    active: int | None = None
    seen: list[Point] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.h = tuple(map(float, self.s.homography))
        court = np.array(self.s.court, float)
        as_points = lambda polygon: [tuple(p) for p in polygon.tolist()]
        self.court, self.trust, self.near = (as_points(p) for p in (court, widened(court, self.s.trust_margin), widened(court, self.s.near_margin)))
        self.diagonal = hypot(*self.s.size)
        self.dt = 1.0 / self.s.fps

    def _on_plane(self, p: Point) -> Point | None:
        h, (x, y) = self.h, p
        w = h[6] * x + h[7] * y + h[8]
        return ((h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w) if abs(w) >= 1e-9 else None

    def _found(self, rows: list[Any]) -> list[tuple]:
        width, height = self.s.size[0] - 1, self.s.size[1] - 1
        out = []
        for r in rows:
            if r.conf is None or r.conf != r.conf:
                continue
            x1, y1, x2, y2 = min(max(r.x1, 0), width), min(max(r.y1, 0), height), min(max(r.x2, 0), width), min(max(r.y2, 0), height)
            if x2 > x1 and y2 > y1:
                out.append((float(x1), float(y1), float(x2), float(y2), float(r.conf)))
        return suppress(out, self.s.nms) if len(out) > 1 else out

    def step(self, frame: int, rows: list[Any]) -> list[tuple]:
        s = self.s
        found = self._found(rows)
        placed = [(b, center(b), self._on_plane(center(b))) for b in found]
        placed = [x for x in placed if x[2] is not None and (not s.strict_court or within(*x[2], self.court))]
        for b in self.balls:
            b.cooldown = max(0, b.cooldown - 1)

        old, taken = list(self.balls), {}
        cost, spare, span = self._costs(old, [c for _, c, _ in placed])
        taken.update(match_up(cost))
        for t in range(len(old)):
            if t not in taken:
                options = [(c, d) for c, d in spare[t] if d not in taken.values()]
                if options:
                    taken[t] = min(options)[1]
        for t, b in enumerate(old):
            if t in taken:
                box, point, plane = placed[taken[t]]
                self._follow(b, box, point, plane, span[t])
            else:
                b.missed, b.age = b.missed + 1, b.age + 1
                b.smooth, b.smooth_mps = b.smooth * s.decay, b.smooth_mps * s.decay

        used = set(taken.values())
        self._start([x for d, x in enumerate(placed) if d not in used and x[0][4] >= s.spawn_conf])
        if len(self.balls) > 1:
            self._merge()
        self.balls = [b for b in self.balls if b.missed <= s.max_missed]
        self._choose()
        self.seen = [center(b) for b in found]
        return self._rows()

    def _costs(self, balls: list[Ball], centers: list[Point]) -> tuple[list[tuple], list[list[tuple]], list[float]]:
        """Pairs inside all gates (cost, ball, detection), for each ball those inside the gates of the second chance (cost, detection),
        and seconds since each ball was seen."""
        s, cost, spare, span = self.s, [], [], []
        base = max(8.0, s.radius_share * self.diagonal)
        for i, b in enumerate(balls):
            seconds = (b.missed + 1) * self.dt
            span.append(seconds)
            pace = b.smooth if b.smooth > 0 else self._speed(b)
            radius = min(max(base + s.gate_seconds * pace, s.size_gate * hypot(*b.size), base), 0.25 * self.diagonal)
            cap = s.max_speed * (1 + s.cap_growth * b.missed) * (s.bounce_cap if b.cooldown else 1.0)
            (x, y), wide = b.points[-1], []
            for d, (cx, cy) in enumerate(centers):
                far = hypot(cx - x, cy - y)
                if far > radius:
                    continue
                surprise = abs(far - pace * seconds)
                if far / seconds <= cap:
                    cost.append((surprise, i, d))
                if far / seconds <= cap * s.second_chance:
                    wide.append((surprise, d))
            spare.append(wide)
        return cost, spare, span

    def _speed(self, b: Ball) -> float:
        if not b.known:
            return 0.0
        (ax, ay), (bx, by) = b.points[-2:]
        return hypot(bx - ax, by - ay) / self.dt

    def _follow(self, b: Ball, box: tuple, point: Point, plane: Point, seconds: float) -> None:
        s, before = self.s, b.points[-1]
        b.speed = min(hypot(point[0] - before[0], point[1] - before[1]) / seconds, 3 * s.max_speed)
        b.mps = self._metres(b, before, plane, seconds)
        blend = lambda old, new: new if old <= 0 else (1 - s.alpha) * old + s.alpha * new
        b.smooth, b.smooth_mps = blend(b.smooth, b.speed), blend(b.smooth_mps, b.mps)
        b.points.append(point)
        del b.points[: -s.trace]
        b.size = 0.6 * (box[2] - box[0]) + 0.4 * b.size[0], 0.6 * (box[3] - box[1]) + 0.4 * b.size[1]
        b.box, b.conf, b.plane, b.missed, b.age = box[:4], box[4], plane, 0, b.age + 1
        if self._bounced(b):
            b.cooldown = max(b.cooldown, s.bounce_frames)

    def _metres(self, b: Ball, before: Point, plane: Point, seconds: float) -> float:
        """Speed on the plane if both places can be trusted and the camera's stretch allows it, else the middle of what it allows."""
        s = self.s
        small, large = stretch(self.h, *before)
        low, high, most = small * b.speed, large * b.speed, s.max_kmh / 3.6
        if b.plane is not None:
            moved = hypot(plane[0] - b.plane[0], plane[1] - b.plane[1]) / seconds
            if within(*b.plane, self.trust) and within(*plane, self.trust) and large <= s.max_condition * max(small, 1e-12) and low / s.guard <= moved <= high * s.guard:
                return min(moved, most)
        return min((low + high) / 2, most)

    def _bounced(self, b: Ball) -> bool:
        s, y = self.s, [p[1] for p in b.points[-7:]]
        if len(y) < 3:
            return False
        now, last = (y[-1] - y[-2]) / self.dt, (y[-2] - y[-3]) / self.dt
        curve = (5 * y[0] - 3 * y[2] - 4 * y[3] - 3 * y[4] + 5 * y[6]) / 42 if len(y) == 7 else 0.0
        return (now * last < 0 and min(abs(now), abs(last)) >= s.bounce_speed) or abs(curve) >= s.bounce_curve

    def _start(self, fresh: list[tuple]) -> None:
        """New tracks, the most surprising detections first; a full pool gives up its worst track."""
        if not fresh:
            return
        s, block = self.s, self.s.block_share * self.diagonal
        near = lambda p, others: min((hypot(p[0] - x, p[1] - y) for x, y in others), default=inf)
        ranked, places = [], [center(b.box) for b in self.balls]
        for box, point, plane in fresh:
            gap = near(point, places)
            if gap <= block or any(overlap(box, b.box) >= s.block_iou for b in self.balls):
                continue
            ranked.append((min(gap, near(point, self.seen)), box[4], box, point, plane))
        ranked.sort(key=lambda r: r[:2], reverse=True)
        started = []
        for _, conf, box, point, plane in ranked:
            if len(self.balls) + len(started) >= s.max_tracks:
                if not self.balls:
                    continue
                worst = max(self.balls, key=lambda b: (b.missed, -b.speed, -b.age))
                if near(point, [center(worst.box)]) <= block:
                    continue
                self.balls.remove(worst)
            started.append(Ball(0, box[:4], conf, [point], plane, (box[2] - box[0], box[3] - box[1])))
        for b in started:
            b.id, self.next_id = self.next_id, self.next_id + 1
            self.balls.append(b)

    def _merge(self) -> None:
        s, gone = self.s, set()
        places = [center(b.box) for b in self.balls]
        rank = lambda t: (t.missed, -t.age, -t.conf, -t.speed)
        for i, a in enumerate(self.balls):
            for j in range(i + 1, len(self.balls)):
                b = self.balls[j]
                if a.id in gone or b.id in gone:
                    continue
                gap = hypot(places[i][0] - places[j][0], places[i][1] - places[j][1])
                if gap <= s.merge_share * self.diagonal or overlap(a.box, b.box) >= s.merge_iou:
                    gone.add(b.id if rank(a) < rank(b) else a.id)
        if gone:
            self.balls = [b for b in self.balls if b.id not in gone]

    def _choose(self) -> None:
        """The track in play stays so while it is seen and eligible; then the fastest eligible one; then it is kept unseen."""
        s = self.s
        on_court = {b.id: b.plane is not None and within(*b.plane, self.court) for b in self.balls}
        crowd = sum(on_court.values()) > 1

        def eligible(b: Ball) -> bool:
            if b.known:
                return self._pace(b) >= (s.slow_inside if crowd else 0.0) if on_court[b.id] else self._pace(b) >= s.slow_outside
            return on_court[b.id] or (b.plane is not None and within(*b.plane, self.near) and b.conf >= s.unknown_conf)

        fit = [b for b in self.balls if b.missed == 0 and eligible(b)]
        if any(b.id == self.active for b in fit):
            return
        strong = [b for b in fit if b.known]
        if strong:
            self.active = max(strong, key=self._pace).id
        elif not any(b.id == self.active for b in self.balls):
            self.active = None

    def _pace(self, b: Ball) -> float:
        return self._speed(b) if b.known else b.speed

    def _rows(self) -> list[tuple]:
        rows = [
            (b.id, b.id == self.active, *b.box, b.conf, self._pace(b), b.smooth, b.known, b.plane is not None and within(*b.plane, self.court),
             *(b.plane or (None, None)), b.smooth_mps if b.smooth_mps > 0 else b.mps, b.missed, b.age)
            for b in self.balls
        ]
        return sorted(rows, key=lambda r: (not r[1], -r[7]))
