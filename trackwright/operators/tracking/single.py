"""One ball at a time: follows the nearest fast detection, but changes to a clearly faster one anywhere; and clean-up of a ball path."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np

from .ball import inside, middle, on_plane, widened

SCHEMA = (
    "track_id bigint, x1 double, y1 double, x2 double, y2 double, conf double, speed double, plane_x double, plane_y double, "
    "missed int, still boolean, on_floor boolean"
)


@dataclass(frozen=True)
class SingleSettings:
    homography: tuple[float, ...]
    court: tuple[tuple[float, float], ...]
    fps: float = 30.0
    size: tuple[int, int] = (1280, 720)
    court_margin: float = 0.05
    max_missed: int = 12
    max_speed: float = 3000.0
    radius_share: float = 0.02
    match_share: float = 0.06
    still_frames: int = 6
    still_speed: float = 20.0
    rolling_speed: float = 120.0
    curve: float = 0.45
    floor_seconds: float = 1.0
    decay: float = 0.90
    slow_outside: float = 40.0
    slow_inside: float = 12.0
    faster_by: float = 0.15


@dataclass
class SingleTracker:
    s: SingleSettings
    id: int = 0
    points: list[np.ndarray] = field(default_factory=list)
    box: np.ndarray | None = None
    conf: float = 0.0
    plane: np.ndarray | None = None
    missed: int = 0
    still: int = 0
    floor: int = 0
    age: int = 0
    before: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))

    def __post_init__(self) -> None:
        self.h = np.array(self.s.homography, float).reshape(3, 3)
        self.court = widened(np.array(self.s.court, float), self.s.court_margin)
        self.diagonal = float(np.hypot(*self.s.size))

    def step(self, frame: int, rows: list[Any]) -> list[tuple]:
        s = self.s
        boxes = np.array([(r.x1, r.y1, r.x2, r.y2, r.conf) for r in rows if r.conf == r.conf and r.conf is not None], float).reshape(-1, 5)
        centers = (boxes[:, :2] + boxes[:, 2:4]) / 2
        planes = [on_plane(self.h, c) for c in centers]
        on_court = np.array([p is not None and inside(p, self.court) for p in planes], bool)
        usable = np.array([p is not None for p in planes], bool)
        # A detection's own speed: to the nearest one of the frame before, where that is near enough.
        far = np.hypot(*(centers[:, None] - self.before[None]).transpose(2, 0, 1)) if len(self.before) and len(centers) else np.full((len(centers), 1), np.inf)
        near = far.min(axis=1) if len(centers) else np.zeros(0)
        speeds = np.where(near <= s.match_share * self.diagonal, near * s.fps, 0.0)
        lively = usable & (speeds >= np.where(on_court, s.slow_inside, s.slow_outside))
        fastest = int(np.where(lively, speeds, -1).argmax()) if lively.any() else None

        chosen = None
        if self.box is None:
            chosen = fastest
        else:
            chosen = self._nearby(boxes, centers, on_court, usable)
            own = speeds[chosen] if chosen is not None else self._speed()
            if fastest is not None and speeds[fastest] > (1 + s.faster_by) * max(own, 1e-6):
                chosen = fastest
        self._move(boxes, centers, planes, chosen)
        self.before = centers
        return self._rows()

    def _nearby(self, boxes: np.ndarray, centers: np.ndarray, on_court: np.ndarray, usable: np.ndarray) -> int | None:
        """Among detections inside the growing search radius the one that implies the highest speed, then the surest."""
        s = self.s
        base = s.radius_share * self.diagonal
        radius = float(np.clip(base * (1 + 0.002 * self._speed()) * (1 + 0.3 * self.missed), base, 0.25 * self.diagonal))
        far = np.hypot(*(centers - self.points[-1]).T) if len(centers) else np.zeros(0)
        speed = far * s.fps
        fit = usable & (far <= radius) & (speed <= s.max_speed * (1 + 0.15 * self.missed)) & (speed >= np.where(on_court, s.slow_inside, s.slow_outside))
        return min(np.flatnonzero(fit), key=lambda i: (-round(speed[i], 6), -boxes[i, 4], far[i])) if fit.any() else None

    def _move(self, boxes: np.ndarray, centers: np.ndarray, planes: list, chosen: int | None) -> None:
        s = self.s
        if chosen is not None:
            if self.box is None:
                self.id, self.points, self.still, self.floor, self.age = self.id + 1, [], 0, 0, 0
            self.box, self.conf, self.plane, self.missed = boxes[chosen, :4], float(boxes[chosen, 4]), planes[chosen], 0
            self.points = [*self.points, centers[chosen]][-24:]
        elif self.box is not None:
            self.missed += 1
        if self.box is None:
            return
        self.age += 1
        speed, curve = self._speed(), self._curve()
        self.still = self.still + 1 if abs(curve) < s.curve and len(self.points) > 1 and speed < s.still_speed else 0
        self.floor = self.floor + 1 if speed < s.rolling_speed and abs(curve) < s.curve else max(0, self.floor - 1)
        if self.missed > s.max_missed:
            self.box = None

    def _speed(self) -> float:
        return float(np.hypot(*(self.points[-1] - self.points[-2]))) * self.s.fps if len(self.points) > 1 else 0.0

    def _curve(self) -> float:
        y = np.array([p[1] for p in self.points[-7:]])
        return float(y @ np.array([5, 0, -3, -4, -3, 0, 5])) / 42 if len(y) == 7 else 0.0

    def _rows(self) -> list[tuple]:
        s = self.s
        if self.box is None:
            return []
        low = s.slow_inside if self.plane is not None and inside(self.plane, self.court) else s.slow_outside
        if self._speed() < low or middle(self.box)[0] != middle(self.box)[0]:
            return []
        conf = self.conf * s.decay**self.missed
        penalty = self.floor >= s.floor_seconds * s.fps
        return [(self.id, *map(float, self.box), conf, self._speed(), *map(float, self.plane), self.missed, self.still >= max(1, s.still_frames // 2), penalty)]


CLAMP_SCHEMA = "x double, y double"


@dataclass
class ClampSteps:
    """Limits how far a point (x, y between 0 and 1) moves in a frame, measured from the already limited point before.

    A frame is left alone if it or the frame before had no step of its own (raw is null there).
    """

    most: float = 0.1
    last: np.ndarray | None = None
    had_step: bool = False

    def step(self, frame: int, rows: list[Any]) -> list[tuple]:
        r = rows[0]
        at, has_step = np.array([r.x, r.y], float), r.raw == r.raw and r.raw is not None
        if self.last is not None and has_step and self.had_step:
            move = at - self.last
            at = np.where(np.abs(move) > self.most, self.last + np.sign(move) * self.most, at)
        self.last, self.had_step = at, has_step
        return [(float(at[0]), float(at[1]))]
