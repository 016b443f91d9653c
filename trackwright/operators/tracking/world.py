"""Positions and speeds of tracks in metres."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np

from .ball import on_plane

SCHEMA = (
    "kind string, track_id bigint, x_m double, y_m double, x_smooth_m double, y_smooth_m double, vx double, vy double, "
    "mps double, kmh double, mph double, samples int, rejected boolean"
)


@dataclass(frozen=True)
class WorldSettings:
    homography: tuple[float, ...]
    fps: float = 30.0
    bottom: bool = False
    hampel_least: int = 7
    hampel_k: float = 3.0
    max_jump: float | None = None
    position_alpha: float | None = 0.35
    window: int = 7
    least: int = 2
    weight: float = 0.7
    max_mps: float | None = 200 / 3.6
    speed_alpha: float | None = 1.0
    purge: int = 60
    #: Steps of the clock for each frame. 2 gives the speeds of a converter whose clock ball and player rows advance in turn.
    ticks: int = 1


@dataclass
class Path:
    last: np.ndarray
    smooth: np.ndarray
    seen: int
    steps: list[float] = field(default_factory=list)
    history: list[tuple[float, float, float]] = field(default_factory=list)
    mps: float | None = None


@dataclass
class WorldSpeed:
    """Rows need kind, track_id and a box; ball and player tracks may share ids."""

    s: WorldSettings
    paths: dict[tuple[str, int], Path] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.h = np.array(self.s.homography, float).reshape(3, 3)

    def step(self, frame: int, rows: list[Any]) -> list[tuple]:
        s = self.s
        self.paths = {k: p for k, p in self.paths.items() if (frame - p.seen) * s.ticks <= s.purge}
        return [self._one(frame, r) for r in rows if r.track_id == r.track_id and r.track_id is not None]

    def _one(self, frame: int, r: Any) -> tuple:
        s, key = self.s, (r.kind, int(r.track_id))
        at = on_plane(self.h, np.array([(r.x1 + r.x2) / 2, r.y2 if s.bottom else (r.y1 + r.y2) / 2]))
        if at is None:
            return (*key, *[None] * 9, 0, False)
        path, rejected = self.paths.get(key), False
        if path is None:
            path = self.paths[key] = Path(at, at, frame)
        else:
            step = float(np.hypot(*(at - path.last)))
            path.steps = [*path.steps, step][-24:]
            far = s.max_jump is not None and step > s.max_jump
            if len(path.steps) >= s.hampel_least:
                middle = np.median(path.steps)
                far |= step > middle + s.hampel_k * (1.4826 * np.median(np.abs(path.steps - middle)) + 1e-9)
            rejected = bool(far)
            path.last = path.last if rejected else at
            path.smooth = at if s.position_alpha is None else (1 - s.position_alpha) * path.smooth + s.position_alpha * at
        path.seen = frame
        if not rejected:
            path.history = [*path.history, (frame * s.ticks / s.fps, *map(float, path.smooth))][-max(32, 3 * s.window) :]
        velocity, samples = self._velocity(path)
        mps = float(np.hypot(*velocity)) if velocity is not None else None
        if mps is not None and s.max_mps is not None and mps > s.max_mps:
            velocity, mps = None, None
        if mps is not None and s.speed_alpha is not None:
            path.mps = (1 - s.speed_alpha) * (path.mps or 0.0) + s.speed_alpha * mps
            mps = path.mps
        vx, vy = map(float, velocity) if velocity is not None else (None, None)
        kmh, mph = (mps * 3.6, mps * 2.2369362920544) if mps is not None else (None, None)
        return (*key, float(at[0]), float(at[1]), float(path.smooth[0]), float(path.smooth[1]), vx, vy, mps, kmh, mph, samples, rejected)

    def _velocity(self, path: Path) -> tuple[np.ndarray | None, int]:
        """Slope of the last samples by least squares; a sample of age n weighs weight ** (2 n)."""
        recent = np.array(path.history[-self.s.window :]).reshape(-1, 3)
        if len(recent) < self.s.least or recent[-1, 0] - recent[0, 0] <= 1e-6:
            return None, 0
        w = self.s.weight ** (2.0 * np.arange(len(recent))[::-1])
        t = recent[:, 0] - w @ recent[:, 0] / w.sum()
        return (w * t) @ recent[:, 1:] / ((w * t) @ t), len(recent)
