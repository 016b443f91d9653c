"""Ball flight: places in space from one camera, and launch speed and angle from a flight's time and length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import Point

#: Gravity, air density, and a ball's mass, diameter and drag coefficient (SI units).
GRAVITY, AIR, MASS, DIAMETER, DRAG = 9.81, 1.225, 0.057, 0.067, 0.55
_PULL = 0.5 * DRAG * AIR * np.pi * (DIAMETER / 2) ** 2 / MASS


def ball_height(y: Column, image_height: float = 1080.0) -> Column:
    """Rough height in metres: twice the distance from the image's middle line in half images, and 0.1 at least."""
    return F.greatest(F.lit(0.1), F.abs((y - image_height / 2) / (image_height / 2)) * 2.0)


def ray_at_height(p: Point, camera: list[list[float]], rotation: list[list[float]], shift: list[float], height: Column) -> tuple[Column, Column, Column]:
    """Where the ray through a pixel of an undistorted camera has a given height; null for level rays."""
    k, r, t = np.array(camera), np.array(rotation), np.array(shift)
    position = -r.T @ t
    u, v = (p[0] - k[0, 2]) / k[0, 0], (p[1] - k[1, 2]) / k[1, 1]
    norm = F.sqrt(u * u + v * v + 1)
    ray = [(float(r[0, i]) * u + float(r[1, i]) * v + float(r[2, i])) / norm for i in range(3)]
    along = F.when(F.abs(ray[2]) >= 1e-6, (height - float(position[2])) / ray[2])
    return tuple(float(position[i]) + along * ray[i] for i in range(3))


def landing(speed: np.ndarray, angle: np.ndarray, height: np.ndarray, step: float = 1e-3, most: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Time and distance of landing for many throws at once, with quadratic drag (fourth-order Runge-Kutta)."""
    state = np.stack([np.zeros_like(speed), height, speed * np.cos(angle), speed * np.sin(angle)])
    time, far = np.full(len(speed), most), np.zeros(len(speed))
    # Those that have landed are left behind from time to time; at holds the numbers of the rest.
    at, flying = np.arange(len(speed)), np.ones(len(speed), bool)

    def slope(s: np.ndarray) -> np.ndarray:
        pull = _PULL * np.hypot(s[2], s[3])
        return np.stack([s[2], s[3], -pull * s[2], -GRAVITY - pull * s[3]])

    for i in range(int(round(most / step))):
        k1 = slope(state)
        k2 = slope(state + step / 2 * k1)
        k3 = slope(state + step / 2 * k2)
        after = state + step / 6 * (k1 + 2 * k2 + 2 * k3 + slope(state + step * k3))
        down = flying & (after[1] <= 0)
        part = np.where(down, state[1] / np.where(down, state[1] - after[1], 1.0), 1.0)
        time[at[down]], far[at[down]] = (i + part[down]) * step, (state[0] + part * (after[0] - state[0]))[down]
        state, flying = after, flying & ~down
        left = np.count_nonzero(flying)
        if not left:
            break
        if left < 0.9 * len(at):
            state, at, flying = np.ascontiguousarray(state[:, flying]), at[flying], np.ones(left, bool)
    far[at[flying]] = state[0][flying]
    return time, far


def launch(height: np.ndarray, seconds: np.ndarray, distance: np.ndarray, rounds: int = 100, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Speed and angle (degrees) that land at a given time and distance: damped Newton steps for all rows together.

    A row is done when it misses by at most tolerance (seconds and metres); NaN where that is not so after all rounds.
    """
    speed, angle = distance / np.maximum(seconds, 1e-6) * 1.2, np.full(len(height), np.radians(10.0))
    done = np.zeros(len(height), bool)
    todo = np.flatnonzero(np.isfinite(height) & np.isfinite(seconds) & np.isfinite(distance))
    most = float(np.clip(2 * seconds[todo].max(initial=0.0), 5.0, 60.0))
    miss = lambda i, v, a: np.stack(landing(v, a, height[i], 4e-3, most)) - np.stack([seconds[i], distance[i]])
    for k in range(rounds + 1):
        if not len(todo):
            break
        now = miss(todo, speed[todo], angle[todo])
        hit = (np.abs(now) <= tolerance).all(axis=0)
        done[todo[hit]] = True
        todo, now = todo[~hit], now[:, ~hit]
        if k == rounds or not len(todo):
            break
        v, a = speed[todo], angle[todo]
        by_speed, by_angle = (miss(todo, v + 1e-3, a) - now) / 1e-3, (miss(todo, v, a + 1e-4) - now) / 1e-4
        det = by_speed[0] * by_angle[1] - by_angle[0] * by_speed[1]
        det = np.where(np.abs(det) < 1e-9, 1e-9, det)
        dv, da = (by_angle[1] * now[0] - by_angle[0] * now[1]) / det, (by_speed[0] * now[1] - by_speed[1] * now[0]) / det
        speed[todo], angle[todo] = np.clip(v - np.clip(dv, -5, 5), 0, 100), np.clip(a - np.clip(da, -0.1, 0.1), 0, np.pi / 2)
    return np.where(done, speed, np.nan), np.where(done, np.degrees(angle), np.nan)


def launches(flights: DataFrame, height: str, seconds: str, distance: str) -> DataFrame:
    """flights with speed_mps and angle_deg, null where no launch was found.

    The solve is long and the rows are short, so each different flight is solved once, and they are dealt over all cores."""
    keys = ["__height", "__seconds", "__distance"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            speed, angle = launch(*(batch[c].to_numpy(float) for c in keys))
            yield batch.assign(speed_mps=speed, angle_deg=angle)

    keyed = flights.withColumns({k: F.col(c).cast("double") for k, c in zip(keys, (height, seconds, distance), strict=True)})
    each = keyed.select(*keys).na.drop().distinct().repartition(4 * flights.sparkSession.sparkContext.defaultParallelism, *keys)
    solved = each.mapInPandas(run, ", ".join(f"{c} double" for c in keys) + ", speed_mps double, angle_deg double")
    return keyed.join(solved, keys, "left").drop(*keys)


#: Order of a line detector's 14 points (outer corners, inner corners, service corners, service middles), seen from
#: one side of the court and from the other.
NEAR_SIDE = [0, 3, 8, 11, 1, 9, 2, 10, 4, 5, 6, 7, 12, 13]
FAR_SIDE = [8, 11, 0, 3, 9, 1, 10, 2, 6, 7, 4, 5, 13, 12]


def reordered_keypoints(points: Column) -> Column:
    """An array of 14 points (x, y) in the template's order."""
    pick = lambda order: F.transform(F.array(*map(F.lit, order)), lambda i: F.get(points, i))
    return F.when(points[0]["y"] > points[11]["y"], pick(FAR_SIDE)).otherwise(pick(NEAR_SIDE))
