"""Cameras from four court corners: a rough matrix as columns, and the pose that fits the corners best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import homography
from .geometry import Point

#: The court's corners in metres, in the order top-left, top-right, bottom-right, bottom-left.
CORNERS = np.array([(0.0, 0.0), (10.97, 0.0), (10.97, 23.77), (0.0, 23.77)])


def matrix_of(corners: list[Point], least_focal: float = 1000.0) -> tuple[Column, Column, Column]:
    """Focal length (the corners' longer extent, least_focal or more) and centre (their mean)."""
    xs, ys = zip(*corners, strict=True)
    extent = lambda v: F.greatest(*v) - F.least(*v)
    mean = lambda v: sum(v[1:], v[0]) / len(v)
    return F.greatest(extent(xs), extent(ys), F.lit(least_focal)), mean(xs), mean(ys)


def _turn(v: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector."""
    angle = float(np.linalg.norm(v))
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = v / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def _seen(turn: np.ndarray, shift: np.ndarray, plane: np.ndarray) -> np.ndarray:
    at = plane @ turn[:, :2].T + shift
    return at[:, :2] / at[:, 2:]


def solve_pose(pixels: np.ndarray, focal: float, middle: np.ndarray, plane: np.ndarray = CORNERS, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Rotation, translation and root mean square error in pixels of a camera that sees plane (z = 0) at pixels.

    Starts from the homography's columns, made orthogonal, and improves by Gauss-Newton steps. None without a homography.
    """
    target = (pixels - middle) / focal
    h = homography.fit(plane, target)
    if h is None:
        return None
    h = h / np.sqrt(np.linalg.norm(h[:, 0]) * np.linalg.norm(h[:, 1]))
    h = h if h[2, 2] > 0 else -h
    u, _, v = np.linalg.svd(np.column_stack([h[:, 0], h[:, 1], np.cross(h[:, 0], h[:, 1])]))
    turn, shift = u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v, h[:, 2]
    miss = lambda a, b: (_seen(a, b, plane) - target).ravel()
    error = miss(turn, shift)
    for _ in range(rounds):
        change = np.empty((len(error), 6))
        for j in range(6):
            d = np.eye(6)[j] * 1e-6
            change[:, j] = (miss(_turn(d[:3]) @ turn, shift + d[3:]) - error) / 1e-6
        step = -np.linalg.lstsq(change, error, rcond=None)[0]
        after = _turn(step[:3]) @ turn, shift + step[3:]
        better = miss(*after)
        if not (better @ better < error @ error):
            break
        (turn, shift), error = after, better
    return turn, shift, float(np.sqrt((error @ error) / len(plane)) * focal)


def camera_poses(corners: DataFrame, key: str) -> DataFrame:
    """key, turn (nine numbers), shift (three) and error in pixels, from rows with focal, cx, cy and x0, y0 .. x3, y3."""
    names = [f"{c}{i}" for i in range(4) for c in "xy"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                found = solve_pose(np.array([getattr(row, n) for n in names], float).reshape(4, 2), row.focal, np.array([row.cx, row.cy]))
                turn, shift, error = found or (None, None, None)
                rows.append((getattr(row, key), None if turn is None else turn.ravel().tolist(), None if shift is None else shift.tolist(), error))
            yield pd.DataFrame(rows, columns=[key, "turn", "shift", "error"])

    kind = corners.schema[key].dataType.simpleString()
    return corners.select(key, "focal", "cx", "cy", *names).mapInPandas(run, f"{key} {kind}, turn array<double>, shift array<double>, error double")
