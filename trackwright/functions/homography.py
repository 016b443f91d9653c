"""Homography estimates. A fit is a handful of points, so it runs in numpy inside tasks, for many steps at once; applying one is a Column
expression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The 14 points of the court template in pixels of the reference drawing (baselines, inner sidelines, service
#: lines, their middles) by place, and 12 choices of four points from which a homography is fitted.
TEMPLATE = np.array([
    (286, 561), (1379, 561), (286, 2935), (1379, 2935), (423, 561), (423, 2935), (1242, 561), (1242, 2935),
    (423, 1110), (1242, 1110), (423, 2386), (1242, 2386), (832, 1110), (832, 2386),
], float)
CHOICES = (
    (0, 1, 2, 3), (4, 6, 5, 7), (4, 1, 5, 3), (0, 6, 2, 7), (8, 9, 10, 11), (8, 9, 5, 7),
    (4, 6, 10, 11), (6, 1, 7, 3), (0, 4, 2, 5), (8, 12, 10, 13), (12, 9, 13, 11), (10, 11, 5, 7),
)


def fit(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """Least-squares homography from normalised points; None if there are fewer than four or they do not span a plane."""
    if len(source) < 4:
        return None
    h = fits(source, target[None])[0]
    return None if np.isnan(h).any() else h


def fits(source: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """k x 3 x 3: fit of the same points (n x 2, four or more) to k sets of points (k x n x 2); NaN where these do not span a plane."""

    def normal(p: np.ndarray) -> np.ndarray:
        middle = p.mean(axis=1)
        spread = np.hypot(*np.moveaxis(p - middle[:, None], -1, 0)).mean(axis=1)
        with np.errstate(divide="ignore"):
            k = np.where(spread > 0, np.sqrt(2) / spread, 1.0)
        to = np.zeros((len(p), 3, 3))
        to[:, 0, 0], to[:, 1, 1], to[:, 2, 2] = k, k, 1.0
        to[:, 0, 2], to[:, 1, 2] = -k * middle[:, 0], -k * middle[:, 1]
        return to

    a, b = normal(source[None]), normal(targets)
    p, q = projections(a, source[None]), projections(b, targets)
    left = np.broadcast_to(np.concatenate([p, np.ones((1, p.shape[1], 1))], axis=2), (len(q), p.shape[1], 3))
    zero = np.zeros_like(left)
    rows = np.concatenate([np.concatenate([left, zero, -q[..., :1] * left], axis=2), np.concatenate([zero, left, -q[..., 1:] * left], axis=2)], axis=1)
    good = np.isfinite(rows).all(axis=(1, 2))
    _, sizes, v = np.linalg.svd(np.where(good[:, None, None], rows, 0.0))
    good &= sizes[:, 7] >= 1e-9 * sizes[:, 0]
    h = np.linalg.inv(np.where(good[:, None, None], b, np.eye(3))) @ v[:, -1].reshape(-1, 3, 3) @ a
    last = h[:, 2:, 2:]
    h = h / np.where(np.abs(last) > 1e-12, last, 1.0)
    h[~good] = np.nan
    return h


def projections(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """project for k homographies (or one) and k sets of points (or one)."""
    v = np.concatenate([points, np.ones((*points.shape[:2], 1))], axis=2) @ np.swapaxes(h, 1, 2)
    with np.errstate(all="ignore"):
        return v[..., :2] / v[..., 2:]


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    v = np.column_stack([points, np.ones(len(points))]) @ h.T
    return v[:, :2] / v[:, 2:]


def valid(h: np.ndarray | None, least_det: float = 1e-12) -> bool:
    return h is not None and h.shape == (3, 3) and bool(np.isfinite(h).all()) and abs(np.linalg.det(h)) >= least_det


def best_of_choices(points: np.ndarray) -> tuple[np.ndarray | None, float]:
    """The homography from the template whose other points (of the first 12) fall nearest; points may hold NaN."""
    h, error = best_of_each(points[None])
    return (h[0], float(error[0])) if np.isfinite(error[0]) else (None, np.inf)


def best_of_each(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best_of_choices for k sets of points (k x 14 x 2): homographies, and errors that are infinite where there is none."""
    best, least = np.full((len(points), 3, 3), np.nan), np.full(len(points), np.inf)
    known = ~np.isnan(points).any(axis=2)
    for choice in CHOICES:
        four, rest = list(choice), [i for i in range(12) if i not in choice]
        able = np.flatnonzero(known[:, four].all(axis=1) & known[:, rest].any(axis=1))
        if not len(able):
            continue
        h = fits(TEMPLATE[four], points[able][:, four])
        apart = projections(h, TEMPLATE[rest][None]) - points[able][:, rest]
        here = known[able][:, rest]
        error = np.where(here, np.hypot(apart[..., 0], apart[..., 1]), 0.0).sum(axis=1) / here.sum(axis=1)
        better = error < least[able]
        best[able[better]], least[able[better]] = h[better], error[better]
    return best, least


def court_homographies(keypoints: DataFrame) -> DataFrame:
    """video_id, step_idx, h (nine numbers, row by row) and error from keypoints (video_id, step_idx, point, x, y)."""
    kind = keypoints.schema["video_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = np.full((len(batch), 14, 2), np.nan)
            step = np.repeat(np.arange(len(batch)), batch["point"].map(len).to_numpy(int))
            for axis, c in enumerate(("x", "y")):
                if len(batch):
                    points[step, np.concatenate(batch["point"].to_list()), axis] = np.concatenate(batch[c].to_list())
            h, error = best_of_each(points)
            found = np.isfinite(error)
            out = batch[["video_id", "step_idx"]].copy()
            out["h"] = [x.ravel().tolist() if ok else None for x, ok in zip(h, found, strict=True)]
            out["error"] = np.where(found, error, np.nan)
            yield out

    picked = keypoints.where("x is not null and y is not null").groupBy("video_id", "step_idx").agg(F.collect_list(F.struct("point", "x", "y")).alias("p"))
    steps = picked.select("video_id", "step_idx", "p.point", F.col("p.x").cast("array<double>").alias("x"), F.col("p.y").cast("array<double>").alias("y"))
    return steps.mapInPandas(run, f"video_id {kind}, step_idx int, h array<double>, error double")
