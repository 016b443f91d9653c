"""Players: association of boxes to tracks, choice of one player for each half of the court, and their labels.

A frame has few boxes, so all is done on plain floats: a numpy call for two boxes costs more than their arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import isfinite
from typing import Any

import numpy as np

from .ball import Box, Point, match_up

SCHEMA = "track_id bigint, x1 double, y1 double, x2 double, y2 double, conf double, u double, v double, score double, label string, position string"


@dataclass(frozen=True)
class PlayerSettings:
    homography: tuple[float, ...]
    height: float = 720.0
    width_m: float = 10.97
    length_m: float = 23.77
    # Association in two rounds (sure boxes, then doubtful ones), after ByteTrack.
    high: float = 0.25
    low: float = 0.1
    buffer: int = 300
    least_iou: float = 0.3
    # Score of a track.
    in_court: float = 2.5
    speed: float = 1.2
    recency: float = 0.8
    camp: float = 1.0
    outside: float = 0.9
    again: float = 0.5
    beta: float = 0.8
    moving: float = 0.08
    still: float = 0.02
    idle: int = 150
    still_frames: int = 60
    full_speed: float = 0.05
    max_absent: int = 45
    soft: float = 0.75
    hard: float = 6.0
    net: float = 1.2
    lateral: float = 1.0
    # Labels.
    swap: float = 18.0
    patience: int = 45


@dataclass
class Player:
    id: int
    box: Box
    drift: Box
    conf: float
    seen: int
    uv: Point | None = None
    scored: int = -1
    pace: float = 0.0
    camping: float = 0.0
    still: int = 0
    moved: int = 0


DROP = -1e6


def _length(x: float, y: float) -> float:
    """The C library's hypot, which numpy has too; math.hypot rounds in its own way."""
    try:
        return abs(complex(x, y))
    except OverflowError:
        return float("inf")


def _number(x: Any) -> float:
    return float("nan") if x is None else float(x)


def _iou(a: Box, b: Box) -> float:
    """IoU of two boxes, NaN if a side of either is."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = (0.0 if w < 0 else w) * (0.0 if h < 0 else h)
    aw, ah, bw, bh = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    both = (0.0 if aw < 0 else aw) * (0.0 if ah < 0 else ah) + (0.0 if bw < 0 else bw) * (0.0 if bh < 0 else bh) - shared
    return shared / (1e-9 if both < 1e-9 else both)


@dataclass
class PlayerTracker:
    s: PlayerSettings
    players: list[Player] = field(default_factory=list)
    next_id: int = 1
    chosen: list[int] = field(default_factory=list)
    named: dict[str, int | None] = field(default_factory=lambda: {"player1": None, "player2": None})
    places: dict[int, tuple[float, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.h = tuple(np.array(self.s.homography, float).ravel().tolist())

    def step(self, frame: int, rows: list[Any]) -> list[tuple]:
        boxes = [tuple(map(_number, (r.x1, r.y1, r.x2, r.y2, r.conf))) for r in rows if r.conf == r.conf and r.conf is not None]
        here = self._associate(frame, boxes)
        scores = {p.id: self._score(frame, p) for p in here}
        best = {}
        for p in sorted(here, key=lambda p: -scores[p.id]):
            if p.uv is not None:
                best.setdefault(bool(p.uv[1] <= self.s.length_m / 2), p)
        picked = [best[half] for half in (True, False) if half in best]
        self.chosen = [p.id for p in picked]
        labels = self._label(frame, picked)
        return [
            (p.id, *p.box, p.conf, *(p.uv if p.uv is not None else (None, None)), scores[p.id], labels[p.id], "top" if labels[p.id] == "player1" else "bottom")
            for p in sorted(picked, key=lambda p: labels[p.id])
        ]

    def _costs(self, frame: int, left: list[Player], some: list[tuple], sure: bool) -> list[tuple[float, int, int]]:
        """(cost, place in left, place in some) of the pairs that overlap enough."""
        least, costs = self.s.least_iou, []
        for i, p in enumerate(left):
            (x1, y1, x2, y2), (dx1, dy1, dx2, dy2), gap = p.box, p.drift, frame - p.seen
            guess = (x1 + dx1 * gap, y1 + dy1 * gap, x2 + dx2 * gap, y2 + dy2 * gap)
            for j, box in enumerate(some):
                # Most boxes lie apart.
                if least > 0 and not (guess[0] < box[2] and box[0] < guess[2] and guess[1] < box[3] and box[1] < guess[3]):
                    continue
                iou = _iou(guess, box)
                if iou >= least:
                    cost = 1 - iou * (box[4] if sure else 1.0)
                    if isfinite(cost):
                        costs.append((cost, i, j))
        return costs

    def _associate(self, frame: int, boxes: list[tuple]) -> list[Player]:
        """Players seen in this frame. Tracks move on at their last drift; sure boxes choose first."""
        s, left, here = self.s, list(self.players), []
        for sure in (True, False):
            some = [b for b in boxes if (b[4] >= s.high) == sure and b[4] >= s.low]
            if not some:
                continue
            if not sure:
                left = [p for p in left if p.seen == frame - 1]
            pairs = match_up(self._costs(frame, left, some, sure))
            for i, j in pairs:
                p, box = left[i], some[j][:4]
                n = max(1, frame - p.seen)
                p.drift = tuple([0.5 * d + 0.5 * (to - at) / n for d, to, at in zip(p.drift, box, p.box, strict=True)])
                p.box, p.conf, p.seen = box, some[j][4], frame
                here.append(p)
            taken, matched = {i for i, _ in pairs}, {j for _, j in pairs}
            left = [p for i, p in enumerate(left) if i not in taken]
            if sure:
                for j, box in enumerate(some):
                    if j not in matched:
                        here.append(Player(self.next_id, box[:4], (0.0, 0.0, 0.0, 0.0), box[4], frame, moved=frame))
                        self.players.append(here[-1])
                        self.next_id += 1
        self.players = [p for p in self.players if frame - p.seen <= s.buffer]
        return here

    def _on_plane(self, x: float, y: float) -> Point | None:
        h = self.h
        w = h[6] * x + h[7] * y + h[8]
        return ((h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w) if abs(w) >= 1e-9 else None

    def _score(self, frame: int, p: Player) -> float:
        s = self.s
        uv = self._on_plane((p.box[0] + p.box[2]) / 2, p.box[3])
        if uv is None:
            return DROP
        step = _length(uv[0] - p.uv[0], uv[1] - p.uv[1]) if p.uv is not None else 0.0
        court = 0 <= uv[0] <= s.width_m and 0 <= uv[1] <= s.length_m
        net = abs(uv[1] - s.length_m / 2) <= s.net and -s.lateral <= uv[0] <= s.width_m + s.lateral
        before, p.uv, p.scored = p.scored, uv, frame
        p.pace = s.beta * p.pace + (1 - s.beta) * step
        p.camping = 0.9 * p.camping + 0.1 * net
        p.still = p.still + 1 if net and step <= s.still else 0
        p.moved = frame if step >= s.moving else p.moved
        out = _length(max(-s.soft - uv[0], uv[0] - s.width_m - s.soft, 0), max(-s.soft - uv[1], uv[1] - s.length_m - s.soft, 0))
        if out >= s.hard or p.still >= s.still_frames:
            return DROP
        if frame - p.moved > s.idle:
            return -1e4 if court else DROP
        gap = frame - before
        recency = 1.0 if before < 0 or gap <= 1 else float(np.exp(-gap / 30))
        fast = min(1.0, p.pace / (s.full_speed * s.length_m))
        return s.in_court * court + s.speed * fast + s.recency * recency - s.camp * p.camping - s.outside * out + s.again * (p.id in self.chosen)

    def _label(self, frame: int, picked: list[Player]) -> dict[int, str]:
        """player1 is the upper one; two that are nearly level keep their labels, and one alone keeps or takes over a label."""
        s, level = self.s, {p.id: float(p.box[1] + p.box[3]) / 2 for p in picked}
        self.places = {i: v for i, v in self.places.items() if frame - v[1] <= s.patience} | {i: (y, frame) for i, y in level.items()}
        if len(picked) == 2:
            upper, lower = sorted(level, key=level.get)
            close = level[lower] - level[upper] < s.swap * s.height / 1080
            if close and {upper, lower} == set(self.named.values()):
                upper, lower = self.named["player1"], self.named["player2"]
            self.named = {"player1": upper, "player2": lower}
        elif picked:
            only = picked[0].id
            label = next((n for n, i in self.named.items() if i == only), None)
            if label is None:
                near = [(abs(level[only] - self.places[i][0]), n) for n, i in self.named.items() if i in self.places]
                label = min(near)[1] if near else "player1" if level[only] <= s.height / 2 else "player2"
            self.named[label] = only
        return {i: n for n, i in self.named.items() if i in level}
