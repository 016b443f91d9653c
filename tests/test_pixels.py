"""Pooling along lines against a plain loop; matching of pixels against all one-to-one matchings."""

import itertools
import math
import random

import pytest

from trackwright.operators import grids, pixels
from trackwright.operators import heatmaps as hm


def pooled_by_loop(grid, line, points, pools):
    """grid: rows of values."""
    rows, cols = len(grid), len(grid[0])
    x1, y1, x2, y2 = line
    out = []
    for k in range(points):
        t = k / (points - 1)
        y, x = y1 * t + y2 * (1 - t) - 0.5, x1 * t + x2 * (1 - t) - 0.5
        r0, c0 = min(max(math.floor(y), 0), rows - 1), min(max(math.floor(x), 0), cols - 1)
        r1, c1 = min(r0 + 1, rows - 1), min(c0 + 1, cols - 1)
        top = grid[r0][c0] * (c1 - x) + grid[r0][c1] * (x - c0)
        bottom = grid[r1][c0] * (c1 - x) + grid[r1][c1] * (x - c0)
        out.append(top * (r1 - y) + bottom * (y - r0))
    size = points // pools
    return [max(out[i * size : (i + 1) * size]) for i in range(pools)]


def test_pooling_against_a_loop(spark):
    rnd = random.Random(5)
    grids_of = {i: [[rnd.random() for _ in range(9)] for _ in range(6)] for i in range(3)}
    cells = spark.createDataFrame([(i, r, c, v, -v) for i, g in grids_of.items() for r, row in enumerate(g) for c, v in enumerate(row)], "image long, row int, col int, u double, w double")
    # Ends at all edges, beyond them, and both in one place.
    made = [(i, 0, n, rnd.uniform(-0.5, 9.5), rnd.uniform(-0.5, 6.5), rnd.uniform(0, 9), rnd.uniform(0, 6)) for i in range(3) for n in range(1, 8)]
    made += [(0, 1, 2, 0.0, 0.0, 9.0, 6.0), (0, 1, 3, 8.5, 5.5, 8.5, 5.5), (0, 1, 4, 2.5, 2.5, 2.5, 2.5)]
    lines = spark.createDataFrame(made, "image long, a long, b long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.image, r.a, r.b): list(r.pooled) for r in hm.pooled_lines(cells, lines, ["u", "w"], 6, 9, 12, 3).collect()}
    assert len(got) == len(made)
    for i, a, b, *ends in made:
        down = [[-v for v in row] for row in grids_of[i]]
        assert got[i, a, b] == pytest.approx(pooled_by_loop(grids_of[i], ends, 12, 3) + pooled_by_loop(down, ends, 12, 3))


def test_missing_cells_count_as_nothing(spark):
    cells = spark.createDataFrame([(1, 2, 2, 4.0), (1, 2, 3, None)], "image long, row int, col int, u double")
    lines = spark.createDataFrame([(1, 0, 1, 2.5, 2.5, 4.5, 2.5), (2, 0, 1, 1.0, 1.0, 2.0, 2.0)], "image long, a long, b long, x1 double, y1 double, x2 double, y2 double")
    got = {r.image: list(r.pooled) for r in hm.pooled_lines(cells, lines, ["u"], 8, 8, 4, 2).collect()}
    assert got == {1: pytest.approx([4 / 3 * 0, 4.0]), 2: [0.0, 0.0]}


def test_scores_ranks_and_padding(spark):
    rows = [(1, 0, b, [v, 0.0]) for b, v in enumerate([3.0, 1.0, -1.0, 2.0, 2.0], 1)] + [(2, 0, 1, [-5.0, 0.0])]
    ranked = hm.scored_lines(spark.createDataFrame(rows, "image long, a long, b long, pooled array<double>"), [1.0, 1.0], 0.0)
    assert [(r.image, r.b, r["rank"]) for r in ranked.orderBy("image", "rank").collect()] == [(1, 1, 1), (1, 4, 2), (1, 5, 3), (1, 2, 4)]
    padded = hm.padded_lines(ranked, 10)
    assert [r.b for r in padded.orderBy("idx").collect()] == [1, 4, 5, 2, 1, 4, 5, 2, 1, 4]
    assert [r.b for r in grids.trim_repeats(padded, ["a", "b"]).orderBy("idx").collect()] == [1, 4, 5, 2]
    assert [r.b for r in hm.padded_lines(ranked, 2).orderBy("idx").collect()] == [1, 4]


def largest(left, right, radius):
    """Size of the largest one-to-one matching, by trying all."""
    for n in range(min(len(left), len(right)), 0, -1):
        for some in itertools.combinations(left, n):
            if any(all(math.dist(p, q) <= radius for p, q in zip(some, others, strict=True)) for others in itertools.permutations(right, n)):
                return n
    return 0


@pytest.mark.parametrize("seed", range(12))
def test_gains_against_all_matchings(seed):
    rnd = random.Random(seed)
    left = rnd.sample([(r, c) for r in range(4) for c in range(3)], 6)
    right = rnd.sample([(r, c) for r in range(4) for c in range(3)], rnd.randrange(0, 6))
    near = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if math.hypot(r, c) <= 1]
    got = list(itertools.accumulate(pixels.gains(left, set(right), near)))
    assert got == [largest(left[: n + 1], right, 1) for n in range(len(left))]


def test_a_long_row_is_matched_by_a_chain(spark):
    # Each true pixel stands one to the right; the last predicted one finds its place only if all move over.
    n = 3000
    near = [(0, 0), (0, 1), (0, -1)]
    assert sum(pixels.gains([(0, c) for c in range(n)], {(0, c + 1) for c in range(n)}, near)) == n
    assert sum(pixels.gains([(0, c) for c in range(n)] + [(1, c) for c in range(n)], {(0, c) for c in range(n)}, [*near, (1, 0), (-1, 0)])) == n


def test_sums_and_precision_by_hand(spark):
    lines = "image long, x1 double, y1 double, x2 double, y2 double, score double"
    pred = pixels.line_pixels(spark.createDataFrame([(1, 0.0, 0.0, 3.0, 0.0, 0.9), (1, 2.0, 0.0, 5.0, 0.0, 0.5), (2, 0.0, 0.0, 0.0, 0.0, 0.7), (3, None, 0.0, 1.0, 1.0, 0.9), (3, math.nan, 0.0, 1.0, 1.0, 0.9)], lines))
    assert {(r.image, r.row, r.col): r.score for r in pred.collect()} == {(1, 0, c): 0.9 if c < 4 else 0.5 for c in range(6)} | {(2, 0, 0): 0.7}
    truth = pixels.line_pixels(spark.createDataFrame([(1, 0.0, 1.0, 2.0, 1.0, 1.0), (4, 5.0, 5.0, 5.0, 5.0, 1.0)], lines))
    claimed = pixels.claimed_pixels(pred, truth, 1.0)
    sums = pixels.pixel_sums(claimed, truth, [0.8, 0.1, 0.6, 0.95])
    assert [tuple(r) for r in sums.orderBy("threshold").collect()] == [(0.1, 3, 4, 4), (0.6, 3, 2, 4), (0.8, 3, 1, 4), (0.95, 0, 0, 4)]
    got = pixels.pixel_precision(sums).collect()[0]
    assert got.ap == pytest.approx(0.75 * 0.75)
    assert got.f_score == pytest.approx(0.75)


def test_no_pixels(spark):
    none = pixels.line_pixels(spark.createDataFrame([], "image long, x1 double, y1 double, x2 double, y2 double, score double"))
    sums = pixels.pixel_sums(pixels.claimed_pixels(none, none, 2), none, [0.5])
    assert [tuple(r) for r in sums.collect()] == [(0.5, 0, 0, 0)]
    assert pixels.pixel_precision(sums).collect()[0].ap is None
