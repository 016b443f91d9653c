"""Circle votes, line votes and refined points, on drawn pictures and against plain loops."""

import math
import random

import pytest

from trackwright.operators import heatmaps as hm


def picture(spark, images, size):
    """images: {image: set of lit (row, col)}; all other cells are dark."""
    rows = [(i, r, c, 255.0 if (r, c) in lit else 0.0) for i, lit in images.items() for r in range(size) for c in range(size)]
    return spark.createDataFrame(rows, "image long, row int, col int, score double")


def ring(row, col, radius):
    return {(row + r, col + c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if radius - 0.5 <= math.hypot(r, c) < radius + 0.5}


def disc(row, col, radius):
    return {(row + r, col + c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if math.hypot(r, c) <= radius}


def test_centres_of_discs_and_rings(spark):
    cells = picture(spark, {1: disc(20, 25, 6), 2: ring(30, 18, 8), 3: set()}, 50)
    found = {r.image: (r.x, r.y) for r in hm.heatmap_points(cells, 155, 5, 9).collect()}
    assert set(found) == {1, 2, 3}
    assert found[3] == (None, None)
    for image, (row, col) in {1: (20, 25), 2: (30, 18)}.items():
        assert found[image][0] == pytest.approx(2 * col, abs=2)
        assert found[image][1] == pytest.approx(2 * row, abs=2)


def test_circle_votes_against_loops(spark):
    rnd = random.Random(3)
    lit = {(rnd.randrange(20), rnd.randrange(20)) for _ in range(60)}
    got = {(r.row, r.col): r.votes for r in hm.circle_votes(picture(spark, {1: lit}, 20), 155, 2, 4).collect()}
    edge = [(r, c) for r, c in lit if not {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} <= lit]
    want = {(r, c): sum(2 <= math.floor(math.hypot(r - a, c - b) + 0.5) <= 4 for a, b in edge) for r in range(20) for c in range(20)}
    assert got == {k: n for k, n in want.items() if n}


def line(row, col, dr, dc, n):
    return {(round(row + k * dr), round(col + k * dc)) for k in range(-n, n + 1)}


def test_points_move_to_where_two_lines_cross(spark):
    across, down, slant = line(60, 70, 0, 1, 45), line(60, 70, 1, 0, 45), line(60, 70, 0.7, 0.7, 50)
    images = {1: across | down, 2: across, 3: across | down | slant, 4: set(), 5: line(60, 70, 0.2, 1, 40) | line(60, 70, 1, -0.3, 40)}
    points = spark.createDataFrame([(i, 1, 66, 63) for i in images] + [(1, 2, 10, 10)], "image long, point long, x int, y int")
    got = {(r.image, r.point): r for r in hm.refined_points(picture(spark, images, 128), points).collect()}
    assert len(got) == 6
    for i in (1, 5):
        assert got[i, 1].moved
        assert (got[i, 1].x, got[i, 1].y) == (pytest.approx(70, abs=2), pytest.approx(60, abs=2))
    for i in (2, 3, 4):
        assert (got[i, 1].x, got[i, 1].y, got[i, 1].moved) == (66, 63, False)
    assert (got[1, 2].x, got[1, 2].y, got[1, 2].moved) == (10, 10, False)


def test_windows_at_the_edge(spark):
    cells = picture(spark, {1: {(0, 0), (3, 4), (9, 9)}}, 12)
    points = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 8, 8)], "image long, point long, x int, y int")
    rows = {(r.point, r.x, r.y) for r in hm.around_points(cells, points, 155, 5).collect()}
    assert rows == {(1, 0, 0), (1, 4, 3), (2, 1, 0), (2, 6, 6)}


def test_empty_tables(spark):
    none = picture(spark, {1: set()}, 2).where("false")
    assert hm.heatmap_points(none, 1).count() == 0
    assert hm.refined_points(none, spark.createDataFrame([], "image long, point long, x int, y int")).count() == 0
