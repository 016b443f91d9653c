import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackwright.functions import geometry as g
from trackwright.functions import homography as h
from trackwright.operators import boxes as bx
from trackwright.operators import lines as ln


def lit(*values):
    return tuple(F.lit(float(v)) for v in values)


def value(spark, *columns):
    row = tuple(spark.range(1).select(*columns).first())
    return row[0] if len(row) == 1 else row


def test_box_scalars(spark):
    assert value(spark, *g.center(lit(0, 0, 5, 5))) == (2, 2)
    assert value(spark, *g.bottom_center(lit(10, 20, 30, 60))) == (20, 60)
    assert value(spark, g.iou(lit(0, 0, 10, 10), lit(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert value(spark, g.iou(lit(0, 0, 1, 1), lit(5, 5, 6, 6))) == 0
    assert value(spark, *g.clipped(lit(-5, -5, -1, -1), 100, 100)) == (None,) * 4


def test_polygon_edges_are_inside(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert value(spark, *(g.in_polygon(lit(*p), square) for p in ((0.5, 0.5), (1, 0.5), (1.1, 0.5), (0, 0)))) == (True, True, False, True)


def test_court_distances(spark):
    assert value(spark, g.outside_court(lit(-3.75, 27.52))) == pytest.approx(4.2426, abs=1e-4)
    assert value(spark, g.mini_court_metres(lit(0, 0), lit(1, 0))) == pytest.approx(5.485)
    assert value(spark, g.frame_time(F.lit(45), F.lit(29.97))) == 45 / 29


def test_points_without_image_are_null(spark):
    assert value(spark, *g.project(lit(1, 0), [1, 0, 0, 0, 1, 0, 1, 0, -1])) == (None, None)


def test_parallel_lines_do_not_meet(spark):
    assert value(spark, *g.line_intersection(lit(0, 0, 1, 1), lit(0, 1, 1, 2))) == (None, None)
    assert value(spark, *g.line_intersection(lit(0, 0, 2, 2), lit(0, 2, 2, 0))) == (1, 1)


def test_quad_order(spark):
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((9, 8), (1, 1), (0, 9), (8, 0))))
    assert [tuple(p) for p in value(spark, g.ordered_quad(points))] == [(1, 1), (8, 0), (9, 8), (0, 9)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-0.2, 0.2), min_size=8, max_size=8), st.permutations(range(4)))
def test_homography_round_trip(jitter, order):
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    image = square * 100 + np.array(jitter).reshape(4, 2) * 100
    m = h.fit(square[list(order)], image[list(order)])
    assert h.valid(m)
    assert np.allclose(h.project(m, square), image, atol=1e-6)
    assert np.allclose(h.project(np.linalg.inv(m), image), square, atol=1e-6)


def test_best_choice_skips_missing_points():
    m = np.array([[0.4, 0.01, 90], [0.02, 0.2, 40], [1e-5, 2e-5, 1]])
    points = h.project(m, h.TEMPLATE)
    points[[0, 5]] = np.nan
    best, error = h.best_of_choices(points)
    assert error < 1e-6
    assert np.allclose(best, m, atol=1e-6)
    assert h.best_of_choices(np.full((14, 2), np.nan))[0] is None


def detections(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], "frame int, det int, x1 double, y1 double, x2 double, y2 double, conf double")


def test_nms_keeps_the_surest(spark):
    df = detections(spark, [(0, 0, 10, 10, 0.5), (0, 0, 10, 11, 0.9), (50, 50, 60, 60, 0.3)])
    assert sorted(r.det for r in bx.nms(df, ["frame"], 0.7).collect()) == [1, 2]


def test_bad_detection_fails(spark):
    with pytest.raises(Exception, match="out of range"):
        bx.valid_detections(detections(spark, [(0, 0, 1, 1, 1.5)])).collect()


def test_hungarian_is_optimal(spark):
    from itertools import permutations

    rng = np.random.default_rng(2)
    rows, best = [], {}
    for image in range(12):
        n, m = rng.integers(1, 5, 2)
        c = rng.random((n, m)).round(3)
        rows += [(image, i, 100 + j, float(c[i, j])) for i in range(n) for j in range(m)]
        small = c if n <= m else c.T
        best[image] = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small)))
    got = ln.hungarian(spark.createDataFrame(rows, "image int, a int, b int, cost double"), ["image"]).groupBy("image").agg(F.sum("cost").alias("c"), F.countDistinct("a").alias("n"), F.count("*").alias("k")).collect()
    assert {r.image: pytest.approx(r.c) for r in got} == best
    assert all(r.n == r.k for r in got)


def test_detector_rows_become_boxes(spark):
    from trackwright.operators import boxes

    rows = [
        (1, '{"bbox": [10, 20, 30, 40], "class": 0}', None), (2, None, [10.0, 20.0, 300.0, 40.0, 0.5, 1.0]), (3, None, [-9.0, 5.0, -1.0, 9.0, 0.9]),
        (4, '{"bbox": [1, 2, 3]}', None), (5, "not json", None), (6, None, [5.0, 5.0, 5.0, 9.0, 0.9]), (7, None, None), (8, None, [1.0, 2.0, 3.0, 4.0, 0.25]),
    ]
    frame = spark.createDataFrame(rows, "det int, record string, values array<double>")
    got = {r.det: tuple(r)[1:] for r in boxes.parsed(frame, (101, 51)).collect()}
    assert got == {1: (10, 20, 30, 40, 1.0, 0), 2: (10, 20, 100, 40, 0.5, 1), 8: (1, 2, 3, 4, 0.25, None)}
    assert [r.det for r in boxes.parsed(frame, (101, 51), only_class=1).collect()] == [2]
    shares = spark.createDataFrame([(1, None, [0.5, 0.5, 0.2, 0.4, 0.7])], "det int, record string, values array<double>")
    (box,) = boxes.parsed(shares, (100, 50), "xywh", normalized=True).collect()
    assert (box.x1, box.y1, box.x2, box.y2) == (40, 15, 60, 35)
