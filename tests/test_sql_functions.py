"""Functions by name in SQL text."""

import pytest

from trackwright.functions import sql


def test_functions_by_hand(spark):
    assert set(sql.register(spark)) == set(sql.register(spark))
    one = spark.sql("""
        SELECT tw_iou(0, 0, 2, 2, 1, 1, 3, 3) AS iou, tw_iou(0, 0, 0, 0, 1, 1, 1, 1) AS none, tw_distance(0, 0, 3, 4) AS d, tw_segment_angle(0, 0, -1, -1) AS angle,
          tw_project_x(array(2D, 0D, 1D, 0D, 3D, 0D, 0D, 0D, 1D), 5, 7) AS x, tw_project_y(array(2D, 0D, 1D, 0D, 3D, 0D, 0D, 0D, 1D), 5, 7) AS y, tw_kmh(10, 1) AS kmh, tw_kmh(10, 0) AS still
    """).first()
    assert one.iou == pytest.approx(1 / 7)
    assert (one.none, one.d, one.x, one.y, one.still) == (0.0, 5.0, 11.0, 21.0, None)
    assert (one.angle, one.kmh) == (pytest.approx(45), pytest.approx(36))


def test_debounce_as_a_table_function(spark):
    sql.register(spark)
    marks = {1: [10, 70, 100, 131, 300], 2: [61, 62, 200]}
    spark.createDataFrame([(v, f) for v, fs in marks.items() for f in fs], "video_id long, frame long").createOrReplaceTempView("marks")
    rows = spark.sql("SELECT * FROM tw_debounce(TABLE(SELECT video_id, frame FROM marks) PARTITION BY video_id ORDER BY (frame), 60)").collect()
    assert sorted(map(tuple, rows)) == [(1, 70), (1, 131), (1, 300), (2, 61), (2, 200)]
