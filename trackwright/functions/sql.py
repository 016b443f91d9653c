"""The engine's functions by name in SQL text: geometry as SQL functions that Spark inlines, and a keyed fold as a table function.

register(spark) makes them known to a session:

    SELECT frame, tw_iou(a.x1, a.y1, a.x2, a.y2, b.x1, b.y1, b.x2, b.y2) FROM ...
    SELECT * FROM tw_debounce(TABLE(SELECT ...) PARTITION BY video_id ORDER BY (frame), 60)
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

_BOX = lambda p="": ", ".join(f"{p}{c} DOUBLE" for c in ("x1", "y1", "x2", "y2"))

#: name: (parameters, type, body). A body may use the functions before it.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "tw_distance": ("ax DOUBLE, ay DOUBLE, bx DOUBLE, `by` DOUBLE", "DOUBLE", "hypot(ax - bx, ay - `by`)"),
    "tw_box_area": (_BOX(), "DOUBLE", "greatest(x2 - x1, 0D) * greatest(y2 - y1, 0D)"),
    "tw_box_overlap": (
        f"{_BOX('a')}, {_BOX('b')}", "DOUBLE", "tw_box_area(greatest(ax1, bx1), greatest(ay1, by1), least(ax2, bx2), least(ay2, by2))",
    ),
    "tw_iou": (
        f"{_BOX('a')}, {_BOX('b')}", "DOUBLE",
        "coalesce(tw_box_overlap(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) / nullif(tw_box_area(ax1, ay1, ax2, ay2) + tw_box_area(bx1, by1, bx2, by2) "
        "- tw_box_overlap(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2), 0D), 0D)",
    ),
    "tw_project_x": ("h ARRAY<DOUBLE>, x DOUBLE, y DOUBLE", "DOUBLE", "(h[0] * x + h[1] * y + h[2]) / nullif(h[6] * x + h[7] * y + h[8], 0D)"),
    "tw_project_y": ("h ARRAY<DOUBLE>, x DOUBLE, y DOUBLE", "DOUBLE", "(h[3] * x + h[4] * y + h[5]) / nullif(h[6] * x + h[7] * y + h[8], 0D)"),
    "tw_segment_length": (_BOX(), "DOUBLE", "hypot(x2 - x1, y2 - y1)"),
    "tw_segment_angle": (_BOX(), "DOUBLE", "pmod(degrees(atan2(y2 - y1, x2 - x1)), 180D)"),
    "tw_kmh": ("metres DOUBLE, seconds DOUBLE", "DOUBLE", "metres / nullif(seconds, 0D) * 3.6D"),
}


@udtf(returnType="video_id bigint, frame bigint")
class Debounce:
    """Rows (video_id, frame) of a partition in order of frame, kept if more than gap frames after the last one kept. Its state is one number."""

    def __init__(self) -> None:
        self.last = 0

    def eval(self, row: Row, gap: int) -> Iterator[tuple[Any, Any]]:
        if row["frame"] - self.last > gap:
            self.last = row["frame"]
            yield row["video_id"], row["frame"]


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; again is no harm. Gives their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("tw_debounce", Debounce)
    return [*FUNCTIONS, "tw_debounce"]
