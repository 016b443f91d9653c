"""Tables of court geometry: fixed values, small whatever the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .geometry import COURT_LENGTH, COURT_WIDTH, SERVICE, SINGLES_WIDTH
from .homography import CHOICES, TEMPLATE

Segment = tuple[float, float, float, float]

#: The template's lines by the places of their end points (fixed values): baselines, sidelines, inner sidelines, service lines,
#: the middle line; the net is not between template points.
TEMPLATE_LINES = {
    "baseline_top": (0, 1), "baseline_bottom": (2, 3), "left": (0, 2), "right": (1, 3), "left_inner": (4, 5), "right_inner": (6, 7),
    "top_inner": (8, 9), "bottom_inner": (10, 11), "middle": (12, 13),
}


def court_segments(width: float = COURT_WIDTH, length: float = COURT_LENGTH, singles: float | None = SINGLES_WIDTH, service: float = COURT_LENGTH / 2 - SERVICE) -> dict[str, list[Segment]]:
    """The court's lines (u1, v1, u2, v2) in metres by kind; service is the way from a baseline to its service line."""
    across = lambda v: (0.0, v, width, v)
    along = lambda u: (u, 0.0, u, length)
    inner = [] if singles is None else [along((width - singles) / 2), along((width + singles) / 2)]
    return {
        "baselines": [across(0.0), across(length)], "doubles": [along(0.0), along(width)], "service": [across(service), across(length - service)],
        "center_serv": [(width / 2, service, width / 2, length - service)], "net": [across(length / 2)], "singles": inner,
    }


def calibration_points(mode: str = "4corners") -> list[tuple[str, float, float]]:
    """Names and places in metres of the points that a calibration by hand asks for."""
    near, far = COURT_LENGTH / 2 - SERVICE, COURT_LENGTH / 2 + SERVICE
    corners = [(f"{end}-{side} singles corner", u, v) for end, side, u, v in (
        ("near", "left", 0.0, 0.0), ("near", "right", SINGLES_WIDTH, 0.0), ("far", "right", SINGLES_WIDTH, COURT_LENGTH), ("far", "left", 0.0, COURT_LENGTH)
    )]
    if mode == "4corners":
        return corners
    if mode != "8points":
        raise ValueError(f"unknown mode {mode}")
    return corners + [(f"{end} service line @ {side} sideline", u, v) for end, side, u, v in (
        ("near", "left", 0.0, near), ("near", "right", SINGLES_WIDTH, near), ("far", "right", SINGLES_WIDTH, far), ("far", "left", 0.0, far)
    )]


def court_segment_table(spark: SparkSession) -> DataFrame:
    rows = [(kind, i, *s) for kind, some in court_segments().items() for i, s in enumerate(some)]
    return spark.createDataFrame(rows, "kind string, idx int, u1 double, v1 double, u2 double, v2 double")


def calibration_table(spark: SparkSession) -> DataFrame:
    rows = [(mode, i, *p) for mode in ("4corners", "8points") for i, p in enumerate(calibration_points(mode))]
    return spark.createDataFrame(rows, "mode string, idx int, label string, u double, v double")


def template_lines(spark: SparkSession) -> DataFrame:
    """The template's lines in the reference drawing's pixels."""
    rows = [(name, *map(float, TEMPLATE[a]), *map(float, TEMPLATE[b])) for name, (a, b) in TEMPLATE_LINES.items()]
    return spark.createDataFrame(rows, "name string, x1 double, y1 double, x2 double, y2 double")


def template_choices(spark: SparkSession) -> DataFrame:
    """Four-point choices: choice, place, point, x, y."""
    rows = [(c, k, p, *map(float, TEMPLATE[p])) for c, four in enumerate(CHOICES) for k, p in enumerate(four)]
    return spark.createDataFrame(rows, "choice int, place int, point int, x double, y double")
