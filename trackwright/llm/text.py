"""Expressions that several text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as the operators' definitions of words use it.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """text without ASCII white space."""
    return F.regexp_replace(text, SPACE + "+", "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")
