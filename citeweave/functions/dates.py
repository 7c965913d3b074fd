"""Lenient date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_date(col: str | Column) -> Column:
    """Parse year-month-day text to DATE, or null.

    A bare year or year-month is not a date here (Spark's own cast would take
    them as 1 January); ``/`` works as separator like ``-``.
    """
    col = F.col(col) if isinstance(col, str) else col
    shaped = col.rlike(r"^\s*\d{1,4}([-/])\d{1,2}\1\d{1,2}")
    return F.when(shaped, F.translate(col, "/", "-").try_cast("date"))
