"""Text predicates and measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.constants import CHARS_PER_TOKEN

ALNUM = r"[\p{L}\p{N}]"

# Python's str.strip() set: Unicode separators plus the control-character spaces.
PY_SPACE = r"[\p{Z}\t-\r\x{1c}-\x{1f}\x{85}]"


def has_text(col: str | Column) -> Column:
    """True when something is left after trimming Unicode space separators.

    Tabs and line breaks count as text, and null gives null. One search for a
    non-space character replaces trim-and-compare.
    """
    return _col(col).rlike(r"[^\p{Zs}]")


def strip(col: str | Column) -> Column:
    """Remove surrounding white space, control-character spaces included."""
    return F.regexp_replace(_col(col), rf"^{PY_SPACE}+|{PY_SPACE}+\z", "")


def combined_text(title: str | Column, abstract: str | Column) -> Column:
    """Title, one space, abstract. A phrase may match across the seam."""
    return F.concat(
        F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(abstract), F.lit(""))
    )


def estimated_tokens(title: str | Column, abstract: str | Column) -> Column:
    """Characters of title and abstract over four, nulls counting nothing."""
    chars = F.length(F.coalesce(_col(title), F.lit(""))) + F.length(
        F.coalesce(_col(abstract), F.lit(""))
    )
    return chars / F.lit(CHARS_PER_TOKEN)


def year_in_range(year: str | Column, start: int | None = None, end: int | None = None) -> Column:
    """Inclusive range test that lets an unknown year (null or 0) pass."""
    year = _col(year)
    inside = F.lit(True)
    if start:
        inside = inside & (year >= start)
    if end:
        inside = inside & (year <= end)
    return year.isNull() | (year == 0) | inside


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
