"""Cleaning model responses and finding their JSON object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave import constants as C
from citeweave.functions.text import strip


def clean_response(raw: str | Column) -> Column:
    """Drop reasoning spans and code fences, trim white space."""
    text = F.col(raw) if isinstance(raw, str) else raw
    for span in C.RESPONSE_SPANS:
        text = F.regexp_replace(text, f"(?s){span}", "")
    return strip(F.regexp_replace(text, C.RESPONSE_FENCES, ""))


def object_text(cleaned: str | Column) -> Column:
    """From the first { to the last }, or ''."""
    cleaned = F.col(cleaned) if isinstance(cleaned, str) else cleaned
    return F.regexp_extract(cleaned, f"(?s){C.RESPONSE_OBJECT}", 0)


def is_json_object(text: str | Column) -> Column:
    """True when the whole text is one JSON object.

    The parser stops after the first value, so the text is parsed as the only
    element of an array; anything behind the object shows. Repeated keys and NaN
    count as not parsed.
    """
    text = F.col(text) if isinstance(text, str) else text
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return (text != "") & wrapped.isNotNull() & alone


def has_error_key(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.array_contains(F.json_object_keys(text), "error"), F.lit(False))
