"""Abstract text from an inverted index (word -> positions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rebuild_abstract(index: str | Column) -> Column:
    """Words of ``MAP<STRING, ARRAY<INT>>`` in position order, one space apart.

    Gaps in the positions close up. Words sharing a position keep the order in
    which the index lists them. Null, empty or position-less input gives ''.
    """
    index = F.col(index) if isinstance(index, str) else index
    return _join_words(F.map_entries(index))


def rebuild_abstract_json(raw: str | Column) -> Column:
    """Same from the index's JSON text.

    A word whose positions are not a list is left out; text that is not a JSON
    object gives ''. When a key is repeated its last list counts, at the place
    where the key first stood.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    lists = F.map_entries(F.from_json(raw, "map<string,array<int>>"))
    return bind(
        lists,
        lambda entries: _join_words(
            F.when(F.forall(entries, lambda e: e["value"].isNotNull()), entries).otherwise(
                _lists_only(raw)
            )
        ),
    )


def _lists_only(raw: Column) -> Column:
    """The index word by word; what is not a list becomes null."""
    by_word = F.map_entries(F.from_json(raw, "map<string,string>"))
    return F.transform(
        by_word,
        lambda e: F.struct(
            e["key"].alias("key"), F.from_json(e["value"], "array<int>").alias("value")
        ),
    )


def _join_words(entries: Column) -> Column:
    words = bind(
        entries,
        lambda some: bind(
            F.transform(some, lambda e: e["key"]),
            lambda keys: _words_in_order(
                F.when(
                    F.size(F.array_distinct(keys)) < F.size(keys), _last_of_each_key(some, keys)
                ).otherwise(some)
            ),
        ),
    )
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def _words_in_order(entries: Column) -> Column:
    no_positions = F.array().cast("array<int>")
    placed = F.flatten(
        F.transform(
            entries,
            lambda e, i: F.transform(
                F.coalesce(e["value"], no_positions),
                lambda pos: F.struct(pos.alias("pos"), i.alias("entry"), e["key"].alias("word")),
            ),
        )
    )
    return F.transform(F.sort_array(placed), lambda s: s["word"])


def _last_of_each_key(entries: Column, keys: Column) -> Column:
    return F.transform(
        F.array_distinct(keys),
        lambda key: F.element_at(F.filter(entries, lambda e: e["key"] == key), -1),
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]
