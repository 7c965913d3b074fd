"""Deduplicating papers and building the concept-paper edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.operators.semifilter import mark_possible


def first_version(
    papers: DataFrame,
    order: Sequence[str],
    id_col: str = "id",
    shard_col: str | None = None,
) -> DataFrame:
    """Keep the first row of every id in the given order (nulls last)."""
    return _one_per_id(papers, [F.asc_nulls_last(c) for c in order], id_col, shard_col)


def latest_version(
    papers: DataFrame,
    order: Sequence[str],
    id_col: str = "id",
    shard_col: str | None = None,
) -> DataFrame:
    """Keep the last row of every id in the given order (nulls first)."""
    return _one_per_id(papers, [F.desc_nulls_last(c) for c in order], id_col, shard_col)


def concept_edges(
    papers: DataFrame,
    id_col: str = "id",
    concepts_col: str = "matched_concepts",
    shard_col: str | None = None,
) -> DataFrame:
    """Distinct (concept, paper_id) over all versions of all papers."""
    shard = [shard_col] if shard_col else []
    return (
        papers.select(
            F.explode(concepts_col).alias("concept"), F.col(id_col).alias("paper_id"), *shard
        )
        .where(F.col("concept").isNotNull() & F.col("paper_id").isNotNull())
        .dropDuplicates()
    )


def not_yet_done(items: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Items without an entry in ``done``."""
    return items.join(done.select(*on), list(on), "left_anti")


def _one_per_id(
    papers: DataFrame, order: Sequence[Column], id_col: str, shard_col: str | None
) -> DataFrame:
    """One row of every id: those that stand alone as they are, row_number() = 1 of others.

    Ids that occur more than once are found on a scan of the ids alone. A bitmap of them is
    broadcast to the scan of the rows, where rows of all other ids pass unmoved; only rows
    of repeated ids (and a few by chance) are sorted and shuffled with their text. Of those
    Spark keeps one row per id in each input partition before the shuffle, so an id with
    very many copies is not gathered whole. Rows that tie in the given order are told apart
    by content.
    """
    keys = ([shard_col] if shard_col else []) + [id_col]
    repeated = papers.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marked = mark_possible(papers, F.struct(*keys), repeated, F.struct(*keys), "_repeated")
    alone = marked.where(~F.col("_repeated")).drop("_repeated")
    several = marked.where("_repeated").drop("_repeated")
    content = F.xxhash64(*[c for c in papers.columns if c not in keys])
    window = W.partitionBy(*keys).orderBy(*order, content)
    first = several.withColumn("_version", F.row_number().over(window))
    return alone.unionByName(first.where(F.col("_version") == 1).drop("_version"))
