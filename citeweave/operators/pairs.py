"""The earliest paper in which two concepts occur together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.dates import safe_date
from citeweave.operators.numbering import number_rows

# Concepts of a paper are paired block by block.
BLOCK = 256


def first_cooccurrence(
    papers: DataFrame,
    edges: DataFrame,
    shard_col: str | None = None,
    per_shard: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """concept1 < concept2 with the first paper of both, its date and year.

    "First" is the smallest (date, paper id); papers without a valid date do not
    count. With ``shard_col`` pairs form only within a shard; ``per_shard`` then
    also keeps one row per shard instead of one in all.

    Papers are numbered once in that order (see ``number_rows``), so "first" is the least
    number: the aggregates keep one long a group, and the paper behind a number is looked
    up at the end. The concepts of a paper are gathered into a sorted set (bounded by the
    dictionary), cut into blocks, and the first paper is found per pair of blocks before
    any pair of concepts is made. So papers with the same concepts make their pairs once,
    and a paper with very many concepts is shared out among tasks. No self-join is needed.
    """
    if per_shard and not shard_col:
        raise ValueError("per_shard needs shard_col")
    shard = [shard_col] if shard_col else []
    kept = shard if per_shard else []
    dated = papers.select(
        F.col("id").alias("paper_id"),
        *shard,
        safe_date("publication_date").alias("date"),
        F.col("publication_year").alias("year"),
    ).where(F.col("date").isNotNull())
    order = ["date", "paper_id", *shard, F.asc_nulls_last("year")]
    numbered = number_rows(dated, order, "paper")
    sets = edges.groupBy("paper_id", *shard).agg(
        F.sort_array(F.collect_set("concept")).alias("concepts")
    )
    blocks = (
        sets.where(F.size("concepts") > 1)
        .join(numbered.select("paper_id", *shard, "paper"), ["paper_id", *shard])
        .select(*kept, "paper", "concepts")
        .withColumn("i", F.explode(_block_numbers(block)))
        .withColumn("j", F.explode(F.sequence(F.col("i"), F.element_at(_block_numbers(block), -1))))
        .select(*kept, "paper", _block("i", block).alias("left"), _block("j", block).alias("right"))
    )
    first = F.min("paper").alias("paper")
    # Concepts of a block are less than those of a later one; within a block, of later ones.
    later = F.when(
        F.col("left") == F.col("right"), F.slice("right", F.col("at") + 2, F.lit(block))
    ).otherwise(F.col("right"))
    pairs = (
        blocks.groupBy(*kept, "left", "right").agg(first)
        .select(*kept, "paper", "left", "right", F.posexplode("left").alias("at", "concept1"))
        .select(*kept, "paper", "concept1", F.explode(later).alias("concept2"))
    )
    found = pairs.groupBy(*kept, "concept1", "concept2").agg(first)
    return found.join(numbered.drop(*kept), "paper").select(
        *kept,
        "concept1",
        "concept2",
        F.col("paper_id").alias("first_paper_id"),
        F.col("date").alias("first_publication_date"),
        F.col("year").alias("first_publication_year"),
    )


def by_first_date(pairs: DataFrame) -> DataFrame:
    """The order for a sink."""
    return pairs.orderBy(
        F.asc_nulls_last("first_publication_date"), F.asc("concept1"), F.asc("concept2")
    )


def _block_numbers(block: int) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size("concepts") - 1) / block).cast("int"))


def _block(number: str, block: int) -> Column:
    return F.slice("concepts", F.col(number) * block + 1, F.lit(block))
