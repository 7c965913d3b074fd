"""Ranking within groups that may be very large.

A window function sends each group to one task. These forms give the same answers
while a group holding a large part of all rows stays spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Spark trims row_number() <= k before its shuffle only up to this k by default
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT_K = 1000
SALTS = 512

# Leading hex digits of a row's md5 that name its slot: 16 ** 3 slots per value.
SLOT_DIGITS = 3


def top_k(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int | Column,
    id_col: str,
    rank_col: str = "rank",
    max_k: int | None = None,
) -> DataFrame:
    """First ``k`` rows of each group, with their 1-based rank.

    Spark cuts every input partition to k rows per group before shuffling. For a
    k past Spark's limit for that, the cut is made per salted subgroup first.
    """
    limit = max_k if max_k is not None else k
    if limit > GROUP_LIMIT_K:
        rows = _cut_salted(rows, keys, order, limit, id_col, F.row_number())
    ranked = rows.withColumn(rank_col, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    if max_k is not None:
        ranked = ranked.where(F.col(rank_col) <= max_k)
    return ranked.where(F.col(rank_col) <= k).withColumn(rank_col, F.col(rank_col).cast("bigint"))


def within_rank(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt_col: str
) -> DataFrame:
    """Rows with fewer than ``k`` strictly better rows in their group."""
    if k > GROUP_LIMIT_K:
        rows = _cut_salted(rows, keys, order, k, salt_col, F.rank())
    better = F.rank().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", better).where(F.col("_rank") <= k).drop("_rank")


def value_percent_rank(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    n: str,
    out: str,
    descending: bool = True,
) -> DataFrame:
    """PERCENT_RANK of every distinct value, from a table of value counts.

    Equal values share a rank, so the rank depends on the number of rows before
    the value only. The window runs over distinct values instead of rows. Nulls
    rank last. Returns keys, value and ``out``.
    """
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    within = W.partitionBy(*keys)
    freq = counts.groupBy(*keys, value).agg(F.sum(n).alias("_n"))
    before = F.sum("_n").over(within.orderBy(order)) - F.col("_n")
    total = F.sum("_n").over(within)
    share = F.when(total > 1, before / (total - 1)).otherwise(F.lit(0.0))
    return freq.select(*keys, value, share.alias(out))


def spread_ntile(
    rows: DataFrame, keys: Sequence[str], value: str, id_col: str, tiles: int, out: str
) -> DataFrame:
    """NTILE(tiles) per group in order of (value, md5(id), id), for groups of any size.

    Rows are counted per (group, value, md5 prefix); a running sum over those
    counts says how many rows stand before each such slot, and a row number
    inside the slot does the rest. The md5 order makes slots even, so a group
    that is huge, even one with a single value, is shared out among tasks.
    ``value`` must not be null.
    """
    slot_keys = [*keys, value, "_slot"]
    slotted = rows.withColumn("_hash", F.md5(id_col)).withColumn(
        "_slot", F.substring("_hash", 1, SLOT_DIGITS)
    )
    counts = slotted.groupBy(*slot_keys).agg(F.count(F.lit(1)).alias("_n"))
    within = W.partitionBy(*keys)
    before = F.sum("_n").over(within.orderBy(value, "_slot").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(
        *slot_keys,
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_n").over(within).alias("_total"),
    )
    in_slot = F.row_number().over(W.partitionBy(*slot_keys).orderBy("_hash", id_col))
    position = F.col("_before") + in_slot - 1
    small = F.floor(F.col("_total") / tiles)
    larger_tiles = F.col("_total") % tiles
    in_larger = larger_tiles * (small + 1)
    tile = F.when(
        F.col("_pos") < in_larger, F.floor(F.col("_pos") / (small + 1))
    ).otherwise(larger_tiles + F.floor((F.col("_pos") - in_larger) / small))
    return (
        slotted.join(offsets, slot_keys)
        .withColumn("_pos", position)
        .withColumn(out, (tile + 1).cast("bigint"))
        .drop("_hash", "_slot", "_before", "_total", "_pos")
    )


def _cut_salted(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt_col: str, rank: Column
) -> DataFrame:
    """Drop rows whose rank in a hash-picked part of their group is past k already."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_col), F.lit(SALTS)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    return salted.withColumn("_local", rank.over(part)).where(F.col("_local") <= k).drop(
        "_salt", "_local"
    )
