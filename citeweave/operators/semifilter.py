"""Keep rows whose key may be among given keys, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a filter: a million longs at most, whatever the number of keys.
CELLS = 1 << 26


def key_cells(keys: DataFrame, key: Column, cells: int = CELLS) -> DataFrame:
    """``cell_word, bits``: a bitmap of the keys' hashes, 64 bits a row, of bounded size."""
    cell = F.pmod(F.xxhash64(key), F.lit(cells))
    bit = F.expr("shiftleft(1L, cast(_cell % 64 as int))")
    return (
        keys.select(cell.alias("_cell"))
        .groupBy(F.shiftright("_cell", 6).alias("_cell_word"))
        .agg(F.bit_or(bit).alias("_bits"))
    )


def mark_possible(
    rows: DataFrame, key: Column, keys: DataFrame, wanted: Column, out: str, cells: int = CELLS
) -> DataFrame:
    """Rows with a flag: False if ``key`` is surely none of the ``wanted`` values of ``keys``.

    The bitmap is broadcast, so rows are marked in the stage that scans them.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(cells))
    placed = rows.withColumn("_cell", cell).withColumn("_cell_word", F.shiftright("_cell", 6))
    met = placed.join(F.broadcast(key_cells(keys, wanted, cells)), "_cell_word", "left")
    held = F.expr("(shiftright(_bits, cast(_cell % 64 as int)) & 1) = 1")
    flagged = met.withColumn(out, F.coalesce(held, F.lit(False)))
    return flagged.drop("_cell", "_cell_word", "_bits")


def may_match(
    rows: DataFrame, key: Column, keys: DataFrame, wanted: Column, cells: int = CELLS
) -> DataFrame:
    """Rows whose ``key`` may be one of the ``wanted`` values of ``keys``.

    No row with a wanted key is lost; a share of the others stays by chance (the number of
    keys over ``cells``), for the join that follows to drop.
    """
    marked = mark_possible(rows, key, keys, wanted, "_possible", cells)
    return marked.where("_possible").drop("_possible")
