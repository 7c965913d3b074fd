"""Words, tables and hashes that several operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.session import drop_folder, scratch_dir

# A word is a run of characters other than the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall

_ODD_A = np.uint64(0x9E3779B97F4A7C15)
_ODD_B = np.uint64(0xC2B2AE3D27D4EB4F)


def stored(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` into the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks after the table.
    """
    path = scratch_dir(spark, name)
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove tables of ``stored`` once what was made from them is written."""
    for frame in frames:
        drop_folder(spark, frame.stored_at)


def word_array(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    return F.crc32(doc_id.cast("string")) % divisor


def word_hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes, position by position."""
    x = left * _ODD_A + right
    x ^= x >> np.uint64(29)
    x *= _ODD_B
    x ^= x >> np.uint64(32)
    return x


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash per window of ``length`` items, put together from doubled windows."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    doubled, size, out, done = hashes, 1, None, 0
    while done < length:
        if (length - done) & size:
            if out is None:
                out = doubled
            else:
                tail = doubled[done:]
                keep = min(len(out), len(tail))
                out = mixed(out[:keep], tail[:keep])
            done += size
        if done < length:
            doubled = mixed(doubled[:-size], doubled[size:])
            size *= 2
    return out[:n]


def as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Cut Arrow batches into small ones, so that Python holds few long texts at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
