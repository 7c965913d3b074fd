"""Removal of passages that repeat across documents, by doubling repeated windows.

Windows of half the length are hashed first; only those found in two documents are
extended to the full length, those that repeat again to twice that, and so on until no
window repeats. What repeats at the full length is removed everywhere but in the smallest
document; the longer levels tell how long a document's longest repeat is. Of the half
windows in any full window the least (by hash, the first of equals) stands for it, so two
documents that share a full window share that half window too, and only these few are
shuffled.

Rows are known by what they say: rows of the same words are one class, judged once through
its smallest document; the others are removed whole if they hold a window. So rows that
share an id, with one text or with several, are kept apart.

Defined cases: a null or empty text has no words, nothing to remove, and keeps ''. Texts
shorter than a window keep their words. A row whose document id is null belongs to no
document: it is returned, but neither counts as an occurrence nor loses words. Rows with
the same id are one document each time they stand; a window is removed only for a smaller
id. Other columns are not looked at. Words and texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import as_long, find_words, slices, stored, window_hashes, word_hashes

LONGS = pa.list_(pa.int64())
INTS = pa.list_(pa.int32())


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the position of the least, the first of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    view = sliding_window_view(values, width)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        part = view[at : at + 65536]
        out[at : at + len(part)] = part.argmin(axis=1)
    return out + np.arange(n)


def half_windows(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the half windows, and which of them stands for each full window."""
    half = window_hashes(hashes, length // 2)
    return half, least_positions(half, length - length // 2 + 1)


def _digest(words: list[str]) -> tuple[bytes, int, int]:
    """The words as one string, and the two halves of its 128-bit hash."""
    whole = " ".join(words).encode()
    digest = xxhash.xxh3_128_intdigest(whole)
    return whole, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def _mark(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, highs, lows, kept, anchors = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = find_words(text) if text else []
                whole, high, low = _digest(words)
                half, standing = half_windows(word_hashes(words), length)
                sizes.append(len(words))
                highs.append(high)
                lows.append(low)
                kept.append(hashlib.sha256(whole).hexdigest())
                anchors.append(as_long(np.unique(half[np.unique(standing)])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(highs, pa.int64()),
                    pa.array(lows, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(anchors, LONGS),
                ],
                names=["doc_id", "text_key", "n_words", "high", "low", "whole_sha256", "anchors"],
            )

    return run


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is the one that their class stands for."""
    for batch in slices(batches):
        texts = [find_words(t) for t in batch.column("text").to_pylist()]
        same = [
            _digest(words)[1:] == (high, low)
            for words, high, low in zip(
                texts,
                batch.column("high").to_pylist(),
                batch.column("low").to_pylist(),
                strict=True,
            )
        ]
        yield batch.filter(pa.array(same, pa.bool_()))


def _extend(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            windows, starts = [], []
            for text, found in zip(
                batch.column("text").to_pylist(), batch.column("anchors"), strict=True
            ):
                hashes = word_hashes(find_words(text))
                half, standing = half_windows(hashes, length)
                found = found.values.to_numpy().view(np.uint64)
                at = np.flatnonzero(np.isin(half[standing], found))
                full = window_hashes(hashes, length)
                windows.append(as_long(full[at]))
                starts.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "high", "low", "text")],
                    pa.array(windows, LONGS),
                    pa.array(starts, INTS),
                ],
                names=["doc_id", "high", "low", "text", "windows", "starts"],
            )

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, kept = [], []
            for text, starts in zip(
                batch.column("text").to_pylist(), batch.column("starts"), strict=True
            ):
                words = find_words(text)
                change = np.zeros(len(words) + 1, np.int64)
                at = starts.values.to_numpy()
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
                covered = np.cumsum(change)[:-1] > 0
                removed.append(int(covered.sum()))
                kept.append(" ".join([words[i] for i in np.flatnonzero(~covered)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("high"),
                    batch.column("low"),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["high", "low", "n_removed", "kept"],
            )

    return run


def shared_keys(spark: SparkSession, rows: DataFrame, key: str, name: str) -> DataFrame:
    """Keys found in two documents, with the smaller id. Copies meet before the shuffle."""
    ends = rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return stored(spark, ends.where("least < most").select(key, "least"), name)


CLASS = ["high", "low"]


def _longer(size: int):
    """Windows of ``size`` words both halves of which repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            windows, starts = [], []
            for text, found in zip(
                batch.column("text").to_pylist(), batch.column("starts"), strict=True
            ):
                full = window_hashes(word_hashes(find_words(text)), size)
                at = np.unique(found.values.to_numpy())
                at = at[(at < len(full)) & np.isin(at + size // 2, at)]
                windows.append(as_long(full[at]))
                starts.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "high", "low")],
                    pa.array(windows, LONGS),
                    pa.array(starts, INTS),
                ],
                names=["doc_id", "high", "low", "windows", "starts"],
            )

    return run


def _placed(full: DataFrame) -> DataFrame:
    """One row per window and place."""
    rows = full.select("doc_id", *CLASS, F.explode(F.arrays_zip("windows", "starts")).alias("w"))
    return rows.select(
        "doc_id", *CLASS, F.col("w.windows").alias("window"), F.col("w.starts").alias("at")
    )


def _repeated(spark: SparkSession, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of windows found in two documents, and those windows."""
    rows = _placed(full)
    repeats = shared_keys(spark, rows, "window", "repeats")
    return rows.join(repeats, "window"), repeats


def _starts(spans: DataFrame, name: str = "starts") -> DataFrame:
    return spans.groupBy(*CLASS).agg(F.collect_list("at").alias(name))


def doubled_repeats(
    spark: SparkSession, texts: DataFrame, found: DataFrame, length: int
) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``high, low, longest``, and the number of classes with a repeat at each level.

    ``texts`` has ``doc_id, high, low, text`` of classes with a repeat of ``length`` words,
    ``found`` the places of those (``high, low, starts``). A window of twice the length is
    looked at only where both its halves repeat; levels follow until nothing does.
    """
    longest, levels = [], []
    while True:
        # Each row once: a class can stand in ``texts`` several times.
        n = found.count()
        if not n:
            break
        levels.append((length, n))
        longest.append(found.select(*CLASS, F.lit(length).cast("long").alias("longest")))
        length *= 2
        enough = F.size("starts") > length // 2
        full = texts.join(found.where(enough), CLASS).mapInArrow(
            _longer(length),
            "doc_id long, high long, low long, windows array<bigint>, starts array<int>",
        )
        full = stored(spark, full.where(F.size("windows") > 0), "longer")
        kept, _ = _repeated(spark, full)
        found = stored(spark, _starts(kept), "found")
    if not longest:
        none = found.select(*CLASS, F.lit(0).cast("long").alias("longest"))
        return none, levels
    every = longest[0]
    for level in longest[1:]:
        every = every.unionByName(level)
    return every.groupBy(*CLASS).agg(F.max("longest").alias("longest")), levels


def repeated_passages(
    spark: SparkSession,
    docs: DataFrame,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: every row's marks, what is left of touched classes, longest repeats.

    Marks: ``doc_id, text_key, n_words, whole_sha256, high, low`` and ``least`` (the
    smallest document with the same words). Cuts: ``high, low, n_removed, kept`` for those
    classes whose smallest document loses words. Longest: ``high, low, longest``.
    """
    if length < 2:
        raise ValueError("a window has two words at least")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("text_key"),
    )
    marks = texts.mapInArrow(
        _mark(length),
        "doc_id long, text_key long, n_words long, high long, low long, whole_sha256 string,"
        " anchors array<bigint>",
    )
    marks = stored(spark, marks, "marks")
    stands = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("s")
    same = marks.groupBy(*CLASS).agg(stands)
    same = same.select(*CLASS, F.col("s.doc_id").alias("least"), F.col("s.text_key").alias("key"))
    same = stored(spark, same, "same")
    # One row stands for a class of equal words.
    rows = marks.where(f"n_words >= {length} and doc_id is not null")
    rows = rows.join(same.withColumnRenamed("least", "doc_id"), [*CLASS, "doc_id"])
    rows = rows.where("text_key = key").dropDuplicates([*CLASS])
    rows = rows.select("doc_id", *CLASS, "key", F.explode("anchors").alias("anchor"))

    halves = shared_keys(spark, rows, "anchor", "halves")
    found = rows.join(halves, "anchor").groupBy("doc_id", "key", *CLASS)
    found = found.agg(F.collect_list("anchor").alias("anchors"))
    named = texts.withColumnRenamed("text_key", "key")
    own = found.join(named, ["doc_id", "key"]).select("doc_id", *CLASS, "text", "anchors")
    own = own.mapInArrow(
        _own_rows, "doc_id long, high long, low long, text string, anchors array<bigint>"
    )
    full = own.mapInArrow(
        _extend(length),
        "doc_id long, high long, low long, text string, windows array<bigint>, starts array<int>",
    )
    # Rows of one id and one text would each bring the text along.
    full = stored(spark, full.where(F.size("windows") > 0).dropDuplicates(CLASS), "windows")
    kept, _ = _repeated(spark, full)
    kept = stored(spark, kept.drop("window"), "repeated")
    spans = _starts(kept.where("doc_id > least"))
    cuts = full.select(*CLASS, "text").join(spans, CLASS)
    cuts = cuts.mapInArrow(_cut(length), "high long, low long, n_removed long, kept string")
    shared = full.select("doc_id", *CLASS, "text")
    longest, _ = doubled_repeats(spark, shared, stored(spark, _starts(kept), "found"), length)
    return marks.join(same, CLASS).drop("key", "anchors"), cuts, longest


def remove_repeats(
    spark: SparkSession,
    docs: DataFrame,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, text_key, n_words, n_removed, kept, whole_sha256, longest`` of every row.

    ``text_key`` is the text's ``xxhash64``. A row that loses nothing has null ``kept``;
    ``whole_sha256`` is the digest of its words. ``longest`` is the greatest of ``length``,
    twice that and so on, at which a window of the row stands in a document of other words
    too; 0 if none does.
    """
    marks, cuts, longest = repeated_passages(spark, docs, length, id_col, text_col)
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= length)
    mine = F.col("doc_id") == F.col("least")
    found = cuts.join(longest, CLASS, "full_outer")
    joined = marks.join(found, CLASS, "left")
    return joined.select(
        "doc_id",
        "text_key",
        "n_words",
        F.when(copy, F.col("n_words"))
        .when(mine, F.coalesce("n_removed", F.lit(0)))
        .otherwise(0)
        .cast("long")
        .alias("n_removed"),
        F.when(copy, F.lit("")).when(mine, F.col("kept")).alias("kept"),
        "whole_sha256",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("longest", F.lit(0)))
        .otherwise(0)
        .cast("long")
        .alias("longest"),
    )


def digests(result: DataFrame) -> DataFrame:
    own = F.sha2(F.col("kept").cast("binary"), 256)
    return result.select(
        "doc_id",
        "n_words",
        "n_removed",
        F.when(F.col("kept").isNull(), F.col("whole_sha256")).otherwise(own).alias("kept_sha256"),
        "longest",
    )
