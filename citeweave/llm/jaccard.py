"""Documents joined by the Jaccard similarity of their word n-grams.

The documents-by-n-grams incidence matrix is multiplied with its transpose in blocks of
columns and of rows. Sizes bound the work: with all n-grams in one order, two sets of a
given similarity share at least s of the first |x| - ceil(t |x|) + s of either set. So the
product is first formed over those columns alone (s grows with the set, one for each 20 of
its n-grams). A share of s is spared: each set drops so many of its most frequent columns,
by the exact number of sets that have them, and as that order is one for all sets, a linked
pair still shares the rest. Overlap counts are accumulated per pair, and pairs whose sizes
differ too much or whose count stays below their bound are discarded. What remains is dealt
into tiles of rows by columns; each tile holds its sets' incidence in sparse form and
accumulates the whole overlap of its pairs.

The order puts n-grams that a fixed-size counting sketch of all documents finds frequent
last, so passages that very many documents share seldom make pairs. Documents with equal
sets are one row of the matrix (named by a 64-bit hash of the set); the rows of one
column meet as described at ``counted_components``, without all pairs of a group. The
result is exact but for collisions of 64-bit hashes.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing.
Fewer words than an n-gram make one n-gram of all of them. Rows with equal ids are
equal documents' rows or not, each is judged by its text. Rows with a null id are returned
with their size, a null class and a null component; they are linked with nothing. Other
columns are not looked at. Texts may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import (
    as_long,
    dropped,
    find_words,
    slices,
    stored,
    window_hashes,
    word_hashes,
)
from citeweave.llm.components import SKETCH, SKETCH_COLUMNS, counted_components
from citeweave.operators.semifilter import mark_possible

SKETCH_SLICES = 64
# A set must share one n-gram more of its first ones for each so many that it has.
GRAMS_PER_SHARED = 20
# Percent of those that are spared for its most frequent ones.
SPARED = 60
# N-grams per block, about.
BLOCK_GRAMS = 1_500_000


def gram_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of a text's n-grams; ASCII capitals count as small letters."""
    found = find_words(text.encode().lower().decode()) if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = word_hashes(found)
    if len(found) < words:
        whole = window_hashes(hashes, len(found)) + np.uint64(len(found))
        return whole[:1]
    return np.unique(window_hashes(hashes, words))


def set_name(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _parities(grams: np.ndarray) -> np.ndarray:
    """The set's sketch, as ``parity_sketches`` describes it."""
    cells = ((grams >> np.uint64(20)) % np.uint64(64 * SKETCH)).view(np.int64)
    odd = (np.bincount(cells, minlength=64 * SKETCH) & 1).astype(bool)
    return np.packbits(odd).view(np.int64)


def _sketcher(words: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for batch in slices(batches):
            sets = [gram_set(t, words) for t in batch.column("text").to_pylist()]
            if sets:
                at = (np.concatenate(sets) % np.uint64(cells)).view(np.int64)
                counts += np.bincount(at, minlength=cells)
        parts = np.split(counts, SKETCH_SLICES)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(SKETCH_SLICES), pa.int32()),
                pa.array([p.tobytes() for p in parts], pa.binary()),
            ],
            names=["slice", "counts"],
        )

    return run


def _merge(parts: pa.Table) -> pa.Table:
    total = None
    for value in parts.column("counts"):
        part = np.frombuffer(value.as_py(), np.int64)
        total = part.copy() if total is None else total + part
    return pa.table({"slice": parts.column("slice")[:1], "counts": [total.tobytes()]})


def gram_sketch(docs: DataFrame, words: int, cells: int) -> np.ndarray:
    """How often n-grams fall into each of ``cells`` cells; its size is fixed."""
    parts = docs.select("text").mapInArrow(_sketcher(words, cells), "slice int, counts binary")

    rows = parts.groupBy("slice").applyInArrow(_merge, "slice int, counts binary").collect()
    if not rows:
        return np.zeros(cells, np.int64)
    rows.sort(key=lambda r: r["slice"])
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])


def _prefixes(words: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in slices(batches):
            sizes, names, first, drawn = [], [], [], []
            for text in batch.column("text").to_pylist():
                grams = gram_set(text, words)
                n = len(grams)
                sizes.append(n)
                names.append(set_name(grams) if n else None)
                rank = ranks[(grams % np.uint64(len(ranks))).view(np.int64)]
                order = np.argsort(rank, kind="stable")  # equal ranks by the hash
                least = -(-percent * n // 100)
                most = n - least + min(least, 1 + n // GRAMS_PER_SHARED)
                first.append(as_long(grams[order[:most]]))
                drawn.append(_parities(grams))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array(first, pa.list_(pa.int64())),
                    pa.array(drawn, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_shingles", "class", "first", "parities"],
            )

    return run


def _product(words: int, percent: int):
    """Overlap counts of a block's pairs, row by row over its sparse incidence."""

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        at, sets = {}, []
        for name, text in zip(
            texts.column("class").to_pylist(), texts.column("text").to_pylist(), strict=True
        ):
            grams = gram_set(text, words)
            # An id that stands at several texts brings all of them along.
            if name not in at and set_name(grams) == name:
                at[name] = len(sets)
                sets.append(grams)
        if not sets or not pairs.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(columns.max() + 1, np.int64)
        members: dict[int, list[int]] = {}
        for a, b in zip(
            pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True
        ):
            members.setdefault(a, []).append(b)
        left, right = [], []
        for a, found in members.items():
            row = columns[ends[at[a]] - sizes[at[a]] : ends[at[a]]]
            mark[row] = 1
            rows = np.array([at[b] for b in found])
            held = np.concatenate([columns[ends[r] - sizes[r] : ends[r]] for r in rows])
            starts = np.cumsum(sizes[rows]) - sizes[rows]
            overlap = np.add.reduceat(mark[held], starts)
            union = len(row) + sizes[rows] - overlap
            mark[row] = 0
            for hit in np.flatnonzero(100 * overlap >= percent * union):
                left.append(a)
                right.append(found[hit])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _may_link(size: Column, other: Column, percent: int) -> Column:
    return 100 * F.least(size, other) >= percent * F.greatest(size, other)


def _shared_first(size: Column, percent: int) -> Column:
    """How many of its first n-grams a set shares with any set linked to it."""
    least = F.ceil(size * percent / 100)
    return F.least(least, 1 + F.floor(size / GRAMS_PER_SHARED))


def _spared(size: Column, percent: int) -> Column:
    """How many of its most frequent first n-grams a set does without."""
    return F.floor((_shared_first(size, percent) - 1) * SPARED / 100)


def _needed(one: Column, two: Column, percent: int) -> Column:
    """What two linked sets share at least of the n-grams that are left to them."""
    both = F.least(_shared_first(one, percent), _shared_first(two, percent))
    return F.greatest(both - F.greatest(_spared(one, percent), _spared(two, percent)), F.lit(1))


def _least(size: Column, percent: int) -> Column:
    """What a set shares at least of those n-grams with any set linked to it."""
    smaller, larger = F.ceil(size * percent / 100), F.floor(size * 100 / F.lit(percent))
    both = F.least(
        _shared_first(smaller, percent) - _spared(size, percent),
        _shared_first(size, percent) - _spared(larger, percent),
    )
    return F.greatest(both, F.lit(1))


def _verifier(texts: DataFrame, classes: DataFrame, words: int, percent: int):
    def verify(pairs: DataFrame) -> DataFrame:
        one = classes.select(F.col("class").alias("a"), F.col("n_shingles").alias("size_a"))
        two = classes.select(F.col("class").alias("b"), F.col("n_shingles").alias("size_b"))
        sized = pairs.join(one, "a").join(two, "b")
        sized = sized.where(_may_link(F.col("size_a"), F.col("size_b"), percent))
        spark = pairs.sparkSession
        sized = stored(spark, sized, "pairs")
        total = sized.agg(F.sum(F.col("size_a") + F.col("size_b"))).first()[0] or 0
        # Tiles of rows by columns: a set is in as many as the root of their number, twice.
        side = math.ceil(math.sqrt(1 + int(total) // BLOCK_GRAMS))
        row, column = (F.pmod(F.xxhash64(x), F.lit(side)) for x in "ab")
        dealt = sized.select((row * side + column).alias("block"), "a", "b")
        dealt = stored(spark, dealt, "dealt")
        needed = dealt.select("block", F.col("a").alias("class")).union(dealt.select("block", "b"))
        needed = needed.distinct().join(classes.select("class", "doc_id", "text_key"), "class")
        needed = stored(spark, needed, "needed")
        held = needed.join(texts, ["doc_id", "text_key"]).select("block", "class", "text")
        links = (
            dealt.groupBy("block")
            .cogroup(held.groupBy("block"))
            .applyInArrow(_product(words, percent), "a long, b long")
        )
        links = stored(spark, links, "links")
        dropped(spark, sized, dealt, needed)
        return links

    return verify


def similar_documents(
    spark: SparkSession,
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    sketch_cells: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, text_key, n_shingles, class, component_id`` of every document.

    ``text_key`` is the text's ``xxhash64``. ``class`` is equal for equal sets; ``component_id`` is the smallest id that links
    (similarity of ``percent`` or more) reach. Only components are given: pairs inside one
    are not all verified, so links are neither listed nor counted. The sketch takes eight bytes a cell on the
    driver and in each Python worker; more cells tell frequent n-grams of larger inputs.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("text_key"),
    )
    texts = rows.where("doc_id is not null")
    counts = gram_sketch(texts, words, sketch_cells)
    usual = max(1, 3 * int(counts.mean()))
    ranks = spark.sparkContext.broadcast((counts // usual).astype(np.int32))
    sets = rows.mapInArrow(
        _prefixes(words, percent, ranks),
        "doc_id long, text_key long, n_shingles long, class long, first array<bigint>,"
        " parities array<bigint>",
    )
    sets = stored(spark, sets.withColumn("row", F.monotonically_increasing_id()), "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("class").agg(
        F.min(F.struct("doc_id", "text_key", "row")).alias("s"),
        F.min("n_shingles").alias("n_shingles"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    classes = classes.select("class", "s.doc_id", "s.text_key", "s.row", "n_shingles", "n_rows")
    classes = stored(spark, classes, "classes")

    # One row of each class; those that are alone in their class are not moved.
    several = classes.where("n_rows > 1")
    marked = mark_possible(full, F.col("class"), several, F.col("class"), "_several")
    alone = marked.where(~F.col("_several")).select("class", "n_shingles", "first")
    chosen = marked.where("_several").join(classes.select("row"), "row", "left_semi")
    firsts = alone.unionByName(chosen.select("class", "n_shingles", "first"))
    keys = firsts.select(
        F.explode("first").alias("key"), F.col("class").alias("id"), F.col("n_shingles").alias("value")
    )
    # Never null: else joins filter one use of the keys, and they are shuffled twice.
    keys = keys.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in keys.columns])

    def sketches(ids: DataFrame) -> DataFrame:
        held = sets.join(ids.withColumnRenamed("id", "class"), "class").dropDuplicates(["class"])
        drawn = [F.col("parities")[i].alias(c) for i, c in enumerate(SKETCH_COLUMNS)]
        return held.select(F.col("class").alias("id"), *drawn)

    verify = _verifier(texts, classes, words, percent)
    found = counted_components(
        spark,
        keys,
        verify,
        lambda a, b: _may_link(a, b, percent),
        lambda a, b: _needed(a, b, percent),
        lambda size: _spared(size, percent),
        sketches,
        # Overlap o of n in both sets leaves n - 2 o; o of n - o is the percentage at least.
        lambda a, b: F.floor((a + b) * (100 - percent) / F.lit(100 + percent)),
        lambda size, low: _least(size, percent),
    )
    narrow = stored(spark, sets.drop("first", "parities", "row"), "sizes")
    dropped(spark, sets)

    grouped = classes.join(found.withColumnRenamed("id", "class"), "class", "left").select(
        "class", "doc_id", F.coalesce("component", "class").alias("component")
    )
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(spark, grouped.join(least, "component").select("class", "component_id"), "named")
    able = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    columns = ["doc_id", "text_key", "n_shingles", "class", "component_id"]
    alone = narrow.where(~able).withColumns(
        {"class": F.lit(None).cast("long"), "component_id": F.col("doc_id")}
    )
    return narrow.where(able).join(named, "class").select(*columns).unionByName(alone.select(*columns))
