"""Benchmark passages found in documents by a prefix-filtered join of shingles.

An item's windows are its runs of ``window`` neighbouring words (all of its words, if it has
fewer). A window stands in a document only if all shingles of the window, runs of three
words, do; with the shingles ordered from rare to frequent, the shortest prefix that must be
shared is the rarest one alone. So each window is joined at its rarest shingle: a document's
place with that shingle says where the window would begin and end, which must lie within the
document (the positional and the length bound), and then its words are compared one by one
with the document's words there. What counts as rare is told by the number of places that a
shingle has in all documents.

Everything is Spark SQL functions. Texts are brought into one form once and written, with a
row number, into the shared folder; counting and joining read that. Document words meet the
benchmark's shingles in the same task that reads them: 64-bit hashes of shingles are only
looked up, equality is settled on the words. The benchmark's side is measured; up to
``broadcast_bytes`` it is broadcast, and documents are not shuffled at all. Beyond it, places
of documents whose hash may be in the benchmark (a bitmap of its hashes, of fixed size, is
broadcast first) are shuffled by hash, and the words of candidates are fetched by row.

Defined cases: null texts have no words. An item without a word has no window, one with a
null id marks words but is neither counted nor listed. Every row of the documents is judged
on its own, whatever its id, and returned. Words are compared after A-Z became small.
Repeated items and windows are joined once. Other columns are not looked at. Empty tables
are legal on either side. Texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.llm.common import stored

SHINGLE = 3
BROADCAST_BYTES = 32 << 20
# Bits of the bitmap of benchmark hashes: a million longs at most are broadcast.
CELLS = 1 << 26
NOT_IN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(text: Column) -> Column:
    """The words of a text, A-Z made small, joined by one space each."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    small = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, CAPITALS, CAPITALS.lower())
    )
    return F.trim(F.regexp_replace(small, NOT_IN_WORDS, " "))


def words_of(form: Column) -> Column:
    return F.when(form == "", F.array().cast("array<string>")).otherwise(F.split(form, " "))


def _hash(words: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` words from the 0-based place on; the length counts too."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(length)], F.lit(length))


def windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """``item_id, words``: distinct windows of every item."""
    words = words_of(plain(F.col(text_col)))
    lists = items.select(F.col(id_col).alias("item_id"), words.alias("_words"))
    lists = lists.where(F.size("_words") > 0)
    length = F.least(F.size("_words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("_words") - length + 1)
    return lists.select(
        "item_id", F.explode(starts).alias("_start"), "_words", length.alias("_length")
    ).select("item_id", F.slice("_words", F.col("_start"), F.col("_length")).alias("words")).distinct()


def _shingled(found: DataFrame) -> DataFrame:
    """``words, at, length, key``: the shingles of distinct windows."""
    length = F.least(F.size("words"), F.lit(SHINGLE))
    rows = found.select(
        "words",
        length.alias("length"),
        F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("at"),
    )
    key = F.coalesce(
        *[F.when(F.col("length") == n, _hash(F.col("words"), F.col("at"), n)) for n in range(1, SHINGLE + 1)]
    )
    return rows.withColumn("key", key)


def _places(forms: DataFrame, lengths: list[int], columns: list[str]) -> DataFrame:
    """``at, key`` and the given columns for each place of each document's shingles."""
    listed = forms.where("n_words > 0").select(*columns, words_of(F.col("form")).alias("doc_words"))
    placed = listed.select("*", F.posexplode("doc_words").alias("at", "_word"))
    size = F.size("doc_words")
    parts = []
    for length in lengths:
        key = _hash(F.col("doc_words"), F.col("at"), length)
        parts.append(placed.where(F.col("at") <= size - length).select(*columns, "doc_words", "at", key.alias("key")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _small(frame: DataFrame, limit: int) -> DataFrame | None:
    """The frame marked for a broadcast, if its measured size allows it."""
    width = F.lit(48)
    if "words" in frame.columns:
        width = width + F.octet_length(F.array_join("words", " ")) + 24 * F.size("words")
    size = frame.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(frame) if size <= limit else None


def _held_cells(keys: DataFrame) -> DataFrame:
    """A bitmap of the keys' cells, 64 to a row: ``cell_word, bits``, of a fixed size at most."""
    cell = F.pmod(F.col("key"), F.lit(CELLS))
    one = F.expr("shiftleft(1L, cast(cell % 64 as int))")
    return (
        keys.select(cell.alias("cell"))
        .groupBy(F.shiftright("cell", 6).alias("cell_word"))
        .agg(F.bit_or(one).alias("bits"))
    )


def _maybe_held(places: DataFrame, keys: DataFrame) -> DataFrame:
    """Places whose cell holds a key of the benchmark."""
    cell = F.pmod(F.col("key"), F.lit(CELLS))
    placed = places.withColumns({"cell": cell, "cell_word": F.shiftright(cell, 6)})
    held = placed.join(F.broadcast(_held_cells(keys)), "cell_word")
    one = F.expr("shiftright(bits, cast(cell % 64 as int)) & 1 = 1")
    return held.where(one).drop("cell", "cell_word", "bits")


def _counted(forms: DataFrame, keys: DataFrame, lengths: list[int], limit: int) -> DataFrame:
    """``key, n``: how many places of all documents have a shingle."""
    places = _places(forms, lengths, []).select("key")
    small = _small(keys, limit)
    if small is not None:
        found = places.join(small, "key", "left_semi")
        return found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # Counted before the join, so that a frequent shingle is one row of a task.
    counts = _maybe_held(places, keys).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(keys, "key", "left_semi")


def _prefixes(shingled: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, before, words``: each window that can occur, at its rarest shingle."""
    ranked = shingled.join(counts, "key", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("at"), F.col("key")))
    best = ranked.groupBy("words").agg(rarest.alias("best")).where("best.n > 0")
    return best.select(F.col("best.key").alias("key"), F.col("best.at").alias("before"), "words")


def _hits(forms: DataFrame, prefixes: DataFrame, lengths: list[int], limit: int) -> DataFrame:
    """``row, start, length, window``: every occurrence of every window, once."""
    start = F.col("at") - F.col("before")
    inside = (start >= 0) & (start + F.size("words") <= F.size("doc_words"))
    same = F.slice("doc_words", start + 1, F.size("words")) == F.col("words")
    small = _small(prefixes, limit)
    if small is not None:
        met = _places(forms, lengths, ["row"]).join(small, "key")
    else:
        # Only places and hashes are shuffled; the words are fetched by row.
        places = _places(forms, lengths, ["row"]).select("row", "at", "key")
        places = _maybe_held(places, prefixes.select("key").distinct())
        met = places.join(prefixes, "key")
        texts = forms.select("row", words_of(F.col("form")).alias("doc_words"))
        met = met.join(texts, "row")
    return met.where(inside).where(same).select(
        "row",
        start.alias("start"),
        F.size("words").alias("length"),
        _window_id(F.col("words")).alias("window"),
    )


def _window_id(words: Column) -> Column:
    return F.unhex(F.md5(F.array_join(words, " ")))


def _hit_words(hits: DataFrame) -> DataFrame:
    """``row, n_hit``: words under the union of a document's spans."""
    end = F.col("start") + F.col("length")
    earlier = W.partitionBy("row").orderBy("start", "length")
    earlier = earlier.rowsBetween(W.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(earlier), F.lit(0))
    new = F.greatest(F.lit(0), end - F.greatest("start", "reached"))
    spans = hits.select("row", "start", "length").distinct().withColumn("reached", reached)
    return spans.groupBy("row").agg(F.sum(new).cast("long").alias("n_hit"))


def _hit_items(hits: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """``row, n_items, items``: ids as sorted strings."""
    named = found.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item"), _window_id(F.col("words")).alias("window")
    )
    size = named.agg(F.sum(F.octet_length("item") + 64)).first()[0] or 0
    named = F.broadcast(named) if size <= limit else named
    rows = hits.select("row", "window").distinct().join(named, "window")
    rows = rows.select("row", "item").distinct()
    return rows.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("items")
    )


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items`` of every document.

    ``n_hit`` words are inside an occurrence of a window; ``items`` are the ids of the items
    whose windows occur, as strings in order.
    """
    forms = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        plain(F.col(text_col)).alias("form"),
    )
    spaces = F.octet_length("form") - F.octet_length(F.replace("form", F.lit(" "), F.lit("")))
    n_words = F.when(F.col("form") == "", 0).otherwise(spaces + 1).cast("long")
    forms = stored(spark, forms.withColumn("n_words", n_words), "forms")

    found = stored(spark, windows(items, window, item_id_col, item_text_col), "windows")
    shingled = _shingled(found.select("words").distinct())
    # As many lengths as a shingle has words, at most.
    lengths = sorted(r["length"] for r in shingled.select("length").distinct().collect())
    counted = forms.select("row", "doc_id", "n_words")
    if not lengths:
        none = F.array().cast("array<string>").alias("items")
        zero = F.lit(0).cast("long")
        return counted.drop("row").select("*", zero.alias("n_hit"), zero.alias("n_items"), none)
    keys = shingled.select("key").distinct()
    counts = stored(spark, _counted(forms, keys, lengths, broadcast_bytes), "counts")
    prefixes = stored(spark, _prefixes(shingled, counts), "prefixes")
    hits = stored(spark, _hits(forms, prefixes, lengths, broadcast_bytes), "hits")
    out = counted.join(_hit_words(hits), "row", "left").join(
        _hit_items(hits, found, broadcast_bytes), "row", "left"
    )
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
