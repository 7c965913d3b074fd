"""Importance resampling of documents towards a target's distribution of word features.

A feature is a run of 1 to ``max_words`` neighbouring words, joined by one space; its bucket
is the CRC-32 of its bytes modulo the number of buckets. Words come from a dictionary: an
Aho-Corasick automaton of the distinct words met so far, each bounded by the delimiter on
both sides, whose entries carry the word's CRC-32 and its length. A scan of a text emits the
payloads of its words in order; the CRC of a longer feature is composed from the payloads of
neighbouring words, since the CRC of a joined string follows from the parts' CRCs and the
second part's length. No string is built or hashed for a feature, and each distinct word is
hashed once for a dictionary.

Counts of all documents and of all target texts give each bucket a gain; a document's weight
is the floored mean of its features' gains, and its score adds Gumbel noise drawn from a hash
of the seed and its id, so that the highest scores are a sample without replacement.

Documents' buckets are stored as two bytes a feature (four for more buckets than that holds)
and read for the counts and for the weights. Only the counts per bucket, as many numbers as
there are buckets, reach the driver. Ranks come from sorting narrow rows by range.

Defined cases: null and empty texts, and texts without a word, have no features, weight 0 and
their noise as score. Capitals A-Z count as small letters, no others do. A null id counts as
an empty one in the noise and is last among equal scores. Rows of one id are scored and
drawn each on its own. No target texts: all target counts are 0. Other columns are not
looked at. Empty tables give an empty result. Texts may be of any length; a long one is
scanned in parts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import stored
from citeweave.operators.numbering import number_rows

# Distinct words of one automaton, bytes of texts handled together, bytes scanned at once.
DICTIONARY_WORDS = 200_000
BATCH_BYTES = 8 << 20
SCAN_BYTES = 1 << 20

_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))


def _plain_bytes() -> bytes:
    """Small letters for capitals, a space for every byte that no word has."""
    small = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
    return bytes(b if b in _WORD_BYTES else 0x20 for b in small)


_PLAIN = _plain_bytes()


def plain(text: str | None) -> str:
    """The text's words, each byte one character, with a space before and after each."""
    return f" {text.encode().translate(_PLAIN).decode('latin-1')} " if text else " "


# --- CRC composition ---------------------------------------------------------


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """32 x 32 bits, a column a word, times a bit vector each."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@lru_cache(maxsize=None)
def _shift(exponent: int) -> np.ndarray:
    """What 2 ** exponent zero bytes do to a CRC, as a matrix."""
    if exponent == 0:
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            odd = np.where(unit & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
            unit = unit >> np.uint32(1) ^ odd
        return unit
    half = _shift(exponent - 1)
    return _times(half, half)


def joined_crc(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings, from their CRCs and the lengths of the second ones."""
    out = left.copy()
    for exponent in range(int(right_length.max(initial=0)).bit_length()):
        moved = (right_length >> np.uint32(exponent) & np.uint32(1)).astype(bool)
        if moved.any():
            out[moved] = _times(_shift(exponent), out[moved])
    return out ^ right


def feature_crcs(crcs: np.ndarray, lengths: np.ndarray, max_words: int) -> np.ndarray:
    """CRCs of all runs of 1 to ``max_words`` words, shorter ones first."""
    found, run = [crcs], crcs
    space = np.uint32(zlib.crc32(b" "))
    for more in range(1, min(max_words, len(crcs))):
        one = np.ones(len(run) - 1, np.uint32)
        run = joined_crc(run[:-1], np.full(len(one), space), one)
        run = joined_crc(run, crcs[more:], lengths[more:])
        found.append(run)
    return np.concatenate(found)


# --- the dictionary ----------------------------------------------------------


class Dictionary:
    """Automaton over the words met so far; starts anew when it has grown too large."""

    def __init__(self, limit: int = DICTIONARY_WORDS):
        self.limit, self.words, self.automaton = limit, set(), None

    def learn(self, texts: list[str]) -> None:
        found = set()
        for text in texts:
            found.update(text.split(" "))
        found.discard("")
        new = found - self.words
        if not new:
            return
        if self.automaton is None or len(self.words) + len(new) > self.limit:
            self.automaton, self.words, new = ahocorasick.Automaton(), set(), found
        for word in new:
            raw = word.encode("latin-1")
            self.automaton.add_word(f" {word} ", zlib.crc32(raw) | len(raw) << 32)
        self.words |= new
        self.automaton.make_automaton()

    def payloads(self, text: str) -> np.ndarray:
        """CRC and length of each word, in order."""
        if not text.strip(" "):
            return np.empty(0, np.uint64)
        parts, start = [], 0
        while start < len(text) - 1:
            end = len(text) - 1
            if end - start > SCAN_BYTES:
                end = text.find(" ", start + SCAN_BYTES)
            emitted = map(itemgetter(1), self.automaton.iter(text[start : end + 1]))
            parts.append(np.fromiter(emitted, np.uint64))
            start = end
        return np.concatenate(parts)


def _bucket_type(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _by_bytes(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with no more than so many bytes, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > BATCH_BYTES:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _featurer(buckets: int, max_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary()
        for batch in batches:
            for start, end in _by_bytes(batch.column("text")):
                part = batch.slice(start, end - start)
                texts = [plain(t) for t in part.column("text").to_pylist()]
                dictionary.learn(texts)
                words, features = [], []
                for text in texts:
                    payloads = dictionary.payloads(text)
                    crcs = (payloads & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    lengths = (payloads >> np.uint64(32)).astype(np.uint32)
                    found = feature_crcs(crcs, lengths, max_words) % np.uint32(buckets)
                    words.append(len(crcs))
                    features.append(found.astype(_bucket_type(buckets)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        pa.array(words, pa.int64()),
                        pa.array(features, pa.binary()),
                    ],
                    names=["row", "doc_id", "n_words", "features"],
                )

    return run


def word_features(texts: DataFrame, buckets: int, max_words: int) -> DataFrame:
    """``row, doc_id, n_words, features`` (buckets as packed numbers) of ``row, doc_id, text``."""
    doc_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("row", "doc_id", "text").mapInArrow(
        _featurer(buckets, max_words),
        f"row long, doc_id {doc_type}, n_words long, features binary",
    )


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("features"):
                found = np.frombuffer(value.as_buffer(), _bucket_type(buckets))
                counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())],
            names=["bucket", "n"],
        )

    return run


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket."""
    parts = features.select("features").mapInArrow(_counter(buckets), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000-fold log ratio of a bucket's smoothed shares in target and corpus."""
    buckets, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    out = [
        math.floor(
            1000
            * math.log(
                float(t + 1)
                * float(all_corpus + buckets)
                / (float(s + 1) * float(all_target + buckets))
            )
        )
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ]
    return np.array(out, np.int64)


def noise(seed: int, doc_id: str) -> int:
    """Floored 1000-fold Gumbel noise of a document."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(shared, seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = shared.value
        for batch in batches:
            n, weights, scores = [], [], []
            names = batch.column("name").to_pylist()
            for name, value in zip(names, batch.column("features"), strict=True):
                found = np.frombuffer(value.as_buffer(), _bucket_type(buckets))
                n.append(len(found))
                weights.append(int(of_bucket[found].sum()) // len(found) if len(found) else 0)
                scores.append(weights[-1] + noise(seed, name))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    *[pa.array(x, pa.int64()) for x in (n, weights, scores)],
                ],
                names=["row", "doc_id", "n_words", "n_features", "weight", "score"],
            )

    return run


def score_documents(
    spark: SparkSession,
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10_000,
    max_words: int = 2,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight, score`` of every document."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    features = stored(spark, word_features(texts, buckets, max_words), "features")
    aims = target.select(
        F.lit(0).cast("long").alias("row"),
        F.lit(0).alias("doc_id"),
        F.col(target_col).alias("text"),
    )
    wanted = bucket_counts(word_features(aims, buckets, max_words), buckets)
    shared = spark.sparkContext.broadcast(gains(bucket_counts(features, buckets), wanted))
    doc_type = features.schema["doc_id"].dataType.simpleString()
    named = features.withColumn("name", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return named.mapInArrow(
        _scorer(shared, seed, buckets),
        f"row long, doc_id {doc_type}, n_words long, n_features long, weight long, score long",
    )


def resample(
    spark: SparkSession,
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    **options,
) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight, score, rank``; undrawn rows have no rank.

    ``percent`` of the documents with ``min_words`` words or more are drawn, those of the
    highest scores, smaller ids first among equal ones.
    """
    scored = score_documents(spark, docs, target, **options)
    can = F.col("n_words") >= min_words
    order = [
        F.desc(can),
        F.desc("score"),
        F.asc_nulls_last("doc_id"),
        F.desc("weight"),
        F.desc("n_features"),
        F.asc("row"),
    ]
    placed = number_rows(scored, order, "_number")
    drawn = percent * placed.where(can).count() // 100
    rank = F.when(can & (F.col("_number") <= drawn), F.col("_number"))
    return placed.withColumn("rank", rank).drop("_number")
