"""Quality classifier: naive Bayes log-count ratios and a linear hinge loss.

A text's features are its distinct hashed word 1-grams and 2-grams, the symbols its words
end in, and coarse shares (distinct words, capitals, symbols). Each indicator is scaled by
the log of the ratio of its smoothed class counts, and a linear model of hinge loss is
fitted by dual coordinate descent; a logistic curve on unseen margins makes the score. Training
reads at most ``train_rows`` labelled rows, those with the smallest hashes of their id;
scores are computed for every row.

Defined cases: a null or empty text has no features and gets the score of the bias.
Labels that are null or of unknown documents are ignored; a document labelled twice
counts twice. With labels of one class only, or none, all scores are that class's share,
or 0.5. Equal texts get equal scores. Other columns are never read. Empty tables give
empty results; texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import find_words, mixed, slices, word_hashes

BUCKETS = 1 << 18


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text."""
    words = find_words(text) if text else []
    if not words:
        return np.empty(0, np.int64)
    hashes = word_hashes(words)
    pairs = mixed(hashes[:-1], hashes[1:])
    # How the text is written: word ends, capitals, and how much of it is repeated.
    raw = np.frombuffer(text.encode(), np.uint8)
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    symbols = int(((raw > 32) & (raw < 48)).sum())
    shares = [
        ("distinct", 20 * len(np.unique(hashes)) // len(words)),
        ("pairs", 20 * len(np.unique(pairs)) // max(1, len(pairs))),
        ("capitals", 20 * capitals // len(raw)),
        ("symbols", 20 * symbols // len(raw)),
    ]
    ends = {w[-2:] for w in words if not w[-1].isalnum()}
    marks = [xxhash.xxh3_64_intdigest(f"{k}\x00{v}") for k, v in shares]
    marks += [xxhash.xxh3_64_intdigest(f"end\x00{e}") for e in ends]
    every = np.concatenate([hashes, pairs, np.array(marks, np.uint64)])
    return np.unique(every % np.uint64(BUCKETS)).view(np.int64)


def count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the ratio of a bucket's shares in the two classes."""
    counts = np.full((2, BUCKETS), smooth)
    for row, label in zip(rows, labels, strict=True):
        counts[int(label), row] += 1
    counts /= np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None] + 2 * smooth
    return np.log(counts[1]) - np.log(counts[0])


def dual_coordinate_descent(
    rows: list[np.ndarray],
    values: list[np.ndarray],
    labels: np.ndarray,
    cost: float = 1.0,
    rounds: int = 12,
    seed: int = 7,
) -> np.ndarray:
    """Weights (the last one the bias) where the hinge loss with a squared norm is least."""
    sign = np.where(labels > 0, 1.0, -1.0)
    weights, alpha = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    # Both classes weigh the same in all.
    share = len(rows) / (2 * np.array([(labels == 0).sum(), (labels == 1).sum()]))
    limit = cost * share[labels.astype(int)]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in random.permutation(len(rows)):
            slope = sign[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1
            step = min(max(alpha[i] - slope / norm[i], 0.0), limit[i]) - alpha[i]
            if step:
                alpha[i] += step
                weights[rows[i]] += step * sign[i] * values[i]
                weights[-1] += step * sign[i]
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return weights


def platt(margins: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, label), by Newton steps."""
    slope, offset = 1.0, 0.0
    high, low = (labels.sum() + 1) / (labels.sum() + 2), 1 / ((labels == 0).sum() + 2)
    target = np.where(labels > 0, high, low)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        w, g = p * (1 - p) + 1e-9, p - target
        h = np.array([[w @ (margins**2), w @ margins], [w @ margins, w.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), [g @ margins, g.sum()])
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def fit_linear(
    rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float
) -> tuple[np.ndarray, float]:
    """Weights per bucket with the curve's slope and scale in them, and the offset.

    The curve is fitted on margins of a model that has not seen those rows.
    """
    values = [scaled(row, ratios) for row in rows]
    own, other = [], []
    for i in range(len(rows)):
        (other if i % 4 == 0 else own).append(i)
    slope, offset = 1.0, 0.0
    if len(set(labels[own])) == 2 and len(set(labels[other])) == 2:
        part = dual_coordinate_descent(
            [rows[i] for i in own], [values[i] for i in own], labels[own], cost
        )
        margins = np.array([part[rows[i]] @ values[i] + part[-1] for i in other])
        slope, offset = platt(margins, labels[other])
    weights = dual_coordinate_descent(rows, values, labels, cost)
    return slope * weights[:-1] * ratios, slope * weights[-1] + offset


def scaled(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """A row's log-count ratios, over the root of how many it has."""
    return ratios[row] / np.sqrt(max(1, len(row)))


def scorer(
    shared, find: Callable[[str | None], np.ndarray], by_root: bool, id_col: str, text_col: str
) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = shared.value
        for batch in slices(batches):
            margins = []
            for text in batch.column(text_col).to_pylist():
                row = find(text)
                root = np.sqrt(max(1, len(row))) if by_root else 1.0
                margins.append(weights[row].sum() / root + offset)
            scores = 1 / (1 + np.exp(-np.clip(np.array(margins, float), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return run


def score_rows(
    spark: SparkSession,
    docs: DataFrame,
    model: tuple[np.ndarray, float],
    find: Callable[[str | None], np.ndarray],
    id_col: str,
    text_col: str,
    by_root: bool = True,
) -> DataFrame:
    """``doc_id, score, predicted`` of every row under a model over feature buckets."""
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]
    scores = docs.select(id_col, text_col).mapInArrow(
        scorer(shared, find, by_root, id_col, text_col), f"doc_id {kind}, score double"
    )
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    rows: int,
    id_col: str,
    text_col: str,
) -> DataFrame:
    """``_id, label, text`` of at most ``rows`` labels, those with the smallest hashes."""
    own = labels.where(F.col(label).isin(0, 1) & learn).select(
        F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")
    )
    chosen = own.orderBy(F.xxhash64("_id"), "_id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return texts.join(chosen, "_id")


def featured(frame: DataFrame, find: Callable[[str | None], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [find(t).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))],
                names=["_id", "label", "features"],
            )

    kind = dict(frame.dtypes)["_id"]
    return frame.select("_id", "label", "text").mapInArrow(
        run, f"_id {kind}, label int, features array<int>"
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    train_rows: int = 6_000,
    cost: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[np.ndarray, float]:
    """A model from at most ``train_rows`` of the labels that ``learn`` admits."""
    sample = labelled_sample(docs, labels, label, learn, train_rows, id_col, text_col)
    found = featured(sample, features).toPandas()
    # The order must not depend on the partitions.
    found = found.sort_values(["_id", "label"], kind="stable")
    rows = [np.asarray(r, np.int64) for r in found["features"]]
    y = found["label"].to_numpy(np.int64)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    return fit_linear(rows, y, count_ratios(rows, y), cost)


def score(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    train_rows: int = 6_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, score, predicted`` of every text, learnt from the rows ``learn`` admits."""
    model = fit(docs, labels, label, learn, train_rows, id_col=id_col, text_col=text_col)
    return score_rows(spark, docs, model, features, id_col, text_col)
