"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Lexicons of words and patterns of word beginnings are gathered from labelled rows that may
be learnt from and dealt into many voters, each of which votes toxic or abstains; others
vote clean or abstain. From the votes and the share of toxic rows alone, not the labels, a
generative model estimates by expectation maximisation how often each voter votes under
either label and, from what the votes still have in common given the label, how correlated
voters are; correlated voters share their weight. A
logistic linear classifier over hashed words and beginnings is trained on its posterior
labels and scores every text. Training reads at most ``train_rows`` labelled rows, those
with the smallest hashes of their id.

Defined cases: a null or empty text has no features and gets the score of the bias.
Null labels and labels of unknown documents are ignored; a document labelled twice
counts twice. With labels of one class only, or none, every score is that class's share,
or 0.5. Equal texts get equal scores. Other columns are never read. Empty tables give
empty results; texts may be of any length.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

from citeweave.llm import nbsvm

BUCKETS = 1 << 20
GROUPS = 6
KINDS = ("word", "begin4", "begin5", "begin6")
_WORDS = re.compile(r"[^\W\d_]+")
_KIND_SIZE = BUCKETS // len(KINDS)


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's words and of their beginnings; each kind has its own."""
    words = set(_WORDS.findall(text.lower())) if text else set()
    digest = xxhash.xxh3_64_intdigest
    out = []
    for at, size in enumerate((None, 4, 5, 6)):
        kind = words if size is None else {w[:size] for w in words if len(w) >= size}
        out.append(np.fromiter(map(digest, kind), np.uint64, len(kind)) % np.uint64(_KIND_SIZE))
        out[-1] += np.uint64(at * _KIND_SIZE)
    return np.unique(np.concatenate(out)).view(np.int64)


def class_counts(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Weighted documents per class and bucket."""
    counts = np.zeros((2, BUCKETS))
    for row, share in zip(rows, toxic, strict=True):
        counts[1, row] += share
        counts[0, row] += 1 - share
    return counts


def log_ratios(
    rows: list[np.ndarray], toxic: np.ndarray, least: int = 5, share: float = 0.02
) -> np.ndarray:
    """Log ratio of smoothed shares in the classes.

    It is 0 for buckets of fewer than ``least`` documents or ``share`` of the toxic ones,
    which long texts hit by chance.
    """
    counts = class_counts(rows, toxic)
    least = max(least, share * toxic.sum())
    ratio = np.log((counts[1] + 1) / (toxic.sum() + 2))
    ratio -= np.log((counts[0] + 1) / ((1 - toxic).sum() + 2))
    return np.where(counts.sum(axis=0) >= least, ratio, 0.0)


def voters(rows: list[np.ndarray], ratios: np.ndarray, strong: float = 3.0) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 none) per text and voter.

    Toxic voters: per kind of feature ``GROUPS`` lexicons, and one for two strong features.
    Clean voters: per kind, for texts without any feature of more than half the strength.
    """
    toxic = np.flatnonzero(ratios >= strong)
    lexicon = np.full(BUCKETS, -1, np.int64)
    lexicon[toxic] = toxic // _KIND_SIZE * GROUPS + toxic % _KIND_SIZE % GROUPS
    votes = np.zeros((len(rows), len(KINDS) * (GROUPS + 1) + 1), np.int64)
    for i, row in enumerate(rows):
        hits = lexicon[row]
        votes[i, hits[hits >= 0]] = 1
        votes[i, len(KINDS) * GROUPS] = int((hits >= 0).sum() >= 2)
        weak = row[ratios[row] >= strong / 2] // _KIND_SIZE
        for kind in range(len(KINDS)):
            votes[i, len(KINDS) * GROUPS + 1 + kind] = -int(not (weak == kind).any())
    return votes


def majority(votes: np.ndarray) -> np.ndarray:
    """Share of toxic votes among a text's votes; a half where none is cast."""
    cast = np.maximum((votes != 0).sum(axis=1), 1)
    return 0.5 + 0.5 * votes.sum(axis=1) / cast


def voter_report(votes: np.ndarray, toxic: np.ndarray) -> list[tuple[float, float]]:
    """Per voter the share of texts that it votes on, and the share of those it is right on."""
    out = []
    for vote in votes.T:
        cast = vote != 0
        right = (vote[cast] > 0) == (toxic[cast] > 0)
        out.append((float(cast.mean()), float(right.mean()) if cast.any() else 0.0))
    return out


def label_model(
    votes: np.ndarray, balance: float, rounds: int = 50
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic per text, vote shares per label and voter, and correlations.

    It sees votes and the share of toxic texts, ``balance``, not which they are; the first
    guess is the votes' majority. Every other round the correlations of
    the votes given the label are worked out anew; a voter's evidence is divided by the sum of its
    correlations with all.
    """
    posterior = np.clip(majority(votes), 0.02, 0.98)
    outcomes = [votes == v for v in (-1, 0, 1)]
    weight, related = np.ones(votes.shape[1]), np.eye(votes.shape[1])
    for turn in range(rounds):
        classes = np.stack([1 - posterior, posterior])
        shares = np.stack([(classes @ o + 0.5) for o in outcomes], axis=2)
        shares /= shares.sum(axis=2, keepdims=True)
        if turn % 2 == 0:
            expected = (shares[:, :, 2] - shares[:, :, 0]).T @ classes
            rest = votes - expected.T
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            related = np.clip(rest.T @ rest / len(votes) / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(related, 1.0)
            weight = 1 / related.sum(axis=0)
        logs = np.log(shares)
        evidence = np.zeros((2, len(votes)))
        for at, outcome in enumerate(outcomes):
            evidence += (logs[:, :, at] * weight) @ outcome.T
        odds = np.log(balance / (1 - balance)) + evidence[1] - evidence[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-6:
            break
    return posterior, shares, related


def logistic(
    rows: list[np.ndarray], target: np.ndarray, ratios: np.ndarray, rounds: int = 400
) -> tuple[np.ndarray, float]:
    """Weights per bucket and bias for soft labels, over buckets that tell the classes apart."""
    kept = [row[np.abs(ratios[row]) >= 2.0] for row in rows]
    used = np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)
    sizes = np.array([len(k) for k in kept])
    at = np.searchsorted(used, np.concatenate(kept)) if len(used) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    scale = np.abs(ratios[used])
    weights, bias = np.sign(ratios[used]) * 0.1, -1.0
    balance = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()),
                       0.5 / max(1, (target < 0.5).sum())) * len(rows)
    past, past_bias = np.full(len(used), 1e-3), 1e-3
    for _ in range(rounds):
        margin = np.bincount(owner, weights[at] * scale[at], len(rows)) + bias
        gap = balance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) / len(rows)
        slope = np.bincount(at, gap[owner] * scale[at], len(used)) + 1e-4 * weights
        past, past_bias = past + slope**2, past_bias + gap.sum() ** 2
        weights -= 0.1 * slope / np.sqrt(past)
        bias -= 0.1 * gap.sum() / np.sqrt(past_bias)
    out = np.zeros(BUCKETS)
    out[used] = weights * scale
    return out, float(bias)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    train_rows: int = 6_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[np.ndarray, float]:
    """A model from at most ``train_rows`` of the labels that ``learn`` admits."""
    sample = nbsvm.labelled_sample(docs, labels, "toxic", learn, train_rows, id_col, text_col)
    found = nbsvm.featured(sample, features).toPandas()
    # The order must not depend on the partitions.
    found = found.sort_values(["_id", "label"], kind="stable")
    rows = [np.asarray(r, np.int64) for r in found["features"]]
    y = found["label"].to_numpy(float)
    if len(set(y)) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    posterior, _, _ = label_model(voters(rows, log_ratios(rows, y)), float(y.mean()))
    return logistic(rows, posterior, log_ratios(rows, posterior))


def score(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    train_rows: int = 6_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, score, predicted`` of every text, learnt from the rows ``learn`` admits."""
    model = fit(docs, labels, learn, train_rows, id_col, text_col)
    return nbsvm.score_rows(spark, docs, model, features, id_col, text_col, by_root=False)
