"""Quality rules whose cutoffs come with a guarantee on false rejections.

Each rule rejects documents whose measure lies above a cutoff of a fixed grid. Per stratum
(language) the labelled documents, each distinct text once, are split in two by a hash of the
text. On the first half a path of ever stricter settings of all rules is laid, from none on,
each step adding the cutoff that rejects most bad documents per good one lost. On the
holdout the settings are tested along the path: one passes if, were ``risk`` or more of the
stratum's good documents rejected by it, so few rejections as seen would have at most the
chance ``doubt / strata`` (exact binomial tail; Bonferroni over strata, and no further
correction within one, since testing in a fixed order stops at the first setting that
fails). The last setting that passed is used. So with confidence 1 - ``doubt`` no stratum
loses more than ``risk`` of its good documents.

Only counts of documents per stratum, half, label and vector of exceeded cutoffs leave the
measuring; a task lays and tests the path of one stratum on them.

Defined cases: a null or empty text has no words and fails the base rules. A null stratum
is a stratum of its own, not that of ''; one without labels keeps what passes the base
rules. A text labelled more than once is good if any label says so; null labels count for
nothing. Repeated rows are judged alike. Empty tables give empty results. Further columns
stay out of the measures; texts may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import find_words, slices, stored, window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Most strata whose cutoffs are broadcast.
BROADCAST_STRATA = 10_000

# Rule: (measure, cutoffs from the mildest to the strictest).
RULES = {
    "symbols_per_word": ("try_divide(n_symbols, n_words)", (3.0, 2.0, 1.0, 0.6, 0.4, 0.3, 0.2, 0.1)),
    "repeat_share": ("try_divide(n_repeat_words, n_words)", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_line_share": ("try_divide(n_dup_lines, n_lines)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "capital_share": ("try_divide(n_capitals, word_chars)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "long_words": ("try_divide(word_chars, n_words)", (60.0, 40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0)),
    "short_words": ("try_divide(-word_chars, n_words)", (-1.2, -1.5, -1.8, -2.0, -2.2, -2.5, -2.8, -3.0)),
}
STEPS = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_capitals")


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES and EXTRA of one text."""
    if not text:
        return (0,) * 7
    words = find_words(text)
    grams = window_hashes(word_hashes(words), 3)
    covered = np.zeros(len(words) + 2, bool)
    if len(grams):
        _, kind, times = np.unique(grams, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[kind] > 1)
        for shift in range(3):
            covered[again + shift] = True
    seen, dup, filled = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANK_CHARACTERS):
            filled += 1
            dup += line in seen
            seen.add(line)
    capitals = np.frombuffer(text.encode(), np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANK_CHARACTERS)),
        sum(map(text.count, SYMBOLS)),
        dup,
        int(covered.sum()),
        filled,
        int(((capitals >= 65) & (capitals <= 90)).sum()),
    )


def _measurer(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [measure(t) for t in batch.column(text_col).to_pylist()]
            values = np.array(rows, np.int64).reshape(-1, 7).T
            at = batch.schema.get_field_index(text_col)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*columns, *map(pa.array, values)], names=[*names, *MEASURES, *EXTRA]
            )

    return run


def _stratum_key(stratum):
    """Tells null from every string."""
    return F.coalesce(F.concat(F.lit("="), stratum), F.lit("-"))


def measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """``doc_id, stratum, text_key``, the measures and ``base_failed`` of every row."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum_col).cast("string").alias("stratum"),
        F.xxhash64(text_col).alias("text_key"),
        F.col(text_col).alias("text"),
    )
    schema = f"doc_id {kind}, stratum string, text_key long, "
    schema += ", ".join(f"{name} long" for name in (*MEASURES, *EXTRA))
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return rows.mapInArrow(_measurer("text"), schema).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | repeats
    )


def chance_of_so_few(rejected: int, good: int, share: float) -> float:
    """Chance of at most ``rejected`` of ``good`` if each is rejected with ``share``."""
    if good == 0:
        return 1.0
    k = np.arange(rejected + 1)
    logs = [
        math.lgamma(good + 1) - math.lgamma(i + 1) - math.lgamma(good - i + 1) for i in k.tolist()
    ]
    terms = np.array(logs) + k * math.log(share) + (good - k) * math.log1p(-share)
    return float(min(1.0, np.exp(terms).sum()))


def exceeded(rule: str):
    """How many of the rule's cutoffs a document exceeds; the strictest ones."""
    expr, cuts = RULES[rule]
    hits = [F.coalesce(F.expr(f"{expr} > {cut!r}"), F.lit(False)).cast("int") for cut in cuts]
    return sum(hits[1:], hits[0]).alias(f"over_{rule}")


def rejected(over: np.ndarray, setting: tuple[int, ...]) -> np.ndarray:
    """Rows that a setting rejects: of rule r it uses the ``setting[r]``-th cutoff, 0 none."""
    used = np.array(setting)
    return ((used > 0) & (over > STEPS - used)).any(axis=1)


def strictness_path(over: np.ndarray, n: np.ndarray, bad: np.ndarray) -> list[tuple[int, ...]]:
    """Ever stricter settings of all rules, laid on counted vectors of exceeded cutoffs.

    A step tightens one rule by one cutoff or more: the one that rejects most bad documents
    for each good one lost; of equals the one with most bad ones, then the first rule and
    the mildest cutoff. The path ends when no step rejects another bad document.
    """
    setting, path = (0,) * over.shape[1], []
    gone = np.zeros(len(over), bool)
    while True:
        best = None
        for rule, used in enumerate(setting):
            for cutoff in range(used + 1, STEPS + 1):
                hit = (over[:, rule] > STEPS - cutoff) & ~gone
                caught, lost = int(n[hit & bad].sum()), int(n[hit & ~bad].sum())
                worth = (caught / (lost + 1), caught)
                if caught and (best is None or worth > best[0]):
                    best = (worth, rule, cutoff)
        if best is None:
            return path
        setting = tuple(best[2] if r == best[1] else c for r, c in enumerate(setting))
        gone = rejected(over, setting)
        path.append(setting)


def certified(
    path: list[tuple[int, ...]], over: np.ndarray, n: np.ndarray, bad: np.ndarray, risk: float, level: float
) -> tuple[tuple[int, ...], int, int, int]:
    """The last setting before the first that fails its test, with the numbers of good
    documents, of good ones rejected and of bad ones rejected."""
    good = int(n[~bad].sum())
    found = ((0,) * over.shape[1], good, 0, 0)
    for setting in path:
        gone = rejected(over, setting)
        lost = int(n[gone & ~bad].sum())
        if chance_of_so_few(lost, good, risk) > level:
            break
        found = (setting, good, lost, int(n[gone & bad].sum()))
    return found


def cutoffs(
    measured: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05
) -> DataFrame:
    """``stratum_key``, ``cut_<rule>`` (null: off), ``n_good, good_rejected, bad_rejected``.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad). The counts are the holdout's.
    """
    own = labels.where("doc_id is not null and quality is not null")
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = measured.where("not base_failed").join(own.select("doc_id", "quality"), "doc_id")
    over = [f"over_{rule}" for rule in RULES]
    held = held.select(
        _stratum_key(F.col("stratum")).alias("stratum_key"),
        "text_key",
        "quality",
        *[exceeded(rule) for rule in RULES],
    )
    # Each distinct text counts once, however often it stands.
    texts = held.groupBy("stratum_key", "text_key", *over).agg(F.max("quality").alias("quality"))
    counted = texts.groupBy(
        "stratum_key",
        (F.pmod(F.xxhash64("text_key", F.lit("half")), F.lit(2)) == 0).alias("holdout"),
        (F.col("quality") == 0).alias("bad"),
        *over,
    ).agg(F.count(F.lit(1)).alias("n"))
    strata = texts.select("stratum_key").distinct().count()
    level = doubt / max(1, strata)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["holdout", "bad", *over])
        parts = []
        for half in (False, True):
            part = frame[frame["holdout"] == half]
            parts.append((part[over].to_numpy(), part["n"].to_numpy(), part["bad"].to_numpy(bool)))
        path = strictness_path(*parts[0])
        setting, good, lost, caught = certified(path, *parts[1], risk, level)
        cuts = [
            RULES[rule][1][used - 1] if used else None
            for rule, used in zip(RULES, setting, strict=True)
        ]
        row = [frame["stratum_key"].iloc[0], *cuts, good, lost, caught]
        return pd.DataFrame([row], columns=columns)

    columns = ["stratum_key", *[f"cut_{r}" for r in RULES], "n_good", "good_rejected", "bad_rejected"]
    schema = "stratum_key string, " + ", ".join(f"cut_{r} double" for r in RULES)
    schema += ", n_good long, good_rejected long, bad_rejected long"
    return counted.groupBy("stratum_key").applyInPandas(choose, schema)


def judge(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    risk: float = 0.02,
    doubt: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and ``failed_rules`` of every document."""
    measured = stored(spark, measures(docs, id_col, text_col, stratum_col), "measures")
    used = stored(spark, cutoffs(measured, labels, risk, doubt), "cutoffs")
    wide = used.select("stratum_key", *[f"cut_{r}" for r in RULES])
    if used.count() <= BROADCAST_STRATA:
        wide = F.broadcast(wide)
    failed = F.array_compact(
        F.array(
            *(
                F.when(F.expr(f"{expr} > cut_{rule}"), F.lit(rule))
                for rule, (expr, _) in RULES.items()
            )
        )
    )
    rules = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed)
    keyed = measured.withColumn("stratum_key", _stratum_key(F.col("stratum")))
    out = keyed.join(wide, "stratum_key", "left").withColumn("failed_rules", rules)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return out.select(
        "doc_id", "stratum", "text_key", *MEASURES, "base_failed", kept.alias("kept"), "failed_rules"
    )
