"""Whole jobs from stored tables to stored results."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from citeweave import constants as C
from citeweave.operators import budget, consolidate, distribution, pairs, summaries
from citeweave.operators.representatives import select_representatives
from citeweave.schemas import CONSOLIDATED_COLUMNS
from citeweave.sources import sinks
from citeweave.sources.tables import read_table
from citeweave.streaming import ingest


def consolidate_job(spark: SparkSession, ingest_path: str, out_path: str) -> None:
    """Ingest output to ``papers`` (first version of each id) and ``edges``."""
    versions = ingest.ingested_versions(spark, ingest_path)
    first = consolidate.first_version(versions, ["processed_date", "batch_id", "source_file"])
    sinks.write_papers(first.select(*CONSOLIDATED_COLUMNS), f"{out_path}/papers")
    sinks.write_edges(consolidate.concept_edges(versions), f"{out_path}/edges")


def representatives_job(
    spark: SparkSession,
    tables_path: str,
    out_path: str,
    strategy: str = C.DEFAULT_STRATEGY,
    k: int = C.CLI_DEFAULT_K,
    concepts: Sequence[str] | None = None,
    context_window: int = C.DEFAULT_CONTEXT_WINDOW,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Write the chosen papers; return their token statistics and the concepts
    that exceed the context window."""
    chosen = select_representatives(
        read_table(spark, f"{tables_path}/papers"),
        read_table(spark, f"{tables_path}/edges"),
        strategy,
        k,
        concepts=concepts,
        stage=True,
        **options,
    )
    sinks.write_representatives(chosen, out_path)
    written = read_table(spark, out_path)
    checks = budget.budget_check(written, [context_window])
    return budget.token_stats(written), checks.where("exceeds_budget")


def distribution_job(spark: SparkSession, tables_path: str, out_path: str) -> dict[str, DataFrame]:
    """Write concept counts; return summary, histogram, CCDF and top concepts."""
    sinks.write_distribution(
        distribution.concept_counts(read_table(spark, f"{tables_path}/edges")), out_path
    )
    counts = spark.read.schema("concept string, paper_count bigint").option("header", True).csv(
        out_path
    )
    return {
        "describe": distribution.describe_counts(counts),
        "histogram": distribution.histogram(counts),
        "ccdf": distribution.ccdf(counts),
        "top": distribution.top_concepts(counts),
    }


def pairs_job(spark: SparkSession, tables_path: str, out_path: str) -> DataFrame:
    """Write first co-occurrences; return a preview."""
    papers = read_table(spark, f"{tables_path}/papers")
    edges = read_table(spark, f"{tables_path}/edges")
    sinks.write_pairs(pairs.first_cooccurrence(papers, edges), out_path)
    return pairs.by_first_date(read_table(spark, out_path)).limit(C.PREVIEW_ROWS)


def summaries_job(
    spark: SparkSession,
    chosen_path: str,
    out_path: str,
    make_scorer: Callable[[], summaries.Scorer],
    model: str,
    order: Sequence[str] = ("rank",),
    startup_seconds: float = 0.0,
    clock: Callable[[], float] | None = None,
) -> DataFrame:
    """Score every concept with a caller's model and write results, run and raw text.

    The model runs once: its raw responses are written first and parsed from
    there.
    """
    clock = clock or time.monotonic
    talks = summaries.concept_conversations(read_table(spark, chosen_path), order=order)
    started = clock()
    summaries.score_conversations(talks, make_scorer).write.parquet(f"{out_path}/scored")
    seconds = clock() - started
    results = summaries.parse_responses(read_table(spark, f"{out_path}/scored"))
    stats = summaries.run_stats(results, seconds, startup_seconds)
    sinks.write_summaries(results, stats, out_path, model)
    return stats
