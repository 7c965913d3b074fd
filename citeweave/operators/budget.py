"""Do the chosen papers fit a model's context window?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave import constants as C
from citeweave.functions.text import estimated_tokens


def tokens_per_concept(chosen: DataFrame) -> DataFrame:
    """Papers, tokens in all and tokens of the largest paper, per concept."""
    tokens = estimated_tokens("title", "abstract")
    return chosen.groupBy("concept").agg(
        F.count(F.lit(1)).alias("n_papers"),
        F.sum(tokens).alias("total_tokens"),
        F.max(tokens).alias("max_tokens_per_paper"),
    )


def token_stats(chosen: DataFrame) -> DataFrame:
    """One row about all chosen papers and concepts.

    The median comes from token-count frequencies, whose number is bounded by
    the longest text; the rest from the per-concept sums.
    """
    tokens = estimated_tokens("title", "abstract")
    freq = chosen.groupBy(tokens.alias("tokens")).agg(F.count(F.lit(1)).alias("n"))
    median = freq.agg(F.percentile("tokens", F.lit(0.5), F.col("n")).alias("m"))
    papers, total = F.sum("n_papers"), F.sum("total_tokens")
    concepts = F.count("concept")
    return (
        tokens_per_concept(chosen)
        .agg(
            F.coalesce(papers, F.lit(0)).alias("total_papers"),
            concepts.alias("total_concepts"),
            (total / papers).alias("avg_tokens_per_paper"),
            F.max("max_tokens_per_paper").alias("max_tokens_per_paper"),
            total.alias("total_tokens"),
            F.when(concepts > 0, papers / concepts).otherwise(0.0).alias("papers_per_concept"),
            F.avg("total_tokens").alias("avg_tokens_per_concept"),
            F.max("total_tokens").alias("max_tokens_per_concept"),
        )
        .withColumn("median_tokens_per_paper", median.select("m").scalar())
    )


def recommend_k(
    windows: DataFrame,
    window_col: str = "context_window",
    reserve_tokens: int = C.RESERVED_TOKENS,
) -> DataFrame:
    """Add the tokens left for papers and the k that fits for three paper lengths."""
    available = F.col(window_col) - F.lit(reserve_tokens)
    return windows.withColumn("available_tokens", available.cast("bigint")).withColumns(
        {
            f"k_{length}": F.floor(available / F.lit(tokens))
            for length, tokens in C.TOKENS_PER_PAPER.items()
        }
    )


def budget_check(
    chosen: DataFrame,
    windows: list[int] | None = None,
    reserve_tokens: int = C.RESERVED_TOKENS,
) -> DataFrame:
    """Per concept and context window: do the concept's papers exceed the budget?"""
    sizes = F.array(*[F.lit(w).cast("bigint") for w in windows or C.CONTEXT_WINDOWS])
    each = tokens_per_concept(chosen).withColumn("context_window", F.explode(sizes))
    return recommend_k(each, "context_window", reserve_tokens).withColumn(
        "exceeds_budget", F.col("total_tokens") > F.col("available_tokens")
    )
