"""From chosen papers to model conversations, and from responses to results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave import constants as C
from citeweave.functions.prompts import conversation, left_out, summary_prompt
from citeweave.functions.responses import (
    clean_response,
    has_error_key,
    is_json_object,
    object_text,
)
from citeweave.operators.numbering import number_rows
from citeweave.operators.ranking import top_k
from citeweave.schemas import RAW_RESPONSE, SUMMARY


def papers_of_concepts(
    chosen: DataFrame, n: int = C.PROMPT_PAPERS, order: Sequence[str] = ("rank",)
) -> DataFrame:
    """The first ``n`` papers of every concept as an ordered array of structs.

    Only those n rows per concept are gathered. For tiled strategies put the
    tile first in ``order``.
    """
    by = [F.asc_nulls_last(c) for c in order] + [F.asc("paper_id")]
    first = top_k(chosen, ["concept"], by, n, "paper_id", "_place")
    paper = F.struct(
        "_place",
        "title",
        "abstract",
        F.col("publication_year").alias("year"),
        F.col("cited_by_count").alias("citations"),
    )
    gathered = first.groupBy("concept").agg(F.array_sort(F.collect_list(paper)).alias("papers"))
    return gathered.select(
        "concept", F.transform("papers", lambda p: p.dropFields("_place")).alias("papers")
    )


def concept_prompts(
    chosen: DataFrame,
    n: int = C.PROMPT_PAPERS,
    order: Sequence[str] = ("rank",),
    title_chars: int | None = C.PROMPT_TITLE_CHARS,
    abstract_chars: int | None = C.PROMPT_ABSTRACT_CHARS,
) -> DataFrame:
    """concept, prompt, and how many characters the cuts of titles and abstracts left out."""
    cuts = (title_chars, abstract_chars)
    return papers_of_concepts(chosen, n, order).select(
        "concept",
        summary_prompt("concept", "papers", *cuts).alias("prompt"),
        left_out("papers", *cuts).alias("chars_left_out"),
    )


def concept_conversations(
    chosen: DataFrame, n: int = C.PROMPT_PAPERS, order: Sequence[str] = ("rank",), **cuts
) -> DataFrame:
    """concept, conversation: array of (role, content) with system and user message."""
    return concept_prompts(chosen, n, order, **cuts).select(
        "concept", conversation(F.col("prompt")).alias("conversation")
    )


Scorer = Callable[[pd.Series], pd.DataFrame]


def score_conversations(conversations: DataFrame, make_scorer: Callable[[], Scorer]) -> DataFrame:
    """Run a caller's model over all conversations, batch by batch.

    ``make_scorer`` is called once per task, so that a model is loaded once; the
    scorer takes a batch of conversations and returns raw_response,
    tokens_generated and finish_reason, one row per conversation in order.
    Results stay keyed by concept.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            out = scorer(batch["conversation"]).reset_index(drop=True)
            if len(out) != len(batch):
                raise ValueError(f"scorer gave {len(out)} rows for {len(batch)} conversations")
            out.insert(0, "concept", batch["concept"].to_numpy())
            yield out[RAW_RESPONSE.fieldNames()]

    return conversations.select("concept", "conversation").mapInPandas(score, RAW_RESPONSE)


def parse_responses(raw: DataFrame, column: str = "raw_response") -> DataFrame:
    """Add parse_ok, response (JSON text) and summary (its seven known keys).

    A response that holds no single JSON object becomes an object with ``error``
    and the cleaned text as ``raw``. A parsed object with an ``error`` key of its
    own is kept but counts as failed.
    """
    found = (
        raw.withColumn("_cleaned", clean_response(column))
        .withColumn("_object", object_text("_cleaned"))
        .withColumn("_parsed", F.coalesce(is_json_object("_object"), F.lit(False)))
    )
    failure = F.to_json(
        F.struct(F.lit(C.PARSE_FAILURE).alias("error"), F.col("_cleaned").alias("raw"))
    )
    return (
        found.withColumn("parse_ok", F.col("_parsed") & ~has_error_key("_object"))
        .withColumn("response", F.when(F.col("_parsed"), F.col("_object")).otherwise(failure))
        .withColumn("summary", F.when(F.col("_parsed"), F.from_json("_object", SUMMARY)))
        .drop("_cleaned", "_object", "_parsed")
    )


def number_by_concept(results: DataFrame, id_col: str = "id") -> DataFrame:
    """Add 0-based numbers in order of concept (concepts are unique here).

    Rows are sorted by ranges of the concept, however its names are spread, so no task
    sees all rows.
    """
    numbered = number_rows(results, [F.asc_nulls_first("concept")], id_col)
    return numbered.withColumn(id_col, F.col(id_col) - 1)


def run_stats(
    results: DataFrame, generation_seconds: float, startup_seconds: float = 0.0
) -> DataFrame:
    """One row of counts, tokens and rates for a parsed run. Empty runs give zeros."""
    n, seconds = F.col("concepts_processed"), F.lit(float(generation_seconds))
    tokens = F.col("total_tokens_generated")
    counted = results.agg(
        F.count(F.lit(1)).alias("concepts_processed"),
        F.coalesce(F.sum("tokens_generated"), F.lit(0)).cast("bigint").alias(
            "total_tokens_generated"
        ),
        F.count_if("parse_ok").alias("json_parse_ok"),
        F.count_if(~F.col("parse_ok")).alias("json_parse_failed"),
    )
    return counted.select(
        n,
        tokens,
        F.round(seconds, 2).alias("generation_seconds"),
        F.when(seconds > 0, F.round(tokens / seconds, 1)).otherwise(0.0).alias("tokens_per_second"),
        F.when(n > 0, F.round(seconds / n, 3)).otherwise(0.0).alias("avg_seconds_per_concept"),
        F.when(n > 0, F.floor(tokens / n)).otherwise(0).alias("avg_tokens_per_concept"),
        F.round(F.lit(float(startup_seconds)), 1).alias("startup_seconds"),
        F.round(seconds + F.lit(float(startup_seconds)), 1).alias("total_wall_seconds"),
        "json_parse_ok",
        "json_parse_failed",
    )
