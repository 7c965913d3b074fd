"""Every registered query: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.text import year_in_range
from citeweave.operators import budget, consolidate, distribution, matching, pairs
from citeweave.operators import representatives as rep
from citeweave.operators import summaries, tagging
from citeweave.plans import adapters as A
from citeweave.plans.registry import query
from citeweave.session import scratch_dir
from citeweave.sources import works as works_source
from citeweave.streaming import ingest, topk

K = 30
DEEP_K = 1200
SCORE_DIGITS = 6
GENERATION_SECONDS = 12.5
STARTUP_SECONDS = 90.0

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from citeweave.plans import stored  # registers its own, with helpers from here

    return stored.registered()


# --- representative papers ---------------------------------------------------


def _representatives(t: A.Tables, strategy: str, sharded: bool = False, **options) -> DataFrame:
    return rep.select_representatives(
        A.order_papers(t, sharded),
        A.order_edges(t, sharded),
        strategy,
        K,
        shard_col="shard" if sharded else None,
        **options,
    ).drop("shard")


@query
def rep_citation(t):
    return _representatives(t, "citation")


@query
def rep_citation_per_shard(t):
    return rep.rank_in_shard(A.order_papers(t, True), A.order_edges(t, True), "shard", K)


@query
def rep_citation_concepts(t):
    """The strategy for named concepts, one of them unknown."""
    named = ["blue anvil", "blue gear", "not a concept"]
    return _representatives(t, "citation", concepts=named)


@query
def rep_recency(t):
    return _representatives(t, "recency", score_digits=SCORE_DIGITS)


@query
def rep_temporal(t):
    return _representatives(t, "temporal")


@query
def rep_temporal_sharded(t):
    return _representatives(t, "temporal", sharded=True)


@query
def rep_coverage(t):
    return _representatives(t, "coverage")


@query
def rep_coverage_sharded(t):
    return _representatives(t, "coverage", sharded=True)


@query
def rep_hybrid(t):
    return _representatives(t, "hybrid", score_digits=SCORE_DIGITS)


@query
def rep_random(t):
    return _representatives(t, "random")


@query
def rep_citation_deep(t):
    """More papers a concept than Spark's own cut before the shuffle allows."""
    return rep.citation_count(A.order_papers(t), A.order_edges(t), DEEP_K)


@query
def signal_percent_ranks(t):
    ranks = rep.signal_percent_ranks(A.order_papers(t), A.order_edges(t))
    shares = ["citation_prank", "recency_prank", "breadth_prank"]
    return ranks.withColumns({c: F.round(c, SCORE_DIGITS) for c in shares})


def _arrived(t: A.Tables, strategy: str, **options) -> DataFrame:
    """Versions of papers arrive in two waves, a batch each; the rows after the last one."""
    arriving, progress = scratch_dir(t.spark, "arriving"), scratch_dir(t.spark, "progress")
    state = scratch_dir(t.spark, "state")
    for wave in A.arriving_orders(t):
        wave.write.mode("append").parquet(arriving)
        papers = t.spark.read.schema(wave.schema).parquet(arriving)
        stream = t.spark.readStream.schema(wave.schema).parquet(arriving)
        topk.update_representatives(
            t.spark, stream, state, progress, [strategy], K, options={strategy: options}
        )
    return topk.current_representatives(t.spark, state, papers, strategy, K, **options)


@query
def rep_citation_incremental(t):
    return _arrived(t, "citation")


@query
def rep_recency_incremental(t):
    return _arrived(t, "recency", score_digits=SCORE_DIGITS)


@query
def rep_random_incremental(t):
    return _arrived(t, "random")


@query
def rep_temporal_incremental(t):
    return _arrived(t, "temporal")


@query
def rep_coverage_incremental(t):
    return _arrived(t, "coverage")


@query
def rep_hybrid_incremental(t):
    return _arrived(t, "hybrid", score_digits=SCORE_DIGITS)


# --- distribution ------------------------------------------------------------


@query
def concept_counts(t):
    return distribution.concept_counts(A.order_edges(t))


@query
def concept_counts_describe(t):
    row = distribution.describe_counts(distribution.concept_counts(A.order_edges(t)))
    return row.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query
def concept_counts_hist(t):
    bins = distribution.histogram(distribution.concept_counts(A.order_edges(t)))
    return bins.withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


@query
def concept_ccdf(t):
    points = distribution.ccdf(distribution.concept_counts(A.order_edges(t)))
    return points.withColumn("ccdf", F.round("ccdf", 6))


@query
def concept_top30(t):
    return distribution.top_concepts(distribution.concept_counts(A.order_edges(t)))


# --- concept pairs -----------------------------------------------------------


@query
def pairs_first(t):
    return pairs.first_cooccurrence(A.order_papers(t), A.order_edges(t))


@query
def pairs_first_per_shard(t):
    return pairs.first_cooccurrence(
        A.order_papers(t, True), A.order_edges(t, True), "shard", per_shard=True
    )


@query
def pairs_preview(t):
    return pairs.by_first_date(pairs_first(t)).limit(10)


@query
def pairs_per_shard_counts(t):
    return pairs_first_per_shard(t).groupBy("shard").agg(F.count(F.lit(1)).alias("n_pairs"))


# --- ingest ------------------------------------------------------------------


@query
def abstract_rebuild(t):
    return tagging.parse_works(A.document_works(t)).select("id", "abstract")


@query
def concept_match(t):
    return matching.match_concepts(A.document_texts(t), t.dictionary())


@query
def concept_match_shuffled(t):
    """The same through the join for dictionaries too large to broadcast."""
    return matching.match_concepts(A.document_texts(t), t.dictionary(), broadcast_bytes=0)


@query
def concept_match_phrases(t):
    return matching.match_concepts(A.document_texts(t), t.phrase_dictionary())


@query
def concept_match_large(t):
    """Tens of thousands of concepts, broadcast."""
    return matching.match_concepts(A.document_texts(t), t.title_dictionary())


@query
def concept_match_large_shuffled(t):
    return matching.match_concepts(A.document_texts(t), t.title_dictionary(), broadcast_bytes=0)


def _shown(papers: DataFrame) -> DataFrame:
    return papers.select(
        "id",
        "title",
        "abstract",
        "publication_year",
        "publication_date",
        "type",
        "cited_by_count",
        "counts_by_year",
        F.array_join("matched_concepts", "|").alias("concepts"),
        "num_matched_concepts",
    )


@query
def works_to_papers(t):
    return _shown(tagging.tag_papers(tagging.parse_works(A.document_works(t)), t.dictionary()))


def _write_works(t: A.Tables) -> str:
    path = scratch_dir(t.spark, "works")
    works = A.document_works(t).drop("source_file", "updated_date").columns
    # Lines are sorted by date, not the wide works that they are made of. Every task writes
    # its own files, as gzip is read by one task a file.
    lines = A.document_works(t).select("updated_date", F.to_json(F.struct(*works)).alias("value"))
    lines.write.partitionBy("updated_date").option("compression", "gzip").text(path)
    return path


@query
def works_scan(t):
    """Works written as gzip JSON lines under three dates, read back."""
    works = works_source.read_works(t.spark, _write_works(t))
    return works_source.usable(works).select(
        "id", "title", "publication_year", "cited_by_count", "updated_date"
    )


@query
def works_stream_ingest(t):
    """Files to tagged papers by the resumable stream, latest version per id."""
    out = scratch_dir(t.spark, "ingest")
    ingest.ingest_works(
        t.spark, _write_works(t), t.dictionary(), out, scratch_dir(t.spark, "progress")
    )
    return _shown(ingest.ingested_papers(t.spark, out))


@query
def year_filter(t):
    return A.dated_documents(t).where(year_in_range("publication_year", 2005, 2015))


@query
def pending_works(t):
    """Documents that have no label yet."""
    return consolidate.not_yet_done(
        t["documents"].select("doc_id", "source"), t["labels"], ["doc_id"]
    )


@query
def ingest_counters(t):
    texts = A.document_texts(t)
    hits = matching.match_concepts(texts, t.dictionary(), ["id", "source"])
    tagged = matching.matched_arrays(hits, ["id", "source"])
    return tagging.ingest_counters(tagged, "source")


# --- consolidation -----------------------------------------------------------


def _version_columns(papers: DataFrame) -> DataFrame:
    return papers.select(
        "id", "title", "publication_year", "cited_by_count", "batch", "updated_date",
        F.array_join("matched_concepts", "|").alias("concepts"),
    )


@query
def consolidate_papers(t):
    return _version_columns(
        consolidate.first_version(A.document_batches(t), ["updated_date", "batch"])
    )


@query
def consolidate_edges(t):
    return consolidate.concept_edges(A.document_batches(t))


@query
def upsert_latest(t):
    return _version_columns(
        consolidate.latest_version(A.document_batches(t), ["updated_date", "batch"])
    )


# --- token budgets -----------------------------------------------------------


def _chosen_documents(t: A.Tables) -> DataFrame:
    return A.document_edges(t).join(
        A.document_papers(t).withColumnRenamed("id", "paper_id"), "paper_id"
    )


@query
def token_stats(t):
    stats = budget.token_stats(_chosen_documents(t))
    return stats.withColumns(
        {
            c: F.round(c, 6)
            for c in ("avg_tokens_per_paper", "papers_per_concept", "avg_tokens_per_concept")
        }
    )


@query
def token_per_concept(t):
    return budget.tokens_per_concept(_chosen_documents(t))


@query
def token_budget_k(t):
    """Recommended k for windows of the size that each document would need."""
    tokens = F.ceil(F.length("text") / 4).alias("context_window")
    return budget.recommend_k(t["documents"].select(A._document_id(), tokens))


@query
def budget_check(t):
    return budget.budget_check(_chosen_documents(t))


# --- summaries ---------------------------------------------------------------


def _document_choice(t: A.Tables) -> DataFrame:
    return rep.citation_count(A.document_papers(t), A.document_edges(t), K)


@query
def concept_prompts(t):
    return summaries.concept_prompts(_document_choice(t))


@query
def concept_conversations(t):
    talks = summaries.concept_conversations(_document_choice(t))
    return talks.select(
        "concept",
        F.col("conversation")[0]["role"].alias("first_role"),
        F.col("conversation")[0]["content"].alias("first_content"),
        F.col("conversation")[1]["role"].alias("second_role"),
        F.col("conversation")[1]["content"].alias("second_content"),
    )


def _length_scorer():
    """A stand-in for a model: answers with the length of the user message."""

    def score(conversations: pd.Series) -> pd.DataFrame:
        sizes = [len(talk[1]["content"]) for talk in conversations]
        return pd.DataFrame(
            {
                "raw_response": [f'Sure. {{"definition": "{n} characters"}}' for n in sizes],
                "tokens_generated": [n // 4 for n in sizes],
                "finish_reason": "stop",
            }
        )

    return score


@query
def concept_summaries(t):
    talks = summaries.concept_conversations(_document_choice(t))
    raw = summaries.score_conversations(talks, _length_scorer)
    parsed = summaries.number_by_concept(summaries.parse_responses(raw))
    return parsed.select(
        "id", "concept", "finish_reason", "tokens_generated", "parse_ok", "response",
        F.col("summary.definition").alias("definition"),
    )


@query
def parse_responses(t):
    return summaries.parse_responses(A.responses(t)).select(
        "concept", "tokens_generated", "finish_reason", "parse_ok", "response",
        F.col("summary.summary").alias("summary_text"),
    )


@query
def run_stats(t):
    return summaries.run_stats(
        summaries.parse_responses(A.responses(t)), GENERATION_SECONDS, STARTUP_SECONDS
    )
