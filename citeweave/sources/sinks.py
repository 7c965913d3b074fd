"""Writing results. All writers fail if the target exists unless told to overwrite."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave import constants as C
from citeweave.functions.text import has_text
from citeweave.operators.pairs import by_first_date
from citeweave.operators.representatives import final_order
from citeweave.operators.summaries import number_by_concept
from citeweave.schemas import READABLE


def write_papers(
    papers: DataFrame,
    path: str,
    mode: str = "error",
    rows_per_file: int = C.DOCS_PER_BATCH,
    shard_col: str | None = None,
) -> None:
    """Papers with the ``readable`` flag, in files of at most ``rows_per_file`` rows.

    Rows are first dealt into even portions of bytes (AQE splits large and merges small
    ones), so neither many small files nor a few huge ones come out. With ``shard_col``
    each shard has a folder.
    """
    papers = with_readable(papers).hint("rebalance", *([shard_col] if shard_col else []))
    writer = papers.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    _zstd(_sharded(writer, shard_col), path)


def with_readable(papers: DataFrame) -> DataFrame:
    flag = has_text("title") & has_text("abstract")
    return papers.withColumn(READABLE, F.coalesce(flag, F.lit(False)))


def write_edges(
    edges: DataFrame, path: str, mode: str = "error", shard_col: str | None = None
) -> None:
    """Edges in order of (concept, paper_id), so that a concept filter skips files.

    The paper id in the range key lets a concept with very many papers be shared
    out among files. With ``shard_col`` each shard has a folder.
    """
    order = [*([shard_col] if shard_col else []), "concept", "paper_id"]
    ordered = edges.repartitionByRange(*order).sortWithinPartitions(*order)
    _zstd(_sharded(ordered.write.mode(mode), shard_col), path)


def save_joinable(papers: DataFrame, edges: DataFrame, prefix: str, buckets: int) -> None:
    """Save both tables bucketed by paper, so that joining them needs no shuffle."""
    tables = (("papers", with_readable(papers), "id"), ("edges", edges, "paper_id"))
    for name, table, key in tables:
        table.write.bucketBy(buckets, key).sortBy(key).saveAsTable(f"{prefix}_{name}")


def write_representatives(chosen: DataFrame, path: str, mode: str = "error") -> None:
    _zstd(final_order(chosen).write.mode(mode), path)


def write_pairs(pairs: DataFrame, path: str, mode: str = "error") -> None:
    by_first_date(pairs).write.mode(mode).parquet(path)


def write_distribution(counts: DataFrame, path: str, mode: str = "error") -> None:
    counts.write.mode(mode).option("header", True).csv(path)


def write_summaries(
    results: DataFrame, stats: DataFrame, path: str, model: str, mode: str = "error"
) -> None:
    """``results``, ``run`` (one row) and ``raw_responses`` under ``path``, as JSON."""
    numbered = number_by_concept(results).select(
        "id", "concept", "finish_reason", "tokens_generated", "parse_ok", "response"
    )
    numbered.write.mode(mode).json(f"{path}/results")
    started = datetime.now(timezone.utc).isoformat()
    header = stats.withColumnRenamed("concepts_processed", "total_concepts").select(
        F.lit(model).alias("model"), F.lit(started).alias("run_timestamp"), "*"
    )
    header.write.mode(mode).json(f"{path}/run")
    results.select("concept", "raw_response").write.mode(mode).json(f"{path}/raw_responses")


def _sharded(writer, shard_col: str | None):
    return writer.partitionBy(shard_col) if shard_col else writer


def _zstd(writer, path: str) -> None:
    writer.option("compression", "zstd").parquet(path)
