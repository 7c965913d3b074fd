"""Queries that go by way of stored files: written by the sinks, read back by the readers."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave import jobs
from citeweave.operators import consolidate, distribution, pairs
from citeweave.operators import representatives as rep
from citeweave.operators.numbering import number_rows
from citeweave.plans import adapters as A
from citeweave.plans.catalog import K, _document_choice, _length_scorer
from citeweave.plans.registry import query, registered
from citeweave.session import scratch_dir
from citeweave.sources import sinks, tables
from citeweave.sources import works as works_source
from citeweave.streaming import ingest

__all__ = ["registered"]

FILE_ROWS = 4000
SHARD = "shard"


def _shards(t: A.Tables) -> str:
    """Papers and edges as the sinks write them, a folder for each shard."""
    path = scratch_dir(t.spark, "tables")
    sinks.write_papers(A.order_papers(t, True), f"{path}/papers", shard_col=SHARD)
    sinks.write_edges(A.order_edges(t, True), f"{path}/edges", shard_col=SHARD)
    return path


def _in_file_order(frame: DataFrame) -> DataFrame:
    """Rows with their place: files by name, rows as they stand in a file."""
    placed = frame.withColumns(
        {"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")}
    )
    return number_rows(placed, [F.asc("_file"), F.asc("_row")], "place").drop("_file", "_row")


@query
def shards_scan(t):
    """Papers of each shard folder, read as one table."""
    papers = tables.read_table(t.spark, f"{_shards(t)}/papers", SHARD)
    return papers.groupBy(F.col(SHARD).cast("long").alias(SHARD)).agg(
        F.count(F.lit(1)).alias("n_papers"),
        F.count_if("readable").alias("n_readable"),
        F.sum("cited_by_count").alias("citations"),
    )


@query
def shard_files_scan(t):
    """One file for each shard in one folder: the file's name stands for the shard."""
    path = scratch_dir(t.spark, "files")
    for shard in range(4):
        part = A.order_papers(t, True).where(F.col(SHARD) == shard).drop(SHARD)
        part.coalesce(1).write.mode("append").parquet(path)
    papers = tables.read_table(t.spark, path, SHARD)
    counts = papers.groupBy(SHARD).agg(
        F.count(F.lit(1)).alias("n_papers"), F.min("id").alias("first_id")
    )
    return counts.drop(SHARD)


@query
def rep_temporal_stored(t):
    """Stored shards to chosen rows, written in their final order and read back."""
    path, out = _shards(t), scratch_dir(t.spark, "chosen")
    chosen = rep.temporal_diversity(
        tables.read_table(t.spark, f"{path}/papers", SHARD),
        tables.read_table(t.spark, f"{path}/edges", SHARD),
        K,
        shard_col=SHARD,
    )
    sinks.write_representatives(chosen.drop(SHARD), out)
    return _in_file_order(tables.read_table(t.spark, out))


@query
def rep_hybrid_stored(t):
    """Stored tables without shards, the whole job, and its rows in final order."""
    path, out = scratch_dir(t.spark, "tables"), scratch_dir(t.spark, "chosen")
    sinks.write_papers(A.order_papers(t), f"{path}/papers")
    sinks.write_edges(A.order_edges(t), f"{path}/edges")
    jobs.representatives_job(t.spark, path, out, "hybrid", K, score_digits=6)
    return _in_file_order(tables.read_table(t.spark, out))


@query
def pairs_stored(t):
    """Pairs as the sink orders them."""
    out = scratch_dir(t.spark, "pairs")
    sinks.write_pairs(pairs.first_cooccurrence(A.order_papers(t), A.order_edges(t)), out)
    return _in_file_order(t.spark.read.parquet(out))


@query
def distribution_stored(t):
    """Concept counts through the CSV file."""
    out = scratch_dir(t.spark, "distribution")
    sinks.write_distribution(distribution.concept_counts(A.order_edges(t)), out)
    return t.spark.read.schema("concept string, paper_count bigint").option("header", True).csv(out)


def _summarised(t: A.Tables) -> str:
    """The whole summary job over the documents' concepts; folder of its JSON output."""
    chosen, out = scratch_dir(t.spark, "chosen"), scratch_dir(t.spark, "summaries")
    sinks.write_representatives(_document_choice(t), chosen)
    jobs.summaries_job(t.spark, chosen, out, _length_scorer, "lengths", clock=lambda: 0.0)
    return out


@query
def summaries_stored(t):
    schema = "id long, concept string, finish_reason string, tokens_generated int, parse_ok boolean, response string"
    return t.spark.read.schema(schema).json(f"{_summarised(t)}/results")


@query
def summaries_run_stored(t):
    """The run's header row, and how many raw responses lie beside it."""
    out = _summarised(t)
    header = t.spark.read.json(f"{out}/run").select(
        "model", "total_concepts", "total_tokens_generated", "json_parse_ok", "json_parse_failed"
    )
    raw = t.spark.read.schema("concept string, raw_response string").json(f"{out}/raw_responses")
    return header.join(raw.agg(F.count("raw_response").alias("n_raw_responses")))


@query
def paper_files(t):
    """Papers from many small parts: rows of the files written, none over the limit."""
    out = scratch_dir(t.spark, "papers")
    sinks.write_papers(A.order_papers(t).repartition(64), out, rows_per_file=FILE_ROWS)
    files = t.spark.read.parquet(out).groupBy(F.col("_metadata.file_name").alias("file"))
    counts = files.agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("n_papers"),
        F.count_if(F.col("n") > FILE_ROWS).alias("n_over_limit"),
        (F.count(F.lit(1)) * FILE_ROWS < F.sum("n") + 32 * FILE_ROWS).alias("few_files"),
    )


@query
def edge_files(t):
    """Edges by range: files of which the least and greatest edges overlap another's."""
    out = scratch_dir(t.spark, "edges")
    sinks.write_edges(A.order_edges(t), out)
    edge = F.struct("concept", "paper_id")
    files = t.spark.read.parquet(out).groupBy(F.col("_metadata.file_name").alias("file"))
    bounds = files.agg(
        F.count(F.lit(1)).alias("n"), F.min(edge).alias("low"), F.max(edge).alias("high")
    )
    other = bounds.select(F.col("file").alias("other"), F.col("low").alias("l"), F.col("high").alias("h"))
    meeting = (F.col("file") < F.col("other")) & (F.col("low") <= F.col("h")) & (F.col("l") <= F.col("high"))
    overlaps = bounds.join(F.broadcast(other), meeting).agg(F.count(F.lit(1)).alias("n_overlaps"))
    return bounds.agg(F.sum("n").alias("n_edges")).join(overlaps)


@query
def dictionary_scan(t):
    """Words of the benchmark texts as dictionary lines: blanks, capitals, repeats, gaps."""
    out = scratch_dir(t.spark, "dictionary")
    words = t["benchmark"].select("item_id", F.explode(F.split("text", " ")).alias("word"))
    small, large = string.ascii_lowercase, string.ascii_uppercase
    upper = F.translate("word", small, large)
    line = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("  "), upper, F.lit("\t")))
    line = line.when(F.col("item_id") % 3 == 1, F.col("word")).otherwise(F.lit(" "))
    words.select(line.alias("value")).write.text(out)
    return tables.load_dictionary(t.spark, out)


def _damaged_works(t: A.Tables) -> str:
    """Works as gzip lines under three dates: every tenth cut in half, every tenth without
    an id, a blank line after every fifth."""
    path, key = scratch_dir(t.spark, "works"), F.substring("id", 2, 20).cast("long")
    works = A.document_works(t).drop("source_file")
    fields = [F.when(key % 10 != 4, F.col("id")).alias("id"), *works.columns[1:-1]]
    line = F.when(key % 10 == 3, F.expr("substring(line, 1, length(line) div 2)"))
    line = line.otherwise(F.col("line"))
    blank = F.when(key % 5 == 0, F.array(line, F.lit(""))).otherwise(F.array(line))
    lines = works.withColumn("line", F.to_json(F.struct(*fields)))
    lines = lines.select("updated_date", F.explode(blank).alias("value"))
    writer = lines.write.partitionBy("updated_date").option("compression", "gzip")
    writer.text(path)
    return path


@query
def works_of_dates(t):
    """Damaged and whole works of two dates of three."""
    works = works_source.read_works(t.spark, _damaged_works(t), ["2024-01-01", "2024-01-03"])
    return works_source.usable(works).select(
        F.coalesce("id", F.lit("")).alias("id"), "title", "counts_by_year", "updated_date"
    )


@query
def works_damaged(t):
    """Lines read and lines that could not be read, by date."""
    works = works_source.read_works(t.spark, _damaged_works(t))
    return works.groupBy("updated_date").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(works_source.damaged(works)).alias("n_damaged"),
    )


@query
def ingest_ledger(t):
    """Two runs of the ingest, one date at a time and none twice: counts of all batches,
    whether the parsed copies are gone, and whether every paper has the time of its run."""
    path, out = _damaged_works(t), scratch_dir(t.spark, "ingest")
    progress = scratch_dir(t.spark, "progress")
    started = t.spark.sql("select current_timestamp() as now").first()["now"]
    for _ in range(2):
        ingest.ingest_works(t.spark, path, t.dictionary(), out, progress)
    ledger = ingest.ingest_ledger(t.spark, out).agg(
        F.sum("n_lines").alias("n_lines"),
        F.sum("n_damaged").alias("n_damaged"),
        F.sum("n_works").alias("n_works"),
        F.sum("n_papers").alias("n_tagged"),
    )
    timely = F.col("processed_date").between(F.lit(started), F.current_timestamp())
    papers = ingest.ingested_versions(t.spark, out).agg(
        F.count(F.lit(1)).alias("n_papers"), F.bool_and(timely).alias("timely")
    )
    joined = ledger.join(papers)
    return joined.select(
        "n_lines", "n_damaged", "n_works", "timely", (F.col("n_tagged") == F.col("n_papers")).alias("all_counted")
    )


@query
def papers_across_shards(t):
    """A paper that stands in two shards is kept in both, and once without shards."""
    copies = A.shard_copies(t)
    kept = consolidate.first_version(copies, ["cited_by_count"], shard_col=SHARD)
    once = consolidate.first_version(copies, ["cited_by_count"])
    return kept.withColumn("kept_in", F.lit("shard")).unionByName(once.withColumn("kept_in", F.lit("all")))
