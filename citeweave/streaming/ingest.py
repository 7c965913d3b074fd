"""Resumable ingest of works files.

The stream's checkpoint remembers which files are done, so a run picks up what
is new or was interrupted. Every micro-batch writes into a folder named by its
id; a repeated batch writes the same folder again, nothing is read and
overwritten at once. The ledger has a row for each batch: lines read, lines that
could not be read, works kept, papers with a concept. They are observed while the
batch is written, no line is read for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from citeweave import constants as C
from citeweave.operators.consolidate import latest_version
from citeweave.operators.tagging import parse_works, tag_papers
from citeweave.session import drop_folder
from citeweave.sources.works import damaged, stream_works

LEDGER = ["n_lines", "n_damaged", "n_works", "n_papers"]
LEDGER_SCHEMA = ", ".join(f"{c} long" for c in LEDGER)


def ingest_works(
    spark: SparkSession,
    works_path: str,
    dictionary: DataFrame,
    out_path: str,
    checkpoint_path: str,
    start_year: int | None = None,
    end_year: int | None = None,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int = C.BYTES_PER_TRIGGER,
) -> None:
    """Process all files not processed yet, then return.

    Gzip files cannot be split, so a batch is parsed once into Parquet; matching
    then runs on as many tasks as that has splits and reads only the columns it
    needs. The parsed copy goes when the batch's papers are written.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        parsed_path = f"{out_path}/parsed/batch_id={batch_id}"
        lines, works, tagged = Observation(), Observation(), Observation()
        seen = batch.observe(
            lines,
            F.count(F.lit(1)).alias("n_lines"),
            F.count_if(damaged(batch)).alias("n_damaged"),
        )
        parsed = parse_works(seen, start_year, end_year)
        parsed = parsed.observe(works, F.count(F.lit(1)).alias("n_works"))
        parsed.write.mode("overwrite").parquet(parsed_path)
        papers = tag_papers(session.read.schema(parsed.schema).parquet(parsed_path), dictionary)
        papers = papers.observe(tagged, F.count(F.lit(1)).alias("n_papers"))
        papers.write.mode("overwrite").option(
            "maxRecordsPerFile", C.DOCS_PER_BATCH
        ).parquet(f"{out_path}/papers/batch_id={batch_id}")
        entry = {**lines.get, **works.get, **tagged.get}
        ledger = session.createDataFrame([tuple(entry[c] for c in LEDGER)], LEDGER_SCHEMA)
        ledger.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/ledger/batch_id={batch_id}")
        drop_folder(session, parsed_path)

    query = (
        stream_works(spark, works_path, files_per_trigger, bytes_per_trigger)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_ledger(spark: SparkSession, out_path: str) -> DataFrame:
    """``batch_id`` and the counts of every batch so far."""
    return spark.read.parquet(f"{out_path}/ledger")


def ingested_versions(spark: SparkSession, out_path: str) -> DataFrame:
    """All tagged papers, every version of every id."""
    return spark.read.parquet(f"{out_path}/papers")


def ingested_papers(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest version of every paper."""
    return latest_version(
        ingested_versions(spark, out_path), ["updated_date", "source_file", "batch_id"]
    )
