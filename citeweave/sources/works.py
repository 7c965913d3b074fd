"""Raw works: gzip JSON lines under ``updated_date=`` folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave import constants as C
from citeweave.schemas import WORK

_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    "pathGlobFilter": "*.gz",
}


def read_works(
    spark: SparkSession, path: str, updated_dates: Sequence[str] | None = None
) -> DataFrame:
    """All ``*.gz`` works, or those of the given update dates (partition pruning).

    Adds ``updated_date`` and ``source_file``. Blank lines vanish; a malformed
    line gives a row with ``_corrupt_record`` set, see ``usable`` and
    ``corrupt_counts``.
    """
    works = _with_file(spark.read.schema(WORK).options(**_OPTIONS).json(path))
    if updated_dates is not None:
        works = works.where(F.col("updated_date").isin(list(updated_dates)))
    return works


def stream_works(
    spark: SparkSession,
    path: str,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int = C.BYTES_PER_TRIGGER,
) -> DataFrame:
    """The same as a stream of new files.

    A batch takes files up to ``bytes_per_trigger`` together, so that its work does not
    depend on how finely the files are cut, or ``files_per_trigger`` files if that is given.
    """
    reader = spark.readStream.schema(WORK).options(**_OPTIONS)
    if files_per_trigger is None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    else:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _with_file(reader.json(path))


def damaged(works: DataFrame) -> Column:
    """Whether a line is no JSON object from end to end.

    The reader keeps such lines as text, and those with one bad field; fields that stand
    before the damage may be known all the same.
    """
    line = F.col("_corrupt_record")
    whole = F.get_json_object(line, "$").startswith("{")
    # Spark refuses to read nothing but the text of damaged lines, so a field is named too.
    read = F.length(F.coalesce("id", F.lit(""))) >= 0
    return line.isNotNull() & ~F.coalesce(whole, F.lit(False)) & read


def usable(works: DataFrame) -> DataFrame:
    """Drop lines that could not be read.

    A line with one bad field is kept, and so is a work without an id.
    """
    return works.where(~damaged(works)) if "_corrupt_record" in works.columns else works


def corrupt_counts(works: DataFrame) -> DataFrame:
    """Lines read and damaged lines, per file."""
    return works.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(damaged(works)).alias("n_dropped"),
    )


def _with_file(works: DataFrame) -> DataFrame:
    works = works.withColumn("source_file", F.col("_metadata.file_path"))
    if "updated_date" in works.columns:
        return works.withColumn("updated_date", F.col("updated_date").cast("string"))
    return works.withColumn("updated_date", F.lit(None).cast("string"))
