"""Parquet tables and the dictionary file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators.matching import normalise_dictionary


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """One concept per line, trimmed and lower-cased."""
    return normalise_dictionary(spark.read.text(path), "value")


def read_table(spark: SparkSession, path: str, shard_col: str | None = None) -> DataFrame:
    """A papers, edges or representatives table.

    ``shard=`` folders become a column. With ``shard_col`` and no such folders,
    the file name stands for the shard. A missing path is an error.
    """
    table = spark.read.parquet(path)
    if shard_col and shard_col not in table.columns:
        table = table.withColumn(shard_col, F.col("_metadata.file_name"))
    return table
