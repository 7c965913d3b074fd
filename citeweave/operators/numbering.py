"""Numbers 1, 2, 3… in an order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.session import scratch_dir

# monotonically_increasing_id() counts a partition's rows in its low bits.
_IN_PARTITION = (1 << 33) - 1


def number_rows(frame: DataFrame, order: Sequence[Column], out: str = "number") -> DataFrame:
    """``frame`` with the long column ``out``: each row's place in ``order``, from 1.

    Rows are dealt into ranges of the order, sorted there and written with their place in
    the range; the ranges' row counts, one small row for each, then say how many rows
    stand before a range. Rows that are equal in ``order`` are numbered in any order, all
    in one range: end the order with a column that tells them apart if many can be equal.
    An empty frame stays empty.
    """
    spark = frame.sparkSession
    path = scratch_dir(spark, "numbered")
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns(
        {
            "_range": F.spark_partition_id(),
            "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)),
        }
    )
    ranged.write.parquet(path)
    placed = spark.read.schema(ranged.schema).parquet(path)
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_place") + 1
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(out, number)
        .drop("_range", "_place", "_before")
    )
