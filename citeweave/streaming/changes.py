"""From arriving versions of papers to changes of (concept, paper) rows.

A paper may arrive many times, in any order. Its newest version so far stands in a log of
narrow rows without text; when a newer one arrives, the rows of the old one are taken back
and its own are added. Versions older than the log's change nothing. A batch looks its
papers up by a bitmap of their ids on the log's scan, so only versions of papers that
arrive are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.functions.text import has_text
from citeweave.operators.semifilter import may_match

SIGNALS = ["publication_year", "cited_by_count", "num_matched_concepts"]
ROW = ["concept", "paper_id", "content", *SIGNALS]
VERSION = ["id", "version", "content", *SIGNALS, "concepts"]


def content_hash() -> Column:
    """Names what a version says: its text, signals and concepts."""
    return F.xxhash64("title", "abstract", *SIGNALS, "matched_concepts")


def paper_versions(papers: DataFrame, version: Column) -> DataFrame:
    """Narrow rows of papers that have an id; one whose text is blank has no concepts.

    ``version`` is a string that sorts as versions follow each other; versions of equal
    strings are told apart by what they say.
    """
    readable = F.coalesce(has_text("title") & has_text("abstract"), F.lit(False))
    tagged = F.array_distinct(F.filter("matched_concepts", lambda c: c.isNotNull()))
    none = F.array().cast("array<string>")
    concepts = F.when(readable, F.coalesce(tagged, none)).otherwise(none)
    return papers.where(F.col("id").isNotNull()).select(
        "id",
        F.coalesce(version, F.lit("")).alias("version"),
        content_hash().alias("content"),
        *[F.col(s).cast("int").alias(s) for s in SIGNALS],
        F.array_sort(concepts).alias("concepts"),
    )


def _newest(versions: DataFrame) -> DataFrame:
    """Spark keeps one version per paper in each input partition before the shuffle."""
    order = W.partitionBy("id").orderBy(F.desc("version"), F.desc("content"))
    ranked = versions.withColumn("_place", F.row_number().over(order))
    return ranked.where(F.col("_place") == 1).drop("_place")


def accepted_versions(
    spark: SparkSession, arrived: DataFrame, log_path: str, batch_id: int
) -> DataFrame:
    """Versions of this batch that are the newest of their paper, and what they replace.

    ``arrived`` are rows of ``paper_versions``; the columns of a replaced version start with
    ``old_`` and are null for a paper that is new.
    """
    new = _newest(arrived)
    if batch_id == 0:
        kinds = dict(new.dtypes)
        return new.select("*", *[F.lit(None).cast(kinds[c]).alias(f"old_{c}") for c in VERSION[1:]])
    log = spark.read.parquet(log_path).where(F.col("batch_id") < batch_id).select(*VERSION)
    before = _newest(may_match(log, F.col("id"), arrived, F.col("id")))
    before = before.select("id", *[F.col(c).alias(f"old_{c}") for c in VERSION[1:]])
    later = F.struct("version", "content") > F.struct(
        F.col("old_version").alias("version"), F.col("old_content").alias("content")
    )
    return new.join(before, "id", "left").where(F.col("old_version").isNull() | later)


def concept_changes(accepted: DataFrame) -> DataFrame:
    """``concept, paper_id, content``, signals and ``sign``: rows added (1), taken back (-1).

    A paper has one accepted version, so a row that would be taken back and added again is
    found in that version and left out: the changes of a batch need no setting off.
    """
    same = F.lit(True)
    for column in ("content", *SIGNALS):
        same = same & F.col(column).eqNullSafe(F.col(f"old_{column}"))
    none = F.array().cast("array<string>")

    def rows(prefix: str, other: str, sign: int) -> DataFrame:
        concepts, stays = F.col(f"{prefix}concepts"), F.coalesce(f"{other}concepts", none)
        left = F.when(same, F.array_except(concepts, stays)).otherwise(concepts)
        return accepted.select(
            F.explode(left).alias("concept"),
            F.col("id").alias("paper_id"),
            *[F.col(f"{prefix}{c}").alias(c) for c in ("content", *SIGNALS)],
            F.lit(sign).alias("sign"),
        )

    return rows("", "old_", 1).unionByName(rows("old_", "", -1))


def net_changes(changes: DataFrame) -> DataFrame:
    """Changes that are left when additions and removals of equal rows are set off."""
    summed = changes.groupBy(*ROW).agg(F.sum("sign").cast("int").alias("sign"))
    return summed.where("sign <> 0")
