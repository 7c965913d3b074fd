"""How many papers the concepts have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave import constants as C

# Points of one distinct count are generated in runs of this many rows.
CHUNK = 100_000


def concept_counts(edges: DataFrame) -> DataFrame:
    """Edge rows per concept."""
    return edges.groupBy("concept").agg(F.count(F.lit(1)).alias("paper_count"))


def describe_counts(counts: DataFrame) -> DataFrame:
    """One row: count, mean, sample deviation, min, quartiles, max.

    Quartiles are exact and interpolated. Everything is worked out from the frequencies of
    the distinct counts in one aggregate, sums exactly.
    """
    c, n = F.col("paper_count").cast("decimal(38,0)"), F.col("n").cast("decimal(38,0)")
    quartiles = F.percentile("paper_count", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    sums = _frequencies(counts).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.sum(F.col("paper_count") * F.col("n")).cast("double").alias("total"),
        F.sum((c * c * n).cast("decimal(38,0)")).cast("double").alias("squares"),
        F.min("paper_count").alias("min"),
        F.max("paper_count").alias("max"),
        quartiles.alias("q"),
    )
    total, squares, number = F.col("total"), F.col("squares"), F.col("count")
    spread = F.greatest(squares - total * total / number, F.lit(0.0))
    return sums.select(
        "count",
        F.when(number > 0, total / number).alias("mean"),
        F.when(number > 1, F.sqrt(spread / (number - 1))).alias("std"),
        "min",
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"),
        "max",
    )


def histogram(counts: DataFrame, bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over [min, max], empty ones included.

    The last bin is closed. If all counts are equal the range is widened by 0.5
    on either side. No counts, no bins.

    The frequencies of the distinct counts are gathered once; their number is at most
    about the square root of twice the number of edges. Bounds, bins and sums follow from
    that one row, so counts are worked out a single time.
    """
    pair = F.struct(F.col("paper_count").alias("c"), F.col("n").alias("n"))
    row = _frequencies(counts).agg(
        F.collect_list(pair).alias("pairs"),
        F.min("paper_count").cast("double").alias("low"),
        F.max("paper_count").cast("double").alias("high"),
    )
    same = F.col("low") == F.col("high")
    row = row.where("low is not null").select(
        "pairs",
        F.when(same, F.col("low") - 0.5).otherwise(F.col("low")).alias("lo"),
        F.when(same, F.col("high") + 0.5).otherwise(F.col("high")).alias("hi"),
    )
    lo, hi = F.col("lo"), F.col("hi")
    width = (hi - lo) / bins

    def bin_of(x: Column) -> Column:
        guess = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
        # The division can miss by one bin; the bin's own edges decide.
        return (
            F.when(x < lo + guess * width, guess - 1)
            .when((guess < bins - 1) & (x >= lo + (guess + 1) * width), guess + 1)
            .otherwise(guess)
        )

    # An entry of no concepts for every bin, so that empty bins are there too.
    every = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.struct(b.cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("n")),
    )
    placed = F.transform("pairs", lambda p: F.struct(bin_of(p["c"]).alias("bin"), p["n"].alias("n")))
    entries = row.select("lo", "hi", F.explode(F.concat(every, placed)).alias("e"))
    summed = entries.groupBy("lo", "hi", F.col("e.bin").alias("bin")).agg(
        F.sum("e.n").alias("n_concepts")
    )
    return summed.select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "n_concepts",
    )


def ccdf(counts: DataFrame) -> DataFrame:
    """One point per concept: its count and the share of concepts ranked after it.

    Ranks are running sums over the distinct counts. Their number is at most
    about the square root of twice the number of edges, so that one unpartitioned
    window is small whatever the number of concepts.
    """
    freq = _frequencies(counts)
    upto = F.sum("n").over(W.orderBy("paper_count"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    steps = freq.select(
        "paper_count", (upto - F.col("n")).alias("before"), upto.alias("upto"),
        total.alias("total"),
    )
    starts = F.sequence(F.col("before") + 1, F.col("upto"), F.lit(CHUNK))
    chunks = steps.select("*", F.explode(starts).alias("start"))
    ranks = F.sequence(F.col("start"), F.least(F.col("start") + CHUNK - 1, F.col("upto")))
    return chunks.select("paper_count", "total", F.explode(ranks).alias("rank")).select(
        "paper_count", "rank", (F.lit(1.0) - F.col("rank") / F.col("total")).alias("ccdf")
    )


def top_concepts(counts: DataFrame, n: int = C.TOP_CONCEPTS) -> DataFrame:
    return counts.orderBy(F.desc("paper_count"), F.asc("concept")).limit(n)


def _frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("paper_count").agg(F.count(F.lit(1)).alias("n"))
