import math
import random

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.functions.text import has_text
from citeweave.operators import representatives as rep
from tests.conftest import rows

PAPER = (
    "id string, title string, abstract string, publication_year int, cited_by_count int,"
    " num_matched_concepts int, shard int"
)


def tables(spark, papers, edges):
    papers = spark.createDataFrame(papers, PAPER)
    edges = spark.createDataFrame(edges, "concept string, paper_id string")
    return papers, edges


def paper(i, year=2000, cites=1, breadth=1, title="t", abstract="a", shard=0):
    return (i, title, abstract, year, cites, breadth, shard)


def generated(spark, n=400, seed=3):
    pick = random.Random(seed)
    papers, edges = [], []
    for i in range(n):
        papers.append(
            paper(
                f"p{i}",
                pick.choice([None, 2001, 2002, 2003, 2003, 2003]),
                pick.choice([None, 0, 1, 2, 3, 50]),
                pick.choice([None, 1, 2, 3]),
                pick.choice(["t", "t", "t", None, "  "]),
                shard=i % 2,
            )
        )
        edges += [(c, f"p{i}") for c in ["hot", *pick.sample("abcd", pick.randint(0, 2))]]
    edges.append(("lonely", "p1"))
    return tables(spark, papers, edges)


def chosen(frame, *extra):
    return rows(frame, "concept", *extra, "rank", "paper_id")


@pytest.mark.parametrize("k", [1, 2, 3, 10])
def test_citation_ties_nulls_and_short_concepts(spark, k):
    papers, edges = tables(
        spark,
        [paper("b", cites=5), paper("a", cites=5), paper("c", cites=None), paper("d", cites=9),
         paper("blank", cites=99, title="  "), paper("none", cites=99, abstract=None),
         paper("tab", cites=1, title="\t")],
        [("x", i) for i in ["a", "b", "c", "d", "blank", "none", "tab", "absent"]] + [("y", "c")],
    )
    expected = ["d", "a", "b", "tab", "c"][:k]
    want = [("x", i + 1, p) for i, p in enumerate(expected)] + [("y", 1, "c")]
    assert chosen(rep.citation_count(papers, edges, k)) == sorted(want, key=repr)


def test_recency_scores(spark):
    papers, edges = tables(
        spark,
        [paper("old", 2016, 100), paper("now", 2026, 50), paper("future", 2036, 20),
         paper("no year", None, 51), paper("no cites", 2026, None)],
        [("x", i) for i in ["old", "now", "future", "no year", "no cites"]],
    )
    got = rep.recency_weighted(papers, edges, 5).orderBy("rank").collect()
    assert [r.paper_id for r in got] == ["future", "no year", "now", "old", "no cites"]
    assert math.isclose(got[0].weighted_score, 20 * math.e)
    assert got[-1].weighted_score == 0
    flat = rep.recency_weighted(papers, edges, 1, decay_factor=0.0).collect()
    assert [r.paper_id for r in flat] == ["old"]


@pytest.mark.parametrize("k, buckets, sizes", [(10, 5, 2), (3, 5, 1), (7, 3, 2)])
def test_temporal_bucket_sizes(spark, k, buckets, sizes):
    papers, edges = tables(
        spark,
        [paper(f"p{i:02d}", 2000 + i, i % 7) for i in range(30)] + [paper("none", None, 99)],
        [("x", f"p{i:02d}") for i in range(30)] + [("x", "none"), ("short", "p00"), ("short", "p01")],
    )
    got = rep.temporal_diversity(papers, edges, k, time_buckets=buckets).toPandas()
    counts = got[got.concept == "x"].groupby("time_bucket").size()
    assert list(counts) == [sizes] * buckets
    assert "none" not in set(got.paper_id)
    short = got[got.concept == "short"].sort_values("time_bucket")
    assert list(short.time_bucket) == [1, 2]


def test_coverage_tiers(spark):
    papers, edges = tables(
        spark,
        [paper(f"p{i}", cites=i, breadth=b) for i, b in enumerate([None, 1, 2, 3, 4, 5])]
        + [paper("uncited", cites=None, breadth=9)],
        [("x", f"p{i}") for i in range(6)] + [("x", "uncited")],
    )
    got = chosen(rep.coverage_diversity(papers, edges, 4), "breadth_tier")
    assert got == [("x", 1, 1, "p1"), ("x", 2, 1, "p3"), ("x", 2, 2, "p2"), ("x", 3, 1, "p5")]
    for k in (1, 2):  # outer tiers get nothing
        assert {r[1] for r in chosen(rep.coverage_diversity(papers, edges, k), "breadth_tier")} == {2}


def test_hybrid_against_pandas(spark):
    papers, edges = generated(spark)
    base = edges.join(papers.withColumnRenamed("id", "paper_id"), "paper_id").toPandas()
    base = base[base.title.notna() & (base.title.str.strip() != "")]
    base["breadth"] = base.num_matched_concepts.fillna(1)

    def share(column):
        ranked = base.assign(v=base[column].fillna(-1)).groupby("concept").v
        n = ranked.transform("size")
        return ((ranked.rank(method="min", ascending=False) - 1) / (n - 1)).where(n > 1, 0.0)

    base["score"] = (
        0.5 * share("cited_by_count") + 0.3 * share("publication_year") + 0.2 * share("breadth")
    ).round(9)
    best = base.sort_values(["concept", "score", "paper_id"]).groupby("concept").head(7)
    got = rep.hybrid(papers, edges, 7, score_digits=9).toPandas()
    assert sorted(zip(got.concept, got.paper_id)) == sorted(zip(best.concept, best.paper_id))


def whole_concepts(papers, edges, strategy, k, shard):
    """The definition with window functions over whole concepts."""
    keys = ([shard] if shard else []) + ["concept"]
    on = ["paper_id"] + ([shard] if shard else [])
    rows = edges.join(papers.withColumnRenamed("id", "paper_id"), on)
    rows = rows.where(has_text("title") & has_text("abstract"))
    breadth = F.coalesce("num_matched_concepts", F.lit(1))
    if strategy == "hybrid":
        rows = rows.withColumn("num_matched_concepts", breadth)
        share = lambda c: F.percent_rank().over(W.partitionBy("concept").orderBy(F.desc_nulls_last(c)))
        score = 0.5 * share("cited_by_count") + 0.3 * share("publication_year")
        rows = rows.withColumn("score", F.round(score + 0.2 * share("num_matched_concepts"), 9))
        tile, order, most = F.lit(0), ["score", "paper_id"], F.lit(k)
    else:
        temporal = strategy == "temporal"
        value = F.col("publication_year") if temporal else breadth
        rows = rows.where("publication_year is not null" if temporal else "cited_by_count is not null")
        window = W.partitionBy(*keys).orderBy(value, F.md5("paper_id"), "paper_id")
        tile, order = F.ntile(5 if temporal else 3).over(window), [F.desc_nulls_last("cited_by_count"), "paper_id"]
        most = F.lit(max(1, k // 5)) if temporal else F.when(F.col("tile") == 2, k - 2 * (k // 3)).otherwise(k // 3)
    rows = rows.withColumn("tile", tile)
    place = F.row_number().over(W.partitionBy("concept", "tile").orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= most)


@pytest.mark.parametrize("k", [1, 9, 1500])
@pytest.mark.parametrize(
    "strategy, shard",
    [("temporal", None), ("temporal", "shard"), ("coverage", "shard"), ("hybrid", None)],
)
def test_counts_give_the_rows_of_whole_concepts(spark, strategy, k, shard):
    papers, edges = generated(spark)
    if shard:
        shards = papers.select(F.col("id").alias("paper_id"), "shard")
        edges = edges.join(shards, "paper_id")
    options = {"k": k, "shard_col": shard}
    if strategy == "hybrid":
        options["score_digits"] = 9
    tile = {"temporal": ["time_bucket"], "coverage": ["breadth_tier"], "hybrid": []}[strategy]
    got = rep.select_representatives(papers, edges, strategy, **options)
    want = whole_concepts(papers, edges, strategy, k, shard)
    columns = ["concept", "paper_id", "rank"]
    assert rows(got, *columns, *tile) == rows(want, *columns, *(["tile"] if tile else []))


def test_shards_change_tiles(spark):
    papers, edges = tables(
        spark,
        [paper("a", 2000, 1, shard=0), paper("b", 2001, 2, shard=0),
         paper("c", 2010, 3, shard=1), paper("d", 2011, 4, shard=1)],
        [("x", i) for i in "abcd"],
    )
    sharded = edges.withColumn("shard", F.when(F.col("paper_id").isin("a", "b"), 0).otherwise(1))
    whole = rep.temporal_diversity(papers, edges, 2, time_buckets=2)
    assert chosen(whole, "time_bucket") == [("x", 1, 1, "b"), ("x", 2, 1, "d")]
    parts = rep.temporal_diversity(papers, sharded, 2, shard_col="shard", time_buckets=2)
    assert chosen(parts, "time_bucket") == [("x", 1, 1, "c"), ("x", 2, 1, "d")]


def test_join_stays_in_the_shard(spark):
    papers, edges = tables(
        spark, [paper("a", cites=1, shard=0), paper("a", cites=2, shard=1)], [("x", "a")]
    )
    sharded = edges.withColumn("shard", F.lit(1))
    got = rep.citation_count(papers, sharded, 5, shard_col="shard").collect()
    assert [(r.paper_id, r.cited_by_count) for r in got] == [("a", 2)]


def test_random_depends_on_seed_only(spark):
    papers, edges = generated(spark)
    first = chosen(rep.random_sample(papers, edges, 5))
    moved = rep.random_sample(papers.repartition(7), edges.repartition(3, "paper_id"), 5)
    assert chosen(moved) == first
    assert chosen(rep.random_sample(papers, edges, 5, seed=7)) != first


@pytest.mark.parametrize("strategy", ["citation", "recency", "hybrid", "random"])
def test_ranks_are_contiguous_and_at_most_k(spark, strategy):
    papers, edges = generated(spark)
    got = rep.select_representatives(papers, edges, strategy, 6).toPandas()
    for _, group in got.groupby("concept"):
        assert sorted(group["rank"]) == list(range(1, len(group) + 1))
        assert len(group) <= 6


def test_k_beyond_the_group_limit(spark):
    papers = spark.range(3000).select(
        F.format_string("p%05d", "id").alias("id"), F.lit("t").alias("title"),
        F.lit("a").alias("abstract"), F.lit(2000).alias("publication_year"),
        (F.col("id") % 17).cast("int").alias("cited_by_count"), F.lit(1).alias("num_matched_concepts"),
    )
    edges = papers.select(F.lit("x").alias("concept"), F.col("id").alias("paper_id"))
    got = rep.citation_count(papers, edges, 2000).orderBy("rank").toPandas()
    want = papers.toPandas().sort_values(["cited_by_count", "id"], ascending=[False, True])
    assert list(got.paper_id) == list(want.id[:2000])


def test_named_concepts(spark):
    papers, edges = generated(spark)
    want = [r for r in chosen(rep.citation_count(papers, edges, 3)) if r[0] in ("a", "it's")]
    names = ["a", "it's", "A"]
    assert chosen(rep.citation_count(papers, edges, 3, concepts=names)) == want
    assert len(chosen(rep.citation_count(papers, edges, 3, concepts=[]))) > len(want)


def test_staged_selection_is_the_same(spark, monkeypatch):
    papers, edges = generated(spark)
    want = rows(rep.citation_count(papers, edges, 4))
    staged = rep.citation_count(papers, edges, 4, stage=True)
    assert rows(staged) == want
    assert "BroadcastHashJoin" in staged._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rep, "BROADCAST_BYTES", 0)
    assert rows(rep.citation_count(papers, edges, 4, stage=True)) == want


def test_unknown_strategy(spark):
    papers, edges = generated(spark, 1)
    with pytest.raises(ValueError, match="unknown strategy"):
        rep.select_representatives(papers, edges, "best")


def test_percent_ranks_of_a_single_row(spark):
    papers, edges = tables(spark, [paper("a", None, None, None)], [("x", "a")])
    row = rep.signal_percent_ranks(papers, edges).first()
    assert (row.citation_prank, row.recency_prank, row.breadth_prank) == (0.0, 0.0, 0.0)
    assert isinstance(rep.hybrid(papers, edges).toPandas(), pd.DataFrame)
