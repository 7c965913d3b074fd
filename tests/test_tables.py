"""Consolidation, distribution, pairs and budgets on small tables."""

import itertools
import random
from datetime import date

import numpy as np
import pytest

from citeweave.operators import budget, consolidate, distribution, pairs
from tests.conftest import rows


def test_versions_and_edges(spark):
    papers = spark.createDataFrame(
        [("a", 1, "old", ["x", "y"]), ("a", 2, "new", ["y", "z"]), ("b", None, "only", None),
         ("c", None, "undated", ["x"]), ("c", 1, "dated", [])],
        "id string, batch int, title string, matched_concepts array<string>",
    )
    first = consolidate.first_version(papers, ["batch"])
    assert rows(first, "id", "title") == [("a", "old"), ("b", "only"), ("c", "dated")]
    last = consolidate.latest_version(papers, ["batch"])
    assert rows(last, "id", "title") == [("a", "new"), ("b", "only"), ("c", "dated")]
    assert rows(consolidate.concept_edges(papers)) == [
        ("x", "a"), ("x", "c"), ("y", "a"), ("z", "a")
    ]


def test_versions_stay_apart_per_shard(spark):
    papers = spark.createDataFrame([("a", 1, 0), ("a", 2, 1)], "id string, batch int, shard int")
    assert rows(consolidate.first_version(papers, ["batch"], shard_col="shard")) == [
        ("a", 1, 0), ("a", 2, 1)
    ]


def test_ties_are_settled_by_content(spark):
    data = [("a", 1, str(i)) for i in range(20)]
    columns = "id string, batch int, title string"
    one = rows(consolidate.first_version(spark.createDataFrame(data, columns), ["batch"]))
    two = rows(consolidate.first_version(
        spark.createDataFrame(data[::-1], columns).repartition(5), ["batch"]))
    assert one == two and len(one) == 1


def test_anti_join(spark):
    items = spark.createDataFrame([("a",), ("b",), ("b",)], "f string")
    assert rows(consolidate.not_yet_done(items, items.where("f = 'b'"), ["f"])) == [("a",)]


def counts_frame(spark, counts):
    data = [(f"c{i}", int(n)) for i, n in enumerate(counts)]
    return spark.createDataFrame(data, "concept string, paper_count bigint")


@pytest.mark.parametrize("counts", [[5], [3, 3, 3], [1, 2, 2, 9, 100], list(range(1, 200, 3))])
def test_distribution_against_numpy(spark, counts):
    frame = counts_frame(spark, counts)
    row = distribution.describe_counts(frame).first()
    quartiles = np.percentile(counts, [25, 50, 75])
    assert [row.p25, row.p50, row.p75] == pytest.approx(quartiles)
    assert row["count"] == len(counts)
    assert row["mean"] == pytest.approx(np.mean(counts))
    if len(counts) > 1:
        assert row["std"] == pytest.approx(np.std(counts, ddof=1))
    else:
        assert row["std"] is None

    for bins in (7, 100):
        got = distribution.histogram(frame, bins).orderBy("bin").collect()
        want, edges = np.histogram(counts, bins=bins)
        assert [r.n_concepts for r in got] == list(want)
        assert [r.bin_start for r in got] == pytest.approx(edges[:-1])

    points = distribution.ccdf(frame).orderBy("rank").collect()
    assert [p.paper_count for p in points] == sorted(counts)
    assert [p.ccdf for p in points] == pytest.approx(
        [1 - (i + 1) / len(counts) for i in range(len(counts))]
    )
    assert points[-1].ccdf == 0


def test_ccdf_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(distribution, "CHUNK", 3)
    points = distribution.ccdf(counts_frame(spark, [1] * 10 + [2] * 4)).orderBy("rank").collect()
    assert [p["rank"] for p in points] == list(range(1, 15))


def test_empty_distribution(spark):
    frame = counts_frame(spark, [])
    assert distribution.describe_counts(frame).first()["count"] == 0
    assert rows(distribution.histogram(frame)) == []
    assert rows(distribution.ccdf(frame)) == []


def test_duplicate_edges_count_twice_and_ties_go_by_name(spark):
    edges = spark.createDataFrame(
        [("b", "1"), ("b", "1"), ("a", "1"), ("a", "2"), ("c", "1")], "concept string, paper_id string"
    )
    counts = distribution.concept_counts(edges)
    assert [tuple(r) for r in distribution.top_concepts(counts, 2).collect()] == [("a", 2), ("b", 2)]


PAPERS = "id string, publication_date string, publication_year int"


def test_pairs_by_hand(spark):
    papers = spark.createDataFrame(
        [("p2", "2001-01-01", 2001), ("p1", "2001-01-01", None), ("p3", "2000-5-1", 2000),
         ("bad", "1990", 1990), ("single", "1980-01-01", 1980)],
        PAPERS,
    )
    edges = spark.createDataFrame(
        [(c, p) for p in ("p1", "p2", "bad") for c in ("a", "b")]
        + [("b", "p3"), ("c", "p3"), ("a", "single"), ("a", "absent"), ("c", "absent")]
        + [("a", "p1")],
        "concept string, paper_id string",
    )
    assert rows(pairs.first_cooccurrence(papers, edges)) == [
        ("a", "b", "p1", date(2001, 1, 1), None),
        ("b", "c", "p3", date(2000, 5, 1), 2000),
    ]


@pytest.mark.parametrize("block", [1, 2, 3, 256])
@pytest.mark.parametrize("per_shard", [False, True])
def test_pairs_against_brute_force(spark, block, per_shard):
    pick = random.Random(block)
    data = [(f"p{i}", f"20{pick.randint(10, 20)}-01-0{pick.randint(1, 9)}", i, i % 2) for i in range(60)]
    sets = {p[0]: pick.sample("abcdefghij", pick.randint(0, 8)) for p in data}
    best = {}
    for p, day, year, shard in data:
        for pair in itertools.combinations(sorted(sets[p]), 2):
            key = (shard, *pair) if per_shard else pair
            best[key] = min(best.get(key, ("9",)), (day, p, year))
    want = sorted((*k, p, date.fromisoformat(d), y) for k, (d, p, y) in best.items())
    papers = spark.createDataFrame(data, PAPERS + ", shard int")
    edges = spark.createDataFrame(
        [(c, p, s) for p, _, _, s in data for c in sets[p]],
        "concept string, paper_id string, shard int",
    )
    got = pairs.first_cooccurrence(
        papers, edges, "shard" if per_shard else None, per_shard=per_shard, block=block
    )
    assert sorted(rows(got)) == want


def test_pairs_per_shard_needs_a_shard(spark):
    with pytest.raises(ValueError):
        pairs.first_cooccurrence(None, None, per_shard=True)


def test_budgets(spark):
    chosen = spark.createDataFrame(
        [("x", "abcd", "12345678"), ("x", None, "1234"), ("y", "ab", None)],
        "concept string, title string, abstract string",
    )
    assert rows(budget.tokens_per_concept(chosen)) == [("x", 2, 4.0, 3.0), ("y", 1, 0.5, 0.5)]
    stats = budget.token_stats(chosen).first().asDict()
    assert stats == {
        "total_papers": 3, "total_concepts": 2, "avg_tokens_per_paper": 1.5,
        "max_tokens_per_paper": 3.0, "total_tokens": 4.5, "papers_per_concept": 1.5,
        "avg_tokens_per_concept": 2.25, "max_tokens_per_concept": 4.0,
        "median_tokens_per_paper": 1.0,
    }
    empty = budget.token_stats(chosen.limit(0)).first()
    assert (empty.total_papers, empty.papers_per_concept) == (0, 0.0)
    checks = budget.budget_check(chosen, [2002, 8192], 2000)
    assert rows(checks, "concept", "context_window", "exceeds_budget") == [
        ("x", 2002, True), ("x", 8192, False), ("y", 2002, False), ("y", 8192, False)
    ]


def test_recommended_k_floors_negative_budgets(spark):
    windows = spark.createDataFrame([(8192,), (1000,)], "context_window bigint")
    assert rows(budget.recommend_k(windows)) == [(1000, -1000, -7, -4, -3), (8192, 6192, 41, 22, 15)]
