"""Papers that arrive in any order, are corrected and lose concepts, against the whole."""

import os
import random

import pytest
from pyspark.sql import functions as F

from citeweave.operators import representatives as rep
from citeweave.operators.consolidate import concept_edges
from citeweave.operators.semifilter import may_match
from citeweave.plans import adapters as A
from citeweave.plans import catalog
from citeweave.streaming import topk
from tests.conftest import rows

SCHEMA = (
    "id string, title string, abstract string, publication_year int, cited_by_count int,"
    " matched_concepts array<string>, num_matched_concepts int, updated_date string"
)
K = 4
OPTIONS = {"recency": {"score_digits": 6}, "hybrid": {"score_digits": 6}, "temporal": {"time_buckets": 3}}


def waves(n=90, seed=5):
    """Three waves of versions, and the newest version of each paper."""
    r, waves, newest = random.Random(seed), [[], [], []], {}
    for i in range(n):
        versions = r.sample("123456789", r.randint(1, 3))
        for at, version in enumerate(versions):
            concepts = r.sample("abc", r.randint(0, 3)) + r.choice([[], [None]])
            # Early waves tend to overstate what later ones take back.
            cites = r.choice([None, 1, 2, 3, 50 * (3 - at)])
            row = (
                f"p{i}", r.choice(["t", "t", f"title {version}", " ", None]), r.choice(["a", f"a{version}"]),
                r.choice([None, 1999, 2001, 2020]), cites, concepts, r.choice([None, 1, 2]), version,
            )
            waves[r.choice([at, at, 0])].append(row)
            if i not in newest or version > newest[i][-1]:
                newest[i] = row
    waves[1].append((None, "t", "a", 2000, 9999, ["a"], 1, "9"))
    waves[2].append(waves[0][0])
    return waves, list(newest.values())


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    """State of all strategies after the three waves, with a reserve of one row."""
    folder = str(tmp_path_factory.mktemp("arrived"))
    parts, newest = waves()
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/papers")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/papers")
        topk.update_representatives(
            spark, stream, f"{folder}/state", f"{folder}/progress", list(rep.STRATEGIES), K,
            reserve=1, options=OPTIONS,
        )
    return folder, spark.createDataFrame(newest, SCHEMA)


@pytest.mark.parametrize("strategy", list(rep.STRATEGIES))
def test_state_is_the_whole(spark, arrived, strategy):
    folder, newest = arrived
    options = OPTIONS.get(strategy, {})
    texts = spark.read.parquet(f"{folder}/papers")
    edges = concept_edges(newest)
    want = rep.select_representatives(newest, edges, strategy, K, **options)
    got = topk.current_representatives(spark, f"{folder}/state", texts, strategy, K, **options)
    assert want.count() > K and rows(got, *want.columns) == rows(want)


def test_old_states_go_and_changes_stay(arrived):
    folder, _ = arrived
    held = [n for n in os.listdir(f"{folder}/state/citation/held") if n.startswith("batch")]
    changes = [n for n in os.listdir(f"{folder}/state/changes") if n.startswith("batch")]
    assert sorted(held) == ["batch_id=1", "batch_id=2"] and len(changes) == 3
    assert not os.path.exists(f"{folder}/state/citation/merged")


def test_state_holds_no_text(spark, arrived):
    folder, _ = arrived
    for table in ("changes", "citation/held", "hybrid/counts"):
        columns = spark.read.parquet(f"{folder}/state/{table}").columns
        assert not {"title", "abstract"} & set(columns)


def test_nothing_new_changes_nothing(spark, arrived):
    folder, _ = arrived
    texts = spark.read.parquet(f"{folder}/papers")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/papers")
    before = rows(topk.current_representatives(spark, f"{folder}/state", texts, "citation", K))
    topk.update_representatives(
        spark, stream, f"{folder}/state", f"{folder}/progress", list(rep.STRATEGIES), K
    )
    assert rows(topk.current_representatives(spark, f"{folder}/state", texts, "citation", K)) == before


def test_filter_keeps_every_wanted_key(spark):
    data = spark.range(5000).withColumn("name", F.concat(F.lit("n"), "id"))
    keys = spark.range(0, 5000, 7).select(F.concat(F.lit("n"), "id").alias("wanted"))
    for cells in (64, 1 << 10, 1 << 26):
        kept = may_match(data, F.col("name"), keys, F.col("wanted"), cells)
        assert kept.columns == data.columns
        assert kept.where("id % 7 = 0").count() == 715
        assert cells < 1 << 26 or kept.count() == 715
    assert may_match(data, F.col("name"), keys.limit(0), F.col("wanted")).count() == 0


def test_changes_of_other_cells_are_not_set_off(spark, fresh_dir):
    years = [(f"p{i}", 2000 + i % 5, i % 7, i % 3 - 1 or 1) for i in range(200)]
    changes = spark.createDataFrame(years, "paper_id string, publication_year int, cited_by_count int, sign int")
    changes = changes.withColumns(
        {"concept": F.lit("c"), "content": F.lit(0).cast("long"), "num_matched_concepts": F.lit(None).cast("int")}
    )
    changes = changes.unionByName(changes.where("cited_by_count = 3").withColumn("sign", F.lit(-1)))
    changes.write.parquet(f"{fresh_dir}/changes")
    changes = spark.read.parquet(f"{fresh_dir}/changes")
    for strategy in ("temporal", "coverage", "hybrid"):
        kept = topk.kept_by(strategy)
        every = kept.placed(topk._live(changes))
        cells = every.select(*topk.CELL).distinct().where("crc32(cell) % 3 = 0")
        found = kept.live_in(changes, cells)
        want = every.join(cells, topk.CELL, "left_semi").select(*found.columns)
        assert rows(found) == rows(want)
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        # The cells are chosen below the sum of the signs, on the changes as they are stored.
        assert next(i for i, line in enumerate(plan) if "LeftSemi" in line) > next(
            i for i, line in enumerate(plan) if "sum(sign" in line
        )


def test_a_wave_of_papers_is_read_by_many_tasks(spark, fresh_dir, monkeypatch):
    orders = [(i, i % 9, "O", 1000.0 * (i % 50), "1-URGENT", f"199{i % 8}-01-01") for i in range(300)]
    spark.createDataFrame(
        orders,
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
        " o_orderpriority string, o_orderdate string",
    ).withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{fresh_dir}/orders.parquet")
    lines = [(i, j) for i in range(300) for j in range(i % 3 + 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{fresh_dir}/lineitem.parquet")
    parts = [(j, f"Part {j}") for j in range(3)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{fresh_dir}/part.parquet")
    files = []
    monkeypatch.setattr(
        catalog.topk, "update_representatives",
        lambda spark, stream, *args, **options: files.append(len(spark.read.parquet(arriving[0]).inputFiles())),
    )
    monkeypatch.setattr(catalog.topk, "current_representatives", lambda *args, **options: None)
    arriving = []
    scratch = catalog.scratch_dir
    monkeypatch.setattr(catalog, "scratch_dir", lambda *a: arriving.append(scratch(*a)) or arriving[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog._arrived(A.Tables(spark, fresh_dir), "citation")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) == 2  # a batch each
    assert files[0] > 2 and files[1] - files[0] > 2


def test_changes_of_a_batch_are_set_off_without_a_shuffle(spark):
    shown = "id string, content long, publication_year int, cited_by_count int, num_matched_concepts int, concepts array<string>"
    old = ", ".join(f"old_{c}" for c in shown.split(", ")[1:])
    accepted = spark.createDataFrame(
        [
            ("new", 1, 2000, 5, 1, ["a", "b"], None, None, None, None, None),
            ("same", 2, None, 5, 1, ["a", "b"], 2, None, 5, 1, ["b", "c"]),
            ("told", 3, 2000, 5, 1, ["a"], 4, 2000, 5, 1, ["a"]),
            ("cited", 5, 2000, 6, 1, ["a"], 5, 2000, 5, 1, ["a"]),
        ],
        f"{shown}, {old}",
    )
    changes = topk.concept_changes(accepted)
    assert rows(changes) == rows(topk.net_changes(changes))
    assert rows(changes, "paper_id", "concept", "sign") == sorted([
        ("new", "a", 1), ("new", "b", 1), ("same", "a", 1), ("same", "c", -1),
        ("told", "a", 1), ("told", "a", -1), ("cited", "a", 1), ("cited", "a", -1),
    ], key=repr)
    assert "Exchange" not in changes._jdf.queryExecution().executedPlan().toString()
