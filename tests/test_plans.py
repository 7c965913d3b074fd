"""Plan shapes that large inputs depend on."""

import re

import pytest
from pyspark.sql import functions as F

from citeweave.operators import consolidate, distribution, pairs
from citeweave.operators import representatives as rep
from citeweave.sources import sinks


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    spark.range(1000).select(
        F.concat(F.lit("p"), "id").alias("id"), F.lit("t").alias("title"),
        F.lit("a").alias("abstract"), F.lit(2000).alias("publication_year"),
        F.lit("2000-01-01").alias("publication_date"), F.lit("d").alias("doi"),
        F.col("id").cast("int").alias("cited_by_count"), F.lit(1).alias("num_matched_concepts"),
    ).write.parquet(f"{folder}/papers")
    spark.range(3000).select(
        F.concat(F.lit("c"), F.col("id") % 7).alias("concept"),
        F.concat(F.lit("p"), F.col("id") % 1000).alias("paper_id"),
    ).distinct().write.parquet(f"{folder}/edges")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(f"{folder}/papers"), spark.read.parquet(f"{folder}/edges")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def ancestors(lines, at):
    """The nodes above a line of a plan, nearest first."""
    depth = lambda line: re.search("[A-Za-z]", line).start()
    found, deepest = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < deepest:
            found.append(line)
            deepest = depth(line)
    return found


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(stored):
    text = plan(rep.citation_count(*stored, stage=False))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_text_is_not_ranked(stored):
    text = plan(rep.citation_count(*stored, stage=False))
    window = next(line for line in text.splitlines() if "+- Window [" in line or "- Window [" in line)
    assert "title" not in window and "abstract" not in window
    limits = [line for line in text.splitlines() if "Sort [concept" in line]
    assert limits and all("title" not in line for line in limits)


def test_scan_reads_needed_columns_and_filters(stored):
    text = plan(rep.recency_weighted(*stored, concepts=["c1", "c2"], stage=False))
    assert "doi" not in text and "publication_date" not in text
    assert "In(concept, [c1,c2])" in text


@pytest.mark.parametrize("strategy", ["temporal", "coverage", "hybrid"])
def test_no_cross_joins(stored, strategy):
    text = plan(rep.select_representatives(*stored, strategy, stage=False))
    assert "Cartesian" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("strategy", list(rep.STRATEGIES))
@pytest.mark.parametrize("limit", [None, 0])
def test_texts_of_papers_not_chosen_are_not_moved(stored, monkeypatch, strategy, limit):
    """Text is scanned and filtered; only what passes the filter is sorted or shuffled."""
    if limit is not None:
        monkeypatch.setattr(rep, "BROADCAST_BYTES", limit)
    lines = plan(rep.select_representatives(*stored, strategy, 3)).splitlines()
    scan = next(i for i, line in enumerate(lines) if "abstract" in line and "FileScan" in line)
    above = ancestors(lines, scan)
    moves = [i for i, line in enumerate(above) if "Exchange" in line or "- Sort [" in line]
    if limit is None:
        assert not moves
    else:
        filters = [i for i, line in enumerate(above) if "BroadcastHashJoin [_cell_word" in line]
        assert moves and filters and filters[0] < moves[0]


def test_pairs_aggregate_by_hash_and_need_no_self_join(stored):
    text = plan(pairs.first_cooccurrence(*stored))
    assert "SortAggregate" not in text and "Cartesian" not in text
    assert text.count("/edges]") == 1


def test_counts_are_planned_once(stored):
    counts = distribution.concept_counts(stored[1])
    for frame in (distribution.histogram(counts), distribution.describe_counts(counts)):
        text = frame._jdf.queryExecution().toString()
        assert text[text.index("== Physical Plan ==") :].count("/edges]") == 1


def test_rows_that_stand_alone_are_not_moved(stored):
    lines = plan(consolidate.first_version(stored[0], ["publication_date"])).splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "abstract" in line]
    paths = [ancestors(lines, i) for i in scans]
    moved = [any("Exchange" in line or "- Sort [" in line for line in path) for path in paths]
    assert sorted(moved) == [False, True]  # single papers; papers of repeated ids
    assert all(any("BroadcastHashJoin [_cell_word" in line for line in path) for path in paths)


def test_counts_are_pre_aggregated(stored):
    text = plan(distribution.concept_counts(stored[1]))
    assert text.count("HashAggregate") == 2 and "ReadSchema: struct<concept:string>" in text


def test_bucketed_tables_join_without_a_shuffle(spark, stored):
    sinks.save_joinable(*stored, "joinable", 4)
    papers, edges = spark.table("joinable_papers"), spark.table("joinable_edges")
    frame = rep.citation_count(papers, edges, 2, stage=False)
    text = plan(frame)
    assert text.count("Exchange hashpartitioning(paper_id") == 1  # text fetch, chosen side only
    assert sorted(frame.collect()) == sorted(rep.citation_count(*stored, 2).collect())


def test_stored_flag_keeps_text_out_of_ranking(spark, stored, tmp_path):
    sinks.write_papers(stored[0], f"{tmp_path}/papers")
    papers = spark.read.parquet(f"{tmp_path}/papers")
    text = plan(rep.citation_count(papers, stored[1], stage=False))
    assert text.count("abstract:string") == 1
