import gzip
import json
import os
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from citeweave.operators import representatives as rep
from citeweave.operators import tagging
from citeweave.operators.consolidate import concept_edges
from citeweave.sources import sinks, tables, works
from citeweave.streaming import ingest
from tests.conftest import rows


def write_works(folder, day, name, lines):
    path = f"{folder}/updated_date={day}"
    os.makedirs(path, exist_ok=True)
    with gzip.open(f"{path}/{name}", "wt", encoding="utf-8") as out:
        out.writelines(line if isinstance(line, str) else json.dumps(line) + "\n" for line in lines)


def work(i, title="Deep learning", index=None, **more):
    return {"id": i, "title": title, "abstract_inverted_index": index, "publication_year": 2020,
            "cited_by_count": 1, **more}


def dictionary(spark, fresh_dir):
    path = f"{fresh_dir}/concepts.txt"
    with open(path, "w") as out:
        out.write("Deep Learning\n\n  graph \ngraph\nlearning on\n")
    return tables.load_dictionary(spark, path)


LINES = [
    work("w1", index={"on": [0], "graphs": [1]}, counts_by_year=[{"year": 2020, "n": 1}]),
    "\n",
    "not json\n",
    work("w2", title=None, index=json.dumps({"a": [0], "graph": [1]}), cited_by_count=None),
    work("w3", title="graph", index={"x": [0], "y": 5}),
    work("w4", title="nothing here"),
    {"title": "graph without id"},
    work("w5", publication_year=1990),
    work("w6", publication_year=0),
]


def test_works_to_papers(spark, fresh_dir):
    write_works(fresh_dir, "2024-01-01", "a.gz", LINES)
    write_works(fresh_dir, "2024-01-01", "skip.txt", [work("w9")])
    write_works(fresh_dir, "2024-01-02", "b.gz", [work("w7")])
    raw = works.read_works(spark, fresh_dir)
    assert raw.count() == len(LINES) - 1 + 1
    counts = works.corrupt_counts(raw).where("source_file LIKE '%a.gz'").first()
    assert (counts.n_lines, counts.n_dropped) == (8, 1)

    parsed = tagging.parse_works(works.usable(raw), 2000, None)
    papers = tagging.tag_papers(parsed, dictionary(spark, fresh_dir))
    assert rows(papers, "id", "title", "abstract", "cited_by_count", "matched_concepts") == [
        ("", "graph without id", "", 0, ["graph"]),
        ("w1", "Deep learning", "on graphs", 1, ["deep learning", "learning on"]),
        ("w2", "", "a graph", 0, ["graph"]),
        ("w3", "graph", "x", 1, ["graph"]),
        ("w6", "Deep learning", "", 1, ["deep learning"]),
        ("w7", "Deep learning", "", 1, ["deep learning"]),
    ]
    first = papers.where("id = 'w1'").first()
    assert json.loads(first.counts_by_year) == [{"year": 2020, "n": 1}]
    assert first.num_matched_concepts == 2 and first.processed_date is not None
    assert papers.where("id = 'w2'").first().counts_by_year == "[]"
    assert {r[1] for r in rows(tagging.ingest_counters(papers))} == {5, 1}


def test_update_dates_prune_partitions(spark, fresh_dir):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        write_works(fresh_dir, day, "a.gz", [work(day)])
    picked = works.read_works(spark, fresh_dir, ["2024-01-01", "2024-01-03"])
    assert rows(picked, "id") == [("2024-01-01",), ("2024-01-03",)]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_stream_reads_every_file_once(spark, fresh_dir):
    source, out, progress = (f"{fresh_dir}/{n}" for n in ("works", "out", "progress"))
    names = dictionary(spark, fresh_dir)
    write_works(source, "2024-01-01", "a.gz", LINES)
    write_works(source, "2024-01-01", "b.gz", [work("w1", title="older graph"), work("w8")])

    def run():
        ingest.ingest_works(spark, source, names, out, progress, files_per_trigger=1)
        return ingest.ingested_versions(spark, out).count()

    assert run() == 8
    assert run() == 8
    write_works(source, "2024-02-01", "c.gz", [work("w1", title="newer graph"), work("w4")])
    assert run() == 10
    latest = {r.id: r for r in ingest.ingested_papers(spark, out).collect()}
    assert latest["w1"].title == "newer graph"
    ledger = ingest.ingest_ledger(spark, out)
    assert rows(ledger, "n_lines", "n_damaged", "n_works", "n_papers") == [
        (2, 0, 2, 2), (2, 0, 2, 2), (8, 1, 7, 6)
    ]
    assert os.listdir(f"{out}/parsed") == []
    assert sorted(latest) == ["", "w1", "w2", "w3", "w4", "w5", "w6", "w8"]


def generated_papers(spark, n=120):
    pick = random.Random(5)
    data = [
        (f"p{i}", "t", "a", pick.choice([None, 2001, 2020]), pick.choice([None, 1, 2, 3]),
         pick.sample("abc", pick.randint(1, 3)))
        for i in range(n)
    ]
    return spark.createDataFrame(
        data,
        "id string, title string, abstract string, publication_year int, cited_by_count int,"
        " matched_concepts array<string>",
    ).withColumn("num_matched_concepts", F.size("matched_concepts"))


def test_sinks(spark, fresh_dir):
    papers = generated_papers(spark)
    edges = concept_edges(papers)
    sinks.write_papers(papers, f"{fresh_dir}/papers", rows_per_file=10)
    assert len(tables.read_table(spark, f"{fresh_dir}/papers").inputFiles()) >= 12
    sinks.write_edges(edges, f"{fresh_dir}/edges")
    assert rows(tables.read_table(spark, f"{fresh_dir}/edges")) == rows(edges)
    chosen = rep.temporal_diversity(papers, edges, 5)
    sinks.write_representatives(chosen, f"{fresh_dir}/chosen")
    files = tables.read_table(spark, f"{fresh_dir}/chosen")
    assert rows(files) == rows(chosen)
    assert all(".zstd." in f for f in files.inputFiles())
    counts = edges.groupBy("concept").agg(F.count("*").alias("paper_count"))
    sinks.write_distribution(counts, f"{fresh_dir}/counts")
    back = spark.read.option("header", True).csv(f"{fresh_dir}/counts")
    assert back.columns == ["concept", "paper_count"] and back.count() == 3
    with pytest.raises(AnalysisException):
        sinks.write_edges(edges, f"{fresh_dir}/edges")


def test_shards_from_folders_and_files(spark, fresh_dir):
    edges = spark.createDataFrame([("a", "1", 0), ("b", "2", 1)], "concept string, paper_id string, shard int")
    edges.write.partitionBy("shard").parquet(f"{fresh_dir}/byfolder")
    assert rows(tables.read_table(spark, f"{fresh_dir}/byfolder", "shard")) == rows(edges)
    edges.drop("shard").coalesce(1).write.parquet(f"{fresh_dir}/byfile")
    named = tables.read_table(spark, f"{fresh_dir}/byfile", "shard")
    assert named.select("shard").distinct().count() == 1
    with pytest.raises(AnalysisException):
        tables.read_table(spark, f"{fresh_dir}/missing")
