"""Works to summaries, end to end."""

from citeweave import jobs
from citeweave.sources.tables import read_table
from citeweave.streaming import ingest
from tests.conftest import rows
from tests.test_sources_and_streams import dictionary, work, write_works
from tests.test_summaries import scorer


def test_works_to_summaries(spark, fresh_dir):
    path = lambda name: f"{fresh_dir}/{name}"
    write_works(path("works"), "2024-01-01", "a.gz", [
        work(f"w{i}", index={"graph": [0]}, cited_by_count=i, publication_date=f"2020-01-0{i + 1}")
        for i in range(5)
    ])
    names = dictionary(spark, fresh_dir)
    ingest.ingest_works(spark, path("works"), names, path("ingest"), path("progress"))
    jobs.consolidate_job(spark, path("ingest"), path("tables"))
    assert read_table(spark, path("tables/edges")).count() == 10

    stats, over = jobs.representatives_job(
        spark, path("tables"), path("chosen"), "citation", 2, context_window=2001
    )
    assert stats.first().total_papers == 4
    assert rows(over, "concept") == [("deep learning",), ("graph",)]

    report = jobs.distribution_job(spark, path("tables"), path("counts.csv"))
    assert rows(report["top"]) == [("deep learning", 5), ("graph", 5)]
    assert report["describe"].first()["mean"] == 5.0

    preview = jobs.pairs_job(spark, path("tables"), path("pairs"))
    assert rows(preview, "concept1", "concept2", "first_paper_id") == [
        ("deep learning", "graph", "w0")
    ]

    ticks = iter([10.0, 14.0])
    run = jobs.summaries_job(
        spark, path("chosen"), path("summaries"), scorer, "fake", clock=lambda: next(ticks)
    )
    assert run.first().tokens_per_second == 5.0
    results = spark.read.json(path("summaries/results"))
    assert rows(results, "id", "concept", "parse_ok") == [
        (0, "deep learning", True), (1, "graph", True)
    ]
    header = spark.read.json(path("summaries/run")).first()
    assert (header.model, header.total_concepts, header.json_parse_ok) == ("fake", 2, 2)
    assert spark.read.json(path("summaries/raw_responses")).count() == 2
