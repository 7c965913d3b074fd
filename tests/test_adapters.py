"""The given tables as works: what the stored queries are made from."""

import re

from pyspark.sql import functions as F

from citeweave.plans import adapters as A
from citeweave.plans import catalog

DOCS = [
    (1, "b a\nb  c"), (2, ""), (3, None), (4, " x "), (None, "lost words"),
    (7, "same text same"), (7, "same text same"), (8, "one two"), (8, "two three three"),
]


def tables(spark, fresh_dir, rows):
    documents = [(i, text, "en", "web", len(text or "")) for i, text in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents, schema).write.parquet(f"{fresh_dir}/documents.parquet")
    return A.Tables(spark, fresh_dir)


def test_index_of_words_and_positions(spark, fresh_dir):
    found = A.document_works(tables(spark, fresh_dir, DOCS)).collect()
    assert len(found) == len(DOCS)
    for row in found:
        index = {}
        for doc_id, text in DOCS:
            if row.id is not None and row.id == f"D{doc_id}":
                for pos, word in enumerate((text or "").split()):
                    index.setdefault(word, []).append(pos)
        want = {word: sorted(places) for word, places in index.items()} or None
        assert row.abstract_inverted_index == want, row.id


def test_works_move_texts_once_and_no_words(spark, fresh_dir):
    made = A._document_works(tables(spark, fresh_dir, DOCS))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange \w+partitioning", plan, re.IGNORECASE)) == 1
    assert "Generate" not in plan


def test_files_of_a_date_are_written_by_many_tasks(spark, fresh_dir):
    path = catalog._write_works(tables(spark, fresh_dir, [(i, f"word {i}") for i in range(600)]))
    files = spark.read.text(path).groupBy("updated_date").agg(
        F.countDistinct("_metadata.file_name").alias("n"), F.count(F.lit(1)).alias("lines")
    )
    rows = files.collect()
    assert [r.lines for r in rows] == [200, 200, 200]
    assert all(r.n > 1 for r in rows)
