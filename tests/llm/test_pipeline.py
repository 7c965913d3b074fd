"""The pipeline's stages on the smallest table: what each keeps, and that all have an effect."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from citeweave.llm import queries
from citeweave.llm.common import find_words
from tests.llm.test_lines import _brute as line_brute
from tests.llm.test_operators import brute_components

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(spark, stage(spark, docs, FOLDER), name.replace(" ", "-"))
        assert docs.columns == columns
        assert docs.where("n_chars <> char_length(text)").count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0]
    packed = corpus_pipeline.packed(spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, FOLDER).count() == packed.count()


def _documents():
    """Texts that every stage has something to do with; one id stands at two texts."""
    r, texts = random.Random(21), []
    line = lambda n: " ".join(r.choice(VOCABULARY) + str(r.randint(0, 99)) for _ in range(n))
    passage = line(60)
    for _ in range(14):
        texts.append("\n".join(line(r.randint(9, 30)) for _ in range(4)))
    texts += texts[:2] + [texts[3].replace("\n", " ") + " more", "short text", "", None]
    texts += [f"{line(30)} {passage} {line(20)}" for _ in range(3)] + [texts[5] + "\n" + texts[6]]
    texts += ["again " * 80, "\n".join([line(25), "x " + line(24), texts[8].split("\n")[0]])]
    ids = [*range(len(texts))]
    ids[9] = 4
    return list(zip(ids, texts, strict=True))


VOCABULARY = ["tree", "stone", "Öl", "river", "été", "cloud"]


def _kept_by_base_rules(text):
    words = find_words(text or "")
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words) >= 50 and 100 * len(again) <= 50 * len(words)


def test_every_stage_equals_a_plain_run(spark, tmp_path):
    rows = [x for x in _documents()]
    schema = "doc_id long, text string, lang string, source string, n_chars int, h long, _lost string"
    table = spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows] + [(None, rows[0][1], None, None, 1, 1, "x")], schema
    )
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    shown = lambda frame: sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)

    want = sorted([x for x in rows if _kept_by_base_rules(x[1])], key=repr)
    docs = stages["quality rules"](spark, table, folder)
    assert shown(docs) == want and docs.columns == table.columns and len(want) < len(rows) - 3

    # Rows in order of id, then text key, stand for the documents of the line test.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()
    keyed = sorted(keyed, key=lambda x: (x["doc_id"], x["k"] % (1 << 31)))
    lost = line_brute([x["text"] for x in keyed], [x["doc_id"] for x in keyed])
    cut = []
    for at, x in enumerate(keyed):
        kept = "\n".join(y for k, y in enumerate(x["text"].split("\n")) if k not in lost.get(at, ()))
        if at not in lost or find_words(kept):
            cut.append((x["doc_id"], kept))
    docs = stages["line dedup"](spark, docs, folder)
    assert shown(docs) == sorted(cut, key=repr) and lost

    groups = brute_components(cut)
    docs = stages["n-gram Jaccard join"](spark, docs, folder)
    firsts = collections.Counter(c for _, _, c in groups)
    # Both texts of the repeated id are first in a group of their own.
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted([*firsts, 4])
    assert set(shown(docs)) <= set(cut)

    left = shown(docs)
    want = [(i, kept) for i, kept in plain_passages(left) if kept]
    docs = stages["substring dedup"](spark, docs, folder)
    assert shown(docs) == sorted(want, key=repr) and sum(map(len, want)) and want != left

    library = Tokenizer.from_file(queries.tokenizer_path())
    packed = stages["best-fit packing"](spark, docs, folder).collect()
    sizes = collections.Counter()
    for piece in packed:
        sizes[piece["doc_id"]] += piece["length"]
    tokens = collections.Counter()
    for i, text in want:
        tokens[i] += len(library.encode(text, add_special_tokens=False).ids) + 1
    assert sizes == tokens


def plain_passages(rows, length=50):
    split = [(i, find_words(t), t) for i, t in rows]
    first = {}
    for i, w, _ in split:
        for s in range(len(w) - length + 1):
            run = tuple(w[s : s + length])
            first[run] = min(i, first.get(run, i))
    for i, w, text in split:
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < i:
                gone.update(range(s, s + length))
        yield i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text
