"""Large groups that share much and are not linked, and work that is done once."""

import random

from pyspark.sql import functions as F

from citeweave.llm import common, components, jaccard, licences, line_dedup

MEMBERS = 40


def _family(changes):
    """Texts of one text's words, each with words of its own; the last ones are one word apart."""
    r = random.Random(5)
    out = []
    for member in range(MEMBERS):
        words = [f"w{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}{'xy'[i // 100]}" for i in range(150)]
        for at in r.sample(range(150), changes):
            words[at] = "own" + "".join(r.choices("klmnopqrst", k=6))
        out.append(words)
    return [" ".join(x) for x in out] + [" ".join(["other", *out[-1][1:]])]


def _last_verified(monkeypatch):
    """Numbers of pairs that were handed on to be verified, in order."""
    counts, run = [], components._verified_more

    def counted(spark, found, pairs, verify):
        counts.append(pairs.count())
        return run(spark, found, pairs, verify)

    monkeypatch.setattr(components, "_verified_more", counted)
    return counts


def test_unlike_documents_of_a_family_are_not_all_verified(spark, monkeypatch):
    counts = _last_verified(monkeypatch)
    table = spark.createDataFrame(list(enumerate(_family(6))), "doc_id long, text string")
    found = jaccard.similar_documents(spark, table.repartition(3), sketch_cells=64)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert got == {i: min(i, MEMBERS - 1) for i in range(MEMBERS + 1)}
    assert counts[-1] < MEMBERS


def test_unlike_lines_of_a_family_are_not_all_verified(spark, monkeypatch):
    counts = _last_verified(monkeypatch)
    table = spark.createDataFrame(list(enumerate(_family(40))), "doc_id long, text string")
    lost = line_dedup.similar_lines(spark, table.repartition(3), blocks=10_000).collect()
    assert [(r["doc_id"], r["lines"]) for r in lost] == [(MEMBERS, [0])]
    assert counts[-1] < MEMBERS


def test_sketches_differ_in_no_more_cells_than_items(spark):
    sets = {1: list(range(400)), 2: [*range(20, 400), *range(900, 910)], 3: [5, 5], 4: [7]}
    rows = [(i, x) for i, items in sets.items() for x in items]
    drawn = components.parity_sketches(spark.createDataFrame(rows, "id long, item long")).collect()
    drawn = {r["id"]: [r[c] for c in components.SKETCH_COLUMNS] for r in drawn}

    def differing(a, b):
        return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(drawn[a], drawn[b], strict=True))

    assert 0 < differing(1, 2) <= 30 and (30 - differing(1, 2)) % 2 == 0
    assert differing(3, 4) == 1 and drawn[3] == [0] * components.SKETCH


def test_a_licence_form_is_worked_out_once(spark):
    texts = spark.range(1).select(F.col("id").cast("string").alias("text"))
    plan = texts.select(licences.digest(F.col("text")).alias("digest"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count(licences.NOT_IN_WORDS) == 1


def test_ids_meet_few_of_a_component_they_belong_to(spark, monkeypatch):
    """A group of which no pivot is linked to most, though neighbours make it one component."""
    counts, n, reach = _last_verified(monkeypatch), 1000, 200
    rows = spark.createDataFrame([(1, i, i) for i in range(n)], "key long, id long, value long")

    def verify(pairs):
        assert pairs.where(F.abs(F.col("a") - F.col("b")) > reach).isEmpty()
        return common.stored(spark, pairs, "links")

    found = components.counted_components(
        spark, rows, verify, lambda a, b: F.abs(a - b) <= reach, lambda a, b: F.lit(1)
    )
    assert {(r["id"], r["component"]) for r in found.collect()} == {(i, 0) for i in range(1, n)}
    assert sum(counts) < n * reach / 10


def test_ids_with_too_few_shared_keys_are_left_out(spark):
    # Ids 1 to 3 share one key, 4 and 5 share two.
    rows = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 1), (3, 3), (4, 4), (5, 4), (4, 5), (5, 5), (6, 1)]
    table = spark.createDataFrame([(k, i, 10) for k, i in rows], "key long, id long, value long")
    held = []
    found = components.counted_components(
        spark,
        table,
        lambda pairs: common.stored(spark, pairs, "links"),
        lambda a, b: F.lit(True),
        lambda a, b: F.lit(2),
        least=lambda value, low: F.lit(2),
        prepare=lambda ids: held.extend(sorted(r["id"] for r in ids.collect())),
    )
    assert held == [1, 2, 3, 4, 5]
    assert [(r["id"], r["component"]) for r in found.collect()] == [(5, 4)]
