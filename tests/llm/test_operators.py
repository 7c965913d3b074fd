"""Operators on a small table with awkward rows, against plain Python."""

import collections
import hashlib
import itertools
import os
import random
import zlib
from math import comb

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeweave.llm import (
    bpe,
    components,
    jaccard,
    licences,
    nbsvm,
    neighbours,
    packing,
    quality_rules,
    queries,
    substring,
    toxicity,
)
from citeweave.llm.common import find_words, window_hashes, word_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, key long, class string, h long, vector int"


def _sentence(r, n):
    return " ".join(r.choice(["the", "of", "able", "Tree,", "rivers", "é1", "stone"]) + str(r.randint(0, 30)) for _ in range(n))


def _texts():
    r = random.Random(5)
    base = [_sentence(r, r.randint(3, 90)) for _ in range(30)]
    passage = _sentence(r, 60)
    texts = [None, "", " \n\t", "one", "two words", "<|endoftext|> it's Σ", "a" * 9000]
    texts += base + base[:6]
    for t in base[6:14]:  # near copies
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [_sentence(r, 8) + " " + passage + " " + _sentence(r, 5) for _ in range(5)]
    texts += ["\n".join([base[20], "12 34", base[21], base[20].upper() + "!"])] * 2
    texts.append("\n".join(_sentence(r, 12) for _ in range(400)))
    return texts


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, 1, "x", 2, 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return find_words(text or "")


def test_window_hashes_follow_content():
    hashes = word_hashes(["a", "b", "c", "a", "b", "c", "d"])
    for length in (1, 2, 3, 5, 7, 8):
        got = window_hashes(hashes, length)
        assert len(got) == max(0, 8 - length)
    three = window_hashes(hashes, 3)
    assert three[0] == three[3] and len(set(three.tolist())) == 4


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    found = components.components(spark, spark.createDataFrame(links, "a long, b long"))
    got = {r["id"]: r["component"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}


def test_licences(spark, docs, nothing):
    known = spark.createDataFrame([("B", "Some Licence,\nversion 2"), ("A", "some license VERSION 2!")], "licence string, text string")
    texts = ["Copyright 2020 X\nSome  license; Version 2.", "some license", None, "", "(c) me"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(table, known).collect()}
    assert [got[i]["licence"] for i in range(5)] == ["A", None, None, None, None]
    assert [got[i]["digest"] is None for i in range(5)] == [False, False, True, True, True]
    assert licences.scan(docs, known).count() == len(TEXTS)
    assert licences.scan(nothing, known).count() == 0


def test_bpe_equals_library(docs, nothing):
    library = Tokenizer.from_file(PATH)
    for row in bpe.encode_decode(docs, PATH).collect():
        ids = library.encode(TEXTS[row["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(row["ids"]), "<u4").tolist() == ids
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(nothing, PATH).count() == 0


def test_bpe_on_random_characters():
    library, model, r = Tokenizer.from_file(PATH), bpe.Vocabulary(PATH), random.Random(3)
    alphabet = "abcdehinorst'éñ!?<|>Σ1ß漢́ "
    chunks = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    want = [library.encode(c, add_special_tokens=False).ids for c in chunks]
    assert model.encode_chunks(chunks) == want


def test_packing(spark, docs, nothing):
    library = Tokenizer.from_file(PATH)
    pieces = packing.token_pieces(docs, PATH, capacity=64)
    got = packing.pack(spark, pieces, capacity=64, groups=6).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for row in got:
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
        by_doc[row["doc_id"]].append(row)
    assert len(by_doc) == len(TEXTS)
    for i, rows in by_doc.items():
        ids = [*library.encode(TEXTS[i] or "", add_special_tokens=False).ids, 1]
        for n, row in enumerate(sorted(rows, key=lambda x: x["piece"])):
            part = ids[64 * n : 64 * n + 64]
            assert (row["piece"], row["start"], row["length"]) == (n, 64 * n, len(part))
            assert row["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    bound = -(-sum(r["length"] for r in got) // 64)
    assert bound <= len(by_sequence) <= bound * 1.1 + 1
    assert packing.pack(spark, packing.token_pieces(nothing, PATH)).count() == 0


def test_configurations_serve_the_demand():
    r = random.Random(2)
    for _ in range(20):
        sizes = sorted(r.sample(range(13, 101), 5))
        demand = [r.randint(1, 300) for _ in sizes]
        plan = packing.configurations(sizes, demand, 100)
        assert all(sum(p * s for p, s in zip(pattern, sizes, strict=True)) <= 100 for pattern, _ in plan)
        assert (sum(pattern * times for pattern, times in plan) == np.array(demand)).all()


def test_substring_dedup(spark, docs, nothing):
    got = {r["doc_id"]: r for r in substring.digests(substring.remove_repeats(spark, docs)).collect()}
    first, split = {}, {i: words_of(t) for i, t in enumerate(TEXTS)}
    for i, w in split.items():
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    total = 0
    for i, w in split.items():
        gone = {s + k for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for k in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        total += len(gone)
        assert got[i]["n_words"] == len(w) and got[i]["n_removed"] == len(gone)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert total > 200
    assert substring.remove_repeats(spark, nothing).count() == 0


def brute_passages(rows, length=50):
    """n_words, n_removed, kept and longest repeat of every (id, text), ids null or not."""
    split = [(i, words_of(t)) for i, t in rows]
    first, classes = {}, {}
    for i, w in split:
        if i is not None:
            classes[tuple(w)] = min(i, classes.get(tuple(w), i))
            for s in range(len(w) - length + 1):
                run = tuple(w[s : s + length])
                first[run] = min(i, first.get(run, i))
    longest, size = dict.fromkeys(classes, 0), length
    while True:
        holders = collections.defaultdict(set)
        for w, i in classes.items():
            for s in range(len(w) - size + 1):
                holders[w[s : s + size]].add(i)
        found = {w for run, ids in holders.items() if len(ids) > 1 for w in classes if len(w) >= size
                 and any(w[s : s + size] == run for s in range(len(w) - size + 1))}
        if not found:
            break
        longest.update(dict.fromkeys(found, size))
        size *= 2
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - length + 1):
            if i is not None and first[tuple(w[s : s + length])] < i:
                gone.update(range(s, s + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        most = longest[tuple(w)] if i is not None else 0
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), most))
    return sorted(out, key=repr)


def test_substring_dedup_of_repeated_and_null_ids(spark):
    r = random.Random(8)
    passage, long = _sentence(r, 60), _sentence(r, 130)
    rows = [(1, "a " + long), (2, "x " + long + " y"), (3, long), (3, long), (3, _sentence(r, 500) + " " + passage)]
    rows += [(3, "short"), (None, long), (None, passage), (None, None), (4, passage + " q"), (4, passage + " q")]
    rows += [(4, passage + "  q"), (9, None), (0, "z " + passage), (7, ""), (5, "a " + long), (2, _sentence(r, 70))]
    table = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, high int, key string")
    found = substring.digests(substring.remove_repeats(spark, table.repartition(4)))
    got = sorted((tuple(x) for x in found.collect()), key=repr)
    want = brute_passages(rows)
    assert got == want and {x[4] for x in want} == {0, 50, 100} and sum(x[2] > 0 for x in want) >= 7


def brute_components(rows):
    """Size and component of (id, text) rows; rows without an id are linked with nothing."""

    def grams(text):
        w = words_of((text or "").encode().lower().decode())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if None not in (rows[i][0], rows[j][0]) and both:
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(j)] = root(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    out = [(d, len(sets[i]), least.get(root(i)) if d is not None else None) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=repr)


def test_jaccard(spark, docs, nothing):
    found = jaccard.similar_documents(spark, docs).drop("class", "text_key")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_components(list(enumerate(TEXTS)))
    assert jaccard.similar_documents(spark, nothing).count() == 0


def test_jaccard_of_families(spark):
    """Families whose members drift apart, repeated and null ids, sizes at the limit."""
    r, rows = random.Random(12), []
    for family in range(12):
        words = [f"w{r.randint(0, 300)}" for _ in range(r.choice([6, 12, 25, 60, 200]))]
        for _ in range(r.randint(1, 9)):
            rows.append((r.choice([None, len(rows), len(rows), family]), " ".join(words)))
            for _ in range(r.choice([0, 1, 1, 2])):
                words[r.randrange(len(words))] = f"x{r.randint(0, 300)}"
            words = words if r.random() < 0.6 else words[: max(1, int(len(words) * 0.9))]
    rows += [(500, rows[3][1]), (500, rows[3][1]), (None, ""), (501, " "), (502, None)]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, class long, value long")
    found = jaccard.similar_documents(spark, table.repartition(3)).drop("class", "text_key")
    got = sorted((tuple(x) for x in found.collect()), key=repr)
    want = brute_components(rows)
    assert got == want and any(d is not None and c != d for d, _, c in want)


def test_quality_measures():
    text = "A b A b A b c #x\nA b\n\nA b"
    words = text.split()
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    got = quality_rules.measure(text)
    assert got[:5] == (len(words), sum(map(len, words)), 1, 1, len(covered))
    assert quality_rules.measure(None) == quality_rules.measure("") == (0,) * 7


def test_binomial_tail_is_exact():
    for n, k, p in ((40, 0, 0.05), (40, 3, 0.05), (900, 12, 0.01)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.chance_of_so_few(k, n, p) == pytest.approx(want, rel=1e-9)
    assert quality_rules.chance_of_so_few(0, 0, 0.1) == 1


def _plain_cutoffs(rows, risk, level):
    """Cutoff index per rule from (exceeded cutoffs, bad, holdout) of each distinct text."""
    first, second = ([x for x in rows if x[2] == half] for half in (False, True))
    hits = lambda over, setting: any(c and o > 8 - c for o, c in zip(over, setting, strict=True))
    setting, last = (0,) * 6, (0,) * 6
    while True:
        steps = []
        for rule in range(6):
            for cut in range(setting[rule] + 1, 9):
                new = tuple(cut if r == rule else c for r, c in enumerate(setting))
                more = [bad for over, bad, _ in first if hits(over, new) and not hits(over, setting)]
                if sum(more):
                    steps.append((-sum(more) / (len(more) - sum(more) + 1), -sum(more), rule, cut, new))
        if not steps:
            return last
        setting = min(steps)[-1]
        good = [hits(over, setting) for over, bad, _ in second if not bad]
        k, n = sum(good), len(good)
        tail = sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        if tail > level:
            return last
        last = setting


def test_quality_rules_equal_the_plain_search(spark, docs, nothing):
    r, rows = random.Random(8), []
    for i in range(1500):
        bad = r.random() < 0.15
        lang = r.choice(["en", "en", "de", None, ""])
        words = _sentence(r, r.randint(60, 80)).split()
        if r.random() < (0.8 if bad else 0.01):
            words = [w + "#" * r.choice([1, 2]) if r.random() < 0.7 else w for w in words]
        if r.random() < (0.3 if bad else 0.01):
            words = [w.upper() for w in words]
        rows.append((i, "\n".join(" ".join(words[k : k + 20]) for k in range(0, 80, 20)), lang, int(not bad)))
    rows += [(2000 + i, t, lang, q) for i, (_, t, lang, q) in enumerate(rows[:400])]  # copies are no evidence
    table = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    measured = quality_rules.measures(table).where("not base_failed")
    over = [quality_rules.exceeded(rule) for rule in quality_rules.RULES]
    half = (F.pmod(F.xxhash64("text_key", F.lit("half")), F.lit(2)) == 0).alias("half")
    quality, strata = {x[0]: x[3] for x in rows}, collections.defaultdict(dict)
    for x in measured.select("doc_id", "stratum", "text_key", half, F.array(*over).alias("over")).collect():
        good = quality[x["doc_id"]] or not strata[x["stratum"]].get(x["text_key"], (0, True, 0))[1]
        strata[x["stratum"]][x["text_key"]] = (x["over"], not good, x["half"])
    used = {x["stratum_key"]: x for x in quality_rules.cutoffs(quality_rules.measures(table), labels, 0.05).collect()}
    on = 0
    for name, texts in strata.items():
        want = _plain_cutoffs(list(texts.values()), 0.05, 0.05 / len(strata))
        got = used["-" if name is None else "=" + name]
        for used_cut, (rule, (_, cuts)) in zip(want, quality_rules.RULES.items(), strict=True):
            assert got[f"cut_{rule}"] == (cuts[used_cut - 1] if used_cut else None)
        on += sum(want) > 0
    assert len(used) == 4 and on >= 2
    judged = quality_rules.judge(spark, table, labels, 0.05)
    lost = judged.where("not kept and not base_failed").join(labels, "doc_id").groupBy("quality").count()
    lost = {x["quality"]: x["count"] for x in lost.collect()}
    assert lost[0] > 100 and lost.get(1, 0) < 0.05 * 1600
    few = labels.where("doc_id < 40")
    assert quality_rules.judge(spark, table, few).where("not kept and not base_failed").count() == 0
    assert quality_rules.judge(spark, docs, labels.limit(0)).count() == len(TEXTS)
    assert quality_rules.judge(spark, nothing, labels).count() == 0


def _labelled(spark):
    r = random.Random(4)
    plain = [_sentence(r, r.randint(20, 60)) for _ in range(300)]
    odd = [t + " " + r.choice(["nasty", "vileous"]) + " " + r.choice(["nasty", "vileword"]) for t in plain[:60]]
    loud = [" ".join(w.upper() + "!!" for w in t.split()) for t in plain[60:120]]
    rows = [(t, 1, 0) for t in plain] + [(t, 1, 1) for t in odd] + [(t, 0, 0) for t in loud]
    r.shuffle(rows)
    table = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, (_, q, x) in enumerate(rows)], "doc_id long, quality int, toxic int")
    return table, labels


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, docs, nothing, label):
    table, labels = _labelled(spark)
    learn = F.col("doc_id") % 4 != 0

    def score(frame, own):
        if label == "toxic":
            return toxicity.score(spark, frame, own, learn)
        return nbsvm.score(spark, frame, own, "quality", learn)

    got = score(table, labels).join(labels, "doc_id").where(~learn)
    right, n = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.count("*")).first()
    assert n > 80 and right >= 0.95
    every = score(docs, labels).collect()
    assert len(every) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in every)
    assert score(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert score(nothing, labels).count() == 0


def test_label_model_beats_the_majority():
    """Voters of known accuracy, some of them copies of one another, and no labels."""
    r = np.random.default_rng(3)
    truth = r.random(4000) < 0.2
    accuracies = [0.9, 0.85, 0.8, 0.75, 0.7, 0.65]
    columns = []
    for accuracy in accuracies:
        right = r.random(4000) < accuracy
        vote = np.where(right == truth, 1, -1)
        columns.append(np.where(r.random(4000) < 0.8, vote, 0))
    for _ in range(5):  # copies of the worst voter
        columns.append(np.where(r.random(4000) < 0.95, columns[5], 0))
    votes = np.stack(columns, 1)
    posterior, shares, related = toxicity.label_model(votes, float(truth.mean()))
    own = ((posterior > 0.5) == truth).mean()
    plain = ((toxicity.majority(votes) > 0.5) == truth).mean()
    assert own > 0.9 and own > plain + 0.05
    # Shares of votes on toxic texts, and what copies have in common.
    for at, accuracy in enumerate(accuracies[:3]):
        assert shares[1, at, 2] / (shares[1, at, 2] + shares[1, at, 0]) == pytest.approx(accuracy, abs=0.1)
    assert related[5, 6:].min() > 0.6 and abs(related[0, 1]) < 0.2
    report = toxicity.voter_report(votes, truth)
    assert [x for _, x in report[:6]] == pytest.approx(accuracies, abs=0.03)
    assert [x for x, _ in report[:6]] == pytest.approx([0.8] * 6, abs=0.03)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_neighbours_recall_of_the_query(spark, folder):
    """The registered search against exact distances, on the tables' own vectors."""
    path = f"/root/testdata/{folder}"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    found = collections.defaultdict(set)
    for x in queries.op9_neighbours(spark, path).collect():
        found[x["query_id"]].add(x["vec_id"])
    table = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    table = [(r[0], r[1]) for r in table if r[1] and any(r[1]) and np.isfinite(r[1]).all()]
    ids, vectors = np.array([i for i, _ in table]), np.array([v for _, v in table], float)
    hits = total = 0
    for query in found:
        gap = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, gap))] if i != query][:10]
        hits, total = hits + len(found[query] & set(best)), total + len(best)
    assert set(found) == {i for i in ids if i % 100 == 0} and hits >= 0.9 * total


def test_neighbours(spark):
    r = np.random.default_rng(6)
    vectors = r.normal(size=(400, 8)).astype(np.float32)
    vectors[50:90] = vectors[3]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [None] * 8), (1010, [float("nan")] * 8)]
    odd += [(1011, [1.0, 2.0]), (None, [1.0] * 8), (1020, [float("inf")] * 8)]
    table = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<float>")
    query = F.col("vec_id") % 10 == 0
    got = collections.defaultdict(list)
    for x in neighbours.search_neighbours(spark, table, query, k=10, leaf=16, search_least=1).orderBy("rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    assert set(got) == set(range(0, 400, 10))
    hits = 0
    for q, found in got.items():
        exact = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(400), exact)) if i != q][:10]
        assert [s for _, s in found] == pytest.approx([exact[i] for i, _ in found], abs=1e-12)
        hits += len(set(best) & {i for i, _ in found})
    assert hits >= 0.9 * 400
    assert neighbours.search_neighbours(spark, table.limit(0), query).count() == 0
