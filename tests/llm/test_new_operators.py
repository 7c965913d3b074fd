"""Decontamination, resampling and conversation repair against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.llm import conversations, decontamination, resampling

ODD = "doc_id long, text string, row long, key long, words int, at int, form int, name string"


def small(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text))


def documents(r, passages):
    vocabulary = ["tree", "Öl", "stone", "river", "x1", "The", "of", "ÄB", "42", "été"]
    texts = [None, "", " \n ", "...", "one", "One two", "ünder_score a-b", "tree " * 3000]
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 60))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(words))
            words[at:at] = r.choice(passages).split()
        texts.append(r.choice([" ", ", ", "\n"]).join(words))
    return texts + texts[:12]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    passages = [" ".join(f"w{r.randint(0, 40)}" for _ in range(n)) for n in (1, 2, 4, 9, 10, 11, 30, 30)]
    passages.append(" ".join(passages[6].split()[5:25]))
    texts = documents(r, passages + ["a b c d e f g h i j k l"])
    # Repeated ids, null ids, and columns named like the operators' own.
    ids = [None if i % 17 == 3 else i % 45 for i in range(len(texts))]
    rows = [(i, t, 1, 2, 3, 4, 5, "x") for i, t in zip(ids, texts, strict=True)]
    items = [(i if i != 4 else None, p) for i, p in enumerate(passages)]
    items += [(50, passages[6]), (51, None), (52, "--"), (6, passages[7])]
    return (
        spark.createDataFrame(rows, ODD).repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        list(zip(ids, texts, strict=True)),
        items,
    )


def brute_contamination(texts, items, window=10):
    found = set()
    for item, text in items:
        words = plain_words(text)
        n = min(window, len(words))
        for s in range(len(words) - n + 1 if n else 0):
            found.add((item, tuple(words[s : s + n])))
    out = []
    for doc_id, text in texts:
        words, hit, held = plain_words(text), set(), set()
        for item, run in found:
            for s in range(len(words) - len(run) + 1):
                if tuple(words[s : s + len(run)]) == run:
                    hit.update(range(s, s + len(run)))
                    held |= {str(item)} if item is not None else set()
        out.append((doc_id, len(words), len(hit), len(held), sorted(held)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_contamination(spark, corpus, limit):
    docs, items, texts, rows = corpus
    found = decontamination.find_contamination(spark, docs, items, broadcast_bytes=limit)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = brute_contamination(texts, rows)
    assert got == want and sum(r[2] > 0 for r in want) > 10


def test_contamination_by_other_windows(spark, corpus):
    docs, items, texts, rows = corpus
    for window in (1,):
        found = decontamination.find_contamination(spark, docs, items, window=window)
        got = sorted((tuple(r) for r in found.collect()), key=repr)
        assert got == brute_contamination(texts, rows, window)


def test_contamination_of_nothing(spark, corpus):
    docs, items, texts, _ = corpus
    none = decontamination.find_contamination(spark, docs, items.limit(0))
    assert none.count() == len(texts) and none.where("n_hit > 0 or n_items > 0").count() == 0
    empty = decontamination.find_contamination(spark, docs.limit(0), items)
    assert empty.count() == 0 and empty.columns == none.columns


def test_contamination_runs_no_python(spark, corpus):
    docs, items, _, _ = corpus
    plan = decontamination.find_contamination(spark, docs, items)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


# --- resampling ----------------------------------------------------------------


def test_joined_crc():
    r = random.Random(2)
    pairs = [(r.randbytes(r.randint(0, 40)), r.randbytes(r.choice([0, 1, 7, 300]))) for _ in range(300)]
    left = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    right = np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    sizes = np.array([len(b) for _, b in pairs], np.uint32)
    assert resampling.joined_crc(left, right, sizes).tolist() == [zlib.crc32(a + b) for a, b in pairs]


def brute_resampling(texts, items, percent, min_words, buckets, max_words, seed):
    def features(text):
        words = plain_words(text)
        runs = [
            " ".join(words[s : s + n])
            for n in range(1, max_words + 1)
            for s in range(len(words) - n + 1)
        ]
        return len(words), [zlib.crc32(x.encode()) % buckets for x in runs]

    mine = [features(t) for _, t in texts]
    s, t = [0] * buckets, [0] * buckets
    for _, found in mine:
        for b in found:
            s[b] += 1
    for _, text in items:
        for b in features(text)[1]:
            t[b] += 1
    gain = [
        math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets))))
        for x, y in zip(s, t, strict=True)
    ]
    out = []
    for (doc_id, _), (n_words, found) in zip(texts, mine, strict=True):
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, n_words, len(found), weight, score, None])
    able = [r for r in out if r[1] >= min_words]
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("max_words,buckets,percent", [(1, 10_000, 10), (3, 70_000, 50)])
def test_resampling(spark, corpus, max_words, buckets, percent):
    docs, items, texts, rows = corpus
    options = {"percent": percent, "min_words": 20, "buckets": buckets, "max_words": max_words, "seed": 7}
    drawn = resampling.resample(spark, docs, items, **options).drop("row")
    got = sorted((tuple(r) for r in drawn.collect()), key=repr)
    assert got == brute_resampling(texts, rows, **options)
    assert any(r[5] for r in got)


def test_resampling_of_nothing(spark, corpus):
    docs, items, texts, _ = corpus
    assert resampling.resample(spark, docs.limit(0), items).count() == 0
    drawn = resampling.resample(spark, docs, items.limit(0), percent=0)
    assert drawn.count() == len(texts) and drawn.where("rank is not null").count() == 0


def test_dictionary_starts_anew_and_scans_in_parts(monkeypatch):
    monkeypatch.setattr(resampling, "SCAN_BYTES", 10)
    dictionary, r = resampling.Dictionary(limit=20), random.Random(4)
    for _ in range(30):
        words = [r.choice("abcdefgäß") * r.randint(1, 15) for _ in range(r.randint(0, 25))]
        text = resampling.plain("  ".join(words))
        dictionary.learn([text])
        payloads = dictionary.payloads(text).tolist()
        assert payloads == [zlib.crc32(w.encode()) | len(w.encode()) << 32 for w in words]
        assert len(dictionary.words) <= 20 + 25


# --- conversations ---------------------------------------------------------------


def audits(rows):
    """Every edit sequence without needless insertions: cost, letters, repaired lines."""
    def walk(at, state, cost, letters, lines, inserted):
        if cost > 2 * len(rows):  # all can be deleted for that
            return
        if at == len(rows):
            if state in (0, 3):
                yield cost, letters, lines
        else:
            role, text, forced, cut = rows[at]
            yield from walk(at + 1, state, cost + 2, letters + "D", lines, 0)
            if not forced:
                extra = 5 * cut
                to = {"s": 1 if state == 0 else None, "u": None if state == 2 else 2,
                      "a": 3 if state == 2 else None}.get(role[:1])
                if to is not None:
                    yield from walk(at + 1, to, cost + extra, letters + "K", [*lines, f"{role}:{text}"], 0)
                for name, to, ok in (("user", 2, state != 2), ("assistant", 3, state == 2)):
                    if ok:
                        yield from walk(at + 1, to, cost + 1 + extra, letters + "R", [*lines, f"{name}:{text}"], 0)
        if inserted < 2:
            name, to = ("assistant", 3) if state == 2 else ("user", 2)
            yield from walk(at, to, cost + 5, letters + "I", [*lines, f"{name}:"], inserted + 1)

    return min(walk(0, 0, 0, "", [], 0))


BLANKS = " \t\n\v\f\r"


def brute_repair(rows):
    """From rows ``conv_id, turn, role, text`` after damage, copies and all."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [(t, " " if role is None else role, " " if x is None else x) for c, t, role, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults, offers = set(), [], []
        for _, role, text in own:
            bare = text.strip(BLANKS)
            fault = None
            if not bare:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif bare[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            faults.append(fault)
            offers.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, letters, lines = audits(offers)
        body = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, letters, body))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, n long, range int"


def some_conversations(r, n, longest):
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "u", ""]
    texts = ["Yes.", "No!", "Why?  ", "cut off", None, "", " \n", "Yes. and", "été.", "Go on?"]
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            name = None if conv == 0 else conv
            turn = r.choice([turn, turn, turn * 2, None])
            for _ in range(r.choice([1, 1, 1, 2])):
                rows.append((name, turn, r.choice(roles), r.choice(texts)))
    return rows


@pytest.mark.parametrize("partitions", [1, 40])
def test_repair(spark, partitions):
    rows = some_conversations(random.Random(partitions), 30, 4)
    table = spark.createDataFrame([(*x, 9, 9) for x in rows], TURNS).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = conversations.repair(spark, conversations.undamaged(table))
        got = sorted((tuple(x) for x in found.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_repair(rows)


def brute_damage(rows):
    out, left = [], set()
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, text = zlib.crc32(name.encode()) % 20, " " if text is None else text
        if kind == 0:
            left.add(conv)
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out, left


def test_damage_and_repair(spark):
    rows = some_conversations(random.Random(1), 40, 4) + [(c, 0, "user", "Hm.") for c in range(100, 160)]
    table = spark.createDataFrame([(*x, 9, 9) for x in rows], TURNS).repartition(3)
    damaged, left = brute_damage(rows)
    empty = hashlib.sha256(b"").hexdigest()
    gone = left - {r[0] for r in damaged}
    want = brute_repair(damaged) + [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in gone]
    found = conversations.repair(spark, conversations.damage(table))
    assert gone and sorted((tuple(x) for x in found.collect()), key=repr) == sorted(want, key=repr)
    assert conversations.repair(spark, conversations.damage(table.limit(0))).count() == 0


def slow_repair(offers):
    """Cheapest and ASCII-least by one row at a time, from the end."""
    best = {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}
    for initial, forced, cut in reversed(offers):
        bare = {}
        for state in range(4):
            ways = [(best[state][0] + 2, "D" + best[state][1])]
            if not forced:
                to = conversations.moved_state(state)
                ways.append((best[to][0] + 1 + 5 * cut, "R" + best[to][1]))
                kept = conversations.kept_state(state, initial)
                if kept is not None:
                    ways.append((best[kept][0] + 5 * cut, "K" + best[kept][1]))
            bare[state] = min(ways)
        best = {}
        for state in range(4):
            one = conversations.moved_state(state)
            two = conversations.moved_state(one)
            best[state] = min(
                bare[state],
                (bare[one][0] + 5, "I" + bare[one][1]),
                (bare[two][0] + 10, "II" + bare[two][1]),
            )
    return best[0]


def test_long_runs(monkeypatch):
    monkeypatch.setattr(conversations, "UNROLL", 16)
    r = random.Random(9)
    for _ in range(60):
        offers = []
        for _ in range(r.randint(1, 6)):
            offers += [(r.randint(0, 3), r.random() < 0.3, r.random() < 0.3)] * r.choice([1, 2, 3, 50])
        runs = []
        for initial, forced, cut in offers:
            symbol = conversations.FORCED if forced else conversations.symbol_of(initial, cut)
            conversations.add_run(runs, symbol, 1)
        after = conversations.end_costs()
        letters = "".join(x[0] for x in conversations.unroll(runs, 0, after, True))
        cost = conversations.apply(conversations.piece_transition(runs), after)[0]
        assert (cost, letters) == slow_repair(offers)


def test_one_conversation_over_all_ranges(spark):
    """A conversation that holds nearly all rows is repaired in pieces, its copies counted."""
    texts = ["Yes.", "No.", "cut", ""]
    rows = [(1, i, ["user", "assistant", "tool"][i * i % 3], f"{texts[i % 4]}") for i in range(300)]
    rows = [(c, t, role, f"{t} {x}" if i % 5 else x) for i, (c, t, role, x) in enumerate(rows)]
    rows += [(1, 7, "user", "again.")] * 500 + [(2, 0, "user", "Hm.")]
    table = spark.createDataFrame([(*x, 1, 1) for x in rows], TURNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sorted_once = conversations.sorted_rows(conversations.undamaged(table))
        ranges = sorted_once.where("conv_id = 1").select(F.spark_partition_id()).distinct().count()
        found = conversations.repair(spark, conversations.undamaged(table)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges >= 3
    own = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1], r[2], hashlib.md5(r[3].encode()).hexdigest()))
    offers, seen = [], set()
    for _, _, role, text in own:
        bare = text.strip(BLANKS)
        forced = not bare or (role, text) in seen
        seen.add((role, text))
        offers.append(({"s": 0, "u": 1, "a": 2}.get(role[0], 3), forced, bool(bare) and bare[-1] not in ".!?"))
    got = next(r for r in found if r["conv_id"] == 1)
    assert (got["cost"], got["audit"]) == slow_repair(offers)
    # Every plain text that comes back, and 499 of the 500 copies.
    assert got["duplicate"] == sum(f and bool(r[3].strip(BLANKS)) for (_, f, _), r in zip(offers, own, strict=True))
