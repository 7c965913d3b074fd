"""Repair of conversations whose turns were lost, blanked, repeated or mislabelled.

A repaired conversation's role initials read ``(s?(ua)+)?``: nothing, or an optional system
turn and pairs of user and assistant. Every row is kept (0), given another of the two roles
(1) or deleted (2; blank rows and duplicates must be); rows may be inserted (5); a row cut
off in mid-sentence costs 5 unless it is deleted. The cheapest edits are found by dynamic
programming over the four states of that pattern. Rows that offer the same choices carry the
same symbol, equal symbols in a row are one run, and a run of n rows moves the costs by the
n-th min-plus power of its symbol's transition, put together from cached binary powers. The
edits themselves are then unrolled from the start; of equally cheap edits those with the
ASCII-least letters (D, I, K, R) win.

Rows are sorted by conversation over all tasks, so a conversation of any size is spread over
as many tasks as it has ranges. Only a range's first and last conversation can go on in
another range: those two are summed up as one transition each, stitched on the driver (two
small rows for each range, whatever the number of rows) and unrolled by each range on its
own. One task at last hashes a conversation's repaired text in order, piece by piece: a
SHA-256 can't be divided, but holds no text.

Defined cases: null ids, roles and texts count as one space (the id is returned as it is,
all null ids being one conversation), null turns come first and are left out of ``gaps``.
Rows of one turn are ordered by role, then by the text's MD5; equal rows (of equal digests)
are counted together before anything is sorted, so many copies of one row are one row with
a count. Conversations of which no row is left are returned with zeros. Other columns are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.session import ensure_checkpoint_dir

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = 4
NEVER = 1 << 40
FORCED = 0  # the symbol of rows that must be deleted
INITIALS = "sua"
OTHER = 3  # any other initial, or none
LEGAL = {(0, 1), (1, 2), (2, 1)}

# Rows unrolled at once, and characters of a repaired piece handed on at once.
UNROLL = 4096
PIECE_CHARS = 1 << 20


# --- the transitions ---------------------------------------------------------


def symbol_of(initial: int, truncated: bool) -> int:
    return 1 + initial + (OTHER + 1) * truncated


def kept_state(state: int, initial: int) -> int | None:
    """Where a kept row of that initial leads, if it may stand there."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return None if state == 2 else 2
    return 3 if initial == 2 and state == 2 else None


def moved_state(state: int) -> int:
    """Where a rerole or an insertion leads: the only role that may stand there."""
    return 3 if state == 2 else 2


def times(left: list[list[int]], right: list[list[int]]) -> list[list[int]]:
    columns = list(zip(*right, strict=True))
    return [[min(NEVER, *map(int.__add__, row, column)) for column in columns] for row in left]


def _unit() -> list[list[int]]:
    return [[0 if i == j else NEVER for j in range(STATES)] for i in range(STATES)]


@lru_cache(maxsize=1)
def insertions() -> list[list[int]]:
    """No insertion, one, or two; a third never helps."""
    one = _unit()
    for state in range(STATES):
        one[state][moved_state(state)] = INSERT
    return times(one, one)


def row_step(symbol: int) -> list[list[int]]:
    """Costs of one row without insertions."""
    step = [[NEVER] * STATES for _ in range(STATES)]
    initial, truncated = (symbol - 1) % (OTHER + 1), symbol > OTHER + 1
    for state in range(STATES):
        step[state][state] = DELETE
        if symbol == FORCED:
            continue
        extra = TRUNCATED if truncated else 0
        to = moved_state(state)
        step[state][to] = min(step[state][to], REROLE + extra)
        to = kept_state(state, initial)
        if to is not None:
            step[state][to] = min(step[state][to], KEEP + extra)
    return step


@lru_cache(maxsize=None)
def power(symbol: int, exponent: int) -> list[list[int]]:
    """The transition of 2 ** exponent rows of a symbol, insertions before each allowed."""
    if exponent == 0:
        return times(insertions(), row_step(symbol))
    half = power(symbol, exponent - 1)
    return times(half, half)


def run_transition(symbol: int, n: int) -> list[list[int]]:
    out = _unit()
    for exponent in range(n.bit_length()):
        if n >> exponent & 1:
            out = times(out, power(symbol, exponent))
    return out


def apply(transition: list[list[int]], costs: list[int]) -> list[int]:
    return [min(NEVER, *map(int.__add__, row, costs)) for row in transition]


def advance(symbol: int, n: int, costs: list[int]) -> list[int]:
    """Costs to go before a run of n rows, from those after it."""
    for exponent in range(n.bit_length()):
        if n >> exponent & 1:
            costs = apply(power(symbol, exponent), costs)
    return costs


def end_costs() -> list[int]:
    """Costs to go when no row is left: nothing, or what must be inserted."""
    return apply(insertions(), [0, NEVER, NEVER, 0])


# --- one piece of a conversation ---------------------------------------------


def add_run(runs: list[list[int]], symbol: int, n: int) -> None:
    if n and runs and runs[-1][0] == symbol:
        runs[-1][1] += n
    elif n:
        runs.append([symbol, n])


def piece_transition(runs: list[list[int]]) -> list[list[int]]:
    out = _unit()
    for symbol, n in runs:
        out = times(out, run_transition(symbol, n))
    return out


def unroll(runs: list[list[int]], state: int, after: list[int], last: bool) -> Iterator[tuple]:
    """``letter, state before, state after`` of the ASCII-least cheapest edits, in order.

    ``after`` are the costs to go after the piece. Costs inside a run are worked out a
    block at a time, so a long run takes no more memory than a block.
    """
    ends = [after]
    for symbol, n in reversed(runs):
        ends.append(advance(symbol, n, ends[-1]))
    ends.pop()
    for symbol, n in runs:
        end = ends.pop()
        initial, truncated = (symbol - 1) % (OTHER + 1), symbol > OTHER + 1
        extra = TRUNCATED if truncated else 0
        for start in range(0, n, UNROLL):
            size = min(UNROLL, n - start)
            costs = [advance(symbol, n - start - size, end)]
            one = power(symbol, 0)
            for _ in range(size):
                costs.append(apply(one, costs[-1]))
            for at in range(size, 0, -1):
                before, then = costs[at], costs[at - 1]
                while True:
                    best, to = before[state], moved_state(state)
                    if DELETE + then[state] == best:
                        yield "D", state, state
                        break
                    if INSERT + before[to] == best:
                        yield "I", state, to
                        state = to
                        continue
                    kept = kept_state(state, initial) if symbol != FORCED else None
                    if kept is not None and KEEP + extra + then[kept] == best:
                        yield "K", state, kept
                        state = kept
                    else:
                        yield "R", state, to
                        state = to
                    break
    while last and after[state]:
        to = moved_state(state)
        yield "I", state, to
        state = to


def final_state(runs: list[list[int]], state: int, after: list[int], last: bool) -> int:
    for _, _, state in unroll(runs, state, after, last):
        pass
    return state


# --- rows --------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: rows after damage, n times each (0: dropped).

    What happens to a row depends on the CRC-32 of its id and turn alone.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(parts[0], F.lit(":"), parts[1])) % 20
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """Rows as they are, for callers whose conversations are damaged already."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    one = F.lit(1).cast("long").alias("n")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, one)


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    code = F.lit(OTHER)
    for at, letter in enumerate(INITIALS):
        code = F.when(first == letter, at).otherwise(code)
    return code


def _marked(rows: DataFrame) -> DataFrame:
    """Each distinct row once, with its count, initial and faults."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    same = same.select(
        "*", F.md5("text").alias("digest"), blank.alias("blank"), (~blank & ~ends).alias("cut")
    )
    # The first turn of equal role and text; a null turn is before all others.
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = same.where("n > 0").groupBy(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")
    ).agg(F.min(place).alias("_first"))
    on = (
        F.col("conv_id").eqNullSafe(F.col("_conv"))
        & (F.col("role") == F.col("_role"))
        & (F.col("digest") == F.col("_digest"))
    )
    joined = same.join(first, on, "left")
    original = (F.col("n") > 0) & ~F.col("blank") & place.eqNullSafe(F.col("_first"))
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "digest",
        "n",
        "blank",
        original.alias("original"),
        "cut",
        _initial(F.col("role")).alias("initial"),
        F.when(original, F.col("text")).alias("text"),
    )


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Marked rows in order of conversation and place, checkpointed range by range."""
    ensure_checkpoint_dir(rows.sparkSession)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest"]
    return _marked(rows).repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()


class Piece:
    """The rows of one conversation that one range holds."""

    def __init__(self, conv_id):
        self.conv_id, self.runs, self.texts = conv_id, [], []
        self.blank = self.duplicate = self.cut = self.illegal = self.distinct = 0
        self.low = self.high = self.first = self.previous = None

    def add(self, turn, n, blank, original, cut, initial, role, text) -> None:
        if not n:
            return
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.first = initial if self.first is None else self.first
        self.illegal += n - 1  # a role never may follow itself
        if self.previous is not None:
            self.illegal += (self.previous, initial) not in LEGAL
        self.previous = initial
        if original:
            self.texts.append((role, text))
            add_run(self.runs, symbol_of(initial, cut), 1)
            self.cut += cut
        add_run(self.runs, FORCED, n - original)
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n - original

    def repaired(self, state: int, after: list[int], last: bool) -> Iterator[tuple]:
        """``letters, lines, cost`` in pieces of bounded length."""
        rows, letters, lines, size, cost = self._offers(), [], [], 0, 0
        for letter, _, to in unroll(self.runs, state, after, last):
            letters.append(letter)
            role, text, truncated = ("", "", False) if letter == "I" else next(rows)
            if letter == "D":
                cost += DELETE
            else:
                role = role if letter == "K" else ("assistant" if to == 3 else "user")
                lines.append(f"{role}:{text}")
                size += len(lines[-1])
                cost += INSERT if letter == "I" else TRUNCATED * truncated + (letter == "R") * REROLE
            if size > PIECE_CHARS or len(letters) > PIECE_CHARS:
                yield "".join(letters), "\n".join(lines), cost
                letters, lines, size, cost = [], [], 0, 0
        yield "".join(letters), "\n".join(lines), cost

    def _offers(self) -> Iterator[tuple]:
        """Role, text and whether cut off, of each row of the runs in turn."""
        texts = iter(self.texts)
        for symbol, n in self.runs:
            for _ in range(n):
                if symbol == FORCED:
                    yield "", "", False
                else:
                    yield (*next(texts), symbol > OTHER + 1)


ROW = ["turn", "n", "blank", "original", "cut", "initial", "role", "text"]


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[Piece]:
    piece = None
    for batch in batches:
        values = [
            batch.column(c).to_pylist() if c in columns else [None] * batch.num_rows for c in ROW
        ]
        for conv_id, *row in zip(batch.column("conv_id").to_pylist(), *values, strict=True):
            if piece is None or piece.conv_id != conv_id:
                if piece is not None:
                    yield piece
                piece = Piece(conv_id)
            piece.add(*row)
    if piece is not None:
        yield piece


def _edges(pieces: Iterator[Piece]) -> Iterator[tuple[int, Piece]]:
    """The first and, if it is another, the last piece."""
    first = last = None
    for piece in pieces:
        if first is None:
            first = piece
            yield 0, piece
        last = piece
    if last is not first:
        yield 1, last


def _opened(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator]:
    """The first batch that has rows, and all of those."""
    batches = filter(lambda b: b.num_rows, batches)
    first = next(batches, None)
    return first, chain([first], batches)


NARROW = ["turn", "n", "blank", "original", "cut", "initial"]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch, batches = _opened(batches)
    if batch is None:
        return
    conv, number = batch.schema.field("conv_id").type, batch.column("range")[0].as_py()
    edges = list(_edges(_pieces(batches, NARROW)))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([number] * len(edges), pa.int32()),
            pa.array([which for which, _ in edges], pa.int32()),
            pa.array([p.conv_id for _, p in edges], conv),
            pa.array([sum(piece_transition(p.runs), []) for _, p in edges], pa.list_(pa.int64())),
        ],
        names=["range", "which", "conv_id", "transition"],
    )


def _final_states(wanted):
    """State after an edge piece for every state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, batches = _opened(batches)
        if batch is None:
            return
        number, found = batch.column("range")[0].as_py(), []
        for which, piece in _edges(_pieces(batches, NARROW)):
            if (number, which) in wanted.value:
                after, last = wanted.value[number, which]
                ends = [final_state(piece.runs, s, after, last) for s in range(STATES)]
                found.append((number, which, ends))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in found], pa.int32()),
                pa.array([f[1] for f in found], pa.int32()),
                pa.array([f[2] for f in found], pa.list_(pa.int32())),
            ],
            names=["range", "which", "ends"],
        )

    return run


def _stitched(spark: SparkSession, narrow: DataFrame, conv_type: str) -> dict[tuple, tuple]:
    """``state before, costs after, whether last`` of pieces of divided conversations.

    The driver gets two rows at most for each range: their number grows with the ranges,
    not with what is in them.
    """
    found = narrow.mapInArrow(
        _summed, f"range int, which int, conv_id {conv_type}, transition array<bigint>"
    ).collect()
    found.sort(key=lambda r: (r["range"], r["which"]))
    groups: list[list] = []
    for row in found:
        if groups and row["range"] != groups[-1][-1]["range"] and (
            row["conv_id"] == groups[-1][-1]["conv_id"]
        ):
            groups[-1].append(row)
        else:
            groups.append([row])
    groups = [g for g in groups if len(g) > 1]
    ends = {}
    for group in groups:
        after, last = end_costs(), True
        for row in reversed(group):
            ends[row["range"], row["which"]] = (after, last)
            flat = row["transition"]
            rows = [list(flat[i : i + STATES]) for i in range(0, len(flat), STATES)]
            after, last = apply(rows, after), False
    if not ends:
        return {}
    states = narrow.mapInArrow(
        _final_states(spark.sparkContext.broadcast(ends)), "range int, which int, ends array<int>"
    ).collect()
    states = {(r["range"], r["which"]): r["ends"] for r in states}
    known = {}
    for group in groups:
        state = 0
        for row in group:
            key = (row["range"], row["which"])
            known[key] = (state, *ends[key])
            state = states[key][state]
    return known


REPAIRED = (
    "range int, piece int, audit string, lines string, cost long, blank long, duplicate long, "
    "truncated long, illegal long, low long, high long, distinct long, first int, last int"
)


def _repairer(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, batches = _opened(batches)
        if batch is None:
            return
        number, conv = batch.column("range")[0].as_py(), batch.schema.field("conv_id").type

        def rows():
            pieces = _pieces(batches, ROW)
            piece, which = next(pieces, None), 0
            while piece is not None:
                following = next(pieces, None)
                which = 0 if which == 0 else (1 if following is None else 2)
                state, after, last = known.value.get((number, which), (0, end_costs(), True))
                stats = (
                    piece.blank, piece.duplicate, piece.cut, piece.illegal, piece.low,
                    piece.high, piece.distinct, piece.first, piece.previous,
                )
                for at, part in enumerate(piece.repaired(state, after, last)):
                    yield (piece.conv_id, number, at, *part, *stats)
                    stats = (0, 0, 0, 0, None, None, 0, None, None)
                piece, which = following, 2

        yield from batched(rows(), conv)

    def batched(rows, conv):
        names = ["conv_id", *[c.split()[0] for c in REPAIRED.split(", ")]]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        types = [conv, *[kinds[c.split()[1]] for c in REPAIRED.split(", ")]]
        held, size = [], 0

        def out():
            columns = zip(*held, strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for row in rows:
            held.append(row)
            size += len(row[4]) + 100
            if size > 4 * PIECE_CHARS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces, which come in order."""
    names = ["conv_id", *[c.split()[0] for c in RESULT.split(", ")]]
    kinds = {"long": pa.int64(), "string": pa.string()}
    current, done = None, []

    def closed(c):
        gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["distinct"]
        counts = [c[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")]
        return (c["conv_id"], gaps, *counts, "".join(c["audit"]), c["sha"].hexdigest())

    def out(conv):
        columns = zip(*done, strict=True)
        types = [conv, *[kinds[c.split()[1]] for c in RESULT.split(", ")]]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    conv = None
    for batch in batches:
        conv = batch.schema.field("conv_id").type
        for start in range(0, batch.num_rows, 64):
            for row in batch.slice(start, 64).to_pylist():
                if current is None or current["conv_id"] != row["conv_id"]:
                    if current is not None:
                        done.append(closed(current))
                    current = {
                        "conv_id": row["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0,
                        "illegal": 0, "cost": 0, "distinct": 0, "low": None, "high": None,
                        "last": None, "audit": [], "sha": hashlib.sha256(), "any": False,
                    }
                c = current
                for key in ("blank", "duplicate", "truncated", "illegal", "cost", "distinct"):
                    c[key] += row[key]
                if row["low"] is not None:
                    c["distinct"] -= row["low"] == c["high"]
                    c["low"] = row["low"] if c["low"] is None else c["low"]
                    c["high"] = row["high"]
                if row["first"] is not None:
                    if c["last"] is not None:
                        c["illegal"] += (c["last"], row["first"]) not in LEGAL
                    c["last"] = row["last"]
                c["audit"].append(row["audit"])
                if row["lines"]:
                    c["sha"].update(b"\n" if c["any"] else b"")
                    c["sha"].update(row["lines"].encode())
                    c["any"] = True
        if len(done) > 10_000:
            yield out(conv)
            done = []
    if current is not None:
        done.append(closed(current))
    if done:
        yield out(conv)


def repaired_pieces(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Audit letters and repaired lines of each conversation, piece by piece.

    ``rows`` are those of ``damage`` or ``undamaged``. ``range, piece`` give the order of
    a conversation's pieces; counts stand on a range's first piece.
    """
    placed = sorted_rows(rows).withColumn("range", F.spark_partition_id())
    conv = placed.schema["conv_id"].dataType.simpleString()
    known = _stitched(spark, placed.select("conv_id", "range", *NARROW), conv)
    shared = spark.sparkContext.broadcast(known)
    return placed.mapInArrow(_repairer(shared), f"conv_id {conv}, {REPAIRED}")


def repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    pieces = repaired_pieces(spark, rows)
    conv = pieces.schema["conv_id"].dataType.simpleString()
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "range", "piece")
    return dealt.mapInArrow(_assemble, f"conv_id {conv}, {RESULT}")
