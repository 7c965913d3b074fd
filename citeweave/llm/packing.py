"""Packing token pieces into sequences: linear grouping, few-size configurations, best fit.

Large lengths are put into groups of equal cardinality and rounded up to their group's
largest. Over these few sizes the number of times each way of filling a sequence is
used is optimised by column generation. Actual pieces take the places planned for
their group, and small pieces go by best fit, largest first, into the room that is
truly left. Everything is planned on counts per length (at most ``capacity`` of them,
however many pieces there are) and per room left; pieces find their places through
their rank among pieces of the same length, which is counted by task-sized chunks.

Defined cases: a null or empty text has the end token alone. Equal pieces are ranked by
(document, piece). An empty table packs into nothing. Other columns are not looked at.
A document id that occurs twice or is null is packed once per row.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import find_words, slices, stored

# Distinct chunks whose ids one Python worker remembers, and as many older ones, of which
# those that come again are remembered on.
REMEMBERED = 500_000
# Chunks encoded in one call.
JOINED = 150
# Rows per chunk in which ranks are counted.
CHUNK_ROWS = 500_000

_MEMORIES: dict[str, list[dict[str, bytes]]] = {}
_TOKENIZERS: dict = {}


def _encode_apart(tokenizer, chunks: list[str]) -> list[bytes]:
    encoded = tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
    return [np.array(e.ids, np.uint32).tobytes() for e in encoded]


def chunk_ids(tokenizer, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
    """Each chunk's ids as bytes.

    Chunks hold no ASCII blank and no token spans one, so chunks are encoded some hundred
    at a time, joined by blanks, and told apart by where their tokens start; a call for
    each would take most of the time. Chunks that may hold an added token go alone.
    """
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    alone = [c for c in chunks if any(token in c for token in added)]
    yield from zip(alone, _encode_apart(tokenizer, alone), strict=True)
    special = set(alone)
    plain = [c for c in chunks if c not in special]
    groups = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
    encoded = tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
    for group, one in zip(groups, encoded, strict=True):
        ids = np.array(one.ids, np.uint32)
        starts = np.fromiter((span[0] for span in one.offsets), np.int64, len(ids))
        sizes = np.fromiter(map(len, group), np.int64, len(group))
        ends = np.searchsorted(starts, np.cumsum(sizes + 1), "left") * 4
        raw, at = ids.tobytes(), 0
        for chunk, end in zip(group, ends.tolist(), strict=True):
            yield chunk, raw[at:end]
            at = end


def _piece_maker(path: str, capacity: int, end_id: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = Tokenizer.from_file(path)
            _TOKENIZERS[path].no_truncation()
            _TOKENIZERS[path].no_padding()
        tokenizer, both = _TOKENIZERS[path], _MEMORIES.setdefault(path, [{}, {}])
        end = np.uint32(end_id).tobytes()
        for batch in slices(batches, 512):
            # No token spans an ASCII blank, so a chunk's ids don't depend on its text.
            split = [find_words(t) if t else [] for t in batch.column(text_col).to_pylist()]
            if len(both[0]) > REMEMBERED:
                both[:] = {}, both[0]
            memory, older = both
            new = set().union(*split).difference(memory)
            again = new.intersection(older)
            memory.update((chunk, older[chunk]) for chunk in again)
            memory.update(chunk_ids(tokenizer, list(new - again)))
            rows, starts, sizes, sums, numbers = [], [], [], [], []
            for row, chunks in enumerate(split):
                ids = b"".join([*map(memory.__getitem__, chunks), end])
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(at // 4)
                    sizes.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(
    docs: DataFrame,
    path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of at most ``capacity``."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(
        _piece_maker(path, capacity, end_id, id_col, text_col),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long",
    )


# --- ranks -------------------------------------------------------------------


def ranked(frame: DataFrame, chunks: int, key: str, order: list[str], name: str) -> DataFrame:
    """Add a number from 0 within equal ``key``, without bringing a key's rows together.

    Rows are hashed into ``chunks``; the counts per (chunk, key) give each chunk's first
    number, and rows are numbered within the chunk.
    """
    chunked = frame.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = chunked.groupBy("_chunk", key).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        "_chunk", key, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first")
    )
    inside = Window.partitionBy("_chunk", key).orderBy(*order)
    numbered = chunked.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        numbered.join(firsts, ["_chunk", key])
        .withColumn(name, (F.col("_first") + F.col("_inside")).cast("long"))
        .drop("_chunk", "_first", "_inside")
    )


# --- planning on counts ------------------------------------------------------


def linear_groups(counts: np.ndarray, smallest: int, groups: int) -> list[tuple[int, int]]:
    """Cut lengths >= ``smallest`` into runs (low, high) of about equally many pieces.

    One length stays in one group, so a very frequent length is a group of its own.
    """
    lengths = [n for n in range(smallest, len(counts)) if counts[n]]
    share = max(1, -(-int(sum(counts[n] for n in lengths)) // groups))
    out, low, held = [], None, 0
    for at, n in enumerate(lengths):
        low = n if low is None else low
        held += int(counts[n])
        if held >= share or at == len(lengths) - 1:
            out.append((low, n))
            low, held = None, 0
    return out


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    layers = capacity // int(sizes.min())
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(layers):
        options = np.stack([np.r_[np.full(s, -1.0), best[:-s] + w] for s, w in zip(sizes, worth)])
        pick = options.argmax(axis=0)
        new = options[pick, np.arange(capacity + 1)]
        better = new > best + 1e-12
        picks.append(np.where(better, pick, -1))
        best = np.where(better, new, best)
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            pattern[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), pattern


def configurations(
    sizes: list[int], demand: list[int], capacity: int, rounds: int = 600
) -> list[tuple[np.ndarray, int]]:
    """Ways of filling a sequence from few sizes, and how often each is used.

    Column generation for the fewest sequences; fractions are rounded down and what is
    then left of the demand goes by first fit, largest first.
    """
    size, need = np.array(sizes), np.array(demand, np.int64)
    if not len(size):
        return []
    columns = np.diag(capacity // size).astype(float)
    for _ in range(rounds):
        amount = np.linalg.solve(columns, need)
        worth = np.linalg.solve(columns.T, np.ones(len(size)))
        value, pattern = _best_pattern(size, worth, capacity)
        if value <= 1 + 1e-7:
            break
        move = np.linalg.solve(columns, pattern.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, np.maximum(amount, 0) / move, np.inf)
        columns[:, int(ratio.argmin())] = pattern
    amount = np.linalg.solve(columns, need)
    plan, left = [], need.copy()
    for column, times in zip(columns.T.astype(np.int64), np.floor(amount + 1e-9), strict=True):
        held = column > 0
        times = min(int(times), int((left[held] // column[held]).min())) if held.any() else 0
        if times > 0:
            plan.append((column, times))
            left -= column * times
    while left.any():
        pattern, room = np.zeros(len(size), np.int64), capacity
        for g in np.argsort(-size):
            pattern[g] = min(int(left[g]), room // int(size[g]))
            room -= int(pattern[g] * size[g])
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def best_fit(
    rooms: dict[int, int], counts: dict[int, int], capacity: int
) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, largest first, for runs of equal pieces into runs of equal rooms.

    Sequences are numbered by room (descending), new ones follow. Returns runs
    (length, first rank, number of pieces, first sequence, room used before) and the
    number of sequences.
    """
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    total = 0
    for room in sorted(rooms, reverse=True):
        by_room[room].append((total, rooms[room]))
        total += rooms[room]
    filled = np.zeros(capacity + 1, bool)
    for room, runs in enumerate(by_room):
        filled[room] = bool(runs)
    out = []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fitting = np.flatnonzero(filled[length:])
            if len(fitting):
                room = length + int(fitting[0])
                first, size = by_room[room].pop()
            else:
                room, size = capacity, -(-left // max(1, capacity // length))
                first, total = total, total + size
            used = min(size, left)
            out.append((length, rank, used, first, capacity - room))
            if used < size:
                by_room[room].append((first + used, size - used))
            by_room[room - length].append((first, used))
            filled[room], filled[room - length] = bool(by_room[room]), True
            rank, left = rank + used, left - used
    return out, total


# --- placing -----------------------------------------------------------------


def _lookup(spark: SparkSession, keys: np.ndarray, starts: np.ndarray, values: np.ndarray):
    """A function of (key, rank) columns: the row of ``values`` whose run holds the rank."""
    order = np.lexsort((starts, keys))
    shared = spark.sparkContext.broadcast((keys[order], starts[order], values[order]))
    kind = "array<bigint>"

    @F.pandas_udf(kind)
    def place(key, rank):
        import pandas as pd

        keys, starts, values = shared.value
        k, r = key.to_numpy(), rank.to_numpy()
        lo = np.searchsorted(keys, k, "left")
        out = np.empty((len(k), values.shape[1] + 1), np.int64)
        for value in np.unique(k):
            mine = np.flatnonzero(k == value)
            a, b = lo[mine[0]], np.searchsorted(keys, value, "right")
            at = a + np.searchsorted(starts[a:b], r[mine], "right") - 1
            out[mine, :-1], out[mine, -1] = values[at], r[mine] - starts[at]
        return pd.Series(list(out))

    return place


def _counts(frame: DataFrame, column: str) -> dict[int, int]:
    """Rows per value; there are at most ``capacity`` values, whatever the input."""
    rows = frame.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()
    return {row[column]: row["n"] for row in rows}


def _large(
    spark: SparkSession, pieces: DataFrame, counts: dict, capacity: int, smallest: int, groups: int
) -> DataFrame:
    """Large pieces with the planned sequence and the place's number in it."""
    by_length = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        by_length[length] = n
    runs = linear_groups(by_length, smallest, groups)
    demand = [int(by_length[low : high + 1].sum()) for low, high in runs]
    plan = configurations([high for _, high in runs], demand, capacity)
    keys, starts, values = [], [], []
    taken, sequence = [0] * len(runs), 0
    for pattern, times in plan:
        slot = 0
        for g, copies in enumerate(pattern):
            for _ in range(int(copies)):
                keys.append(g)
                starts.append(taken[g])
                values.append((sequence, slot))
                taken[g] += times
                slot += 1
        sequence += times
    place = _lookup(spark, np.array(keys), np.array(starts), np.array(values).reshape(-1, 2))
    # A piece's rank in its group: pieces of the group's shorter lengths come first.
    shift, group_of = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for g, (low, high) in enumerate(runs):
        before = 0
        for length in range(low, high + 1):
            shift[length], group_of[length] = before, g
            before += int(by_length[length])
    table = spark.createDataFrame(
        [(int(n), int(group_of[n]), int(shift[n])) for n in counts if n >= smallest],
        "length long, grp long, shift long",
    )
    placed = (
        pieces.where(F.col("length") >= smallest)
        .join(F.broadcast(table), "length")
        .withColumn("_at", place(F.col("grp"), F.col("rank") + F.col("shift")))
    )
    return placed.withColumns(
        {"planned": F.col("_at")[0] + F.col("_at")[2], "slot": F.col("_at")[1]}
    ).drop("_at", "grp", "shift")


def pack(
    spark: SparkSession,
    pieces: DataFrame,
    capacity: int = 4096,
    groups: int = 48,
    large_share: int = 8,
    ids: tuple[str, ...] = ("doc_id", "piece"),
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` up to ``capacity``.

    Lengths above ``capacity // large_share`` are planned by configurations, the others
    by best fit. ``groups`` is the number of rounded sizes.
    """
    columns = pieces.columns
    pieces = stored(spark, pieces, "pieces")
    counts = _counts(pieces, "length")
    chunks = 1 + sum(counts.values()) // CHUNK_ROWS
    pieces = stored(spark, ranked(pieces, chunks, "length", [*ids], "rank"), "ranked")
    smallest = capacity // large_share + 1
    large = stored(spark, _large(spark, pieces, counts, capacity, smallest, groups), "large")

    rooms = large.groupBy("planned").agg((capacity - F.sum("length")).alias("room"))
    rooms = stored(spark, rooms, "rooms")
    room_counts = _counts(rooms, "room")
    small_counts = {n: c for n, c in counts.items() if n < smallest}
    runs, total = best_fit(room_counts, small_counts, capacity)
    firsts, at = {}, 0
    for room in sorted(room_counts, reverse=True):
        firsts[room], at = at, at + room_counts[room]
    table = spark.createDataFrame([*firsts.items()], "room long, first long")
    sequences = ranked(rooms, chunks, "room", ["planned"], "nth").join(F.broadcast(table), "room")
    sequences = sequences.select("planned", (F.col("first") + F.col("nth")).alias("sequence_id"))
    placed = large.join(sequences, "planned").select(
        *columns, "sequence_id", F.col("slot").alias("_turn")
    )
    if runs:
        run = np.array(runs, np.int64)
        place = _lookup(spark, run[:, 0], run[:, 1], run[:, [3, 4]])
        small = pieces.where(F.col("length") < smallest)
        small = small.withColumn("_at", place(F.col("length"), F.col("rank")))
        small = small.select(
            *columns,
            (F.col("_at")[0] + F.col("_at")[2]).alias("sequence_id"),
            (F.col("_at")[1] + capacity).alias("_turn"),
        )
        placed = placed.union(small)
    before = (
        Window.partitionBy("sequence_id")
        .orderBy("_turn", *ids)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    ).select(*columns, "sequence_id", "offset")
