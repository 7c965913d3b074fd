"""Byte-pair encoding of distinct words along a prefix trie, and decoding.

A text is cut at ASCII blanks into chunks. No token spans two of them, so each
distinct chunk is encoded once per task: its words go into a trie, a depth-first walk
gives every prefix its last token, and a word's tokens are read back along its path.
A prefix's last token t is the vocabulary entry at its end that byte-pair encoding
leaves whole and that may follow the last token of the rest; sequences whose
neighbours are all of that kind are exactly the encodings, so shared prefixes are
worked out once and no merge loop runs over a word.

Defined cases: a null or empty text has no tokens and decodes to ''. Repeated texts are
encoded alike. Columns besides the id and the text are not looked at. An empty table
gives an empty result. Words and texts may be of any length.
"""

from __future__ import annotations

import gc
import json
import re
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeweave.llm.common import find_words, slices

WORD_END = "</w>"
# The file's own rule for the pieces of a chunk, where that is printable ASCII; for other
# chunks the file's normalizer and pre-tokenizer are called.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
# Distinct chunks, and distinct words, that one Python worker remembers; beyond it the
# memory starts anew.
REMEMBERED = 400_000


class Vocabulary:
    """Tokens, merge ranks and added tokens of a word-end byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        tokens: dict[str, int] = spec["model"]["vocab"]
        self.tokens = tokens
        self.names = {i: t for t, i in tokens.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.added.items()})
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.halves: dict[str, tuple[str, str]] = {}
        self.made: dict[str, int] = dict.fromkeys(tokens, -1)
        for (a, b), rank in self.ranks.items():
            if a + b not in self.halves:
                self.halves[a + b], self.made[a + b] = (a, b), rank
        end = len(WORD_END)
        usable = {t: i for t, i in tokens.items() if self._whole(t)}
        last = {t[:-end]: i for t, i in usable.items() if t.endswith(WORD_END)}
        inner = {t: i for t, i in usable.items() if not t.endswith(WORD_END)}
        self._automaton(inner, last)
        rules = Tokenizer.from_file(path)
        self.normalize = rules.normalizer.normalize_str
        self.cut = rules.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self._known: dict[tuple[int, int], bool] = {}
        self._words: dict[str, list[int]] = {}

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            body = token[: -len(WORD_END)]
            return [*body[:-1], body[-1] + WORD_END]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain merging of a short run of symbols, to learn about tokens and pairs."""
        while len(symbols) > 1:
            ranked = [
                (self.ranks[pair], i)
                for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))
                if pair in self.ranks
            ]
            if not ranked:
                break
            _, i = min(ranked)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _whole(self, token: str) -> bool:
        """Whether encoding the token's own characters gives the token."""
        return self._merge(self._symbols(token)) == [token]

    def follows(self, left: str, right: str) -> bool:
        """Whether the second token may stand after the first in an encoding.

        Undoes the merges next to the border, the latest first. The pair that meets at
        the border must not have been due earlier than the merge undone last; of equal
        merges the leftmost is done first.
        """
        ranks, made, halves, due = self.ranks, self.made, self.halves, len(self.ranks)
        while ranks.get((left, right), due) >= due:
            a, b = made[left], made[right]
            if a > b:
                due, left = a, halves[left][1]
            elif b >= 0:
                due, right = b + 1, halves[right][0]
            else:
                return True
        return False

    def _automaton(self, inner: dict[str, int], last: dict[str, int]) -> None:
        """States for the longest token beginning that a prefix ends with.

        ``step`` leads on by a symbol, ``back`` to the next shorter such beginning;
        ``inner_ends`` and ``last_ends`` list the (length, token) that a prefix in that
        state ends with, longest first.
        """
        step: list[dict[str, int]] = [{}]
        inner_ends: list[list] = [[]]
        last_ends: list[list] = [[]]
        for table, ends in ((inner, inner_ends), (last, last_ends)):
            for name, token in table.items():
                state = 0
                for symbol in name:
                    if symbol not in step[state]:
                        step[state][symbol] = len(step)
                        step.append({})
                        inner_ends.append([])
                        last_ends.append([])
                    state = step[state][symbol]
                ends[state].append((len(name), token))
        back = [0] * len(step)
        queue = list(step[0].values())
        for state in queue:
            inner_ends[state] += inner_ends[back[state]]
            last_ends[state] += last_ends[back[state]]
            for symbol, then in step[state].items():
                shorter = back[state]
                while shorter and symbol not in step[shorter]:
                    shorter = back[shorter]
                back[then] = step[shorter].get(symbol, 0)
                queue.append(then)
        self.step, self.back = step, back
        self.inner_ends, self.last_ends = inner_ends, last_ends

    def _ending(self, ends: list, depth: int, states: list) -> tuple[int, int]:
        """The last token of a prefix, and its length.

        ``ends`` are the tokens at the prefix's end, ``depth`` its length, ``states``
        what was found for its own prefixes.
        """
        known = self._known
        for size, token in ends:
            if size == depth:
                return token, size
            pair = states[depth - size][0], token
            fits = known.get(pair)
            if fits is None:
                fits = known[pair] = self.follows(self.names[pair[0]], self.names[token])
            if fits:
                return token, size
        raise ValueError("the vocabulary lacks a byte")

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Tokens of every word (given in byte symbols), by one walk over their trie."""
        if len(self._known) > 1_000_000:
            self._known.clear()
        root: dict = {}
        for word in words:
            node = root
            for symbol in word:
                if symbol in node:
                    node = node[symbol]
                else:
                    node[symbol] = node = {}
            node[""] = word
        step, back, ending = self.step, self.back, self._ending
        inner_ends, last_ends = self.inner_ends, self.last_ends
        found: dict[str, list[int]] = {}
        # states[d]: last token and its length for the current path's first d symbols.
        states: list[tuple[int, int]] = [(-1, 0)]
        todo = [(symbol, child, 1, 0) for symbol, child in root.items()]
        while todo:
            symbol, node, depth, state = todo.pop()
            del states[depth:]
            while state and symbol not in step[state]:
                state = back[state]
            state = step[state].get(symbol, 0)
            word = node.pop("", None)
            if word is not None:
                token, size = ending(last_ends[state], depth, states)
                ids, at = [token], depth - size
                while at:
                    token, size = states[at]
                    ids.append(token)
                    at -= size
                ids.reverse()
                found[word] = ids
            if node:
                states.append(ending(inner_ends[state], depth, states))
                for following, child in node.items():
                    todo.append((following, child, depth + 1, state))
        return found

    def pieces(self, chunk: str) -> list[str | int]:
        """A chunk's words in byte symbols, and the ids of added tokens in it."""
        out: list[str | int] = []
        parts = self.special.split(chunk) if "<|" in chunk else (chunk,)
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
                continue
            if part.isascii() and part.isprintable():
                out += PIECES.findall(part.lower())
            else:
                out += [piece for piece, _ in self.cut(self.normalize(part))]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        known = self._words
        if len(known) > REMEMBERED:
            known.clear()
        cut = [self.pieces(chunk) for chunk in chunks]
        pieces = {w for words in cut for w in words if isinstance(w, str)}
        known.update(self.encode_words(pieces - known.keys()))
        return [
            [i for w in words for i in (known[w] if isinstance(w, str) else (w,))] for words in cut
        ]

    def decode(self, ids: list[int]) -> str:
        """Token names with blanks between; the file names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids])


@contextmanager
def no_cycle_search():
    """Tries and memories hold no cycles; looking for them took a third of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def in_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_VOCABULARIES: dict[str, Vocabulary] = {}
_MEMORIES: dict[str, dict[str, tuple[bytes, str]]] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary, loaded once per Python worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _encoder(path: str, id_col: str, text_col: str) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = vocabulary(path), _MEMORIES.setdefault(path, {})
        for batch in slices(batches):
            with no_cycle_search():
                split = [find_words(t) if t else [] for t in batch.column(text_col).to_pylist()]
                if len(memory) > REMEMBERED:
                    memory.clear()
                new = list({chunk for chunks in split for chunk in chunks if chunk not in memory})
                for chunk, ids in zip(new, model.encode_chunks(new), strict=True):
                    memory[chunk] = in_bytes(ids), model.decode(ids)
                ids, decoded = [], []
                for chunks in split:
                    found = list(map(memory.__getitem__, chunks))
                    ids.append(b"".join([x for x, _ in found]))
                    decoded.append(" ".join([y for _, y in found if y]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array(ids, pa.binary()),
                    pa.array(decoded, pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    return run


def encode_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit integers), ``decoded`` per text."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(
        _encoder(path, id_col, text_col), f"doc_id {kind}, ids binary, decoded string"
    )


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
