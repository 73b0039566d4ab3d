"""Encoding of whole texts with a byte-level BPE vocabulary, as rounds over padded matrices.

The texts of an Arrow batch are split by the vocabulary's pattern; each different piece is encoded once and remembered
by the worker (``KEPT_PIECES`` at most, then the memory is emptied).  Pieces are bucketed by length into padded matrices.
In every round each row merges its leftmost pair of minimum rank; the ranks of pairs come from an open-addressing hash
table, rows that are done leave the matrix, and the cells behind a merge close up.  Pieces longer than ``WIDEST`` bytes go
through a heap of pairs instead, which makes the same merges in the same order in O(n log n).

The vocabulary (fixed size, about 50,000 entries) is read by the driver from a path and broadcast as arrays.

Cases: null and empty texts give the empty list; special-token strings in a text are ordinary text; a lone surrogate
becomes U+FFFD; repeated ids give one row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_PIECES = 400_000
WIDEST = 256
SLICE_CHARS = 4_000_000
_NONE = np.int32(2**31 - 1)
_BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, WIDEST)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Hashed lookup (left id, right id) -> id of the merged token, for whole arrays at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, vals = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    vals.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        n = 1 << self.bits
        self.keys, self.vals = np.full(n, -1, np.int64), np.full(n, _NONE, np.int32)
        todo_k, todo_v = np.array(keys, np.int64), np.array(vals, np.int32)
        at = self._slot(todo_k)
        while len(todo_k):
            free = self.keys[at] < 0
            self.keys[at[free]] = todo_k[free]  # of several for one slot the last stays
            won = self.keys[at] == todo_k
            self.vals[at[won]] = todo_v[won]
            todo_k, todo_v, at = todo_k[~won], todo_v[~won], (at[~won] + 1) & (n - 1)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids, ``_NONE`` where the pair has none; a negative id is padding and pairs with nothing."""
        k = a.astype(np.int64) << 20 | b.astype(np.int64)
        out = np.full(k.shape, _NONE, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        k = k[open_]
        at = self._slot(k)
        while len(open_):
            there = self.keys[at]
            hit = there == k
            out[open_[hit]] = self.vals[at[hit]]
            on = ~hit & (there >= 0)
            open_, k, at = open_[on], k[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _matrix(table: PairTable, rows: list[bytes], width: int) -> list[np.ndarray]:
    """The ids of each of ``rows``, none longer than ``width`` bytes."""
    n = len(rows)
    lens = np.fromiter(map(len, rows), np.int64, n)
    x = np.full((n, width), -1, np.int32)
    inside = np.arange(width) < lens[:, None]
    x[inside] = table.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
    r = table.look(x[:, :-1].ravel(), x[:, 1:].ravel()).reshape(n, width - 1)
    out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    who = np.arange(n)
    while len(who):
        at = r.argmin(axis=1)
        best = r[np.arange(len(who)), at]
        done = best == _NONE
        if done.any():
            for i in np.flatnonzero(done):
                out[who[i]] = x[i, : lens[who[i]]]
            go = ~done
            x, r, who, at, best = x[go], r[go], who[go], at[go], best[go]
            if not len(who):
                break
        here = np.arange(len(who))
        cols = np.arange(x.shape[1])
        x[here, at] = best
        x = np.take_along_axis(np.pad(x, ((0, 0), (0, 1)), constant_values=-1), cols + (cols > at[:, None]), 1)
        cols = cols[:-1]
        r = np.take_along_axis(np.pad(r, ((0, 0), (0, 1)), constant_values=_NONE), cols + (cols >= at[:, None]), 1)
        lens[who] -= 1
        mid = x[here, at]
        left = np.maximum(at - 1, 0)
        fresh = table.look(np.where(at > 0, x[here, left], -1), mid)
        r[here[at > 0], left[at > 0]] = fresh[at > 0]
        right_ok = at < r.shape[1]
        right = np.minimum(at + 1, x.shape[1] - 1)
        fresh = table.look(mid, np.where(at + 1 < x.shape[1], x[here, right], -1))
        r[here[right_ok], at[right_ok]] = fresh[right_ok]
    return out


def _heap(table: PairTable, piece: bytes) -> np.ndarray:
    """The same merges for one long piece: a heap of (rank, place) over a linked list."""
    x = table.byte_ids[np.frombuffer(piece, np.uint8)]
    first = table.look(x[:-1], x[1:])
    ids, n = x.tolist(), len(x)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, r in enumerate(first.tolist()) if r != _NONE]
    heapq.heapify(heap)
    rank_at = first.tolist() + [int(_NONE)]
    one = lambda a, b: int(table.look(np.array([a], np.int32), np.array([b], np.int32))[0])
    known: dict[tuple[int, int], int] = {}
    while heap:
        r, i = heapq.heappop(heap)
        if ids[i] < 0 or rank_at[i] != r:
            continue
        j = nxt[i]
        ids[i], ids[j], rank_at[j] = r, -1, int(_NONE)
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
        for p, q in ((prv[i], i), (i, k)):
            if p < 0:
                continue
            rank_at[p] = int(_NONE)
            if q < n:
                pair = ids[p], ids[q]
                if pair not in known:
                    known[pair] = one(*pair)
                rank_at[p] = known[pair]
                if rank_at[p] != _NONE:
                    heapq.heappush(heap, (rank_at[p], p))
    return np.array([i for i in ids if i >= 0], np.int32)


def encode_pieces(table: PairTable, pieces: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
    by: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        n = len(p)
        if n < 2:
            out[i] = table.byte_ids[np.frombuffer(p, np.uint8)]
        elif n > WIDEST:
            out[i] = _heap(table, p)
        else:
            by.setdefault(next(w for w in _BUCKETS if w >= n), []).append(i)
    for width, at in by.items():
        step = max(1, 2_000_000 // width)
        for s in range(0, len(at), step):
            for i, ids in zip(at[s : s + step], _matrix(table, [pieces[i] for i in at[s : s + step]], width)):
                out[i] = ids
    return out


class _Pieces(dict):
    """piece -> number; pieces seen for the first time are listed in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        n = self[piece] = len(self)
        return n


class Encoder:
    """Encodes lists of texts; remembers the pieces it has met."""

    def __init__(self, table: PairTable):
        self.table, self.split = table, regex.compile(PATTERN).findall
        self._empty()

    def _empty(self) -> None:
        self.pieces = _Pieces()
        self.len, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self) -> None:
        if not self.pieces.new:
            return
        ids = encode_pieces(self.table, [p.encode("utf-8", "surrogatepass") for p in self.pieces.new])
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.len = np.concatenate([self.len, n])
        self.flat = np.concatenate([self.flat, *ids])
        self.pieces.new = []

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in order)."""
        if len(self.pieces) > KEPT_PIECES:
            self._empty()
        parts = [self.split(t) if t else () for t in texts]
        per = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(parts)), np.int32, int(per.sum()))
        del parts
        self._learn()
        n = self.len[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        src = np.repeat(self.start[at] - (ends - n), n) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        return np.diff(bounds), self.flat[src]


_ENCODERS: dict[str, Encoder] = {}


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    s = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE_CHARS:
            yield s, i + 1
            s, size = i + 1, 0
    yield s, len(texts)


def _encoded(documents: DataFrame, schema: str, vocabulary: str, make) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(PairTable(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from citeloom.llm import tokens as here  # the worker's own module: its encoder outlives the task

        if vocabulary not in here._ENCODERS:
            here._ENCODERS[vocabulary] = Encoder(shared.value)
        encoder = here._ENCODERS[vocabulary]
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in _slices(texts):
                n, ids = encoder(texts[s:e])
                yield make(b.column(0).slice(s, e - s), n, ids)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""

    def make(doc_id: pa.Array, n: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["doc_id", "ids"])

    return _encoded(documents, "doc_id long, ids array<int>", vocabulary, make)


def count(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n): the number of token ids of every document."""

    def make(doc_id: pa.Array, n: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_id, pa.array(n)], names=["doc_id", "n"])

    return _encoded(documents, "doc_id long, n long", vocabulary, make)
