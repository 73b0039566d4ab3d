"""Long exact spans shared between texts: super-k-mer partitioning.

A window is ``length`` code points.  Its minimiser is the smallest hash among its substrings of ``seed`` code points, so two
equal windows have equal minimisers.  Consecutive windows of a text with one minimiser form a super-k-mer.

1. Equal whole texts are put together first (class of equal texts, one of them stands for all).
2. Each text is cut into super-k-mers; only (minimiser, text, place) travels.  Ranges of the sorted minimisers tell which ones
   occur in two texts or more; a window whose minimiser occurs in one text only can't be shared.
3. The super-k-mers that are left travel as packed strings to the bucket of their minimiser, where sorting their windows
   counts them exactly.  Windows met in the same set of texts form one class of texts.
4. Small classes give their pairs at once, larger ones by joining blocks of their members, and pairs of texts are expanded to
   pairs of documents.

Minimisers with more than ``HOT`` super-k-mers travel window by window, so that no bucket holds a passage that occurs in a
third of all texts.

Cases: null and short texts share nothing; blank runs count like any other text; repeated passages inside one text are no
pair; texts of any length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import settle

LENGTH = 200
SEED = 100
HOT = 20_000
SMALL_CLASS = 64
CHUNK = 1_000_000
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(p^i, p^-i) modulo 2^64 for i < n."""
    p = 0xD6E8FEB86659FD93
    inv = pow(p, -1, 1 << 64)
    out = []
    for base in (p, inv):
        x = np.ones(n, np.uint64)
        x[1:] = np.uint64(base)
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Cutter:
    """Cuts texts into super-k-mers."""

    def __init__(self, length: int = LENGTH, seed: int = SEED):
        self.k, self.m = length, seed
        self.up, self.down = _powers(CHUNK + 1)

    def hashes(self, c: np.ndarray) -> np.ndarray:
        """The hash of each substring of ``seed`` code points."""
        if len(c) > len(self.up):
            self.up, self.down = _powers(len(c))
        x = c.astype(np.uint64)
        x *= np.uint64(_ODD)
        x ^= x >> np.uint64(29)
        x *= self.up[: len(x)]
        s = np.cumsum(x)
        h = s[self.m - 1 :].copy()
        h[1:] -= s[: len(s) - self.m]
        h *= self.down[: len(h)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_ODD)
        h ^= h >> np.uint64(29)
        return h

    def minima(self, h: np.ndarray) -> np.ndarray:
        """The smallest hash of each window: prefix and suffix minima of blocks of the window's width."""
        w = self.k - self.m + 1
        n = len(h) - w + 1
        pad = -len(h) % w
        b = np.concatenate([h, np.full(pad, _MASK, np.uint64)]).reshape(-1, w)
        pre = np.minimum.accumulate(b, axis=1).ravel()
        suf = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(suf[:n], pre[w - 1 : w - 1 + n])

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the text, first window, number of windows, minimiser) of every super-k-mer."""
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        none = np.zeros(0, np.int64)
        if len(c) < self.k:
            return none, none, none, none.astype(np.uint64)
        low = self.minima(self.hashes(c))
        ends = np.cumsum(n)
        text = np.repeat(np.arange(len(n)), n)[: len(low)]
        first = np.ones(len(low), bool)
        first[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
        room = ends - self.k  # the last window of each text
        bad = np.arange(len(low)) > room[text]
        first |= np.concatenate([[False], bad[1:] != bad[:-1]])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(low)))
        ok = ~bad[at]
        at, size = at[ok], size[ok]
        return text[at], at - (ends - n)[text[at]], size, low[at]


def distinct_texts(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rep, doc_id): each document with a text of ``length`` or more and the smallest one with an equal text."""
    x = documents.filter(F.length("text") >= length).select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("h"))
    low = x.groupBy("h").agg(F.min("doc_id").alias("rep"))
    return x.join(low, "h").select("rep", "doc_id")


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    s = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield s, i
            s, size = i, 0
        size += len(t)
    if s < len(texts):
        yield s, len(texts)


def _minimisers(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(length, seed)
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for s, e in _chunks(texts):
                t, start, n, low = cutter.cut(texts[s:e])
                cols = [pa.array(low.view(np.int64)), pa.array(ids[s:e][t]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["low", "doc", "start", "n"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by minimiser, those whose minimiser has two texts here or may have more in a neighbouring range."""
    carry: pa.RecordBatch | None = None
    opening = True
    for b in batches:
        if carry is not None and carry.num_rows:
            b = pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        low, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = int(np.searchsorted(low, low[-1]))  # the last run may go on
        if cut == 0 and len(low) > 100_000:  # one minimiser fills it: it's met often enough
            yield b.slice(0, len(low) - 1)
            carry, opening = b.slice(len(low) - 1), True
            continue
        yield b.slice(0, cut).filter(pa.array(_two(low[:cut], doc[:cut], opening)))
        carry, opening = b.slice(cut), opening and cut == 0
    if carry is not None:
        yield carry


def _two(low: np.ndarray, doc: np.ndarray, opening: bool) -> np.ndarray:
    if not len(low):
        return np.zeros(0, bool)
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    keep = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    keep[0] |= opening
    return np.repeat(keep, np.diff(np.append(at, len(low))))


def _packed(length: int):
    """(low, doc, start, s): the strings of the super-k-mers listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, doc, start, out = [], [], [], []
            for d, text, parts in zip(*(b.column(i).to_pylist() for i in range(3))):
                for p in parts:
                    low.append(p["low"]), doc.append(d), start.append(p["start"]), out.append(text[p["start"] : p["start"] + p["n"] - 1 + length])
            for s in range(0, len(low), 50_000):
                e = s + 50_000
                yield pa.RecordBatch.from_arrays([pa.array(low[s:e], pa.int64()), pa.array(doc[s:e], pa.int64()), pa.array(start[s:e], pa.int32()), pa.array(out[s:e], pa.string())], names=["low", "doc", "start", "s"])

    return run


def _bucket(length: int, small: int):
    """Sorted (low, doc, start, s) -> kind 0: pair (a, b); 1: member b of the class a; 2: windows a.. of length b shared in doc c."""

    def classes(rows: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, int, int]]:
        same: dict[str, list[tuple[int, int]]] = {}
        for doc, start, s in rows:
            same.setdefault(s, []).append((doc, start))
        if len(rows) < 2 or len({d for d, _, _ in rows}) < 2:
            return
        windows = sorted((s[i : i + length], j) for j, s in enumerate(same) for i in range(len(s) - length + 1))
        docs = [frozenset(d for d, _ in x) for x in same.values()]
        shared: dict[str, frozenset[int]] = {}
        sets: set[frozenset[int]] = set()
        known: dict[frozenset[int], frozenset[int]] = {}
        i = 0
        while i < len(windows):
            k = i + 1
            while k < len(windows) and windows[k][0] == windows[i][0]:
                k += 1
            strings = frozenset(j for _, j in windows[i:k])
            if strings not in known:
                known[strings] = frozenset().union(*(docs[j] for j in strings))
            who = known[strings]
            if len(who) > 1:
                shared[windows[i][0]] = who
                sets.add(who)
            i = k
        for who in sets:
            if len(who) <= small:
                for a, b in combinations(sorted(who), 2):
                    yield 0, a, b, 0
            else:
                members = sorted(who)
                name = xxhash.xxh64_intdigest(np.array(members, np.int64).tobytes()) - (1 << 63)
                for d in members:
                    yield 1, name, d, 0
        for s, places in same.items():
            n = len(s) - length + 1
            i = 0
            while i < n:
                if s[i : i + length] in shared:
                    k = i + 1
                    while k < n and s[k : k + length] in shared:
                        k += 1
                    for doc, start in places:
                        yield 2, start + i, k - i - 1 + length, doc
                    i = k
                i += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int, int, int]] = set()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            r = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "a", "b", "c"])
            out.clear()
            return r

        open_, rows = None, []
        for b in batches:
            for low, doc, start, s in zip(*(b.column(i).to_pylist() for i in range(4))):
                if low != open_:
                    out.update(classes(rows))
                    if len(out) > 100_000:
                        yield flush()
                    open_, rows = low, []
                rows.append((doc, start, s))
        out.update(classes(rows))
        yield flush()

    return run


def _windows(length: int):
    """Hot super-k-mers as (window digest, doc, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, doc, at = [], [], []
            for d, start, s in zip(*(b.column(i).to_pylist() for i in range(1, 4))):
                for i in range(len(s) - length + 1):
                    h.append(xxhash.xxh3_128_digest(s[i : i + length].encode("utf-8", "surrogatepass"))), doc.append(d), at.append(start + i)
                if len(h) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(doc, pa.int64()), pa.array(at, pa.int32())], names=["h", "doc", "start"])
                    h, doc, at = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(doc, pa.int64()), pa.array(at, pa.int32())], names=["h", "doc", "start"])

    return run


def shared_spans(documents: DataFrame, length: int = LENGTH, seed: int | None = None, hot: int = HOT, small: int = SMALL_CLASS) -> tuple[DataFrame, DataFrame]:
    """(classes of equal texts (rep, doc_id), spans (kind, a, b, c)) as tables; see ``_bucket`` for the kinds."""
    seed = seed or max(1, length // 2)
    same = settle(distinct_texts(documents, length), "same")
    texts = documents.filter(F.length("text") >= length).select(F.col("doc_id").cast("long").alias("doc"), "text")
    # repeated ids with different texts stay texts of their own; only exact repeats are left out
    texts = texts.join(same.filter("rep = doc_id").select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi")
    mins = settle(texts.mapInArrow(_minimisers(length, seed), "low long, doc long, start int, n int"), "minimisers")
    kept = settle(mins.repartitionByRange("low", "doc").sortWithinPartitions("low").mapInArrow(_shared, "low long, doc long, start int, n int"), "kept")
    lists = kept.groupBy("doc").agg(F.collect_list(F.struct("low", "start", "n")).alias("parts"))
    strings = texts.join(lists, "doc").mapInArrow(_packed(length), "low long, doc long, start int, s string")
    many = kept.groupBy("low").count().filter(F.col("count") > hot).select("low")
    packed = settle(strings, "packed")
    out_schema = "kind int, a long, b long, c long"
    normal = packed.join(many, "low", "left_anti")
    spans = normal.repartition("low").sortWithinPartitions("low").mapInArrow(_bucket(length, small), out_schema)
    if not many.isEmpty():
        w = settle(packed.join(many, "low", "left_semi").mapInArrow(_windows(length), "h binary, doc long, start int"), "windows")
        two = w.groupBy("h").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).filter("d0 <> d1").select("h")
        x = w.join(two, "h")
        spans = spans.unionByName(x.select(F.lit(1).alias("kind"), F.xxhash64("h").alias("a"), F.col("doc").alias("b"), F.lit(0).cast("long").alias("c")).distinct())
        spans = spans.unionByName(x.select(F.lit(2).alias("kind"), F.col("start").cast("long").alias("a"), F.lit(length).cast("long").alias("b"), F.col("doc").alias("c")))
    return same, settle(spans, "spans")


def _block_pairs(members: DataFrame, block: int = 256) -> DataFrame:
    """(a, b), a < b, of the members (cls, doc) of each class, made block by block of the class."""
    m = members.distinct()
    n = m.groupBy("cls").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")  # most classes have one member
    m = m.join(n, "cls").select("cls", "doc", "blocks", F.pmod(F.xxhash64("doc"), "blocks").alias("blk"))
    left = m.select("cls", "doc", F.col("blk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = m.select("cls", F.col("doc").alias("doc2"), F.col("blk").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    return left.join(right, ["cls", "i", "j"]).filter("doc < doc2").select(F.col("doc").alias("a"), F.col("doc2").alias("b"))


def sharing_pairs(documents: DataFrame, **how: int) -> DataFrame:
    """(left_doc_id, right_doc_id): documents whose texts share a run of ``length`` code points."""
    same, spans = shared_spans(documents, **how)
    pairs = spans.filter("kind = 0").select("a", "b").unionByName(_block_pairs(spans.filter("kind = 1").select(F.col("a").alias("cls"), F.col("b").alias("doc"))))
    pairs = pairs.distinct()
    m1, m2 = same.select(F.col("rep").alias("a"), F.col("doc_id").alias("l")), same.select(F.col("rep").alias("b"), F.col("doc_id").alias("r"))
    across = pairs.join(m1, "a").join(m2, "b").select("l", "r")
    within = _block_pairs(same.select(F.col("rep").alias("cls"), F.col("doc_id").alias("doc"))).select(F.col("a").alias("l"), F.col("b").alias("r"))
    out = across.unionByName(within).filter("l <> r")
    return out.select(F.least("l", "r").alias("left_doc_id"), F.greatest("l", "r").alias("right_doc_id")).distinct()


def shared_part(documents: DataFrame, **how: int) -> DataFrame:
    """(doc_id, n_chars, shared_chars): how much of each text of ``length`` or more stands in another document too."""
    from pyspark.sql import Window as W

    same, spans = shared_spans(documents, **how)
    x = spans.filter("kind = 2").select(F.col("c").alias("rep"), F.col("a").alias("s"), (F.col("a") + F.col("b")).alias("e")).distinct()
    before = W.partitionBy("rep").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("seen", F.coalesce(F.max("e").over(before), F.lit(0)))
    part = x.groupBy("rep").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "seen"))).alias("shared"))
    copies = same.groupBy("rep").agg(F.count("*").alias("copies"))
    sizes = documents.filter(F.length("text") >= how.get("length", LENGTH)).select("doc_id", F.length("text").cast("long").alias("n_chars"))
    y = same.join(copies, "rep").join(part, "rep", "left").join(sizes, "doc_id")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0)))
    return y.select("doc_id", "n_chars", shared.alias("shared_chars"))
