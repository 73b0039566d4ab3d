"""Matching of works across sources that share no identifier.

1. Every record is brought to comparable features (title, authors, journal, year, places in the volume); records with equal
   features are one node from there on.
2. Random walks over the graph of records, their attributes (author, journal, year, volume, page) and title tokens give node
   sequences, on which skip-gram vectors with negative sampling are trained.  All records take part: they are dealt into shards of
   ``SHARD`` by their rarest node, so that records of one work mostly meet, each shard is trained where it lies, and what the
   shards learnt is averaged.  A token's vector is that of its letter trigrams, which brings misspellings near, moved by what was
   learnt for it.  What was learnt lives in ``SLOTS`` hashed slots, a fixed size whatever the corpus.
3. A record has two vectors, of its title and of its attributes, weighted by token counts over all records.  Hyperplanes turn
   each into a code of 64 bits; several tables of different bits of the codes give the blocks.  Rows are shuffled once for a
   group of tables, packed; the longer keys that more than a million records need, and the more tables that go with them so that
   a pair is missed as rarely at every size, are applied where a group's rows lie.
4. In a block, pairs from different sources with enough equal bits and no contradiction in year, volume, page and DOI are kept,
   each in the first group where it meets, and compared exactly, field by field.  Pairs that contradict each other are not made.
5. The two cosines and the field scores are calibrated to a confidence on pairs that identifiers decide, a bounded sample, and the
   pairs with ``ACCEPT`` or more are the matches.

All pairs of a block are treated alike, however large it is: a block of more than ``BIG`` records is compared in cells of two parts
each, so that no task holds it whole, which changes nothing in the result.

Cases: records without a title are left out; missing fields neither support nor contradict; authors that aren't a JSON array
count as missing; equal records from one source are no pair; an empty table gives an empty result; repeated ids count once.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.copies import plain_doi
from citeloom.llm import lookalikes
from citeloom.llm.lookalikes import consistent, names_of
from citeloom.llm.names import _FILLERS, distance, edits, folded, without_honours
from citeloom.operators.linkage import numbered_rows
from citeloom.session import settle

DIM = 64
TABLES = {"title": 10, "rest": 7}
#: ``TABLES`` holds for keys of so many bits; longer ones get as many tables more as keep the chance that a pair whose bits
#: agree with this probability is missed by all.
TABLE_BITS, AGREE = 6, 0.85
SHARD, WALKS, STEPS, WINDOW, NEGATIVES, BATCH, RATE = 20_000, 1, 4, 2, 64, 4096, 0.05
SLOTS = 1 << 16
COUNT_SLOTS = 1 << 20
KEY_BITS = 5
#: Blocks of more than so many records are compared in cells of two parts each; a task of the comparison gets about ``BLOCK_ROWS`` rows.
BIG, BLOCK_ROWS = 2_000_000, 200_000
#: The centres of the vectors are those of so many records.
PROBED = 20_000
#: The least confidence of a match.
ACCEPT = 0.9
#: Pairs of a block are compared if the two 64-bit codes together differ in so many bits at most.
NEAR_SUM = 38
CALIBRATION_PAIRS = 20_000
FEATURES = "id long, src string, cat string, t string, a string, j string, year int, vol string, iss string, page string, doi string, pmid string, pmcid string"


# ---------------------------------------------------------------- features

_READ = ("cp1252", "latin-1", "mac_roman", "cp850", "gbk", "cp1250")


#: Anything but ASCII and the usual marks of print.
_BEYOND = re.compile("[^\x00-\x7f\u2010-\u2015\u2018-\u201f\u2026\u2264\u2265]")


def mended(text: str) -> str:
    """``text`` with whole-text encoding damage undone where the bytes leave no doubt."""
    for _ in range(2):
        if not _BEYOND.search(text):
            return text
        high = [c for c in text if c >= "\x80"]
        for codec in _READ:
            try:
                got = text.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if len(got) < len(text) or codec == "gbk":
                text = got
                break
        else:
            if len(high) > 10 and sum("À" <= c <= "ÿ" for c in high) > 0.8 * len(high) and len(high) > 0.3 * len(text):
                for codec in ("gbk", "cp1251"):
                    try:
                        return text.encode("cp1252").decode(codec)
                    except UnicodeError:
                        continue
            return text
    return text


_WORDS = re.compile(r"[^\W_]+")
# Names of Greek letters that titles spell out.
_GREEK_NAMES = str.maketrans({k: f" {v} " for k, v in zip("αβγδεκλμσωΑΒ", "alpha beta gamma delta epsilon kappa lambda mu sigma omega alpha beta".split())})


def title_text(title: str) -> str:
    """Words of a title; a mark for a title that was cut and one for each lost character follow them."""
    text = (consistent(title) if title.isascii() else consistent(mended(title)).translate(_GREEK_NAMES)).replace("&", " and ")
    lost = text.count("�")
    cut = ("..." in text or "…" in text) and bool(re.search(r"(…|\.\.\.)\W*$", text)) and not re.search(r"\.{4,}", text)
    words = _WORDS.findall(folded(text.replace("�", "")))
    return " ".join(words) + (" …" if cut else "") + " �" * min(lost, 9)


@lru_cache(200_000)
def author_part(name: str) -> str:
    """``surname/initial`` of a typed name, as far as they can be told; empty for no name."""
    n = re.sub(r"\([^)]*\)", " ", consistent(name, True))
    head, comma, tail = n.partition(",")
    h, t = (without_honours(re.split(r"[\s.]+", x)) for x in (head, tail.partition(",")[0]))
    if not h or folded(n).startswith("et al"):
        return ""
    if len(h) < 2 and not t:
        h = [w for w in re.split(r"[\s.]+", head) if w]  # a name that looks like a title
    if comma and t:
        surname, given = "".join(h), t[0]
    elif len(h) == 1:
        surname, given = h[0], ""
    elif len(h[-1]) <= 3 and h[-1].isupper() and not h[0].isupper() or len(h[-1]) == 1:
        surname, given = "".join(h[:-1]), h[-1]
    else:
        k = 1
        while k < len(h) - 1 and len(h[k]) == 1:
            k += 1
        surname, given = "".join(h[k:]), h[0]
    s = "".join(_WORDS.findall(folded(surname)))
    return f"{s}/{folded(given)[:1]}" if s else ""


def author_text(authors_json: str | None) -> str:
    """``surname/initial`` of each author."""
    return " ".join(p for n in (names_of(authors_json) if authors_json else ()) if (p := author_part(n)))


@lru_cache(50_000)
def journal_text(journal: str | None) -> str:
    if not journal:
        return ""
    return " ".join(w for w in _WORDS.findall(folded(consistent(journal))) if w not in _FILLERS)


def _features(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookalikes.use(table)
        order = [x.split()[0] for x in FEATURES.split(", ")]
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            t = [title_text(x) for x in cols.pop("title").to_pylist()]
            a = [author_text(x) for x in cols.pop("authors_json").to_pylist()]
            j = [journal_text(x) for x in cols.pop("journal").to_pylist()]
            cols |= {"t": pa.array(t, pa.string()), "a": pa.array(a, pa.string()), "j": pa.array(j, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in order], names=order).filter(pa.array([x.strip(" …�") != "" for x in t]))

    return run


def features(records: DataFrame) -> DataFrame:
    blank = lambda c: F.when(F.trim(c) != "", F.trim(F.lower(c)))
    page = F.regexp_extract(F.col("start_page"), r"([0-9]+)", 1)
    x = records.filter("title is not null and trim(title) <> ''").select(
        F.col("id").cast("long").alias("id"), F.coalesce(F.lower(F.trim("source_db")), F.lit("")).alias("src"), F.coalesce("record_type_category", F.lit("other")).alias("cat"),
        "title", "authors_json", "journal", F.col("year").cast("int").alias("year"), blank(F.col("volume")).alias("vol"), blank(F.col("issue")).alias("iss"),
        F.when(page != "", page).alias("page"), plain_doi(F.col("doi")).alias("doi"), blank(F.col("pmid")).alias("pmid"), blank(F.col("pmcid")).alias("pmcid"),
    )
    return x.mapInArrow(_features(lookalikes.twins(records.sparkSession)), FEATURES)


# ---------------------------------------------------------------- vectors


_TABLE = np.random.default_rng(23).standard_normal((1 << 14, DIM)).astype(np.float32)


@lru_cache(1 << 18)
def _gram_row(gram: str) -> int:
    return xxhash.xxh32_intdigest(gram) & 0x3FFF


def _gram_rows(word: str) -> list[int]:
    g = f"^{word}$"
    return [_gram_row(g[i : i + 3]) for i in range(max(1, len(g) - 2))]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-6, np.linalg.norm(x, axis=1, keepdims=True))


def spelling(words: list[str]) -> np.ndarray:
    """The unit vector of the letter trigrams of each node."""
    grams = [_gram_rows(w.split(":")[-1]) for w in words]
    n = np.fromiter(map(len, grams), np.int64, len(words))
    return _unit(np.add.reduceat(_TABLE[np.fromiter((g for x in grams for g in x), np.int64, int(n.sum()))], np.cumsum(n) - n, axis=0))


def slots_of(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) % SLOTS for w in words), np.int64, len(words))


def _nodes(b: pa.RecordBatch) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """The different nodes of a batch, and for its title tokens and its attribute nodes (number of the node, row), row by row.

    A token keeps its spelling as name; the attributes are ``a:`` surname, ``j:`` journal word, ``y:`` year, ``v:`` volume, ``p:`` page.
    """
    col = lambda c: pc.fill_null(b.column(c).cast(pa.string()), "")

    def words(c: str) -> tuple[pa.Array, np.ndarray]:
        lists = pc.split_pattern(col(c), " ")
        flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
        some = pc.invert(pc.is_in(flat, pa.array(["", "…", "�"])))
        return flat.filter(some), rows.filter(some).to_numpy()

    def value(c: str) -> tuple[pa.Array, np.ndarray]:
        some = pc.not_equal(col(c), "0" if c == "year" else "")
        some = pc.and_(some, pc.not_equal(col(c), ""))
        return col(c).filter(some), np.flatnonzero(some.to_numpy(zero_copy_only=False))

    title, (a, a_rows) = words("t"), words("a")
    rest = [(pc.list_element(pc.split_pattern(a, "/", max_splits=1), 0), a_rows), words("j"), *(value(c) for c in ("year", "vol", "page"))]
    named = [pc.binary_join_element_wise(pa.scalar(f"{k}:"), x, pa.scalar("")) for k, (x, _) in zip("ajyvp", rest)]
    coded = pa.concat_arrays([title[0], *named]).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    rows = np.concatenate([r for _, r in rest])
    order = np.argsort(rows, kind="stable")
    return coded.dictionary.to_pylist(), [(code[: len(title[1])], title[1]), (code[len(title[1]) :][order], rows[order])]


def _different(n: int, views: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, row) of the different nodes of each row, in the order in which the row has them; ``n`` nodes in all."""
    code, rows = (np.concatenate([v[k] for v in views]) for k in (0, 1))
    order = np.argsort(rows, kind="stable")
    code, rows = code[order], rows[order]
    first = np.sort(np.unique(rows * n + code, return_index=True)[1])
    return code[first], rows[first]


def _count_slots(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) % COUNT_SLOTS for w in words), np.int64, len(words))


def _add(to: np.ndarray, at: np.ndarray, what: np.ndarray, most: float = 8.0) -> None:
    """``to[at] += what``, by sorting; a place that is met more than ``most`` times moves as if it were met so often."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[first, len(at)]).astype(np.float32)[:, None]
    to[at[first]] += np.add.reduceat(what[order], first, axis=0) / np.maximum(1.0, n / most)


def learnt(lists: list[list[str]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(slots, what the nodes in them moved) of one shard of records, each a list of its different nodes."""
    lists = [x for x in lists if x]
    return _learnt(pa.array([w for x in lists for w in x], pa.string()), np.fromiter(map(len, lists), np.int64, len(lists)), seed)


def _learnt(words: pa.Array, n: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``learnt`` of the nodes of all records, one record after the other, of which each has ``n``."""
    rng = np.random.default_rng(seed)
    coded = words.dictionary_encode()
    vocab, flat = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if not vocab:
        return np.zeros(0, np.int64), np.zeros((0, DIM), np.float32)
    first = np.cumsum(n) - n
    by_node = np.argsort(flat, kind="stable")
    deg = np.bincount(flat, minlength=len(vocab))
    node_first = np.cumsum(deg) - deg
    record_of = np.repeat(np.arange(len(n)), n)[by_node]
    pick = lambda start, size: start + (rng.random(len(start)) * size).astype(np.int64)
    # a walk goes record -> node -> record -> node ...; its nodes are the sequence
    at, path = np.tile(np.arange(len(n)), WALKS), []
    for _ in range(STEPS):
        node = flat[pick(first[at], n[at])]
        path.append(node)
        at = record_of[pick(node_first[node], deg[node])]
    walk = np.stack(path, 1)
    pairs = [(walk[:, :-d].ravel(), walk[:, d:].ravel()) for d in range(1, WINDOW + 1)]
    c = np.concatenate([x for p in pairs for x in p])
    o = np.concatenate([x for p in pairs for x in p[::-1]])
    other = np.flatnonzero(c != o)
    mix = other[rng.permutation(len(other))]
    c, o = c[mix], o[mix]
    begin = spelling(vocab)
    vec, out = begin.copy(), begin.copy()
    cdf = np.cumsum(deg**0.75 / (deg**0.75).sum())
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -20, 20)))
    for s in range(0, len(c), BATCH):
        ci, oi = c[s : s + BATCH], o[s : s + BATCH]
        neg = np.searchsorted(cdf, rng.random(NEGATIVES)).clip(0, len(vocab) - 1)
        v, u, w = vec[ci], out[oi], out[neg]
        up = (RATE * (1 - sigmoid(np.einsum("ij,ij->i", v, u))))[:, None].astype(np.float32)
        down = (-RATE * 5 / NEGATIVES * sigmoid(v @ w.T)).astype(np.float32)
        _add(vec, ci, up * u + down @ w)
        _add(out, np.concatenate([oi, neg]), np.concatenate([up * v, down.T @ v]))
    moved = vec - begin
    moved -= moved.mean(0)
    slots = slots_of(vocab)
    order = np.argsort(slots, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(slots[order]) > 0])
    size = np.diff(np.r_[head, len(order)])[:, None]
    return slots[order][head], np.add.reduceat(moved[order], head, axis=0) / size


def _sharded(counts):
    """(shard, nodes): every record's nodes with the hash of the rarest one that another record has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, views = _nodes(b)
            code, rows = _different(len(words), views)
            n = np.bincount(rows, minlength=b.num_rows)
            held = np.flatnonzero(n)
            keys = np.full(b.num_rows, xxhash.xxh32_intdigest(""), np.int64)
            if len(held):
                met = counts.value[_count_slots(words)].astype(np.int64)
                by_name = pc.sort_indices(pa.array(words, pa.string())).to_numpy().astype(np.int64)
                rank = np.empty(len(words), np.int64)
                rank[by_name] = np.arange(len(words))
                # nodes of one record come last, then the rarest first
                least = np.minimum.reduceat(((met <= 1).astype(np.int64) << 62 | met << 26 | rank)[code], (np.cumsum(n) - n)[held])
                keys[held] = np.fromiter((xxhash.xxh32_intdigest(words[k]) for k in by_name[least & (1 << 26) - 1]), np.int64, len(held))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(words, pa.string()).take(pa.array(code)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pc.binary_join(lists, "\x1f")], names=["shard", "nodes"])

    return run


def _train_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n, v) of each shard of sorted rows, summed over the shards of the task."""
    total, n = np.zeros((SLOTS, DIM), np.float32), np.zeros(SLOTS, np.int32)
    held: list[str] = []
    now: int | None = None

    def close() -> None:
        if held:
            lists = pc.split_pattern(pa.array(held, pa.string()), "\x1f")
            at, moved = _learnt(pc.list_flatten(lists), pc.list_value_length(lists).to_numpy().astype(np.int64), 7 + (now or 0))
            total[at] += moved
            n[at] += 1
            held.clear()

    for b in batches:
        for shard, nodes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if shard != now or len(held) >= 4 * SHARD:  # a rare node that many share is trained in pieces
                close()
                now = shard
            held.append(nodes)
    close()
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array([x.astype(np.float16).tobytes() for x in total[at]], pa.binary())], names=["slot", "n", "v"])


def _mean_of_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    n: dict[int, int] = {}
    for b in batches:
        for slot, k, v in zip(*(b.column(i).to_pylist() for i in range(3))):
            total[slot] = total.get(slot, 0) + np.frombuffer(v, np.float16).astype(np.float32)
            n[slot] = n.get(slot, 0) + k
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([(total[k] / n[k]).astype(np.float16).tobytes() for k in total], pa.binary())], names=["slot", "v"])


def train(nodes: DataFrame, counts, n: int) -> np.ndarray:
    """What skip-gram training on random walks over the graph of all ``n`` nodes moves the vectors in each slot."""
    shards = max(1, math.ceil(n / SHARD))
    x = nodes.mapInArrow(_sharded(counts), "shard long, nodes string").withColumn("shard", F.pmod("shard", F.lit(shards)))
    x = x.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("nodes"))
    part = x.mapInArrow(_train_shards, "slot long, n int, v binary")
    mean = part.repartition(max(1, min(shards, 256)), "slot").mapInArrow(_mean_of_slots, "slot long, v binary")
    out = np.zeros((SLOTS, DIM), np.float32)
    for r in mean.toLocalIterator():  # SLOTS rows at most
        out[r["slot"]] = np.frombuffer(r["v"], np.float16)
    return out


class Embedder:
    """Vectors of records from those of their tokens."""

    def __init__(self, trained: np.ndarray, counts: np.ndarray, records: int):
        self.trained, self.counts, self.records = trained, counts, max(1, records)
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, DIM), np.float32)

    def __getstate__(self) -> dict:
        return {"trained": self.trained, "counts": self.counts, "records": self.records, "memo": {}, "rows": np.zeros((0, DIM), np.float32)}

    def _learn(self, words: list[str]) -> None:
        """Rows for words not met so far: the vector of their spelling, moved by what was learnt, weighted by how rare the word is."""
        if len(self.memo) > 200_000:
            self.memo, self.rows = {}, np.zeros((0, DIM), np.float32)
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if not new:
            return
        slots = _count_slots(new)
        weight = np.maximum(0.1, np.log((self.records + 1) / (self.counts[slots] + 0.5))) ** 0.75
        made = (_unit(spelling(new) + self.trained[slots_of(new)]) * weight[:, None]).astype(np.float32)
        start = len(self.rows)
        self.rows = np.concatenate([self.rows, made])
        self.memo.update((w, start + i) for i, w in enumerate(new))

    def views(self, b: pa.RecordBatch) -> list[np.ndarray]:
        """[title vectors, attribute vectors] of the rows, unit vectors each; zero for a row without tokens."""
        words, views = _nodes(b)
        self._learn(words)
        if any(w not in self.memo for w in words):
            self._learn(words)
        place = np.fromiter((self.memo[w] for w in words), np.int64, len(words))
        made = []
        for code, rows in views:
            n = np.bincount(rows, minlength=b.num_rows)
            first, some = np.cumsum(n) - n, np.flatnonzero(n)
            out = np.zeros((b.num_rows, DIM), np.float32)
            for s in range(0, len(some), 2000):  # so many rows at once bound the memory
                k = some[s : s + 2000]
                low, high = first[k[0]], first[k[-1]] + n[k[-1]]
                out[k] = np.add.reduceat(self.rows[place[code[low:high]]], first[k] - low, axis=0)
            made.append(out / np.maximum(1e-6, np.linalg.norm(out, axis=1, keepdims=True)))
        return made


# ---------------------------------------------------------------- exact comparison

_ROMAN = {"i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"}
#: British and American spellings, in the order they are applied to run-together titles.
_SPELLINGS = (("ae", "e"), ("oe", "e"), ("our", "or"), ("isation", "ization"), ("ise", "ize"), ("yse", "yze"), ("centre", "center"), ("ll", "l"))


def run_together(words: list[str]) -> str:
    s = "".join(words)
    for a, b in _SPELLINGS:
        s = s.replace(a, b)
    return s


# Words that carry nothing for the comparison of titles, and words that make another work of the same title.
_LIGHT = {"a", "an", "the", "of", "and", "in", "for", "to", "on", "with", "from", "versus", "vs"}
_OTHER_WORK = _ROMAN | {
    "erratum", "corrigendum", "correction", "retraction", "protocol", "update", "updated", "part", "men", "women", "sexes", "both", "boys", "girls", "year", "years",
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "follow", "followup", "extension", "reply", "comment", "commentary", "response", "letter", "interim", "final", "phase",
    "male", "female", "males", "females", "children", "adults", "companion", "substudy", "rationale", "design",
}


def _pair_off(x: list[str], y: list[str], cut: bool) -> tuple[list[str], list[str], int]:
    """What is left of two word lists once equal, short, split, cut and misspelt words are paired, and the edits it took."""
    x, y, cost = list(x), list(y), 0
    for w in list(x):
        if w in y:
            x.remove(w), y.remove(w)
    if min(len(x), len(y)) > 5:
        return x, y, cost  # more than slips and short forms can explain
    for left, right in ((x, y), (y, x)):
        for w in list(left):
            if 2 <= len(w) <= 5:
                for i in range(len(right) - len(w) + 1):
                    if "".join(v[0] for v in right[i : i + len(w)]) == w:
                        left.remove(w)
                        del right[i : i + len(w)]
                        break
    for left, right in ((x, y), (y, x)):
        for w in list(left):
            for i in range(len(right) - 1):
                if abs(len(w) - len(right[i]) - len(right[i + 1])) < 2 and distance(w, right[i] + right[i + 1], 1) < 2:
                    left.remove(w)
                    del right[i : i + 2]
                    break
    for w in list(x):
        near = [(distance(w, v, 2), v) for v in y if min(len(w), len(v)) >= 4 and abs(len(w) - len(v)) <= 2 and len(set(w) ^ set(v)) <= 4 and not (w + v).isdigit()]
        near = [(d, v) for d, v in near if d <= (2 if min(len(w), len(v)) >= 8 else 1)]
        if near:
            d, v = min(near)
            x.remove(w), y.remove(v)
            cost += d
        elif cut and any(v.startswith(w) for v in y):
            x.remove(w)
            y.remove(next(v for v in y if v.startswith(w)))
    return x, y, cost


def titles_agree(t1: str, t2: str) -> float:
    """1 for equal titles, 0.7 to 1 for slips and reordering, 0.5 if one lacks a part, 0 for different titles."""
    lost = t1.count("�") + t2.count("�")
    cut1, cut2 = "…" in t1, "…" in t2
    w1, w2 = t1.rstrip(" …�").split(), t2.rstrip(" …�").split()
    a, b = run_together(w1), run_together(w2)
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b, w1, w2, cut1, cut2 = b, a, w2, w1, cut2, cut1
    few = min(len(w1), len(w2))
    if few >= 5 and not lost and len(set(w1) & set(w2)) < 0.4 * few:
        return 0.0  # slips, cuts and reordering leave more words than that
    if sorted(w for w in w1 if w in _OTHER_WORK) == sorted(w for w in w2 if w in _OTHER_WORK) and re.sub(r"\D", "", a) == re.sub(r"\D", "", b):
        most = (1 if len(a) < 20 else 3) + min(lost, 12)
        d = distance(a, b, most)
        if d <= most:
            return max(0.7, 1.0 - 0.1 * max(0, d - lost))
    if len(a) >= 25 and len(b) - len(a) > 3:
        # cut off, perhaps within a word; what follows must not make another work of it
        rest = w2[len(w1) :] if w2[: len(w1) - 1] == w1[:-1] else w2[max(0, len(w1) - 1) :]
        if min(distance(a, b[: len(a) + d], 3) for d in (-1, 0, 1)) <= 2 + lost and not any(w in _OTHER_WORK or w.isdigit() for w in rest):
            return 0.5
    s1, s2 = ([run_together([w]) for w in ws if w not in _LIGHT] for ws in (w1, w2))
    if min(len(s1), len(s2)) < 3:
        return 0.0
    x, y, cost = _pair_off(s1, s2, True)
    if x and y or cost > 3 + lost:
        return 0.0
    more = x or y
    if not more:
        return 0.9 - 0.05 * min(cost, 4)
    if any(w in _OTHER_WORK or w[0].isdigit() for w in more) or more == ["results"] or len(more) > 0.7 * max(len(s1), len(s2)):
        return 0.0
    return 0.5


def _surnames_agree(s: str, s2: str) -> bool:
    # one edit leaves the first or the last letter
    if s == s2 or len(s) > 4 and (s[0] == s2[0] or s[-1] == s2[-1]) and edits(s, s2) < 2:
        return True
    if len(s) > 8 and abs(len(s) - len(s2)) <= 2 and len(set(s) ^ set(s2)) <= 4 and distance(s, s2, 2) < 3:
        return True
    return min(len(s), len(s2)) > 5 and (s.endswith(s2) or s2.endswith(s))


def authors_agree(a1: str, a2: str) -> float | None:
    """The share of the shorter list that the other one has, None if either is missing."""
    x, y = [p.split("/") for p in a1.split()], [p.split("/") for p in a2.split()]
    if not x or not y:
        return None
    if len(x) > len(y):
        x, y = y, x
    left, hits = list(y), 0
    for s, g in x:
        for k, (s2, g2) in enumerate(left):
            if (not g or not g2 or g == g2 or s == s2) and _surnames_agree(s, s2):
                hits += 1 if not g or not g2 or g == g2 else 0.5
                del left[k]
                break
    return hits / len(x)


def journals_agree(j1: str, j2: str) -> bool | None:
    if not j1 or not j2:
        return None
    if j1 == j2:
        return True
    x, y = j1.split(), j2.split()
    if sorted(x) == sorted(y) or edits("".join(x), "".join(y)) < 2:
        return True
    if len(x) > len(y):
        x, y = y, x
    left = list(y)
    for w in sorted(x, key=len, reverse=True):
        for k, v in enumerate(left):
            if v == w or v.startswith(w) or w.startswith(v) or (len(w) > 4 and edits(w, v) < 2):
                del left[k]
                break
        else:
            return False
    return len(left) <= len(y) - len(x) and len(y) - len(x) <= 1


def contradicted(p: dict, q: dict) -> bool:
    """Whether identifiers or kind of two feature rows rule out one work, whatever their texts."""
    same = lambda k: None if not p[k] or not q[k] else p[k] == q[k]
    if any(same(k) is False for k in ("doi", "pmid", "pmcid")):
        return True
    cats = {p["cat"], q["cat"]}
    return bool(len(cats) > 1 and cats & {"conference", "correction"} and not (cats & {"other", "generic"} and same("vol") and same("page")))


SCORES = ("title", "unread", "authors", "journal", "year", "vol", "page", "iss", "places", "other", "other_alike", "short", "strangers", "elsewhere")


class Bound:
    """The most that scores which are not yet known can add, by the weights of the calibration (constant first)."""

    def __init__(self, w: np.ndarray):
        self.w = {c: float(x) for c, x in zip(("", "cos_title", "cos_rest", *SCORES), w)}
        up = lambda *names: max(0.0, *(self.w[c] for c in names))
        self.known = [self.w[c] for c in ("year", "vol", "page", "iss", "places")]
        self.free = self.w[""] + 1e-4 + abs(self.w["cos_title"]) + abs(self.w["cos_rest"])
        self.people = abs(self.w["authors"]) + abs(self.w["journal"]) + up("strangers") + up("elsewhere")
        # titles that agree in nothing, or in something; with words of another work or without
        self.titles = [max(self.w["unread"] + o * self.w["other"], up("title") + o * max(self.w["other"], self.w["other_alike"])) for o in (0, 1)]
        self.words = max(self.titles) + up("short")


def compare(p: dict, q: dict, bound: Bound | None = None, least: float = -math.inf) -> list[float] | None:
    """``SCORES`` of two feature rows: 1 for agreement, -1 for difference, 0 where one has nothing to compare.

    None if by ``bound`` nothing that is still to be compared can bring the sum of the weighted scores to ``least``.
    """
    vol, page, iss = (0.0 if not p[k] or not q[k] else 1.0 if p[k] == q[k] else -1.0 for k in ("vol", "page", "iss"))
    year = 0.0 if not p["year"] or not q["year"] else (1.0, 0.5, -0.5, -1.0)[min(3, abs(p["year"] - q["year"]))]
    places = vol * page if vol > 0 else 0.0
    most = 0.0
    if bound:
        most = bound.free + sum(k * x for k, x in zip(bound.known, (year, vol, page, iss, places)))
        if most + bound.people + bound.words < least:
            return None
    a, j = authors_agree(p["a"], q["a"]), journals_agree(p["j"], q["j"])
    authors, journal = 0.0 if a is None else 2 * a - 1, 0.0 if j is None else 1.0 if j else -1.0
    # other authors, or another journal without authors to tell, where volume and page don't both agree
    held = vol > 0 and page > 0
    strangers, elsewhere = float(not held and a is not None and a < 0.34), float(not held and j is False and (a is None or a < 0.5))
    if bound:
        most += bound.w["authors"] * authors + bound.w["journal"] * journal + bound.w["strangers"] * strangers + bound.w["elsewhere"] * elsewhere
        if most + bound.words < least:
            return None
    w1, w2 = (set(x["t"].rstrip(" …�").split()) for x in (p, q))
    other = float(any(w in _OTHER_WORK or w[0].isdigit() for w in w1 ^ w2))
    short = float(min(len(p["t"]), len(q["t"])) < 30 and min(len(w1), len(w2)) <= 3 and p["t"].isascii() and q["t"].isascii())
    if bound and most + bound.titles[int(other)] + bound.w["short"] * short < least:
        return None
    t = titles_agree(p["t"], q["t"])
    return [t, float(t == 0), authors, journal, year, vol, page, iss, places, other * (t < 0.6), other * (t >= 0.6), short, strangers, elsewhere]


# ---------------------------------------------------------------- blocks

#: Keys have ``KEY_BITS`` bits; where that leaves more than so many records to a key on average, they get longer.
MEAN_BLOCK = 16_384


def grouped(bits: int) -> dict[str, tuple[int, int]]:
    """(groups, tables a group) of each view for keys of ``bits`` bits.

    The tables of a group have ``TABLE_BITS`` bits in common, by which rows are shuffled once for all of them; the chance that
    a pair whose bits agree with ``AGREE`` is missed by all is at most that of ``TABLES`` at ``TABLE_BITS``.
    """
    if bits <= TABLE_BITS:
        return {v: (n, 1) for v, n in TABLES.items()}
    out, met = {}, AGREE**TABLE_BITS
    for v, n in TABLES.items():
        need = (1 - (1 - met) ** (n / (n + 1))) / met
        out[v] = n + 1, math.ceil(math.log1p(-need) / math.log1p(-(AGREE ** (bits - TABLE_BITS))))
    return out


def tables(bits: int) -> dict[str, int]:
    """The number of tables of each view for keys of ``bits`` bits."""
    return {v: g * m for v, (g, m) in grouped(bits).items()}


_PLANES = {v: x for v, x in zip(TABLES, np.random.default_rng(11).standard_normal((2, DIM, 64)).astype(np.float32))}


@lru_cache(32)
def layout(bits: int) -> list[tuple[int, np.ndarray, int, list[np.ndarray]]]:
    """(view, bits that its tables share, first table, the other bits of each table) of each group, those of the title first."""
    rng, out, first = np.random.default_rng(bits), [], 0
    for view, (groups, m) in enumerate(grouped(bits).values()):
        for _ in range(groups):
            places = rng.permutation(64)
            shared, rest = places[: min(bits, TABLE_BITS)], places[min(bits, TABLE_BITS) :]
            out.append((view, shared, first, [rng.permutation(rest)[: bits - len(shared)] for _ in range(m)]))
            first += m
    return out


def _mask(places: np.ndarray) -> np.uint64:
    return np.bitwise_or.reduce(np.uint64(1) << places.astype(np.uint64))


@lru_cache(32)
def masks(bits: int) -> np.ndarray:
    """The bits of the code that each table looks at, those of the title's tables first."""
    return np.array([_mask(np.r_[shared, own]) for _, shared, _, tables_ in layout(bits) for own in tables_], np.uint64)


def _taken(code: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits of ``code`` in ``places`` as a number."""
    out = np.zeros(len(code), np.int64)
    for p in places:
        out = out << 1 | (code >> np.uint64(p) & np.uint64(1)).astype(np.int64)
    return out


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def codes(title: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The title codes and attribute codes of the rows' vectors: 64 hyperplanes a view."""
    return tuple(_pack(x @ _PLANES[v] > 0) for v, x in (("title", title), ("rest", rest)))  # type: ignore[return-value]


def block_rows(title: np.ndarray, rest: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of every table, title code, attribute code) of the rows' vectors: 64 hyperplanes a view, of which each table takes some."""
    c0, c1 = codes(title, rest)
    m, t = masks(bits), tables(bits)["title"]
    part = np.concatenate([c0[:, None] & m[None, :t], c1[:, None] & m[None, t:]], 1)
    part ^= part >> np.uint64(29)
    part *= np.uint64(0x9E3779B97F4A7C15)
    part ^= part >> np.uint64(32)
    return part << np.uint64(13) | np.arange(len(m), dtype=np.uint64), c0, c1


def first_met(x0: np.ndarray, x1: np.ndarray, table: int, bits: int) -> np.ndarray:
    """Whether pairs whose codes differ in x0 and x1 meet in no table before this one."""
    out = np.ones(len(x0), bool)
    t = tables(bits)["title"]
    for k, m in enumerate(masks(bits)[:table]):
        out &= ((x0 if k < t else x1) & m) != 0
    return out


def facts(src: np.ndarray, year: np.ndarray, vol: list, page: list, doi: list) -> np.ndarray:
    """Source, year, volume, page and DOI in 64 bits: equal values give equal bits; 0 stands for a missing one."""
    h = lambda xs, m: np.fromiter((0 if not x else 1 + xxhash.xxh32_intdigest(x) % (m - 1) for x in xs), np.uint64, len(xs))
    y = np.where(year > 0, np.clip(year - 1849, 1, 255), 0).astype(np.uint64)
    out = src.astype(np.uint64) << np.uint64(44) | y << np.uint64(36) | h(vol, 1 << 10) << np.uint64(26)
    return out | h(page, 1 << 12) << np.uint64(14) | h(doi, 1 << 14)


def _field(x: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (x >> np.uint64(shift)) & np.uint64((1 << width) - 1)


#: One of so many records is compared with all others in its blocks whatever their facts say, for the calibration.
DRAWN = 211
#: Where so many records would be more than this number, fewer are drawn: the calibration takes no more pairs from more records.
MOST_DRAWN = 1000


def _spread(first: np.ndarray, count: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, first[k] + 0 ... count[k] - 1) of all k, in steps."""
    count = np.maximum(count, 0)
    total, s = np.cumsum(count), 0
    while s < len(count):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + most, "right")))
        n = count[s:e]
        k = np.repeat(np.arange(s, e), n)
        if len(k):
            yield k, np.arange(len(k)) + np.repeat(first[s:e] - np.cumsum(n) + n, n)
        s = e


def _years_near(base: np.ndarray, year: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest key ``base << 8 | year`` of rows whose year, if there is one, is no more than two away."""
    return base << 8 | np.where(year > 0, np.maximum(1, year - 2), 0), base << 8 | np.where(year > 0, np.minimum(255, year + 2), 255)


def _within(rows: np.ndarray, base: np.ndarray, year: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``rows`` with equal ``base`` and near or missing years."""
    key = base[rows] << 8 | year[rows]
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    after = np.arange(1, len(rows) + 1)
    for a, b in _spread(after, np.searchsorted(key, _years_near(base[rows], year[rows])[1], "right") - after):
        yield rows[a], rows[b]


def _across(x: np.ndarray, y: np.ndarray, base: np.ndarray, year: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows ``x`` and ``y`` with equal ``base`` and, if given, near or missing years."""
    if not len(x) or not len(y):
        return
    time = np.zeros(len(base), np.int64) if year is None else year
    key = base[y] << 8 | time[y]
    order = np.argsort(key, kind="stable")
    y, key = y[order], key[order]
    low, high = _years_near(base[x], time[x])
    dated = np.flatnonzero(time[x] > 0)
    for of, a, b in ((np.arange(len(x)), low, high), (dated, base[x[dated]] << 8, base[x[dated]] << 8)):
        start = np.searchsorted(key, a, "left")
        for k, at in _spread(start, np.searchsorted(key, b, "right") - start):
            yield x[of[k]], y[at]


def near_pairs(ids: np.ndarray, c0: np.ndarray, c1: np.ndarray, f: np.ndarray, met: list[np.ndarray], part: np.ndarray | None = None, drawn_of: int = DRAWN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, kind) of all pairs i < j that have one of the keys ``met`` in common, are from different sources and have enough equal
    bits and no contradiction in their facts; with ``part`` only pairs across two parts count.

    Kind 2 marks the pairs of drawn records that are kept for the calibration although their DOIs differ.  Only pairs that can pass
    are made: facts leave pairs of one volume, of one page, and those of which one has no volume and one no page.
    """
    n = len(ids)
    src, year, vol, page, doi = (_field(f, s, w).astype(np.int64) for s, w in ((44, 20), (36, 8), (26, 10), (14, 12), (0, 14)))
    drawn = (doi > 0) & ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(drawn_of) == 0)
    rows = lambda x: np.flatnonzero(x)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for key in met:
            yield from _within(rows(vol > 0), key << 10 | vol, year)
            yield from _within(rows(page > 0), key << 12 | page, year)
            yield from _across(rows((vol == 0) & (page == 0)), np.arange(n), key, year)
            yield from _across(rows((vol == 0) & (page > 0)), rows((vol > 0) & (page == 0)), key, year)
            yield from _across(rows(drawn), rows(doi > 0), key, None)

    got = []
    for a, b in pairs():
        ok = np.bitwise_count(c0[a] ^ c0[b]) + np.bitwise_count(c1[a] ^ c1[b]) <= NEAR_SUM
        ok &= ((src[a] != src[b]) | (src[a] == 0)) & (a != b)
        if part is not None:
            ok &= part[a] != part[b]
        a, b = a[ok], b[ok]
        both = lambda x: (x[a] != 0) & (x[b] != 0)
        differ = lambda x: both(x) & (x[a] != x[b])
        same = lambda x: both(x) & (x[a] == x[b])
        bad = both(year) & (np.abs(year[a] - year[b]) > 2) | differ(vol) & ~same(page) | differ(page) & ~same(vol)
        other = differ(doi)
        sampled = other & (drawn[a] | drawn[b])
        keep = ~bad & ~other | sampled
        got.append(np.stack([np.minimum(a, b) * n + np.maximum(a, b), np.where(sampled, 2, 0)])[:, keep])
    if not got:
        return (np.zeros(0, np.int64),) * 3
    pair, kind = np.concatenate(got, 1)
    pair, at = np.unique(pair, return_index=True)
    return pair // n, pair % n, kind[at]


_PAIR = "i long, j long, kind int"
_DEALT = "key long, x int, y int, rows binary"


def _cells(ids: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """(part of each row, (x, y, whether in it) of each cell): in cell x, y are the rows of both parts."""
    part = ((ids.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64) % parts
    return part, [(x, y, (part == x) | (part == y)) for x in range(parts) for y in range(x, parts)]


def _group_keys(b: pa.RecordBatch, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, rows of the batch that have it) of each group of tables; without attributes the second view has no direction."""
    code = [b.column(c).to_numpy().view(np.uint64) for c in ("c0", "c1")]
    some = np.flatnonzero(b.column("told").to_numpy(zero_copy_only=False))
    for g, (view, shared, _, _) in enumerate(layout(bits)):
        rows = some if view else np.arange(b.num_rows)
        yield g << TABLE_BITS | _taken(code[view][rows], shared), rows


def _count_keys(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(layout(bits)) << TABLE_BITS, np.int64)
        for b in batches:
            for key, _ in _group_keys(b, bits):
                total += np.bincount(key, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["key", "n"])

    return run


def _deal(bits: int, parts: dict[int, int]):
    """The rows of each key packed together, byte by byte, so that they shrink; those of a key in ``parts`` go to its cells."""

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        table = np.stack([b.column(c).to_numpy().view(np.uint64) for c in ("id", "c0", "c1", "facts")], 1)
        out: list[tuple[int, int, int, bytes]] = []
        put = lambda k, x, y, rows: out.append((k, x, y, table[rows].view(np.uint8).T.tobytes()))
        for key, rows in _group_keys(b, bits):
            order = np.argsort(key, kind="stable")
            key, rows = key[order], rows[order]
            at = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)] if len(key) else np.zeros(1, np.int64)
            for s, e in zip(at[:-1], at[1:]):
                k = int(key[s])
                if k not in parts:
                    put(k, 0, 0, rows[s:e])
                    continue
                for x, y, within in _cells(table[rows[s:e], 0], parts[k])[1]:
                    if within.any():
                        put(k, x, y, rows[s:e][within])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["key", "x", "y", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) >= 50_000:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def _compare_blocks(bits: int, parts: dict[int, int], drawn_of: int):
    """Near pairs of each block, each in the first group of tables where it meets."""

    def compared(k: int, x: int, y: int, blobs: list[bytes]) -> pa.RecordBatch | None:
        t = np.concatenate([np.frombuffer(v, np.uint8).reshape(32, -1).T for v in blobs])
        if len(t) < 2:
            return None
        ids, c0, c1, f = np.ascontiguousarray(t).view(np.uint64).T.copy()
        view, _, first, own = layout(bits)[k >> TABLE_BITS]
        part = _cells(ids, parts[k])[0] if x != y else None
        i, j, kind = near_pairs(ids.view(np.int64), c0, c1, f, [_taken((c0, c1)[view], places) for places in own], part, drawn_of)
        new = first_met(c0[i] ^ c0[j], c1[i] ^ c1[j], first, bits)
        left, right = (ids[z[new]].view(np.int64) for z in (i, j))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(kind[new].astype(np.int32))], names=["i", "j", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for *at, v in zip(*(c.to_pylist() for c in b.columns)):
                if at != now:
                    if held and (out := compared(*now, held)):
                        yield out
                    now, held = at, []
                held.append(v)
        if held and (out := compared(*now, held)):
            yield out

    return run


def _count_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNT_SLOTS, np.int64)
    for b in batches:
        words, views = _nodes(b)
        np.add.at(total, _count_slots(words), np.bincount(_different(len(words), views)[0], minlength=len(words)))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])


def _encode(shared):
    """(id, c0, c1, facts, told) of every node; told is whether it has attributes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder, centers = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            c0, c1 = codes(*(v - center for v, center in zip(embedder.views(b), centers)))
            year = pc.fill_null(b.column("year"), 0).to_numpy()
            f = facts(b.column("source").to_numpy(), year, *(b.column(c).to_pylist() for c in ("vol", "page", "doi")))
            told = pc.or_(*(pc.not_equal(pc.fill_null(b.column(c), ""), "") for c in ("a", "j")))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x.view(np.int64)) for x in (c0, c1, f)), told], names=["id", "c0", "c1", "facts", "told"])

    return run


def _sum_views(shared):
    """The sums of both views over the records of a task, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * DIM + 1)
        for b in batches:
            t, r = shared.value.views(b)
            total[:DIM] += t.sum(0)
            total[DIM:-1] += r.sum(0)
            total[-1] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    return run


_CODED = "id long, c0 long, c1 long, facts long, told boolean"


_CALIBRATED = ["cos_title", "cos_rest", *SCORES]
_HALF = [x.split()[0] for x in FEATURES.split(", ")]


def _score(shared, w: np.ndarray | None = None, accept: float = 0.0):
    """The scores of pairs with their label; with the weights ``w``, the pairs of ``accept`` or more with their confidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder, _ = shared.value
        bound, least = (None, -math.inf) if w is None else (Bound(w), math.log(accept / (1 - accept)) if 0 < accept < 1 else math.inf if accept >= 1 else -math.inf)
        for b in batches:
            left, right = ([dict(zip(_HALF, r)) for r in zip(*(b.column(s + c).to_pylist() for c in _HALF))] for s in ("l_", "r_"))
            kept, scores = [], []
            for k, (p, q) in enumerate(zip(left, right)):
                x = compare(p, q, bound, least)
                if x is None or bound and x[0] == 0 and x[5] <= 0 and x[6] <= 0:
                    continue  # too little in common, or other titles and no common volume or page
                kept.append(k)
                scores.append(x)
            if not kept:
                continue
            rows = b.take(pa.array(kept))
            # a node is in many pairs; its vectors are made once
            ids = [rows.column(s + "id").to_numpy() for s in ("l_", "r_")]
            seen, first, at = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
            both = [pa.concat_arrays([rows.column(s + c) for s in ("l_", "r_")]).take(pa.array(first)) for c in ("t", "a", "j", "year", "vol", "page")]
            title, rest = embedder.views(pa.RecordBatch.from_arrays(both, names=["t", "a", "j", "year", "vol", "page"]))
            i, j = at[: len(kept)], at[len(kept) :]
            table = np.column_stack([(title[i] * title[j]).sum(1), (rest[i] * rest[j]).sum(1), np.array(scores)])
            if w is None:
                yield pa.RecordBatch.from_arrays([rows.column("label"), *(pa.array(x.copy()) for x in table.T)], names=["label", *_CALIBRATED])
                continue
            p = 1 / (1 + np.exp(-(w[0] + table @ w[1:])))
            good = p >= accept
            yield pa.RecordBatch.from_arrays([pa.array(ids[0][good]), pa.array(ids[1][good]), pa.array(p[good])], names=["i", "j", "confidence"])

    return run


_LABELLED = "label int, " + ", ".join(f"{c} double" for c in _CALIBRATED)
#: The weights (constant first) that the calibration begins from and is pulled to where labelled pairs are few.
PRIOR = np.array([-1.5, 0.6, 0.3, 0.8, -2.4, 1.5, 1.2, 1.1, 2.5, 1.0, 1.0, 0.5, -2.0, -2.0, -2.0, -4.0, -3.0])


def calibrate(rows: list[tuple], rounds: int = 30) -> np.ndarray:
    """Weights (constant first) of a logistic curve fitted to (label, scores...) rows, with a mild pull to ``PRIOR``."""
    if not rows:
        return PRIOR
    y = np.array([r[0] for r in rows], float)
    x = np.array([(1.0, *r[1:]) for r in rows])
    w = PRIOR.copy()
    # what is minimized; whole steps can run away where one label is rare
    loss = lambda w: (np.logaddexp(0, x @ w) - y * (x @ w)).sum() + ((w - PRIOR) ** 2).sum() / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - (w - PRIOR)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(len(w))
        step, now = np.linalg.solve(h, g), loss(w)
        while np.abs(step).max() > 1e-12 and loss(w + step) > now + 1e-9:
            step = step / 2
        w = w + step
    return w


def _numbered_sources(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``nodes`` with ``source``, a number from 1 of their source in ``names``; 0 for all if there are too many for the bits of
    ``facts``, which leaves the comparison of sources to the exact step."""
    numbers = settle(numbered_rows(names.distinct(), [F.col("src")], "source").select("src", "source"), "sources")
    many = numbers.count() >= 1 << 20
    return nodes.join(numbers, "src").withColumn("source", F.lit(0).cast("long") if many else F.col("source").cast("long"))


def _weights(pairs: DataFrame, nodes: DataFrame, n: int, shared) -> np.ndarray:
    """The weights of the calibration, from the first ``CALIBRATION_PAIRS`` pairs by hash that identifiers decide."""
    cut = lambda of: F.pmod(F.xxhash64("i", "j"), F.lit(1 << 20)) < int(min(1.0, 2.0 * CALIBRATION_PAIRS / max(1, of)) * (1 << 20))
    apart = pairs.filter("kind = 2").count()
    some = settle(pairs.filter((F.col("kind") == 2) & cut(apart) | (F.col("kind") == 0) & cut(n)), "labelled")
    ids = some.select(F.col("i").alias("id")).union(some.select("j")).distinct()
    both, linked, clash, _ = _joined(some, nodes.join(F.broadcast(ids), "id", "left_semi"))
    other = (F.coalesce("l_cat", F.lit("")) != F.coalesce("r_cat", F.lit(""))) & (F.coalesce("l_cat", F.lit("")).isin("conference", "correction") | F.coalesce("r_cat", F.lit("")).isin("conference", "correction"))
    # two ids of which one says yes and one no decide nothing
    both = both.filter((linked | (F.col("kind") == 2)) & (linked != clash) & ~other & (F.col("l_src") != F.col("r_src"))).withColumn("label", linked.cast("int"))
    both = both.orderBy(F.xxhash64("l_id", "r_id"), "l_id", "r_id").limit(CALIBRATION_PAIRS).repartition(8)
    return calibrate([tuple(x) for x in both.mapInArrow(_score(shared), _LABELLED).collect()])


def _joined(pairs: DataFrame, nodes: DataFrame):
    """(pairs with both feature rows, whether an identifier links them, whether one parts them, whether their kinds do)."""
    l, r = (nodes.select(*[F.col(c).alias(s + c) for c in _HALF]) for s in ("l_", "r_"))
    both = pairs.join(l, F.col("i") == F.col("l_id")).join(r, F.col("j") == F.col("r_id")).drop("i", "j")
    of = lambda f: {c: F.coalesce(f(F.col("l_" + c), F.col("r_" + c)), F.lit(False)) for c in ("doi", "pmid", "pmcid", "vol", "page")}
    equal, clash = of(lambda x, y: x == y), of(lambda x, y: x != y)
    kinds = [F.coalesce("l_cat", F.lit("")), F.coalesce("r_cat", F.lit(""))]
    strict, loose = (kinds[0].isin(*v) | kinds[1].isin(*v) for v in (("conference", "correction"), ("other", "generic")))
    return both, equal["doi"] | equal["pmid"] | equal["pmcid"], clash["doi"] | clash["pmid"] | clash["pmcid"], (kinds[0] != kinds[1]) & strict & ~(loose & equal["vol"] & equal["page"])


def matches(records: DataFrame, big: int = BIG, mean_block: int = MEAN_BLOCK, accept: float = ACCEPT, trained: bool = True) -> DataFrame:
    """(left_record_id, right_record_id, confidence) of records of one work from different sources without a common identifier.

    ``trained=False`` leaves the vectors as their spelling gives them, to show what training adds.
    """
    spark = records.sparkSession
    names = [x.split()[0] for x in FEATURES.split(", ")]
    own = names[1:]
    raw = settle(features(records).withColumn("h", F.unhex(F.substring(F.sha2(F.to_json(F.struct(*own)), 256), 1, 32))), "features")
    # equal records of one source are one node; ids may repeat
    marks = raw.select("h", "id").repartition("h").groupBy("h", "id").count().withColumn("rep", F.min("id").over(Window.partitionBy("h")))
    # few rows are not the only one of their node; the others need no shuffle
    doubled = settle(marks.filter("id <> rep or count > 1"), "doubled")
    single = raw.join(doubled.select("h", "id"), ["h", "id"], "left_anti").select(*names)
    first = raw.join(doubled.filter("id = rep").select("h", "id"), ["h", "id"], "left_semi").dropDuplicates(["h", "id"]).select(*names)
    nodes = settle(_numbered_sources(single.union(first), raw.select("src")), "nodes")
    n = nodes.count()
    empty = spark.createDataFrame([], "left_record_id long, right_record_id long, confidence double")
    if n < 2:
        return empty
    counts = np.zeros(COUNT_SLOTS, np.float32)
    told = nodes.select(*names).mapInArrow(_count_nodes, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts[told["slot"].to_numpy()] = told["n"].to_numpy()
    of_tokens = spark.sparkContext.broadcast(counts)
    moved = train(nodes.select(*names), of_tokens, n) if trained else np.zeros((SLOTS, DIM), np.float32)
    embedder = Embedder(moved, counts, n)
    bits = int(np.clip(round(math.log2(max(2, n / mean_block))), KEY_BITS, 26))
    keyed = nodes.select(*names, "source")
    # a sample by hash tells the centres of the vectors, on which only the evenness of the keys depends
    share = PROBED / n
    probe = keyed if share >= 1 else keyed.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sums = [np.frombuffer(r["v"], np.float64) for r in probe.mapInArrow(_sum_views(spark.sparkContext.broadcast(embedder)), "v binary").collect()]  # one row a task
    middle = np.sum(sums, 0)
    centers = tuple((middle[k * DIM : (k + 1) * DIM] / max(1.0, middle[-1])).astype(np.float32) for k in (0, 1))
    shared = spark.sparkContext.broadcast((embedder, centers))
    coded = settle(keyed.mapInArrow(_encode(shared), _CODED), "codes")
    parts: dict[int, int] = {}
    if n > big:
        sizes = coded.mapInArrow(_count_keys(bits), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > big)
        parts = {r["key"]: -(-r["n"] // big) for r in sizes.collect()}  # keys are at most groups << TABLE_BITS
    tasks = max(1, min(4096, math.ceil(n * len(layout(bits)) / BLOCK_ROWS)))
    dealt = coded.mapInArrow(_deal(bits, parts), _DEALT).repartition(tasks, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    pairs = settle(dealt.mapInArrow(_compare_blocks(bits, parts, max(DRAWN, n // MOST_DRAWN)), _PAIR), "blocks")
    w = _weights(pairs, keyed, n, shared)
    # what ``contradicted`` rules out without looking at texts need not reach Python, nor pairs that an identifier links
    both, linked, clash, ruled_out = _joined(pairs.filter("kind = 0").drop("kind"), keyed)
    both = both.filter(~linked & ~clash & ~ruled_out & (F.col("l_src") != F.col("r_src")))
    out = settle(both.mapInArrow(_score(shared, w, accept), "i long, j long, confidence double"), "scored")
    more = doubled.filter("id <> rep").select(F.col("rep"), F.col("id").alias("member"))
    for c in ("i", "j"):
        out = out.union(out.join(more, F.col(c) == F.col("rep")).select(*[F.col("member").alias(c) if k == c else F.col(k) for k in ("i", "j")], "confidence"))
    out = out.filter("i <> j")
    return out.groupBy(F.least("i", "j").alias("left_record_id"), F.greatest("i", "j").alias("right_record_id")).agg(F.max("confidence").alias("confidence"))
