import random
from itertools import combinations

import pytest
import tiktoken

from citeloom.llm import packing, spans, tokens


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks()


def test_same_ids_as_a_library(spark, ranks):
    rng = random.Random(4)
    ref = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["", "a", "a" * 3000, "ab" * 400, " \n\n\t x", "naïve β-cell 治疗", "<|endoftext|>", "1234567 $$$ don't", "".join(chr(rng.randrange(32, 0x3000)) for _ in range(3000))]
    rows = [(i, t, "x") for i, t in enumerate(odd)] + [(100, None, "x")]
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    assert got == {i: ref.encode_ordinary(t) for i, t, _ in rows if t is not None} | {100: []}
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_emptied_memory(ranks):
    table = tokens.PairTable(ranks)
    e = tokens.Encoder(table)
    first = e(["hello world again"])[1].tolist()
    tokens.KEPT_PIECES, old = 0, tokens.KEPT_PIECES
    assert e(["hello world again", None])[1].tolist() == first
    tokens.KEPT_PIECES = old


def test_packing(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice([0, 1, 7, 300, 900, 2048, 2049, 5000])) for i in range(600)] + [(900, None), (901, 10), (901, 10)]
    df = spark.createDataFrame(sizes, "doc_id long, n long")
    for how in ({}, {"open_bins": 3, "group_items": 100}):
        rows = packing.pack(df, **how).collect()
        used, got = {}, {}
        for r in rows:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
        assert max(used.values()) <= 2048
        want = {i: n for i, n in sizes if n}
        assert got == want | {901: 20}
        split = {r["doc_id"] for r in rows if r["piece"]}
        assert split == {i for i, n in want.items() if n > 2048}
    assert packing.pack(df.limit(0)).count() == 0
    f = packing.fill_report(packing.pack(df)).first()
    pieces = sorted((min(2048, n - s) for _, n in sizes if n for s in range(0, n, 2048)), reverse=True)
    free: list[int] = []  # best fit in decreasing order, all bins open
    for x in pieces:
        fit = min((i for i, v in enumerate(free) if v >= x), key=lambda i: free[i], default=None)
        if fit is None:
            free.append(2048 - x)
        else:
            free[fit] -= x
    assert f["containers"] <= 1.02 * len(free) + 1 and f["tokens"] == sum(pieces)


def test_fullest_closes_first():
    p = packing.Packer(10, 2)
    assert [p.put(4), p.put(7), p.put(8)] == [0, 1, 2]  # the bin with 7 closes when the third opens
    assert p.put(3) == 0 and p.put(3) == 0 and p.put(2) == 2


def brute(rows, k):
    where, pairs, shared = {}, set(), {}
    for i, t in rows:
        for j in range(len(t or "") - k + 1):
            where.setdefault(t[j : j + k], set()).add(i)
    for s in where.values():
        pairs |= set(combinations(sorted(s), 2))
    for i, t in rows:
        if t is not None and len(t) >= k:
            cover = set()
            for j in range(len(t) - k + 1):
                if len(where[t[j : j + k]]) > 1:
                    cover |= set(range(j, j + k))
            shared[i] = len(cover)
    return pairs, shared


@pytest.mark.parametrize("how", [{}, {"hot": 2}, {"small": 2}])
def test_spans_like_brute_force(spark, how):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdé𝒳 ") for _ in range(n))
    common = [word(25), word(60), "-" * 70]
    rows = [(i, word(rng.randrange(0, 80)) + rng.choice(["", *common]) + word(rng.randrange(0, 30)) + rng.choice(["", *common])) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, common[1]), (105, common[2] + common[2])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rep int").repartition(3)
    pairs, shared = brute(rows, 20)
    got = [tuple(r) for r in spans.sharing_pairs(df, length=20, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_part(df, length=20, **how).collect()} == shared


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.sharing_pairs(df).count() == 0 and spans.shared_part(df).count() == 0
