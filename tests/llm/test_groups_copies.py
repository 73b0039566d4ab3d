import random
from collections import defaultdict

from citeloom.llm import copies, groups
from tests.test_linkage import roots_of

PAIRS = "left_record_id long, right_record_id long, pair_key string, status string, path string"


def test_components_like_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges[:30]], "a long, b long")
    n = {x for e in edges for x in e if e[0] != e[1]}
    want = roots_of(n, [e for e in edges if e[0] != e[1]])
    for how in ({}, {"cell_edges": 10, "least_side": 3}):
        got = {r["v"]: r["root"] for r in groups.components(df.filter("a <> b"), **how).collect()}
        assert got == want


def test_pairs(spark):
    rows = [(1, 2, "1:2", "auto_merged", "x"), (2, 1, None, "merged_by_review", None), (None, 3, " 0002 : 0003", "auto_merged", None), (4, None, "4:9", "auto_merged", None), (None, None, "9:10", "merged_by_review", None), (5, 5, "5:5", "auto_merged", None), (6, 7, "6:7", "pending", None), (8, 8, None, None, None)]
    got = {r["record_id"]: r["group_id"] for r in groups.grouped(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 9: 4, 10: 4}
    assert groups.grouped(spark.createDataFrame([], PAIRS)).count() == 0


def test_copies(spark):
    rng = random.Random(2)
    titles = ["A title: x", "a TITLE x", "Other", "ß straße", "SS STRASSE", "", None, "b" * 5000, "B" * 5000 + "."]
    dois = ["10.1000/AB", "https://doi.org/10.1000/ab.", "doi: 10.1000/ab", "10.2000/c [doi]", "n/a", "", None, "10.1000 / ab"]
    rows = [(i, rng.choice(dois), rng.choice(titles), "k") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, doi string, title string, k string").repartition(5)

    def key(d, t):
        if not d or "10." not in d or not t:
            return None
        d = d.lower().replace(" ", "").replace("[doi]", "")
        return d[d.index("10.") :].rstrip("."), "".join(c for c in t.lower().upper() if c.isalnum())

    by = defaultdict(list)
    for i, d, t, _ in rows:
        if key(d, t) and key(d, t)[1]:
            by[key(d, t)].append(i)
    want = {i: min(v) for v in by.values() if len(v) > 1 for i in v}
    old = copies.PIECE
    for piece in (old, 7):
        copies.PIECE = piece
        got = [(r["record_id"], r["group_id"]) for r in copies.collapse(df).collect()]
        assert len(got) == len(want) and dict(got) == want
    copies.PIECE = old
    assert {r["record_id"]: r["copies"] for r in copies.representatives(df).collect()} == {min(v): len(v) for v in by.values()}
    assert copies.collapse(df.limit(0)).count() == 0


def test_tallies_across_batches():
    import pyarrow as pa

    rng = random.Random(9)
    for _ in range(40):
        keys = sorted(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30)))
        cuts = sorted(rng.randrange(0, len(keys) + 1) for _ in range(3))
        parts = [list(range(len(keys)))[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        batches = [pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array([keys[i] for i in p], pa.string())], names=["id", "k"]) for p in parts]
        rows = [r for b in copies._tally(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        want = [(keys.index(k), keys.count(k)) for k in dict.fromkeys(keys)]
        assert [r[1:] for r in rows] == want
        assert [i for i, r in enumerate(rows) if r[0] is not None] == sorted({0, len(rows) - 1} if rows else set())
