import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import golden, linkage, review, sampling, state
from citeloom.operators.graph import connected_components


def roots_of(n, edges):
    p = {i: i for i in n}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 40)] + [(rng.randrange(50, 120), rng.randrange(50, 120)) for _ in range(60)] + [(7, 7)]
    n = range(1, 130)
    got = connected_components(spark.createDataFrame([(i,) for i in n], "id long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["root"] for r in got.collect()} == roots_of(n, edges)
    assert connected_components(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "src long, dst long")).collect()[0]["root"] == 1


def test_star_edges_connect_like_pairs(spark):
    rng = random.Random(4)
    cats = ["journal", "conference", "other", "correction", "chapter", "generic", None]
    recs = [(i, rng.choice(cats), f"10.1/{rng.randrange(25)}" if rng.random() < 0.8 else "", "", None) for i in range(1, 120)]
    df = spark.createDataFrame(recs, "id long, record_type_category string, doi string, pmid string, pmcid string")
    pairs = []
    for a in recs:
        for b in recs:
            ca, cb = a[1] or "other", b[1] or "other"
            if a[0] < b[0] and a[2] and a[2] == b[2] and not {ca, cb} & {"correction", "chapter"} and {ca, cb} != {"journal", "conference"}:
                pairs.append((a[0], b[0]))
    got = {r["id"]: r["root"] for r in linkage.exact_clusters(df).collect()}
    assert got == roots_of([r[0] for r in recs], pairs)


def test_rules(spark):
    base = dict(t=99.0, first_author_match=True, journal_match=True, page_match=False, author_overlap=1.0, year_diff=0, doi_conflict=False, pmid_conflict=False, l_cat="journal", r_cat="journal")
    cases = [({}, "auto_merge"), ({"doi_conflict": True}, None), ({"l_cat": "chapter"}, None), ({"l_cat": "conference"}, "review"), ({"l_cat": "conference", "t": 90.0}, None), ({"t": 96.0, "author_overlap": 0.5}, "auto_merge"),
             ({"t": 90.0}, "review"), ({"t": 81.0, "page_match": True, "first_author_match": False}, "review"), ({"t": 81.0}, None), ({"year_diff": 2}, None)]
    rows = [tuple((base | c).values()) for c, _ in cases]
    kinds = "t double, first_author_match boolean, journal_match boolean, page_match boolean, author_overlap double, year_diff int, doi_conflict boolean, pmid_conflict boolean, l_cat string, r_cat string"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + kinds)
    got = [r["x"] for r in df.select("i", linkage.recommendation(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_merge_and_numbers(spark):
    m = spark.createDataFrame([(1, 10), (1, 12), (2, 11), (3, 9)], "cluster_id long, record_id long")
    e = spark.createDataFrame([(1, 3), (2, 77)], "src long, dst long")
    got = {r["id"]: r["root"] for r in linkage.merged(m, e).collect()}
    assert got == {9: 9, 10: 9, 12: 9, 11: 11}
    r = spark.createDataFrame(list(got.items()), "id long, root long")
    assert {x["root"]: x["cluster_id"] for x in linkage.numbered(r).collect()} == {9: 1, 11: 2}


def test_golden(spark, tmp_path):
    cols = "id long, source_db string, record_type string, record_type_category string, title string, year int, abstract string, journal string, volume string, issue string, start_page string, end_page string, url string, language string, doi string, pmid string, pmcid string, authors array<string>, keywords array<string>, source_record_id string"
    rows = [(1, "WoS", "JOUR", "journal", "T", 2001, "", "J", None, "", "", "", "", "", "", "", "", ["A; b", 'C "q"'], ["X"], "w1"), (2, "RIS", "JOUR", "journal", "", None, "Abs", "K", "7", "", "", "", "", "", "10.1/a", "", "", None, ["x", "Y"], "r1"), (3, "RIS", "", "", "", None, "Other", "", "8", "", "", "", "", "", "", "", "", [], [], "r2")]
    r = spark.createDataFrame(rows, cols)
    c = spark.createDataFrame([(1, 1, "active")], "cluster_id long, canonical_record_id long, status string")
    m = spark.createDataFrame([(1, 1), (1, 3), (1, 2), (1, 2)], "cluster_id long, record_id long")
    g = golden.consolidated(c, m, r)
    x = g.first()
    assert (x["abstract"], x["journal"], x["volume"], x["doi"], x["title"], x["member_count"]) == ("Abs", "J", "7", "10.1/a", "T", 3)
    assert x["source_members"] == ["WoS:w1", "RIS:r1", "RIS:r2"]
    assert golden.consolidated(c, m, r, unite_keywords=True).first()["keywords"] == ["X", "Y"]
    golden.write_csv(golden.csv_rows(g), tmp_path / "g.csv", encoding="utf-8-sig")
    raw = (tmp_path / "g.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfcluster_id,") and b'"A; b; C ""q"""' in raw and raw.endswith(b"\r\n")
    golden.write_ris(golden.ris_text(g), tmp_path / "g.ris")
    text = (tmp_path / "g.ris").read_text()
    assert text.startswith("TY  - JOUR\nAU  - A; b\n") and text.endswith("N1  - source_members=WoS:w1; RIS:r1; RIS:r2\nER  - \n\n") and "VL  - 7" in text


def test_review(spark):
    rows = spark.createDataFrame([(1, " Merge "), (2, ""), (3, None), (4, "SKIP")], "pair_id long, decision string")
    assert {r["pair_id"]: r["decision"] for r in review.decisions(rows).collect()} == {1: "merge", 4: "skip"}
    with pytest.raises(ValueError):
        review.checked(rows.filter("pair_id = 2"))
    with pytest.raises(Exception):
        review.decisions(spark.createDataFrame([(1, "maybe")], "pair_id long, decision string")).collect()
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 0), (3, "d", 0)], "k int, v string, t int")
    assert sorted((r["k"], r["v"]) for r in review.upsert(old, new, ["k"], "t").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_samples(spark):
    assert sampling.drawn(3, 2, 11) == [1, 2] and sampling.drawn(3, 2, 7) == [1, 0]
    df = spark.createDataFrame([(i, f" r{i} ") for i in range(3)], "rec int, raw_text string")
    assert sampling.rendered(sampling.sample(df, 2, 7, ["rec"])) == "r1\n\nr0\n"
    for bad in (0, 4):
        with pytest.raises(ValueError):
            sampling.sample(df, bad, 1, ["rec"])


def test_state(spark):
    f = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2"), (3, "c", "h1")], "id long, path string, file_hash string")
    assert [r["id"] for r in state.unseen(f.filter("id > 1"), f.filter("id = 1")).collect()] == [2]
    left = state.without(f, f.filter("id = 3"), "id", {"r": (spark.createDataFrame([(9, 3), (8, 1)], "id long, source_file_id long"), "source_file_id")})
    assert left[""].count() == 2 and [r["id"] for r in left["r"].collect()] == [8]
    assert state.upserted(f, f.filter("id = 2").withColumn("path", F.lit("z")), "id").filter("path = 'z'").count() == 1


def test_hot_blocks_are_divided(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 5}") for i in range(90)], "id long, key string")
    want = {(r[0], r[1]) for r in rows.alias("l").join(rows.alias("r"), "key").filter("l.id < r.id").select("l.id", "r.id").collect()}
    for part in (7, 1000):
        got = [tuple(r) for r in linkage._pairs_within(rows, ["key"], part).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_rounding_is_exact(spark):
    values = [3.125, 3.375, 2.675, 1.005, 99.995, 0.0, 100.0, 12.345, 66.665]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", linkage.rounded(F.col("v"), 2).alias("r"))
    assert all(r["r"] == round(r["v"], 2) for r in df.collect())
