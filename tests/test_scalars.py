import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import scalars as S


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_doi(spark):
    got = column(spark, ["https://doi.org/10.1000/AB.c).", "doi: 10.12345/x;", "n/a", None, ""], S.normalize_doi)
    assert got == ["10.1000/ab.c", "10.12345/x", "", "", ""]


def test_text(spark):
    got = column(spark, ["A&amp;B  Ｆｕｌｌ﻿x", "see https://a.b/c?d  end", None, "Ünï-code"], S.normalize_text)
    assert got == ["a b full x", "see end", "", "n code"]


def test_year_pages(spark):
    assert column(spark, ["Jan 1999", "20011", "abc", None], S.parse_year) == [1999, 2001, None, None]
    got = column(spark, [" 12-15 ", "7", "", None, "a-b-c"], S.parse_pages)
    assert [(r["start"], r["end"]) for r in got] == [("12", "15"), ("7", ""), ("", ""), ("", ""), ("a", "b-c")]


def test_surnames(spark):
    got = column(spark, [["Smith, John", "Jones AB", "Mary Ann Lee", " ", None, "Smith JAB"], [], None], S.author_surnames, "array<string>")
    assert got[0] == ["smith", "jones", "lee", "jab"] and got[1] == [] and not got[2]


def test_types(spark):
    values = ["Erratum", "CHAP", "Conference Abstract", "Journal Article", "GEN", "", None]
    assert column(spark, values, S.record_type_category) == ["correction", "chapter", "conference", "journal", "generic", "other", "other"]
    assert column(spark, ["CHAP", "Book chapter", "CPAPER", None], S.ris_type) == ["JOUR", "CHAP", "CPAPER", "JOUR"]


def test_lines(spark):
    assert column(spark, ["a\r\nb\rc d\n", "", "﻿x"], lambda c: S.split_lines(S.normalize_lines(c))) == [["a", "b", "c", "d"], [], ["x"]]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 20))) for _ in range(2))
        assert S._lcs(a, b) == plain_lcs(a, b)


@pytest.mark.parametrize("a,b,want", [("x y", "y x z", 100.0), ("", "a", 0.0), ("a b", "a b", 100.0)])
def test_set_ratio(a, b, want):
    assert S.set_ratio(a, b) == pytest.approx(want)
