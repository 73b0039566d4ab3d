"""Scalar functions over citation fields, as column expressions; Arrow only where the JVM has no equivalent."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All Unicode white space, written so that Java and RE2 read it alike.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_ENDS = r"[\n\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: Sources in the order of their trust.
SOURCE_ORDER = ("PubMed", "Embase", "WoS", "RIS")
#: What each present field adds to the completeness of a record.
COMPLETENESS = {"doi": 10, "pmid": 10, "pmcid": 8, "title": 6, "year": 5, "authors": 5, "abstract": 4, "journal": 3, "pages": 2, "url": 1}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def blank(c: Column) -> Column:
    """True for null and for the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


@F.pandas_udf(T.StringType())
def _compatible(s: pd.Series) -> pd.Series:
    def one(x):
        if not isinstance(x, str) or (x.isascii() and "&" not in x):
            return x
        return unicodedata.normalize("NFKC", html.unescape(x)).replace("﻿", " ").lower()

    return s.map(one)


@F.pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) and not x.isascii() else x)


def normalize_text(c: Column) -> Column:
    """Lower-case ASCII words and digits of a text, without URLs."""
    x = F.lower(_compatible(F.coalesce(c, F.lit(""))))
    x = F.regexp_replace(x, r"https?://[^\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " ")
    return F.trim(F.regexp_replace(x, "[^0-9a-z]+", " "))


def normalize_lines(c: Column) -> Column:
    """LF line ends and no leading byte-order mark."""
    return F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"^\x{feff}", "")


def split_lines(c: Column) -> Column:
    """The lines of a text; a line end at its end opens no further line."""
    parts = F.split(c, LINE_ENDS)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normalize_doi(c: Column) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)", 1)
    return F.lower(F.regexp_replace(found, r"[.;,)]+$", ""))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{Nd}]", "")


def parse_year(c: Column) -> Column:
    return F.when(c.rlike("(19|20)[0-9]{2}"), F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1).cast("int"))


def parse_pages(c: Column) -> Column:
    """struct(start, end)."""
    v = strip(F.coalesce(c, F.lit("")))
    at = F.instr(v, "-")
    start = F.when(at > 0, strip(F.substring_index(v, "-", 1))).otherwise(v)
    end = F.when(at > 0, strip(F.regexp_replace(v, r"^[^-]*-", ""))).otherwise("")
    return F.struct(start.alias("start"), end.alias("end"))


def values_of(fields: Column, tags: list[str]) -> Column:
    """The values of ``tags`` in a map of tag -> values, in the order of the tags."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(fields[t], none) for t in tags]) if tags else none


def all_values(fields: Column, tags: list[str]) -> Column:
    return F.filter(F.transform(values_of(fields, tags), strip), lambda v: v != "")


def first_non_empty(fields: Column, tags: list[str]) -> Column:
    return F.coalesce(F.get(all_values(fields, tags), F.lit(0)), F.lit(""))


def extract_identifier(fields: Column, tags: list[str], normalizer=strip) -> Column:
    """The first value whose normalized form isn't empty, normalized."""
    return F.coalesce(F.get(F.filter(F.transform(values_of(fields, tags), normalizer), lambda v: v != ""), F.lit(0)), F.lit(""))


def surname(author: Column) -> Column:
    """The surname of one typed name, before normalization."""
    a = strip(author)
    parts = F.filter(F.split(a, f"{WS}+"), lambda p: p != "")
    last = F.element_at(parts, -1)
    short = F.length(F.regexp_replace(last, r"^\.+|\.+$", "")) <= 2
    return (
        F.when(a == "", "")
        .when(F.contains(a, F.lit(",")), strip(F.substring_index(a, ",", 1)))
        .when((F.size(parts) >= 2) & short, F.get(parts, F.lit(0)))
        .otherwise(last)
    )


_SEPARATOR = "\u0001"


def author_surnames(authors: Column) -> Column:
    """Normalized surnames of a list of names; one Arrow call for the whole list."""
    names = F.filter(F.transform(F.filter(authors, lambda a: a.isNotNull()), surname), lambda s: s != "")
    joined = F.array_join(names, _SEPARATOR)
    low = F.lower(_compatible(joined))
    words = F.transform(F.split(low, _SEPARATOR), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"https?://\S+", " "), "[^0-9a-z]+", " ")))
    return F.filter(words, lambda s: s != "")


def record_type_category(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]+", " "))
    rules = (("correction", ("erratum", "correction")), ("chapter", ("chapter", "chap")), ("conference", ("conference", "cpaper", "abstract")), ("journal", ("journal", "article", "jour")), ("generic", ("generic", "gen")))
    out = F.lit("other")
    for name, words in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words]), name).otherwise(out)
    return out


def completeness_score(doi, pmid, pmcid, title, year, authors, abstract, journal, start_page, end_page, url) -> Column:
    has = {"doi": ~blank(doi), "pmid": ~blank(pmid), "pmcid": ~blank(pmcid), "title": ~blank(title), "year": year.isNotNull(), "authors": F.coalesce(F.size(authors), F.lit(0)) > 0, "abstract": ~blank(abstract), "journal": ~blank(journal), "pages": ~blank(start_page) | ~blank(end_page), "url": ~blank(url)}
    return reduce(lambda a, b: a + b, [F.when(has[k], float(v)).otherwise(0.0) for k, v in COMPLETENESS.items()])


def pair_key(left: Column, right: Column) -> Column:
    return F.concat_ws(":", F.least(left, right), F.greatest(left, right))


def source_rank(source_db: Column, order: tuple[str, ...] = SOURCE_ORDER) -> Column:
    out = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        out = F.when(source_db == s, i).otherwise(out)
    return out


def author_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def ris_type(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(t, F.lit("conference")) | F.contains(t, F.lit("cpaper")), "CPAPER").when(F.contains(t, F.lit("chapter")), "CHAP").otherwise("JOUR")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: bit-parallel over the positions of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        m = where.get(ch)
        if m is not None:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def set_ratio(a: str, b: str) -> float:
    """Similarity 0 to 100 of two texts as sets of words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    gap = 1 if both else 0
    nx, ny = len(both) + gap + len(only_x), len(both) + gap + len(only_y)
    apart = len(only_x) + len(only_y) - 2 * _lcs(only_x, only_y)
    best = 1.0 - apart / (nx + ny)
    if both:
        best = max(best, 1.0 - (gap + len(only_x)) / (len(both) + nx), 1.0 - (gap + len(only_y)) / (len(both) + ny))
    return 100.0 * best


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
