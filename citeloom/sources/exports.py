"""Citation exports as DataFrames: files to texts, texts to records, records to normalized rows.

Parsing is narrow and linear.  A text is split where its records begin, the pieces are exploded, and each record is split the
same way into its entries, so that nothing is shuffled, every file is parsed where it was read and the work grows with the
length of the text, however many records it holds.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import scalars as S
from citeloom.sources.profiles import Profile

#: Codec names that Java knows under another name; all others go through Arrow.
JAVA_CODECS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "utf-16": "UTF-16"}
#: How a tagged line of each format begins.
RIS_HEAD = "[A-Z0-9]{2}  -"
NBIB_HEAD = r"[A-Z0-9]{2,4}[ \t]*-"
#: Fixed value: the warning of a record that ends with its file.
NO_END = "Missing explicit ER end tag; record finalized at EOF."


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content, file_hash) of the given files."""
    f = spark.read.format("binaryFile").load(paths)
    return f.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", content_hash(F.col("content")).alias("file_hash"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def decoded(files: DataFrame, profile: Profile, encoding: str | None = None) -> DataFrame:
    """Adds text, encoding_used and encoding_source; bytes that the encoding doesn't allow fail the query."""
    chosen = (encoding or "").strip() or (profile.encoding or "").strip() or "utf-8"
    how = "cli" if (encoding or "").strip() else "config" if (profile.encoding or "").strip() else "default"
    java = JAVA_CODECS.get(chosen.lower())
    if java:
        text = F.decode(F.col("content"), java)
    else:
        codec = chosen

        @F.pandas_udf(T.StringType())
        def strict(raw: pd.Series) -> pd.Series:
            return raw.map(lambda b: bytes(b).decode(codec, "strict"))

        text = strict(F.col("content"))
    return files.withColumn("text", S.composed(S.normalize_lines(text))).withColumn("encoding_used", F.lit(chosen)).withColumn("encoding_source", F.lit(how))


def _with_breaks(text: Column, strip_bom: bool) -> Column:
    """The lines of a text, each with an LF in front of it."""
    x = F.regexp_replace(F.regexp_replace(S.normalize_lines(F.coalesce(text, F.lit(""))), S.LINE_ENDS, "\n"), r"\n\z", "")
    x = F.when(x == "", F.lit("")).otherwise(F.concat(F.lit("\n"), x))
    return F.regexp_replace(x, r"\n\x{feff}+", "\n") if strip_bom else x


def _after_end(piece: Column, end_tag: str) -> Column:
    """Place of the first line end behind the line of the end tag; 0 if nothing follows it or it isn't there."""
    at = F.position(F.lit(f"\n{end_tag}  -"), piece)
    return F.when(at > 0, F.position(F.lit("\n"), piece, at + 1)).otherwise(F.lit(0))


def _active(piece: Column, end_tag: str | None) -> Column:
    """The lines of a record up to its end tag."""
    if end_tag is None:
        return piece
    return F.when(_after_end(piece, end_tag) > 0, F.substring(piece, F.lit(1), _after_end(piece, end_tag) - 1)).otherwise(piece)


def _entries(record: Column, head: str) -> Column:
    """struct(tag, value) of the tagged lines of a record, each with the lines that go on with it."""

    def one(e: Column) -> Column:
        lines = F.transform(F.split(F.substring(e, F.position(F.lit("-"), e) + 1, F.length(e)), "\n"), S.strip)
        return F.struct(F.regexp_extract(e, "^([A-Z0-9]+)", 1).alias("tag"), F.array_join(F.filter(lines, lambda v: v != ""), " ").alias("value"))

    parts = F.split(record, f"\n(?={head})")
    return F.transform(F.slice(parts, 2, F.size(parts)), one)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _firsts(sizes: pd.Series) -> pd.Series:
    """The ordinals with which runs of the given sizes begin, counted from 1."""
    return sizes.map(lambda n: np.cumsum(n, dtype=np.int32) - n + 1)


def _pieces(x: DataFrame, profile: Profile) -> tuple[DataFrame, str | None]:
    """(path, own, before): for each text the pieces that hold one record each and the pieces in front of them."""
    if profile.format == "ris":
        x = x.select("path", F.split("text", f"\n(?={profile.start_tag}  -)").alias("p"))
        # a split takes the LF in front of a record away
        own = F.transform(F.slice("p", 2, F.size("p")), lambda v: F.concat(F.lit("\n"), v))
        before = F.transform(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), lambda v, i: F.when(i == 0, v).otherwise(F.concat(F.lit("\n"), v)))
        return x.select("path", own.alias("own"), before.alias("before")), profile.end_tag or "ER"
    # a blank line or the start tag closes a record, any tag opens one
    blank = r"[ \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]*(?:\n|\z)"
    own = F.transform(F.split("text", rf"\n(?={blank}|{profile.start_tag}[ \t]*-)"), lambda v: F.concat(F.lit("\n"), v))
    x = x.select("path", F.filter(own, lambda v: v.rlike(f"\n{NBIB_HEAD}")).alias("own"))
    return x.select("path", "own", F.col("own").alias("before")), None


def parse(texts: DataFrame, profile: Profile, path: str = "path", text: str = "text") -> DataFrame:
    """(path, rec, first_position, entries, fields, warnings, raw_text): the records of each text.

    ``rec`` counts the records of a file from 1; the position of an entry in its file is ``first_position`` plus its index.
    Lines between two RIS records belong to the raw text of the later one.
    """
    if profile.format not in ("ris", "nbib"):
        raise ValueError(f"unknown format {profile.format}")
    ris = profile.format == "ris"
    head = RIS_HEAD if ris else NBIB_HEAD
    x, end = _pieces(texts.select(F.col(path).alias("path"), _with_breaks(F.col(text), ris and profile.strip_bom).alias("text")), profile)
    first = _firsts(F.transform("own", lambda v: F.regexp_count(_active(v, end), F.lit(f"\n(?={head})"))))
    x = x.select("path", F.size("own").alias("n"), F.arrays_zip("own", "before", first.alias("first")).alias("z"))
    x = x.select("path", "n", F.posexplode("z").alias("k", "z")).select("path", "n", "k", "z.own", "z.before", F.col("z.first").alias("first"))
    if ris:
        at = _after_end(F.col("before"), end)
        between = F.when(F.col("k") == 0, F.col("before")).when(at > 0, F.substring("before", at, F.length("before"))).otherwise(F.lit(""))
        raw = F.concat(between, _active(F.col("own"), end))
        unfinished = (F.position(F.lit(f"\n{end}  -"), F.col("own")) == 0) & (F.col("k") == F.col("n") - 1)
    else:
        raw = F.concat(F.lit("\n"), F.array_join(F.slice(F.split("own", f"\n(?={head})"), 2, F.length("own")), "\n"))
        unfinished = F.lit(False)
    x = x.select("path", "k", "first", F.substring(raw, F.lit(2), F.length(raw)).alias("raw_text"), unfinished.alias("unfinished"), F.explode(F.array(_entries(_active(F.col("own"), end), head))).alias("entries"))
    tags = F.array_distinct(F.transform("entries", lambda e: e["tag"]))
    fields = F.map_from_arrays(tags, F.transform(tags, lambda t: F.transform(F.filter("entries", lambda e: e["tag"] == t), lambda e: e["value"])))
    return x.select(
        "path", (F.col("k") + 1).alias("rec"), F.col("first").alias("first_position"), "entries", fields.alias("fields"),
        F.when(F.col("unfinished"), F.array(F.lit(NO_END))).otherwise(F.array().cast("array<string>")).alias("warnings"), "raw_text",
    )


def raw_entries(parsed: DataFrame) -> DataFrame:
    """(path, rec, position, tag, value): the entries in long form."""
    return parsed.select("path", "rec", "first_position", F.posexplode("entries").alias("k", "e")).select("path", "rec", (F.col("first_position") + F.col("k")).alias("position"), "e.tag", "e.value")


def record_count(texts: DataFrame, profile: Profile, path: str = "path", text: str = "text") -> DataFrame:
    """(path, n): lines that look like the start of a record."""
    head = f"{profile.start_tag}  -" if profile.format == "ris" else f"{profile.start_tag}-"
    lines = S.split_lines(S.normalize_lines(F.coalesce(F.col(text), F.lit(""))))
    return texts.select(F.col(path).alias("path"), F.size(F.filter(lines, lambda v: v.startswith(head))).cast("long").alias("n"))


@F.pandas_udf(T.StringType())
def _generated_id(fields_json: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        return "generated:" + hashlib.sha1(json.dumps(json.loads(x), sort_keys=True).encode()).hexdigest()

    return fields_json.map(one)


def source_record_id(fields: Column, profile: Profile) -> Column:
    """The first value of the first id tag that is there, else a digest of all fields."""
    out = _generated_id(F.to_json(fields))
    for t in reversed(profile.id_tags):
        out = F.when(F.coalesce(F.size(fields[t]), F.lit(0)) > 0, F.get(fields[t], F.lit(0))).otherwise(out)
    return out


def normalized(parsed: DataFrame, profile: Profile) -> DataFrame:
    """Rows of the records table, but for ids and times."""
    f = F.col("fields")
    first = lambda name: S.first_non_empty(f, profile.tags(name))
    x = parsed.select(
        "path", "rec", "warnings", "raw_text", source_record_id(f, profile).alias("source_record_id"), first("record_type").alias("record_type"), first("title").alias("title0"),
        first("abstract").alias("abstract0"), S.all_values(f, profile.tags("authors")).alias("authors"), first("journal").alias("journal0"), S.parse_year(first("year")).alias("year"),
        first("volume").alias("volume"), first("issue").alias("issue"), first("start_page").alias("sp"), first("end_page").alias("ep"), S.parse_pages(first("pages")).alias("pages"),
        S.all_values(f, profile.tags("keywords")).alias("keywords0"), first("language").alias("language"), first("url").alias("url"),
        S.extract_identifier(f, profile.ids.get("doi", []), S.normalize_doi).alias("doi"), S.extract_identifier(f, profile.ids.get("pmid", []), S.digits).alias("pmid"), S.extract_identifier(f, profile.ids.get("pmcid", [])).alias("pmcid"),
    )
    paged = (F.col("sp") == "") & (F.col("pages.start") != "")
    sep = "\u0001"
    x = x.select(
        "*", F.when(paged, F.col("pages.start")).otherwise(F.col("sp")).alias("start_page"), F.when(paged, F.col("pages.end")).otherwise(F.col("ep")).alias("end_page"),
        S.author_surnames(F.col("authors")).alias("author_surnames"), S.record_type_category(F.col("record_type")).alias("record_type_category"),
    )
    x = x.withColumns({"title": S.strip(S.unescape("title0")), "abstract": S.strip(S.unescape("abstract0")), "journal": S.strip(S.unescape("journal0"))})
    x = x.withColumn("keywords", F.when(F.size("keywords0") > 0, F.transform(F.split(S.unescape(F.array_join("keywords0", sep)), sep), S.strip)).otherwise(F.array().cast("array<string>")))
    score = S.completeness_score(*(F.col(c) for c in ("doi", "pmid", "pmcid", "title", "year", "authors", "abstract", "journal", "start_page", "end_page", "url")))
    return x.select(
        "path", "rec", F.lit(profile.source_name).alias("source_db"), F.col("path").alias("source_file"), "source_record_id", "record_type", "record_type_category", "title", "abstract", "authors", "author_surnames",
        "journal", "year", "volume", "issue", "start_page", "end_page", "doi", "pmid", "pmcid", "keywords", "language", "url", S.normalize_text(F.col("title0")).alias("title_norm"),
        S.normalize_text(F.col("journal0")).alias("journal_norm"), F.coalesce(F.get("author_surnames", F.lit(0)), F.lit("")).alias("first_author_norm"), S.normalize_text(F.col("start_page")).alias("page_key"),
        score.alias("completeness_score"), "warnings", "raw_text",
    )


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(path, source_record_id, n) of ids that one file uses more than once; such a file must not be stored."""
    return rows.groupBy("path", "source_record_id").agg(F.count("*").alias("n")).filter("n > 1")
