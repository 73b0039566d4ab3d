"""Data-quality figures over the records, their files and the outcome of the stages."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import scalars as S

# The fields of the missing-value profile with the columns they are read from, and the tags that are counted.
PROFILED = {"title": "title", "authors": "authors", "year": "year", "abstract": "abstract", "doi": "doi", "pmid": "pmid", "journal": "journal", "pages": "start_page"}
OBSERVED = ("AB", "N2", "PMID", "DO", "AID", "LID", "T1", "TI", "A1", "AU", "Y1", "PY")
# The keys of the report.
SUMMARY = ("total_source_files", "raw_imported_records", "exact_deduplicated_clusters", "fuzzy_auto_merged_clusters", "manual_review_pending", "final_unique_clusters")
SECTIONS = ("summary", "source_breakdown", "missing_key_fields", "record_type_distribution", "exact_metrics", "fuzzy_metrics", "review_metrics", "encoding_summary", "encoding_by_file", "parser_profile_summary")


def summary_counts(**tables: DataFrame) -> DataFrame:
    """(name, n): the rows of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in sorted(tables.items())])


def source_breakdown(records: DataFrame) -> DataFrame:
    return records.groupBy("source_db").agg(F.count("*").alias("n"))


def type_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("record_type_category", F.lit("other")).alias("record_type_category")).agg(F.count("*").alias("n"))


def observed_tags(entries: DataFrame, tags: tuple[str, ...] = OBSERVED) -> DataFrame:
    return entries.filter(F.col("tag").isin(*tags)).groupBy("tag").agg(F.count("*").alias("n"))


def encoding_summary(files: DataFrame) -> DataFrame:
    used, how = F.coalesce("encoding_used", F.lit("unknown")), F.coalesce("encoding_source", F.lit("unknown"))
    return files.groupBy(F.concat_ws("|", used, how).alias("encoding")).agg(F.count("*").alias("n"))


def encoding_by_file(files: DataFrame) -> DataFrame:
    return files.select("id", "path", "profile_name", F.coalesce("encoding_used", F.lit("")).alias("encoding_used"), F.coalesce("encoding_source", F.lit("")).alias("encoding_source"), "record_count")


def missing_fields(records: DataFrame) -> DataFrame:
    """(field, missing, total) from one pass over the records."""

    def absent(f: str):
        kind = dict(records.dtypes)[f]
        if kind.startswith("array"):
            return F.coalesce(F.size(f), F.lit(0)) <= 0
        return F.coalesce(F.col(f), F.lit(0)) == 0 if kind in ("int", "bigint") else S.blank(F.col(f))

    one = records.agg(F.count("*").alias("total"), *[F.sum(F.when(absent(c), 1).otherwise(0)).alias(f) for f, c in PROFILED.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(0)).cast("long").alias("missing")) for f in PROFILED])
    return one.select("total", F.explode(rows).alias("r")).select("r.field", "r.missing", "total")


def markdown(payload: dict) -> str:
    """The report as headed lists; shares are given to one decimal."""
    s = payload["summary"]
    out = ["# Data quality", "", "## Summary", ""] + [f"- {k.replace('_', ' ')}: {s[k]}" for k in SUMMARY]
    out += ["", "## Missing values", "", "| field | missing | of | share |", "|---|---|---|---|"]
    out += [f"| {f} | {v['missing']} | {v['total']} | {100 * v['missing'] / (v['total'] or 1):.1f}% |" for f, v in payload["missing_key_fields"].items()]
    for head, key in (("Sources", "source_breakdown"), ("Types", "record_type_distribution")):
        out += ["", f"## {head}", ""] + [f"- {k}: {n}" for k, n in payload[key].items()]
    out += ["", "## Encodings", ""] + ["- {} by {}: {} files".format(*k.split("|", 1), n) for k, n in payload["encoding_summary"].items()]
    told = payload["parser_profile_summary"]
    out += ["", "## Profiles", "", "An encoding given with the command goes before that of the profile, and that before UTF-8.", ""]
    for name, p in told["profiles"].items():
        out.append(f"- {name}: {p['format']} from {p['source_name']}, abstract from {' then '.join(p['abstract_tags']) or 'none'}" + (", byte-order marks stripped" if p["strip_bom"] else ""))
    out += ["", "## Tags", ""] + [f"- {k}: {n}" for k, n in told["observed_raw_tags"].items()]
    out += ["", "## Stages", ""] + [f"- {k}: `{json.dumps(payload[k + '_metrics'], ensure_ascii=False)}`" for k in ("exact", "fuzzy", "review")]
    return "\n".join(out) + "\n"


def write(payload: dict, markdown_path: str | Path, json_path: str | Path, encoding: str = "utf-8") -> None:
    Path(markdown_path).write_text(markdown(payload), encoding)
    Path(json_path).write_text(json.dumps(payload, indent=2, ensure_ascii=False) + "\n", encoding)
