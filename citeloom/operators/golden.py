"""One consolidated record for each cluster, and its CSV and RIS renderings."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import scalars as S

#: Fields that a canonical record takes over from the first member that has them, where its own is missing.
BACKFILLED = ("abstract", "journal", "volume", "issue", "start_page", "end_page", "url", "language", "doi", "pmid", "pmcid")
# Fields that are its own, and the columns of the export.
OWN = ("source_db", "record_type", "record_type_category", "title", "year")
CSV_COLUMNS = ("cluster_id", "canonical_record_id", "source_db", "record_type", "title", "year", "authors", "journal", "volume", "issue", "start_page", "end_page", "doi", "pmid", "pmcid", "abstract", "keywords", "language", "url", "member_count", "source_members")


def consolidated(clusters: DataFrame, members: DataFrame, records: DataFrame, unite_keywords: bool = False) -> DataFrame:
    """One row a cluster, from one join and one aggregation.

    The member lists, which are part of the result and as long as their cluster, are sorted inside the aggregation; everything
    else is reduced where the rows are.
    """
    c = clusters.filter("status = 'active'").select("cluster_id", "canonical_record_id")
    m = members.select("cluster_id", F.col("record_id").alias("id")).distinct()
    cols = [*OWN, *BACKFILLED, "authors", "keywords", "source_record_id"]
    x = m.join(c, "cluster_id").join(records.select("id", *cols), "id")
    own = F.col("id") == F.col("canonical_record_id")
    aggs = [F.max(F.when(own, F.col(f))).alias(f) for f in (*OWN, "authors", "keywords")]
    aggs += [F.expr(f"min_by({f}, struct(id <> canonical_record_id, id)) filter (where {f} is not null and {f} <> '')").alias(f) for f in BACKFILLED]
    aggs += [F.sort_array(F.collect_list(F.struct("id", F.concat_ws(":", "source_db", "source_record_id").alias("s")))).alias("who"), F.max(own).alias("_has")]
    out = x.groupBy("cluster_id", "canonical_record_id").agg(*aggs).filter("_has").drop("_has")
    if unite_keywords:
        out = out.drop("keywords").join(keyword_union(x), "cluster_id", "left")
    return out.select("cluster_id", "canonical_record_id", *OWN, *BACKFILLED, "authors", "keywords", F.col("who.id").alias("member_ids"), F.col("who.s").alias("source_members"), F.size("who").alias("member_count"))


def keyword_union(member_rows: DataFrame) -> DataFrame:
    """(cluster_id, keywords): the keywords of all members (cluster_id, id, keywords), letter case aside, in the spelling and order met first."""
    k = member_rows.select("cluster_id", "id", F.posexplode("keywords").alias("pos", "kw")).withColumn("low", F.lower(S.strip(F.col("kw")))).filter("low <> ''")
    first = k.groupBy("cluster_id", "low").agg(F.min(F.struct("id", "pos", "kw")).alias("f"))
    return first.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list("f")), lambda f: f["kw"]).alias("keywords"))


def csv_rows(golden: DataFrame) -> DataFrame:
    """The rows of the CSV export as text; sort by cluster_id."""
    lists = {"authors", "keywords", "source_members"}
    none = F.array().cast("array<string>")
    pick = lambda c: F.array_join(F.coalesce(c, none), "; ") if c in lists else S.or_empty(F.when(F.col(c) != 0, F.col(c)) if c == "year" else F.col(c))
    return golden.select(*[(F.col(c) if c == "cluster_id" else pick(c)).alias(c) for c in CSV_COLUMNS])


def ris_text(golden: DataFrame) -> DataFrame:
    """(cluster_id, text): each record in RIS."""
    line = lambda tag, c: F.when(~S.blank(c.cast("string")), F.concat(F.lit(f"{tag}  - "), c.cast("string")))
    none = F.array().cast("array<string>")
    each = lambda tag, c: F.transform(F.coalesce(c, none), lambda v: F.concat(F.lit(f"{tag}  - "), v))
    year = F.when(F.col("year") != 0, F.col("year"))
    lines = F.concat(
        F.array(F.concat(F.lit("TY  - "), S.ris_type(F.col("record_type")))), each("AU", F.col("authors")),
        F.array(*[line(t, c) for t, c in (("TI", F.col("title")), ("T2", F.col("journal")), ("AB", F.col("abstract")), ("PY", year), ("VL", F.col("volume")), ("IS", F.col("issue")), ("SP", F.col("start_page")), ("EP", F.col("end_page")), ("DO", F.col("doi")), ("UR", F.col("url")))]),
        each("KW", F.col("keywords")), F.array(line("LA", F.col("language")), F.concat(F.lit("N1  - cluster_id="), F.col("cluster_id").cast("string")), F.concat(F.lit("N1  - source_members="), F.array_join("source_members", "; ")), F.lit("ER  - "), F.lit("")),
    )
    return golden.select("cluster_id", F.array_join(F.array_compact(lines), "\n").alias("text"))


def _csv_lines(rows: Iterator, columns: tuple[str, ...]) -> Iterator[str]:
    buffer = io.StringIO()
    w = csv.writer(buffer, lineterminator="\r\n")
    w.writerow(columns)
    for r in rows:
        w.writerow(["" if r[c] is None else r[c] for c in columns])
        yield buffer.getvalue()
        buffer.seek(0)
        buffer.truncate()
    yield buffer.getvalue()


def write_csv(rows: DataFrame, path: str | Path, columns: tuple[str, ...] = CSV_COLUMNS, encoding: str = "utf-8", order: str | Column = "cluster_id") -> None:
    """A single CSV file, streamed partition by partition through the driver."""
    with open(path, "w", encoding=encoding, newline="") as f:
        f.writelines(_csv_lines(rows.orderBy(order).toLocalIterator(), columns))


def write_parts(golden: DataFrame, folder: str) -> None:
    """``folder``/csv and ``folder``/ris in parts that follow each other by cluster id; no row passes the driver."""
    csv_rows(golden).repartitionByRange("cluster_id").sortWithinPartitions("cluster_id").write.csv(f"{folder}/csv", header=True, quote='"', escape='"', emptyValue="")
    ris_text(golden).repartitionByRange("cluster_id").sortWithinPartitions("cluster_id").select("text").write.text(f"{folder}/ris")


def write_ris(texts: DataFrame, path: str | Path, encoding: str = "utf-8") -> None:
    with open(path, "w", encoding=encoding, newline="") as f:
        for r in texts.orderBy("cluster_id").toLocalIterator():
            f.write(r["text"] + "\n")
