"""A folder of versioned tables with the commands of the pipeline: ingest, exact and probable duplicates, review, export, report.

Every command writes whole new versions of the tables it changes beside the old ones and then swaps one pointer file, so a
command that fails leaves the tables as they were.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators import golden, linkage, report, review, sampling, state
from citeloom.session import forget, settle
from citeloom.sources import exports
from citeloom.sources.profiles import Settings, infer_profile, load_settings, profile_summary, save_settings

SCHEMAS = {
    "source_files": "id long, path string, format string, profile_name string, file_hash string, imported_at timestamp, encoding_used string, encoding_source string, record_count long",
    "records": "id long, source_file_id long, source_db string, source_file string, source_record_id string, record_type string, record_type_category string, title string, abstract string, authors array<string>, author_surnames array<string>, journal string, year int, volume string, issue string, start_page string, end_page string, doi string, pmid string, pmcid string, keywords array<string>, language string, url string, title_norm string, journal_norm string, first_author_norm string, page_key string, completeness_score double, warnings array<string>, created_at timestamp",
    "record_fields_raw": "record_id long, position int, tag string, value string",
    "clusters": "cluster_id long, canonical_record_id long, stage string, status string",
    "cluster_members": "cluster_id long, record_id long, merged_stage string",
    "candidate_pairs": "id long, pair_key string, left_record_id long, right_record_id long, left_cluster_id long, right_cluster_id long, title_score double, author_score double, author_overlap double, first_author_match boolean, journal_match boolean, year_diff int, page_match boolean, doi_conflict boolean, pmid_conflict boolean, type_conflict boolean, composite_score double, recommendation string, status string, created_at timestamp, resolved_at timestamp",
    "manual_reviews": "pair_id long, pair_key string, left_record_id long, right_record_id long, decision string, preferred_keeper_record_id long, notes string, decided_at timestamp",
    "stage_metrics": "stage string, payload_json string, updated_at timestamp",
}
AFTER_IMPORT = ("clusters", "cluster_members", "candidate_pairs", "manual_reviews", "stage_metrics")


class Workspace:
    def __init__(self, spark: SparkSession, folder: str | Path = "dedup", force: bool = False):
        self.spark, self.folder = spark, Path(folder).resolve()
        self.folder.mkdir(parents=True, exist_ok=True)
        self.config = self.folder / "config.json"
        if force or not self.config.exists():
            save_settings(Settings(), self.config)
        self.settings = load_settings(self.config)
        self.pointer = self.folder / "versions.json"

    # ---- tables

    def _versions(self) -> dict[str, str]:
        return json.loads(self.pointer.read_text()) if self.pointer.exists() else {}

    def table(self, name: str) -> DataFrame:
        v = self._versions().get(name)
        schema = T._parse_datatype_string(SCHEMAS[name])
        return self.spark.read.schema(schema).parquet(str(self.folder / name / v)) if v else self.spark.createDataFrame([], schema)

    def store(self, tables: dict[str, DataFrame | None]) -> None:
        """Writes new versions and swaps the pointer; None empties a table."""
        versions = self._versions()
        for name, df in tables.items():
            versions.pop(name, None)
            if df is not None:
                v = uuid.uuid4().hex[:12]
                columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(SCHEMAS[name]).fields]
                df.select(*columns).write.parquet(str(self.folder / name / v))
                versions[name] = v
        new = self.pointer.with_suffix(".new")
        new.write_text(json.dumps(versions))
        os.replace(new, self.pointer)

    def _metrics(self, stage: str, payload: dict) -> DataFrame:
        row = self.spark.createDataFrame([(stage, json.dumps(payload, sort_keys=True))], "stage string, payload_json string").withColumn("updated_at", F.current_timestamp())
        old = self.table("stage_metrics")
        return old.join(row.select("stage"), "stage", "left_anti").unionByName(row)

    def metrics(self, stage: str) -> dict:
        r = self.table("stage_metrics").filter(F.col("stage") == stage).first()
        return json.loads(r["payload_json"]) if r else {}

    # ---- commands

    def ingest(self, paths: list[str | Path], profile: str | None = None, encoding: str | None = None, force: bool = False) -> dict:
        """Imports files whose path and content are new (all of them with ``force``); clears the results of later stages.

        What the driver holds is as long as ``paths``; the stored files are met by joins.
        """
        paths = list(dict.fromkeys(str(Path(p).resolve()) for p in paths))
        told = [(p, i, profile or infer_profile(p)) for i, p in enumerate(paths)]
        old_files, old_records, old_raw = (self.table(t) for t in ("source_files", "records", "record_fields_raw"))
        next_file, next_record = ((t.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) for t in (old_files, old_records))
        asked = self.spark.createDataFrame(told, "path string, place long, profile_name string")
        files = settle(asked.join(exports.read_files(self.spark, paths).select("path", "file_hash"), "path"), "asked") if paths else asked.withColumn("file_hash", F.lit(""))
        fresh = files if force else state.first_of(state.unseen(files, old_files), "file_hash", "place")
        fresh = settle(fresh, "fresh")
        order = [(r["path"], r["profile_name"]) for r in fresh.orderBy("place").select("path", "profile_name").collect()]
        if not order:
            return {"imported": 0, "skipped": len(paths), "records": 0}
        parts: list[DataFrame] = []
        for name in dict.fromkeys(n for _, n in order):
            prof = self.settings.profiles[name]
            text = exports.decoded(exports.read_files(self.spark, [p for p, n in order if n == name]), prof, encoding)
            recs = exports.parse(text, prof)
            meta = text.select("path", "encoding_used", "encoding_source").withColumns({"format": F.lit(prof.format)})
            rows = exports.normalized(recs, prof).drop("path").withColumn("path", F.col("source_file"))
            parts.append(rows.join(recs.select("path", "rec", "first_position", "entries"), ["path", "rec"]).join(meta, "path"))
        everything = settle(reduce(DataFrame.unionByName, parts), "import")
        twice = exports.repeated_ids(everything).first()
        if twice:
            raise ValueError(f"{twice['path']}: record id {twice['source_record_id']} is used {twice['n']} times")
        counts = everything.groupBy("path").agg(F.count("*").alias("record_count"), *[F.first(c).alias(c) for c in ("format", "encoding_used", "encoding_source")])
        w = Window.orderBy("place")  # one row a file of this import
        ids = fresh.join(counts, "path", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)))
        ids = ids.withColumns({"id": F.row_number().over(w) + F.lit(next_file), "before": F.sum("record_count").over(w) - F.col("record_count") + F.lit(next_record)})
        ids = settle(ids, "ids")
        new_files = ids.withColumn("imported_at", F.current_timestamp()).select([f.name for f in T._parse_datatype_string(SCHEMAS["source_files"]).fields])
        known = ids.select("path", F.col("id").alias("source_file_id"), "before")
        numbered = everything.join(known, "path").withColumns({"id": F.col("before") + F.col("rec"), "created_at": F.current_timestamp()})
        raw = numbered.select(F.col("id").alias("record_id"), "first_position", F.posexplode("entries").alias("k", "e")).select("record_id", (F.col("first_position") + F.col("k")).alias("position"), "e.tag", "e.value")
        if force:
            gone = old_files.join(fresh.select("path"), "path", "left_semi").select("id")
            lost = old_records.join(gone.select(F.col("id").alias("source_file_id")), "source_file_id", "left_semi").select("id")
            left = state.without(old_files, gone, "id", {"records": (old_records, "source_file_id")})
            old_raw = state.without(old_records, lost, "id", {"raw": (old_raw, "record_id")})["raw"]
            old_files, old_records = left[""], left["records"]
        keep = [f.name for f in T._parse_datatype_string(SCHEMAS["records"]).fields]
        self.store({"source_files": old_files.unionByName(new_files), "records": old_records.unionByName(numbered.select(*keep)), "record_fields_raw": old_raw.unionByName(raw), **dict.fromkeys(AFTER_IMPORT)})
        total = ids.agg(F.sum("record_count")).first()[0]
        forget(files, fresh, everything, ids)
        return {"imported": len(order), "skipped": len(paths) - len(order), "records": total}

    def dedup_exact(self) -> dict:
        records = self.table("records")
        payload = dict.fromkeys(linkage.EXACT_METRICS, 0)
        raw = records.count()
        if not raw:
            return payload
        clusters, members = linkage.rebuilt_clusters(records, linkage.exact_clusters(records), "exact")
        payload |= {r["kind"] + "_groups": r["n"] for r in linkage.identifier_groups(records).groupBy("kind").agg(F.count("*").alias("n")).collect()}
        self.store({"clusters": clusters, "cluster_members": members})
        n = self.table("clusters").count()
        payload |= {"raw_records": raw, "exact_clusters": n, "merged_records": raw - n}
        self.store({"stage_metrics": self._metrics("exact", payload)})
        return payload

    def dedup_fuzzy(self) -> dict:
        records, before = self.table("records"), self.table("clusters")
        c, m, p = linkage.fuzzy(records, before, self.table("cluster_members"))
        order = [F.col("status") == "pending", F.col("left_record_id"), F.col("right_record_id")]
        ids = linkage.numbered_rows(p, order)
        self.store({"clusters": c, "cluster_members": m, "candidate_pairs": ids, "manual_reviews": None})
        payload = linkage.fuzzy_metrics(before, self.table("clusters"), self.table("candidate_pairs")).first().asDict()
        self.store({"stage_metrics": self._metrics("fuzzy", payload)})
        return payload

    def _queue(self) -> DataFrame:
        r = self.table("records").withColumn("authors", F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "; "))
        return review.queue(self.table("candidate_pairs"), r, self.table("cluster_members"))

    def review_export(self, path: str | Path, encoding: str = "utf-8", force: bool = False) -> int:
        if Path(path).exists() and not force:
            raise FileExistsError(f"{path} exists; use force to replace it")
        q = self._queue()
        golden.write_csv(q, path, tuple(q.columns), encoding, order=F.struct(-F.col("composite_score"), F.col("pair_id")))
        return q.count()

    def review_import(self, path: str | Path, encoding: str = "utf-8") -> dict:
        rows = self.spark.read.csv(str(path), header=True, multiLine=True, escape='"', encoding=encoding)
        told = review.checked(rows).withColumn("pair_id", F.col("pair_id").cast("long"))
        pairs, members, records = (self.table(t) for t in ("candidate_pairs", "cluster_members", "records"))
        strange = told.join(pairs.select(F.col("id").alias("pair_id")), "pair_id", "left_anti").first()
        if strange:
            raise ValueError(f"unknown pair {strange['pair_id']}")
        keeper = F.col("preferred_keeper").cast("long") if "preferred_keeper" in rows.columns else F.lit(None).cast("long")
        told = told.withColumn("keeper", keeper)
        p = pairs.select(F.col("id").alias("pair_id"), "pair_key", "left_record_id", "right_record_id")
        both = told.join(p.drop("pair_key") if "pair_key" in told.columns else p, "pair_id") if not {"left_record_id", "right_record_id"} & set(told.columns) else told.drop("left_record_id", "right_record_id", "pair_key").join(p, "pair_id")
        wrong = both.filter("decision = 'merge' and keeper is not null and keeper <> left_record_id and keeper <> right_record_id").first()
        if wrong:
            raise ValueError(f"pair {wrong['pair_id']}: {wrong['keeper']} is none of its records")
        if "pair_key" not in both.columns:
            both = both.join(pairs.select(F.col("id").alias("pair_id"), "pair_key"), "pair_id")
        edges = review.merge_edges(told, pairs, members)
        roots = linkage.merged(members.select("cluster_id", "record_id"), edges)
        preferred = both.filter("decision = 'merge' and keeper is not null").select(F.col("keeper").alias("id"))
        c, m = linkage.rebuilt_clusters(records, roots, "manual_review", preferred)
        notes = F.coalesce("notes", F.lit("")) if "notes" in both.columns else F.lit("")
        new = both.select("pair_id", "pair_key", "left_record_id", "right_record_id", "decision", F.col("keeper").alias("preferred_keeper_record_id"), notes.alias("notes"), F.current_timestamp().alias("decided_at"))
        counts = {r["decision"]: r["n"] for r in review.counts(told).collect()}
        self.store({"clusters": c, "cluster_members": m, "candidate_pairs": review.decided(pairs, told), "manual_reviews": review.upsert(self.table("manual_reviews"), new, ["pair_id"], "decided_at")})
        told_of = [sum(counts.values()), *(counts.get(k, 0) for k in review.DECISIONS), self.pending(), self.table("clusters").count()]
        payload = dict(zip(review.REVIEW_METRICS, told_of))
        self.store({"stage_metrics": self._metrics("review", payload)})
        return payload

    def pending(self) -> int:
        return review.pending(self.table("candidate_pairs"), self.table("cluster_members")).count()

    def golden(self, unite_keywords: bool = False) -> DataFrame:
        return golden.consolidated(self.table("clusters"), self.table("cluster_members"), self.table("records"), unite_keywords)

    def export_tables(self, folder: str | Path, allow_pending: bool = False) -> None:
        """The export as folders of CSV and RIS parts, written where the rows are, for results no single file should hold."""
        waiting = self.pending()
        if waiting and not allow_pending:
            raise RuntimeError(f"{waiting} pairs wait for review; allow_pending exports anyway")
        golden.write_parts(self.golden(), str(folder))

    def export(self, csv_path: str | Path, ris_path: str | Path, allow_pending: bool = False, csv_encoding: str = "utf-8", ris_encoding: str = "utf-8") -> int:
        waiting = self.pending()
        if waiting and not allow_pending:
            raise RuntimeError(f"{waiting} pairs wait for review; allow_pending exports anyway")
        g = settle(self.golden(), "golden")
        golden.write_csv(golden.csv_rows(g), csv_path, encoding=csv_encoding)
        golden.write_ris(golden.ris_text(g), ris_path, ris_encoding)
        return g.count()

    def stats(self) -> dict:
        """The figures of the report; one entry for each stored file, everything else is small."""
        records, files, clusters = self.table("records"), self.table("source_files"), self.table("clusters")
        pairs_of = lambda df, k, *by: {r[k]: r["n"] for r in df.orderBy(*(by or (k,))).collect()}
        stages = {s: self.metrics(s) for s in ("exact", "fuzzy", "review")}
        often = F.col("n").desc()
        summary = [files.count(), records.count(), stages["exact"].get("exact_clusters"), stages["fuzzy"].get("post_fuzzy_clusters"), self.table("candidate_pairs").filter("status = 'pending'").count(), clusters.count()]
        return dict(zip(report.SECTIONS, (
            dict(zip(report.SUMMARY, summary)), pairs_of(report.source_breakdown(records), "source_db"),
            {r["field"]: {"missing": r["missing"], "total": r["total"]} for r in report.missing_fields(records).collect()},
            pairs_of(report.type_distribution(records), "record_type_category", often, "record_type_category"), stages["exact"], stages["fuzzy"], stages["review"],
            pairs_of(report.encoding_summary(files), "encoding", often, "encoding"), [r.asDict() for r in report.encoding_by_file(files).orderBy("id").drop("id").toLocalIterator()],
            profile_summary(self.settings) | {"observed_raw_tags": pairs_of(report.observed_tags(self.table("record_fields_raw")), "tag")},
        )))

    def report(self, markdown_path: str | Path, json_path: str | Path, encoding: str = "utf-8") -> dict:
        payload = self.stats()
        report.write(payload, markdown_path, json_path, encoding)
        return payload


def sample_file(spark: SparkSession, source: str | Path, target: str | Path, count: int, seed: int, profile: str | None = None, encoding: str | None = None, output_encoding: str = "utf-8", force: bool = False, settings: Settings | None = None) -> int:
    """Writes a seeded sample of the records of one export, in the order they were drawn."""
    if Path(target).exists() and not force:
        raise FileExistsError(f"{target} exists; use force to replace it")
    prof = (settings or Settings()).profiles[profile or infer_profile(str(source))]
    recs = exports.parse(exports.decoded(exports.read_files(spark, str(Path(source).resolve())), prof, encoding), prof)
    text = sampling.rendered(sampling.sample(recs.select("rec", "raw_text"), count, seed, ["rec"]))
    Path(target).write_text(text, output_encoding)
    return count


__all__ = ["Workspace", "sample_file"]
