"""The review of uncertain pairs: the queue for people, their decisions, and what follows from these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import scalars as S

DECISIONS = ("merge", "separate", "skip")
SIDE = ("title", "year", "authors", "journal", "doi", "pmid", "source_db")


def pending(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pending pairs whose records are in different clusters now, with these clusters."""
    m = members.select("record_id", "cluster_id").distinct()
    at = lambda side: m.select(F.col("record_id").alias(side + "_record_id"), F.col("cluster_id").alias(side + "_cluster"))
    return pairs.filter("status = 'pending'").join(at("left"), "left_record_id").join(at("right"), "right_record_id").filter("left_cluster <> right_cluster")


def queue(pairs: DataFrame, records: DataFrame, members: DataFrame) -> DataFrame:
    """What a reviewer sees of each pending pair; sort it by composite_score descending, then id."""
    x = pending(pairs, members)
    r = records.withColumn("authors", F.array_join(F.coalesce("author_surnames", F.array().cast("array<string>")), "; ")) if "authors" not in records.columns else records
    for side in ("left", "right"):
        x = x.join(r.select(F.col("id").alias(side + "_record_id"), *[S.or_empty(F.col(c)).alias(f"{side}_{c}") for c in SIDE]), side + "_record_id")
    return x.select(
        F.col("id").alias("pair_id"), S.pair_key(F.col("left_record_id"), F.col("right_record_id")).alias("pair_key"), "left_record_id", "right_record_id", F.col("left_cluster").alias("left_cluster_id"), F.col("right_cluster").alias("right_cluster_id"),
        *[f"{s}_{c}" for c in SIDE for s in ("left", "right")], "title_score", "author_score", "author_overlap", "composite_score", "recommendation",
        F.lit("").alias("decision"), F.lit("").alias("preferred_keeper"), F.lit("").alias("notes"),
    )


def decisions(rows: DataFrame) -> DataFrame:
    """Decisions in lower case without blanks; rows without one are left out, an unknown one fails the query."""
    d = F.lower(S.strip(F.coalesce("decision", F.lit(""))))
    x = rows.withColumn("decision", d).filter("decision <> ''")
    known = F.when(F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise(F.raise_error(F.concat(F.lit("unknown decision: "), F.col("decision"))))
    return x.withColumn("decision", known)


def checked(rows: DataFrame) -> DataFrame:
    """The same, but ValueError if there is no decision at all."""
    x = decisions(rows)
    if x.isEmpty():
        raise ValueError("the file holds no decisions")
    return x


def merge_edges(told: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst): clusters to join by the merge decisions (pair_id, decision) whose records are still apart."""
    m = members.select("record_id", "cluster_id").distinct()
    at = lambda side: m.select(F.col("record_id").alias(side + "_record_id"), F.col("cluster_id").alias(side))
    p = pairs.select(F.col("id").alias("pair_id"), "left_record_id", "right_record_id")
    x = told.filter("decision = 'merge'").join(p, "pair_id").join(at("left"), "left_record_id").join(at("right"), "right_record_id")
    return x.filter("left <> right").select(F.least("left", "right").alias("src"), F.greatest("left", "right").alias("dst")).distinct()


def decided(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """Pairs with the status that their decision gives them."""
    status = F.when(F.col("decision") == "merge", "merged_by_review").when(F.col("decision") == "separate", "separate_by_review").when(F.col("decision") == "skip", "skipped_by_review")
    x = pairs.join(told.select(F.col("pair_id").alias("id"), "decision"), "id", "left")
    if "resolved_at" in x.columns:
        x = x.withColumn("resolved_at", F.when(status.isNotNull(), F.current_timestamp()).otherwise(F.col("resolved_at")))
    return x.withColumn("status", F.coalesce(status, F.col("status"))).drop("decision")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, new rows before old ones, later ``order`` before earlier."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = list(old.columns)
    top = both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct("_new", order)).alias("r"))
    return top.select("r.*")


# The figures of the stage.
REVIEW_METRICS = ("reviewed_pairs", "merged_by_review", "separate_by_review", "skipped_by_review", "pending_after_review", "final_clusters_after_review")


def counts(told: DataFrame) -> DataFrame:
    return told.groupBy("decision").agg(F.count("*").alias("n"))
