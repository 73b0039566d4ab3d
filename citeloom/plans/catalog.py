"""Registry of the general queries and of the SQL that states each one independently."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import scalars as S
from citeloom.operators import golden, linkage, report, review, sampling, state
from citeloom.plans import sql
from citeloom.session import settle, table
from citeloom.sources import exports
from citeloom.sources.profiles import BUILT_IN, infer_profile_column

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SAMPLE, SEED = 25, 11


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


def bib(spark: SparkSession, d: str) -> DataFrame:
    """The records with normalized identifiers and authors as an array."""
    r = table(spark, d, "records")
    return r.withColumns({"doi": S.normalize_doi(F.col("doi")), "pmid": S.digits(F.col("pmid")), "pmcid": F.lower(S.strip(S.or_empty(F.col("pmcid")))), "authors": F.from_json("authors_json", "array<string>")})


def texts(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("doc_kind") == kind).select(F.col("doc_id").alias("path"), "text")


def parsed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return exports.parse(texts(spark, d, kind), BUILT_IN["standard_ris" if kind == "ris" else "pubmed_nbib"])


# ---- sources


@query
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", exports.content_hash(F.encode("text", "UTF-8")).alias("file_hash"))


@query
def text_line_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", S.normalize_lines(F.col("text")).alias("text"))


@query
def infer_profile(spark, d):
    return table(spark, d, "source_files").select("id", infer_profile_column(F.col("path")).alias("profile"))


@query
def ris_record_count(spark, d):
    return exports.record_count(texts(spark, d, "ris"), BUILT_IN["standard_ris"])


@query
def ris_parse_entries(spark, d):
    return exports.raw_entries(parsed(spark, d, "ris"))


@query
def nbib_parse_entries(spark, d):
    return exports.raw_entries(parsed(spark, d, "nbib"))


@query
def ris_parse_records(spark, d):
    return parsed(spark, d, "ris").select("path", "rec", F.size("entries").alias("n_entries"), (F.size("warnings") > 0).alias("unfinished"))


@query
def nbib_parse_records(spark, d):
    return parsed(spark, d, "nbib").select("path", "rec", F.size("entries").alias("n_entries"))


@query
def raw_fields_explode(spark, d):
    e = exports.raw_entries(parsed(spark, d, "ris")).unionByName(exports.raw_entries(parsed(spark, d, "nbib")))
    return e.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query
def observed_raw_tags(spark, d):
    e = exports.raw_entries(parsed(spark, d, "ris")).unionByName(exports.raw_entries(parsed(spark, d, "nbib")))
    return report.observed_tags(e)


@query
def first_non_empty(spark, d):
    return parsed(spark, d, "ris").select("path", "rec", S.first_non_empty(F.col("fields"), ["TI", "T1"]).alias("title"))


@query
def all_values(spark, d):
    return parsed(spark, d, "nbib").select("path", "rec", F.array_join(S.all_values(F.col("fields"), ["AU", "FAU"]), "|").alias("authors"))


@query
def extract_identifier(spark, d):
    f = F.col("fields")
    return parsed(spark, d, "nbib").select("path", "rec", S.extract_identifier(f, ["PMID"], S.digits).alias("pmid"), S.extract_identifier(f, ["AID", "LID"], S.normalize_doi).alias("doi"))


@query
def source_record_id(spark, d):
    """The ids of all texts by every profile of their format."""
    one = lambda p: exports.parse(texts(spark, d, p.format), p).select(F.lit(p.name).alias("profile"), "path", "rec", exports.source_record_id(F.col("fields"), p).alias("source_record_id"))
    return reduce(DataFrame.unionByName, map(one, BUILT_IN.values()))


@query
def normalize_record(spark, d):
    """The records of all texts by every profile of their format."""
    one = lambda p: exports.normalized(exports.parse(texts(spark, d, p.format), p), p).withColumn("profile", F.lit(p.name))
    x = reduce(DataFrame.unionByName, map(one, BUILT_IN.values())).drop("source_file")
    return x.withColumns({c: F.array_join(c, "|") for c in ("authors", "author_surnames", "keywords", "warnings")})


# ---- scalars


@query
def normalize_doi(spark, d):
    return table(spark, d, "records").select("id", S.normalize_doi(F.col("doi")).alias("doi"))


@query
def normalize_text(spark, d):
    return table(spark, d, "records").select("id", S.normalize_text(F.col("title")).alias("title_norm"), S.normalize_text(F.col("journal")).alias("journal_norm"), S.normalize_text(F.col("start_page")).alias("page_key"))


@query
def author_surnames(spark, d):
    x = table(spark, d, "records").select("id", S.author_surnames(F.from_json("authors_json", "array<string>")).alias("s"))
    return x.select("id", F.coalesce(F.array_join("s", "|"), F.lit("")).alias("surnames"))


@query
def parse_year(spark, d):
    return table(spark, d, "records").select("id", S.parse_year(F.col("title")).alias("year"))


@query
def parse_pages(spark, d):
    p = S.parse_pages(F.concat_ws("-", "start_page", "end_page"))
    return table(spark, d, "records").select("id", p.alias("p")).select("id", F.col("p.start").alias("start_page"), F.col("p.end").alias("end_page"))


@query
def record_type_category(spark, d):
    return table(spark, d, "records").select("id", S.record_type_category(F.col("record_type")).alias("category"))


@query
def ris_type(spark, d):
    return table(spark, d, "records").select("id", S.ris_type(F.col("record_type")).alias("ris_type"))


@query
def completeness_score(spark, d):
    c = [F.col(x) for x in ("doi", "pmid", "pmcid", "title", "year", "author_surnames", "abstract", "journal", "start_page", "end_page", "url")]
    return bib(spark, d).select("id", S.completeness_score(*c).alias("score"))


# ---- exact duplicates


def roots(spark, d):
    return linkage.exact_clusters(bib(spark, d))


@query
def identifier_groups(spark, d):
    return linkage.identifier_groups(bib(spark, d))


@query
def exact_edges(spark, d):
    return linkage.exact_edges(bib(spark, d))


@query
def exact_clusters(spark, d):
    return roots(spark, d)


@query
def exact_metrics(spark, d):
    x = roots(spark, d)
    g = linkage.identifier_groups(bib(spark, d)).agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k + "_groups") for k in linkage.KINDS])
    m = x.agg(F.count("*").alias("raw_records"), F.countDistinct("root").alias("exact_clusters")).withColumn("merged_records", F.col("raw_records") - F.col("exact_clusters"))
    return m.crossJoin(g).select(*linkage.EXACT_METRICS)  # two rows of one


@query
def canonical_record(spark, d):
    return linkage.canonical(bib(spark, d), roots(spark, d))


@query
def rebuild_cluster_ids(spark, d):
    return linkage.numbered(roots(spark, d))


@query
def cluster_members_list(spark, d):
    m = table(spark, d, "cluster_members").select("cluster_id", "record_id").distinct()
    return m.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("record_id")), lambda x: x.cast("string")), ",").alias("members"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.canonical(bib(spark, sf_dir), roots(spark, sf_dir))


# ---- probable duplicates, each record standing for itself at first


def singles(spark, d):
    """(clusters, members) of one record each."""
    r = bib(spark, d).select("id")
    clusters = r.select(F.col("id").alias("cluster_id"), F.col("id").alias("canonical_record_id"), F.lit("exact").alias("stage"), F.lit("active").alias("status"))
    return clusters, r.select(F.col("id").alias("cluster_id"), F.col("id").alias("record_id"))


def reps(spark, d):
    return linkage.representatives(singles(spark, d)[0], bib(spark, d))


def members(spark, d):
    return table(spark, d, "cluster_members").join(table(spark, d, "clusters").filter("status = 'active'").select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "record_id").distinct()


@query
def records_scan(spark, d):
    c = table(spark, d, "clusters").filter("status = 'active'").select(F.col("canonical_record_id").alias("id"))
    return bib(spark, d).join(c, "id", "left_semi").select("id", "source_db", "title", "doi", "pmid")


@query
def cluster_representatives(spark, d):
    return linkage.representatives(table(spark, d, "clusters"), bib(spark, d)).select("cluster_id", "id", "title_norm", "year")


@query
def candidate_pairs(spark, d):
    return linkage.candidate_pairs(reps(spark, d)).withColumn("pair_key", S.pair_key(F.col("left_id"), F.col("right_id")))


@query
def author_jaccard(spark, d):
    r = reps(spark, d)
    x = linkage.flags(linkage.with_sides(linkage.candidate_pairs(r), r))
    return x.select("left_id", "right_id", F.floor(F.col("author_overlap") * 10000 + 0.5).cast("long").alias("overlap"))


FLAGS = ("first_author_match", "journal_match", "page_match", "year_diff", "doi_conflict", "pmid_conflict", "type_conflict")
SCORES = ("title_score", "author_score", "author_overlap", "year_score", "composite_score")


@query
def evaluate_pair(spark, d):
    r = reps(spark, d)
    return linkage.evaluated(linkage.flags(linkage.with_sides(linkage.candidate_pairs(r), r))).select("left_id", "right_id", *FLAGS, *SCORES, "recommendation")


@query
def token_set_ratio(spark, d):
    r = reps(spark, d)
    x = linkage.possible(linkage.flags(linkage.with_sides(linkage.candidate_pairs(r), r)))
    return linkage.evaluated(x).select("left_id", "right_id", "title_score")


@query
def recommendation(spark, d):
    return linkage.scored_pairs(reps(spark, d)).select("left_id", "right_id", "recommendation")


def fuzzy(spark, d):
    return linkage.fuzzy(bib(spark, d), *singles(spark, d))


@query
def cluster_merge(spark, d):
    return fuzzy(spark, d)[1].select("cluster_id", "record_id")


@query
def candidate_pairs_final(spark, d):
    return fuzzy(spark, d)[2].select("pair_key", "left_record_id", "right_record_id", "left_cluster_id", "right_cluster_id", *[c for c in SCORES if c != "year_score"], *FLAGS, F.col("resolved_at").isNotNull().alias("resolved"), "recommendation", "status")


@query
def fuzzy_metrics(spark, d):
    c, _, p = fuzzy(spark, d)
    return linkage.fuzzy_metrics(singles(spark, d)[0], c, p)


# ---- review


def pairs(spark, d):
    """Stored pairs with both record ids, from the columns or the key."""
    p = table(spark, d, "candidate_pairs")
    k = F.split(F.regexp_replace("pair_key", r"\s", ""), ":")
    a, b = F.try_element_at(k, F.lit(1)).try_cast("long"), F.try_element_at(k, F.lit(2)).try_cast("long")
    l, r = F.col("left_record_id"), F.col("right_record_id")
    return p.withColumns({"left_record_id": F.coalesce(l, F.when(r == a, b).otherwise(a)), "right_record_id": F.coalesce(r, F.when(l == a, b).otherwise(F.coalesce(b, a)))})


def told(spark, d):
    word = F.when(F.col("status") == "merged_by_review", " Merge ").when(F.col("status") == "separate_by_review", "separate").when(F.col("status") == "skipped_by_review", "SKIP").otherwise("")
    return review.decisions(table(spark, d, "candidate_pairs").select(F.col("id").alias("pair_id"), word.alias("decision"), "resolved_at"))


@query
def review_decisions(spark, d):
    return told(spark, d).select("pair_id", "decision")


@query
def review_upsert(spark, d):
    p = table(spark, d, "candidate_pairs").select(F.regexp_replace("pair_key", r"\s", "").alias("pair_key"), "id", "status").filter("pair_key is not null")
    return review.upsert(p.filter("status in ('pending', 'auto_merged')"), p.filter("status not in ('pending', 'auto_merged')"), ["pair_key"], "id")


@query
def review_merge_edges(spark, d):
    return review.merge_edges(told(spark, d), pairs(spark, d), members(spark, d))


@query
def review_metrics(spark, d):
    return review.counts(told(spark, d))


@query
def pending_pairs(spark, d):
    return review.pending(pairs(spark, d), members(spark, d)).agg(F.count("*").alias("n"))


@query
def review_queue(spark, d):
    q = review.queue(pairs(spark, d), bib(spark, d).withColumn("authors", F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "; ")), members(spark, d))
    return q


# ---- golden records


def consolidated(spark, d, **how):
    return golden.consolidated(table(spark, d, "clusters"), table(spark, d, "cluster_members"), bib(spark, d), **how)


@query
def cluster_consolidated(spark, d):
    x = consolidated(spark, d)
    return x.select("cluster_id", "canonical_record_id", "title", "abstract", "journal", "doi", "pmid", "url", F.array_join("source_members", "; ").alias("source_members"), "member_count")


@query
def keyword_union(spark, d):
    x = consolidated(spark, d, unite_keywords=True)
    return x.select("cluster_id", F.coalesce(F.array_join("keywords", "|"), F.lit("")).alias("keywords"))


@query
def export_csv_rows(spark, d):
    return golden.csv_rows(consolidated(spark, d))


@query
def export_ris_text(spark, d):
    return golden.ris_text(consolidated(spark, d))


# ---- report


@query
def summary_counts(spark, d):
    return report.summary_counts(**{t: table(spark, d, t) for t in ("records", "source_files", "clusters", "candidate_pairs")})


@query
def source_breakdown(spark, d):
    return report.source_breakdown(table(spark, d, "records"))


@query
def record_type_distribution(spark, d):
    return report.type_distribution(table(spark, d, "records"))


@query
def encoding_summary(spark, d):
    return report.encoding_summary(table(spark, d, "source_files"))


@query
def encoding_by_file(spark, d):
    return report.encoding_by_file(table(spark, d, "source_files"))


@query
def missing_key_fields(spark, d):
    return report.missing_fields(bib(spark, d))


# ---- state


@query
def incremental_anti_import(spark, d):
    f = table(spark, d, "source_files").select("id", "path", "file_hash", "imported_at")
    return state.unseen(f.filter("imported_at >= '2024-01-01'"), f.filter("imported_at < '2024-01-01'")).select("id", "path")


@query
def cascade_delete(spark, d):
    """How much of each file's records, memberships and pairs is left after the files that repeat an earlier file's bytes are gone."""
    f = table(spark, d, "source_files")
    first = f.groupBy("file_hash").agg(F.min("id").alias("id"))
    gone = f.join(first, "id", "left_anti")
    records = table(spark, d, "records").select("id", "source_file_id")
    left = state.without(f, gone, "id", {"records": (records, "source_file_id")})
    lost = records.join(gone.select(F.col("id").alias("source_file_id")), "source_file_id", "left_semi").select("id")
    m = state.without(records, lost, "id", {"members": (table(spark, d, "cluster_members").select("cluster_id", "record_id"), "record_id")})["members"]
    rows = lambda t, a, b: t.select(F.lit(a[0]).alias("name"), F.col(a[1]).alias("id"), F.col(b).alias("parent_id"))
    return rows(left[""], ("file", "id"), "id").unionByName(rows(left["records"], ("record", "id"), "source_file_id")).unionByName(rows(m, ("member", "record_id"), "cluster_id"))


@query
def stage_metrics_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return state.latest(e, "user_id", "event_id")


# ---- samples


@query
def sample_records(spark, d):
    return sampling.sample(table(spark, d, "records").select("id", "title"), SAMPLE, SEED, ["id"])


@query
def sample_render(spark, d):
    s = sampling.sample(table(spark, d, "records").select("id", F.coalesce("abstract", F.lit("")).alias("raw_text")), SAMPLE, SEED, ["id"])
    return spark.createDataFrame([(sampling.rendered(s),)], "text string")


@query
def stream_import(spark, d):
    """Files met by the incremental import when the documents come as a stream."""
    from citeloom.streaming import ingest

    return ingest.counted_stream(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)


__all__ = ["flagship", "queries", "oracle_sql", "settle"]
