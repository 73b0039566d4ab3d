"""Exact and probable duplicates: identifier groups, blocking, pair scores, the rule cascade and cluster merges.

Records are rows of the records table with ``author_surnames`` as an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import scalars as S
from citeloom.operators.graph import connected_components
from citeloom.session import settle

KINDS = ("pmid", "doi", "pmcid")
NEVER = ("correction", "chapter")
FAR_YEARS = 99
#: Rows of one block that are joined at once.
PART = 2_000


def identifiers(records: DataFrame) -> DataFrame:
    """(id, cat, kind, value): the identifiers of each record, one a row."""
    e = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(S.strip(F.coalesce(k, F.lit("")))).alias("value")) for k in KINDS])
    return records.select("id", F.col("record_type_category").alias("cat"), F.explode(e).alias("e")).select("id", "cat", "e.kind", "e.value").filter("value <> ''")


def identifier_groups(records: DataFrame) -> DataFrame:
    """(kind, value, n, first_id) of the identifiers that several records carry."""
    return identifiers(records).groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def exact_edges(records: DataFrame) -> DataFrame:
    """(src, dst): star edges of every identifier, as connecting as all allowed pairs would be.

    Corrections and chapters link nothing.  Conference and journal records link directly only among their own kind, but any
    record of a third kind links with both, so one such record lets the whole group meet at its smallest id.
    """
    x = identifiers(records).filter(~F.coalesce(F.col("cat"), F.lit("other")).isin(*NEVER))
    third = ~F.coalesce(F.col("cat"), F.lit("other")).isin("conference", "journal")
    g = x.groupBy("kind", "value").agg(F.min("id").alias("low"), F.max(third).alias("bridged"), F.min(F.when(F.col("cat") == "conference", F.col("id"))).alias("low_c"), F.min(F.when(F.col("cat") == "journal", F.col("id"))).alias("low_j"))
    hub = F.when(F.col("bridged"), F.col("low")).when(F.col("cat") == "conference", F.col("low_c")).otherwise(F.col("low_j"))
    return x.join(g, ["kind", "value"]).select(hub.alias("src"), F.col("id").alias("dst")).filter("src <> dst").distinct()


def exact_clusters(records: DataFrame) -> DataFrame:
    """(id, root): every record with the smallest record of its exact cluster."""
    return connected_components(records.select("id"), exact_edges(records))


def canonical(records: DataFrame, roots: DataFrame, order: tuple[str, ...] = S.SOURCE_ORDER, preferred: DataFrame | None = None) -> DataFrame:
    """(root, canonical_record_id, n): the preferred, most complete, best sourced, smallest member of each group (id, root)."""
    r = records.select("id", "completeness_score", "source_db")
    x = roots.join(r, "id")
    kept = F.lit(1)
    if preferred is not None:
        x = x.join(preferred.select("id", F.lit(0).alias("kept")).distinct(), "id", "left")
        kept = F.coalesce("kept", F.lit(1))
    key = F.struct(kept, -F.coalesce(F.nanvl("completeness_score", F.lit(0.0)), F.lit(0.0)), S.source_rank(F.col("source_db"), order), F.col("id"))
    return x.groupBy("root").agg(F.min_by("id", key).alias("canonical_record_id"), F.count("*").alias("n"))


def numbered_rows(rows: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """``rows`` with 1..n in ``order``, counted range by range instead of in one window."""
    r = settle(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = r.groupBy("_part").count()
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return r.withColumn("_n", n).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def numbered(roots: DataFrame) -> DataFrame:
    """(cluster_id, root): clusters numbered 1..n by their smallest record."""
    return numbered_rows(roots.select("root").distinct(), [F.col("root")], "cluster_id").select("cluster_id", "root")


def rebuilt_clusters(records: DataFrame, roots: DataFrame, stage: str, preferred: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) tables for groups (id, root)."""
    ids = numbered(roots)
    clusters = canonical(records, roots, preferred=preferred).join(ids, "root").select("cluster_id", "canonical_record_id", F.lit(stage).alias("stage"), F.lit("active").alias("status"))
    members = roots.join(ids, "root").select("cluster_id", F.col("id").alias("record_id"), F.lit(stage).alias("merged_stage"))
    return clusters, members


def representatives(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """The canonical records of active clusters, with cluster_id."""
    c = clusters.filter("status = 'active'").select("cluster_id", F.col("canonical_record_id").alias("id"))
    return c.join(records, "id")


def _block_array() -> Column:
    """The blocks of a record: title and year, first author and title, journal, volume and page."""
    t, fa, j = (F.coalesce(c, F.lit("")) for c in ("title_norm", "first_author_norm", "journal_norm"))
    keys = F.array(
        F.when(t != "", F.concat_ws(":", F.lit("ty"), F.coalesce(F.when(F.col("year") != 0, F.col("year").cast("string")), F.lit("")), F.left(t, F.lit(40)))),
        F.when((t != "") & (fa != ""), F.concat_ws(":", F.lit("at"), fa, F.left(t, F.lit(28)))),
        F.when((j != "") & ~S.blank(F.col("volume")) & ~S.blank(F.col("start_page")), F.concat_ws(":", F.lit("jvp"), j, "volume", "start_page")),
    )
    return F.array_compact(keys)


def block_keys(reps: DataFrame) -> DataFrame:
    """(id, cluster_id, key): the blocks of each representative."""
    return reps.select("id", "cluster_id", F.explode(_block_array()).alias("key"))


PAIR_COLUMNS = ("title_norm", "author_surnames", "first_author_norm", "journal_norm", "page_key", "year", "doi", "pmid", "record_type_category")


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """(left_id, right_id): distinct pairs that share a block, smaller id first."""
    return _pairs_within(block_keys(reps).select("id", "key"), ["key"]).distinct()


def _pairs_within(rows: DataFrame, keys: list[str], part: int = PART) -> DataFrame:
    """(left_id, right_id) of rows (id, *keys) with equal keys.

    A key with more than ``part`` rows is divided into parts and joined as cells of two parts, so no task gets it whole.
    """
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / part).cast("int").alias("_g")).filter("_g > 1")
    m = rows.join(parts, keys, "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    m = m.withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_g")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    left = m.select(*keys, F.col("id").alias("left_id"), F.col("_p").alias("_i"), F.col("_o").alias("_j"))
    right = m.select(*keys, F.col("id").alias("right_id"), F.col("_o").alias("_i"), F.col("_p").alias("_j"))
    return left.join(right, [*keys, "_i", "_j"]).filter("left_id < right_id").select("left_id", "right_id")


def with_sides(pairs: DataFrame, records: DataFrame, columns: tuple[str, ...] = PAIR_COLUMNS) -> DataFrame:
    l = records.select(F.col("id").alias("left_id"), *[F.col(c).alias("l_" + c) for c in columns])
    r = records.select(F.col("id").alias("right_id"), *[F.col(c).alias("r_" + c) for c in columns])
    return pairs.join(l, "left_id").join(r, "right_id")


def flags(sides: DataFrame) -> DataFrame:
    """The comparisons of a pair that need no text similarity."""
    both = lambda c: ~S.blank(F.col("l_" + c)) & ~S.blank(F.col("r_" + c))
    equal = lambda c: both(c) & (F.col("l_" + c) == F.col("r_" + c))
    known = (F.coalesce("l_year", F.lit(0)) != 0) & (F.coalesce("r_year", F.lit(0)) != 0)
    cat = lambda s: F.coalesce(F.col(s + "_record_type_category"), F.lit("other"))
    none = F.array().cast("array<string>")
    overlap = S.author_jaccard(F.coalesce("l_author_surnames", none), F.coalesce("r_author_surnames", none))
    return sides.withColumns({
        "author_overlap": overlap, "first_author_match": equal("first_author_norm"), "journal_match": equal("journal_norm"), "page_match": equal("page_key"),
        "year_diff": F.when(known, F.abs(F.col("l_year") - F.col("r_year"))).otherwise(FAR_YEARS), "doi_conflict": both("doi") & (F.col("l_doi") != F.col("r_doi")),
        "pmid_conflict": both("pmid") & (F.col("l_pmid") != F.col("r_pmid")), "l_cat": cat("l"), "r_cat": cat("r"),
    }).withColumn("type_conflict", F.col("l_cat") != F.col("r_cat"))


def possible(x: DataFrame) -> DataFrame:
    """Without the pairs that no rule can accept whatever their titles; this keeps the costly title comparison small."""
    never = F.col("l_cat").isin(*NEVER) | F.col("r_cat").isin(*NEVER)
    some = F.col("first_author_match") | (F.col("author_overlap") >= 0.4) | F.col("journal_match") | F.col("page_match")
    return x.filter(~F.col("doi_conflict") & ~F.col("pmid_conflict") & ~never & (F.col("year_diff") <= 1) & some)


def recommendation(t: Column) -> Column:
    """The rule cascade; null discards a pair."""
    fa, jm, pm, ov, near = F.col("first_author_match"), F.col("journal_match"), F.col("page_match"), F.col("author_overlap"), F.col("year_diff") <= 1
    mixed = ((F.col("l_cat") == "conference") & (F.col("r_cat") == "journal")) | ((F.col("l_cat") == "journal") & (F.col("r_cat") == "conference"))
    never = F.col("l_cat").isin(*NEVER) | F.col("r_cat").isin(*NEVER)
    review, auto = F.lit("review"), F.lit("auto_merge")
    return (
        F.when(F.col("doi_conflict") | F.col("pmid_conflict"), None)
        .when(never, None)
        .when(mixed, F.when((t >= 92) & near & (fa | (ov >= 0.4)), review))
        .when((t >= 98) & near & (fa | (ov >= 0.8)) & (jm | pm | (ov >= 0.9)), auto)
        .when((t >= 95) & fa & near & (ov >= 0.5) & (jm | pm), auto)
        .when((t >= 88) & near & (fa | (ov >= 0.4) | jm | pm), review)
        .when(pm & jm & near & (t >= 80), review)
    )


def evaluated(x: DataFrame) -> DataFrame:
    """Adds title_score, year_score, composite_score and recommendation to pairs with flags.

    The rules see the scores as they are; what is kept of them is rounded.
    """
    x = x.withColumn("title_score", S.token_set_ratio(F.coalesce("l_title_norm", F.lit("")), F.coalesce("r_title_norm", F.lit(""))))
    bit = lambda c: F.when(F.col(c), 100.0).otherwise(0.0)
    years = F.greatest(F.lit(0.0), 100.0 - 20.0 * F.least(F.col("year_diff"), F.lit(5)))
    x = x.withColumns({"author_score": F.col("author_overlap") * 100.0, "year_score": years, "recommendation": recommendation(F.col("title_score"))})
    total = 0.6 * F.col("title_score") + 0.15 * F.col("author_score") + 0.1 * bit("journal_match") + 0.05 * bit("first_author_match") + 0.05 * bit("page_match") + 0.05 * years
    x = x.withColumn("composite_score", rounded(total, 2))
    return x.withColumns({"title_score": rounded(F.col("title_score"), 2), "author_score": rounded(F.col("author_score"), 2), "author_overlap": rounded(F.col("author_overlap"), 4)})


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many digits by its exact binary value, ties to even; for values below 1,000."""
    return F.format_number(x, digits).cast("double")


def kept_pairs(reps: DataFrame) -> DataFrame:
    """(left_id, right_id): the pairs of ``candidate_pairs`` that a rule could keep.

    Such a pair is at most a year apart and shares its first author, a surname, the journal or the page.  These go into the
    block key, so that a block of one much used title falls into small parts and its other pairs are never made.
    """
    none = F.array().cast("array<string>")
    part = lambda tag, c: F.when(~S.blank(F.col(c)), F.concat(F.lit(tag), F.col(c)))
    shared = F.concat(F.array(part("f:", "first_author_norm"), part("j:", "journal_norm"), part("p:", "page_key")), F.transform(F.coalesce("author_surnames", none), lambda n: F.concat(F.lit("s:"), n)))
    x = reps.filter("year is not null and year <> 0").select("id", "cluster_id", "year", F.array_distinct(F.array_compact(shared)).alias("shared"), "title_norm", "first_author_norm", "journal_norm", "volume", "start_page")
    k = x.select("id", "year", "shared", F.explode(_block_array()).alias("key"))
    # most blocks hold one record; these need no further keys
    k = k.join(k.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key", "left_semi")
    near = F.when(F.col("key").startswith("ty:"), F.array("year")).otherwise(F.array(F.col("year"), F.col("year") + 1))
    k = k.withColumn("y", F.explode(near)).withColumn("s", F.explode("shared")).select("id", "key", "y", "s")
    return _pairs_within(k, ["key", "y", "s"]).distinct()


def scored_pairs(reps: DataFrame) -> DataFrame:
    """The pairs of representatives that a rule keeps."""
    return evaluated(possible(flags(with_sides(kept_pairs(reps), reps)))).filter("recommendation is not null")


def merged(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): members (cluster_id, record_id) after their clusters were joined along edges (src, dst) of cluster ids.

    Edges to clusters that don't exist are left out.
    """
    ids = members.select(F.col("cluster_id").alias("id")).distinct()
    real = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    cc = connected_components(ids, real).select(F.col("id").alias("cluster_id"), F.col("root").alias("c"))
    x = members.join(cc, "cluster_id")
    low = x.groupBy("c").agg(F.min("record_id").alias("root"))
    return x.join(low, "c").select(F.col("record_id").alias("id"), "root")


# The figures of the stages.
EXACT_METRICS = ("raw_records", "exact_clusters", "merged_records", "pmid_groups", "doi_groups", "pmcid_groups")
FUZZY_METRICS = ("pre_fuzzy_clusters", "auto_merge_pairs", "manual_review_pending", "post_fuzzy_clusters")


def fuzzy_metrics(before: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of ``FUZZY_METRICS`` from the clusters before and after the merge and the pairs."""
    n = pairs.agg(F.count(F.when(F.col("status") == "auto_merged", 1)).alias("auto_merge_pairs"), F.count(F.when(F.col("status") == "pending", 1)).alias("manual_review_pending"))
    one = lambda t, name: t.agg(F.count("*").alias(name))
    return n.crossJoin(one(before, "pre_fuzzy_clusters")).crossJoin(one(after, "post_fuzzy_clusters")).select(*FUZZY_METRICS)  # three rows of one


def fuzzy(records: DataFrame, clusters: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, members, pairs) after the probable duplicates were joined; needs clusters of the exact stage."""
    if clusters.isEmpty():
        raise RuntimeError("no clusters; find exact duplicates first")
    reps = representatives(clusters, records)
    pairs = settle(scored_pairs(reps), "pairs")
    own = members.select("cluster_id", "record_id")
    at = lambda side: own.select(F.col("record_id").alias(side + "_id"), F.col("cluster_id").alias(side + "_cluster_id"))
    auto = pairs.filter("recommendation = 'auto_merge'").join(at("left"), "left_id").join(at("right"), "right_id")
    roots = settle(merged(own, auto.select(F.col("left_cluster_id").alias("src"), F.col("right_cluster_id").alias("dst"))), "merged")
    c2, m2 = rebuilt_clusters(records, roots, "fuzzy_auto")
    return c2, m2, final_pairs(pairs, m2)


def final_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs with their clusters after the merge and a status; pairs whose records came together on the way count as merged."""
    at = lambda side: members.select(F.col("record_id").alias(side + "_id"), F.col("cluster_id").alias(side + "_cluster_id"))
    x = pairs.join(at("left"), "left_id", "left").join(at("right"), "right_id", "left")
    together = F.coalesce(F.col("left_cluster_id") == F.col("right_cluster_id"), F.lit(False))
    auto = (F.col("recommendation") == "auto_merge") | together
    x = x.withColumn("pair_key", S.pair_key(F.col("left_id"), F.col("right_id"))).withColumn("recommendation", F.when(auto, "auto_merge").otherwise(F.col("recommendation")))
    x = x.withColumn("status", F.when(F.col("recommendation") == "auto_merge", "auto_merged").otherwise("pending")).withColumn("created_at", F.current_timestamp())
    return x.withColumn("resolved_at", F.when(F.col("status") != "pending", F.col("created_at"))).select(
        "pair_key", F.col("left_id").alias("left_record_id"), F.col("right_id").alias("right_record_id"), "left_cluster_id", "right_cluster_id", "title_score", "author_score", "author_overlap",
        "first_author_match", "journal_match", "year_diff", "page_match", "doi_conflict", "pmid_conflict", "type_conflict", "composite_score", "recommendation", "status", "created_at", "resolved_at",
    )
