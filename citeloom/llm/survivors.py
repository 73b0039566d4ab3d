"""The best representative of each group of duplicates and, field by field, the value to keep.

The representative is the member with the best (completeness, trust, recency, smallest id).

Field values are chosen by currency reasoning.  A value has a form from a small fixed set: whether it is in capitals,
carries trailing punctuation, a resolver, stray blanks or characters beyond ASCII.  Within every group the forms of a field
are ordered by the time they were first met on timestamped rows; the transitions between forms that follow each other
directly, counted over all groups, teach which form precedes which.  In a group this gives a partial order of its different
values: stamped values by their latest time, values met only on rows without a time by the learnt precedence of their forms.
Values with a later one in the group fall away, and of the latest values the one on the best member is kept.

All of it is aggregation, first by (group, field, value), then by (group, field, form): of the values of one form only the
latest stamped one and the best one without a time can be kept, so a group that holds a third of all rows is reduced where
its rows are, and what is left of it is at most 2 * ``FORMS`` rows a field.

Cases: null and NaN completeness rank lowest; an unlisted source ranks after all listed ones; null times rank last; members
listed twice count once; members that aren't records are left out; a group with one member or none has no row; blank values
are never kept; an empty table gives an empty result; clashing extra columns are ignored, since only named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeloom.session import settle

#: The fields that a surviving record takes value by value.
FIELDS = ("title", "abstract", "journal", "volume", "issue", "start_page", "end_page", "doi", "pmid", "pmcid", "language", "url", "record_type")
FORMS = 64
#: A learnt precedence needs this share of the transitions between two forms.
LEAST_SHARE = 0.5


def ranked_members(clusters: DataFrame, members: DataFrame, records: DataFrame, priority: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """Members of active clusters with ``rank``, a struct of which the largest is the best member."""
    active = clusters.filter(F.col("status") == "active").select("cluster_id", F.col("canonical_record_id").alias("canonical")).distinct()
    m = members.select("cluster_id", F.col("record_id").alias("rid")).distinct()
    r = records.select(F.col("id").alias("rid"), "completeness_score", F.lower(F.trim("source_db")).alias("db"), "created_at", *fields)
    p = priority.groupBy(F.lower(F.trim("source_db")).alias("db")).agg(F.min("trust_rank").alias("trust"))
    x = active.join(m, "cluster_id").join(r, "rid").join(p, "db", "left")
    score = F.when(F.isnan("completeness_score"), None).otherwise(F.col("completeness_score"))
    # in an ascending struct null sorts lowest
    rank = F.struct(score.alias("score"), (-F.coalesce("trust", F.lit(2**31 - 1))).alias("trust"), F.col("created_at").alias("at"), (-F.col("rid")).alias("neg_id"))
    return x.select("cluster_id", "canonical", F.col("rid").alias("record_id"), rank.alias("rank"), *fields)


def representatives(clusters: DataFrame, members: DataFrame, records: DataFrame, priority: DataFrame) -> DataFrame:
    """(cluster_id, canonical, record_id, n): the record that should stand for each active cluster of two or more."""
    x = ranked_members(clusters, members, records, priority)
    best = x.groupBy("cluster_id", "canonical").agg(F.max("rank").alias("best"), F.count("*").alias("n"))
    return best.filter("n > 1").select("cluster_id", "canonical", (-F.col("best.neg_id")).alias("record_id"), "n")


def wrong_representatives(clusters: DataFrame, members: DataFrame, records: DataFrame, priority: DataFrame) -> DataFrame:
    """(cluster_id, record_id) where the stored canonical record is another one or none."""
    r = representatives(clusters, members, records, priority)
    return r.filter(~F.col("canonical").eqNullSafe(F.col("record_id"))).select("cluster_id", "record_id")


def form(v: Column) -> Column:
    """The form of a value, below ``FORMS``."""
    bit = lambda c, n: F.when(c, n).otherwise(0)
    return (
        bit((F.upper(v) == v) & (F.lower(v) != v), 1)
        + bit(v.rlike(r"[.,;:]\s*$"), 2)
        + bit(v.rlike(r"(?i)^\s*(https?://|doi|info:)"), 4)
        + bit(v.rlike(r"^\s|\s$|\s\s"), 8)
        + bit(v.rlike(r"[^\x00-\x7F]"), 16)
        + bit((F.lower(v) == v) & (F.upper(v) != v), 32)
    )


def field_values(clusters: DataFrame, members: DataFrame, records: DataFrame, priority: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(cluster_id, field, form, first_at, value, last_at, best): per group, field and form the latest stamped value and the
    best one that is never stamped.  ``first_at`` is that of the form."""
    x = ranked_members(clusters, members, records, priority, fields)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    y = x.select("cluster_id", "rank", F.explode(pairs).alias("e")).select("cluster_id", "rank", "e.field", "e.value").filter("value is not null and trim(value) <> ''")
    y = y.groupBy("cluster_id", "field", "value").agg(F.max("rank").alias("best"), F.min("rank.at").alias("first_at"), F.max("rank.at").alias("last_at"))
    whole, stamped = F.struct("value", "last_at", "best"), F.col("last_at").isNotNull()
    z = y.withColumn("form", form(F.col("value"))).groupBy("cluster_id", "field", "form").agg(
        F.min("first_at").alias("first_at"),
        F.array(F.max_by(whole, F.when(stamped, F.struct("last_at", "best"))), F.max_by(whole, F.when(~stamped, F.col("best")))).alias("kept"),
    )
    return z.select("cluster_id", "field", "form", "first_at", F.explode("kept").alias("k")).filter("k is not null").select("cluster_id", "field", "form", "first_at", "k.*")


def precedence(values: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(field, earlier, later): forms of which the later one usually follows, learnt over all groups. At most FORMS^2 a field."""
    w = W.partitionBy("cluster_id", "field").orderBy("first_at", "form")
    forms = values.groupBy("cluster_id", "field", "form").agg(F.min("first_at").alias("first_at")).filter("first_at is not null")
    t = forms.select("field", "form", F.lag("form").over(w).alias("before"), F.lag("first_at").over(w).alias("t0"), "first_at")
    t = t.filter("before is not null and t0 < first_at").groupBy("field", F.col("before").alias("earlier"), F.col("form").alias("later")).agg(F.count("*").alias("n"))
    back = t.select("field", F.col("earlier").alias("later"), F.col("later").alias("earlier"), F.col("n").alias("m"))
    return t.join(back, ["field", "earlier", "later"], "left").filter(F.col("n") > least_share * (F.col("n") + F.coalesce("m", F.lit(0)))).select("field", "earlier", "later")


def surviving_values(clusters: DataFrame, members: DataFrame, records: DataFrame, priority: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(cluster_id, field, value): the value that each active cluster of two or more keeps for each field it has."""
    v = settle(field_values(clusters, members, records, priority, fields), "values")
    # a set of forms is a long with one bit for each
    bit, free = lambda c: F.expr(f"shiftleft(1L, cast({c} as int))"), F.col("last_at").isNull()
    after = precedence(v).groupBy("field", F.col("earlier").alias("form")).agg(F.bit_or(bit("later")).alias("after"))
    none = F.lit(0).cast("long")
    group = v.groupBy("cluster_id", "field").agg(F.max("last_at").alias("top"), F.bit_or(bit("form")).alias("all"), F.coalesce(F.bit_or(F.when(free, bit("form"))), none).alias("free"))
    x = v.join(group, ["cluster_id", "field"]).join(F.broadcast(after), ["field", "form"], "left").withColumn("after", F.coalesce("after", none))
    learnt = F.col("after").bitwiseAND(F.when(free, F.col("all")).otherwise(F.col("free"))) != 0
    newest = F.coalesce(F.col("last_at") == F.col("top"), F.lit(False))
    x = x.withColumn("latest", ~learnt & (free | newest))
    # precedence that is learnt can be circular; where a group would lose all, its newest stamped values stay
    best = x.groupBy("cluster_id", "field").agg(F.max_by("value", F.struct("latest", (~F.col("latest") & newest).alias("newest"), "best")).alias("value"))
    many = representatives(clusters, members, records, priority).select("cluster_id")
    return best.join(many, "cluster_id", "left_semi").select("cluster_id", "field", "value")
