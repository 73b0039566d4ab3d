"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import matching

    return matching.matches(table(spark, d, "records")).select("left_record_id", "right_record_id")


@query
def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import matching

    m = matching.matches(table(spark, d, "records"))
    return m.withColumn("confidence", F.round("confidence", 4))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_forms(spark, d).select("record_id", "field_name")


@query
def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import encodings, lookalikes

    records = table(spark, d, "records")
    # the exclusion concerns the fields of this query alone
    return lookalikes.forms(records, encodings.damaged(records, table(spark, d, "source_files"), fields=("title",)))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import groups

    return groups.grouped(table(spark, d, "candidate_pairs"))


SQL["p3_found"] = r"""
with recursive k as (
  select left_record_id l, right_record_id r, string_split(regexp_replace(pair_key, '\s', '', 'g'), ':') p
  from candidate_pairs where trim(status) in ('auto_merged', 'merged_by_review')),
x as (select l, r, try_cast(p[1] as bigint) k0, try_cast(p[2] as bigint) k1 from k),
y as (select coalesce(l, case when r is null then k0 when k0 = r then k1 else coalesce(k0, k1) end) l,
             coalesce(r, case when l is null then k1 when k0 = l then k1 else coalesce(k0, k1) end) r from x),
e as (select distinct l a, r b from y where l <> r union select distinct r, l from y where l <> r),
cc(v, root) as (select a, a from e union select e.b, cc.root from cc join e on e.a = cc.v)
select v as record_id, min(root) as group_id from cc group by v
"""


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import copies

    return copies.collapse(table(spark, d, "records"))


_P6_KEYS = r"""
with n as (select id, regexp_replace(regexp_replace(lower(doi), '[\s\x{00a0}\x{2000}-\x{200d}\x{202f}\x{3000}\x{feff}]+', '', 'g'), '\[doi\]', '', 'g') b,
  regexp_replace(upper(lower(title)), '[^\p{L}\p{N}]', '', 'g') t from records),
k as (select id, t, regexp_replace(regexp_extract(b, '(10\.[0-9]{4,9}/.+)$', 1), '[.,;:)\]}>"'']+$', '') d from n),
f as (select id, d, t from k where t <> '' and regexp_matches(d, '^10\.[0-9]{4,9}/.'))
"""
SQL["p6_found"] = _P6_KEYS.rstrip() + """,
g as (select d, t, min(id) m from f group by d, t having count(*) > 1)
select f.id as record_id, g.m as group_id from f join g using (d, t)
"""


@query
def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import copies

    return copies.representatives(table(spark, d, "records"))


SQL["p6_copies"] = _P6_KEYS + "select min(id) as record_id, count(*) as copies from f group by d, t"


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import tokens

    return tokens.encode(table(spark, d, "documents"))


@query
def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import packing, tokens

    return packing.pack(packing.settled_sizes(tokens.count(table(spark, d, "documents"))))


@query
def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import packing

    return packing.fill_report(p9_containers(spark, d))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import names

    return names.variants(table(spark, d, "records"), table(spark, d, "name_authority"))


def _cluster_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, d, t) for t in ("clusters", "cluster_members", "records", "source_priority"))  # type: ignore[return-value]


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import survivors

    return survivors.wrong_representatives(*_cluster_tables(spark, d))


SQL["p5_found"] = """
with m as (select distinct c.cluster_id, c.canonical_record_id canon, cm.record_id
           from clusters c join cluster_members cm using (cluster_id) where c.status = 'active'),
p as (select lower(trim(source_db)) db, min(trust_rank) trust from source_priority group by 1),
x as (select m.*, row_number() over (partition by m.cluster_id order by
        case when r.completeness_score is null or isnan(r.completeness_score) then 1 else 0 end, r.completeness_score desc,
        coalesce(p.trust, 2147483647), r.created_at desc nulls last, r.id) rn, count(*) over (partition by m.cluster_id) n
      from m join records r on r.id = m.record_id left join p on p.db = lower(trim(r.source_db)))
select cluster_id, record_id from x where rn = 1 and n > 1 and canon is distinct from record_id
"""


@query
def p5_values(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import survivors

    return survivors.surviving_values(*_cluster_tables(spark, d))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import spans

    return spans.sharing_pairs(table(spark, d, "documents"))


@query
def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import spans

    return spans.shared_part(table(spark, d, "documents"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import encodings

    return encodings.damaged(table(spark, d, "records"), table(spark, d, "source_files"))


@query
def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.llm import encodings

    return encodings.restored(table(spark, d, "records"), table(spark, d, "source_files"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
