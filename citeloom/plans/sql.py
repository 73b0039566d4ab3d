"""The general queries in SQL, stated over the same tables and independent of the engine's code."""

from __future__ import annotations

import random

WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


LINES = "regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '^\\x{feff}', '')"

BIB = f"""
bib as (select r.* exclude (doi, pmid, pmcid),
  lower(regexp_replace(regexp_extract(coalesce(doi, ''), '(?i)(10\\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+)', 1), '[.;,)]+$', '')) doi,
  regexp_replace(coalesce(pmid, ''), '[^\\p{{Nd}}]', '', 'g') pmid, lower({strip("coalesce(pmcid, '')")}) pmcid, from_json(authors_json, '["VARCHAR"]') authors from records r)
"""

RIS = rf"""
l as (select doc_id path, unnest(string_split_regex({LINES}, '[\n\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]')) line, generate_subscripts(string_split_regex({LINES}, '[\n\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), 1) i
      from documents where doc_kind = 'ris'),
t as (select *, case when regexp_matches(line, '^[A-Z0-9]{{2}}  - ?[^\n]*$') then line[1:2] end tag from l),
r as (select *, sum(case when tag = 'TY' then 1 else 0 end) over (partition by path order by i) rec from t),
c as (select *, coalesce(sum(case when tag = 'ER' then 1 else 0 end) over (partition by path, rec order by i rows between unbounded preceding and 1 preceding), 0) closed from r where rec > 0),
e as (select *, sum(case when tag is not null then 1 else 0 end) over (partition by path, rec order by i) ent,
        {strip("case when tag is not null then regexp_replace(line[6:], '^ ', '') else line end")} part from c where closed = 0),
entries as (select path, rec, row_number() over (partition by path order by rec, ent) position, max(tag) tag, coalesce(string_agg(part, ' ' order by i) filter (where part <> ''), '') as value
            from e group by path, rec, ent)
"""

NBIB = rf"""
l as (select doc_id path, unnest(string_split_regex({LINES}, '[\n\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]')) line, generate_subscripts(string_split_regex({LINES}, '[\n\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), 1) i
      from documents where doc_kind = 'nbib'),
t as (select *, {strip("line")} = '' blank, case when regexp_matches(line, '^[A-Z0-9]{{2,4}}\s*-\s?[^\n]*$') then regexp_extract(line, '^([A-Z0-9]{{2,4}})', 1) end tag from l),
r as (select *, sum(case when blank or tag = 'PMID' then 1 else 0 end) over (partition by path order by i) seg from t),
c as (select *, sum(case when tag is not null then 1 else 0 end) over (partition by path, seg order by i) ent,
        {strip(r"case when tag is not null then regexp_replace(line, '^[A-Z0-9]{2,4}\s*-\s?', '') else line end")} part from r),
d as (select *, dense_rank() over (partition by path order by seg) rec from c where ent > 0),
entries as (select path, rec, row_number() over (partition by path order by rec, ent) position, max(tag) tag, coalesce(string_agg(part, ' ' order by i) filter (where part <> ''), '') as value
            from d group by path, rec, ent)
"""


def both(select: str) -> str:
    ris = RIS.replace("entries as", "ris_entries as")
    nbib = NBIB
    for name in ("l", "t", "r", "c", "d"):
        nbib = nbib.replace(f"\n{name} as (", f"\nn{name} as (").replace(f" from {name} ", f" from n{name} ").replace(f" from {name})", f" from n{name})").replace(f" from {name} where", f" from n{name} where")
    nbib = nbib.replace("entries as", "nbib_entries as")
    return f"with {ris}, {nbib}, entries as (select * from ris_entries union all select * from nbib_entries) {select}"


CAT = """case when t like '%erratum%' or t like '%correction%' then 'correction' when t like '%chap%' then 'chapter'
  when t like '%conference%' or t like '%cpaper%' or t like '%abstract%' then 'conference' when t like '%journal%' or t like '%article%' or t like '%jour%' then 'journal' when t like '%gen%' then 'generic' else 'other' end"""

IDS = """
ids as (select id, coalesce(record_type_category, 'other') cat, 'pmid' kind, pmid as value from bib where pmid <> '' union all select id, coalesce(record_type_category, 'other'), 'doi', doi from bib where doi <> ''
        union all select id, coalesce(record_type_category, 'other'), 'pmcid', pmcid from bib where pmcid <> '')
"""
# all allowed pairs of a group, not its star
LINKS = """
links as (select distinct a.id src, b.id dst from ids a join ids b on a.kind = b.kind and a.value = b.value and a.id <> b.id
  where a.cat not in ('correction', 'chapter') and b.cat not in ('correction', 'chapter') and not (a.cat in ('conference', 'journal') and b.cat in ('conference', 'journal') and a.cat <> b.cat)),
cc(v, root) as (select id, id from bib union select l.dst, cc.root from links l join cc on l.src = cc.v),
roots as (select v id, min(root) root from cc group by v)
"""
EXACT = f"with recursive {BIB}, {IDS}, {LINKS}"

RANK = "case source_db when 'PubMed' then 0 when 'Embase' then 1 when 'WoS' then 2 when 'RIS' then 3 else 4 end"
SCORE = "coalesce(case when isnan(completeness_score) then 0 else completeness_score end, 0)"

def scored(pairs: str, suffix: str = "") -> str:
    """The title scores of a table of pairs."""
    chain = SCORING
    for name in ("words", "parts", "strs", "lcs", "sized", "scored"):
        chain = chain.replace(f"{name} as (", f"{name}{suffix} as (").replace(f" from {name})", f" from {name}{suffix})")
    return chain.replace("from pairs_to_score)", f"from {pairs})")


SCORING = """words as (select *, list_distinct(list_filter(string_split(coalesce(lt, ''), ' '), lambda x: x <> '')) x, list_distinct(list_filter(string_split(coalesce(rt, ''), ' '), lambda x: x <> '')) y from pairs_to_score),
parts as (select *, list_intersect(x, y) i0, list_filter(x, lambda w: not list_contains(y, w)) a0, list_filter(y, lambda w: not list_contains(x, w)) b0 from words),
strs as (select *, coalesce(array_to_string(list_sort(i0), ' '), '') i, coalesce(array_to_string(list_sort(a0), ' '), '') a, coalesce(array_to_string(list_sort(b0), ' '), '') b from parts),
lcs as (select *, case when a = '' or b = '' then 0 else list_last(list_reduce(
  list_prepend(list_transform(range(length(b) + 1), lambda z: 0::bigint), list_transform(string_split(a, ''), lambda ch: [ascii(ch)::bigint])),
  lambda prev, cw: list_reduce(list_prepend([0::bigint], list_transform(range(1, length(b) + 1), lambda j: [j])),
    lambda row, jw: list_append(row, case when ascii(b[jw[1]]) = cw[1] then prev[jw[1]] + 1 else greatest(row[len(row)], prev[jw[1] + 1]) end)))) end m from strs),
sized as (select *, length(i) + (case when i <> '' then 1 else 0 end) + length(a) na, length(i) + (case when i <> '' then 1 else 0 end) + length(b) nb from lcs),
scored as (select *, case when len(x) = 0 or len(y) = 0 then 0.0 when i <> '' and (a = '' or b = '') then 100.0 else 100.0 * greatest(
    1.0::double - (length(a) + length(b) - 2 * m)::double / (na + nb), case when i <> '' then 1.0::double - (1 + length(a))::double / (length(i) + na) else 0.0 end, case when i <> '' then 1.0::double - (1 + length(b))::double / (length(i) + nb) else 0.0 end) end t from sized),"""
SCORED = scored("possible")


def rounded(x: str, digits: int = 2) -> str:
    return f"cast(printf('%.{digits}f', {x}) as double)"


COMPOSITE = "t * 0.6::double + (ov * 100.0::double) * 0.15::double + (case when journal_match then 100.0::double else 0.0::double end) * 0.1::double + (case when first_author_match then 100.0::double else 0.0::double end) * 0.05::double + (case when page_match then 100.0::double else 0.0::double end) * 0.05::double + greatest(0.0::double, 100.0::double - 20.0::double * least(year_diff, 5)) * 0.05::double"
SCORES = f"{rounded('t')} as title_score, {rounded('ov * 100.0::double')} as author_score, {rounded('ov', 4)} as author_overlap, {rounded(COMPOSITE)} as composite_score"
FLAGS = "first_author_match, journal_match, page_match, year_diff, doi_conflict, pmid_conflict, type_conflict"

REPS = f"""{BIB},
reps as (select id cluster_id, b.* from bib b),
keys as (select id, unnest([case when coalesce(title_norm, '') <> '' then 'ty:' || coalesce(cast(nullif(year, 0) as varchar), '') || ':' || left(title_norm, 40) end,
    case when coalesce(title_norm, '') <> '' and coalesce(first_author_norm, '') <> '' then 'at:' || first_author_norm || ':' || left(title_norm, 28) end,
    case when coalesce(journal_norm, '') <> '' and coalesce(volume, '') <> '' and coalesce(start_page, '') <> '' then 'jvp:' || journal_norm || ':' || volume || ':' || start_page end]) k from reps),
cand as (select distinct a.id left_id, b.id right_id from keys a join keys b on a.k = b.k and a.id < b.id),
sides as (select left_id, right_id, l.title_norm lt, r.title_norm rt, coalesce(l.record_type_category, 'other') lc, coalesce(r.record_type_category, 'other') rc,
    coalesce(len(list_distinct(list_concat(coalesce(l.author_surnames, []), coalesce(r.author_surnames, [])))), 0) nu, coalesce(len(list_intersect(list_distinct(coalesce(l.author_surnames, [])), list_distinct(coalesce(r.author_surnames, [])))), 0) ni,
    coalesce(l.first_author_norm <> '' and l.first_author_norm = r.first_author_norm, false) first_author_match, coalesce(l.journal_norm <> '' and l.journal_norm = r.journal_norm, false) journal_match,
    coalesce(l.page_key <> '' and l.page_key = r.page_key, false) page_match, cast(case when coalesce(l.year, 0) <> 0 and coalesce(r.year, 0) <> 0 then abs(l.year - r.year) else 99 end as int) year_diff,
    l.doi <> '' and r.doi <> '' and l.doi <> r.doi doi_conflict, l.pmid <> '' and r.pmid <> '' and l.pmid <> r.pmid pmid_conflict from cand join reps l on l.id = left_id join reps r on r.id = right_id),
flagged as (select *, case when nu > 0 then ni / nu else 0.0::double end ov, lc <> rc type_conflict from sides),
possible as (select * from flagged where not doi_conflict and not pmid_conflict and lc not in ('correction', 'chapter') and rc not in ('correction', 'chapter') and year_diff <= 1
    and (first_author_match or ov >= 0.4 or journal_match or page_match)),
{SCORED}ruled as (select *, case when (lc = 'conference' and rc = 'journal') or (lc = 'journal' and rc = 'conference') then case when t >= 92 and (first_author_match or ov >= 0.4) then 'review' end
    when t >= 98 and (first_author_match or ov >= 0.8) and (journal_match or page_match or ov >= 0.9) then 'auto_merge' when t >= 95 and first_author_match and ov >= 0.5 and (journal_match or page_match) then 'auto_merge'
    when t >= 88 and (first_author_match or ov >= 0.4 or journal_match or page_match) then 'review' when page_match and journal_match and t >= 80 then 'review' end rec from scored)
"""
WITH_REPS = f"with recursive {REPS}"
MEMBERS = "mem as (select distinct m.cluster_id, m.record_id from cluster_members m join clusters c on c.cluster_id = m.cluster_id and c.status = 'active')"
FUZZY = f"""{WITH_REPS}, mem as (select id cluster_id, id record_id from records),
ce as (select l.cluster_id a, r.cluster_id b from ruled join mem l on l.record_id = left_id join mem r on r.record_id = right_id where rec = 'auto_merge' and l.cluster_id <> r.cluster_id),
be as (select a, b from ce union select b, a from ce),
cl(v, root) as (select distinct cluster_id, cluster_id from mem union select e.b, cl.root from be e join cl on e.a = cl.v),
grp as (select m.record_id, g.root g from mem m join (select v, min(root) root from cl group by v) g on g.v = m.cluster_id),
low as (select record_id, min(record_id) over (partition by g) low from grp),
merged as (select record_id, dense_rank() over (order by low) cluster_id from low),
fin as (select least(left_id, right_id) || ':' || greatest(left_id, right_id) pair_key, left_id left_record_id, right_id right_record_id, l.cluster_id left_cluster_id, r.cluster_id right_cluster_id, {SCORES}, {FLAGS},
    case when rec = 'auto_merge' or coalesce(l.cluster_id = r.cluster_id, false) then 'auto_merge' else rec end recommendation from ruled left join merged l on l.record_id = left_id left join merged r on r.record_id = right_id where rec is not null)
"""

PAIRS = r"""
pk as (select *, try_cast(string_split(regexp_replace(pair_key, '\s', '', 'g'), ':')[1] as bigint) k0, try_cast(string_split(regexp_replace(pair_key, '\s', '', 'g'), ':')[2] as bigint) k1 from candidate_pairs),
pairs as (select * replace (coalesce(left_record_id, case when right_record_id = k0 then k1 else k0 end) as left_record_id, coalesce(right_record_id, case when left_record_id = k0 then k1 else coalesce(k1, k0) end) as right_record_id) from pk)
"""
TOLD = "told as (select id pair_id, case status when 'merged_by_review' then 'merge' when 'separate_by_review' then 'separate' when 'skipped_by_review' then 'skip' end decision from candidate_pairs where status like '%by_review')"
APART = f"""with {BIB}, {PAIRS}, {MEMBERS}, apart as (select p.*, l.cluster_id lcl, r.cluster_id rcl from pairs p join mem l on l.record_id = p.left_record_id join mem r on r.record_id = p.right_record_id where p.status = 'pending' and l.cluster_id <> r.cluster_id)"""

FILLED = ("abstract", "journal", "volume", "issue", "start_page", "end_page", "url", "language", "doi", "pmid", "pmcid")
GOLD = f"""with {BIB}, mm as (select distinct cluster_id, record_id id from cluster_members),
x as (select c.cluster_id, c.canonical_record_id canon, b.* from clusters c join mm on mm.cluster_id = c.cluster_id join bib b on b.id = mm.id where c.status = 'active'),
own as (select * from x where id = canon),
fill as (select cluster_id, {", ".join(f"arg_min({f}, case when id = canon then -1 else id end) filter (where {f} <> '') {f}" for f in FILLED)}, count(*) member_count,
    string_agg(concat_ws(':', source_db, source_record_id), '; ' order by id) source_members from x group by cluster_id)"""


def joined(x: str, by: str = "; ") -> str:
    return f"coalesce(array_to_string(list_filter({x}, lambda v: v is not null), '{by}'), '')"


#: The words of the usual generator for the seed of the samples, from which ordinals are drawn below.
WORDS = [g.getrandbits(32) for g in [random.Random(11)] for _ in range(400)]
BITS = lambda m: f"length(ltrim(bin(cast({m} as bigint)), '0'))"
# a small table is drawn from a pool that loses what was drawn, a large one until enough different ordinals are met
DRAWN = f"""with recursive ranked as (select *, row_number() over (order by id) - 1 k from records), size as (select count(*) n, count(*) <= 277 pool from records), words as (select {WORDS} w),
d(i, m, picks, left_over) as (select 1, n, []::bigint[], case when pool then range(n) else []::bigint[] end from size
  union all select i + 1, case when ok and pool then m - 1 else m end, case when ok then list_append(picks, pick) else picks end,
    case when ok and pool then list_concat(list_concat(left_over[:v], [left_over[m]]), left_over[v + 2:m])[:m - 1] else left_over end
  from (select *, case when v >= m then false when pool then true else not list_contains(picks, v) end ok, case when pool then left_over[v + 1] else v end pick
    from (select d.*, pool, w[i] >> (32 - {BITS('m')}) v from d, size, words where len(picks) < 25 and i <= 400))),
picked as (select unnest(p) o, generate_subscripts(p, 1) - 1 draw from (select picks p from d where len(picks) = 25 limit 1))
"""


def source_ids(profile: str, tags: tuple[str, ...]) -> str:
    """The first value of the first id tag that is there, else a digest of the fields as JSON in ASCII."""
    code = "case when c in (chr(34), chr(92)) then chr(92) || c when c = chr(9) then chr(92) || 't' when unicode(c) between 32 and 126 then c when unicode(c) < 65536 then printf('%cu%04x', 92, unicode(c)) else printf('%cu%04x%cu%04x', 92, 55296 + ((unicode(c) - 65536) >> 10), 92, 56320 + ((unicode(c) - 65536) & 1023)) end"
    order = " ".join(f"when '{t}' then {i}" for i, t in enumerate(tags))
    listed = ", ".join(f"'{t}'" for t in tags)
    return f"""select '{profile}' as profile, path, cast(rec as int) as rec, case when bool_or(first is not null) then max(first) else 'generated:' || sha1('{{' || string_agg(field, ', ' order by tag) || '}}') end as source_record_id
      from (select path, rec, tag, '"' || tag || '": [' || string_agg('"' || array_to_string(list_transform(list_filter(string_split(value, ''), lambda c: c <> ''), lambda c: {code}), '') || '"', ', ' order by position) || ']' field,
        case when tag in ({listed}) and row_number() over (partition by path, rec order by case tag {order} else 99 end) = 1 then arg_min(value, position) end first from entries group by path, rec, tag) group by path, rec"""


ORACLES: dict[str, str] = {
    "content_hash": "select doc_id, sha256(text) as file_hash from documents",
    "text_line_normalize": f"select doc_id, case when text is not null then {LINES} end as text from documents",
    "infer_profile": "select id, case when lower(path) like '%.nbib' then 'pubmed_nbib' when lower(path) like '%.ris' then case when list_contains(string_split(lower(path), '/'), 'embase') then 'embase_ris' when list_contains(string_split(lower(path), '/'), 'wos') then 'wos_ris' else 'standard_ris' end end as profile from source_files",
    "ris_record_count": rf"select doc_id as path, cast(len(list_filter(string_split_regex({LINES}, '[\n\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda v: starts_with(v, 'TY  -'))) as bigint) as n from documents where doc_kind = 'ris'",
    "ris_parse_entries": f"with {RIS} select path, cast(rec as int) as rec, cast(position as int) as position, tag, value from entries",
    "nbib_parse_entries": f"with {NBIB} select path, cast(rec as int) as rec, cast(position as int) as position, tag, value from entries",
    "ris_parse_records": f"with {RIS} select path, cast(rec as int) as rec, cast(count(*) as int) as n_entries, bool_and(tag <> 'ER') and rec = max(rec) over (partition by path) as unfinished from entries group by path, rec",
    "nbib_parse_records": f"with {NBIB} select path, cast(rec as int) as rec, cast(count(*) as int) as n_entries from entries group by path, rec",
    "raw_fields_explode": both("select tag, count(*) as n, count(distinct value) as n_values from entries group by tag"),
    "observed_raw_tags": both("select tag, count(*) as n from entries where tag in ('AB', 'N2', 'PMID', 'DO', 'AID', 'LID', 'T1', 'TI', 'A1', 'AU', 'Y1', 'PY') group by tag"),
    "first_non_empty": f"with {RIS}, k as (select distinct path, rec from entries) select path, cast(rec as int) as rec, coalesce((select arg_min(value, case tag when 'TI' then 0 else 1000000 end + position) from entries e2 where e2.path = k.path and e2.rec = k.rec and e2.tag in ('TI', 'T1') and value <> ''), '') as title from k",
    "all_values": f"with {NBIB} select path, cast(rec as int) as rec, coalesce(string_agg(value, '|' order by case tag when 'AU' then 0 else 1 end, position) filter (where tag in ('AU', 'FAU') and value <> ''), '') as authors from entries group by path, rec",
    "extract_identifier": rf"""with {NBIB}, ids as (select path, rec, position, tag, case tag when 'PMID' then regexp_replace(value, '[^\p{{Nd}}]', '', 'g') else lower(regexp_replace(regexp_extract(value, '(?i)(10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+)', 1), '[.;,)]+$', '')) end v from entries)
      select path, cast(rec as int) as rec, coalesce(arg_min(v, position) filter (where tag = 'PMID' and v <> ''), '') as pmid, coalesce(arg_min(v, case tag when 'AID' then 0 else 1000000 end + position) filter (where tag in ('AID', 'LID') and v <> ''), '') as doi from ids group by path, rec""",
    "normalize_doi": rf"select id, lower(regexp_replace(regexp_extract(coalesce(doi, ''), '(?i)(10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+)', 1), '[.;,)]+$', '')) as doi from records",
    "normalize_text": "select id, title_norm, journal_norm, page_key from records",
    "author_surnames": "select id, coalesce(array_to_string(author_surnames, '|'), '') as surnames from records",
    "parse_year": "select id, try_cast(nullif(regexp_extract(title, '((?:19|20)[0-9]{2})', 1), '') as int) as year from records",
    "parse_pages": f"""with v as (select id, {strip("concat_ws('-', start_page, end_page)")} v from records)
      select id, case when instr(v, '-') > 0 then {strip("split_part(v, '-', 1)")} else v end as start_page, case when instr(v, '-') > 0 then {strip("substr(v, instr(v, '-') + 1)")} else '' end as end_page from v""",
    "record_type_category": f"with v as (select id, trim(regexp_replace(lower(coalesce(record_type, '')), '[^0-9a-z]+', ' ', 'g')) t from records) select id, {CAT} as category from v",
    "ris_type": "with v as (select id, lower(coalesce(record_type, '')) t from records) select id, case when t like '%conference%' or t like '%cpaper%' then 'CPAPER' when t like '%chapter%' then 'CHAP' else 'JOUR' end as ris_type from v",
    "completeness_score": f"with {BIB} select id, cast((doi <> '')::int * 10 + (pmid <> '')::int * 10 + (pmcid <> '')::int * 8 + (coalesce(title, '') <> '')::int * 6 + (year is not null)::int * 5 + (coalesce(len(author_surnames), 0) > 0)::int * 5 + (coalesce(abstract, '') <> '')::int * 4 + (coalesce(journal, '') <> '')::int * 3 + (coalesce(start_page, '') <> '' or coalesce(end_page, '') <> '')::int * 2 + (coalesce(url, '') <> '')::int as double) as score from bib",
    "identifier_groups": f"with {BIB}, {IDS} select kind, value, count(*) as n, min(id) as first_id from ids group by kind, value having count(*) > 1",
    "exact_clusters": f"{EXACT} select id, root from roots",
    "exact_metrics": f"{EXACT}, g as (select kind from ids group by kind, value having count(*) > 1) select count(*) as raw_records, count(distinct root) as exact_clusters, count(*) - count(distinct root) as merged_records, (select count(*) from g where kind = 'pmid') as pmid_groups, (select count(*) from g where kind = 'doi') as doi_groups, (select count(*) from g where kind = 'pmcid') as pmcid_groups from roots",
    "canonical_record": f"{EXACT}, o as (select root, id, row_number() over (partition by root order by {SCORE} desc, {RANK}, id) rn, count(*) over (partition by root) n from roots join records using (id)) select root, id as canonical_record_id, n from o where rn = 1",
    "rebuild_cluster_ids": f"{EXACT} select row_number() over (order by root) as cluster_id, root from (select distinct root from roots)",
    "cluster_members_list": "select cluster_id, string_agg(cast(record_id as varchar), ',' order by record_id) as members from (select distinct cluster_id, record_id from cluster_members) group by cluster_id",
    "records_scan": f"with {BIB} select id, source_db, title, doi, pmid from bib where id in (select canonical_record_id from clusters where status = 'active')",
    "cluster_representatives": f"with {BIB} select c.cluster_id, b.id, b.title_norm, b.year from clusters c join bib b on b.id = c.canonical_record_id where c.status = 'active'",
    "candidate_pairs": f"{WITH_REPS} select left_id, right_id, left_id || ':' || right_id as pair_key from cand",
    "author_jaccard": f"{WITH_REPS} select left_id, right_id, cast(floor(ov * 10000 + 0.5) as bigint) as overlap from flagged",
    "evaluate_pair": f"{WITH_REPS}, {scored('flagged', '_all')} select s.left_id, s.right_id, {', '.join('s.' + c for c in FLAGS.split(', '))}, {SCORES}, greatest(0.0::double, 100.0::double - 20.0::double * least(year_diff, 5)) as year_score, r.rec as recommendation from scored_all s left join (select left_id, right_id, rec from ruled) r on r.left_id = s.left_id and r.right_id = s.right_id",
    "token_set_ratio": f"{WITH_REPS} select left_id, right_id, {rounded('t')} as title_score from scored",
    "recommendation": f"{WITH_REPS} select left_id, right_id, rec as recommendation from ruled where rec is not null",
    "cluster_merge": f"{FUZZY} select cluster_id, record_id from merged where record_id in (select id from records)",
    "candidate_pairs_final": f"{FUZZY} select pair_key, left_record_id, right_record_id, left_cluster_id, right_cluster_id, title_score, author_score, author_overlap, composite_score, {FLAGS}, recommendation = 'auto_merge' as resolved, recommendation, case recommendation when 'auto_merge' then 'auto_merged' else 'pending' end as status from fin",
    "fuzzy_metrics": f"{FUZZY} select (select count(*) from records) as pre_fuzzy_clusters, count(*) filter (where recommendation = 'auto_merge') as auto_merge_pairs, count(*) filter (where recommendation <> 'auto_merge') as manual_review_pending, (select count(distinct cluster_id) from merged) as post_fuzzy_clusters from fin",
    "review_decisions": f"with {TOLD} select pair_id, decision from told",
    "review_upsert": r"with p as (select regexp_replace(pair_key, '\s', '', 'g') pair_key, id, status from candidate_pairs where pair_key is not null), o as (select *, row_number() over (partition by pair_key order by case when status in ('pending', 'auto_merged') then 0 else 1 end desc, id desc) rn from p) select pair_key, id, status from o where rn = 1",
    "review_merge_edges": f"with {TOLD}, {PAIRS}, {MEMBERS} select distinct least(l.cluster_id, r.cluster_id) as src, greatest(l.cluster_id, r.cluster_id) as dst from told join pairs p on p.id = told.pair_id join mem l on l.record_id = p.left_record_id join mem r on r.record_id = p.right_record_id where decision = 'merge' and l.cluster_id <> r.cluster_id",
    "review_metrics": f"with {TOLD} select decision, count(*) as n from told group by decision",
    "pending_pairs": f"{APART} select count(*) as n from apart",
    "review_queue": f"""{APART} select p.id as pair_id, least(left_record_id, right_record_id) || ':' || greatest(left_record_id, right_record_id) as pair_key, left_record_id, right_record_id, lcl as left_cluster_id, rcl as right_cluster_id,
      coalesce(l.title, '') as left_title, coalesce(r.title, '') as right_title, coalesce(cast(l.year as varchar), '') as left_year, coalesce(cast(r.year as varchar), '') as right_year, {joined("l.authors")} as left_authors, {joined("r.authors")} as right_authors,
      coalesce(l.journal, '') as left_journal, coalesce(r.journal, '') as right_journal, l.doi as left_doi, r.doi as right_doi, l.pmid as left_pmid, r.pmid as right_pmid, coalesce(l.source_db, '') as left_source_db, coalesce(r.source_db, '') as right_source_db,
      p.title_score, p.author_score, p.author_overlap, p.composite_score, recommendation, '' as decision, '' as preferred_keeper, '' as notes from apart p join bib l on l.id = p.left_record_id join bib r on r.id = p.right_record_id""",
    "cluster_consolidated": f"{GOLD} select o.cluster_id, o.canon as canonical_record_id, o.title, f.abstract, f.journal, f.doi, f.pmid, f.url, f.source_members, cast(f.member_count as int) as member_count from own o join fill f using (cluster_id)",
    "keyword_union": f"""{GOLD}, kw as (select cluster_id, id, unnest(keywords) k, generate_subscripts(keywords, 1) pos from x), lw as (select *, lower({strip("k")}) low from kw),
      first as (select *, row_number() over (partition by cluster_id, low order by id, pos) rn from lw where low <> ''), u as (select cluster_id, string_agg(k, '|' order by id, pos) keywords from first where rn = 1 group by cluster_id)
      select o.cluster_id, coalesce(u.keywords, '') as keywords from own o left join u using (cluster_id)""",
    "export_csv_rows": f"""{GOLD} select o.cluster_id, cast(o.canon as varchar) as canonical_record_id, coalesce(o.source_db, '') as source_db, coalesce(o.record_type, '') as record_type, coalesce(o.title, '') as title, coalesce(cast(nullif(o.year, 0) as varchar), '') as year, {joined("o.authors")} as authors,
      {", ".join(f"coalesce(f.{c}, '') as {c}" for c in FILLED if c != "abstract")}, coalesce(f.abstract, '') as abstract, {joined("o.keywords")} as keywords, cast(f.member_count as varchar) as member_count, f.source_members from own o join fill f using (cluster_id)""",
    "export_ris_text": f"""{GOLD}, tx as (select o.cluster_id, list_concat(list_concat(['TY  - ' || case when lower(coalesce(o.record_type, '')) like '%conference%' or lower(o.record_type) like '%cpaper%' then 'CPAPER' when lower(o.record_type) like '%chapter%' then 'CHAP' else 'JOUR' end],
      list_transform(coalesce(o.authors, []), lambda v: 'AU  - ' || v)), list_concat(['TI  - ' || nullif(o.title, ''), 'T2  - ' || f.journal, 'AB  - ' || f.abstract, 'PY  - ' || nullif(o.year, 0), 'VL  - ' || f.volume, 'IS  - ' || f.issue, 'SP  - ' || f.start_page, 'EP  - ' || f.end_page, 'DO  - ' || f.doi, 'UR  - ' || f.url],
      list_concat(list_transform(coalesce(o.keywords, []), lambda v: 'KW  - ' || v), ['LA  - ' || f.language, 'N1  - cluster_id=' || o.cluster_id, 'N1  - source_members=' || f.source_members, 'ER  - ', '']))) ls from own o join fill f using (cluster_id))
      select cluster_id, array_to_string(list_filter(ls, lambda v: v is not null), chr(10)) as text from tx""",
    "summary_counts": "select 'records' as name, count(*) as n from records union all select 'source_files', count(*) from source_files union all select 'clusters', count(*) from clusters union all select 'candidate_pairs', count(*) from candidate_pairs",
    "source_breakdown": "select source_db, count(*) as n from records group by source_db",
    "record_type_distribution": "select coalesce(record_type_category, 'other') as record_type_category, count(*) as n from records group by 1",
    "encoding_summary": "select coalesce(encoding_used, 'unknown') || '|' || coalesce(encoding_source, 'unknown') as encoding, count(*) as n from source_files group by 1",
    "encoding_by_file": "select id, path, profile_name, coalesce(encoding_used, '') as encoding_used, coalesce(encoding_source, '') as encoding_source, record_count from source_files",
    "missing_key_fields": f"""with {BIB} select unnest(['title', 'authors', 'year', 'abstract', 'doi', 'pmid', 'journal', 'pages']) as field, unnest([count(*) filter (where coalesce(title, '') = ''), count(*) filter (where coalesce(len(authors), 0) = 0), count(*) filter (where coalesce(year, 0) = 0),
      count(*) filter (where coalesce(abstract, '') = ''), count(*) filter (where doi = ''), count(*) filter (where pmid = ''), count(*) filter (where coalesce(journal, '') = ''), count(*) filter (where coalesce(start_page, '') = '')]) as missing, count(*) as total from bib""",
    "incremental_anti_import": "with f as (select *, imported_at < timestamptz '2024-01-01 00:00:00+00' old from source_files) select id, path from f where not old and file_hash not in (select file_hash from f where old) and path not in (select path from f where old)",
    "cascade_delete": """with f as (select id from source_files f where not exists (select 1 from source_files g where g.file_hash = f.file_hash and g.id < f.id)), r as (select id, source_file_id from records where source_file_id not in (select id from source_files) or source_file_id in (select id from f) or source_file_id is null)
      select 'file' as name, id, id as parent_id from f union all select 'record', id, source_file_id from r union all select 'member', record_id, cluster_id from cluster_members where record_id in (select id from r) or record_id not in (select id from records)""",
    "exact_edges": f"""with {BIB}, {IDS}, x as (select * from ids where cat not in ('correction', 'chapter')), y as (select *, bool_or(cat not in ('conference', 'journal')) over k bridged, min(id) over k low, min(id) over (partition by kind, value, cat) own from x window k as (partition by kind, value))
      select distinct case when bridged then low else own end as src, id as dst from y where id <> case when bridged then low else own end""",
    "sample_records": f"{DRAWN} select r.id, r.title, cast(p.draw as int) as draw from picked p join ranked r on r.k = p.o",
    "sample_render": f"{DRAWN} select string_agg({strip("coalesce(r.abstract, '')")}, chr(10) || chr(10) order by p.draw) || chr(10) as text from picked p join ranked r on r.k = p.o",
    "source_record_id": " union all ".join(f"(with {(RIS if f == 'ris' else NBIB)} {source_ids(name, tags)})" for name, f, tags in (("pubmed_nbib", "nbib", ("PMID",)), ("standard_ris", "ris", ("DO", "PM", "PMID", "N1")), ("embase_ris", "ris", ("U2", "C5", "DO")), ("wos_ris", "ris", ("AN", "UT", "DO")))),
    "stage_metrics_upsert": "select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id",
    "stream_import": f"with {RIS} select tag, count(*) as n from entries group by tag",
}
