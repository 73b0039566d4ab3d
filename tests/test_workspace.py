import csv

import pytest

from citeloom.operators import golden, report
from citeloom.sources.profiles import BUILT_IN
from citeloom.streaming import ingest
from citeloom.workspace import Workspace, sample_file

NBIB = """PMID- 11
DP  - 2020
TI  - Exercise training after stroke
AB  - Text.
AU  - Smith J
JT  - Journal of Rehab
PG  - 1-9
LID - 10.1000/abc [doi]
PT  - Journal Article

PMID- 12
DP  - 2020
TI  - Walking and balance in older adults
AU  - Jones A
JT  - Journal of Rehab
PT  - Journal Article
"""
RIS = """TY  - JOUR
M3  - Journal Article
Y1  - 2020
T1  - Exercise training after stroke
A1  - Smith, J.
JF  - Journal of Rehab
DO  - 10.1000/abc
ER  -
TY  - JOUR
M3  - Conference Abstract
Y1  - 2020
T1  - Walking and balance in older adults
A1  - Jones, A.
JF  - Abstracts
ER  -
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "embase").mkdir()
    (tmp_path / "a.nbib").write_text(NBIB)
    (tmp_path / "embase" / "b.ris").write_text(RIS)
    return tmp_path / "a.nbib", tmp_path / "embase" / "b.ris"


def test_whole_way(spark, tmp_path, files):
    ws = Workspace(spark, tmp_path / "ws")
    assert ws.dedup_exact()["raw_records"] == 0
    with pytest.raises(RuntimeError):
        ws.dedup_fuzzy()
    assert ws.ingest(list(files)) == {"imported": 2, "skipped": 0, "records": 4}
    assert ws.ingest([files[0]])["skipped"] == 1
    e = ws.dedup_exact()
    assert (e["raw_records"], e["exact_clusters"], e["doi_groups"]) == (4, 3, 1)
    f = ws.dedup_fuzzy()
    assert f == {"pre_fuzzy_clusters": 3, "auto_merge_pairs": 0, "manual_review_pending": 1, "post_fuzzy_clusters": 3}
    with pytest.raises(RuntimeError):
        ws.export(tmp_path / "x.csv", tmp_path / "x.ris")
    q = tmp_path / "q.csv"
    assert ws.review_export(q) == 1
    with pytest.raises(FileExistsError):
        ws.review_export(q)
    with pytest.raises(ValueError):
        ws.review_import(q)
    rows = list(csv.DictReader(q.open()))
    rows[0] |= {"decision": "Merge", "preferred_keeper": rows[0]["right_record_id"], "notes": "same"}
    with q.open("w", newline="") as out:
        w = csv.DictWriter(out, rows[0].keys())
        w.writeheader()
        w.writerows(rows)
    r = ws.review_import(q)
    assert (r["reviewed_pairs"], r["merged_by_review"], r["pending_after_review"], r["final_clusters_after_review"]) == (1, 1, 0, 2)
    keeper = int(rows[0]["right_record_id"])
    assert keeper in {x["canonical_record_id"] for x in ws.table("clusters").collect()}
    assert ws.export(tmp_path / "x.csv", tmp_path / "x.ris") == 2
    assert ws.table("manual_reviews").first()["decision"] == "merge"
    p = ws.report(tmp_path / "r.md", tmp_path / "r.json")
    md = (tmp_path / "r.md").read_text()
    assert tuple(p) == report.SECTIONS and p["summary"] == {"total_source_files": 2, "raw_imported_records": 4, "exact_deduplicated_clusters": 3, "fuzzy_auto_merged_clusters": 3, "manual_review_pending": 0, "final_unique_clusters": 2}
    assert p["missing_key_fields"]["abstract"] == {"missing": 3, "total": 4} and p["missing_key_fields"]["pages"]["missing"] == 3 and p["encoding_summary"] == {"utf-8|default": 2}
    assert [f["record_count"] for f in p["encoding_by_file"]] == [2, 2] and p["parser_profile_summary"]["observed_raw_tags"]["Y1"] == 2 and p["parser_profile_summary"]["profiles"]["embase_ris"]["abstract_tags"] == ["N2", "AB"]
    assert "| abstract | 3 | 4 | 75.0% |" in md and "total source files: 2" in md and "utf-8 by default: 2 files" in md and '"reviewed_pairs": 1' in md and "byte-order marks stripped" in md
    pair = ws.table("candidate_pairs").first()
    assert pair["created_at"] and pair["resolved_at"] and pair["status"] == "merged_by_review" and pair["composite_score"] == round(pair["composite_score"], 2)
    ws.export_tables(tmp_path / "parts")
    back = spark.read.csv(str(tmp_path / "parts" / "csv"), header=True, multiLine=True, escape='"')
    assert back.count() == 2 and set(back.columns) == set(golden.CSV_COLUMNS) and spark.read.text(str(tmp_path / "parts" / "ris")).filter("value like 'TY  -%'").count() == 2
    assert ws.ingest([files[0]], force=True)["imported"] == 1
    assert ws.table("records").count() == 4 and ws.table("clusters").count() == 0


def test_repeated_id_changes_nothing(spark, tmp_path):
    bad = tmp_path / "bad.nbib"
    bad.write_text("PMID- 1\nTI  - A\n\nPMID- 1\nTI  - B\n")
    ws = Workspace(spark, tmp_path / "ws")
    with pytest.raises(ValueError):
        ws.ingest([bad])
    assert ws.table("source_files").count() == 0


def test_sample(spark, tmp_path):
    src = tmp_path / "s.nbib"
    src.write_text("\n\n".join(f"PMID- {i}\nTI  - {n}\nAU  - X Y" for i, n in enumerate(("First", "Second", "Third"), 1)))
    out = tmp_path / "o.nbib"
    sample_file(spark, src, out, 2, 7)
    t = out.read_text()
    assert t.index("Second") < t.index("First") and "Third" not in t
    with pytest.raises(FileExistsError):
        sample_file(spark, src, out, 2, 7)
    with pytest.raises(ValueError):
        sample_file(spark, src, tmp_path / "p.nbib", 9, 7)
    assert not (tmp_path / "p.nbib").exists()


def test_stream(spark, tmp_path, files):
    target = str(tmp_path / "target")
    known = lambda: None
    ingest.into_table(ingest.watch(spark, str(files[1].parent)), target, str(tmp_path / "cp"), BUILT_IN["embase_ris"], known)
    assert spark.read.parquet(target).count() == 2
    ingest.into_table(ingest.watch(spark, str(files[1].parent)), target, str(tmp_path / "cp"), BUILT_IN["embase_ris"], known)
    assert spark.read.parquet(target).count() == 2


def test_many_stored_files(spark, tmp_path, files):
    """Stored files are met by joins, whatever their number."""
    ws = Workspace(spark, tmp_path / "ws")
    old = spark.range(10_000).selectExpr("id + 1 id", "concat('/old/', id, '.ris') path", "'ris' format", "'standard_ris' profile_name", "concat('h', id) file_hash", "current_timestamp() imported_at", "'utf-8' encoding_used", "'default' encoding_source", "1L record_count")
    ws.store({"source_files": old})
    twin = tmp_path / "twin.nbib"
    twin.write_text(NBIB)
    assert ws.ingest([files[0], twin, files[0]]) == {"imported": 1, "skipped": 1, "records": 2}
    assert ws.ingest([files[0], twin])["imported"] == 0
    assert ws.ingest([files[1], twin], force=True) == {"imported": 2, "skipped": 0, "records": 4}
    f = {r["path"]: r["id"] for r in ws.table("source_files").filter("id > 10000").collect()}
    assert f == {str(files[0]): 10_001, str(files[1]): 10_002, str(twin): 10_003}
    assert ws.table("records").select("id").distinct().count() == 6 and ws.ingest([]) == {"imported": 0, "skipped": 0, "records": 0}
