import random
import re
import time

import pytest
from pyspark.sql import functions as F

from citeloom.sources import exports, profiles
from citeloom.sources.profiles import BUILT_IN

RIS = """stray
TY  - JOUR
TI  - A title
 that goes on
AU  - Smith, J.
AU  -
 Late, N.
TY  - CONF
TI  - Interrupted
ER  -
AB  - orphan
TY  - CHAP
DO  - 10.1000/x.
KW  - one
KW  - two"""

NBIB = """PMID- 1
TI  - First
      goes on
AU  - Smith J
FAU - Smith, John
PG  - 12-15
LID - 10.1000/one [doi]
DP  - 2001 Mar
PMID- 2
TI  - Second

loose text
PMID- 3
JT  - Journal &amp; More
"""


def rows(spark, text, profile):
    return exports.parse(spark.createDataFrame([("p", text)], "path string, text string"), BUILT_IN[profile])


def test_ris(spark):
    x = rows(spark, RIS, "standard_ris")
    recs = x.orderBy("rec").collect()
    assert len(recs) == 3
    assert recs[0]["fields"]["TI"] == ["A title that goes on"] and recs[0]["fields"]["AU"] == ["Smith, J.", "Late, N."]
    assert recs[0]["raw_text"].startswith("stray\nTY") and recs[0]["warnings"] == [] and recs[1]["warnings"] == []
    assert "AB" not in recs[2]["fields"] and recs[2]["raw_text"].startswith("AB  - orphan") and recs[2]["warnings"] == [exports.NO_END]
    e = exports.raw_entries(x).orderBy("position").collect()
    assert [r["position"] for r in e] == list(range(1, len(e) + 1)) and e[-1]["value"] == "two"


def test_nbib(spark):
    x = rows(spark, NBIB, "pubmed_nbib")
    n = exports.normalized(x, BUILT_IN["pubmed_nbib"]).orderBy("rec").collect()
    assert [r["pmid"] for r in n] == ["1", "2", "3"] and n[0]["title"] == "First goes on"
    assert (n[0]["start_page"], n[0]["end_page"], n[0]["doi"], n[0]["year"]) == ("12", "15", "10.1000/one", 2001)
    assert n[0]["authors"] == ["Smith J", "Smith, John"] and n[0]["author_surnames"] == ["smith", "smith"]
    assert n[2]["journal"] == "Journal & More" and n[2]["source_record_id"] == "3"


def test_empty_and_unknown(spark):
    assert rows(spark, "", "standard_ris").count() == 0 and rows(spark, None, "pubmed_nbib").count() == 0
    with pytest.raises(ValueError):
        exports.parse(spark.createDataFrame([], "path string, text string"), profiles.Profile("x", "bib", "x", "x"))


def test_generated_id(spark):
    x = rows(spark, "TY  - JOUR\nTI  - T\nER  - ", "standard_ris")
    got = x.select(exports.source_record_id(F.col("fields"), BUILT_IN["standard_ris"]).alias("i")).first()["i"]
    assert got.startswith("generated:") and len(got) == 50


def test_decoding(spark, tmp_path):
    text = "TY  - JOUR\nTI  - Café\nER  - \n"
    (tmp_path / "a.ris").write_bytes(text.encode("cp1252"))
    (tmp_path / "b.ris").write_bytes(text.encode("mac_roman"))
    for name, codec in (("a", "cp1252"), ("b", "mac_roman")):
        f = exports.read_files(spark, str(tmp_path / f"{name}.ris"))
        r = exports.decoded(f, BUILT_IN["standard_ris"], codec).first()
        assert "Café" in r["text"] and (r["encoding_used"], r["encoding_source"]) == (codec, "cli")
    with pytest.raises(Exception):
        exports.decoded(exports.read_files(spark, str(tmp_path / "a.ris")), BUILT_IN["standard_ris"]).select("text").collect()


def test_profiles(tmp_path):
    assert [profiles.infer_profile(p) for p in ("a/b.nbib", "x/embase/b.RIS", "wos/b.ris", "myembase/b.ris")] == ["pubmed_nbib", "embase_ris", "wos_ris", "standard_ris"]
    with pytest.raises(ValueError):
        profiles.infer_profile("a.txt")
    c = tmp_path / "c.json"
    c.write_text('{"profiles": {"own": {"format": "ris"}}, "source_priority": ["WoS"]}')
    s = profiles.load_settings(c)
    assert {"own", "standard_ris"} <= set(s.profiles) and s.source_priority == ("WoS", "PubMed", "Embase", "RIS")
    assert c.read_text().startswith('{"profiles": {"own"')


def test_raw_text_and_line_ends(spark):
    text = "\n\nTY  - A\r\nER  - \r\nER  - stray ZZ  - also\x0bTY  - B\nTI  - x\nTY  - C\nER  -\n\n"
    recs = rows(spark, text, "standard_ris").orderBy("rec").collect()
    assert [r["raw_text"] for r in recs] == ["\n\nTY  - A\nER  - ", "ER  - stray\nZZ  - also\nTY  - B\nTI  - x", "TY  - C\nER  -"]
    assert [r["first_position"] for r in recs] == [1, 3, 5] and not any(r["warnings"] for r in recs)
    bom = spark.createDataFrame([("p", "﻿TY  - A\n﻿﻿TI  - t\n﻿ER  - \n")], "path string, text string")
    assert exports.parse(bom, BUILT_IN["wos_ris"]).first()["fields"]["TI"] == ["t"]
    assert "TI" not in exports.parse(bom, BUILT_IN["standard_ris"]).first()["fields"]
    n = rows(spark, "loose\n  　\nAB-\n-x\nTI  - t\n \nPMID- 2\nPMID - 3", "pubmed_nbib").orderBy("rec").collect()
    assert [[tuple(e) for e in r["entries"]] for r in n] == [[("AB", "-x"), ("TI", "t")], [("PMID", "2")], [("PMID", "3")]]
    assert n[0]["raw_text"] == "AB-\n-x\nTI  - t" and [r["first_position"] for r in n] == [1, 3, 4]


def walked(text, start, end):
    """Records of a RIS text, line by line."""
    out, cur = [], None
    for line in text.split("\n"):
        tagged = re.match("([A-Z0-9]{2})  - ?(.*)$", line)
        if tagged and tagged[1] == start:
            cur = []
            out.append(cur)
        if cur is None:
            continue
        if tagged:
            cur.append([tagged[1], [tagged[2].strip()]])
        elif cur:
            cur[-1][1].append(line.strip())
        if tagged and tagged[1] == end:
            cur = None
    return [[(t, " ".join(v for v in vs if v)) for t, vs in r] for r in out]


def test_random_texts(spark):
    rng = random.Random(6)
    parts = ["TY  - JOUR", "TY  -", "ER  - ", "ER  -x", "AU  - A, B", "AU  -  ", "  more", "", "x-y", "TI - no tag", "KW  - a - b", "ty  - low"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    got = exports.parse(spark.createDataFrame(list(enumerate(texts)), "path int, text string"), BUILT_IN["standard_ris"]).orderBy("path", "rec").collect()
    for i, t in enumerate(texts):
        mine = [r for r in got if r["path"] == i]
        assert [[tuple(e) for e in r["entries"]] for r in mine] == walked(t, "TY", "ER")
        n = 1
        for r in mine:
            assert r["first_position"] == n
            n += len(r["entries"])


@pytest.mark.parametrize("profile,one", [
    ("standard_ris", "TY  - JOUR\nTI  - Title {0}\n goes on\nAU  - Smith, J.\nAU  - Jones, M.\nAB  - Some words of an abstract\nPY  - 2001\nDO  - 10.1000/{0}\nER  - \n"),
    ("pubmed_nbib", "PMID- {0}\nTI  - Title {0}\n      goes on\nAU  - Smith J\nFAU - Smith, John\nAB  - Some words\nDP  - 2001\nLID - 10.1000/{0} [doi]\n\n"),
])
def test_time_grows_with_the_records(spark, profile, one):
    def seconds(n):
        df = spark.createDataFrame([("p", "".join(one.format(i) for i in range(n)))], "path string, text string")
        began = time.perf_counter()
        assert exports.parse(df, BUILT_IN[profile]).select(F.sum(F.size("entries") + F.size("fields") + F.length("raw_text"))).first()[0] > 0
        return time.perf_counter() - began

    seconds(100)
    few, many = min(seconds(100) for _ in range(2)), seconds(10_000)
    assert many < 20 and many < few + 10_000 * 0.002
