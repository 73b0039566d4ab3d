"""Profiles: which tags of an export feed which field, and how a profile is told from a path."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path, PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.scalars import SOURCE_ORDER

FIELDS = ("record_type", "title", "abstract", "authors", "journal", "year", "volume", "issue", "start_page", "end_page", "pages", "keywords", "language", "url")


@dataclass(frozen=True)
class Profile:
    name: str
    format: str
    source_name: str
    start_tag: str
    end_tag: str | None = None
    strip_bom: bool = False
    encoding: str | None = None
    fields: dict[str, list[str]] = field(default_factory=dict)
    ids: dict[str, list[str]] = field(default_factory=dict)
    id_tags: list[str] = field(default_factory=list)

    def tags(self, name: str) -> list[str]:
        return self.fields.get(name, [])


# The tags of each export format by field, in the order they are tried.
BUILT_IN = {
    "pubmed_nbib": Profile(
        "pubmed_nbib", "nbib", "PubMed", "PMID",
        fields={
            "record_type": ["PT"],
            "title": ["TI"],
            "abstract": ["AB"],
            "authors": ["AU", "FAU"],
            "journal": ["JT", "TA"],
            "year": ["DP"],
            "volume": ["VI"],
            "issue": ["IP"],
            "pages": ["PG"],
            "keywords": ["OT", "MH"],
            "language": ["LA"],
        },
        ids={"doi": ["AID", "LID"], "pmid": ["PMID"], "pmcid": ["PMC", "PMCID"]}, id_tags=["PMID"],
    ),
    "standard_ris": Profile(
        "standard_ris", "ris", "RIS", "TY", "ER",
        fields={
            "record_type": ["TY"],
            "title": ["TI", "T1"],
            "abstract": ["AB", "N2"],
            "authors": ["AU", "A1"],
            "journal": ["T2", "JF", "JO"],
            "year": ["PY", "Y1"],
            "volume": ["VL"],
            "issue": ["IS"],
            "start_page": ["SP"],
            "end_page": ["EP"],
            "keywords": ["KW"],
            "language": ["LA"],
            "url": ["UR"],
        },
        ids={"doi": ["DO"], "pmid": ["PM", "PMID"], "pmcid": ["PMC", "PMCID"]}, id_tags=["DO", "PM", "PMID", "N1"],
    ),
    "embase_ris": Profile(
        "embase_ris", "ris", "Embase", "TY", "ER",
        fields={
            "record_type": ["M3", "TY"],
            "title": ["T1", "TI"],
            "abstract": ["N2", "AB"],
            "authors": ["A1", "AU"],
            "journal": ["JF", "JO", "T2"],
            "year": ["Y1", "PY"],
            "volume": ["VL"],
            "issue": ["IS"],
            "start_page": ["SP"],
            "end_page": ["EP"],
            "keywords": ["KW"],
            "language": ["LA"],
            "url": ["UR", "L2"],
        },
        ids={"doi": ["DO", "L2"], "pmid": ["C5"]}, id_tags=["U2", "C5", "DO"],
    ),
    "wos_ris": Profile(
        "wos_ris", "ris", "WoS", "TY", "ER", strip_bom=True,
        fields={
            "record_type": ["TY"],
            "title": ["TI", "T1"],
            "abstract": ["AB", "N2"],
            "authors": ["AU", "A1"],
            "journal": ["T2", "JO", "JF"],
            "year": ["PY", "Y1", "C6"],
            "volume": ["VL"],
            "issue": ["IS"],
            "start_page": ["SP", "C7"],
            "end_page": ["EP"],
            "keywords": ["KW", "DE", "ID"],
            "language": ["LA"],
            "url": ["UR"],
        },
        ids={"doi": ["DO"], "pmid": ["PM", "PMID"]}, id_tags=["AN", "UT", "DO"],
    ),
}


@dataclass(frozen=True)
class Settings:
    profiles: dict[str, Profile] = field(default_factory=lambda: dict(BUILT_IN))
    source_priority: tuple[str, ...] = SOURCE_ORDER


def load_settings(path: str | Path | None) -> Settings:
    """Built-in profiles under those of a JSON file, which win by name; the file isn't changed."""
    if path is None or not Path(path).exists():
        return Settings()
    told = json.loads(Path(path).read_text("utf-8"))
    own = {n: replace(BUILT_IN.get(n, Profile(n, "ris", n, "TY", "ER")), **{**p, "name": n}) for n, p in told.get("profiles", {}).items()}
    order = tuple(told.get("source_priority", ()))
    return Settings({**BUILT_IN, **own}, order + tuple(s for s in SOURCE_ORDER if s not in order))


def save_settings(settings: Settings, path: str | Path) -> None:
    body = {"source_priority": list(settings.source_priority), "profiles": {n: asdict(p) for n, p in settings.profiles.items()}}
    Path(path).write_text(json.dumps(body, indent=2, ensure_ascii=False) + "\n", "utf-8")


def infer_profile(path: str) -> str:
    """The profile of a path: by suffix, and for RIS by a whole path component; ValueError for other files."""
    p = PurePath(path.lower())
    if p.suffix == ".nbib":
        return "pubmed_nbib"
    if p.suffix == ".ris":
        return "embase_ris" if "embase" in p.parts else "wos_ris" if "wos" in p.parts else "standard_ris"
    raise ValueError(f"no profile for {path}")


def infer_profile_column(path: Column) -> Column:
    low = F.lower(path)
    parts = F.split(low, "/")
    ris = F.when(F.array_contains(parts, "embase"), "embase_ris").when(F.array_contains(parts, "wos"), "wos_ris").otherwise("standard_ris")
    return F.when(low.endswith(".nbib"), "pubmed_nbib").when(low.endswith(".ris"), ris)


def profile_summary(settings: Settings | None = None) -> dict:
    """What the report and the list of profiles tell about each profile."""
    s = settings or Settings()
    of = lambda p: {"format": p.format, "source_name": p.source_name, "encoding": p.encoding, **{k + "_tags": p.tags(f) for k, f in (("abstract", "abstract"), ("title", "title"), ("author", "authors"), ("year", "year"))}, "strip_bom": p.strip_bom}
    return {"source_priority": list(s.source_priority), "profiles": {n: of(p) for n, p in s.profiles.items()}}


def profile_table(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    rows = [(n, p["format"], p["source_name"], p["encoding"] or "", *(",".join(p[k + "_tags"]) for k in ("abstract", "title", "author", "year")), p["strip_bom"]) for n, p in sorted(profile_summary(settings)["profiles"].items())]
    return spark.createDataFrame(rows, "name string, format string, source_name string, encoding string, abstract_tags string, title_tags string, author_tags string, year_tags string, strip_bom boolean")
