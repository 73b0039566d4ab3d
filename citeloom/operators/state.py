"""Changes to stored tables: files not seen before, cascading deletes, last-write-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content and path are both new."""
    return files.join(known.select("file_hash").distinct(), "file_hash", "left_anti").join(known.select("path").distinct(), "path", "left_anti")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    columns = rows.columns
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_r")).select("_r.*")


def without(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The tables without the rows of ``gone`` (key) and all that refer to them: name -> (table, its foreign key)."""
    g = gone.select(F.col(key).alias("_gone")).distinct()
    out = {"": parents.join(g, F.col(key) == F.col("_gone"), "left_anti")}
    for name, (table, foreign) in children.items():
        out[name] = table.join(g, F.col(foreign) == F.col("_gone"), "left_anti")
    return out


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and the rows of ``old`` with other keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("_r")).select(key, "_r.*")
