"""Groups of linked vertices: alternating large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import forget, settle

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (or the smaller and own) neighbours of each vertex to the smallest in reach."""
    if large:
        e = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    x = e.join(low, "a")
    if large:
        out = x.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = x.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): for every vertex (id) the smallest vertex it is linked with by edges (src, dst)."""
    now = settle(edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    print_ = now.agg(F.count("*"), F.sum(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).cast("decimal(38,0)")))
    last = tuple(print_.first())
    for _ in range(MOST_ROUNDS):
        if not last[0]:
            break
        old, now = now, settle(_star(_star(now, True), False), "stars")
        forget(old)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).cast("decimal(38,0)"))).first())
        if new == last:
            break
        last = new
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return vertices.select(F.col("id").cast("long").alias("id")).distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
