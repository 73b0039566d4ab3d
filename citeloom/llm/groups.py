"""Groups from pairwise links: connected components on a two-dimensional grid of edge blocks.

Every vertex is hashed into one of ``side`` blocks and every edge goes to the cell of its two blocks.  A cell runs a local
union-find over its edges and hands out, for each of its vertices, the local representative.  A vertex then collects the
representatives found along its row and column, keeps the smallest as its parent and links the others to it.  The links
between representatives are the edges of the next, much smaller round; parents are followed until none changes.

A hub with a third of all edges has them in all cells of its row, so no task gets them alone, and it leaves a cell as one
row; a cell of its row holds its share of them, which grows with the square root of the edges.  The side of the grid follows the number of edges (``CELL_EDGES`` a cell), with at least ``LEAST_SIDE`` at the start.

Cases: ids may come from the two columns or from ``pair_key``; a pair without two different ids links nothing; repeated
and reversed pairs count once; an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import forget, settle

CELL_EDGES = 200_000
LEAST_SIDE = 4
MERGED = ("auto_merged", "merged_by_review")


def pair_links(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: the records that the merging rows link, from whichever of the ids and ``pair_key`` is complete."""
    part = F.split(F.regexp_replace("pair_key", r"\s", ""), ":")

    def at(i: int) -> Column:
        return F.when(F.get(part, F.lit(i)).rlike("^[0-9]{1,18}$"), F.get(part, F.lit(i)).cast("long"))

    x = pairs.filter(F.trim(F.col("status")).isin(*MERGED)).select(
        F.col("left_record_id").cast("long").alias("l"), F.col("right_record_id").cast("long").alias("r"), at(0).alias("k0"), at(1).alias("k1")
    )
    other = lambda one: F.when(F.col("k0") == one, F.col("k1")).otherwise(F.coalesce("k0", "k1"))
    l = F.coalesce("l", F.when(F.col("r").isNotNull(), other(F.col("r"))).otherwise(F.col("k0")))
    r = F.coalesce("r", F.when(F.col("l").isNotNull(), other(F.col("l"))).otherwise(F.col("k1")))
    x = x.select(l.alias("l"), r.alias("r")).filter("l is not null and r is not null and l <> r")
    return x.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))


def local_union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex of their component) of one cell's edges: union by smaller label with path halving."""
    seen, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(seen))
    while len(u):
        pu, pv = parent[u], parent[v]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        open_ = parent[u] != parent[v]
        u, v = u[open_], v[open_]
    return seen, seen[parent]


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    v, r = local_union(pdf["a"].to_numpy(), pdf["b"].to_numpy())
    return pd.DataFrame({"v": v, "r": r})


def _round(edges: DataFrame, side: int) -> DataFrame:
    """(v, r): each cell's vertices with their local representatives."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    i, j = block("a"), block("b")
    cells = edges.select("a", "b", (F.least(i, j) * side + F.greatest(i, j)).alias("cell"))
    return cells.groupBy("cell").applyInPandas(_cell, "v long, r long")


def components(edges: DataFrame, cell_edges: int = CELL_EDGES, least_side: int = LEAST_SIDE) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): the smallest vertex it is linked with directly or indirectly."""
    now = settle(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "edges")
    n = now.count()
    side = max(least_side, math.ceil(math.sqrt(2 * n / cell_edges)))
    parents: DataFrame | None = None
    while n:
        stars = settle(_round(now, side), "stars")
        low = stars.groupBy("v").agg(F.min("r").alias("p"))
        step = settle(low, "parents")
        links = stars.join(step, "v").filter("r <> p").select(F.col("p").alias("a"), F.col("r").alias("b")).distinct()
        old, now = now, settle(links, "edges")
        n = now.count()
        forget(old, stars)
        if parents is None:
            parents = step
        else:
            moved = step.select(F.col("v").alias("p"), F.col("p").alias("q")).filter("p <> q")
            old, parents = parents, settle(parents.join(moved, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "parents")
            forget(old, step)
        side = max(1, math.ceil(math.sqrt(2 * n / cell_edges)))
    if parents is None:
        return edges.select(F.col("a").cast("long").alias("v"), F.col("b").cast("long").alias("root")).limit(0)
    return parents.select("v", F.col("p").alias("root"))


def grouped(pairs: DataFrame, **grid: int) -> DataFrame:
    """(record_id, group_id) of every record that a merging row of ``candidate_pairs`` links to another."""
    return components(pair_links(pairs), **grid).select(F.col("v").alias("record_id"), F.col("root").alias("group_id"))
