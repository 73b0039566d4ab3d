"""Filling containers of fixed capacity: bounded-space online best fit.

Items come in the order of a hash of their id, split into groups of about ``GROUP_ITEMS`` that are packed side by side.  A
packer keeps at most ``OPEN_BINS`` open bins.  Their free spaces form a bitset: bit f is set if a bin with f free places is
open, so the best fit for an item of size s is the lowest set bit from s on.  If no bin fits, a new one is opened; when that
is one too many, the fullest open bin (the lowest bit of all) closes first.

Cases: an item larger than the capacity is cut into full pieces and a rest, nothing else is cut; items of size 0 or null take
no space and have no row; an empty table gives no rows; repeated ids are items of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import settle

CAPACITY = 2048
OPEN_BINS = 512
GROUP_ITEMS = 200_000
_SCHEMA = "container_id long, doc_id long, piece int, first_token long, n_tokens int"


class Packer:
    """Bounded-space best fit; ``put`` gives the number of the bin an item went to."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.by_free, self.open, self.made = 0, {}, 0, 0

    def put(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_no = self._take(free)
        else:
            free, bin_no = self.capacity, self.made
            self.made += 1
            if size < free and self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        if size < free:
            self.by_free.setdefault(free - size, []).append(bin_no)
            self.bits |= 1 << (free - size)
            self.open += 1
        return bin_no

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_no = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return bin_no


def pack(sizes: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_id, doc_id, piece, first_token, n_tokens) for sizes (doc_id, n)."""
    sizes = sizes.filter("n > 0")
    groups = max(1, round(sizes.count() / group_items))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers: dict[int, Packer] = {}
        for pdf in parts:
            rows = []
            for g, doc, n in zip(pdf["g"].tolist(), pdf["doc_id"].tolist(), pdf["n"].tolist()):
                if g not in packers:
                    packers = {g: Packer(capacity, open_bins)}  # sorted by g: the one before is over
                p = packers[g]
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    rows.append((g << 40 | p.put(size), doc, piece, start, size))
            yield pd.DataFrame(rows, columns=["container_id", "doc_id", "piece", "first_token", "n_tokens"])

    keyed = sizes.select("doc_id", "n", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"), F.xxhash64("doc_id").alias("o"))
    return keyed.repartition(groups, "g").sortWithinPartitions("g", "o", "doc_id").mapInPandas(run, _SCHEMA)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused places and the least number of containers that could hold the tokens."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    r = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.max("used"), F.lit(0)).alias("fullest"))
    return r.select("containers", "tokens", (F.col("containers") * capacity - F.col("tokens")).alias("unused"), F.ceil(F.col("tokens") / capacity).alias("least_containers"), "fullest")


def settled_sizes(sizes: DataFrame) -> DataFrame:
    """The sizes as a table, so that counting the items does not tokenise the texts twice."""
    return settle(sizes, "sizes")
