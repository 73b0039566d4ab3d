"""Duplicates hidden by formatting: range-partitioned external sort and a scan of adjacent runs.

``scan_runs`` orders (canonical key, id) over the whole cluster with a range partitioning, sorts each partition
externally and walks it once.  Rows with equal full keys are then neighbours.  The id is part of the sort key, so a group
that holds a third of all rows is spread over as many partitions as it needs; only the first and the last run of a
partition can continue in another one, and just those are put together afterwards, from two rows a partition at most.

Cases: a null or blank title, a null, blank or placeholder DOI has no key and yields no row; an empty table yields an
empty result; repeated ids count once each; extra columns are ignored; keys of any length are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import settle

PIECE = 65_536
_EDGE_SCHEMA = "id long, head long, edge int, k string"


def plain_title(title: Column) -> Column:
    """The letters and digits of a title in their order, letter case aside."""
    return F.regexp_replace(F.upper(F.lower(title)), r"[^\p{L}\p{N}]", "")


def plain_doi(doi: Column) -> Column:
    """A DOI without white space, resolver, label and closing punctuation, in lower case; null for a placeholder."""
    bare = F.regexp_replace(F.lower(doi), r"[\s\u00a0\u2000-\u200d\u202f\u3000\ufeff]+", "")
    bare = F.regexp_replace(bare, r"\[doi\]", "")
    found = F.regexp_extract(bare, r"(10\.[0-9]{4,9}/.+)$", 1)
    found = F.regexp_replace(found, r"[.,;:)\]}>\"']+$", "")
    return F.when(found.rlike(r"^10\.[0-9]{4,9}/."), found)


def keyed(records: DataFrame) -> DataFrame:
    """(id, k): the canonical full key of every record that has a DOI and a title."""
    k = records.select(
        F.col("id").cast("long").alias("id"), plain_doi(F.col("doi")).alias("d"), plain_title(F.col("title")).alias("t")
    ).filter("d is not null and t is not null and t <> ''")
    return k.select("id", F.concat_ws("\u0001", "d", "t").alias("k"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition, each with the head of its run; runs of one row inside the partition are dropped.

    ``edge`` is above 0 for the rows of the first and the last run, which another partition may continue.
    """
    run_key, head, n, run_no = None, None, 0, 0
    held: list[int] = []  # the rows of the open run that haven't been put out; never more than PIECE
    cols: tuple[list, ...] = ([], [], [], [])

    def put(edge: int) -> None:
        for c, v in zip(cols, (held, [head] * len(held), [edge] * len(held), [run_key if edge else None] * len(held))):
            c.extend(v)
        held.clear()

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "head", "edge", "k"])
        for c in cols:
            c.clear()
        return out

    for b in batches:
        for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != run_key:
                if run_key is not None:
                    if run_no == 0 or n > 1:
                        put(int(run_no == 0))
                    run_no += 1
                run_key, head, n = k, i, 0
                held.clear()
            n += 1
            held.append(i)
            if len(held) >= PIECE:  # a long run leaves in pieces, settled by its key like an edge
                put(2)
        if len(cols[0]) >= PIECE:
            yield flush()
    put(1)
    yield flush()


def scan_runs(keys: DataFrame) -> DataFrame:
    """(id, head, edge, k) of every row that has, or may have, equal neighbours."""
    ordered = keys.repartitionByRange(F.col("k"), F.col("id")).sortWithinPartitions("k", "id")
    return settle(ordered.mapInArrow(_walk, _EDGE_SCHEMA), "runs")


def collapse(records: DataFrame) -> DataFrame:
    """(record_id, group_id): one row for each record of each group of two or more."""
    runs = scan_runs(keyed(records))
    inner = runs.filter("edge = 0")
    # partial sums are made where the rows are; what is left is at most two rows a partition
    edges = runs.filter("edge > 0")
    whole = edges.groupBy("k").agg(F.min("head").alias("group_id"), F.count("*").alias("copies"))
    whole = whole.filter("copies > 1")
    kept = edges.select("id", "k").join(whole, "k").select("id", "group_id")
    return inner.select("id", F.col("head").alias("group_id")).unionByName(kept).select(
        F.col("id").alias("record_id"), "group_id"
    )


def representatives(records: DataFrame) -> DataFrame:
    """(record_id, copies): one row for each distinct keyed record, with the exact number of copies it had."""
    runs = settle(_count_runs(keyed(records)), "tallies")
    # only the first and the last run of a partition can go on in another one
    edges = runs.filter("k is not null").groupBy("k").agg(F.min("head").alias("record_id"), F.sum("n").alias("copies"))
    return runs.filter("k is null").select(F.col("head").alias("record_id"), F.col("n").alias("copies")).unionByName(edges.select("record_id", "copies"))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, head, n) of every run of one sorted partition, found by comparing neighbours batch by batch; k only for the first and
    the last run."""
    key, head, n, first = None, 0, 0, True  # the run that is open

    def out(k: list, h, c) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(h, pa.int64()), pa.array(c, pa.int64())], names=["k", "head", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        ids, keys = b.column(0).to_numpy(), b.column(1)
        at = np.r_[0, 1 + np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))]
        size = np.diff(np.r_[at, len(ids)])
        heads = ids[at]
        if key is not None and keys[0].as_py() == key:
            heads[0], size[0] = head, size[0] + n
        elif key is not None:
            yield out([key if first else None], [head], [n])
            first = False
        if len(at) > 1:
            k = keys[0].as_py() if first else None
            yield out([k] + [None] * (len(at) - 2), heads[:-1], size[:-1])
            first = False
        key, head, n = keys[int(at[-1])].as_py(), int(heads[-1]), int(size[-1])
    if key is not None:
        yield out([key], [head], [n])


def _count_runs(keys: DataFrame) -> DataFrame:
    ordered = keys.repartitionByRange(F.col("k"), F.col("id")).sortWithinPartitions("k", "id")
    return ordered.mapInArrow(_tally, "k string, head long, n long")
