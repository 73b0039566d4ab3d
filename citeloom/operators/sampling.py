"""Seeded samples without replacement that keep the order of the draw."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.scalars import strip


def drawn(n: int, count: int, seed: int) -> list[int]:
    """Ordinals from 0 in the order they are drawn."""
    if count < 1:
        raise ValueError("a sample has one record at least")
    if count > n:
        raise ValueError(f"asked for {count} records, found {n}")
    return random.Random(seed).sample(range(n), count)


def sample(rows: DataFrame, count: int, seed: int, order: list[str]) -> DataFrame:
    """The drawn rows with ``draw``, their place in the sample; ordinals are counted in ``order``, range by range."""
    from citeloom.session import settle

    part = settle(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = {r["_part"]: r["count"] for r in part.groupBy("_part").count().collect()}  # one row a partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    picks = drawn(total, count, seed)
    spark = rows.sparkSession
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
    want = spark.createDataFrame([(o, d) for d, o in enumerate(picks)], "_ordinal long, draw int")
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    x = part.withColumn("_n", n).join(F.broadcast(offsets), "_part").withColumn("_ordinal", F.col("_before") + F.col("_n"))
    return x.join(want, "_ordinal").drop("_part", "_n", "_before", "_ordinal")


def rendered(sampled: DataFrame, raw: str = "raw_text") -> str:
    """The raw texts of a sample, blank lines between them."""
    texts = [r["t"] for r in sampled.orderBy("draw").select(strip(F.col(raw)).alias("t")).collect()]  # as large as the sample asked for
    return "\n\n".join(texts) + "\n"
