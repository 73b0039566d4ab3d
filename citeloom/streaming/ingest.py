"""Progressive import as a stream: each micro-batch of new files is parsed and appended, files seen before are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import shared_dir
from citeloom.sources import exports
from citeloom.sources.profiles import BUILT_IN, Profile


def watch(spark: SparkSession, folder: str, pattern: str = "*.ris") -> DataFrame:
    """A stream of (path, content, file_hash) of the files that appear in ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    f = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return f.select("path", "content", exports.content_hash(F.col("content")).alias("file_hash"))


def into_table(stream: DataFrame, target: str, checkpoint: str, profile: Profile, known: Callable[[], DataFrame | None]) -> None:
    """Parses what is there now and appends its normalized records to ``target``; content that ``known`` lists is skipped."""

    def batch(files: DataFrame, epoch: int) -> None:
        old = known()
        fresh = files.dropDuplicates(["file_hash"])
        if old is not None:
            fresh = fresh.join(old.select("file_hash").distinct(), "file_hash", "left_anti")
        rows = exports.normalized(exports.parse(exports.decoded(fresh, profile), profile), profile)
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{target}/epoch={epoch:09d}")  # a repeated batch replaces itself

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, n): the tags of all RIS texts among the documents, counted by a stream with a stateful aggregation."""
    import uuid

    name = "tags_" + uuid.uuid4().hex[:12]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = f"{shared_dir(spark)}/{name}-in"
    documents.filter("doc_kind = 'ris'").select(F.col("doc_id").alias("path"), "text").write.parquet(source)
    texts = spark.readStream.schema("path long, text string").parquet(source)
    e = exports.raw_entries(exports.parse(texts, BUILT_IN["standard_ris"])).groupBy("tag").agg(F.count("*").alias("n"))
    out = f"{shared_dir(spark)}/{name}-out"

    def keep(df: DataFrame, epoch: int) -> None:
        df.coalesce(1).write.mode("overwrite").parquet(f"{out}/{epoch:09d}")

    q = e.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{shared_dir(spark)}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(s.getPath().getName() for s in fs.listStatus(path))
    return spark.read.schema("tag string, n long").parquet(f"{out}/{last}")
