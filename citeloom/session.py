"""Session helpers: a tuned local session, table access and durable cuts of the lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_SETTLED: set[str] = set()


def local_session(cpus: int | str = 8, app: str = "citeloom", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where that is unset, a session on one machine gets a folder of its own; a cluster is refused, since its executors would
    each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="citeloom-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return f"file://{_OWN_DIR[0]}"


def settle(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage the way ``checkpoint()`` does, but columnar and compressed, so that later reads prune
    columns, and it survives the loss of executors.  ``forget`` removes a table that nothing reads any more; what is left
    goes with ``forget_all`` or the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    if not _SETTLED:
        atexit.register(forget_all, spark)
    _SETTLED.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Removes settled tables; results that still read them must have been written before."""
    for t in tables:
        path = getattr(t, "_settled_at", None)
        if path in _SETTLED:
            _SETTLED.discard(path)
            _remove(t.sparkSession, path)


def forget_all(spark: SparkSession) -> None:
    """Removes all settled tables of this program."""
    while _SETTLED:
        try:
            _remove(spark, _SETTLED.pop())
        except Exception:  # the session may be gone at the end of the program
            return
