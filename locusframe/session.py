"""Session helpers: building a session, the shared folder, and cutting lineage.

Iterative operators cut their lineage by writing a Parquet table into the shared
folder that the cluster names in ``spark.checkpoint.dir``.  A lost executor then
costs only the tasks it was running: every finished round is re-read from shared
storage, never recomputed from executor-local blocks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "locusframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators expect (UTC, AQE, skew joins)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where the session names
    none and runs on a single machine (tests) a fresh temporary folder is set in its
    place.  On a cluster without the setting a RuntimeError: executors would write to
    folders of their own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("locusframe.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = "file://" + tempfile.mkdtemp(prefix="locusframe-")
        spark.conf.set("locusframe.shared.dir", named)
    return named.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def new_table_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/locusframe/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, label: str = "cut", path: str | None = None, partition: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; ``partition`` names
    a column of few values by which later steps read parts of it."""
    spark = df.sparkSession
    path = path or new_table_path(spark, label)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`cut` that no later step reads."""
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


class Rounds:
    """Successive versions of one iterated table; a version is dropped two rounds on,
    when nothing can read it any more."""

    def __init__(self, spark: SparkSession, label: str, keep: int = 2):
        self.spark, self.label, self.keep, self.paths = spark, label, keep, []

    def put(self, df: DataFrame) -> DataFrame:
        path = new_table_path(self.spark, self.label)
        out = cut(df, path=path)
        self.paths.append(path)
        while len(self.paths) > self.keep:
            discard(self.spark, self.paths.pop(0))
        return out


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                discard(spark, path)
        except Exception:  # the session may be gone already
            return
