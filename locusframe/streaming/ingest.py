"""Incremental loading and event-time merging with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locusframe.operators.profile import ValueCounts
from locusframe.store import AnnotationStore


def stream_into_store(lines: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Load micro-batches of feature rows into the store at ``path``; every batch becomes
    one version.  A batch that is replayed after a failure is recognised by its number,
    which is kept beside the version."""

    def load(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        store = AnnotationStore.open(spark, path)
        if store.options.get("epoch", -1) >= epoch or batch.isEmpty():
            return
        store = store.update(batch, **options)
        store.options["epoch"] = epoch
        store.save(path)

    return lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).start()


def stream_value_counts(rows: DataFrame, columns: list[str], load: str, store: ValueCounts, checkpoint: str) -> StreamingQuery:
    """Add each micro-batch's value counts to a maintained profile; a batch that is replayed
    after a failure replaces its own delta."""
    return rows.writeStream.foreachBatch(lambda batch, epoch: store.apply(batch, columns, load, name=f"batch-{epoch}") and None).option("checkpointLocation", checkpoint).start()


def sessions(events: DataFrame, key: str, at: str, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Merge events of a key that follow each other within ``gap``; on a stream, rows later
    than ``lateness`` are left out."""
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    out = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
