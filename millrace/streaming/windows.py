"""Windowed counts and stale workers, on streams and on tables alike. Extensions: the surveyed system has no streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.session import shared_dir


def tumbling_counts(events: DataFrame, keys: list[str], length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls of each key in fixed windows of ts; on a stream, events later than `late` are dropped with their state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("calls")).select(F.col("w.start").alias("window_start"), *keys, "calls")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: runs of events with no longer pause than `gap`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("session_start"), "events")


def stale_jobs(jobs: DataFrame, now, after_seconds: int = 60, attempts: int = 3) -> DataFrame:
    """Running jobs without a heartbeat for `after_seconds`, and what becomes of them: requeue, or fail after `attempts`."""
    quiet = F.unix_timestamp(now) - F.unix_timestamp(F.col("heartbeat_at").cast("timestamp")) > after_seconds
    return jobs.where((F.col("status") == "running") & quiet).withColumn("next", F.when(F.col("attempt") < attempts, "requeue").otherwise("fail"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once all there is now has been read.

    mode append: all rows that it has emitted, of an aggregating stream those of the windows that its watermark has closed.
    mode complete: the last state of an aggregating stream, open windows included; it keeps all windows. The micro-batches
    go to files in the shared folder, where the stream also keeps its progress; the result is read back.
    """
    if mode not in ("append", "complete"):
        raise ValueError("mode is append or complete")
    where = f"{shared_dir(stream.sparkSession)}/millrace/drained-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}-progress").trigger(availableNow=True)
    q = q.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{where}/batch={batch:08d}")).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema, StructField("batch", IntegerType())])).parquet(where).where("batch IS NOT NULL")
    if mode == "complete":
        rows = rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return rows.drop("batch")


def upsert_batches(stream: DataFrame, apply, checkpoint: str):
    """Start a stream that hands each micro-batch to apply(df, batch_id): once, or again after a failure. KeyedTable.upsert
    takes effect once either way; any other function must see to that itself."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
