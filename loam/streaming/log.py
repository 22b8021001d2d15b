"""Append-only event log as a stream: buckets by month week, keep-first within a watermark, resumable queue.

There is no event-time operator to match; the contract here is an extension: late rows beyond the watermark are dropped
from deduplication state, and a restart from the checkpoint neither loses nor repeats a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of a folder as a stream; ``path`` may be a glob."""
    return spark.readStream.schema(schema).parquet(path)


def bucketed(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn("period", X.month_week(ts))


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """Keep-first of a key; a zoneless time counts as session time."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def append(events: DataFrame, path: str, checkpoint: str, partition: list[str]) -> StreamingQuery:
    """Append everything that is there and stop; runs on from the checkpoint."""
    writer = events.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).partitionBy(*partition)
    return writer.trigger(availableNow=True).start(path)


def pending(jobs: DataFrame, done: DataFrame, retry_failed: bool = False, most: int | None = None) -> DataFrame:
    """Jobs still to run, by rank: without verified receipt, and without a failure unless those are to be retried."""
    ok = done.filter("status = 'completed'").select("id", "sha")
    out = jobs.join(ok, ["id", "sha"], "left_anti")
    if not retry_failed:
        out = out.join(done.filter("status = 'failed'").select("id"), "id", "left_anti")
    return out.orderBy("rank").limit(most) if most else out.orderBy("rank")


def resumable(state: dict, base: str, model: str, language: str) -> bool:
    """A resume token holds only for the same service, model and language."""
    return (state.get("base"), state.get("model"), state.get("language")) == (base, model, language)
