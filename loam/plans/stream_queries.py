"""Structured Streaming over the event table, run to completion on what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.tables import table
from ..streaming import log
from .registry import query


def _folder(spark: SparkSession) -> str:
    """A fresh folder for a stream's output and checkpoint, in the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)


def _run(spark: SparkSession, df: DataFrame, partition: list[str]) -> DataFrame:
    at = _folder(spark)
    log.append(df, f"{at}/out", f"{at}/checkpoint", partition).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


@query("""SELECT strftime(ts, '%Y-%m') || '-w' || ((day(ts) - 1) // 7 + 1) AS period, event_type, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY ALL""")
def stream_log(spark: SparkSession, d: str) -> DataFrame:
    out = _run(spark, log.bucketed(_events(spark, d)), ["period"])
    return out.groupBy("period", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT count(*) AS n, count(DISTINCT user_id || event_type) AS keys FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first of (user, type) within a watermark longer than the data."""
    out = _run(spark, log.deduplicated(_events(spark, d), ["user_id", "event_type"], delay="4000 days").select("user_id", "event_type", "event_id"), ["event_type"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.concat(F.col("user_id").cast("string"), F.col("event_type"))).alias("keys"))
