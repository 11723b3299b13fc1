"""Streaming forms of attribution, conversions and quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions import events as ev


def event_stream(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Event files as a stream, with a zoned event time a watermark accepts."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    folder = path.rsplit("/", 1)[0] if path.endswith(".parquet") else path
    return source.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def conversions(leads: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One conversion per lead id within the watermark."""
    named = leads.filter(F.coalesce(F.col("lead_id"), F.lit("")) != "")
    return named.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["lead_id"])


def breaches(calls: DataFrame, allowances: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Clients over the allowance of each scope, per tumbling window of its length, once that has closed.

    ``calls``: scope, client, ts; ``allowances``: a static table of scope,
    requests and duration.  Windows of all lengths are counted in one stateful
    aggregate.  A window closes when later calls, or a heartbeat row, have taken
    the watermark past its end.
    """
    calls = calls.withWatermark("ts", lateness)
    limits = allowances.select("scope", F.col("requests").alias("allowed"), "duration")
    # One row for each written duration: minutes and days.
    durations = sorted(r.duration for r in limits.select("duration").distinct().collect())
    windows = [
        calls.join(F.broadcast(limits.where(F.col("duration") == duration)), "scope").select(F.window("ts", duration).alias("w"), "scope", "client", "duration", "allowed")
        for duration in durations
    ]
    counted = reduce(DataFrame.union, windows).groupBy("w", "scope", "client", "duration", "allowed").agg(F.count("*").alias("requests"))
    return counted.where(F.col("requests") > F.col("allowed")).select("scope", "client", F.col("w.start").alias("window_start"), "duration", "requests")


def attribution(hits: DataFrame, site_host: str, lateness: str = "1 day", inactivity: str = "24 hours") -> DataFrame:
    """Attribution of each visit: its last campaign by event time, without one its first touch.

    A visit ends after ``inactivity`` without a touch, and is emitted once the
    watermark has passed its end; one that returns later is a visit of its own.
    ``hits``: session_id, ts, event_id, href, referrer.
    """
    block = ev.acquisition(F.col("href"), F.col("referrer"), site_host)
    touches = (
        hits.withWatermark("ts", lateness).withColumn("parsed", block)
        .filter(F.col("parsed").isNotNull())
        .select("session_id", "ts", F.struct("ts", "event_id").alias("order"), F.to_json("parsed").alias("block"), ev.campaign_touch(F.col("parsed")).alias("paid"))
    )
    campaign = F.when(F.col("paid"), F.col("order"))
    visits = touches.groupBy("session_id", F.session_window("ts", inactivity).alias("visit")).agg(
        F.max_by("block", campaign).alias("campaign_block"), F.min_by("block", F.col("order")).alias("first_block"), F.max(F.when(F.col("paid"), F.col("ts"))).alias("campaign_at"),
    )
    paid = F.col("campaign_block").isNotNull()
    return visits.select(
        "session_id", F.col("visit.start").alias("started"), F.coalesce("campaign_block", "first_block").alias("block"), paid.alias("campaign"),
        F.coalesce("campaign_at", "visit.start").alias("updated_at"),
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now into files, then stop.

    Each micro-batch overwrites its own folder, so a batch retried after a
    failure leaves one copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
