"""Valuations kept under their request key, so that each is made once for a vintage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.operators.valuation import request_key
from plotline.session import delete_folder, settle, shuffles_deleted


def value_once(spark: SparkSession, path: str, located: DataFrame, vintage: str, value: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of all requests; only keys that the store does not hold for the vintage are valued.

    ``value`` turns located requests into results with their request_id.  Equal
    requests share one valuation, of the least request id.  What is valued is
    added to the store in one write, so a run that is repeated after a failure
    finds either all or none of its keys.  ``valued_now`` tells which results
    this run has made.
    """
    keyed = settle(located.withColumn("request_key", request_key(vintage)))
    held = _held(spark, path, vintage)
    wanted = keyed.groupBy("request_key").agg(F.min("request_id").alias("request_id"))
    if held is not None:
        wanted = wanted.join(held.select("request_key"), "request_key", "left_anti")
    wanted = settle(wanted)
    if not wanted.isEmpty():
        unseen = keyed.join(wanted.select("request_id"), "request_id", "left_semi").drop("request_key")
        made = value(unseen).join(wanted, "request_id").drop("request_id")
        with shuffles_deleted(spark):
            made.write.mode("append").parquet(_place(path, vintage))
    rows = _held(spark, path, vintage)
    if rows is None:
        return keyed.select("request_id", F.lit(False).alias("valued_now")).limit(0)
    now = wanted.select("request_key", F.lit(True).alias("now"))
    asked = keyed.select("request_id", "request_key").join(now, "request_key", "left")
    return asked.join(rows, "request_key").withColumn("valued_now", F.coalesce("now", F.lit(False))).drop("request_key", "now")


def retire(spark: SparkSession, path: str, old: list[str]) -> None:
    """Delete the results of vintages that are no longer published."""
    for vintage in old:
        delete_folder(spark, _place(path, vintage))


def _place(path: str, vintage: str) -> str:
    return f"{path}/vintage={vintage}"


def _held(spark: SparkSession, path: str, vintage: str) -> DataFrame | None:
    try:
        return spark.read.parquet(_place(path, vintage))
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
