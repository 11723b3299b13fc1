"""A live table of resolved addresses: micro-batches renew rows, expired ones go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.session import settle

#: Parts of the table by address; a micro-batch rewrites those of its own addresses.
PARTS = 64


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each address; of several at one time, that which lives longest."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct("resolved_at", "expires_on", *[c for c in rest if c not in ("resolved_at", "expires_on")])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def renew(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], parts: int = PARTS) -> None:
    """Bring one batch of resolved addresses (keys, resolved_at, expires_on and more) into the table at ``path``.

    Only the parts of the batch's addresses are read and written, and rows there
    that had expired by the batch's latest time go for good.  The latest row of
    an address counts whatever the order of batches, so a batch that is run
    again changes nothing.
    """
    batch = settle(_latest(batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")), [*keys, "part"]))
    touched = [r.part for r in batch.select("part").distinct().collect()]  # at most ``parts``
    if not touched:
        return
    clock = batch.agg(F.max("resolved_at")).first()[0]
    held = _held(spark, path, batch)
    rows = batch if held is None else batch.unionByName(held.where(F.col("part").isin(touched)))
    live = settle(_latest(rows, [*keys, "part"]).where(F.col("expires_on") >= F.to_date(F.lit(clock))))
    # A part that has only expired rows is emptied by a row that no view shows.
    empty = spark.createDataFrame([(p,) for p in touched], "part int").join(live.select("part").distinct(), "part", "left_anti")
    live = live.unionByName(empty, allowMissingColumns=True)
    live.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _held(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def keep_live(stream: DataFrame, path: str, checkpoint: str, keys: list[str], parts: int = PARTS) -> None:
    """Bring all that a stream of resolved addresses holds now into the table, then stop."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: renew(batch.sparkSession, path, batch, keys, parts))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def live_addresses(spark: SparkSession, path: str, today: str) -> DataFrame:
    """The addresses that are still good on a day."""
    return spark.read.parquet(path).where(F.col("expires_on") >= F.lit(today).cast("date")).drop("part")
