"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs rely on.  Sizes (memory, executors, shuffle partitions)
#: belong to the cluster; AQE coalesces and splits partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = 8, name: str = "plotline", **extra: str) -> SparkSession:
    """A single-machine session, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes on disk up to which a settled copy, or a given table that grows, may be broadcast.
SMALL_COPY = 256 << 10

_DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_private_folder: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session on a single machine (tests, a laptop) that names none gets a
    private folder, because there driver and executors share the disk; a
    cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _private_folder:
        _private_folder.append(tempfile.mkdtemp(prefix="plotline-checkpoint-"))
    return _private_folder[0]


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle in this block is deleted at their end, not when the driver collects its garbage."""
    before = spark.conf.get(_DELETE_SHUFFLES, None)
    spark.conf.set(_DELETE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DELETE_SHUFFLES)
        else:
            spark.conf.set(_DELETE_SHUFFLES, before)


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate with several readers to the shared folder and read it back.

    The copy survives lost executors, ends the lineage, and lets later steps
    prune columns.  Spark sizes a join's sides by the bytes of their files, and
    samples of sales take some sixty times their file in memory; so a copy of
    more than ``SMALL_COPY`` bytes is never broadcast, its joins are shuffles.
    What was shuffled to make the copy is deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/settled-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.parquet(path)
    return unless_small(spark.read.schema(df.schema).parquet(path), path)


def unless_small(rows: DataFrame, path: str) -> DataFrame:
    """``rows``, whose joins are shuffles if the files at ``path``, which they grow with, are not small."""
    return rows if stored_bytes(rows.sparkSession, path) <= SMALL_COPY else rows.hint("merge")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder of the shared storage."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
