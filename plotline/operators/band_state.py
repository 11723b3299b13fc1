"""Price bands kept as counters that imports add to and stale marks subtract from.

The state has one row for each commune, type, band and price (or sale day) with
how many counted sales have it.  Quartiles are exact quantiles of the counters,
so they never need the sales again; what an import changes is the difference of
the counters of the rows it rewrote, before and after.  Counters of two states
add up, so the order of imports does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions.numbers import money
from plotline.session import settle

BAND = ["code_insee", "type_local", "tranche_surface"]
_KEYS = ["area", *BAND, "what", "value"]
_QUARTILES = (0.25, 0.5, 0.75)


def area_of_commune() -> Column:
    """The part of the state a commune belongs to: the first two characters of its code."""
    return F.substring("code_insee", 1, 2)


def counters(sales: DataFrame, area: Column | None = None) -> DataFrame:
    """area, code_insee, type_local, tranche_surface, what, value, n of the counted sales.

    Prices count in cents, sale dates in days.
    """
    area = area_of_commune() if area is None else area
    band = F.expr("surface_bati div 20 * 20").cast("int")
    cents = F.round(F.col("prix_m2") * 100).cast("long")
    each = F.array(F.struct(F.lit("price").alias("what"), cents.alias("value")), F.struct(F.lit("day").alias("what"), F.unix_date("date_mutation").cast("long").alias("value")))
    rows = sales.where(~F.col("is_outlier") & F.col("prix_m2").isNotNull()).select(area.alias("area"), "code_insee", "type_local", band.alias("tranche_surface"), F.explode(each).alias("e"))
    return rows.select("area", *BAND, "e.*").groupBy(*_KEYS).agg(F.count("*").alias("n"))


def changes(before: DataFrame, after: DataFrame, area: Column | None = None) -> DataFrame:
    """What turns the counters of some rows as they were into those of the same rows as they are."""
    gone = counters(before, area).withColumn("n", -F.col("n"))
    return _sum(gone.unionByName(counters(after, area)))


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEYS).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def apply_changes(spark: SparkSession, path: str, delta: DataFrame) -> list[str]:
    """Add ``delta`` to the state at ``path``; only the areas it names are read and written.

    Returns those areas (there are a few hundred at most).  A counter that falls
    to nothing goes, and an area without counters keeps one row of none, so that
    its file is replaced.
    """
    delta = settle(delta)
    areas = sorted(r.area for r in delta.select("area").distinct().collect())
    if not areas:
        return []
    current = _existing(spark, path)
    merged = delta if current is None else delta.unionByName(current.where(F.col("area").isin(areas)).select(*_KEYS, "n"))
    merged = settle(_sum(merged))
    empty = spark.createDataFrame([(a,) for a in areas], "area string").join(merged.select("area").distinct(), "area", "left_anti")
    for name in ("code_insee", "type_local", "what"):
        empty = empty.withColumn(name, F.lit(None).cast("string"))
    empty = empty.withColumns({"tranche_surface": F.lit(None).cast("int"), "value": F.lit(None).cast("long"), "n": F.lit(0).cast("long")})
    # At most eight files for an area; a commune's counters lie together.
    rows = merged.unionByName(empty).repartition("area", F.pmod(F.xxhash64("code_insee"), F.lit(8))).sortWithinPartitions("area", "code_insee")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("area").parquet(path)
    return areas


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("code_insee string, type_local string, tranche_surface int, what string, value long, n long, area string").parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The counters, without the marks of empty areas."""
    found = _existing(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return found.where(F.col("n") > 0)


def bands_of(state: DataFrame) -> DataFrame:
    """The bands that a full rebuild from the sales would give."""
    price = F.when(F.col("what") == "price", F.col("value") / 100)
    grouped = state.groupBy(*BAND).agg(
        F.sum(F.when(F.col("what") == "price", F.col("n"))).alias("n"),
        F.percentile(price, _QUARTILES, F.col("n")).alias("q"),
        F.max(F.when(F.col("what") == "day", F.col("value"))).alias("day"),
    )
    return grouped.select(
        *BAND, "n", money(F.col("q")[0]).alias("p25"), money(F.col("q")[1]).alias("mediane"), money(F.col("q")[2]).alias("p75"),
        F.date_from_unix_date(F.col("day").cast("int")).alias("date_max"),
    )
