"""Market statistics: quartiles by commune, type and surface band; land medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.functions.numbers import money

_QUARTILES = (0.25, 0.5, 0.75)


def _priced(sales: DataFrame) -> DataFrame:
    return sales.filter(~F.col("is_outlier") & F.col("prix_m2").isNotNull())


def commune_bands(sales: DataFrame, reference_date: str | Column | None = None) -> DataFrame:
    """Count, quartiles and last date per commune, type and 20 m² band.

    ``percentile`` keeps one counter per distinct price.  Prices are whole
    cents inside the outlier bounds, so even a commune with a third of all
    sales holds a bounded table, merged on the map side first.
    """
    band = F.expr("surface_bati div 20 * 20").cast("int")
    grouped = (
        _priced(sales)
        .groupBy("code_insee", "type_local", band.alias("tranche_surface"))
        .agg(
            F.count("*").alias("n"),
            F.percentile(F.col("prix_m2").cast("double"), _QUARTILES).alias("q"),
            F.max("date_mutation").alias("date_max"),
        )
    )
    return grouped.select(
        "code_insee", "type_local", "tranche_surface", "n",
        money(F.col("q")[0]).alias("p25"),
        money(F.col("q")[1]).alias("mediane"),
        money(F.col("q")[2]).alias("p75"),
        "date_max",
    )


def refresh_bands(current: DataFrame, sales: DataFrame, touched: DataFrame) -> DataFrame:
    """Rebuild the bands of the touched communes, keep the others as they are."""
    touched = touched.select("code_insee").distinct()
    kept = current.join(touched, "code_insee", "left_anti")
    return kept.unionByName(commune_bands(sales.join(touched, "code_insee", "left_semi")))


def commune_medians(bands: DataFrame) -> DataFrame:
    """Approximate built median of a commune: band medians weighted by count."""
    weighted = F.sum(F.col("mediane") * F.col("n")).cast("double") / F.sum("n")
    return bands.groupBy("code_insee", "type_local").agg(weighted.alias("med"))


def land_medians(land: DataFrame) -> DataFrame:
    """Exact land median of a commune over the whole history."""
    return (
        _priced(land)
        .groupBy("code_insee", F.lit("terrain").alias("type_local"))
        .agg(F.percentile(F.col("prix_m2").cast("double"), 0.5).alias("med"))
    )


def guard_medians(bands: DataFrame, land: DataFrame) -> DataFrame:
    return commune_medians(bands).unionByName(land_medians(land))


def land_price(places: DataFrame, land: DataFrame, reference_date: str) -> DataFrame:
    """Land price of a place: its commune, else its department, else null.

    A scope answers only with enough recent sales.  ``places`` needs
    ``code_insee`` and ``code_departement``.
    """
    since = F.add_months(F.lit(reference_date).cast("date"), -fixed.LAND_MEDIAN_MONTHS)
    recent = _priced(land).filter(F.col("date_mutation") >= since)

    def medians(scope: str, name: str) -> DataFrame:
        return (
            recent.groupBy(scope)
            .agg(F.percentile(F.col("prix_m2").cast("double"), 0.5).alias(name), F.count("*").alias("n"))
            .filter(F.col("n") >= fixed.LAND_MEDIAN_MIN_SALES)
            .drop("n")
        )

    return (
        places.join(medians("code_insee", "land_commune"), "code_insee", "left")
        .join(medians("code_departement", "land_department"), "code_departement", "left")
        .withColumn("land_price", F.coalesce("land_commune", "land_department"))
        .drop("land_commune", "land_department")
    )


# --- The market as it was -----------------------------------------------------


def monthly_counters(sales: DataFrame, surface_band: bool) -> DataFrame:
    """code_insee, code_departement, type_local, tranche_surface, month, price, n of the counted sales."""
    band = F.expr("surface_bati div 20 * 20").cast("int") if surface_band else F.lit(None).cast("int")
    return _priced(sales).groupBy(
        "code_insee", "code_departement", F.col("type_local") if surface_band else F.lit("terrain").alias("type_local"), band.alias("tranche_surface"),
        F.trunc("date_mutation", "month").alias("month"), F.col("prix_m2").cast("double").alias("price"),
    ).agg(F.count("*").alias("n"))


def _before(counters: DataFrame, days: list[str], months: int | None = None) -> DataFrame:
    """Counters repeated for each of the days (firsts of months) that they were known on."""
    day = F.explode(F.array(*[F.lit(d).cast("date") for d in days]))
    known = counters.withColumn("as_of", day).where(F.col("month") < F.col("as_of"))
    return known if months is None else known.where(F.col("month") >= F.add_months("as_of", -months))


def medians_as_of(built: DataFrame, land: DataFrame, days: list[str]) -> DataFrame:
    """code_insee, type_local, as_of, med: the guard medians as they were on each day.

    ``built`` and ``land`` are monthly counters; whole months before a day count.
    """
    bands = _before(built, days).groupBy("as_of", "code_insee", "type_local", "tranche_surface").agg(F.sum("n").alias("n"), F.percentile("price", F.lit(0.5), F.col("n")).alias("q"))
    weighted = F.sum(money(F.col("q")) * F.col("n")).cast("double") / F.sum("n")
    houses = bands.groupBy("code_insee", "type_local", "as_of").agg(weighted.alias("med"))
    plots = _before(land, days).groupBy("code_insee", "type_local", "as_of").agg(F.percentile("price", F.lit(0.5), F.col("n")).alias("med"))
    return houses.unionByName(plots)


def land_price_as_of(places: DataFrame, land: DataFrame, days: list[str]) -> DataFrame:
    """``places`` (code_insee, code_departement, as_of) with the land price of the months before."""
    recent = _before(land, days, fixed.LAND_MEDIAN_MONTHS)

    def medians(scope: str, name: str) -> DataFrame:
        rows = recent.where(F.col(scope).isNotNull()).groupBy("as_of", scope).agg(F.percentile("price", F.lit(0.5), F.col("n")).alias(name), F.sum("n").alias("n"))
        return rows.where(F.col("n") >= fixed.LAND_MEDIAN_MIN_SALES).drop("n")

    joined = places.join(medians("code_insee", "own"), ["as_of", "code_insee"], "left").join(medians("code_departement", "around"), ["as_of", "code_departement"], "left")
    return joined.withColumn("land_price", F.coalesce("own", "around")).drop("own", "around")


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date), F.lit("-T"), F.quarter(date))


def market_page(bands: DataFrame, sales: DataFrame, reference_date: str) -> DataFrame:
    """Per commune and type: bands, overall median, 12-month change, last sale."""
    today = F.lit(reference_date).cast("date")
    date, price = F.col("date_mutation"), F.col("prix_m2").cast("double")
    recent = date > F.add_months(today, -12)
    before = (date > F.add_months(today, -24)) & ~recent
    levels = (
        _priced(sales)
        .groupBy("code_insee", "type_local")
        .agg(
            F.percentile(F.when(recent, price), 0.5).alias("recent"),
            F.percentile(F.when(before, price), 0.5).alias("earlier"),
            F.max("date_mutation").alias("last_sale"),
        )
    )
    samples = bands.groupBy("code_insee", "type_local").agg(
        F.count("*").alias("bands"), F.sum("n").alias("n")
    )
    return (
        samples.join(commune_medians(bands), ["code_insee", "type_local"])
        .join(levels, ["code_insee", "type_local"])
        .withColumn("change_12m_pct", (F.col("recent") / F.col("earlier") - 1) * 100)
        .drop("recent", "earlier")
    )
