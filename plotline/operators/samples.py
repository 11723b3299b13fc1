"""Cleaning of a sample of comparables, held as one bounded array per search.

The search never returns more than 200 sales, so a sample is an array column
and cleaning needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.functions.numbers import bind, sorted_quantile


def _by_type(index: int) -> Column:
    chain = None
    for kind, bounds in fixed.SAMPLE_BOUNDS.items():
        value = F.lit(float(bounds[index]))
        condition = F.col("property_type") == kind
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def clean_samples(samples: DataFrame) -> DataFrame:
    """Add ``kept`` and the count of each reject reason to ``sample``.

    Absolute bounds first, then the interquartile clip from four sales up,
    then the 150 nearest.  Needs ``property_type`` and ``sample``.
    """
    price_min, price_max, surface_min, surface_max = (_by_type(i) for i in range(4))

    def verdict(x: Column) -> Column:
        return (
            F.when(x["price"].isNull() | F.isnan(x["price"]) | ~x["price"].between(price_min, price_max), "price")
            .when(x["surface"].isNull() | ~x["surface"].between(surface_min, surface_max), "surface")
            .when(
                x["value"].isNotNull() & ~x["value"].between(fixed.SALE_VALUE_MIN, fixed.SALE_VALUE_MAX), "value"
            )
            .otherwise("ok")
        )

    count = lambda array, what: F.size(F.filter(array, lambda v: v == what))
    staged = (
        samples.withColumn("_verdicts", F.transform("sample", verdict))
        .withColumn("_within", F.filter("sample", lambda x: verdict(x) == "ok"))
        .withColumn("_prices", F.array_sort(F.transform("_within", lambda x: x["price"])))
        .withColumn("_q1", sorted_quantile(F.col("_prices"), 0.25))
        .withColumn("_q3", sorted_quantile(F.col("_prices"), 0.75))
        .withColumn("_low", F.col("_q1") - 1.5 * (F.col("_q3") - F.col("_q1")))
        .withColumn("_high", F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1")))
        .withColumn(
            "_clipped",
            F.when(
                F.size("_within") >= 4,
                F.filter("_within", lambda x: x["price"].between(F.col("_low"), F.col("_high"))),
            ).otherwise(F.col("_within")),
        )
    )
    far = F.lit(9e15)
    nearest = F.transform(
        F.slice(
            F.array_sort(
                F.transform(
                    "_clipped",
                    lambda x: F.struct(F.coalesce(x["distance"], far).alias("d"), x["rank"].alias("r"), x.alias("x")),
                )
            ),
            1,
            fixed.SAMPLE_CAP,
        ),
        lambda s: s["x"],
    )
    over_cap = F.size("_clipped") > fixed.SAMPLE_CAP
    return staged.select(
        *samples.columns,
        F.when(over_cap, nearest).otherwise(F.col("_clipped")).alias("kept"),
        count("_verdicts", "price").alias("rejected_price"),
        count("_verdicts", "surface").alias("rejected_surface"),
        count("_verdicts", "value").alias("rejected_value"),
        (F.size("_within") - F.size("_clipped")).alias("rejected_iqr"),
        F.greatest(F.lit(0), F.size("_clipped") - fixed.SAMPLE_CAP).alias("rejected_cap"),
    )


def within_bounds(price: Column, surface: Column, value: Column) -> Column:
    """Whether a sale is inside the absolute bounds of its type (``property_type``)."""
    price_min, price_max, surface_min, surface_max = (_by_type(i) for i in range(4))
    fine = price.isNotNull() & ~F.isnan(price) & price.between(price_min, price_max) & surface.between(surface_min, surface_max)
    return F.coalesce(fine & (value.isNull() | value.between(fixed.SALE_VALUE_MIN, fixed.SALE_VALUE_MAX)), F.lit(False))


def kept_count(picks: Column) -> Column:
    """How many sales ``clean_samples`` keeps of an array of (price, fine)."""

    def clipped(ordered: Column) -> Column:
        def fence(q: Column) -> Column:
            low, high = q["a"] - 1.5 * (q["b"] - q["a"]), q["b"] + 1.5 * (q["b"] - q["a"])
            return F.size(F.filter(ordered, lambda v: v.between(low, high)))

        quartiles = F.struct(sorted_quantile(ordered, 0.25).alias("a"), sorted_quantile(ordered, 0.75).alias("b"))
        return F.when(F.size(ordered) >= 4, bind(quartiles, fence)).otherwise(F.size(ordered))

    prices = F.array_sort(F.transform(F.filter(picks, lambda x: x["fine"]), lambda x: x["price"]))
    return F.least(F.lit(fixed.SAMPLE_CAP), bind(prices, clipped))


def rejected_map() -> Column:
    """Non-zero reject counters as a map."""
    counters = [
        ("prix_hors_bornes", "rejected_price"),
        ("surface_hors_bornes", "rejected_surface"),
        ("valeur_hors_bornes", "rejected_value"),
        ("iqr", "rejected_iqr"),
        ("plafond_echantillon", "rejected_cap"),
    ]
    entries = F.array_compact(
        F.array(*[F.when(F.col(c) > 0, F.struct(F.lit(name), F.col(c).cast("long"))) for name, c in counters])
    )
    return F.map_from_entries(entries)
