"""Rounding, clamping and quantiles over bounded arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline import fixed_values as fixed


def money(c: Column) -> Column:
    """Two decimals, half up on the decimal form of the number."""
    return F.round(c.cast("decimal(20,6)"), 2)


def half_up(c: Column, step: float = 1) -> Column:
    """Round to a multiple of ``step``, halves towards plus infinity."""
    return F.floor(c / F.lit(float(step)) + 0.5) * F.lit(float(step))


def half_up_decimals(c: Column, decimals: int) -> Column:
    scale = float(10**decimals)
    return F.floor(c * scale + 0.5) / scale


def display_value(c: Column) -> Column:
    """Thousands from 100 000 up, hundreds below; zero for a non-finite value."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite, F.when(F.abs(c) >= 100_000, half_up(c, 1_000)).otherwise(half_up(c, 100))).otherwise(0.0)


def clamp(c: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(F.isnan(c), low).otherwise(F.greatest(low, F.least(high, c)))


def months_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(fixed.DAYS_PER_MONTH)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def array_quantile(values: Column, q: float) -> Column:
    """Interpolated quantile of an array of doubles; null for an empty one.

    Meant for samples whose size the search already bounds.
    """
    return bind(F.array_sort(values), lambda ordered: sorted_quantile(ordered, q))


def sorted_quantile(ordered: Column, q: float) -> Column:
    position = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.floor(position).cast("int")
    below = F.try_element_at(ordered, low + 1)
    above = F.coalesce(F.try_element_at(ordered, low + 2), below)
    return F.when(F.size(ordered) > 0, below + (above - below) * (position - low))


def weighted_quantiles(entries: Column, qs: dict[str, float]) -> Column:
    """Struct of weighted quantiles: first value whose running weight reaches q.

    ``entries`` is an array of ``struct<value: double, weight: decimal>``.
    Decimal weights add up the same way on every engine and in every order.
    With no positive weight left, the plain quantile answers.
    """
    usable = F.array_sort(
        F.filter(entries, lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]) & (e["weight"] > 0))
    )
    zero = F.lit(0).cast("decimal(30,20)")
    start = F.struct(zero.alias("run"), F.lit(None).cast("double").alias("value"))

    def reach(ordered: Column, target: Column) -> Column:
        def step(acc, e):
            run = (acc["run"] + e["weight"]).cast("decimal(30,20)")
            return F.struct(
                run.alias("run"), F.coalesce(acc["value"], F.when(run >= target, e["value"])).alias("value")
            )

        return F.aggregate(ordered, start, step)["value"]

    def of_total(ordered: Column, total: Column) -> Column:
        share = lambda q: (total * F.lit(q).cast("decimal(4,2)")).cast("decimal(34,22)")
        plain = lambda q: array_quantile(F.transform(entries, lambda e: e["value"]), q)
        return F.struct(
            *[
                F.when(F.size(ordered) > 0, bind(share(q), lambda t: reach(ordered, t))).otherwise(plain(q)).alias(name)
                for name, q in qs.items()
            ]
        )

    add = lambda acc, e: (acc + e["weight"]).cast("decimal(30,20)")
    return bind(usable, lambda u: bind(F.aggregate(u, zero, add), lambda total: of_total(u, total)))
