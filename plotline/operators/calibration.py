"""Energy-class coefficients fitted on the sales themselves, one model per density stratum.

The logarithm of a price per square metre is explained by the energy class,
with type, surface, year and commune as controls.  Communes are taken out by
centring every column on its commune's mean, which leaves the same class
coefficients as one column for each commune would.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.functions.numbers import clamp, half_up_decimals
from plotline.session import settle

CLASSES = [c for c in fixed.DPE_CLASSES if c != "unknown"]
#: The class that the others are measured against.
BASE_CLASS = "D"
#: A column that varies less than this within communes says nothing.
LEAST_VARIATION = 1e-9
FITTED = "densite_grille int, energy_class string, n long, effect double, coefficient double"


def latest_classes(certificates: DataFrame) -> DataFrame:
    """ban_id and the class of its latest certificate; of several issued on one day, the worst.

    ``certificates``: ban_id, energy_class, issued_on.  Day and class are one
    number, so the choice is a plain hashed maximum.
    """
    number = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("energy_class"))
    known = certificates.where(F.col("energy_class").isin(CLASSES) & F.col("issued_on").isNotNull() & F.col("ban_id").isNotNull())
    packed = F.unix_date("issued_on").cast("long") * (len(CLASSES) + 1) + number
    latest = known.groupBy("ban_id").agg(F.max(packed).alias("packed"))
    return latest.select("ban_id", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.pmod("packed", F.lit(len(CLASSES) + 1)).cast("int")).alias("energy_class"))


def certified_sales(sales: DataFrame, certificates: DataFrame) -> DataFrame:
    """``sales`` with the energy class of their address, null where none is known."""
    return sales.join(latest_classes(certificates), "ban_id", "left")


def _columns(years: list[int]) -> dict[str, Column]:
    """The explained column and the explaining ones; ``first_year`` is the stratum's."""
    classes = {f"class_{c}": F.col("energy_class") == c for c in CLASSES if c != BASE_CLASS}
    periods = {f"year_{y}": (F.col("year") == y) & (F.col("first_year") < y) for y in years}
    flags = classes | {"house": F.col("type_local") == "maison"} | periods
    return {"log_price": F.log("price"), "log_surface": F.log("surface")} | {n: c.cast("double") for n, c in flags.items()}


def centred(certified: DataFrame) -> tuple[DataFrame, list[str]]:
    """densite_grille and all columns less their commune's mean; the names of the explaining ones."""
    rows = certified.where(
        F.col("type_local").isin("appartement", "maison") & F.col("energy_class").isNotNull() & F.col("densite_grille").isNotNull()
        & F.col("code_insee").isNotNull() & (F.col("price") > 0) & (F.col("surface") > 0)
    ).select("densite_grille", "code_insee", "type_local", "energy_class", "price", F.col("surface").cast("double").alias("surface"), F.year("date_mutation").alias("year"))
    rows = settle(rows)
    # One row for each stratum, and calendar years.
    first = rows.groupBy("densite_grille").agg(F.min("year").alias("first_year"))
    years = sorted(r.year for r in rows.select("year").distinct().collect() if r.year is not None)
    columns = _columns(years)
    wide = rows.join(F.broadcast(first), "densite_grille").select("densite_grille", "code_insee", "energy_class", *[c.alias(n) for n, c in columns.items()])
    # Written first, so that a commune with very many sales can be split where its means come back.
    means = settle(wide.groupBy("code_insee").agg(*[F.avg(n).alias(f"mean_{n}") for n in columns]))
    out = wide.join(means, "code_insee").select("densite_grille", "energy_class", *[(F.col(n) - F.col(f"mean_{n}")).alias(n) for n in columns])
    return settle(out), [n for n in columns if n != "log_price"]


def energy_effects(certified: DataFrame) -> DataFrame:
    """densite_grille, energy_class, n, effect (on the logarithm) and coefficient (its factor).

    ``certified``: output of ``certified_sales`` with price, surface, type_local,
    date_mutation, code_insee and densite_grille.  Classes that a stratum never
    shows beside others within a commune have no row.
    """
    rows, names = centred(certified)
    spread = rows.groupBy("densite_grille").agg(*[F.sum(F.col(n) * F.col(n)).alias(n) for n in names])
    counts = rows.groupBy("densite_grille", "energy_class").agg(F.count("*").alias("n"))
    # Both are bounded by the strata: seven densities.
    used = {r.densite_grille: [n for n in names if r[n] > LEAST_VARIATION] for r in spread.collect()}
    often = {(r.densite_grille, r.energy_class): r.n for r in counts.collect()}
    out = []
    for stratum, features in sorted(used.items()):
        classes = [n for n in features if n.startswith("class_")]
        if not classes:
            continue
        part = VectorAssembler(inputCols=features, outputCol="features").transform(rows.where(F.col("densite_grille") == stratum))
        fit = LinearRegression(labelCol="log_price", solver="normal", fitIntercept=False, standardization=False).fit(part.select("features", "log_price"))
        effects = dict(zip(features, fit.coefficients.tolist(), strict=True))
        out += [(stratum, n[-1], often[(stratum, n[-1])], effects[n], math.exp(effects[n])) for n in classes]
        if (stratum, BASE_CLASS) in often:
            out.append((stratum, BASE_CLASS, often[(stratum, BASE_CLASS)], 0.0, 1.0))
    return certified.sparkSession.createDataFrame(out, FITTED)


def calibrated_coefficients(reference: DataFrame, effects: DataFrame, certified: DataFrame, fitted_on: str) -> DataFrame:
    """The class rows of the coefficient table for each density stratum, with their source.

    A stratum's own effects replace the reference where enough of its sales have
    a class (``CALIBRATION_MIN_SHARE``) and the class itself has enough
    (``CALIBRATION_MIN_SALES``); every other class keeps its reference value.
    """
    dwelling = F.col("type_local").isin("appartement", "maison") & F.col("densite_grille").isNotNull()
    share = certified.where(dwelling).groupBy("densite_grille").agg(F.avg(F.col("energy_class").isNotNull().cast("double")).alias("share"))
    classes = reference.where(F.col("cle").startswith("dpe.") & F.col("actif") & F.col("densite_min").isNull())
    listed = classes.agg(F.collect_list(F.struct("cle", "type_bien", "valeur"))).scalar()  # a row for each class and type
    rows = share.withColumn("r", F.explode(listed)).select("densite_grille", "share", "r.*")
    good = effects.where(F.col("n") >= fixed.CALIBRATION_MIN_SALES).select("densite_grille", F.concat(F.lit("dpe."), "energy_class").alias("cle"), "coefficient")
    rows = rows.join(good, ["densite_grille", "cle"], "left")
    own = (F.col("share") >= fixed.CALIBRATION_MIN_SHARE) & F.col("coefficient").isNotNull()
    value = clamp(half_up_decimals(F.col("coefficient"), 4), *fixed.COEFFICIENT_BOUNDS["dpe"])
    return rows.select(
        "cle", "type_bien", F.when(own, value.cast("string")).otherwise(F.col("valeur")).alias("valeur"), F.col("densite_grille").alias("densite_min"), F.lit(True).alias("actif"),
        F.when(own, "calibrated on sales").otherwise("reference").alias("source_label"), F.when(own, F.lit(fitted_on)).cast("date").alias("date_source"),
    )
