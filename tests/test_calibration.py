"""Energy effects that are known, and a backtest that nothing later can change."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from plotline.catalog import comparables as cc
from plotline.operators import calibration as ca
from plotline.operators import valuation as va
from plotline.plans import backtest as bt
from plotline.sources import sample_market as sm

EFFECTS = {"A": 0.10, "B": 0.06, "C": 0.03, "D": 0.0, "E": -0.05, "F": -0.09, "G": -0.15}


def sale(n, draw, stratum, effects):
    commune, kind, energy = draw.randrange(12), draw.choice(["maison", "appartement"]), draw.choice("ABCDEFG")
    surface, year = draw.uniform(20, 200), draw.randrange(2018, 2024)
    price = 2000 * math.exp(0.3 * (commune % 5) + (0.1 if kind == "maison" else 0) - 0.2 * math.log(surface) + 0.02 * (year - 2018) + effects[energy])
    return (str(n), f"b{n}", kind, price, surface, datetime.date(year, 5, 1), f"{stratum}{commune:02}", stratum, energy)


def test_known_effects_come_back(spark):
    draw = random.Random(5)
    rows = [sale(n, draw, 1, EFFECTS) for n in range(1500)] + [sale(n, draw, 2, {c: 2 * e for c, e in EFFECTS.items() if c}) for n in range(2000, 3500)]
    rows += [("odd", None, "maison", None, 50.0, None, "101", 1, "A"), ("land", "b-land", "terrain", 9.0, 5.0, datetime.date(2020, 1, 1), "101", 1, "A"), ("free", "b-free", "maison", 0.0, 50.0, datetime.date(2020, 1, 1), "101", 1, "A")]
    schema = "sale_id string, ban_id string, type_local string, price double, surface double, date_mutation date, code_insee string, densite_grille int, energy string"
    frame = spark.createDataFrame(rows, schema)
    certificates = frame.select("ban_id", F.col("energy").alias("energy_class"), F.lit("2020-01-01").cast("date").alias("issued_on"))
    older = frame.select("ban_id", F.lit("G").alias("energy_class"), F.lit("2019-01-01").cast("date").alias("issued_on"))
    certified = ca.certified_sales(frame.drop("energy"), certificates.union(older).union(certificates.withColumn("energy_class", F.lit("unknown"))))
    found = {(r.densite_grille, r.energy_class): r for r in ca.energy_effects(certified).collect()}
    assert len(found) == 14
    for (stratum, energy), r in found.items():
        assert r.effect == pytest.approx(stratum * EFFECTS[energy], abs=1e-9) and r.coefficient == pytest.approx(math.exp(r.effect))
    used = ca.calibrated_coefficients(va.coefficient_rows(spark), ca.energy_effects(certified), certified, "2024-01-01").collect()
    assert {(r.cle, r.densite_min): float(r.valeur) for r in used}[("dpe.G", 2)] == 0.8  # bounded
    assert {r.source_label for r in used} == {"calibrated on sales"}


def test_no_sales_no_effects(spark):
    empty = spark.createDataFrame([], "sale_id string, ban_id string, type_local string, price double, surface double, date_mutation date, code_insee string, densite_grille int, energy_class string")
    assert ca.energy_effects(empty).count() == 0


def test_a_latest_certificate_of_one_day_is_the_worst(spark):
    rows = [("x", "B", "2020-01-01"), ("x", "E", "2020-01-02"), ("x", "C", "2020-01-02"), (None, "A", "2020-01-01"), ("y", "Z", "2020-01-01"), ("z", "A", None)]
    frame = spark.createDataFrame(rows, "ban_id string, energy_class string, issued_on string").withColumn("issued_on", F.col("issued_on").cast("date"))
    assert [tuple(r) for r in ca.latest_classes(frame).collect()] == [("x", "E")]


def test_later_and_held_out_sales_change_no_replayed_value(spark):
    folder, day = "/root/testdata/sf0.001", "2001-06-01"
    m, communes = cc.market(spark, folder), sm.communes(spark, folder)

    def values(built, land):
        rows, report = bt.backtest(built, land, communes, va.coefficient_rows(spark), va.department_references(spark), day, 24, 0.3)
        total = report.where("grouped = ''").first()
        assert total["n"] == rows.count()
        return {r.request_id: (r.value, r.low, r.high) for r in rows.collect()}

    before = values(m["built"], m["land"])
    assert before
    chosen = bt.sw.held_out(F.col("id_mutation"), 0.3) & (F.col("date_mutation") >= "1999-06-01") | (F.col("date_mutation") >= "2001-05-01")
    dearer = [t.withColumn("prix_m2", F.when(chosen, F.col("prix_m2") * 3).otherwise(F.col("prix_m2")).cast("decimal(12,2)")) for t in (m["built"], m["land"])]
    assert values(*dearer) == before
