"""Numbers of the valuation, stated beforehand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plotline.functions import numbers as num
from plotline.operators import comparables as cp
from plotline.operators import valuation as va

SAMPLE = (
    "array<struct<rank:int,sale_id:string,surface:double,land:double,date:date,price:double,value:double,rooms:int,"
    "street:string,city:string,longitude:double,latitude:double,distance:double>>"
)
REQUEST = (
    "request_id long, property_type string, surface double, dpe string, condition string, outdoor string, floor int, "
    "has_elevator boolean, is_top_floor boolean, terrain_size double, precision string, level string, radius_m int, "
    f"widened boolean, land_price double, sample {SAMPLE}"
)


def one(df, *columns):
    return tuple(df.select(*columns).first())


@pytest.fixture(scope="module")
def single(spark):
    return spark.range(1)


def test_quantiles(single):
    values = F.array(*[F.lit(float(v)) for v in (4, 1, 3, 2)])
    assert one(single, *[num.array_quantile(values, q) for q in (0.25, 0.5, 0.75)]) == (1.75, 2.5, 3.25)


@pytest.mark.parametrize(
    "pairs, expected", [(((100, 1), (200, 1000), (300, 1)), 200.0), (((100, 0), (300, 0)), 200.0)]
)
def test_weighted_median(single, pairs, expected):
    entries = F.array(
        *[F.struct(F.lit(float(v)).alias("value"), F.lit(w).cast("decimal(24,20)").alias("weight")) for v, w in pairs]
    )
    assert one(single, num.weighted_quantiles(entries, {"m": 0.5})["m"]) == (expected,)


def test_display_rounding(single):
    values = [num.display_value(F.lit(float(v))) for v in (99_949, 123_456, 123_654)]
    assert one(single, *values) == (99_900.0, 123_000.0, 124_000.0)


def test_distance_weights(single):
    assert one(single, *[va.distance_weight(F.lit(float(d))) for d in (0, 500, 1000)]) == (1.0, 0.5, 0.2)


def test_windows_and_thresholds(spark, single):
    days = [cp.window_start(d, 1).cast("string") for d in ("2025-03-31", "2024-03-31")]
    assert one(single, *days) == ("2025-02-28", "2024-02-29")
    land = spark.createDataFrame([("terrain",)], "property_type string")
    assert one(land, *[cp.required_count(F.lit(n)) for n in (15, 12, 8)]) == (8, 6, 5)
    flat = spark.createDataFrame([("appartement",)], "property_type string")
    bands = [x for wide in (False, True) for x in cp.surface_band(F.lit(100.0), cp.tolerance(F.lit(wide)))]
    assert one(flat, *[F.round(b, 6) for b in bands]) == (70.0, 130.0, 60.0, 140.0)


def test_attempt_order():
    assert len(cp.PLAN) == 23
    assert [(a.number, a.level) for a in cp.PLAN if a.level != "radius"] == [
        (9, "commune"), (18, "commune"), (19, "epci"), (20, "commune"), (21, "departement"), (22, "region"), (23, "national"),
    ]
    assert [a.number for a in cp.PLAN if a.flagged] == list(range(10, 19))


@pytest.mark.parametrize(
    "size, median, price, expected",
    [(1800.0, 800.0, 30.0, 30_000.0), (300.0, 800.0, 30.0, -15_000.0), (4000.0, 500.0, 100.0, 50_000.0)],
)
def test_land_adjustment(spark, size, median, price, expected):
    row = spark.createDataFrame(
        [("maison", size, median, price, 0.08, 2000.0)],
        "property_type string, terrain_size double, median_land double, land_price double, land_ratio double, reference_price double",
    )
    assert one(row, va.land_adjustment(F.lit(200_000.0))) == (expected,)


def test_land_curve(single):
    assert one(single, va.land_curve(F.lit(6_000.0), F.lit(10.0))) == (53_000.0,)


def test_twenty_equal_sales(spark):
    sale = lambda i: (i, str(i), 65.0, None, dt.date(2025, 6, 1), 3000.0, 195_000.0, 3, "Rue", "Ville", 2.0, 46.0, 100.0)
    rows = [(1, "appartement", 65.0, "D", None, None, None, None, None, None, "exact", "radius", 500, False, None,
             [sale(i) for i in range(1, 21)])]
    valued = va.value_by_comparables(
        spark.createDataFrame(rows, REQUEST), va.coefficient_lookup(va.coefficient_rows(spark)), "2026-01-15"
    ).first()
    assert (valued.value, valued.price_m2, valued.k_total, valued.n) == (195_000.0, 3_000.0, 1.0, 20)
    assert valued.half_width == 0.04 and valued.clamped is False


def test_uncovered_department(spark):
    row = spark.createDataFrame(
        [(1, "appartement", 65.0, "unknown", None, None, None, None, None, None, "city-centroid", "67")],
        "request_id long, property_type string, surface double, dpe string, condition string, outdoor string, floor int, "
        "has_elevator boolean, is_top_floor boolean, terrain_size double, precision string, code_departement string",
    )
    valued = va.value_by_reference(
        row, va.coefficient_lookup(va.coefficient_rows(spark)), va.department_references(spark)
    ).first()
    assert (valued.score, valued.half_width, valued.label) == (35, 0.2, "low")


def test_anonymous_sale(spark):
    item = "struct<rank:int,surface:double,date:date,price:double,value:double,rooms:int,street:string,city:string,distance:double,adjusted:double>"
    row = spark.createDataFrame(
        [([(1, 90.0, dt.date(2024, 6, 18), 1234.0, 111_060.0, 4, None, "Guéret", 137.0, 1234.0)],)], f"kept array<{item}>"
    )
    x = row.select(va.anonymous_comparables(F.col("kept"))[0].alias("x")).first().x
    assert (x.distance_m, x.month, x.price_m2, x.price, x.street) == (150.0, "2024-06", 1230.0, 111_000.0, "")
