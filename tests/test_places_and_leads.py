import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from plotline.functions import events as ev
from plotline.functions import geo, privacy, text
from plotline.operators import leads as le
from plotline.operators import maintain as ma
from plotline.operators import market as mk
from plotline.operators import places as pl


def one(df, *columns):
    return tuple(df.select(*columns).first())


def test_keyed_hash_equals_hmac(spark):
    for secret in ("secret", "k" * 100):
        got = one(spark.range(1), privacy.keyed_ip(F.lit(" 10.0.0.1 "), secret))[0]
        assert got == hmac.new(secret.encode(), b"10.0.0.1", hashlib.sha256).hexdigest()
    assert one(spark.range(1), privacy.keyed_ip(F.lit("  "), "s"), privacy.hashed_agent(F.lit(None).cast("string"))) == (None, None)


def test_masked_email(spark):
    cases = {"jean.dupont@gmail.com": "j***t@gmail.com", "ab@x.fr": "a***@x.fr", "nobody": "***", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "e string")
    assert {r[0]: r[1] for r in df.select("e", privacy.masked_email(F.col("e"))).collect()} == cases


def test_phone_forms(spark):
    cases = {"06 12 34 56 78": "+33612345678", "0033612345678": "+33612345678", "33612345678": "+33612345678", "123": ""}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", privacy.international_phone(F.col("p"))).collect()} == cases


def test_similarity(spark):
    assert one(spark.range(1), F.round(text.similarity(F.lit("word"), F.lit("words")), 4)) == (0.5714,)


def test_ligatures_of_searched_names(spark):
    communes = spark.createDataFrame(
        [("80001", "oeuilly", ["80000"], 10), ("80002", "euilly", ["80000"], 99), ("80003", "weiss", ["80000"], 5)],
        "code_insee string, nom_normalise string, codes_postaux array<string>, population int",
    )
    for name in ("nom", "code_departement", "code_region", "code_epci", "densite_grille", "longitude", "latitude", "has_dvf"):
        communes = communes.withColumn(name, F.lit(None).cast("string"))
    asked = spark.createDataFrame([("80000", "Œuilly"), ("80000", "weiß")], "postal_code string, city string")
    found = {r.city: (r.code_insee, r.score) for r in pl.best_named(asked, communes).collect()}
    assert found == {"Œuilly": ("80001", 1.0), "weiß": ("80003", 1.0)}


def test_distance_is_ellipsoidal(spark):
    got = one(spark.range(1), *[geo.distance_m(F.lit(2.0), F.lit(46.0), F.lit(x), F.lit(y)) for x, y in ((2.0, 46.01), (2.01, 46.0))])
    assert got[0] == pytest.approx(1111.46, abs=0.1) and got[1] == pytest.approx(774.7, abs=0.3)


def test_precision_floor_comes_first(spark):
    cases = [("street", 0.2, "reject"), ("housenumber", 0.7, "exact"), ("housenumber", 0.5, "approximate"), ("municipality", 0.9, "reject")]
    df = spark.createDataFrame([c[:2] for c in cases], "k string, s double")
    assert [r[0] for r in df.select(pl.precision_class(F.col("k"), F.col("s"))).collect()] == [c[2] for c in cases]


def test_lead_value(spark):
    values = [ev.lead_value(F.lit("yes"), F.lit("yes"), F.lit(500_000.0)), ev.lead_value(F.lit("no"), F.lit("no"), F.lit(None).cast("double"))]
    assert one(spark.range(1), *values) == (600.0, 20.0)


def test_last_campaign_wins_else_first_touch(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [
        (1, t(1), 1, "https://s.example/", "https://www.google.com/x"), (1, t(2), 2, "https://s.example/?gclid=a", ""),
        (1, t(3), 3, "https://s.example/?utm_source=b", ""), (1, t(4), 4, "https://s.example/c", ""),
        (2, t(1), 5, "https://s.example/first", ""), (2, t(2), 6, "https://s.example/next", ""),
    ]
    df = spark.createDataFrame(rows, "session_id long, ts timestamp, event_id long, href string, referrer string")
    got = {r.session_id: (r.block.source, r.block.landingPage, r.channel) for r in le.session_attribution(df, "s.example").collect()}
    assert got == {1: ("b", "/", "b"), 2: (None, "/first", "Accès direct")}


def _land(spark, prices, commune, months=0, outlier=False):
    day = dt.date(2026, 1, 15) - dt.timedelta(days=31 * months)
    return spark.createDataFrame(
        [(commune, "23", float(p), day, outlier) for p in prices],
        "code_insee string, code_departement string, prix_m2 double, date_mutation date, is_outlier boolean",
    )


def _price(spark, land):
    places = spark.createDataFrame([("23096", "23")], "code_insee string, code_departement string")
    return mk.land_price(places, land, "2026-01-15").first().land_price


def test_land_medians(spark):
    assert _price(spark, _land(spark, [60] * 4, "23096")) is None
    assert _price(spark, _land(spark, [60] * 5, "23096").union(_land(spark, [12] * 20, "23001"))) == 60
    assert _price(spark, _land(spark, [400], "23096").union(_land(spark, [25] * 9, "23001"))) == 25
    assert _price(spark, _land(spark, [60] * 10, "23096", months=72)) is None
    assert _price(spark, _land(spark, [60] * 5, "23096").union(_land(spark, [500] * 20, "23096", outlier=True))) == 60


SALE = "dedup_key string, date_mutation date, code_departement string, source_annee int, is_outlier boolean, exclusion_reason string"


def _sales(spark, *rows):
    return spark.createDataFrame([(k, dt.date(y, 1, 1), d, v, False, None) for k, y, d, v in rows], SALE)


def test_import_replay_stale_and_repair(spark, tmp_path):
    path = str(tmp_path / "sales")
    first = _sales(spark, ("a", 2025, "23", 2025), ("b", 2025, "23", 2025), ("c", 2024, "23", 2024), ("d", 2025, "19", 2025))
    assert ma.write_import(path, first).first().inserted == 4
    replay = ma.write_import(path, first).first()
    assert (replay.inserted, replay.updated, replay.stale_marked) == (0, 4, 0)
    cut = ma.write_import(path, _sales(spark, ("a", 2025, "23", 2025))).first()
    assert (cut.inserted, cut.updated, cut.stale_marked) == (0, 1, 1)
    marks = {r.dedup_key: r.exclusion_reason for r in spark.read.parquet(path).collect()}
    assert marks == {"a": None, "b": "stale_reimport", "c": None, "d": None}
    ma.write_import(path, first)
    assert spark.read.parquet(path).filter("exclusion_reason IS NOT NULL").count() == 0


def test_changed_rules_import_again(spark):
    cols = "annee int, code_departement string, sha256 string, etag string"
    files = spark.createDataFrame([(2025, "23", "x", None), (2025, "19", "y", "t"), (2025, "87", "z", None)], cols)
    log = spark.createDataFrame(
        [(2025, "23", "x", None, "success", 1), (2025, "19", "other", "t", "success", 1), (2025, "87", "z", None, "failed", 1)],
        cols + ", status string, rules_version int",
    )
    left = lambda v: sorted(r.code_departement for r in ma.files_to_import(files, log, v).collect())
    assert left(1) == ["87"] and left(2) == ["19", "23", "87"]
