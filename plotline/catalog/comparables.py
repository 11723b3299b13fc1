"""The comparable search: distance, radius join, areas, cascade, trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.catalog import places, sales
from plotline.catalog.entries import part, query, shared
from plotline.functions import geo
from plotline.operators import comparables as cp
from plotline.operators import consolidate as co
from plotline.operators import market as mk
from plotline.operators.samples import clean_samples
from plotline.session import settle
from plotline.sources import sample_market as sm

TODAY = sm.REFERENCE_DATE

part("market_sales", """
  SELECT s.id_mutation AS sale_id, s.type_local, s.surface, s.surface_terrain, s.date_mutation, s.prix_m2::DOUBLE AS price,
    s.valeur_fonciere::DOUBLE AS value, s.nb_pieces AS rooms, s.adresse_voie AS street, s.code_insee, s.code_departement,
    s.longitude, s.latitude, c.nom AS city, c.code_epci, c.code_region, c.densite_grille, m.med
  FROM (SELECT * FROM sales UNION ALL BY NAME SELECT * FROM land) s LEFT JOIN communes c USING (code_insee)
    LEFT JOIN medians m ON m.code_insee = s.code_insee AND m.type_local = s.type_local WHERE NOT s.is_outlier""")
part("searches", """
  SELECT l.*, m.med AS ref_med, CASE WHEN property_type = 'terrain' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS base,
    CASE WHEN property_type = 'terrain' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS wider,
    CASE WHEN property_type = 'terrain' THEN 2 ELSE 1 END AS divisor
  FROM located l LEFT JOIN medians m ON m.code_insee = l.code_insee AND m.type_local = l.property_type
  WHERE has_dvf AND property_type <> 'local-commercial' AND lon IS NOT NULL AND lat IS NOT NULL""")
_PLAN_ROWS = ", ".join(
    f"({a.number}, '{a.level}', {a.radius if a.radius else 'NULL'}, {a.months}, {a.minimum}, {str(a.wide).lower()}, {str(a.flagged).lower()})"
    for a in cp.PLAN
)
part("plan", f"""SELECT *, DATE '{TODAY}' - to_months(months) AS since FROM (VALUES {_PLAN_ROWS})
  t(attempt_no, level, radius_m, months, minimum, wide, widened)""")
part("near_pairs", f"""
  SELECT * FROM (SELECT r.request_id, r.surface AS wanted, r.base, r.wider, r.ref_med, s.*,
    {geo.distance_sql('r.lon', 'r.lat', 's.longitude', 's.latitude')} AS distance
  FROM searches r JOIN market_sales s ON s.type_local = r.property_type AND abs(s.latitude - r.lat) < 0.06 AND abs(s.longitude - r.lon) < 0.1)
  WHERE distance <= 5000""")
part("radius_fetch", """
  SELECT p.attempt_no, n.*, row_number() OVER (PARTITION BY request_id, p.attempt_no ORDER BY distance, sale_id) AS rank
  FROM near_pairs n JOIN plan p ON p.level = 'radius' AND n.distance <= p.radius_m AND n.date_mutation >= p.since
    AND n.surface BETWEEN greatest(0, wanted * (1 - CASE WHEN p.wide THEN wider ELSE base END))
                      AND wanted * (1 + CASE WHEN p.wide THEN wider ELSE base END)
    AND (p.radius_m < 2000 OR ref_med IS NULL OR med IS NULL OR abs(med - ref_med) <= 0.35::DOUBLE * ref_med)
  QUALIFY rank <= 200""")


def _area(level: str, condition: str) -> str:
    return f"""
  SELECT p.attempt_no, r.request_id, r.surface AS wanted, r.lon, r.lat, s.*,
    row_number() OVER (PARTITION BY r.request_id, p.attempt_no ORDER BY abs(s.surface - r.surface), s.date_mutation DESC, s.sale_id) AS rank
  FROM searches r JOIN plan p ON p.level = '{level}' JOIN market_sales s ON s.type_local = r.property_type AND {condition}
    AND s.date_mutation >= p.since AND s.surface BETWEEN greatest(0, r.surface * (1 - CASE WHEN p.wide THEN r.wider ELSE r.base END))
      AND r.surface * (1 + CASE WHEN p.wide THEN r.wider ELSE r.base END)
  QUALIFY rank <= 200"""


part("area_fetch", " UNION ALL ".join(
    f"SELECT * FROM ({_area(level, condition)})"
    for level, condition in (
        ("commune", "s.code_insee = r.code_insee"),
        ("epci", "s.code_epci = r.code_epci"),
        ("departement", "s.code_departement = r.code_departement"),
        ("region", "s.code_region = r.code_region"),
        ("national", "(r.densite_grille IS NULL OR s.densite_grille = r.densite_grille)"),
    )
))
_FETCH = "attempt_no, request_id, sale_id, type_local, surface, surface_terrain, date_mutation, price, value, rooms, street, city, rank, distance"
part("fetched_rows", f"""
  SELECT {_FETCH} FROM radius_fetch UNION ALL
  SELECT {_FETCH} FROM (SELECT *, {geo.distance_sql('lon', 'lat', 'longitude', 'latitude')} AS distance FROM area_fetch)""")
part("bounded_rows", """
  SELECT *, CASE WHEN price < CASE WHEN type_local = 'terrain' THEN 1 ELSE 200 END OR price > 25000 THEN 'price'
    WHEN surface < CASE WHEN type_local = 'terrain' THEN 1 ELSE 9 END OR surface > CASE WHEN type_local = 'terrain' THEN 100000 ELSE 1000 END THEN 'surface'
    WHEN value < 5000 OR value > 15000000 THEN 'value' ELSE 'ok' END AS verdict FROM fetched_rows""")
part("quartiles", """
  SELECT request_id, attempt_no, count(*) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3
  FROM bounded_rows WHERE verdict = 'ok' GROUP BY 1, 2""")
part("clipped_rows", """
  SELECT b.*, row_number() OVER (PARTITION BY request_id, attempt_no ORDER BY distance NULLS LAST, rank) AS near_rank
  FROM bounded_rows b JOIN quartiles q USING (request_id, attempt_no)
  WHERE verdict = 'ok' AND (n < 4 OR price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""")
part("attempt_counts", """
  SELECT request_id, attempt_no, f.fetched, coalesce(k.kept, 0) AS kept FROM
   (SELECT request_id, attempt_no, count(*) AS fetched FROM fetched_rows GROUP BY 1, 2) f
   LEFT JOIN (SELECT request_id, attempt_no, least(150, count(*)) AS kept FROM clipped_rows GROUP BY 1, 2) k USING (request_id, attempt_no)""")
part("attempts", """
  SELECT r.request_id, p.*, round(100 * CASE WHEN p.wide THEN wider ELSE base END)::INT AS tolerance_pct,
    coalesce(a.fetched, 0) AS fetched, coalesce(a.kept, 0) AS kept,
    greatest(5, ceil(p.minimum / r.divisor))::INT AS required, coalesce(a.kept, 0) >= greatest(5, ceil(p.minimum / r.divisor)) AS accepted
  FROM searches r CROSS JOIN plan p LEFT JOIN attempt_counts a ON a.request_id = r.request_id AND a.attempt_no = p.attempt_no""")
part("accepted_rows", "SELECT request_id, min(attempt_no) AS attempt_no FROM attempts WHERE accepted GROUP BY 1")


# --- Spark inputs -----------------------------------------------------------


def market(spark, d):
    """Searchable sales and commune medians."""

    def build():
        both = sales.facts(spark, d)
        both = settle(both)
        built = co.built_sales(co.built_candidates(both))
        land = co.land_sales(co.land_candidates(both))
        medians = settle(mk.guard_medians(mk.commune_bands(built), land))
        return {
            "built": built, "land": land, "medians": medians,
            "sales": settle(cp.searchable_sales(built, land, sm.communes(spark, d), medians)),
        }

    return shared("market", spark, d, build)


def searches(spark, d):
    def build():
        located = places.located(spark, d)
        asked = (
            located.filter(
                F.col("has_dvf") & F.col("property_type").isin(list(fixed.SEARCH_PROFILES))
                & F.col("lon").isNotNull() & F.col("lat").isNotNull()
            )
            .withColumn("search_id", F.col("request_id"))
        )
        return settle(cp.with_reference_median(asked, market(spark, d)["medians"]))

    return shared("searches", spark, d, build)


def outcomes(spark, d):
    return shared(
        "outcomes", spark, d,
        lambda: settle(cp.find_comparables(searches(spark, d), market(spark, d)["sales"], TODAY)),
    )


def chosen(spark, d):
    return cp.chosen_samples(searches(spark, d), outcomes(spark, d), market(spark, d)["sales"])


# --- Queries ----------------------------------------------------------------


@query(
    "J01_J15_sale_distances",
    f"""SELECT s.sale_id, s.city, {geo.distance_sql('c.longitude', 'c.latitude', 's.longitude', 's.latitude')} AS to_centre
        FROM market_sales s LEFT JOIN communes c ON c.code_insee = s.code_insee""",
)
def sale_distances(spark, d):
    centre = sm.communes(spark, d).select(
        "code_insee", F.col("longitude").alias("c_lon"), F.col("latitude").alias("c_lat")
    )
    metres = geo.distance_m(F.col("c_lon"), F.col("c_lat"), F.col("longitude"), F.col("latitude"))
    return market(spark, d)["sales"].join(centre, "code_insee", "left").select("sale_id", "city", metres.alias("to_centre"))


@query(
    "J02_J03_J04_radius_pairs",
    f"""SELECT request_id, sale_id, distance FROM near_pairs WHERE distance <= 2000 AND date_mutation >= DATE '{TODAY}' - to_months(36)
        AND surface BETWEEN greatest(0, wanted * (1 - wider)) AND wanted * (1 + wider)""",
)
def radius_pairs(spark, d):
    pairs = cp.radius_pairs(searches(spark, d), market(spark, d)["sales"], 2_000, cp.window_start(TODAY, 36))
    return pairs.select(F.col("search_id").alias("request_id"), "sale_id", "distance")


@query(
    "J05_window_starts",
    """SELECT o_orderkey AS id, (CAST(o_orderdate AS DATE) - to_months(1))::DATE::VARCHAR AS m1,
       (CAST(o_orderdate AS DATE) - to_months(24))::DATE::VARCHAR AS m24, (CAST(o_orderdate AS DATE) - to_months(36))::DATE::VARCHAR AS m36,
       (CAST(o_orderdate AS DATE) - to_months(60))::DATE::VARCHAR AS m60 FROM orders""",
)
def window_starts(spark, d):
    date = F.col("o_orderdate").cast("date")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    starts = [F.add_months(date, -m).cast("string").alias(f"m{m}") for m in (1, 24, 36, 60)]
    return orders.select(F.col("o_orderkey").alias("id"), *starts)


@query(
    "J06_J17_J21_search_profiles",
    """SELECT request_id, floor(greatest(0, surface * (1 - base)) * 1e4 + 0.5) / 1e4 AS base_low, floor(surface * (1 + base) * 1e4 + 0.5) / 1e4 AS base_high,
       floor(greatest(0, surface * (1 - wider)) * 1e4 + 0.5) / 1e4 AS wide_low, floor(surface * (1 + wider) * 1e4 + 0.5) / 1e4 AS wide_high,
       greatest(5, ceil(15 / divisor))::INT AS need_15, greatest(5, ceil(8 / divisor))::INT AS need_8 FROM searches""",
)
def search_profiles(spark, d):
    tidy = lambda c: F.floor(c * 1e4 + 0.5) / 1e4
    base = cp.surface_band(F.col("surface"), cp.tolerance(F.lit(False)))
    wide = cp.surface_band(F.col("surface"), cp.tolerance(F.lit(True)))
    return searches(spark, d).select(
        "request_id", tidy(base[0]).alias("base_low"), tidy(base[1]).alias("base_high"),
        tidy(wide[0]).alias("wide_low"), tidy(wide[1]).alias("wide_high"),
        cp.required_count(F.lit(15)).alias("need_15"), cp.required_count(F.lit(8)).alias("need_8"),
    )


@query(
    "J07_J08_radius_fetch",
    "SELECT request_id, attempt_no, sale_id, rank, distance FROM radius_fetch",
)
def radius_fetch(spark, d):
    attempts = [a for a in cp.PLAN if a.level == "radius"]
    samples = cp.radius_samples(searches(spark, d), market(spark, d)["sales"], attempts, TODAY)
    # rank restarts for each radius because a smaller radius is a prefix of a larger one
    return samples.select(F.col("search_id").alias("request_id"), "attempt_no", "x.sale_id", "x.rank", "x.distance")


@query(
    "J09_J10_J11_J12_J13_J14_area_fetch",
    f"""SELECT request_id, attempt_no, sale_id, rank, {geo.distance_sql('lon', 'lat', 'longitude', 'latitude')} AS distance FROM area_fetch""",
)
def area_fetch(spark, d):
    attempts = [a for a in cp.PLAN if a.level != "radius"]
    samples = cp.area_samples(searches(spark, d), market(spark, d)["sales"], attempts, TODAY)
    return samples.select(F.col("search_id").alias("request_id"), "attempt_no", "x.sale_id", "x.rank", "x.distance")


@query(
    "J16_J19_attempt_trace",
    """SELECT a.request_id, a.attempt_no, a.level, a.radius_m, a.months AS window_months, a.tolerance_pct, a.fetched, a.kept, a.required, a.accepted
       FROM attempts a LEFT JOIN accepted_rows c USING (request_id) WHERE a.attempt_no <= coalesce(c.attempt_no, 23)""",
)
def attempt_trace(spark, d):
    return cp.attempt_trace(searches(spark, d), outcomes(spark, d)).withColumnRenamed("search_id", "request_id")


@query(
    "J18_accepted_attempts",
    """SELECT request_id, attempt_no, a.level, a.radius_m, a.months AS window_months, a.tolerance_pct, a.widened, a.fetched
       FROM attempts a JOIN accepted_rows c USING (request_id, attempt_no)""",
)
def accepted_attempts(spark, d):
    return chosen(spark, d).select(
        F.col("search_id").alias("request_id"), "attempt_no", "level", "radius_m", "window_months", "tolerance_pct",
        "widened", F.size("sample").alias("fetched"),
    )


@query("J20_not_found", "SELECT request_id FROM searches ANTI JOIN accepted_rows USING (request_id)")
def not_found(spark, d):
    return cp.not_found(searches(spark, d), outcomes(spark, d)).select("request_id")


@query(
    "N01_N02_N03_N04_clean_samples",
    """SELECT request_id, attempt_no, count(*) AS fetched, least(150, max(clipped)) AS kept, count(*) FILTER (WHERE verdict = 'price') AS rejected_price,
       count(*) FILTER (WHERE verdict = 'surface') AS rejected_surface, count(*) FILTER (WHERE verdict = 'value') AS rejected_value,
       count(*) FILTER (WHERE verdict = 'ok') - max(clipped) AS rejected_iqr, greatest(0, max(clipped) - 150) AS rejected_cap
       FROM bounded_rows b JOIN accepted_rows USING (request_id, attempt_no)
       JOIN (SELECT request_id, attempt_no, count(*) AS clipped FROM clipped_rows GROUP BY 1, 2) USING (request_id, attempt_no) GROUP BY 1, 2""",
)
def cleaned_samples(spark, d):
    kinds = searches(spark, d).select("search_id", "property_type")
    cleaned = clean_samples(chosen(spark, d).join(kinds, "search_id"))
    return cleaned.select(
        F.col("search_id").alias("request_id"), "attempt_no", F.size("sample").alias("fetched"),
        F.size("kept").alias("kept"), "rejected_price", "rejected_surface", "rejected_value", "rejected_iqr", "rejected_cap",
    )
