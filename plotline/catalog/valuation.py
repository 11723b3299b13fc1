"""Samples to values: weights, coefficients, land, confidence, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.catalog import comparables as cc
from plotline.catalog import places
from plotline.catalog.entries import part, query, shared
from plotline.catalog.maintenance import _folder as cm_folder
from plotline.functions import numbers as num
from plotline.operators import market as mk
from plotline.operators import valuation as va
from plotline.operators.maintain import append_rows
from plotline.operators.samples import clean_samples
from plotline.plans import portfolio as pf
from plotline.plans.store import value_once
from plotline.session import settle
from plotline.sources import sample_market as sm

TODAY = sm.REFERENCE_DATE


def _r(x: str, decimals: int = 4) -> str:
    return f"floor(({x}) * 1e{decimals} + 0.5) / 1e{decimals}"


def _step(x: str, step: str = "1e0") -> str:
    return f"floor(({x}) / {step} + 0.5) * {step}"


def _display(x: str) -> str:
    return f"(CASE WHEN abs({x}) >= 100000 THEN {_step(x, '1e3')} ELSE {_step(x, '1e2')} END)"


_AGE = f"greatest(0, date_diff('day', date_mutation, DATE '{TODAY}') / 30.4375::DOUBLE)"
part("kept_rows", f"""
  SELECT c.*, {_AGE} AS age, r.surface AS wanted,
    (1.0::DOUBLE / (1 + (distance / 500) * (distance / 500)) * pow(0.5, {_AGE} / 24) * (1.0::DOUBLE / (1 + abs(c.surface - r.surface) / r.surface)))::DECIMAL(24,20) AS weight
  FROM clipped_rows c JOIN accepted_rows USING (request_id, attempt_no) JOIN searches r USING (request_id) WHERE near_rank <= 150""")
part("running", """
  SELECT *, sum(weight) OVER (PARTITION BY request_id ORDER BY price, weight, sale_id ROWS UNBOUNDED PRECEDING) AS run,
    sum(weight) OVER (PARTITION BY request_id) AS total FROM kept_rows""")
part("measured", """
  SELECT request_id, count(*) AS n, min(price) FILTER (WHERE run >= total * 0.50) AS reference_price, min(price) FILTER (WHERE run >= total * 0.25) AS q1,
    min(price) FILTER (WHERE run >= total * 0.75) AS q3, quantile_cont(surface::DOUBLE, 0.5) AS median_surface, quantile_cont(age, 0.5) AS median_age,
    quantile_cont(surface_terrain::DOUBLE, 0.5) AS median_land FROM running GROUP BY 1""")
_COEFFICIENTS = ", ".join(f"('{k}', '{t}', {v}::DOUBLE)" for k, t, v in fixed.COEFFICIENT_ROWS)
part("coefficients", f"SELECT * FROM (VALUES {_COEFFICIENTS}) t(cle, type_bien, value)")
_FLOOR_KEY = """CASE WHEN property_type = 'appartement' AND floor IS NOT NULL THEN CASE WHEN floor = 0 THEN 'ground-floor'
  WHEN has_elevator = false THEN CASE WHEN floor >= 3 THEN 'high-no-elevator' ELSE 'low-no-elevator' END END END"""
_OUTDOOR_KEY = "CASE WHEN property_type = 'appartement' AND outdoor <> 'none' THEN outdoor END"
_KIND = "CASE WHEN property_type = 'maison' THEN 'maison' ELSE 'appartement' END"


def _coefficients(source: str, median_surface: str) -> str:
    return f"""
  SELECT *, {_r('raw_surface')} AS k_surface, {_r('raw_floor')} AS k_floor, {_r('raw_outdoor')} AS k_outdoor,
    {_r('raw_condition')} AS k_condition, {_r('raw_dpe')} AS k_dpe,
    {_r('greatest(0.7, least(1.35, product))')} AS k_total, product < 0.7::DOUBLE OR product > 1.35::DOUBLE AS clamped
  FROM (SELECT *, raw_surface * raw_floor * raw_outdoor * raw_condition * raw_dpe AS product FROM (
    SELECT m.*,
      CASE WHEN {median_surface} IS NULL THEN 1.0::DOUBLE
        ELSE greatest(0.85::DOUBLE, least(1.15::DOUBLE, pow({median_surface} / m.surface, a.value))) END AS raw_surface,
      greatest(0.9::DOUBLE, least(1.06::DOUBLE, coalesce(f.value, 1.0::DOUBLE))) AS raw_floor,
      greatest(1.0::DOUBLE, least(1.08::DOUBLE, coalesce(o.value, 1.0::DOUBLE))) AS raw_outdoor,
      greatest(0.85::DOUBLE, least(1.08::DOUBLE, coalesce(e.value, 1.0::DOUBLE))) AS raw_condition,
      CASE WHEN dpe = 'unknown' THEN 1.0::DOUBLE ELSE greatest(0.8::DOUBLE, least(1.15::DOUBLE, coalesce(g.value, 1.0::DOUBLE))) END AS raw_dpe
    FROM {source} m LEFT JOIN coefficients a ON a.cle = 'surface.alpha' AND a.type_bien = {_KIND}
      LEFT JOIN coefficients f ON f.cle = 'etage.' || {_FLOOR_KEY} LEFT JOIN coefficients o ON o.cle = 'exterieur.' || {_OUTDOOR_KEY}
      LEFT JOIN coefficients e ON e.cle = 'etat.' || condition
      LEFT JOIN coefficients g ON g.cle = 'dpe.' || dpe AND g.type_bien = {_KIND}))"""


part("land_prices", """
  WITH recent AS (SELECT * FROM land WHERE NOT is_outlier AND date_mutation >= DATE '1996-08-01'),
   c AS (SELECT code_insee, quantile_cont(prix_m2, 0.5) AS v FROM recent GROUP BY 1 HAVING count(*) >= 5),
   dp AS (SELECT code_departement, quantile_cont(prix_m2, 0.5) AS v FROM recent GROUP BY 1 HAVING count(*) >= 5)
  SELECT request_id, CASE WHEN property_type = 'maison' AND terrain_size > 0 THEN coalesce(c.v, dp.v) END AS land_price
  FROM searches LEFT JOIN c USING (code_insee) LEFT JOIN dp USING (code_departement)""")
part("sampled", """
  SELECT r.*, m.* EXCLUDE (request_id), greatest(0, (m.q3 - m.q1) / m.reference_price) AS dispersion, p.level, p.radius_m, p.months AS window_months,
    p.widened, l.land_price FROM searches r JOIN measured m USING (request_id) JOIN accepted_rows a USING (request_id)
    JOIN plan p ON p.attempt_no = a.attempt_no JOIN land_prices l USING (request_id)""")
part("adjusted", _coefficients("sampled", "m.median_surface"))
_CURVE = "({p} * least(greatest(0, {s}), 5000) + 0.3::DOUBLE * {p} * greatest(0, {s} - 5000))"
_POINTS = """(CASE precision WHEN 'approximate' THEN 5 WHEN 'city-centroid' THEN 12 ELSE 0 END + CASE WHEN dpe = 'unknown' THEN 5 ELSE 0 END
  + CASE WHEN clamped THEN 10 ELSE 0 END + CASE WHEN {widened} THEN 5 ELSE 0 END)"""
_LABEL = "CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score >= 30 THEN 'low' ELSE 'insufficient' END"
part("valued", f"""
  WITH priced AS (SELECT *, reference_price * k_total * surface AS built_value,
      CASE WHEN land_price > 0 THEN land_price ELSE 0.08::DOUBLE * reference_price END AS per_m2 FROM adjusted),
  landed AS (SELECT *, CASE WHEN property_type = 'maison' AND terrain_size > 0 AND per_m2 > 0 THEN
      greatest(-0.25::DOUBLE * built_value, least(0.25::DOUBLE * built_value,
        {_CURVE.format(p='per_m2', s='terrain_size')} - {_CURVE.format(p='per_m2', s='coalesce(median_land, 0)')})) ELSE 0 END AS land_value FROM priced),
  total AS (SELECT *, {_display('(built_value + land_value)')} AS value,
      greatest(0.04::DOUBLE, least(0.25::DOUBLE, 0.5::DOUBLE * dispersion * (1 + 4 / sqrt(n)))) AS half,
      40 * least(1, ln(1 + n) / ln(31)) AS count_score,
      CASE level WHEN 'radius' THEN 25 * (1 - least(1, radius_m / 5000)) WHEN 'commune' THEN 12 WHEN 'epci' THEN 7 WHEN 'departement' THEN 3 ELSE 0 END AS proximity,
      15 * (1 - least(1, median_age / 36)) AS freshness, 20 * (1 - least(1, dispersion / 0.6::DOUBLE)) AS dispersion_score,
      {_POINTS.format(widened='widened')} AS penalties FROM landed)
  SELECT *, {_step('value / surface')} AS price_m2, {_display('(value * (1 - half))')} AS low, {_display('(value * (1 + half))')} AS high,
    floor(greatest(0, least(100, count_score + proximity + freshness + dispersion_score - penalties)) + 0.5)::INT AS score FROM total""")
part("reference_rows", "SELECT * FROM (VALUES " + ", ".join(
    f"('{dep}', '{kind}', {price}::DOUBLE)" for dep, kind, price in fixed.DEPARTMENT_REFERENCES
) + ") t(code_departement, reference_type, reference_price)")
part("uncovered", f"""
  SELECT l.*, v.reference_price FROM (SELECT *, {_KIND} AS reference_type FROM located WHERE NOT has_dvf AND property_type NOT IN ('local-commercial', 'terrain')) l
    JOIN reference_rows v USING (code_departement, reference_type)""")
part("uncovered_adjusted", _coefficients("uncovered", "NULL::DOUBLE"))
part("reference_valued", f"""
  WITH v AS (SELECT *, {_display('(reference_price * k_total * surface)')} AS value, {_POINTS.format(widened='false')} AS penalties FROM uncovered_adjusted)
  SELECT *, {_step('value / surface')} AS price_m2, {_display('(value * (1 - 0.2::DOUBLE))')} AS low, {_display('(value * (1 + 0.2::DOUBLE))')} AS high,
    least(35, 100 - penalties) AS score FROM v""")
part("all_valued", f"""
  SELECT l.request_id, coalesce(v.kind, 'not-supported') AS kind, v.value, v.price_m2, coalesce(v.low, 0) AS low, coalesce(v.high, 0) AS high, coalesce(v.score, 0) AS score, v.k_total, v.level
  FROM located l LEFT JOIN (
    SELECT request_id, 'comparables' AS kind, value, price_m2, low, high, score, k_total, level FROM valued
    UNION ALL SELECT request_id, 'reference-table', value, price_m2, low, high, score, k_total, NULL FROM reference_valued) v USING (request_id)""")


# --- Spark inputs -----------------------------------------------------------


def sampled(spark, d):
    """Searches with their chosen sample and land price, cleaned and measured."""

    def build():
        wants_land = (F.col("property_type") == "maison") & (F.col("terrain_size") > 0)
        # priced before the samples come, which are wide
        priced = settle(mk.land_price(cc.searches(spark, d), cc.market(spark, d)["land"], TODAY))
        return (
            priced.withColumn("land_price", F.when(wants_land, F.col("land_price")))
            .withColumn("is_top_floor", F.lit(None).cast("boolean"))
            .join(cc.chosen(spark, d), "search_id")
        )

    return shared("sampled", spark, d, build)


def measured(spark, d):
    return shared(
        "measured", spark, d, lambda: settle(va.with_statistics(clean_samples(sampled(spark, d)), TODAY).drop("sample"))
    )


def lookup(spark):
    return va.coefficient_lookup(va.coefficient_rows(spark))


def valued(spark, d):
    return shared("valued", spark, d, lambda: settle(va.value_by_comparables(sampled(spark, d), lookup(spark), TODAY).drop("sample", "kept")))


def portfolio(spark, d):
    def build():
        m = cc.market(spark, d)
        return pf.value_portfolio(
            places.located(spark, d), m["sales"], m["medians"], m["land"], va.coefficient_rows(spark),
            va.department_references(spark), TODAY,
        )

    return shared("portfolio", spark, d, build)


tidy = num.half_up_decimals


# --- Queries ----------------------------------------------------------------


@query(
    "N05_quantiles",
    """SELECT l_suppkey AS grp, floor(quantile_cont(l_extendedprice, 0.25) * 1e4 + 0.5) / 1e4 AS p25, floor(quantile_cont(l_extendedprice, 0.5) * 1e4 + 0.5) / 1e4 AS p50,
       floor(quantile_cont(l_extendedprice, 0.75) * 1e4 + 0.5) / 1e4 AS p75 FROM lineitem GROUP BY 1""",
)
def quantiles(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    q = rows.groupBy(F.col("l_suppkey").alias("grp")).agg(
        F.percentile("l_extendedprice", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("q")
    )
    return q.select("grp", *[tidy(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


@query(
    "N06_V04_weighted_statistics",
    f"""SELECT request_id, n, reference_price, q1, q3, {_r('greatest(0, (q3 - q1) / reference_price)')} AS dispersion, {_r('median_surface')} AS median_surface,
        {_r('median_age')} AS median_age, {_r('median_land')} AS median_land FROM measured""",
)
def weighted_statistics(spark, d):
    return measured(spark, d).select(
        "request_id", "n", "reference_price", "q1", "q3",
        *[tidy(F.col(c), 4).alias(c) for c in ("dispersion", "median_surface", "median_age", "median_land")],
    )


@query(
    "N07_N08_display_values",
    f"SELECT o_orderkey AS id, {_display('(o_totalprice * 0.7::DOUBLE)')} AS shown, greatest(5e4, least(2e5, o_totalprice)) AS clamped FROM orders",
)
def display_values(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("id"), num.display_value(F.col("o_totalprice") * 0.7).alias("shown"),
        num.clamp(F.col("o_totalprice"), 5e4, 2e5).alias("clamped"),
    )


@query(
    "N09_V01_V02_V03_sale_weights",
    f"""SELECT request_id, sale_id, {_r('age', 6)} AS age, {_r('1.0::DOUBLE / (1 + (distance / 500) * (distance / 500))', 8)} AS w_distance,
        {_r('pow(0.5, age / 24)', 8)} AS w_age, {_r('1.0::DOUBLE / (1 + abs(surface - wanted) / wanted)', 8)} AS w_surface FROM kept_rows""",
)
def sale_weights(spark, d):
    kept = measured(spark, d).select("request_id", F.col("surface").alias("wanted"), F.explode("kept").alias("x"))
    return kept.select(
        "request_id", "x.sale_id", tidy(F.col("x.age"), 6).alias("age"),
        tidy(va.distance_weight(F.col("x.distance")), 8).alias("w_distance"),
        tidy(va.age_weight(F.col("x.age")), 8).alias("w_age"),
        tidy(va.surface_weight(F.col("x.surface"), F.col("wanted")), 8).alias("w_surface"),
    )


@query(
    "V05_V06_V07_V08_V09_coefficients",
    "SELECT request_id, k_surface, k_floor, k_outdoor, k_condition, k_dpe, k_total, clamped FROM adjusted",
)
def coefficients(spark, d):
    rows = va.with_coefficients(measured(spark, d), lookup(spark), F.col("median_surface"))
    return rows.select("request_id", "k_surface", "k_floor", "k_outdoor", "k_condition", "k_dpe", "k_total", "clamped")


_VARIED = """SELECT concat(CASE p_partkey % 7 WHEN 0 THEN 'dpe.A' WHEN 1 THEN 'dpe.G' WHEN 2 THEN 'etat.good' WHEN 3 THEN 'surface.alpha'
    WHEN 4 THEN 'exterieur.garden' WHEN 5 THEN 'autre.chose' ELSE 'terrain.fallback_ratio' END) AS cle,
  CASE p_partkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'maison' ELSE 'appartement' END AS type_bien,
  CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE '1.5' END AS valeur, CAST(CASE WHEN p_partkey % 5 = 0 THEN 2 END AS INT) AS densite_min,
  p_partkey % 4 <> 0 AS actif FROM {part}"""


@query(
    "V10_coefficient_table",
    """WITH u AS (SELECT cle, type_bien, TRY_CAST(valeur AS DOUBLE) AS value FROM (""" + _VARIED.format(part="part") + """)
         WHERE actif AND densite_min IS NULL AND TRY_CAST(valeur AS DOUBLE) IS NOT NULL),
       t AS (SELECT cle || '|' || unnest(CASE WHEN cle LIKE 'dpe.%' THEN CASE type_bien WHEN 'all' THEN ['appartement', 'maison'] ELSE [type_bien] END
         WHEN cle = 'surface.alpha' THEN CASE type_bien WHEN 'all' THEN [] ELSE [type_bien] END
         WHEN cle LIKE 'autre.%' THEN [] ELSE ['any'] END) AS entry, value FROM u)
       SELECT entry, max(value) AS value FROM t GROUP BY 1""",
)
def coefficient_table(spark, d):
    rows = sm.on_spark(spark, d, _VARIED)
    return va.coefficient_lookup(rows).select(F.explode("k").alias("entry", "value"))


part("applied", """SELECT request_id, 'comparables' AS kind, k_surface, k_floor, k_outdoor, k_condition, k_dpe, k_total, clamped, land_value, land_price IS NULL AND land_value <> 0 AS fallback, n, radius_m, window_months, reference_price FROM valued
  UNION ALL SELECT request_id, 'reference-table', k_surface, k_floor, k_outdoor, k_condition, k_dpe, k_total, clamped, 0, false, 0, NULL, NULL, reference_price FROM reference_valued""")
part("applied_sources", f"""
  WITH asked AS (SELECT l.*, a.fallback FROM located l JOIN applied a USING (request_id)),
  wanted AS (
    SELECT request_id, unnest([('surface.alpha', {_KIND}, 0)]) AS w FROM asked
    UNION ALL SELECT request_id, unnest([('dpe.' || dpe, {_KIND}, 1), ('dpe.' || dpe, 'all', 2)]) FROM asked WHERE dpe <> 'unknown'
    UNION ALL SELECT request_id, unnest([('etat.' || condition, 'all', 3), ('etat.' || condition, {_KIND}, 4)]) FROM asked WHERE condition IS NOT NULL
    UNION ALL SELECT request_id, unnest([('etage.' || {_FLOOR_KEY}, 'appartement', 5), ('etage.' || {_FLOOR_KEY}, 'all', 6)]) FROM asked WHERE {_FLOOR_KEY} IS NOT NULL
    UNION ALL SELECT request_id, unnest([('exterieur.' || {_OUTDOOR_KEY}, 'all', 7), ('exterieur.' || {_OUTDOOR_KEY}, 'appartement', 8)]) FROM asked WHERE {_OUTDOOR_KEY} IS NOT NULL
    UNION ALL SELECT request_id, unnest([('terrain.fallback_ratio', 'all', 9)]) FROM asked WHERE fallback),
  hit AS (SELECT request_id, w[1] AS cle, w[2] AS type_bien, w[3] AS position, value FROM wanted JOIN coefficients c ON c.cle = w[1] AND c.type_bien = w[2]
    QUALIFY row_number() OVER (PARTITION BY request_id, w[1] ORDER BY w[3]) = 1)
  SELECT request_id, string_agg(cle || '|' || type_bien, ';' ORDER BY position) AS sources FROM hit GROUP BY 1""")


def _listed(sources):
    return F.array_join(F.transform(sources, lambda s: F.concat_ws("|", s["cle"], s["type_bien"])), ";")


@query("V11_coefficient_sources", "SELECT request_id, sources FROM applied_sources")
def coefficient_sources(spark, d):
    """The reference rows behind each value, as the portfolio names them."""
    found = portfolio(spark, d)["results"].where(F.col("sources").isNotNull())
    return found.select("request_id", _listed("sources").alias("sources"))


@query(
    "V12_land_curve",
    f"SELECT o_orderkey AS id, {_r(_CURVE.format(p='10', s='(o_totalprice / 20)'))} AS land FROM orders",
)
def land_curve(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    curve = va.land_curve(F.col("o_totalprice") / 20, F.lit(10.0))
    return orders.select(F.col("o_orderkey").alias("id"), tidy(curve, 4).alias("land"))


@query(
    "V13_V14_V15_V16_values",
    f"""SELECT request_id, value, price_m2, low, high, {_r('half')} AS half_width, {_step('land_value')} AS land_value, score, {_LABEL} AS label,
        {_r('count_score', 2)} AS count_score, {_r('proximity', 2)} AS proximity, {_r('freshness', 2)} AS freshness, {_r('dispersion_score', 2)} AS dispersion_score, penalties,
        array_to_string(list_filter([CASE WHEN level <> 'radius' THEN 'level_' || level END, CASE WHEN n < 10 THEN 'few_sales' END,
          CASE WHEN widened THEN 'wide_tolerance' END, CASE WHEN clamped THEN 'clamped' END, CASE WHEN dpe = 'unknown' THEN 'dpe_unknown' END,
          CASE WHEN precision <> 'exact' THEN 'approximate_place' END, CASE WHEN score < 30 THEN 'weak_data' END], lambda x: x IS NOT NULL), ',') AS warnings FROM valued""",
)
def values(spark, d):
    return valued(spark, d).select(
        "request_id", "value", "price_m2", "low", "high", "half_width", "land_value", "score", "label", "count_score",
        "proximity", "freshness", "dispersion_score", "penalties", F.array_join("warnings", ",").alias("warnings"),
    )


@query(
    "V17_reference_values",
    f"SELECT request_id, value, price_m2, low, high, score, {_LABEL} AS label, penalties, k_total FROM reference_valued",
)
def reference_values(spark, d):
    rows = places.located(spark, d).filter(~F.col("has_dvf") & (F.col("property_type") != "local-commercial"))
    rows = rows.withColumn("is_top_floor", F.lit(None).cast("boolean"))
    return va.value_by_reference(rows, lookup(spark), va.department_references(spark)).select(
        "request_id", "value", "price_m2", "low", "high", "score", "label", "penalties", "k_total"
    )


@query("V18_V19_V20_portfolio", "SELECT request_id, kind, value, price_m2, low, high, score, k_total, level FROM all_valued")
def portfolio_values(spark, d):
    return portfolio(spark, d)["results"].select(
        "request_id", "kind", "value", "price_m2", "low", "high", "score", "k_total", "level"
    )


@query(
    "V20_result_rows",
    f"""SELECT l.request_id, v.value, v.low AS range_low, v.high AS range_high, v.price_m2, v.score, {_LABEL} AS label, v.kind, coalesce(v.level, CASE WHEN v.kind = 'reference-table' THEN 'departement-reference' ELSE 'national' END) AS level,
       a.radius_m, a.window_months, coalesce(a.n, 0) AS n, {_r('a.reference_price')} AS reference_price, CASE WHEN v.value IS NOT NULL THEN 1 END AS time_factor,
       a.k_surface, a.k_floor, a.k_outdoor, a.k_condition, a.k_dpe, a.k_total, a.clamped, coalesce(s.sources, '') AS sources, coalesce({_step('a.land_value')}, 0) AS land_value,
       l.commune AS city, l.precision, CASE WHEN l.has_dvf THEN 'dvf' ELSE 'no-dvf' END AS coverage, CASE WHEN v.kind <> 'reference-table' THEN '2001-T2' END AS index_quarter, CASE WHEN v.kind <> 'reference-table' THEN '2001-07-15' END AS published_on
       FROM located l JOIN all_valued v USING (request_id) LEFT JOIN applied a USING (request_id) LEFT JOIN applied_sources s USING (request_id)""",
)
def result_rows(spark, d):
    p = portfolio(spark, d)
    status = spark.createDataFrame([("2001-07-15", None, "2001-T2")], "published_on string, last_import_at string, index_quarter string").withColumns(
        {"published_on": F.col("published_on").cast("date"), "last_import_at": F.col("last_import_at").cast("timestamp")})
    m, k = "method", "method.coefficients"
    return pf.assemble(p["results"], p["located"], status).select(
        "request_id", "value", F.col("range.low").alias("range_low"), F.col("range.high").alias("range_high"), "price_m2", "confidence.score", "confidence.label", f"{m}.kind", f"{m}.level",
        f"{m}.radius_m", f"{m}.window_months", f"{m}.n", tidy(F.col(f"{m}.reference_price"), 4).alias("reference_price"), f"{m}.time_factor",
        *[f"{k}.{c}" for c in ("k_surface", "k_floor", "k_outdoor", "k_condition", "k_dpe", "k_total", "clamped")], _listed(F.col(f"{m}.coefficient_sources")).alias("sources"), f"{m}.land_value",
        "location.city", "location.precision", "source.coverage", "source.index_quarter", F.col("source.published_on").cast("string").alias("published_on"),
    )


_ANSWERED = "request_id % 13 <> 0"


@query(
    "V22_result_statuses",
    f"""SELECT request_id, CASE WHEN NOT {_ANSWERED} THEN 'static-fallback' WHEN value IS NULL THEN 'deferred' ELSE 'ok' END AS with_static, CASE WHEN NOT {_ANSWERED} OR value IS NULL THEN 'deferred' ELSE 'ok' END AS without
        FROM all_valued""",
)
def result_statuses(spark, d):
    """Answered with and without a value, and not answered at all."""
    rows, answered = portfolio(spark, d)["results"], F.expr(_ANSWERED)
    return rows.select("request_id", va.result_status(answered, F.col("value")).alias("with_static"), va.result_status(answered, F.col("value"), "none").alias("without"))


@query(
    "V21_V22_four_numbers",
    """SELECT request_id, price_m2 AS "prixM2", low AS "estimationMin", value AS "estimationMoyenne", high AS "estimationMax", 'ok' AS status
       FROM all_valued WHERE value IS NOT NULL""",
)
def four_numbers(spark, d):
    flat = pf.four_numbers(portfolio(spark, d)["results"])
    return flat.withColumn("status", va.result_status(F.lit(True), F.col("estimationMoyenne")))


_CITIES = ", ".join(f"({i}, '{name}', {price}::DOUBLE)" for i, (name, price) in enumerate(fixed.CITY_PRICES))
_TOWN = """SELECT *, CASE request_id % 6 WHEN 0 THEN 'Paris 12e' WHEN 1 THEN 'LYON' WHEN 2 THEN 'Le Havre' WHEN 3 THEN 'an' ELSE city END AS town FROM {rows}"""


@query(
    "V23_simple_estimates",
    f"""WITH r AS (SELECT request_id, lower(trim(town)) AS c, property_type, surface, rooms, dpe FROM ({_TOWN.format(rows='request_rows')})),
        p AS (SELECT r.*, coalesce((SELECT min_by(price, i) FROM (VALUES {_CITIES}) t(i, name, price) WHERE contains(r.c, name) OR contains(name, r.c)), 3000)
          * CASE property_type WHEN 'maison' THEN 0.95::DOUBLE WHEN 'terrain' THEN 0.3::DOUBLE WHEN 'local-commercial' THEN 0.8::DOUBLE ELSE 1 END
          * CASE dpe WHEN 'A' THEN 1.15::DOUBLE WHEN 'B' THEN 1.1::DOUBLE WHEN 'C' THEN 1.05::DOUBLE WHEN 'E' THEN 0.95::DOUBLE WHEN 'F' THEN 0.85::DOUBLE WHEN 'G' THEN 0.75::DOUBLE ELSE 1 END
          * CASE WHEN property_type = 'appartement' AND rooms >= 4 THEN 1.05::DOUBLE WHEN property_type = 'appartement' AND rooms = 1 THEN 0.95::DOUBLE ELSE 1 END AS p FROM r)
        SELECT request_id, {_step('p')} AS price_m2, {_step('p * surface * 0.9::DOUBLE')} AS low, {_step('p * surface')} AS value, {_step('p * surface * 1.1::DOUBLE')} AS high FROM p""",
)
def simple_estimates(spark, d):
    rows = spark.sql(_TOWN.format(rows="{rows}"), rows=sm.requests(spark, d)).withColumn("city", F.col("town"))
    return va.simple_estimate(rows)


@query(
    "V24_request_keys",
    """SELECT count(*) AS requests, count(DISTINCT (coalesce(lat::VARCHAR, 'na'), coalesce(lon::VARCHAR, 'na'), property_type, surface, dpe, postal_code, lower(trim(city)),
       lower(trim(address)), rooms, floor, has_elevator, outdoor, condition, terrain_size)::VARCHAR) AS keys FROM request_rows""",
)
def request_keys(spark, d):
    keys = sm.requests(spark, d).groupBy(va.request_key("dvf-2001-08").alias("key")).agg(F.count("*").alias("n"))
    return keys.agg(F.sum("n").alias("requests"), F.count("*").alias("keys"))


_ASKED_AGAIN = """SELECT request_id, request_id AS property, 1 AS run FROM {rows} WHERE request_id % 2 = 0 UNION ALL SELECT request_id, request_id, 2 FROM {rows}
  UNION ALL SELECT request_id + 1000000000, request_id, 2 FROM {rows} WHERE request_id % 3 = 0 UNION ALL SELECT request_id, request_id, 3 FROM {rows}"""


@query(
    "V24_valued_once",
    f"""SELECT a.run, a.request_id, v.kind, v.value, v.low, v.high, a.run = CASE WHEN a.property % 2 = 0 THEN 1 ELSE 2 END AS valued_now
        FROM ({_ASKED_AGAIN.format(rows='request_rows')}) a JOIN all_valued v ON v.request_id = a.property""",
)
def valued_once(spark, d):
    """Half of the requests, then all and some again under other ids, then all: the third run values none."""
    path, m = cm_folder(spark, "valued"), cc.market(spark, d)
    located = places.located(spark, d)
    again = located.where("request_id % 3 = 0").withColumn("request_id", F.col("request_id") + 1_000_000_000)
    value = lambda rows: pf.value_portfolio(
        rows, m["sales"], m["medians"], m["land"], va.coefficient_rows(spark), va.department_references(spark), TODAY)["results"]
    runs = [located.where("request_id % 2 = 0"), located.unionByName(again), located]
    found = [settle(value_once(spark, path, rows, "dvf-2001-08", value).select(F.lit(n).alias("run"), "request_id", "kind", "value", "low", "high", "valued_now")) for n, rows in enumerate(runs, 1)]
    return found[0].union(found[1]).union(found[2])


def _blur(x: str, step: str) -> str:
    return f"floor({x} / {step} + 0.5) * {step}"


@query(
    "P01_anonymous_comparables",
    f"""SELECT request_id, street, coalesce(city, '') AS city, {_blur('distance', '50e0')} AS distance_m, strftime(date_mutation, '%Y-%m') AS month,
        {_blur('surface', '1e0')} AS surface, rooms, {_blur('price', '10e0')} AS price_m2, {_blur('value', '1000e0')} AS price FROM
        (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, rank) AS k FROM kept_rows) WHERE k <= 5""",
)
def anonymous_comparables(spark, d):
    blurred = measured(spark, d).select("request_id", F.explode(va.anonymous_comparables(F.col("kept"))).alias("x"))
    return blurred.select("request_id", "x.*").drop("adjusted_price_m2")


_LOGGED = """SELECT request_id, property_type, surface, concat('10.1.', CAST(request_id % 200 AS STRING), '.7') AS ip,
  CASE WHEN request_id % 5 = 0 THEN ' ' ELSE 'agent' END AS user_agent FROM {rows}"""


_PADS = [bytes(b ^ pad for b in b"secret".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]
_KEYED_IP = f"sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(ip))))"


@query(
    "S10_anonymous_log",
    f"""WITH p AS (SELECT l.*, v.* EXCLUDE (request_id), a.n, a.radius_m, CASE WHEN v.kind = 'not-supported' THEN l.city_code ELSE coalesce(l.city_code, l.code_insee) END AS code
          FROM located l JOIN all_valued v ON v.request_id = l.request_id LEFT JOIN applied a ON a.request_id = l.request_id)
        SELECT run, code AS code_insee, coalesce(CASE WHEN left(code, 2) IN ('97', '98') THEN left(code, 3) ELSE left(code, 2) END, {places._DEP_POSTCODE.format('postal_code')}) AS code_departement,
        p.property_type AS type_bien, floor(p.surface + 0.5)::INT AS surface, kind AS method_kind, radius_m, coalesce(n, 0) AS n_comparables,
        level AS method_level, score AS confidence, CASE WHEN value IS NOT NULL THEN low END AS value_low, value AS value_mid, CASE WHEN value IS NOT NULL THEN high END AS value_high, price_m2,
        {_KEYED_IP} AS ip_hmac, CASE WHEN p.request_id % 5 <> 0 THEN sha256('agent') END AS ua_hash, '2001-08-01' AS created_on
        FROM p JOIN ({_LOGGED.format(rows='request_rows')}) q ON q.request_id = p.request_id CROSS JOIN (VALUES (1), (2)) t(run)""",
)
def anonymous_log(spark, d):
    """The log after two days of valuations, read back."""
    path, p = cm_folder(spark, "valuation-log"), portfolio(spark, d)
    asked = spark.sql(_LOGGED, rows=sm.requests(spark, d))
    log = pf.anonymous_log(p["results"], asked, p["located"], "secret", F.lit(TODAY).cast("timestamp"))
    for run in (1, 2):
        append_rows(log.withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path).withColumn("created_on", F.date_format("created_at", "yyyy-MM-dd")).drop("created_at")
