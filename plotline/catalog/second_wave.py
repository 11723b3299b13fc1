"""Specified extensions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.catalog import comparables as cc
from plotline.catalog import maintenance as cm
from plotline.catalog import sales as cs
from plotline.catalog.entries import part, query
from plotline.functions.numbers import half_up_decimals as tidy
from plotline.operators import market as mk
from plotline.operators import second_wave as sw
from plotline.session import settle
from plotline.sources import files as fi
from plotline.sources import sample_market as sm

TODAY = sm.REFERENCE_DATE

_INDICES = """SELECT concat(CASE WHEN o_orderstatus = 'P' THEN '9' ELSE '1' END, CAST(o_orderkey % 4 AS STRING)) AS code_region, CASE o_orderkey % 3 WHEN 0 THEN 'appartement' WHEN 1 THEN 'maison' ELSE 'all' END AS type_bien,
  CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, 100 + CAST(count(*) AS DOUBLE) / 1e1 AS value FROM {orders} GROUP BY 1, 2, 3
  UNION ALL SELECT 'FR', CASE WHEN o_orderkey % 2 = 0 THEN 'maison' ELSE 'all' END, CAST(date_trunc('quarter', o_orderdate) AS DATE), 100 + CAST(count(*) AS DOUBLE) / 1e1 FROM {orders} GROUP BY 1, 2, 3"""
part("index_rows", _INDICES.format(orders="orders"))
part("index_last", "SELECT code_region, type_bien, max_by(value, quarter) AS last_value FROM index_rows GROUP BY 1, 2")


@query(
    "X01_time_factors",
    """WITH f AS (SELECT i.code_region, i.type_bien, i.quarter, l.last_value / i.value AS factor FROM index_rows i JOIN index_last l USING (code_region, type_bien))
       SELECT s.sale_id, floor(coalesce(a.factor, b.factor, c.factor, e.factor, 1) * 1e6 + 0.5) / 1e6 AS time_factor,
         CASE WHEN a.factor IS NOT NULL THEN 'region_type' WHEN b.factor IS NOT NULL THEN 'region' WHEN c.factor IS NOT NULL THEN 'country_type' WHEN e.factor IS NOT NULL THEN 'country' END AS index_level
       FROM (SELECT *, date_trunc('quarter', date_mutation)::DATE AS quarter FROM market_sales) s
       LEFT JOIN f a ON a.code_region = s.code_region AND a.type_bien = s.type_local AND a.quarter = s.quarter
       LEFT JOIN f b ON b.code_region = s.code_region AND b.type_bien = 'all' AND b.quarter = s.quarter
       LEFT JOIN f c ON c.code_region = 'FR' AND c.type_bien = s.type_local AND c.quarter = s.quarter
       LEFT JOIN f e ON e.code_region = 'FR' AND e.type_bien = 'all' AND e.quarter = s.quarter""",
)
def time_factors(spark, d):
    rows = sw.time_factors(cc.market(spark, d)["sales"], sm.on_spark(spark, d, _INDICES))
    return rows.select("sale_id", tidy(F.col("time_factor"), 6).alias("time_factor"), "index_level")


def _fenced(least: int) -> str:
    return f"""WITH g AS (SELECT code_insee, type_local, year(date_mutation) AS y, quantile_cont(prix_m2, 0.25) AS q1, quantile_cont(prix_m2, 0.75) AS q3 FROM sales
         WHERE NOT is_outlier GROUP BY 1, 2, 3 HAVING count(*) >= {least})
       SELECT dedup_key, is_outlier OR coalesce(prix_m2 NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1), false) AS is_outlier,
         CASE WHEN NOT is_outlier AND prix_m2 NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 'iqr_commune' ELSE exclusion_reason END AS exclusion_reason
       FROM sales s LEFT JOIN g ON g.code_insee = s.code_insee AND g.type_local = s.type_local AND g.y = year(s.date_mutation)"""


@query("X02_statistical_outliers", _fenced(5))
def statistical_outliers(spark, d):
    """Groups from 5 sales on, which the small tables have."""
    return sw.statistical_outliers(settle(cs.sales_table(spark, d)), 5).select("dedup_key", "is_outlier", "exclusion_reason")


@query("X02_outliers_of_full_groups", _fenced(30))
def outliers_of_full_groups(spark, d):
    """The rule's own least group."""
    return sw.statistical_outliers(settle(cs.sales_table(spark, d))).select("dedup_key", "is_outlier", "exclusion_reason")


@query(
    "X03_market_pages",
    """WITH lv AS (SELECT code_insee, type_local, quantile_cont(prix_m2, 0.5) FILTER (WHERE date_mutation > DATE '2000-08-01') AS recent,
         quantile_cont(prix_m2, 0.5) FILTER (WHERE date_mutation > DATE '1999-08-01' AND date_mutation <= DATE '2000-08-01') AS earlier, max(date_mutation)::VARCHAR AS last_sale
         FROM sales WHERE NOT is_outlier GROUP BY 1, 2)
       SELECT b.code_insee, b.type_local, b.bands, b.n, floor(m.med * 1e4 + 0.5) / 1e4 AS med, floor((recent / earlier - 1) * 100 * 1e4 + 0.5) / 1e4 AS change_12m_pct, last_sale
       FROM (SELECT code_insee, type_local, count(*) AS bands, sum(n)::BIGINT AS n FROM bands GROUP BY 1, 2) b JOIN medians m USING (code_insee, type_local) JOIN lv USING (code_insee, type_local)""",
)
def market_pages(spark, d):
    sales = settle(cs.sales_table(spark, d))
    page = mk.market_page(mk.commune_bands(sales), sales, TODAY)
    return cs.plain(page, ["last_sale"]).withColumns(
        {"med": tidy(F.col("med"), 4), "change_12m_pct": tidy(F.col("change_12m_pct"), 4)}
    )


_BOARD = """SELECT CAST(ts AS TIMESTAMP) AS created_at, CASE WHEN event_type = 'error' THEN 'not-supported' ELSE 'comparables' END AS method_kind,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 5 = 0 THEN 'radius' WHEN event_id % 5 = 1 THEN 'commune' WHEN event_id % 5 = 2 THEN 'epci' WHEN event_id % 35 = 3 THEN 'national' ELSE 'departement' END AS method_level,
  CAST(CASE WHEN event_id % 41 = 0 THEN NULL ELSE floor(value * 20) END AS INT) AS duration_ms, CAST(event_id % 101 AS INT) AS confidence FROM {events}"""
_LEVELS = [*sw.LEVELS, "none"]


@query(
    "X06_operations_board",
    f"""WITH log AS ({_BOARD.format(events='events')}), ends AS (SELECT DISTINCT epoch(created_at)::BIGINT // 900 * 900 + 900 AS e FROM log)
        SELECT strftime(to_timestamp(e) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS until, count(*) AS n, floor(avg((method_kind = 'not-supported')::INT) * 1e4 + 0.5) / 1e4 AS deferred,
          {", ".join(f"count(*) FILTER (coalesce(method_level, 'none') = '{x}') AS {x.replace('-', '_')}" for x in _LEVELS)},
          {", ".join(f"count(*) FILTER (least(confidence // 10, 9) = {b}) AS bin_{b}" for b in range(10))},
          true AS p95_close, coalesce(avg((duration_ms > 1500)::INT) > 0.05, false) AS too_slow, avg((method_kind = 'not-supported')::INT) > 0.02 AS too_many_deferred
        FROM ends JOIN log ON epoch(created_at) >= e - 86400 AND epoch(created_at) < e GROUP BY e""",
)
def operations_board(spark, d):
    """The board of two half logs, with the sketched percentile held against the ranks of the durations themselves."""
    log = sm.on_spark(spark, d, _BOARD).withColumn("at", F.unix_timestamp("created_at"))
    halves = [log.where(F.pmod(F.xxhash64("created_at", "duration_ms"), F.lit(2)) == i) for i in (0, 1)]
    board = settle(sw.operations_board(sw.board_intervals(halves[0]).unionByName(sw.board_intervals(halves[1]))))
    # A duration counts in the boards of the 96 quarter hours that end within the day after it.
    end = F.explode(F.sequence(F.floor(F.col("at") / 900) * 900 + 900, F.floor(F.col("at") / 900) * 900 + 86_400, F.lit(900)))
    timed = log.where("duration_ms IS NOT NULL").select(end.alias("end"), "duration_ms")
    ranks = timed.join(board.select(F.unix_timestamp("until").alias("end"), "p95_ms"), "end").groupBy("end").agg(
        F.avg((F.col("duration_ms") < F.col("p95_ms")).cast("double")).alias("under"), F.avg((F.col("duration_ms") <= F.col("p95_ms")).cast("double")).alias("up_to"))
    close = (F.col("under") <= 0.95 + sw.SKETCH_ERROR) & (F.col("up_to") >= 0.95 - sw.SKETCH_ERROR)
    rows = board.join(ranks, F.unix_timestamp("until") == F.col("end"), "left")
    return rows.select(
        F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"), "n", "deferred", *[F.col("levels")[x].alias(x.replace("-", "_")) for x in _LEVELS],
        *[F.col("confidence")[b].alias(f"bin_{b}") for b in range(10)], F.coalesce(close, F.col("p95_ms").isNull()).alias("p95_close"), "too_slow", "too_many_deferred",
    )


@query(
    "X07_coarse_points",
    """SELECT b.id_mutation, coalesce(b.longitude, c.longitude) AS longitude, coalesce(b.latitude, c.latitude) AS latitude, b.longitude IS NOT NULL AS geoloc_fine,
       CASE WHEN b.longitude IS NULL THEN CASE WHEN c.code_insee IS NOT NULL THEN 'commune_centroid' END ELSE 'dvf' END AS geoloc_source FROM built_rows b LEFT JOIN commune_rows c USING (code_insee)""",
)
def coarse_points(spark, d):
    rows = sw.coarse_points(cs.facts(spark, d), sm.communes(spark, d))
    return rows.select("id_mutation", "longitude", "latitude", "geoloc_fine", "geoloc_source")


_STEPS = """SELECT concat(CAST(user_id % 400 AS STRING), ' ', CAST(CAST(ts AS DATE) AS STRING)) AS session_id, CAST(ts AS TIMESTAMP) AS ts, event_id, event_type = 'error' AS failed,
  CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS INT) AS step_number, CASE event_id % 4 WHEN 0 THEN 'email|phone' WHEN 1 THEN 'surface' WHEN 2 THEN ' email | email|' ELSE '' END AS error_fields FROM {events}"""


@query(
    "X08_funnel",
    f"""WITH seen AS ({_STEPS.format(events='events')}),
        reached AS (SELECT session_id, list_reduce(list_prepend(0, list(step_number ORDER BY ts, event_id)), lambda r, s: CASE WHEN s = r + 1 THEN s ELSE r END) AS reached FROM seen WHERE NOT failed GROUP BY 1),
        fields AS (SELECT DISTINCT event_id, step_number, trim(unnest(string_split(error_fields, '|'))) AS field FROM seen WHERE failed),
        listed AS (SELECT step_number, string_agg(field || '=' || n, ';' ORDER BY field) AS error_fields FROM (SELECT step_number, field, count(*) AS n FROM fields WHERE field <> '' GROUP BY 1, 2) GROUP BY 1)
        SELECT step::INT AS step, count(*) FILTER (reached >= step) AS sessions, count(*) FILTER (reached = step AND step < 5) AS left_here, any_value(e.errors) AS errors, any_value(e.sessions_with_errors) AS sessions_with_errors,
          any_value(coalesce(l.error_fields, '')) AS error_fields
        FROM reached CROSS JOIN range(1, 6) t(step) LEFT JOIN (SELECT step_number, count(*) AS errors, count(DISTINCT session_id) AS sessions_with_errors FROM seen WHERE failed GROUP BY 1) e ON e.step_number = step
        LEFT JOIN listed l ON l.step_number = step GROUP BY step""",
)
def funnel(spark, d):
    """Steps in any order, some seen again or skipped, and errors with several fields."""
    rows = sm.on_spark(spark, d, _STEPS)
    found = sw.funnel(rows.where("NOT failed"), rows.where("failed"), 5)
    text = F.array_join(F.transform(F.map_entries("error_fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.withColumn("error_fields", text)


_ZONES = """SELECT lpad(CAST(n_nationkey + 1 AS STRING), 2, '0') AS code, n_name AS name, CAST(1000 + count(*) AS DOUBLE) AS price, CAST(count(*) AS DOUBLE) AS maisons,
  CAST(max(c_custkey) AS DOUBLE) AS apparts, 5e-1 AS evol12, 12e0 AS evol5 FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name"""


@query("S06_zone_prices", _ZONES.format(customer="customer", nation="nation"))
def zone_prices(spark, d):
    path = cm._folder(spark, "zones")
    sm.on_spark(spark, d, _ZONES).write.option("header", True).csv(path)
    return fi.read_zone_prices(spark, path)
