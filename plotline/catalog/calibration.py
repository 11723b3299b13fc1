"""Energy classes of sales and the coefficients fitted on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.catalog import comparables as cc
from plotline.catalog.entries import part, query, shared
from plotline.functions.numbers import half_up_decimals as tidy
from plotline.operators import calibration as ca
from plotline.operators import valuation as va
from plotline.session import settle
from plotline.sources import sample_market as sm

#: Energy certificates: one for most orders, and later ones for some.
_CERTIFICATES = """SELECT concat('B', CAST(o_orderkey AS STRING)) AS ban_id, substr('ABCDEFG', CAST(1 + (o_orderkey * 31 + o_custkey) % 7 AS INT), 1) AS energy_class,
  CAST(o_orderdate AS DATE) AS issued_on FROM {orders} WHERE o_orderkey % 9 <> 0
  UNION ALL SELECT concat('B', CAST(l_orderkey AS STRING)), CASE WHEN l_partkey % 8 = 0 THEN 'unknown' ELSE substr('ABCDEFG', CAST(l_partkey % 8 AS INT), 1) END, CAST(l_shipdate AS DATE)
  FROM {lineitem} WHERE l_linenumber = 1 AND l_orderkey % 2 = 0"""
part("certificate_rows", _CERTIFICATES.format(orders="orders", lineitem="lineitem"))
part("certified", """
  SELECT s.*, c.class_no, substr('ABCDEFG', c.class_no, 1) AS energy_class FROM market_sales s LEFT JOIN
    (SELECT ban_id, (max(datediff('day', DATE '1970-01-01', issued_on) * 8 + ascii(energy_class) - 64) % 8)::INT AS class_no FROM certificate_rows WHERE energy_class <> 'unknown' GROUP BY 1) c
    ON c.ban_id = 'B' || trim(s.sale_id)""")
#: Normal equations of each stratum, solved by Gauss and Jordan's elimination.
part("energy_effects", """
  SELECT stratum, substr('ABCEFG', i, 1) AS energy_class, m[i][len(m[i])] / m[i][i] AS effect FROM (
  WITH RECURSIVE dwellings AS (SELECT densite_grille AS stratum, code_insee, year(date_mutation) AS year, min(year(date_mutation)) OVER (PARTITION BY densite_grille) AS first_year, class_no,
      (type_local = 'maison')::DOUBLE AS house, ln(surface) AS s, ln(price) AS y, row_number() OVER () AS r
    FROM certified WHERE type_local IN ('appartement', 'maison') AND class_no IS NOT NULL AND densite_grille IS NOT NULL AND code_insee IS NOT NULL AND price > 0 AND surface > 0),
  years AS (SELECT list(DISTINCT year ORDER BY year) AS ys FROM dwellings),
  wide AS (SELECT stratum, code_insee, r, list_concat(list_transform([1, 2, 3, 5, 6, 7], lambda c: (class_no = c)::DOUBLE), [house, s],
    list_transform(ys, lambda v: (v = year AND v > first_year)::DOUBLE), [y]) AS x FROM dwellings, years),
  cells AS (SELECT stratum, r, i, v - avg(v) OVER (PARTITION BY code_insee, i) AS v FROM (SELECT stratum, code_insee, r, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM wide)),
  gram AS (SELECT a.stratum, a.i, b.i AS j, sum(a.v * b.v) AS v FROM cells a JOIN cells b ON b.r = a.r GROUP BY 1, 2, 3),
  matrices AS (SELECT stratum, list(line ORDER BY i) AS m FROM (SELECT stratum, i, list(v ORDER BY j) AS line FROM gram GROUP BY 1, 2) GROUP BY 1),
  steps AS (SELECT stratum, 1 AS k, m FROM matrices UNION ALL
    SELECT stratum, k + 1, CASE WHEN abs(m[k][k]) < 1e-9 THEN m ELSE list_transform(m, lambda line, n: CASE WHEN n = k THEN line ELSE
      list_transform(line, lambda v, j: v - line[k] / m[k][k] * m[k][j]) END) END FROM steps WHERE k < len(m))
  SELECT stratum, m, unnest(range(1, 7)) AS i FROM steps WHERE k = len(m)) WHERE abs(m[i][i]) >= 1e-9""")


def _certified(spark, d):
    def build():
        sales = cc.market(spark, d)["sales"].withColumn("ban_id", F.concat(F.lit("B"), F.trim("sale_id")))
        return settle(ca.certified_sales(sales, sm.on_spark(spark, d, _CERTIFICATES)))

    return shared("certified sales", spark, d, build)


def _effects(spark, d):
    return shared("energy effects", spark, d, lambda: ca.energy_effects(_certified(spark, d)))


@query("X04_energy_classes", "SELECT sale_id, energy_class FROM certified")
def energy_classes(spark, d):
    return _certified(spark, d).select("sale_id", "energy_class")


_COUNTED = """(SELECT densite_grille AS stratum, energy_class, count(*) AS n FROM certified WHERE type_local IN ('appartement', 'maison') AND densite_grille IS NOT NULL
  AND code_insee IS NOT NULL AND class_no IS NOT NULL AND price > 0 AND surface > 0 GROUP BY 1, 2)"""


@query(
    "X04_energy_effects",
    f"""SELECT stratum AS densite_grille, energy_class, n, floor(coalesce(effect, 0) * 1e6 + 0.5) / 1e6 AS effect, floor(exp(coalesce(effect, 0)) * 1e6 + 0.5) / 1e6 AS coefficient
        FROM {_COUNTED} LEFT JOIN energy_effects USING (stratum, energy_class) WHERE effect IS NOT NULL OR energy_class = 'D'""",
)
def energy_effects(spark, d):
    return _effects(spark, d).select("densite_grille", "energy_class", "n", tidy(F.col("effect"), 6).alias("effect"), tidy(F.col("coefficient"), 6).alias("coefficient"))


@query(
    "X04_calibrated_coefficients",
    f"""SELECT 'dpe.' || k AS cle, t AS type_bien, CASE WHEN own THEN least(greatest(floor(exp(coalesce(effect, 0)) * 1e4 + 0.5) / 1e4, 0.8), 1.15) ELSE reference END AS value,
          densite_min, CASE WHEN own THEN 'calibrated on sales' ELSE 'reference' END AS source_label
        FROM (SELECT r.*, h.densite_grille AS densite_min, e.effect, h.share >= 0.2 AND c.n >= 30 AND (e.effect IS NOT NULL OR r.k = 'D') AS own
          FROM (SELECT split_part(cle, '.', 2) AS k, type AS t, value AS reference FROM (VALUES {{rows}}) v(cle, type, value)) r
          CROSS JOIN (SELECT densite_grille, avg((class_no IS NOT NULL)::INT) AS share FROM certified WHERE type_local IN ('appartement', 'maison') AND densite_grille IS NOT NULL GROUP BY 1) h
          LEFT JOIN {_COUNTED} c ON c.stratum = h.densite_grille AND c.energy_class = r.k LEFT JOIN energy_effects e ON e.stratum = h.densite_grille AND e.energy_class = r.k)""".format(
        rows=", ".join(f"('{k}', '{t}', {v}::DOUBLE)" for k, t, v in va.fixed.COEFFICIENT_ROWS if k.startswith("dpe."))
    ),
)
def calibrated_coefficients(spark, d):
    rows = ca.calibrated_coefficients(va.coefficient_rows(spark), _effects(spark, d), _certified(spark, d), sm.REFERENCE_DATE)
    return rows.select("cle", "type_bien", F.col("valeur").cast("double").alias("value"), "densite_min", "source_label")
