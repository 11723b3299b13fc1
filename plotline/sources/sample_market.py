"""Sale lines, communes, requests, leads and events derived from the test tables.

The test tables hold orders, not property sales.  Each template below maps
whole tables to one input of the library.  They are plain SQL that Spark and
other engines read alike, so a check elsewhere starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotline.session import unless_small

REFERENCE_DATE = "2001-08-01"


def _commune(key: str) -> dict[str, str]:
    """Commune attributes as expressions of a customer key."""
    k = f"CAST(floor({key} / 8) AS BIGINT)"
    block = f"CAST(floor({key} / 200) AS BIGINT)"
    place = f"({k} % 25)"
    step = f"(CASE {block} % 4 WHEN 0 THEN 2e-3 WHEN 1 THEN 1e-2 WHEN 2 THEN 3e-2 ELSE 2e-1 END)"
    return {
        "k": k,
        "block": block,
        "code": f"lpad(hex({k}), 5, '0')",
        "department": (
            f"(CASE {block} % 25 WHEN 0 THEN '57' WHEN 1 THEN '75' WHEN 2 THEN '2A' WHEN 3 THEN '974' "
            f"ELSE CAST({block} % 25 + 10 AS STRING) END)"
        ),
        "postcode": f"CAST(10000 + CAST(floor({key} / 24) AS BIGINT) % 89000 AS STRING)",
        "lon": f"(-4e0 + (CAST(floor({block} / 8) AS BIGINT) % 60) * 9e-1 + ({place} % 5) * {step})",
        "lat": f"(42e0 + ({block} % 8) * 1e0 + CAST(floor({place} / 5) AS BIGINT) * {step})",
    }


_O = _commune("o_custkey")
_C = _commune("c_custkey")
_K = _commune("(k * 8)")

SALE_LINES = f"""
WITH base AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, o_custkey, o_orderstatus,
         o_totalprice, c_mktsegment, CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
), placed AS (
  SELECT *, {_O['code']} AS commune, {_O['department']} AS department,
         {_O['postcode']} AS postcode, {_O['lon']} AS lon0, {_O['lat']} AS lat0
  FROM base
)
SELECT
  CASE WHEN l_orderkey % 101 = 0 THEN '  ' ELSE concat(' ', CAST(l_orderkey AS STRING)) END AS id_mutation,
  CAST(ord AS BIGINT) AS ord,
  CASE o_orderstatus WHEN 'P' THEN 'Echange' ELSE 'Vente' END AS nature_mutation,
  CASE WHEN l_orderkey % 59 = 0 THEN '' WHEN l_orderkey % 53 = 0 THEN '1'
       WHEN l_orderkey % 3 = 0 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '.', ',')
       ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END AS valeur_fonciere,
  CASE WHEN l_orderkey % 97 = 0
       THEN concat(substr(iso, 9, 2), '/', substr(iso, 6, 2), '/', substr(iso, 1, 4)) ELSE iso END AS date_mutation,
  CASE WHEN l_orderkey % 10 = 9 THEN ''
       WHEN l_orderkey % 17 = 0 AND ord = 2 THEN CASE WHEN l_orderkey % 10 <= 4 THEN '1' ELSE '2' END
       WHEN ord % 2 = 0 THEN '3'
       WHEN l_orderkey % 10 <= 4 THEN '2' WHEN l_orderkey % 10 <= 6 THEN '1'
       WHEN l_orderkey % 10 = 7 THEN ' ' ELSE '4' END AS code_type_local,
  CASE WHEN l_orderkey % 10 = 7 THEN 'Maison' ELSE '' END AS type_local,
  CASE WHEN l_orderkey % 13 = 0 THEN '60' ELSE CAST(CAST(l_quantity * 3 AS BIGINT) AS STRING) END AS surface_reelle_bati,
  CASE WHEN l_orderkey % 13 = 0 THEN '3' ELSE CAST(CAST(floor(l_quantity / 10) AS BIGINT) + 1 AS STRING) END
    AS nombre_pieces_principales,
  CASE WHEN l_orderkey % 13 = 0 THEN 'P1' WHEN l_partkey % 50 = 0 THEN ''
       ELSE concat('P', CAST(l_partkey % 50 AS STRING)) END AS id_parcelle,
  CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE CAST(l_suppkey % 3 AS STRING) END AS lot1_numero,
  CASE l_returnflag WHEN 'R' THEN 's' WHEN 'A' THEN 'T' ELSE '' END AS code_nature_culture,
  CAST(l_suppkey % 100 * 10 AS STRING) AS surface_terrain,
  CASE WHEN l_orderkey % 41 = 0 THEN ''
       ELSE CAST(CAST(lon0 + (l_partkey % 100) * 1e-4 AS DECIMAL(12,6)) AS STRING) END AS longitude,
  CASE WHEN l_orderkey % 41 = 0 THEN ''
       ELSE CAST(CAST(lat0 + (l_suppkey % 100) * 1e-4 AS DECIMAL(12,6)) AS STRING) END AS latitude,
  commune AS code_commune,
  CASE WHEN o_custkey % 11 = 0 THEN '' ELSE department END AS code_departement,
  postcode AS code_postal,
  concat(CAST(l_suppkey % 30 AS STRING), CASE l_linenumber % 3 WHEN 0 THEN ' bis ' WHEN 1 THEN ' B ' ELSE ' ' END,
         'RUE ', c_mktsegment, '-L''', lower(c_mktsegment)) AS adresse_nom_voie
FROM placed
"""

COMMUNES = f"""
WITH keys AS (SELECT CAST(floor(c_custkey / 8) AS BIGINT) AS k FROM {{customer}} GROUP BY 1)
SELECT {_K['code']} AS code_insee,
       concat(CASE k % 4 WHEN 0 THEN 'Évry-sur-' WHEN 1 THEN 'Saint-' WHEN 2 THEN 'Le ' ELSE 'Château-' END,
              replace(n_name, 'NATION_', 'Vallée '), ' ', CAST(k AS STRING)) AS nom,
       split(concat({_K['postcode']},
         CASE WHEN k % 5 = 0 THEN concat(';', CAST(10000 + (CAST(floor(k / 3) AS BIGINT) + 1) % 89000 AS STRING)) ELSE '' END), ';')
         AS codes_postaux,
       {_K['department']} AS code_departement,
       lpad(CAST(n_regionkey + 10 AS STRING), 2, '0') AS code_region,
       concat('2000', lpad(CAST(CAST(floor(k / 5) AS BIGINT) AS STRING), 5, '0')) AS code_epci,
       CASE WHEN k % 7 = 3 THEN NULL ELSE 500 + (k * 7919) % 20000 END AS population,
       CASE WHEN {_K['block']} % 5 = 4 THEN NULL ELSE 1 + {_K['block']} % 7 END AS densite_grille,
       {_K['lon']} AS longitude, {_K['lat']} AS latitude
FROM keys JOIN {{nation}} ON n_nationkey = {_K['block']} % 25
"""

#: One property to value per customer.
REQUESTS = f"""
SELECT c_custkey AS request_id,
       concat(CAST(c_custkey % 90 + 1 AS STRING), '  Rue ', c_mktsegment) AS address,
       {_C['postcode']} AS postal_code,
       concat(CASE {_C['k']} % 4 WHEN 0 THEN 'Evry-sur-' WHEN 1 THEN 'saint ' WHEN 2 THEN 'Le ' ELSE 'Chateau ' END,
              'Vallee ', CAST({_C['block']} % 25 AS STRING), ' ', CAST({_C['k']} AS STRING)) AS city,
       CASE WHEN c_custkey % 10 <= 4 THEN 'appartement' WHEN c_custkey % 10 <= 7 THEN 'maison'
            WHEN c_custkey % 10 = 8 THEN 'terrain' ELSE 'local-commercial' END AS property_type,
       CAST(CASE WHEN c_custkey % 10 = 8 THEN (30 + (c_custkey * 7) % 400) * 5 ELSE 20 + (c_custkey * 7) % 240 END AS DOUBLE)
         + CASE WHEN c_custkey % 4 = 0 THEN 5e-1 ELSE 0e0 END AS surface,
       CASE WHEN c_custkey % 10 = 8 THEN NULL ELSE CAST(1 + c_custkey % 6 AS INT) END AS rooms,
       CASE c_custkey % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E'
            WHEN 5 THEN 'F' WHEN 6 THEN 'G' ELSE 'unknown' END AS dpe,
       CASE WHEN c_custkey % 10 <= 4 AND c_custkey % 9 <> 0 THEN CAST(c_custkey % 6 AS INT) END AS floor,
       CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_elevator,
       CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'balcony' WHEN 2 THEN 'terrace' WHEN 3 THEN 'garden' END AS outdoor,
       CASE c_custkey % 7 WHEN 0 THEN 'to-renovate' WHEN 1 THEN 'fair' WHEN 2 THEN 'good' WHEN 3 THEN 'new' END AS condition,
       CASE WHEN c_custkey % 10 BETWEEN 5 AND 7 AND c_custkey % 4 <> 0 THEN CAST((c_custkey % 5) * 1500 AS DOUBLE) END AS terrain_size,
       CASE WHEN c_custkey % 3 = 0 THEN {_C['lon']} + (c_custkey % 8) * 1e-3 + CASE WHEN c_custkey % 51 = 0 THEN 2e0 ELSE 0e0 END END AS lon,
       CASE WHEN c_custkey % 3 = 0 THEN {_C['lat']} + (c_custkey % 7) * 1e-3 END AS lat
FROM {{customer}}
"""

#: Resolved addresses: some stale, some too vague, some of another street than was asked for.
ADDRESSES = f"""
SELECT concat(CAST(c_custkey % 90 + 1 AS STRING), ' rue ', c_mktsegment, CASE WHEN c_custkey % 3 = 2 THEN ' prolongee' ELSE '' END) AS address,
       {_C['postcode']} AS postal_code,
       concat(CASE {_C['k']} % 4 WHEN 0 THEN 'Evry-sur-' WHEN 1 THEN 'saint ' WHEN 2 THEN 'Le ' ELSE 'Chateau ' END,
              'Vallee ', CAST({_C['block']} % 25 AS STRING), ' ', CAST({_C['k']} AS STRING)) AS city,
       concat('adresse ', CAST(c_custkey AS STRING)) AS label,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE {_C['code']} END AS code_insee,
       {_C['lon']} + (c_custkey % 8) * 11e-4 AS lon,
       {_C['lat']} + (c_custkey % 5) * 7e-4 AS lat,
       CAST(c_custkey % 11 AS DOUBLE) / 1e1 AS score,
       CASE c_custkey % 4 WHEN 0 THEN 'housenumber' WHEN 1 THEN 'street' WHEN 2 THEN 'municipality' ELSE 'housenumber' END AS result_type,
       CAST(CASE WHEN c_custkey % 13 = 0 THEN '2001-07-31' ELSE '2001-10-30' END AS DATE) AS expires_on
FROM {{customer}}
"""

#: Web hits: one per event, with an arrival address and a referrer.
HITS = """
SELECT event_id, user_id AS session_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value,
       concat('https://site.example', CASE event_id % 6 WHEN 0 THEN '/' WHEN 1 THEN '/estimation/' WHEN 2 THEN '/rapport/'
              WHEN 3 THEN '/partenaires/agence/' WHEN 4 THEN '/contact' ELSE '/pages/guide/' END,
         CASE WHEN event_id % 11 = 0 THEN concat('?gclid=g', CAST(event_id AS STRING))
              WHEN event_id % 11 = 1 THEN '?utm_source=Meta&utm_medium=paid_social&utm_campaign=printemps%20vert'
              WHEN event_id % 11 = 2 THEN '?utm_medium=email&utm_source=lettre'
              WHEN event_id % 11 = 3 THEN '?utm_medium=referral'
              WHEN event_id % 11 = 4 THEN '?utm_term=maison&utm_content=%20'
              WHEN event_id % 11 = 5 THEN concat('?utm_source=a b&utm_campaign=x|y_', CAST(event_id % 3 AS STRING))
              ELSE '' END) AS href,
       CASE event_id % 7 WHEN 0 THEN 'https://www.google.com/search?q=x' WHEN 1 THEN 'https://blog.example.org/a'
            WHEN 2 THEN 'https://SITE.example/estimation/' WHEN 3 THEN 'not a url' WHEN 4 THEN 'https://my_blog.Example:8080/z' ELSE '' END AS referrer,
       concat('10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 3 AS STRING)) AS ip,
       CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('agent/', CAST(event_id % 5 AS STRING)) END AS user_agent
FROM {events}
"""

#: One lead per customer.
LEADS = f"""
SELECT c_custkey AS lead_row,
       concat('lead-', CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING)) AS lead_id,
       CASE WHEN c_custkey % 5 = 4 THEN 'contact' WHEN c_custkey % 97 = 0 THEN 'other' ELSE 'estimation' END AS kind,
       CASE WHEN c_custkey % 31 = 0 THEN 'X' ELSE c_name END AS name,
       CASE c_custkey % 6 WHEN 0 THEN concat('  Jean.', c_name, '@Mail.example ') WHEN 1 THEN concat('ab', '@mail.example')
            WHEN 2 THEN '' WHEN 3 THEN 'no-at-sign' WHEN 4 THEN '@mail.example' ELSE concat(c_name, '@b.example') END AS email,
       CASE c_custkey % 7 WHEN 0 THEN '06 12 34 56 78' WHEN 1 THEN '+33 6 12-34-56-78' WHEN 2 THEN '0033612345678'
            WHEN 3 THEN '33612345678' WHEN 4 THEN '12345' WHEN 5 THEN 'call me' ELSE NULL END AS phone,
       CASE c_custkey % 4 WHEN 0 THEN 'Partenariat' WHEN 1 THEN 'estimation' WHEN 2 THEN 'autre' END AS subject,
       CASE WHEN c_custkey % 3 = 0 THEN concat('line one', chr(10), 'line two') END AS message,
       CASE WHEN c_custkey % 19 = 0 THEN 'http://bot.example' ELSE '' END AS website,
       {_C['postcode']} AS postal_code,
       CASE WHEN c_custkey % 10 <= 4 THEN 'appartement' WHEN c_custkey % 10 <= 7 THEN 'maison' ELSE 'terrain' END AS property_type,
       CAST(20 + (c_custkey * 7) % 240 AS DOUBLE) AS surface,
       CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS is_owner,
       CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'maybe' WHEN 2 THEN 'no' END AS want_to_sell,
       CASE WHEN c_custkey % 8 <> 0 THEN 6e4 + (c_custkey * 977) % 900000 END AS estimation_mid,
       CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'static-fallback' ELSE 'deferred' END AS status
FROM {{customer}}
"""

_TABLES = ("lineitem", "orders", "customer", "nation", "events", "pages", "documents", "labels", "supplier", "part")


def on_spark(spark: SparkSession, folder: str, template: str, *spread: str) -> DataFrame:
    """The rows of a template; tables named in ``spread`` are broadcast only if they are small."""
    used = [t for t in _TABLES if "{" + t + "}" in template]
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in used}
    return spark.sql(template, **tables | {t: unless_small(tables[t], f"{folder}/{t}.parquet") for t in spread})


def _by_customer(spark: SparkSession, folder: str, template: str) -> DataFrame:
    """Rows that grow with the customers, to be joined like a settled copy."""
    return unless_small(on_spark(spark, folder, template), f"{folder}/customer.parquet")


def as_sql(template: str) -> str:
    return template.format(**{t: t for t in _TABLES})


def sale_lines(spark: SparkSession, folder: str) -> DataFrame:
    return on_spark(spark, folder, SALE_LINES, "orders", "customer")


def communes(spark: SparkSession, folder: str) -> DataFrame:
    from plotline.operators.places import with_coverage

    return with_coverage(_by_customer(spark, folder, COMMUNES))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return _by_customer(spark, folder, REQUESTS)


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    return _by_customer(spark, folder, ADDRESSES)


def hits(spark: SparkSession, folder: str) -> DataFrame:
    return on_spark(spark, folder, HITS)


def leads(spark: SparkSession, folder: str) -> DataFrame:
    return on_spark(spark, folder, LEADS)
