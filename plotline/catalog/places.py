"""Communes, codes and the location of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.catalog.entries import part, query
from plotline.functions import geo
from plotline.functions.text import plain_name, slug
from plotline.operators import places as pl
from plotline.sources import sample_market as sm

TODAY = sm.REFERENCE_DATE

part("communes", """
  SELECT *, trim(lower(strip_accents(nom))) AS nom_normalise, code_departement NOT IN ('57', '67', '68', '976') AS has_dvf
  FROM commune_rows""")
part("postcodes", "SELECT *, unnest(codes_postaux) AS postal_code FROM communes")
part("largest", """
  SELECT DISTINCT ON (postal_code) * FROM postcodes ORDER BY postal_code, population DESC NULLS LAST, code_insee""")
part("near_rows", f"""
  SELECT DISTINCT ON (request_id) * FROM (
    SELECT request_id, c.code_insee, c.nom, c.has_dvf, {geo.distance_sql('r.lon', 'r.lat', 'c.longitude', 'c.latitude')} AS distance
    FROM request_rows r JOIN postcodes c USING (postal_code) WHERE r.lon IS NOT NULL AND r.lat IS NOT NULL)
  ORDER BY request_id, distance, code_insee""")


def _grams(text: str) -> str:
    words = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"
    return (
        f"list_distinct(flatten(list_transform({words}, lambda w: "
        "list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


part("named_scores", f"""
  SELECT r.postal_code, r.city, c.*  EXCLUDE (postal_code),
    {_grams('c.nom_normalise')} AS a, {_grams("strip_accents(lower(trim(r.city)))")} AS b
  FROM (SELECT DISTINCT postal_code, city FROM request_rows) r JOIN postcodes c USING (postal_code)""")
part("named_rows", """
  SELECT DISTINCT ON (postal_code, city) *,
    CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0 END AS score
  FROM named_scores ORDER BY postal_code, city,
    CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0 END DESC,
    population DESC NULLS LAST, code_insee""")


def _key(prefix: str = "") -> str:
    tidy = lambda c: f"regexp_replace(lower(trim(coalesce({prefix}{c}, ''))), '\\s+', ' ', 'g')"
    return f"sha256({tidy('address')} || '|' || {tidy('postal_code')} || '|' || {tidy('city')})"


_CLASS = """CASE WHEN score IS NULL OR score < 0.4 THEN 'reject' WHEN result_type = 'housenumber' AND score >= 0.7 THEN 'exact'
  WHEN result_type IN ('street', 'locality') THEN 'approximate' WHEN score < 0.7 THEN 'approximate' ELSE 'reject' END"""
part("stored_rows", f"""
  SELECT DISTINCT ON (address_key) * FROM (
    SELECT {_key()} AS address_key, label, code_insee, lon, lat, expires_on, {_CLASS} AS precision FROM address_rows
    WHERE expires_on > DATE '{TODAY}') WHERE precision <> 'reject' ORDER BY address_key, expires_on DESC, label DESC""")
_DEP_POSTCODE = """CASE WHEN regexp_matches(trim({0}), '^\\d{{5}}$') THEN CASE WHEN left(trim({0}), 2) IN ('97', '98')
  THEN left(trim({0}), 3) ELSE left(trim({0}), 2) END END"""
part("located", f"""
  WITH placed AS (SELECT r.* EXCLUDE (lon, lat), {_key('r.')} AS address_key,
    CASE WHEN n.request_id IS NOT NULL THEN 'provided' WHEN s.address_key IS NOT NULL THEN 'address'
         WHEN m.postal_code IS NOT NULL THEN 'commune' ELSE 'none' END AS loc_source,
    CASE WHEN n.request_id IS NOT NULL THEN n.nom || ' ' || r.postal_code WHEN s.address_key IS NOT NULL THEN s.label
         WHEN m.postal_code IS NOT NULL THEN m.nom || ' ' || r.postal_code ELSE r.city || ' ' || r.postal_code END AS loc_label,
    CASE WHEN n.request_id IS NOT NULL THEN n.code_insee WHEN s.address_key IS NOT NULL THEN s.code_insee ELSE m.code_insee END AS city_code,
    CASE WHEN n.request_id IS NOT NULL THEN r.lon WHEN s.address_key IS NOT NULL THEN s.lon ELSE m.longitude END AS lon,
    CASE WHEN n.request_id IS NOT NULL THEN r.lat WHEN s.address_key IS NOT NULL THEN s.lat ELSE m.latitude END AS lat,
    CASE WHEN n.request_id IS NOT NULL THEN 'approximate' WHEN s.address_key IS NOT NULL THEN s.precision ELSE 'city-centroid' END AS precision
  FROM request_rows r LEFT JOIN (SELECT * FROM near_rows WHERE distance <= 30000) n ON n.request_id = r.request_id
    LEFT JOIN stored_rows s ON s.address_key = {_key('r.')}
    LEFT JOIN named_rows m ON m.postal_code = r.postal_code AND m.city = r.city)
  SELECT p.*, CASE WHEN c.code_insee IS NOT NULL THEN c.code_insee WHEN b.code_insee IS NOT NULL THEN b.code_insee ELSE city_code END AS code_insee,
    coalesce(c.nom, b.nom) AS commune,
    coalesce(c.code_departement, b.code_departement, {_DEP_POSTCODE.format('p.postal_code')}) AS code_departement,
    CASE WHEN c.code_insee IS NOT NULL THEN c.code_region ELSE b.code_region END AS code_region,
    CASE WHEN c.code_insee IS NOT NULL THEN c.code_epci ELSE b.code_epci END AS code_epci,
    CASE WHEN c.code_insee IS NOT NULL THEN c.densite_grille ELSE b.densite_grille END AS densite_grille,
    coalesce(c.has_dvf, b.has_dvf, NOT coalesce({_DEP_POSTCODE.format('p.postal_code')} IN ('57','67','68','976'), false)) AS has_dvf
  FROM placed p LEFT JOIN communes c ON c.code_insee = p.city_code LEFT JOIN largest b ON b.postal_code = p.postal_code""")


def located(spark, d):
    return pl.locate(sm.requests(spark, d), sm.communes(spark, d), sm.addresses(spark, d), TODAY)


@query(
    "G01_G17_names_and_slugs",
    r"""SELECT code_insee, trim(lower(strip_accents(nom))) AS plain,
        regexp_replace(regexp_replace(lower(strip_accents(nom)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM commune_rows""",
)
def names_and_slugs(spark, d):
    rows = sm.on_spark(spark, d, sm.COMMUNES)
    return rows.select("code_insee", plain_name(F.col("nom")).alias("plain"), slug(F.col("nom")).alias("slug"))


_RAW = """(SELECT code_insee, CASE WHEN code_insee LIKE '%3' THEN '' ELSE nom END AS nom,
  CASE WHEN code_insee LIKE '%7' THEN '988' WHEN code_insee LIKE '%A' THEN NULL ELSE code_departement END AS code_departement,
  CASE WHEN code_insee LIKE '%5' THEN NULL ELSE longitude END AS longitude, latitude FROM {})"""


@query(
    "G02_G03_G04_commune_rules",
    f"""WITH raw AS (SELECT code_insee, nom, coalesce(code_departement, left(code_insee, 2)) AS code_departement, longitude, latitude
          FROM {_RAW.format('commune_rows')})
        SELECT code_insee, code_departement, CASE WHEN NOT regexp_matches(code_departement, '^(\\d{{2}}|2A|2B|97[1-46])$') THEN 'out_of_scope'
          WHEN length(code_insee) <> 5 OR nom = '' OR longitude IS NULL OR latitude IS NULL THEN 'skipped' END AS left_out,
          code_departement NOT IN ('57','67','68','976') AS has_dvf FROM raw""",
)
def commune_rules(spark, d):
    rows = spark.sql(f"SELECT * FROM {_RAW.format('{rows}')}", rows=sm.on_spark(spark, d, sm.COMMUNES))
    return pl.judged_communes(rows).select("code_insee", "code_departement", "left_out", "has_dvf")


@query(
    "G05_commune_import_counts",
    f"""WITH raw AS (SELECT code_insee, nom, coalesce(code_departement, left(code_insee, 2)) AS code_departement, longitude, latitude
          FROM {_RAW.format('commune_rows')}), j AS (SELECT *, CASE WHEN NOT regexp_matches(code_departement, '^(\\d{{2}}|2A|2B|97[1-46])$')
          THEN 'out_of_scope' WHEN length(code_insee) <> 5 OR nom = '' OR longitude IS NULL OR latitude IS NULL THEN 'skipped' END AS left_out FROM raw)
        SELECT count(*) AS read, count(*) FILTER (WHERE left_out IS NULL) AS upserted, count(*) FILTER (WHERE left_out = 'skipped') AS skipped,
          count(*) FILTER (WHERE left_out = 'out_of_scope') AS out_of_scope,
          count(*) FILTER (WHERE left_out IS NULL AND code_departement IN ('57','67','68','976')) AS without_sales FROM j""",
)
def commune_import_counts(spark, d):
    rows = spark.sql(f"SELECT * FROM {_RAW.format('{rows}')}", rows=sm.on_spark(spark, d, sm.COMMUNES))
    return pl.commune_counts(pl.judged_communes(rows))


@query("G06_largest_of_postcode", "SELECT postal_code, code_insee FROM largest")
def largest_of_postcode(spark, d):
    return pl.largest_of_postcode(sm.communes(spark, d)).select("postal_code", "code_insee")


@query("G07_nearest_of_postcode", "SELECT request_id, code_insee, distance FROM near_rows WHERE distance <= 30000")
def nearest_of_postcode(spark, d):
    near = pl.nearest_of_postcode(sm.requests(spark, d), sm.communes(spark, d))
    return near.select("request_id", "code_insee", "distance")


@query("G08_best_named_commune", "SELECT postal_code, city, code_insee, floor(score * 1e6 + 0.5) / 1e6 AS score FROM named_rows")
def best_named_commune(spark, d):
    best = pl.best_named(sm.requests(spark, d), sm.communes(spark, d))
    return best.select("postal_code", "city", "code_insee", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


@query("G09_address_keys", f"SELECT request_id, {_key()} AS address_key FROM request_rows")
def address_keys(spark, d):
    key = pl.address_key(F.col("address"), F.col("postal_code"), F.col("city"))
    return sm.requests(spark, d).select("request_id", key.alias("address_key"))


@query("G10_precision_classes", f"SELECT result_type, score, {_CLASS} AS precision, count(*) AS n FROM address_rows GROUP BY 1, 2, 3")
def precision_classes(spark, d):
    kind = pl.precision_class(F.col("result_type"), F.col("score")).alias("precision")
    return sm.addresses(spark, d).groupBy("result_type", "score", kind).agg(F.count("*").alias("n"))


@query("G11_live_addresses", "SELECT address_key, label, code_insee, lon, lat, precision FROM stored_rows")
def live_addresses(spark, d):
    return pl.live_addresses(sm.addresses(spark, d), TODAY).drop("expires_on")


@query(
    "G12_G15_located_requests",
    """SELECT request_id, loc_source, loc_label, city_code, lon, lat, precision, code_insee, commune, code_departement, code_region,
       code_epci, densite_grille, has_dvf FROM located""",
)
def located_requests(spark, d):
    return located(spark, d).select(
        "request_id", "loc_source", "loc_label", "city_code", "lon", "lat", "precision", "code_insee", "commune",
        "code_departement", "code_region", "code_epci", "densite_grille", "has_dvf",
    )


_CODES = """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '97' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')
  WHEN 1 THEN '20' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') WHEN 2 THEN 'x' || CAST(c_custkey AS STRING)
  WHEN 3 THEN ' ' || lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') WHEN 4 THEN '98' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')
  ELSE lpad(CAST(c_custkey * 37 % 100000 AS STRING), 5, '0') END AS code FROM {customer}"""


@query(
    "G13_G14_departments_of_codes",
    f"""SELECT id, code, {_DEP_POSTCODE.format('code')} AS from_postcode,
        CASE WHEN length(code) >= 2 THEN CASE WHEN left(code, 2) IN ('97','98') THEN left(code, 3) ELSE left(code, 2) END END AS from_commune,
        CASE WHEN NOT regexp_matches(trim(code), '^\\d{{5}}$') THEN '' WHEN left(trim(code), 2) = '20' THEN
          CASE WHEN left(trim(code), 3)::INT <= 201 THEN '2A' ELSE '2B' END
          WHEN left(trim(code), 2) IN ('97','98') THEN left(trim(code), 3) ELSE left(trim(code), 2) END AS with_corsica
        FROM ({_CODES.format(customer='customer')})""",
)
def departments_of_codes(spark, d):
    code = F.col("code")
    return sm.on_spark(spark, d, _CODES).select(
        "id", "code", pl.department_from_postcode(code).alias("from_postcode"),
        pl.department_from_commune(code).alias("from_commune"), pl.department_with_corsica(code).alias("with_corsica"),
    )


_ZONES = """SELECT CASE WHEN c_custkey % 50 = 49 THEN '99' ELSE lpad(CAST(c_custkey % 96 AS STRING), 2, '0') END AS code,
  concat('Zone (', CASE WHEN c_custkey % 20 = 3 THEN '2A' WHEN c_custkey % 20 = 4 THEN 'ZZ' ELSE lpad(CAST(c_custkey % 96 AS STRING), 2, '0') END, ')') AS name
  FROM {customer}"""


@query(
    "G16_zone_regions",
    r"""SELECT code, name, issue, count(*) AS n FROM (SELECT code, name, CASE
        WHEN code IN ('00', '20', '99', '96') THEN 'unmapped_code'
        WHEN NOT regexp_matches(name, '^(.+)\s\((\d{2,3}|2A|2B)\)$') THEN 'unreadable_name'
        WHEN regexp_extract(name, '^(.+)\s\((\d{2,3}|2A|2B)\)$', 2) <> code THEN 'code_mismatch' END AS issue
        FROM (""" + _ZONES.format(customer="customer") + """)) GROUP BY 1, 2, 3""",
)
def zone_regions(spark, d):
    checked = pl.zone_checks(sm.on_spark(spark, d, _ZONES))
    return checked.groupBy("code", "name", "issue").agg(F.count("*").alias("n"))
