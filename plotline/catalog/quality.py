"""Content checks over the documents table."""

from __future__ import annotations

from plotline import fixed_values as fixed
from plotline.catalog.entries import part, query
from plotline.operators import quality as qu
from plotline.sources import sample_market as sm

CONTENT = """SELECT doc_id AS entry_id, CASE doc_id % 4 WHEN 0 THEN 'regions' WHEN 1 THEN 'departements' WHEN 2 THEN 'partenaires' ELSE 'pages' END AS collection,
  CASE WHEN doc_id % 50 < 4 THEN 'contact' WHEN doc_id % 60 < 2 THEN 'same' WHEN doc_id % 71 = 0 THEN 'Été' ELSE concat('entry-', CAST(doc_id AS STRING)) END AS slug,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END AS nom, CASE WHEN doc_id % 3 = 0 THEN 'publie' WHEN doc_id % 101 = 0 THEN 'retire' ELSE 'brouillon' END AS statut,
  CASE WHEN doc_id % 4 = 1 THEN CASE WHEN doc_id % 16 = 1 THEN NULL WHEN doc_id % 16 = 5 THEN 'nowhere' ELSE concat('entry-', CAST(doc_id - 1 AS STRING)) END END AS region_parente,
  CASE WHEN doc_id % 7 <> 0 THEN substr(lang, 1, 2) || repeat('x', CAST(doc_id % 200 AS INT)) END AS metaDescription,
  concat('<!-- draft -->', chr(10), text) AS body, CASE WHEN doc_id % 5 <> 0 THEN CAST(n_chars - 300 AS DOUBLE) END AS prixM2,
  CASE WHEN doc_id % 11 <> 0 THEN 1e0 END AS prixMaisons, 2e0 AS prixAppartements, CASE WHEN doc_id % 13 <> 0 THEN 1e-1 END AS evolution12Mois, 5e0 AS evolution5Ans,
  CAST(doc_id % 13 AS INT) AS faq_entries, CASE WHEN doc_id % 6 <> 0 THEN '2024-01-01' END AS dateMiseAJour, CASE WHEN doc_id % 8 <> 3 THEN '2024-01-01' END AS datePublication,
  CASE WHEN doc_id % 10 = 2 THEN '' ELSE lang END AS description, CASE doc_id % 12 WHEN 2 THEN 'banque' WHEN 6 THEN 'fleuriste' END AS categorie,
  CASE WHEN doc_id % 4 = 2 THEN CASE WHEN doc_id % 20 = 2 THEN 'http://a.example' ELSE 'https://a.example' END END AS url,
  CASE WHEN doc_id % 8 = 3 THEN 'article' ELSE 'page-simple' END AS gabarit, CASE WHEN doc_id % 14 = 0 THEN 'a.png' END AS image, CASE WHEN doc_id % 28 = 0 THEN 'alt' END AS imageAlt
  FROM {documents}"""
part("content", CONTENT.format(documents="documents"))
part("content_sizes", r"""
  SELECT *, length(regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '^\s+|\s+$', '', 'g')) AS size,
    len(list_filter(regexp_split_to_array(regexp_replace(body, '(?s)<!--.*?-->', ' ', 'g'), '\s+'), lambda w: w <> '')) AS words FROM content""")


def _union(source: str, checks: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT entry_id, collection, '{field}' AS field, '{rule}' AS rule, '{level}' AS level FROM {source} WHERE {bad}"
        for bad, field, rule, level in checks
    )


def content(spark, d):
    return sm.on_spark(spark, d, CONTENT)


_SPACE = "CASE WHEN collection IN ('regions', 'departements') THEN 'zones' ELSE collection END"


@query(
    "K01_duplicate_slugs",
    f"""SELECT entry_id, collection, 'slug' AS field, 'duplicate' AS rule, 'error' AS level FROM content
        QUALIFY count(*) OVER (PARTITION BY {_SPACE}, slug) > 1""",
)
def duplicate_slugs(spark, d):
    return qu.duplicate_slugs(content(spark, d))


_RESERVED = ", ".join(f"'{s}'" for s in fixed.RESERVED_PAGE_SLUGS)


@query("K02_reserved_slugs", _union("content", [(f"collection = 'pages' AND slug IN ({_RESERVED})", "slug", "reserved", "error")]))
def reserved_slugs(spark, d):
    return qu.reserved_slugs(content(spark, d))


_KNOWN = "(SELECT slug FROM content WHERE collection = 'regions')"


@query(
    "K03_unknown_regions",
    _union("content", [
        ("collection = 'departements' AND region_parente IS NULL AND statut = 'publie'", "regionParente", "missing", "error"),
        (f"collection = 'departements' AND region_parente NOT IN {_KNOWN} AND statut = 'publie'", "regionParente", "unknown", "error"),
        (f"collection = 'departements' AND region_parente NOT IN {_KNOWN} AND statut <> 'publie'", "regionParente", "unknown", "warning"),
    ]),
)
def unknown_regions(spark, d):
    return qu.unknown_regions(content(spark, d))


_ZONE = "collection IN ('regions', 'departements')"
_PUB = "statut = 'publie'"


@query(
    "K04_publication_gates",
    _union("content_sizes", [
        (f"{_PUB} AND ({_ZONE} OR collection = 'pages') AND metaDescription IS NULL", "metaDescription", "missing", "error"),
        (f"{_PUB} AND size = 0", "body", "empty", "error"),
        (f"{_PUB} AND {_ZONE} AND size > 0 AND size < 400", "body", "too_short", "error"),
        *[(f"{_PUB} AND {_ZONE} AND {c} IS NULL", c, "missing", "error") for c in fixed.FIGURE_FIELDS],
        (f"{_PUB} AND {_ZONE} AND faq_entries < 2", "faq", "too_few", "error"),
        (f"{_PUB} AND ({_ZONE} OR (collection = 'pages' AND gabarit = 'article')) AND dateMiseAJour IS NULL", "dateMiseAJour", "missing", "error"),
        (f"{_PUB} AND collection = 'departements' AND region_parente IS NULL", "regionParente", "missing", "error"),
        (f"{_PUB} AND collection = 'partenaires' AND description = ''", "description", "missing", "error"),
        (f"{_PUB} AND collection = 'partenaires' AND categorie IS NULL", "categorie", "missing", "error"),
        (f"{_PUB} AND collection = 'partenaires' AND size > 0 AND words < 300", "body", "few_words", "warning"),
        (f"{_PUB} AND collection = 'pages' AND gabarit = 'article' AND datePublication IS NULL", "datePublication", "missing", "error"),
    ]),
)
def publication_gates(spark, d):
    return qu.publication_gates(content(spark, d))


@query(
    "K05_shape_checks",
    _union("content", [
        ("NOT regexp_matches(slug, '^[a-z0-9-]+$')", "slug", "pattern", "error"),
        ("nom = '' AND collection <> 'pages'", "nom", "empty", "error"),
        ("length(metaDescription) < 50 OR length(metaDescription) > 160", "metaDescription", "length", "error"),
        ("prixM2 <= 0", "prixM2", "positive", "error"),
        ("faq_entries > 10", "faq", "too_many", "error"),
        ("statut = 'retire'", "statut", "enum", "error"),
        ("categorie = 'fleuriste'", "categorie", "enum", "error"),
        ("collection = 'partenaires' AND url NOT LIKE 'https://_%'", "url", "https", "error"),
        ("image IS NOT NULL AND imageAlt IS NULL", "imageAlt", "required", "error"),
    ]),
)
def shape_checks(spark, d):
    return qu.shape_checks(content(spark, d))
