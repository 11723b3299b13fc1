"""Checks of content tables; each returns one row per violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import fixed_values as fixed

_EDGE = r"^\s+|\s+$"


def _without_comments(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", " ")


def body_length(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", "")
    return F.length(F.regexp_replace(bare, _EDGE, ""))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(_without_comments(text), r"\s+"), lambda w: w != ""))


def _present(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")) != "", F.lit(False))


def _issues(rows: DataFrame, *checks: tuple[Column, str, str, str]) -> DataFrame:
    """``checks``: condition of failure, field, rule, level."""
    failed = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(bad, F.lit(False)),
                       F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), F.lit(level).alias("level")))
                for bad, f, r, level in checks
            ]
        )
    )
    return rows.select("entry_id", "collection", F.explode(failed).alias("i")).select("entry_id", "collection", "i.*")


def duplicate_slugs(entries: DataFrame) -> DataFrame:
    """Slugs used twice in one address space: regions and departments share theirs."""
    space = F.when(F.col("collection").isin("regions", "departements"), "zones").otherwise(F.col("collection"))
    used = entries.filter(_present("slug")).withColumn("space", space)
    clash = used.groupBy("space", "slug").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = used.join(clash, ["space", "slug"], "left_semi")
    return _issues(rows, (F.lit(True), "slug", "duplicate", "error"))


def reserved_slugs(entries: DataFrame) -> DataFrame:
    pages = entries.filter(F.col("collection") == "pages")
    return _issues(pages, (F.col("slug").isin(fixed.RESERVED_PAGE_SLUGS), "slug", "reserved", "error"))


def unknown_regions(entries: DataFrame) -> DataFrame:
    """Departments whose region does not exist; only a warning for a draft."""
    published = F.col("statut") == "publie"
    departments = entries.filter(F.col("collection") == "departements")
    known = entries.filter((F.col("collection") == "regions") & _present("slug")).select(
        F.col("slug").alias("region_parente")
    ).distinct()
    orphans = departments.filter(_present("region_parente")).join(known, "region_parente", "left_anti")
    return _issues(
        departments, (~_present("region_parente") & published, "regionParente", "missing", "error")
    ).unionByName(
        _issues(
            orphans,
            (published, "regionParente", "unknown", "error"),
            (~F.coalesce(published, F.lit(False)), "regionParente", "unknown", "warning"),
        )
    )


def publication_gates(entries: DataFrame) -> DataFrame:
    """What a published entry must have; drafts pass."""
    published = entries.filter(F.col("statut") == "publie")
    zone = F.col("collection").isin("regions", "departements")
    partner, page = F.col("collection") == "partenaires", F.col("collection") == "pages"
    article = page & (F.col("gabarit") == "article")
    size = body_length(F.col("body"))
    figures = [(zone & ~_present(c), c, "missing", "error") for c in fixed.FIGURE_FIELDS]
    return _issues(
        published,
        ((zone | page) & ~_present("metaDescription"), "metaDescription", "missing", "error"),
        ((zone | partner | page) & (size == 0), "body", "empty", "error"),
        (zone & (size > 0) & (size < fixed.BODY_MIN_CHARS), "body", "too_short", "error"),
        *figures,
        (zone & (F.coalesce("faq_entries", F.lit(0)) < fixed.FAQ_MIN_ENTRIES), "faq", "too_few", "error"),
        ((zone | article) & ~_present("dateMiseAJour"), "dateMiseAJour", "missing", "error"),
        ((F.col("collection") == "departements") & ~_present("region_parente"), "regionParente", "missing", "error"),
        (partner & ~_present("description"), "description", "missing", "error"),
        (partner & ~_present("categorie"), "categorie", "missing", "error"),
        (partner & ~_present("url"), "url", "missing", "error"),
        (partner & (size > 0) & (word_count(F.col("body")) < fixed.PARTNER_WORDS_ADVISED), "body", "few_words", "warning"),
        (article & ~_present("datePublication"), "datePublication", "missing", "error"),
    )


def shape_checks(entries: DataFrame) -> DataFrame:
    """Form of each field, for drafts too."""
    meta = F.length("metaDescription")
    return _issues(
        entries,
        (~F.coalesce(F.col("slug").rlike(fixed.SLUG_PATTERN), F.lit(False)), "slug", "pattern", "error"),
        (~F.coalesce(F.length("nom") >= 1, F.lit(False)) & (F.col("collection") != "pages"), "nom", "empty", "error"),
        ((meta < 50) | (meta > 160), "metaDescription", "length", "error"),
        (F.col("prixM2") <= 0, "prixM2", "positive", "error"),
        (F.col("faq_entries") > 10, "faq", "too_many", "error"),
        (~F.col("statut").isin("brouillon", "publie"), "statut", "enum", "error"),
        (~F.col("categorie").isin(fixed.PARTNER_CATEGORIES), "categorie", "enum", "error"),
        ((F.col("collection") == "partenaires") & ~F.coalesce(F.col("url").rlike(r"^https://.+"), F.lit(False)), "url", "https", "error"),
        (_present("image") & ~_present("imageAlt"), "imageAlt", "required", "error"),
    )


def content_report(entries: DataFrame) -> DataFrame:
    return (
        duplicate_slugs(entries)
        .unionByName(reserved_slugs(entries))
        .unionByName(unknown_regions(entries))
        .unionByName(publication_gates(entries))
        .unionByName(shape_checks(entries))
    )
