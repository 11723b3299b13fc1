"""From raw sale lines to one record per sale, built property and bare land.

A sale spreads over many lines at three grains: the sale itself, its distinct
parcels, its distinct built units.  The lines of a sale meet once, as raw
text; there each line is cleaned and expanded to the grains it takes part in,
one aggregation keeps the first line of every grain, a second one folds the
grains of a sale together.  One shuffle and no joins; both aggregations read
sorted rows one by one, so a sale of any number of lines fits a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.functions import cleaning as c
from plotline.functions.numbers import money

HEAD, PARCEL, UNIT = 0, 1, 2


def by_sale(lines: DataFrame) -> DataFrame:
    """Raw lines that carry a sale id, those of one id together.

    Cleaning is done after this shuffle: in one stage with whatever makes the
    lines, the generated code is too long for the JVM to compile.
    """
    sale = F.trim("id_mutation")
    return lines.filter(sale != "").repartition(sale)


def clean_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """Typed, trimmed columns of the lines that carry a sale id.

    ``lines`` needs an ``ord`` column: the order of lines within a sale.
    """
    text = lambda name: c.clean_text(F.col(name))
    return lines.filter(F.trim("id_mutation") != "").select(
        *keep,
        "ord",
        F.trim("id_mutation").alias("id_mutation"),
        text("nature_mutation").alias("nature_mutation"),
        c.tolerant_number(F.col("valeur_fonciere")).alias("valeur_fonciere"),
        c.strict_date(F.col("date_mutation")).alias("date_mutation"),
        text("code_type_local").alias("code_type_local"),
        c.built_type(F.col("code_type_local"), F.col("type_local")).alias("built_type"),
        c.tolerant_number(F.col("surface_reelle_bati")).alias("surface_bati"),
        c.tolerant_number(F.col("nombre_pieces_principales")).alias("nb_pieces"),
        c.tolerant_number(F.col("surface_terrain")).alias("surface_terrain"),
        F.upper(text("code_nature_culture")).alias("culture"),
        c.tolerant_number(F.col("longitude"), "double").alias("longitude"),
        c.tolerant_number(F.col("latitude"), "double").alias("latitude"),
        text("code_commune").alias("code_insee"),
        text("code_departement").alias("code_departement"),
        text("code_postal").alias("code_postal"),
        text("adresse_nom_voie").alias("voie"),
        text("id_parcelle").alias("id_parcelle"),
        text("lot1_numero").alias("lot1_numero"),
    )


def _grains() -> Column:
    no_number = F.lit(None).cast("decimal(18,4)")
    blank = F.lit("")

    def grain(kind, parcel=blank, code=blank, surface=no_number, rooms=no_number, lot=blank):
        return F.struct(
            F.lit(kind).alias("grain"), parcel.alias("parcel"), code.alias("unit_code"),
            surface.alias("unit_surface"), rooms.alias("unit_rooms"), lot.alias("unit_lot"),
        )

    parcel_key = F.when(F.col("id_parcelle") != "", F.col("id_parcelle")).otherwise(
        F.concat(F.lit("ord:"), F.col("ord"))
    )
    unit = grain(
        UNIT, F.col("id_parcelle"), F.col("code_type_local"), F.col("surface_bati"),
        F.col("nb_pieces"), F.col("lot1_numero"),
    )
    return F.array_compact(
        F.array(grain(HEAD), grain(PARCEL, parcel_key), F.when(F.col("built_type").isNotNull(), unit))
    )


def first_per_grain(clean: DataFrame, *scope: str) -> DataFrame:
    """First line of each sale, each distinct parcel and each distinct unit."""
    at_head = F.col("g.grain") == HEAD
    at_parcel = F.col("g.grain") == PARCEL
    # each grain carries only the columns it is read for
    header = [
        F.when(at_head, F.col(n)).alias(n)
        for n in ("nature_mutation", "date_mutation", "code_insee", "code_departement", "code_postal")
    ]
    has_point = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    keys = [*scope, "id_mutation"]
    return (
        clean.select("*", F.explode(_grains()).alias("g"))
        .groupBy(*keys, "g.grain", "g.parcel", "g.unit_code", "g.unit_surface", "g.unit_rooms", "g.unit_lot")
        .agg(
            F.min(
                F.struct(
                    "ord", *header, F.when(~at_parcel, F.col("voie")).alias("voie"), "built_type",
                    F.when(at_parcel, F.col("culture")).alias("culture"),
                    F.when(at_parcel, F.col("surface_terrain")).alias("surface_terrain"),
                )
            ).alias("first"),
            F.max(F.when(at_head & (F.col("valeur_fonciere") > 0), F.col("valeur_fonciere"))).alias("valeur"),
            F.min(
                F.when(
                    at_head & has_point,
                    F.struct(F.col("built_type").isNull().alias("off_unit"), "ord", "longitude", "latitude"),
                )
            ).alias("point"),
            F.sum(F.when(at_head & (F.col("code_type_local") == "3"), 1).otherwise(0)).alias("deps"),
        )
    )


def sale_facts(lines: DataFrame, *scope: str) -> DataFrame:
    """Everything both sale tables need to know about a sale, one row per sale.

    ``scope`` names extra grouping columns, such as the source file, when a
    sale id may repeat across files.
    """
    grains = first_per_grain(clean_lines(by_sale(lines), *scope), *scope)
    head, parcel, unit = (F.col("grain") == k for k in (HEAD, PARCEL, UNIT))
    land = parcel & (F.col("first.surface_terrain") > 0)
    is_type = lambda t: F.max(F.when(unit & (F.col("first.built_type") == t), 1).otherwise(0))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    folded = grains.groupBy(*scope, "id_mutation").agg(
        F.max(F.when(head, F.col("first"))).alias("head"),
        F.max(F.when(head, F.col("valeur"))).alias("valeur_fonciere"),
        F.min(F.when(head, F.col("point"))).alias("point"),
        F.sum(F.when(head, F.col("deps")).otherwise(0)).alias("nb_dependances"),
        count(unit).alias("nb_locaux"),
        is_type("maison").alias("has_house"),
        is_type("appartement").alias("has_flat"),
        is_type("commercial").alias("has_shop"),
        F.sum(F.when(unit, F.col("unit_surface"))).alias("surface_sum"),
        F.sum(F.when(unit, F.col("unit_rooms"))).alias("rooms_sum"),
        F.min(F.when(unit, F.struct("first.ord", "first.voie"))).alias("unit_street"),
        F.sum(F.when(land, F.col("first.surface_terrain"))).alias("land_sum"),
        count(land).alias("nb_parcelles"),
        count(land & F.col("first.culture").isin(fixed.BUILDABLE_CULTURES)).alias("nb_parcelles_sol"),
    )
    built_kind = (
        F.when(F.col("has_flat") == 1, "appartement")
        .when(F.col("has_shop") == 1, "commercial")
        .when(F.col("has_house") == 1, "maison")
    )
    homes = F.when(F.col("has_flat") == 1, "appartement").when(F.col("has_house") == 1, "maison")
    return folded.select(
        *scope,
        "id_mutation",
        F.sha2("id_mutation", 256).alias("dedup_key"),
        F.col("head.nature_mutation").alias("nature_mutation"),
        F.col("head.date_mutation").alias("date_mutation"),
        F.col("head.code_insee").alias("code_insee"),
        c.department_or_prefix(F.col("head.code_departement"), F.col("head.code_insee")).alias("code_departement"),
        F.nullif(F.col("head.code_postal"), F.lit("")).alias("code_postal"),
        F.col("valeur_fonciere"),
        built_kind.alias("built_type"),
        homes.alias("type_local"),
        (F.col("has_house") + F.col("has_flat") + F.col("has_shop")).alias("nb_types"),
        F.col("nb_locaux").cast("int").alias("nb_locaux"),
        F.col("nb_dependances").cast("int").alias("nb_dependances"),
        F.round("surface_sum").cast("int").alias("surface_bati"),
        F.when(F.col("rooms_sum") > 0, F.round("rooms_sum").cast("int")).alias("nb_pieces"),
        F.coalesce(F.round("land_sum").cast("bigint"), F.lit(0)).alias("surface_terrain"),
        F.col("nb_parcelles").cast("int").alias("nb_parcelles"),
        F.col("nb_parcelles_sol").cast("int").alias("nb_parcelles_sol"),
        F.col("point.longitude").alias("longitude"),
        F.col("point.latitude").alias("latitude"),
        c.street_name(F.col("unit_street.voie")).alias("unit_street"),
        c.street_name(F.col("head.voie")).alias("head_street"),
        ((F.col("nb_locaux") > 0) | (F.col("nb_dependances") > 0)).alias("has_local"),
    )


def _common_rejects(chain: Column) -> Column:
    lon, lat = F.col("longitude"), F.col("latitude")
    return (
        chain.when(F.col("valeur_fonciere").isNull(), "valeur_absente")
        .when(F.col("date_mutation").isNull(), "date_invalide")
        .when(F.length("code_insee") != 5, "code_insee_absent")
        .when(~F.coalesce(c.plausible_point(lon, lat), F.lit(False)), "geolocalisation_absente")
    )


def built_reject_reason() -> Column:
    """First failed test, in a fixed order; null for a kept sale."""
    return _common_rejects(
        F.when(F.col("nature_mutation") != "Vente", "nature_non_vente")
        .when(F.col("built_type").isNull(), "aucun_local_bati")
        .when(F.col("nb_types") > 1, "multi_type")
        .when(F.col("type_local").isNull(), "type_local_non_retenu")
        .when(F.coalesce(F.col("surface_bati"), F.lit(0)) <= 0, "surface_absente")
    )


def land_reject_reason() -> Column:
    return _common_rejects(
        F.when(F.col("nature_mutation") != "Vente", "nature_non_vente")
        .when(F.col("surface_terrain") <= 0, "surface_absente")
        .when(F.col("nb_parcelles_sol") == 0, "nature_culture_non_retenue")
    )


def built_outlier_reason() -> Column:
    """Why a kept sale stays out of every statistic; it is marked, never dropped."""
    value, surface = F.col("valeur_fonciere"), F.col("surface_bati")
    kind = F.col("type_local")
    return F.when(
        F.col("reject_reason").isNull(),
        F.when(~value.between(fixed.SALE_VALUE_MIN, fixed.SALE_VALUE_MAX), "valeur_symbolique")
        .when(
            ((kind == "appartement") & ~surface.between(*fixed.FLAT_SURFACE))
            | ((kind == "maison") & ~surface.between(*fixed.HOUSE_SURFACE)),
            "surface_hors_bornes",
        )
        .when(
            (value < surface * fixed.BUILT_PRICE_MIN)
            | (value > surface * c.price_ceiling(F.col("code_departement"))),
            "prix_hors_bornes",
        ),
    )


def land_outlier_reason() -> Column:
    value, surface = F.col("valeur_fonciere"), F.col("surface_terrain")
    return F.when(
        F.col("reject_reason").isNull(),
        F.when(F.col("nb_parcelles_sol") < F.col("nb_parcelles"), "terrain_mixte")
        .when(value < fixed.SALE_VALUE_MIN, "valeur_symbolique")
        .when(~surface.between(*fixed.LAND_SURFACE), "surface_hors_bornes")
        .when(
            (value < surface * fixed.LAND_PRICE[0]) | (value > surface * fixed.LAND_PRICE[1]),
            "prix_hors_bornes",
        ),
    )


def built_candidates(facts: DataFrame, *scope: str) -> DataFrame:
    """Every sale with its reject reason or outlier mark, as a built sale."""
    return (
        facts.withColumn("reject_reason", built_reject_reason())
        .withColumn("exclusion_reason", built_outlier_reason())
        .withColumn("adresse_voie", F.col("unit_street"))
        .select(
            *scope, "id_mutation", "dedup_key", "date_mutation", "nature_mutation", "valeur_fonciere",
            "type_local", "built_type", "nb_types", "surface_bati", "nb_pieces", "surface_terrain",
            "nb_locaux", "nb_dependances", "code_insee", "code_departement", "adresse_voie",
            "code_postal", "longitude", "latitude", "reject_reason", "exclusion_reason",
        )
    )


def land_candidates(facts: DataFrame, *scope: str) -> DataFrame:
    """Sales without any unit or outbuilding, as bare land."""
    return (
        facts.filter(~F.col("has_local"))
        .withColumn("reject_reason", land_reject_reason())
        .withColumn("exclusion_reason", land_outlier_reason())
        .withColumn("adresse_voie", F.col("head_street"))
        .select(
            *scope, "id_mutation", "dedup_key", "date_mutation", "nature_mutation", "valeur_fonciere",
            "surface_terrain", "nb_parcelles", "nb_parcelles_sol", "code_insee", "code_departement",
            "adresse_voie", "code_postal", "longitude", "latitude", "reject_reason", "exclusion_reason",
        )
    )


def _stored(candidates: DataFrame, surface: str, *scope: str, **shape: Column) -> DataFrame:
    value = F.col("valeur_fonciere").cast("decimal(12,2)")
    rows = candidates.filter(F.col("reject_reason").isNull())
    for name, column in shape.items():
        rows = rows.withColumn(name, column)
    return rows.select(
        *scope, "id_mutation", "dedup_key", "date_mutation", "nature_mutation",
        value.alias("valeur_fonciere"),
        "type_local", F.col("surface_bati").cast("int").alias("surface_bati"),
        F.col("nb_pieces").cast("int").alias("nb_pieces"),
        F.col("surface_terrain").cast("int").alias("surface_terrain"),
        "nb_locaux", "nb_dependances", "code_insee", "code_departement", "adresse_voie", "code_postal",
        "longitude", "latitude",
        price_per_m2(value, F.col(surface)).alias("prix_m2"),
        F.col("exclusion_reason").isNotNull().alias("is_outlier"), "exclusion_reason",
        F.lit("dvf").alias("geoloc_source"), F.lit(True).alias("geoloc_fine"),
    )


def price_per_m2(value: Column, surface: Column) -> Column:
    surface = F.nullif(surface.cast("decimal(10,0)"), F.lit(0).cast("decimal(10,0)"))
    return F.round(value / surface, 2).cast("decimal(10,2)")


def built_sales(candidates: DataFrame, *scope: str) -> DataFrame:
    return _stored(candidates, "surface_bati", *scope)


def land_sales(candidates: DataFrame, *scope: str) -> DataFrame:
    none = F.lit(None).cast("int")
    return _stored(
        candidates, "surface_terrain", *scope,
        type_local=F.lit("terrain"), surface_bati=none, nb_pieces=none,
        nb_locaux=F.col("nb_parcelles"), nb_dependances=F.lit(0),
    )


def reject_counts(candidates: DataFrame) -> DataFrame:
    return (
        candidates.filter(F.col("reject_reason").isNotNull())
        .groupBy(F.col("reject_reason").alias("reason"))
        .agg(F.count("*").alias("total"))
    )


def summary(candidates: DataFrame, *by: str) -> DataFrame:
    kept = F.col("reject_reason").isNull()
    return candidates.groupBy(*by).agg(
        F.count("*").alias("mutations_seen"),
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("rejected"),
        F.count_if(kept & F.col("exclusion_reason").isNotNull()).alias("outliers"),
    )


def sale_years(candidates: DataFrame) -> DataFrame:
    return (
        candidates.filter(F.col("reject_reason").isNull() & F.col("date_mutation").isNotNull())
        .select(F.year("date_mutation").alias("year"))
        .distinct()
    )
