"""Communes and the location of properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.functions import geo
from plotline.functions.text import plain_name, similarity, unaccent, without_ligatures
from plotline.session import settle

_COMMUNE = [
    "code_insee", "nom", "code_departement", "code_region", "code_epci", "densite_grille", "has_dvf",
    "longitude", "latitude",
]


# --- Commune referential ----------------------------------------------------


def with_coverage(communes: DataFrame) -> DataFrame:
    """Searchable name and coverage flag of each commune."""
    return communes.withColumn("nom_normalise", plain_name(F.col("nom"))).withColumn(
        "has_dvf", ~F.col("code_departement").isin(fixed.DEPARTMENTS_WITHOUT_SALES)
    )


def in_scope(department: Column) -> Column:
    return department.rlike(fixed.SCOPE_PATTERN)


def importable() -> Column:
    """A five-character code, a name and a finite centre."""
    lon, lat = F.col("longitude"), F.col("latitude")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce(
        (F.length("code_insee") == 5) & (F.length("nom") > 0) & finite(lon) & finite(lat), F.lit(False)
    )


def judged_communes(raw: DataFrame) -> DataFrame:
    """Each raw commune with the reason it stays out, if any."""
    department = F.coalesce(F.col("code_departement"), F.substring("code_insee", 1, 2))
    rows = raw.withColumn("code_departement", department)
    reason = F.when(~F.coalesce(in_scope(F.col("code_departement")), F.lit(False)), "out_of_scope").when(
        ~importable(), "skipped"
    )
    return with_coverage(rows.withColumn("left_out", reason))


def commune_counts(judged: DataFrame) -> DataFrame:
    kept = F.col("left_out").isNull()
    return judged.agg(
        F.count("*").alias("read"),
        F.count_if(kept).alias("upserted"),
        F.count_if(F.col("left_out") == "skipped").alias("skipped"),
        F.count_if(F.col("left_out") == "out_of_scope").alias("out_of_scope"),
        F.count_if(kept & ~F.col("has_dvf")).alias("without_sales"),
    )


def upsert_communes(current: DataFrame, batch: DataFrame) -> DataFrame:
    """New rows win by commune code; the others stay."""
    return current.join(batch.select("code_insee"), "code_insee", "left_anti").unionByName(batch)


# --- Department and region codes --------------------------------------------


def _overseas_or_two(code: Column) -> Column:
    wide = F.substring(code, 1, 2).isin("97", "98")
    return F.when(wide, F.substring(code, 1, 3)).otherwise(F.substring(code, 1, 2))


def department_from_postcode(postcode: Column) -> Column:
    code = F.trim(postcode)
    return F.when(code.rlike(r"^\d{5}\z"), _overseas_or_two(code))


def department_from_commune(code: Column) -> Column:
    return F.when(F.length(code) >= 2, _overseas_or_two(code))


def department_with_corsica(postcode: Column) -> Column:
    """Department of a postcode, with Corsica split in two; empty if invalid."""
    code = F.trim(F.coalesce(postcode, F.lit("")))
    island = F.when(F.substring(code, 1, 3).cast("int") <= 201, "2A").otherwise("2B")
    return (
        F.when(~code.rlike(r"^\d{5}\z"), "")
        .when(code.startswith("20"), island)
        .otherwise(_overseas_or_two(code))
    )


def region_of(department: Column) -> Column:
    """Region slug of a department; null for an unmapped code."""
    pairs = [F.lit(x) for row in fixed.DEPARTMENT_REGIONS.items() for x in row]
    return F.try_element_at(F.create_map(*pairs), department)


def zone_checks(zones: DataFrame) -> DataFrame:
    """Zones with their region and what is wrong with them.

    ``zones``: ``code`` and ``name`` written as ``Name (code)``.
    """
    inside = F.regexp_extract("name", r"^(.+)\s\((\d{2,3}|2A|2B)\)$", 2)
    region = region_of(F.col("code"))
    issue = (
        F.when(region.isNull(), "unmapped_code")
        .when(inside == "", "unreadable_name")
        .when(inside != F.col("code"), "code_mismatch")
    )
    return zones.select("*", region.alias("region"), inside.alias("code_in_name"), issue.alias("issue"))


# --- Location of requests ---------------------------------------------------


def by_postcode(communes: DataFrame) -> DataFrame:
    return communes.withColumn("postal_code", F.explode("codes_postaux"))


def largest_of_postcode(communes: DataFrame) -> DataFrame:
    """One commune per postcode: the most populated, unknown population last."""
    order = F.struct(
        F.col("population").isNull().alias("unknown"), (-F.col("population")).alias("size"), "code_insee"
    )
    picked = by_postcode(communes).groupBy("postal_code").agg(F.min_by(F.struct(*_COMMUNE), order).alias("c"))
    return picked.select("postal_code", "c.*")


def nearest_of_postcode(requests: DataFrame, communes: DataFrame) -> DataFrame:
    """Nearest commune of the postcode for requests that bring a point.

    None beyond 30 km: point and postcode then contradict each other.
    """
    distance = geo.distance_m(F.col("lon"), F.col("lat"), F.col("longitude"), F.col("latitude"))
    return (
        requests.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .select("request_id", "postal_code", "lon", "lat")
        .join(by_postcode(communes).select("postal_code", *_COMMUNE), "postal_code")
        .groupBy("request_id")
        .agg(F.min(F.struct(distance.alias("distance"), "code_insee", "nom", "has_dvf")).alias("c"))
        .select("request_id", "c.*")
        .filter(F.col("distance") <= fixed.PLACE_MAX_DISTANCE_M)
    )


def best_named(requests: DataFrame, communes: DataFrame) -> DataFrame:
    """Per distinct postcode and city: the commune whose name is closest.

    Equal names give way to population, then to the code.  Ligatures of the
    searched name are folded too, as the communes' names have none.
    """
    names = requests.select("postal_code", "city").distinct()
    wanted = without_ligatures(unaccent(F.lower(F.trim("city"))))
    score = similarity(F.col("nom_normalise"), wanted)
    order = F.struct(
        (-score).alias("score"), F.col("population").isNull().alias("unknown"),
        (-F.col("population")).alias("size"), "code_insee",
    )
    return (
        names.join(by_postcode(communes).select("postal_code", "nom_normalise", "population", *_COMMUNE), "postal_code")
        .groupBy("postal_code", "city")
        .agg(F.min_by(F.struct(score.alias("score"), *_COMMUNE), order).alias("c"))
        .select("postal_code", "city", "c.*")
    )


def address_key(address: Column, postcode: Column, city: Column) -> Column:
    tidy = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    return F.sha2(F.concat_ws("|", tidy(address), tidy(postcode), tidy(city)), 256)


def precision_class(kind: Column, score: Column) -> Column:
    """How far a looked-up point can be trusted; the score floor comes first."""
    return (
        F.when(score.isNull() | F.isnan(score) | (score < 0.4), "reject")
        .when((kind == "housenumber") & (score >= 0.7), "exact")
        .when(kind.isin("street", "locality"), "approximate")
        .when(score < 0.7, "approximate")
        .otherwise("reject")
    )


def live_addresses(addresses: DataFrame, today: str) -> DataFrame:
    """Stored results still valid and precise enough, one row per key."""
    key = address_key(F.col("address"), F.col("postal_code"), F.col("city"))
    return (
        addresses.filter(F.col("expires_on") > F.lit(today).cast("date"))
        .withColumn("precision", precision_class(F.col("result_type"), F.col("score")))
        .filter(F.col("precision") != "reject")
        .groupBy(key.alias("address_key"))
        .agg(F.max(F.struct("expires_on", "label", "code_insee", "lon", "lat", "precision")).alias("a"))
        .select("address_key", "a.*")
    )


def locate(requests: DataFrame, communes: DataFrame, addresses: DataFrame, today: str) -> DataFrame:
    """Point, precision, commune and coverage of each request.

    Own coordinates if they agree with the postcode, else a stored address,
    else the commune centre, else nothing.  Communes, and what is found, are
    settled: as one plan the search was the driver's largest.
    """
    communes = settle(communes)
    near = nearest_of_postcode(requests, communes).select(
        "request_id", F.struct("code_insee", "nom").alias("near")
    )
    stored = live_addresses(addresses, today).select(
        "address_key", F.struct("label", "code_insee", "lon", "lat", "precision").alias("stored")
    )
    named = best_named(requests, communes).select(
        "postal_code", "city",
        F.struct("code_insee", "nom", F.col("longitude").alias("lon"), F.col("latitude").alias("lat")).alias("named"),
    )
    found = settle(
        requests.withColumn("address_key", address_key(F.col("address"), F.col("postal_code"), F.col("city")))
        .join(near, "request_id", "left")
        .join(stored, "address_key", "left")
        .join(named, ["postal_code", "city"], "left")
    )

    def place(source, label, code, lon, lat, precision):
        return F.struct(
            F.lit(source).alias("source"), label.alias("label"), code.alias("city_code"), lon.alias("lon"),
            lat.alias("lat"), precision.alias("precision"),
        )

    c, text, nothing = F.col, F.concat_ws, F.lit(None)
    centre = F.lit("city-centroid")
    located = F.coalesce(
        F.when(c("near").isNotNull(), place("provided", text(" ", "near.nom", "postal_code"), c("near.code_insee"),
                                            c("lon"), c("lat"), F.lit("approximate"))),
        F.when(c("stored").isNotNull(), place("address", c("stored.label"), c("stored.code_insee"),
                                              c("stored.lon"), c("stored.lat"), c("stored.precision"))),
        F.when(c("named").isNotNull(), place("commune", text(" ", "named.nom", "postal_code"), c("named.code_insee"),
                                             c("named.lon"), c("named.lat"), centre)),
        place("none", text(" ", "city", "postal_code"), nothing.cast("string"), nothing.cast("double"),
              nothing.cast("double"), centre),
    )
    kept = [name for name in requests.columns if name not in ("lon", "lat")]
    spots = found.withColumn("place", located).select(
        *kept, "address_key", c("place.source").alias("loc_source"), c("place.label").alias("loc_label"),
        c("place.city_code").alias("city_code"), c("place.lon").alias("lon"), c("place.lat").alias("lat"),
        c("place.precision").alias("precision"),
    )
    return attach_commune(spots, communes)


def attach_commune(spots: DataFrame, communes: DataFrame) -> DataFrame:
    """The commune by code, else the largest of the postcode; then coverage."""
    fields = ["code_insee", "nom", "code_departement", "code_region", "code_epci", "densite_grille", "has_dvf"]
    by_code = communes.select(F.col("code_insee").alias("city_code"), F.struct(*fields).alias("by_code"))
    by_cp = largest_of_postcode(communes).select("postal_code", F.struct(*fields).alias("by_cp"))
    joined = spots.join(by_code, "city_code", "left").join(by_cp, "postal_code", "left")
    commune = F.coalesce("by_code", "by_cp")
    department = F.coalesce(F.col("commune.code_departement"), department_from_postcode(F.col("postal_code")))
    uncovered = F.coalesce(F.col("code_departement").isin(fixed.DEPARTMENTS_WITHOUT_SALES), F.lit(False))
    return (
        joined.withColumn("commune", commune)
        .select(
            *spots.columns,
            F.coalesce(F.col("commune.code_insee"), F.col("city_code")).alias("code_insee"),
            F.col("commune.nom").alias("commune"), department.alias("code_departement"),
            F.col("commune.code_region").alias("code_region"), F.col("commune.code_epci").alias("code_epci"),
            F.col("commune.densite_grille").alias("densite_grille"), F.col("commune.has_dvf").alias("flag"),
        )
        .withColumn("has_dvf", F.coalesce("flag", ~uncovered))
        .drop("flag")
    )
