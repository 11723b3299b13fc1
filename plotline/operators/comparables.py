"""Comparable sales for a whole table of properties.

Twenty-three attempts are ordered from near and recent to far and old; a
property takes the first attempt that keeps enough sales after cleaning.  The
job runs in three stages, each on the properties the previous one left open:

1. attempts 1-2 (500 m and 1 km, 24 months), one grid join at 1 km;
2. attempts 3-18, one grid join at 5 km, plus the two commune attempts;
3. attempts 19-23, by inter-commune body, commune, department, region, country.

Radius joins meet on grid cells and surface bins, all pairs of a search in one
task, so pairs are ranked where they are made and never shuffled.  Attempts are
judged by counts over narrow arrays; the sales of a search's one accepted
attempt get their other columns at the end.  Administrative attempts never pair
a property with every sale of its area: the area's histogram by surface tells
how far from the wanted surface the 200 closest sales reach, and only those are
read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.functions import geo
from plotline.operators.samples import kept_count, within_bounds
from plotline.session import settle


@dataclass(frozen=True)
class Attempt:
    number: int
    level: str
    radius: int | None
    months: int
    minimum: int
    wide: bool
    flagged: bool

    @property
    def scope(self) -> str:
        return f"{self.level}{self.months}"

    @property
    def guarded(self) -> bool:
        return (self.radius or 0) >= fixed.GUARD_FROM_RADIUS


def attempt_plan() -> list[Attempt]:
    """The ordered attempts; only the replayed block carries the widened flag."""
    block = [("radius", r, w, n) for w in fixed.RADIUS_WINDOWS for r, n in fixed.RADIUS_LEVELS]
    level, months, minimum = fixed.COMMUNE_LEVEL
    block.append((level, None, months, minimum))
    rows = [(*b, False, False) for b in block] + [(*b, True, True) for b in block]
    rows += [(level, None, months, n, True, False) for level, months, n in fixed.WIDER_LEVELS]
    return [Attempt(i + 1, *row) for i, row in enumerate(rows)]


PLAN = attempt_plan()


def per_type(values: dict[str, Column], kind: str = "property_type") -> Column:
    return reduce(
        lambda chain, item: chain.when(F.col(kind) == item[0], item[1]),
        list(values.items())[1:],
        F.when(F.col(kind) == next(iter(values)), next(iter(values.values()))),
    )


def tolerance(wide: Column) -> Column:
    """Surface tolerance as a ratio, by property type."""
    return per_type(
        {
            kind: F.when(wide, F.lit(wider / 100)).otherwise(F.lit(base / 100))
            for kind, (base, wider, _) in fixed.SEARCH_PROFILES.items()
        }
    )


def surface_band(surface: Column, ratio: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), surface * (1 - ratio)), surface * (1 + ratio)


def required_count(minimum: Column) -> Column:
    return per_type(
        {
            kind: F.greatest(F.lit(fixed.MIN_SAMPLE), F.ceil(minimum / divisor).cast("int"))
            for kind, (_, _, divisor) in fixed.SEARCH_PROFILES.items()
        }
    )


def window_start(reference_date: str, months: int) -> Column:
    return F.add_months(F.lit(reference_date).cast("date"), -months)


def plan_table() -> Column:
    """The plan as an array literal, to explode next to a search."""
    return F.array(
        *[
            F.struct(
                F.lit(a.number).alias("attempt_no"), F.lit(a.level).alias("level"),
                F.lit(a.radius).cast("int").alias("radius_m"), F.lit(a.months).alias("window_months"),
                F.lit(a.minimum).alias("minimum"), F.lit(a.wide).alias("wide"), F.lit(a.flagged).alias("widened"),
            )
            for a in PLAN
        ]
    )


def searchable_sales(built: DataFrame, land: DataFrame, communes: DataFrame, medians: DataFrame) -> DataFrame:
    """Usable sales of both tables with their commune's areas and median price."""

    def usable(sales: DataFrame, surface: str) -> DataFrame:
        return sales.filter(~F.col("is_outlier") & F.col("prix_m2").isNotNull()).select(
            F.col("id_mutation").alias("sale_id"), "type_local", F.col(surface).alias("surface"), "surface_terrain",
            "date_mutation", F.col("prix_m2").cast("double").alias("price"),
            F.col("valeur_fonciere").cast("double").alias("value"), F.col("nb_pieces").alias("rooms"),
            F.col("adresse_voie").alias("street"), "code_insee", "code_departement", "longitude", "latitude",
            "geoloc_fine",
        )

    areas = communes.select(
        "code_insee", F.col("nom").alias("city"), "code_epci", "code_region", "densite_grille"
    )
    return (
        usable(built, "surface_bati")
        .unionByName(usable(land, "surface_terrain"))
        .join(areas, "code_insee", "left")
        .join(medians, ["code_insee", "type_local"], "left")
    )


def with_reference_median(searches: DataFrame, medians: DataFrame) -> DataFrame:
    """Median of the searched commune, for the market guard; in a replay that of the day looked back from."""
    day = [c for c in ("as_of",) if c in medians.columns]
    own = medians.select("code_insee", F.col("type_local").alias("property_type"), *day, F.col("med").alias("ref_med"))
    return searches.join(own, ["code_insee", "property_type", *day], "left")


def _pick() -> Column:
    """What ranks and judges a sale; the rest of it is joined to the one sample that is used."""
    return F.struct(F.col("rank").cast("int").alias("rank"), "sale_id", F.col("distance").cast("double").alias("distance"), "price", "fine")


def _dated(searches: DataFrame, reference_date: str) -> DataFrame:
    """Searches with the day they look back from; ``as_of`` is that of a replay."""
    return searches if "as_of" in searches.columns else searches.withColumn("as_of", F.lit(reference_date).cast("date"))


def _known(searches: DataFrame) -> Column:
    """Of a replay, only sales before the day it looks back from."""
    return F.col("date_mutation") < F.col("as_of") if "as_of" in searches.columns else F.lit(True)


# --- Radius attempts --------------------------------------------------------

_STEP = 1.2  # width of the surface bins on which pairs meet


def _size_bin(surface: Column) -> Column:
    return F.floor(F.log(F.greatest(surface.cast("double"), F.lit(1.0))) / F.log(F.lit(_STEP))).cast("int")


def radius_pairs(searches: DataFrame, sales: DataFrame, radius_m: float, since: Column) -> DataFrame:
    """Pairs of a search and a fitting sale at most ``radius_m`` away.

    They meet on type, grid cell and surface bin, so a search sees no sale far
    from its size, and even a dense city is many keys.  The distance is exploded
    from an array of one, or Spark would compute it in the filter once more, in
    a method too long for the JVM to compile.
    """
    low, high = surface_band(F.col("surface"), tolerance(F.lit(True)))
    extra = [c for c in ("as_of",) if c in searches.columns]
    seekers = searches.select(
        "search_id", "property_type", "surface", "ref_med", *extra,
        F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat"), low.alias("low"), high.alias("high"),
        F.explode(geo.neighbours(geo.cell_x(F.col("lon"), radius_m))).alias("cell_x"),
        geo.cell_y(F.col("lat"), radius_m).alias("row"),
    )
    seekers = seekers.select("*", F.explode(geo.neighbours(F.col("row"))).alias("cell_y")).drop("row")
    seekers = seekers.withColumn("size_bin", F.explode(F.sequence(_size_bin(F.col("low")), _size_bin(F.col("high")))))
    offers = sales.filter(F.col("geoloc_fine") & (F.col("date_mutation") >= since)).select(
        "sale_id", F.col("type_local").alias("property_type"), F.col("surface").alias("sale_surface"), "date_mutation", "price", "value", "longitude", "latitude",
        *[c for c in ("med", "meds") if c in sales.columns],
        geo.cell_x(F.col("longitude"), radius_m).alias("cell_x"), geo.cell_y(F.col("latitude"), radius_m).alias("cell_y"), _size_bin(F.col("surface")).alias("size_bin"),
    )
    distance = geo.distance_m(F.col("at_lon"), F.col("at_lat"), F.col("longitude"), F.col("latitude"))
    return (
        seekers.join(offers, ["property_type", "cell_x", "cell_y", "size_bin"])
        .filter(F.col("sale_surface").between(F.col("low"), F.col("high")))
        .withColumn("distance", F.explode(F.array(distance)))
        .filter(F.col("distance") <= radius_m)
    )


#: Width of the surface bins of searches that are ranked in one task, and how many searches of a key share a task.
_HOME_STEP, _TASK_SEARCHES = 1.5, 4096
_HOME = ["property_type", "cell_x", "cell_y", "size_bin"]


def _home_bin(surface: Column) -> Column:
    return F.floor(F.log(F.greatest(surface.cast("double"), F.lit(1.0))) / F.log(F.lit(_HOME_STEP))).cast("int")


def _home_pairs(searches: DataFrame, sales: DataFrame, radius_m: float, since: Column) -> tuple[DataFrame, list[str]]:
    """As ``radius_pairs``, with the pairs of a search in one task; also the columns that name its task.

    A search has one cell (twice as wide as the radius) and one surface bin; a
    sale is copied to the cells and bins where it may fit.  Keys with very many
    searches are cut into parts.  The columns are empty if a search id stands
    at several places, as its sales then rank together.
    """
    low, high = surface_band(F.col("surface"), tolerance(F.lit(True)))
    extra = [c for c in ("as_of",) if c in searches.columns]
    cell_x, cell_y = (lambda lon: geo.cell_x(lon, 2 * radius_m)), (lambda lat: geo.cell_y(lat, 2 * radius_m))
    seekers = searches.select(
        "search_id", "property_type", "surface", "ref_med", *extra,
        F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat"), low.alias("low"), high.alias("high"),
        cell_x(F.col("lon")).alias("cell_x"), cell_y(F.col("lat")).alias("cell_y"), _home_bin(F.col("surface")).alias("size_bin"),
    ).dropna(subset=_HOME)
    home = F.struct(*_HOME[1:])
    scattered = seekers.groupBy("search_id", "property_type").agg(F.min(home).alias("a"), F.max(home).alias("b")).where("a <> b")
    loads = settle(
        seekers.groupBy(*_HOME).agg(F.ceil(F.count("*") / _TASK_SEARCHES).cast("int").alias("parts")).where("parts > 1")
    )
    seekers = seekers.join(loads, _HOME, "left").withColumn("part", F.pmod(F.xxhash64("search_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    # A little wider than the radius and the band, as cells and bins are cut from rounded numbers.
    reach_x, reach_y = geo.reach_x(1.001 * radius_m), geo.reach_y(1.001 * radius_m)
    ratio, surface = tolerance(F.lit(True)), F.col("sale_surface").cast("double")
    offers = sales.filter(F.col("geoloc_fine") & (F.col("date_mutation") >= since)).select(
        "sale_id", F.col("type_local").alias("property_type"), F.col("surface").alias("sale_surface"), "date_mutation", "price", "value", "longitude", "latitude",
        *[c for c in ("med", "meds") if c in sales.columns],
    )
    offers = offers.withColumn("fine", within_bounds(F.col("price"), F.col("sale_surface"), F.col("value"))).drop("value")
    offers = offers.withColumn("cell_x", F.explode(F.sequence(cell_x(F.col("longitude") - reach_x), cell_x(F.col("longitude") + reach_x))))
    offers = offers.withColumn("cell_y", F.explode(F.sequence(cell_y(F.col("latitude") - reach_y), cell_y(F.col("latitude") + reach_y))))
    offers = offers.withColumn("size_bin", F.explode(F.sequence(_home_bin(surface / (1.0001 + ratio)), _home_bin(surface / (0.9999 - ratio)))))
    offers = offers.join(loads, _HOME, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    close = (F.abs(F.col("latitude") - F.col("at_lat")) <= reach_y) & (F.abs(F.col("longitude") - F.col("at_lon")) <= reach_x)
    distance = geo.distance_m(F.col("at_lon"), F.col("at_lat"), F.col("longitude"), F.col("latitude"))
    pairs = (
        seekers.hint("merge").join(offers, [*_HOME, "part"])
        .filter(F.col("sale_surface").between(F.col("low"), F.col("high")) & close)
        .withColumn("distance", F.explode(F.array(distance)))
        .filter(F.col("distance") <= radius_m)
    )
    return pairs, [*_HOME[1:], "part"] if scattered.isEmpty() else []


def _rankings(attempts: list[Attempt]) -> list[list[Attempt]]:
    """Attempts that differ only by radius share one ranking: nearest within 5 km implies nearest within 500 m."""
    classes: dict[tuple, list[Attempt]] = {}
    for a in attempts:
        classes.setdefault((a.months, a.wide, a.guarded), []).append(a)
    return list(classes.values())


def radius_ranked(searches: DataFrame, sales: DataFrame, attempts: list[Attempt], reference_date: str) -> tuple[DataFrame, list[str]]:
    """The 200 nearest fitting sales of each search for each ranking of the attempts, one row each, and what names a group of them."""
    reach, longest = max(a.radius for a in attempts), max(a.months for a in attempts)
    known = _known(searches)
    earliest = F.lit(reference_date).cast("date") if "as_of" not in searches.columns else searches.agg(F.min("as_of")).scalar()
    searches = _dated(searches, reference_date)
    pairs, home = _home_pairs(searches, sales, reach, F.add_months(earliest, -longest))
    pairs = pairs.where(known)
    med = F.try_element_at("meds", F.col("as_of")) if "meds" in sales.columns else F.col("med")
    guard = F.coalesce(F.abs(med - F.col("ref_med")) <= fixed.GUARD_TOLERANCE * F.col("ref_med"), F.lit(True))
    base_low, base_high = surface_band(F.col("surface"), tolerance(F.lit(False)))
    fits = []
    for number, group in enumerate(_rankings(attempts)):
        fit = (F.col("date_mutation") >= F.add_months("as_of", -group[0].months)) & (F.col("distance") <= max(a.radius for a in group))
        if not group[0].wide:
            fit &= F.col("sale_surface").between(base_low, base_high)
        if group[0].guarded:
            fit &= guard
        fits.append(F.when(fit, F.lit(number)))
    group = ["search_id", "ranking", "property_type", *home]
    nearest = Window.partitionBy(*group).orderBy("distance", "sale_id")
    ranked = (
        pairs.select(
            *[c for c in group if c != "ranking"], "sale_id", "price", "fine", "distance",
            F.explode(F.array_compact(F.array(*fits))).alias("ranking"),
        )
        .withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= fixed.FETCH_LIMIT)
    )
    return ranked, group


def radius_near(searches: DataFrame, sales: DataFrame, attempts: list[Attempt], reference_date: str) -> DataFrame:
    """search_id, property_type, ranking, near: the 200 nearest fitting sales for each ranking of the attempts."""
    ranked, group = radius_ranked(searches, sales, attempts, reference_date)
    return ranked.groupBy(*group).agg(F.sort_array(F.collect_list(_pick())).alias("near")).select("search_id", "property_type", "ranking", "near")


def _per_ranking(attempts: list[Attempt], body) -> Column:
    """For each row's ranking, an array of what ``body`` makes of its attempts."""
    return reduce(
        lambda chain, m: chain.when(F.col("ranking") == m[0], m[1]),
        [(n, F.array(*[body(a) for a in group])) for n, group in enumerate(_rankings(attempts))][1:],
        F.when(F.col("ranking") == 0, F.array(*[body(a) for a in _rankings(attempts)[0]])),
    )


def _within(radius: Column | float) -> Column:
    return F.filter("near", lambda x: x["distance"] <= radius)


def radius_samples(searches: DataFrame, sales: DataFrame, attempts: list[Attempt], reference_date: str) -> DataFrame:
    """search_id, property_type, attempt_no, x: the 200 nearest fitting sales of each search, for each attempt."""
    asked = _per_ranking(attempts, lambda a: F.when(F.col("distance") <= float(a.radius), F.lit(a.number)))
    ranked, _ = radius_ranked(searches, sales, attempts, reference_date)
    return ranked.select("search_id", "property_type", F.explode(F.array_compact(asked)).alias("attempt_no"), _pick().alias("x"))


def _radius_outcomes(searches: DataFrame, sales: DataFrame, attempts: list[Attempt], reference_date: str):
    """Counts of each attempt, and what gives the sales of chosen ones."""
    near = settle(radius_near(searches, sales, attempts, reference_date))
    counted = lambda a: F.struct(
        F.lit(a.number).alias("attempt_no"), F.size(_within(float(a.radius))).alias("fetched"), kept_count(_within(float(a.radius))).alias("kept"))
    counts = near.select("search_id", "property_type", F.explode(_per_ranking(attempts, counted)).alias("a")).select("search_id", "property_type", "a.*")
    place = [(a.number, n, float(a.radius)) for n, group in enumerate(_rankings(attempts)) for a in group]

    def picks(first: DataFrame) -> DataFrame:
        of = lambda i: F.create_map(*[F.lit(x) for row in place for x in (row[0], row[i])])[F.col("attempt_no")]
        first = first.where(F.col("attempt_no").isin([row[0] for row in place])).withColumns({"ranking": of(1), "radius": of(2)})
        return first.join(near, ["search_id", "ranking"]).select("search_id", "attempt_no", _within(F.col("radius")).alias("picks"))

    return counts.filter(F.col("fetched") > 0), picks


# --- Administrative attempts ------------------------------------------------

_SCOPES = {"commune": "code_insee", "epci": "code_epci", "departement": "code_departement", "region": "code_region"}
_BIN = 100.0  # surface bins of about one per cent


def _surface_bin(surface: Column) -> Column:
    return F.floor(F.log(F.greatest(surface.cast("double"), F.lit(1.0))) * _BIN).cast("int")


def _search_scope(level: str) -> Column:
    if level == "national":
        stratum = F.concat(F.lit("stratum "), F.col("densite_grille"))
        return F.coalesce(stratum, F.lit("everywhere"))
    return F.col(_SCOPES[level])


def _sale_scopes(level: str) -> list[Column]:
    if level == "national":
        return [F.concat(F.lit("stratum "), F.col("densite_grille")), F.lit("everywhere")]
    return [F.col(_SCOPES[level])]


def area_requests(searches: DataFrame, sales: DataFrame, attempts: list[Attempt], reference_date: str) -> tuple[DataFrame, DataFrame]:
    """What each search asks for, and the sample of each different request.

    Searches of one area, type, surface and tolerance share a request: the 200
    sales closest in surface, newest first.
    """
    replay = "as_of" in searches.columns
    area = ["scope", "area", "property_type", *(["as_of"] if replay else [])]
    asked = searches.select(
        "search_id", "property_type", "surface", *(["as_of"] if replay else []),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(a.number).alias("attempt_no"), F.lit(a.scope).alias("scope"),
                        _search_scope(a.level).alias("area"), tolerance(F.lit(a.wide)).alias("ratio"),
                    )
                    for a in attempts
                ]
            )
        ).alias("a"),
    ).select("search_id", "surface", *area[2:], "a.*")
    asked = asked.filter(F.col("area").isNotNull())
    low, high = surface_band(F.col("surface"), F.col("ratio"))
    wanted = (
        asked.select(*area, "surface", "ratio").distinct().withColumn("low", low).withColumn("high", high)
    )

    scopes = {(a.scope, a.level, a.months) for a in attempts}
    days = F.lit(reference_date).cast("date")
    if replay:  # the days that searches look back from are few, and each has a market of its own
        sales = sales.withColumn("as_of", F.explode(searches.agg(F.collect_set("as_of")).scalar())).where(F.col("date_mutation") < F.col("as_of"))
        days = F.col("as_of")
    memberships = F.array(
        *[
            F.when(
                F.col("date_mutation") >= F.add_months(days, -months),
                F.struct(F.lit(scope).alias("scope"), where.alias("area")),
            )
            for scope, level, months in sorted(scopes)
            for where in _sale_scopes(level)
        ]
    )
    # No request can use more than the 200 newest sales of one exact surface.
    newest = Window.partitionBy(*area, "sale_surface").orderBy(F.col("date_mutation").desc(), "sale_id")
    offers = settle(
        sales.withColumn("m", F.explode(F.array_compact(memberships)))
        .select(
            "m.scope", "m.area", F.col("type_local").alias("property_type"), *area[3:], "sale_id",
            F.col("surface").alias("sale_surface"), "date_mutation", "price", "value",
        )
        .withColumn("fine", within_bounds(F.col("price"), F.col("sale_surface"), F.col("value")))
        .drop("value")
        .filter(F.col("area").isNotNull())
        .join(wanted.select(*area).distinct(), area, "left_semi")
        .withColumn("n", F.row_number().over(newest))
        .filter(F.col("n") <= fixed.FETCH_LIMIT)
        .drop("n")
        .withColumn("bin", _surface_bin(F.col("sale_surface")))
    )
    # One row for each area, so that a request meets one row and not one for each bin it may reach.
    histogram = (
        offers.groupBy(*area, "bin")
        .agg(F.count("*").alias("n"), F.min("sale_surface").alias("smallest"), F.max("sale_surface").alias("largest"))
        .groupBy(*area).agg(F.collect_list(F.struct("bin", "n", "smallest", "largest")).alias("bins"))
    )
    surface = F.col("surface")
    lowest, highest = _surface_bin(F.col("low")) - 1, _surface_bin(F.col("high")) + 1

    def touched(b: Column) -> Column:
        return b["bin"].between(lowest, highest) & (b["largest"] >= F.col("low")) & (b["smallest"] <= F.col("high"))

    def entry(b: Column) -> Column:
        smallest, largest = b["smallest"], b["largest"]
        return F.struct(
            F.greatest(F.abs(smallest - surface), F.abs(largest - surface)).alias("far"),
            F.when((smallest >= F.col("low")) & (largest <= F.col("high")), b["n"]).otherwise(0).alias("n"),
            F.greatest(F.lit(0.0), smallest - surface, surface - largest).alias("near"),
            b["bin"].alias("bin"),
        )

    request = [*area, "surface", "ratio"]
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("reach"))

    def grow(acc, e):
        total = acc["n"] + e["n"]
        return F.struct(
            total.alias("n"),
            F.coalesce(acc["reach"], F.when(total >= fixed.FETCH_LIMIT, e["far"])).alias("reach"),
        )

    reached = (
        wanted.join(histogram, area)
        .withColumn("bins", F.sort_array(F.transform(F.filter("bins", touched), entry)))
        .withColumn("reach", F.coalesce(F.aggregate("bins", start, grow)["reach"], F.lit(float("inf"))))
        .withColumn("b", F.explode(F.filter("bins", lambda e: e["near"] <= F.col("reach"))))
        .select(*request, "low", "high", "reach", F.col("b.bin").alias("bin"))
    )
    gap = F.abs(F.col("sale_surface") - F.col("surface"))
    closest = Window.partitionBy(*request).orderBy(gap, F.col("date_mutation").desc(), "sale_id")
    samples = (
        reached.join(offers, [*area, "bin"])
        .filter(F.col("sale_surface").between(F.col("low"), F.col("high")) & (gap <= F.col("reach")))
        .withColumn("rank", F.row_number().over(closest))
        .filter(F.col("rank") <= fixed.FETCH_LIMIT)
        .withColumn("distance", F.lit(None))
        .groupBy(*request)
        .agg(F.sort_array(F.collect_list(_pick())).alias("near"))
    )
    return asked, samples


def area_samples(searches: DataFrame, sales: DataFrame, attempts: list[Attempt], reference_date: str) -> DataFrame:
    """search_id, property_type, attempt_no, x: the 200 sales closest in surface, newest first, in each search's area, with their distance.

    The sales of a request are placed once, however many searches share it.
    """
    asked, samples = area_requests(searches, sales, attempts, reference_date)
    request = [c for c in samples.columns if c != "near"]
    spots = sales.select("sale_id", F.col("type_local").alias("property_type"), "longitude", "latitude")
    placed = (
        samples.select(*request, F.explode("near").alias("x")).select(*request, "x.rank", "x.sale_id")
        .join(spots, ["sale_id", "property_type"])
        .groupBy(*request).agg(F.collect_list(F.struct("rank", "sale_id", "longitude", "latitude")).alias("near"))
    )
    rows = (
        asked.join(_standing(searches), ["search_id", "property_type"]).join(placed, request)
        .select("search_id", "property_type", "attempt_no", "at_lon", "at_lat", F.explode("near").alias("x"))
    )
    distance = geo.distance_m(F.col("at_lon"), F.col("at_lat"), F.col("x.longitude"), F.col("x.latitude"))
    return rows.select("search_id", "property_type", "attempt_no", F.struct("x.rank", "x.sale_id", distance.alias("distance")).alias("x"))


def _area_outcomes(searches: DataFrame, sales: DataFrame, attempts: list[Attempt], reference_date: str):
    """As ``_radius_outcomes``; a request is counted once, however many searches share it."""
    asked, samples = area_requests(searches, sales, attempts, reference_date)
    samples = settle(samples)
    request = [c for c in samples.columns if c != "near"]
    counted = samples.select(*request, F.size("near").alias("fetched"), kept_count(F.col("near")).alias("kept"))
    counts = asked.join(counted, request).select("search_id", "property_type", "attempt_no", "fetched", "kept")

    def picks(first: DataFrame) -> DataFrame:
        return asked.join(first, ["search_id", "attempt_no"]).join(samples, request).select("search_id", "attempt_no", F.col("near").alias("picks"))

    return counts, picks


# --- The cascade ------------------------------------------------------------


def _stage(searches: DataFrame, *parts) -> tuple[DataFrame, DataFrame]:
    """Counts of a stage's attempts with the sales of each search's first accepted one, and the searches left open."""
    minimums = F.create_map(*[F.lit(x) for a in PLAN for x in (a.number, a.minimum)])
    counts = reduce(DataFrame.unionByName, [counts for counts, _ in parts])
    counts = counts.withColumn("required", required_count(minimums[F.col("attempt_no")])).withColumn("accepted", F.col("kept") >= F.col("required"))
    counts = settle(counts.drop("property_type"))
    first = settle(first_accepted(counts).withColumnRenamed("accepted_no", "attempt_no"))
    picks = reduce(DataFrame.unionByName, [picks(first) for _, picks in parts])
    outcomes = settle(counts.join(picks, ["search_id", "attempt_no"], "left"))
    return outcomes, settle(searches.join(first, "search_id", "left_anti"))


def find_comparables(searches: DataFrame, sales: DataFrame, reference_date: str) -> DataFrame:
    """Outcome of every attempt that returned sales, per search.

    ``searches``: search_id, lon, lat, code_insee, code_epci, code_departement,
    code_region, densite_grille, property_type, surface, ref_med; in a replay
    also ``as_of``, the day a search looks back from.  ``sales``: see
    ``searchable_sales``; in a replay with ``meds``, the commune's median by
    day.  Attempts are counted first; ``picks`` holds the sales of the first
    accepted one alone.  Attempts after a settled stage are not run.
    """
    sales, open_ = settle(sales), settle(searches)
    stages = []
    radius = [a for a in PLAN if a.level == "radius"]
    areas = [a for a in PLAN if a.level != "radius"]
    for near, wide in (
        ([a for a in radius if a.number <= 2], []),
        ([a for a in radius if a.number > 2], [a for a in areas if a.number < 19]),
        ([], [a for a in areas if a.number >= 19]),
    ):
        parts = [_radius_outcomes(open_, sales, near, reference_date)] if near else []
        parts += [_area_outcomes(open_, sales, wide, reference_date)] if wide else []
        outcomes, open_ = _stage(open_, *parts)
        stages.append(outcomes)
    return reduce(DataFrame.unionByName, stages)


def first_accepted(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.filter("accepted").groupBy("search_id").agg(F.min("attempt_no").alias("accepted_no"))
    )


def _standing(searches: DataFrame) -> DataFrame:
    return searches.select("search_id", "property_type", F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat"))


def with_sales(picked: DataFrame, sales: DataFrame) -> DataFrame:
    """Picked sales (property_type, at_lon, at_lat, x and more) with the rest of their columns and their distance."""
    whole = sales.select(
        "sale_id", F.col("type_local").alias("property_type"), F.col("surface").cast("double").alias("surface"), F.col("surface_terrain").cast("double").alias("land"),
        F.col("date_mutation").alias("date"), "price", "value", "rooms", "street", "city", "longitude", "latitude",
    )
    rows = picked.select(*[c for c in picked.columns if c != "x"], "x.rank", "x.sale_id", F.col("x.distance").alias("near"))
    rows = rows.join(whole, ["sale_id", "property_type"])
    distance = geo.distance_m(F.col("at_lon"), F.col("at_lat"), F.col("longitude"), F.col("latitude"))
    return rows.withColumn("distance", F.coalesce("near", distance)).drop("near", "at_lon", "at_lat")


def chosen_samples(searches: DataFrame, outcomes: DataFrame, sales: DataFrame) -> DataFrame:
    """The sample of the first accepted attempt, with the attempt's settings.

    Only here do the picked sales get the rest of their columns.  Rows come
    dealt by ``search_id``, so a join on it does not shuffle the samples again.
    """
    standing = searches.select("search_id", "property_type").join(_standing(searches), ["search_id", "property_type"])
    picked = outcomes.filter(F.col("picks").isNotNull()).select("search_id", "attempt_no", "picks").join(standing, "search_id")
    picked = picked.select("search_id", "attempt_no", "property_type", "at_lon", "at_lat", F.explode("picks").alias("x"))
    sale = F.struct("rank", "sale_id", "surface", "land", "date", "price", "value", "rooms", "street", "city", "longitude", "latitude", "distance")
    rows = with_sales(picked, sales).repartition("search_id")
    sampled = rows.groupBy("search_id", "attempt_no", "property_type").agg(F.sort_array(F.collect_list(sale)).alias("sample"))
    settings = F.filter(plan_table(), lambda a: a["attempt_no"] == F.col("attempt_no"))[0]
    return sampled.withColumn("a", settings).select(
        "search_id", "attempt_no", "a.level", "a.radius_m", "a.window_months",
        F.round(tolerance(F.col("a.wide")) * 100).cast("int").alias("tolerance_pct"), "a.widened", "sample",
    )


def attempt_trace(searches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every attempt made for a search, up to and including the accepted one."""
    made = (
        searches.select("search_id", "property_type", F.explode(plan_table()).alias("a"))
        .select("search_id", "property_type", "a.*")
        .join(first_accepted(outcomes), "search_id", "left")
        .filter(F.col("attempt_no") <= F.coalesce("accepted_no", F.lit(len(PLAN))))
    )
    seen = outcomes.select("search_id", "attempt_no", "fetched", "kept")
    kept = F.coalesce("kept", F.lit(0))
    return made.join(seen, ["search_id", "attempt_no"], "left").select(
        "search_id", "attempt_no", "level", "radius_m", "window_months",
        F.round(tolerance(F.col("wide")) * 100).cast("int").alias("tolerance_pct"),
        F.coalesce("fetched", F.lit(0)).alias("fetched"), kept.alias("kept"),
        required_count(F.col("minimum")).alias("required"),
        (kept >= required_count(F.col("minimum"))).alias("accepted"),
    )


def not_found(searches: DataFrame, outcomes: DataFrame) -> DataFrame:
    return searches.join(first_accepted(outcomes), "search_id", "left_anti")
