"""Sessions, conversions, quotas and lead facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.functions import events as ev
from plotline.functions import privacy
from plotline.functions.numbers import half_up
from plotline.operators.places import department_with_corsica


def session_attribution(hits: DataFrame, site_host: str) -> DataFrame:
    """Last identified campaign of each session, else its first known touch."""
    block = ev.acquisition(F.col("href"), F.col("referrer"), site_host)
    # null blocks lose by their null order: a filter on the block would parse each address once more
    touches = hits.select("session_id", "ts", "event_id", block.alias("block"))
    order = F.when(F.col("block").isNotNull(), F.struct("ts", "event_id"))
    picked = touches.groupBy("session_id").agg(
        F.max_by(F.col("block"), F.when(ev.campaign_touch(F.col("block")), order)).alias("campaign_block"),
        F.min_by(F.col("block"), order).alias("first_block"),
    ).filter(F.col("first_block").isNotNull())
    chosen = F.coalesce("campaign_block", "first_block")
    return picked.select("session_id", chosen.alias("block"), ev.channel(chosen).alias("channel"))


def one_conversion(leads: DataFrame, *order: str) -> DataFrame:
    """The first row of each lead id; rows without one convert nothing."""
    named = leads.filter(F.coalesce(F.col("lead_id"), F.lit("")) != "")
    rest = [c for c in leads.columns if c != "lead_id"]
    first = named.groupBy("lead_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select("lead_id", "r.*")


def without_bots(leads: DataFrame) -> DataFrame:
    return leads.filter(F.trim(F.coalesce(F.col("website"), F.lit(""))) == "")


def flat_leads(leads: DataFrame) -> DataFrame:
    """One wide row per lead with its derived facts and hashed contacts."""
    price = F.when(F.col("estimation_mid") > 0, half_up(F.col("estimation_mid")))
    return leads.select(
        "lead_id", "kind", "status", "property_type", "surface", "postal_code", "is_owner", "want_to_sell",
        price.alias("estimation_value"),
        ev.lead_quality(F.col("is_owner"), F.col("want_to_sell")).alias("lead_quality"),
        F.when(F.col("kind") == "contact", ev.contact_value(F.col("subject")).cast("double"))
        .otherwise(ev.lead_value(F.col("is_owner"), F.col("want_to_sell"), price)).alias("lead_value"),
        ev.surface_bucket(F.col("surface")).alias("surface_bucket"),
        department_with_corsica(F.col("postal_code")).alias("department"),
        privacy.contact_hash(privacy.plain_email(F.col("email"))).alias("email_hash"),
        privacy.contact_hash(privacy.international_phone(F.col("phone"))).alias("phone_hash"),
    )


def contact_export(contacts: DataFrame) -> DataFrame:
    """Columns of the contact file; line breaks in messages become blanks."""
    return contacts.select(
        F.col("lead_row").alias("ID"), F.col("name").alias("Nom"), F.col("email").alias("Email"),
        F.coalesce("phone", F.lit("N/A")).alias("Téléphone"), F.col("subject").alias("Sujet"),
        F.regexp_replace("message", "\n", " ").alias("Message"),
    )


def write_contacts(contacts: DataFrame, path: str) -> None:
    kept = contact_export(contacts).write.mode("overwrite").option("sep", ";").option("header", True)
    kept.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


# --- Quotas -----------------------------------------------------------------


def quota_table(spark: SparkSession) -> DataFrame:
    """Allowances parsed from their written form, one row per scope."""
    rows = spark.createDataFrame(fixed.QUOTAS, "scope string, allowance string")
    return parse_allowances(rows)


def parse_allowances(rows: DataFrame) -> DataFrame:
    pattern = r"^(\d+)\s*/\s*(.+)$"
    text = F.trim("allowance")
    requests = F.regexp_extract(text, pattern, 1).try_cast("int")
    return rows.select(
        "scope", requests.alias("requests"), F.trim(F.regexp_extract(text, pattern, 2)).alias("duration")
    ).filter(F.col("requests") > 0)


def quota_breaches(requests: DataFrame, scope: str, limit: int, duration: str) -> DataFrame:
    """Clients over their allowance, per tumbling window.  Batch or stream."""
    return (
        requests.groupBy(F.window("ts", duration).alias("w"), "client")
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .select(F.lit(scope).alias("scope"), "client", F.col("w.start").alias("window_start"), "requests")
    )


def allowance_breaches(requests: DataFrame, allowances: DataFrame) -> DataFrame:
    """Clients over the allowance of each scope, per tumbling window of its length.

    ``requests``: scope, client, ts; ``allowances``: scope, requests, duration
    (a whole number of seconds to days).  The windows of all lengths are counted
    in one pass.
    """
    unit = F.create_map(*[F.lit(x) for row in fixed.DURATION_SECONDS.items() for x in row])
    parts = F.split(F.trim("duration"), r"\s+")
    length = F.element_at(parts, 1).try_cast("long") * F.try_element_at(unit, F.rtrim(F.element_at(parts, -1), F.lit("s")))
    limits = allowances.select("scope", F.col("requests").alias("allowed"), "duration", length.alias("seconds")).where("seconds > 0")
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / F.col("seconds")) * F.col("seconds"))
    return (
        requests.join(limits, "scope")
        .groupBy("scope", "duration", "allowed", "client", start.alias("window_start"))
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > F.col("allowed"))
    )


def scraping_days(
    requests: DataFrame, floor: int = fixed.SCRAPING_REQUESTS_PER_DAY, clients: int = fixed.SCRAPING_MAX_CLIENTS
) -> DataFrame:
    """Days with very many requests from very few clients.

    Counted per day and client first, so a busy day is spread over tasks.
    """
    per_client = requests.groupBy(F.to_date("ts").alias("day"), "client").agg(F.count("*").alias("n"))
    return (
        per_client.groupBy("day")
        .agg(F.sum("n").alias("requests"), F.count("*").alias("clients"))
        .filter((F.col("requests") > floor) & (F.col("clients") < clients))
    )


# --- Validation -------------------------------------------------------------


def _errors(*checks: tuple[Column, str, str]) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))
                for bad, field, rule in checks
            ]
        )
    )


def _outside(name: str, low: float, high: float) -> Column:
    return ~F.col(name).between(low, high)


def _not_in(name: str, allowed: list[str]) -> Column:
    return ~F.col(name).isin(allowed)


def _text_outside(name: str, low: int, high: int) -> Column:
    return ~F.length(F.trim(F.coalesce(F.col(name), F.lit("")))).between(low, high)


def request_errors() -> Column:
    """Broken rules of a valuation request."""
    land = F.col("property_type") == "terrain"
    return _errors(
        (_text_outside("address", 3, 200), "address", "length"),
        (~F.trim(F.coalesce(F.col("postal_code"), F.lit(""))).rlike(r"^\d{5}\z"), "postalCode", "regex"),
        (_text_outside("city", 1, 100), "city", "length"),
        (F.col("property_type").isNull() | _not_in("property_type", fixed.PROPERTY_TYPES), "propertyType", "enum"),
        (F.col("surface").isNull() | _outside("surface", 1, 100_000), "surface", "bounds"),
        (F.when(land, _outside("surface", 1, 100_000)).otherwise(_outside("surface", 9, 1_000)), "surface", "range"),
        (_outside("rooms", 1, 30), "rooms", "range"),
        (F.coalesce(~land, F.lit(True)) & F.col("rooms").isNull(), "rooms", "required"),
        (F.col("dpe").isNull() | _not_in("dpe", fixed.DPE_CLASSES), "dpe", "enum"),
        (_outside("floor", 0, 50), "floor", "range"),
        (_not_in("outdoor", fixed.OUTDOOR_KINDS), "outdoor", "enum"),
        (_not_in("condition", fixed.CONDITIONS), "condition", "enum"),
        (_outside("terrain_size", 0, 100_000), "terrainSize", "range"),
        (_outside("lat", *fixed.LAT_RANGE), "lat", "range"),
        (_outside("lon", *fixed.LON_RANGE), "lon", "range"),
    )


def lead_errors() -> Column:
    email = F.trim(F.coalesce(F.col("email"), F.lit("")))
    message = F.coalesce(F.trim("message"), F.lit(""))
    return _errors(
        (_not_in("kind", ["estimation", "contact"]), "kind", "enum"),
        (_text_outside("name", 2, 100), "name", "length"),
        (~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z") | (F.length(email) > 180), "email", "email"),
        (~F.trim("phone").rlike(fixed.PHONE_PATTERN), "phone", "regex"),
        (F.length(F.trim("subject")) > 120, "subject", "length"),
        (F.length(message) > fixed.MESSAGE_MAX_LENGTH, "message", "length"),
        ((F.col("kind") == "estimation") & F.col("property_type").isNull(), "property", "required"),
        ((F.col("kind") == "contact") & (message == ""), "message", "required"),
    )


def visible_fields(requests: DataFrame) -> DataFrame:
    """Blank the fields a form would not have shown for the property type."""
    kind = F.col("property_type")
    flat, built = kind == "appartement", kind.isin("appartement", "maison")
    keep = lambda name, cond: F.when(cond, F.col(name))
    return requests.withColumns(
        {
            "floor": keep("floor", flat),
            "has_elevator": keep("has_elevator", flat),
            "outdoor": keep("outdoor", built),
            "condition": keep("condition", built),
            "terrain_size": keep("terrain_size", (kind == "maison") & (F.col("has_terrain") == "yes")),
        }
    )


def coerced_requests(forms: DataFrame) -> DataFrame:
    """Typed request fields from the text a form sends."""
    # the number a text begins with; what follows it does not matter
    number = lambda name: F.regexp_extract(F.replace(name, F.lit(","), F.lit(".")), fixed.LEADING_NUMBER, 1).try_cast("double")
    whole = lambda name: F.when(number(name) == F.floor(number(name)), number(name).cast("int"))
    listed = lambda name, allowed: F.when(F.col(name).isin(allowed), F.col(name))
    return forms.withColumns(
        {
            "surface": number("surface"),
            "rooms": whole("rooms"),
            "floor": F.when(whole("floor") >= 0, whole("floor")),
            "has_elevator": F.when(F.col("has_elevator") == "yes", True).when(F.col("has_elevator") == "no", False),
            "dpe": F.coalesce(listed("dpe", fixed.DPE_CLASSES), F.lit("unknown")),
            "property_type": listed("property_type", fixed.PROPERTY_TYPES),
            "outdoor": listed("outdoor", fixed.OUTDOOR_KINDS),
            "condition": listed("condition", fixed.CONDITIONS),
        }
    )


def unexpected_columns(df: DataFrame, allowed: list[str], personal: list[str] = (), prefix: str = "") -> list[tuple[str, str]]:
    """Columns outside an allow-list; personal data is named as such.

    Reads the schema only.
    """
    return [
        (prefix + name, "forbidden_pii" if name.lower() in personal else "unknown_field")
        for name in df.columns
        if name not in allowed
    ]


def unexpected_fields(df: DataFrame, layout: dict[str, list[str]], personal: list[str] = ()) -> list[tuple[str, str]]:
    """Columns and struct fields outside the layout, by their dotted names.

    ``layout`` lists the fields allowed at the top ("") and in each struct.
    Reads the schema only.
    """
    found = unexpected_columns(df, layout[""], personal)
    for field in df.schema.fields:
        if field.name in layout and hasattr(field.dataType, "fields"):
            found += unexpected_columns(df.select(f"{field.name}.*"), layout[field.name], personal, f"{field.name}.")
    return found
