"""Acquisition, lead and page rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.functions.numbers import bind, half_up_decimals


def _short(c: Column) -> Column:
    return F.nullif(F.substring(F.trim(c), 1, fixed.CAMPAIGN_VALUE_MAX), F.lit(""))


def _address(text: Column) -> Column:
    """Host (small letters), path and query of a web address, by one tolerant pattern."""
    part = lambda n: F.regexp_extract(text, fixed.WEB_ADDRESS, n)
    return F.struct(F.lower(part(1)).alias("host"), part(2).alias("path"), part(3).alias("query"))


def acquisition(href: Column, referrer: Column, site_host: str) -> Column:
    """Campaign parameters, landing path and outside referrer; null if nothing is known."""
    names = [*fixed.CAMPAIGN_PARAMETERS.values(), "referrer", "landingPage"]

    def fields(query: Column) -> list[Column]:
        value = lambda name: F.regexp_extract(query, f"(?:^|&){name}=([^&]*)", 1)
        return [_short(F.coalesce(F.try_url_decode(value(p)), value(p))).alias(n) for p, n in fixed.CAMPAIGN_PARAMETERS.items()]

    def block(page: Column, origin: Column) -> Column:
        landing = F.when(page["host"] != "", _short(F.when(page["path"] == "", "/").otherwise(page["path"]))).alias("landingPage")
        outside = F.when(origin["host"] != site_host, _short(origin["host"])).alias("referrer")
        return F.struct(*fields(page["query"]), outside, landing)

    anything = lambda b: reduce(lambda x, y: x | y, [b[n].isNotNull() for n in names])
    # bound, so that each address is split once and not once per later use of a field
    found = bind(F.struct(_address(href).alias("page"), _address(referrer).alias("origin")), lambda a: block(a["page"], a["origin"]))
    return bind(found, lambda b: F.when(anything(b), b))


def campaign_touch(block: Column) -> Column:
    """Whether a visit carries an identified campaign."""
    return F.coalesce(
        block["gclid"].isNotNull() | block["source"].isNotNull() | block["campaign"].isNotNull()
        | block["campaignId"].isNotNull(),
        F.lit(False),
    )


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for row in table.items() for x in row]), key)


def channel(block: Column) -> Column:
    """The first of: paid click, source, medium, any other source, referring host, nothing."""
    source = F.nullif(F.lower(block["source"]), F.lit(""))
    medium = F.nullif(F.lower(block["medium"]), F.lit(""))
    host = block["referrer"]
    behind = lambda label, detail: F.concat(label, F.coalesce(F.concat(F.lit(" ("), detail, F.lit(")")), F.lit("")))
    labels = {k: label for k, (label, _) in fixed.CHANNEL_OF_MEDIUM.items()}
    named = {k: with_source for k, (_, with_source) in fixed.CHANNEL_OF_MEDIUM.items()}
    of_host = F.when(host.rlike(fixed.SEARCH_ENGINES), fixed.CHANNEL_OF_SEARCH).otherwise(fixed.CHANNEL_OF_SITE)
    return F.coalesce(
        F.when(block["gclid"].isNotNull(), fixed.CHANNEL_OF_CLICK),
        _looked_up(fixed.CHANNEL_OF_SOURCE, source),
        behind(_looked_up(labels, medium), F.when(_looked_up(named, medium), source)),
        behind(source, medium),
        F.when(host.isNotNull(), behind(of_host, host)),
        F.lit(fixed.CHANNEL_OF_NOTHING),
    )


def surface_bucket(surface: Column) -> Column:
    chain = F.when(surface.isNull() | F.isnan(surface) | (surface <= 0), "")
    for top, label in fixed.SURFACE_BUCKETS:
        chain = chain.when(surface <= top, label)
    return chain.otherwise(fixed.SURFACE_BUCKET_TOP)


def _said(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def lead_quality(is_owner: Column, want_to_sell: Column) -> Column:
    sell = _said(want_to_sell)
    return F.when(
        _said(is_owner) == "yes", F.when(sell == "yes", "hot").when(sell == "maybe", "warm").otherwise("cold")
    ).otherwise("cold")


def lead_value(is_owner: Column, want_to_sell: Column, price: Column) -> Column:
    willing = F.coalesce(_looked_up(fixed.LEAD_SELL_FACTORS, _said(want_to_sell)), F.lit(fixed.LEAD_SELL_FACTORS["no"]))
    quality = F.when(_said(is_owner) == "yes", willing).otherwise(fixed.LEAD_NOT_OWNER_FACTOR)
    size = F.when(price > 0, F.least(F.lit(fixed.LEAD_PRICE_FACTOR_MAX), price / fixed.LEAD_PRICE_UNIT)).otherwise(1.0)
    return half_up_decimals(fixed.LEAD_BASE_VALUE * quality * size, 2)


def contact_value(subject: Column) -> Column:
    return F.when(_said(subject) == "partenariat", fixed.PARTNER_VALUE).otherwise(fixed.CONTACT_VALUE)


def page_type(path: Column) -> Column:
    """By the first segment of the path, and whether there are more."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")
    root = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    alone, below = ({k: v[i] for k, v in fixed.PAGE_TYPES.items()} for i in (0, 1))
    found = F.when(F.size(parts) > 1, _looked_up(below, root)).otherwise(_looked_up(alone, root))
    return F.coalesce(found, F.lit(fixed.PAGE_TYPE_ELSE))


def clean_parameters(parameters: Column) -> Column:
    """Map of event parameters without empty values and personal keys."""
    return F.map_filter(
        parameters,
        lambda k, v: v.isNotNull() & (v != "") & ~F.lower(k).isin(fixed.FORBIDDEN_EVENT_KEYS),
    )


def clean_user_data(hashes: Column) -> Column:
    """Only values that look like a SHA-256; null when none is left."""
    kept = F.map_filter(hashes, lambda k, v: F.coalesce(v.rlike(r"^[0-9a-f]{64}\z"), F.lit(False)))
    return F.when(F.size(kept) > 0, kept)
