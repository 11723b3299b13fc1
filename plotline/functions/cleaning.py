"""Cleaning rules for the text columns of raw sale lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline import fixed_values as fixed

_NUMBER = r"^-?[0-9]+([.,][0-9]+)?\z"
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"
_HOUSE_NUMBER = r"(?i)^[0-9]+\s*(bis|ter|quater|[a-z])?\s+"
_WORDS = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"


def clean_text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def tolerant_number(c: Column, to: str = "decimal(18,4)") -> Column:
    """A number only if the whole text is one; a decimal comma is accepted."""
    text = F.trim(c)
    return F.when(text.rlike(_NUMBER), F.replace(text, F.lit(","), F.lit(".")).try_cast(to))


def strict_date(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(_ISO_DATE), text.try_cast("date"))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every alphanumeric run, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(_WORDS), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))),
        "",
    )


def street_name(c: Column) -> Column:
    bare = F.regexp_replace(clean_text(c), _HOUSE_NUMBER, "")
    return F.nullif(title_case(bare), F.lit(""))


def built_type(code: Column, label: Column) -> Column:
    """House, flat or commercial unit; the label counts only where the code is blank."""
    code, label = clean_text(code), F.lower(clean_text(label))
    by_code = (
        F.when(code == "1", "maison").when(code == "2", "appartement").when(code == "4", "commercial")
    )
    by_label = (
        F.when(label == "maison", "maison")
        .when(label == "appartement", "appartement")
        .when(label.startswith("local industriel"), "commercial")
    )
    return F.when(code != "", by_code).otherwise(by_label)


def department_or_prefix(department: Column, commune: Column) -> Column:
    return F.coalesce(F.nullif(department, F.lit("")), F.substring(commune, 1, 2))


def plausible_point(lon: Column, lat: Column) -> Column:
    return lon.between(*fixed.LON_RANGE) & lat.between(*fixed.LAT_RANGE)


def price_ceiling(department: Column) -> Column:
    return F.when(
        F.upper(department).isin(fixed.HIGH_PRICE_DEPARTMENTS), fixed.BUILT_PRICE_MAX_HIGH
    ).otherwise(fixed.BUILT_PRICE_MAX)
