"""Names, slugs and trigram similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline import fixed_values as fixed


def unaccent(c: Column) -> Column:
    return F.translate(c, fixed.ACCENTED, fixed.UNACCENTED)


def without_ligatures(c: Column) -> Column:
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), fixed.LIGATURES.items(), c)


def plain_name(c: Column) -> Column:
    return F.trim(F.lower(unaccent(c)))


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def trigrams(c: Column) -> Column:
    """Set of three-letter grams; each word gets two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i.cast("int"), F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    left, right = trigrams(a), trigrams(b)
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(union > 0, shared / union).otherwise(0.0)
