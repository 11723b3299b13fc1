"""Secrets in texts: three fixed patterns, and random-looking strings by Markov likelihood ratio.

All work on rows is done by SQL expressions.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, the group that holds the secret, and the shortest secret.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# Runs of one class are greedy, so a run that is too short can be left out by the pattern itself.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A string is a run of alphabet characters that is at least so long.
CANDIDATE_LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LEAST},}}"
WORD = r"[A-Za-z0-9+/_=-]{5,}"


@dataclass(frozen=True)
class Model:
    """Log ratio, random against ordinary, for each first and next character (0: start)."""

    ratios: tuple[float, ...]
    least: float

    def column(self) -> Column:
        return F.from_json(F.lit(json.dumps([round(r, 6) for r in self.ratios])), "array<double>")


def _pairs(strings: Column) -> Column:
    """Start and every next pair of characters of all strings, as first * (n + 1) + next."""
    width = len(ALPHABET) + 1
    return F.flatten(F.transform(strings, lambda s: _codes(s, width)))


def _codes(string: Column, width: int) -> Column:
    places = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(places, F.lit(1), F.size(places) - 1)), places, lambda a, b: a * width + b)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 1000, smoothing: float = 0.5, odds: float = 1e-6) -> Model:
    """Learn both chains from the labelled strings of at most ``sample`` texts.

    The sample is the texts with the smallest hash of their key.  Labels come
    from the fixed patterns: what they find is random, the other words are
    ordinary.  Half of the random chain stays uniform, as keys may use letters
    that the sample's keys lack.  ``odds`` are those of a secret before its
    characters are seen.
    """
    width = len(ALPHABET) + 1
    # Bounded by the sample size.
    chosen = docs.select(F.col(key).alias("_key")).distinct().orderBy(F.xxhash64("_key"), "_key").limit(sample)
    body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_key")
    found = F.concat(*[_matches(F.col("_text"), kind)[1] for kind in KINDS])
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    labelled = body.select(F.explode(F.array(
        F.struct(F.lit(True).alias("random"), found.alias("strings")),
        F.struct(F.lit(False).alias("random"), F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)).alias("strings")),
    )).alias("x")).select("x.*")
    counts = labelled.select("random", F.explode(_pairs(F.col("strings"))).alias("pair")).groupBy("random", "pair").count()
    tables = {True: [0.0] * width**2, False: [0.0] * width**2}
    for random, pair, n in counts.collect():  # at most two square tables of the alphabet
        tables[random][pair] = float(n)
    ratios = []
    for first in range(width):
        totals = {label: sum(t[first * width : first * width + width]) for label, t in tables.items()}
        for after in range(width):
            p = {label: (t[first * width + after] + smoothing) / (totals[label] + smoothing * (width - 1)) for label, t in tables.items()}
            ratios.append(math.log(0.5 * p[True] + 0.5 / (width - 1)) - math.log(p[False]))
    return Model(tuple(ratios), -math.log(odds))


def _matches(body: Column, kind: str) -> tuple[Column, Column, str]:
    """Whole matches, the secrets in them, and the pattern."""
    if kind == "assign":
        return F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(0)), F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)), ASSIGN
    pattern = {"access": ACCESS, "hex": HEX, "random": CANDIDATE}[kind]
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    return found, found, pattern


def _spans(body: Column, kind: str) -> Column:
    """All matches with their bounds in code points.

    What lies between matches is split off by the same pattern; running sums of
    the lengths give the bounds.
    """
    found, secrets, pattern = _matches(body, kind)
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,secret:string>>)")
    steps = F.arrays_zip(found.alias("found"), secrets.alias("secret"), F.transform(F.split(body, pattern, -1), lambda g: F.length(g)).alias("gap"))
    # The last gap has no match behind it.
    steps = F.slice(steps, F.lit(1), F.size(found))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")),
        lambda s, m: F.struct(
            (s["at"] + m["gap"] + F.length(m["found"])).alias("at"),
            F.concat(s["spans"], F.array(F.struct((s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + F.length(m["found"])).alias("end"), m["secret"].alias("secret")))).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def _score(string: Column, ratios: Column) -> Column:
    """Log-likelihood ratio of a whole string."""
    return F.aggregate(_codes(string, len(ALPHABET) + 1), F.lit(0.0), lambda total, code: total + F.element_at(ratios, (code + 1).cast("int")))


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with an array ``secrets`` of all spans in each whole text.

    A span has its start and end (code points, end exclusive), kind (assign,
    access, hex, random) and place of the kind in that list; spans are sorted by
    start, then place.  Matches of the fixed patterns always stay, also where
    they overlap; a random string is added only where no fixed match lies.
    Null and empty texts have none; a column of that name is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs
    names = []
    for kind in (*KINDS, "random"):
        name = f"_{kind}_spans"
        while name in docs.columns:
            name += "_"
        names.append(name)
        base = base.withColumn(name, _spans(body, kind))

    def named(spans: Column, place: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    sure = F.concat(
        named(F.filter(F.col(names[0]), lambda s: F.length(s["secret"]) >= ASSIGN_LEAST), 0, "assign"),
        named(F.col(names[1]), 1, "access"), named(F.col(names[2]), 2, "hex"),
    )
    ratios = model.column()
    added = F.filter(F.col(names[3]), lambda s: ~F.exists(F.col("_sure_spans"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    added = F.filter(added, lambda s: _score(s["secret"], ratios) >= model.least)
    base = base.withColumn("_sure_spans", sure)
    return base.withColumn("secrets", F.array_sort(F.concat("_sure_spans", named(added, 3, "random")))).drop(*names, "_sure_spans")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str = "text", secrets: str = "secrets", mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones joined, replaced by ``mask``."""
    body = F.coalesce(F.col(text), F.lit(""))
    walked = F.aggregate(
        F.col(secrets),
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("parts")),
        lambda s, m: F.struct(
            F.greatest(s["at"], m["end"]).alias("at"),
            F.when((m["start"] < s["at"]) & (s["at"] > 0), s["parts"]).otherwise(
                F.concat(s["parts"], F.array(body.substr((s["at"] + 1).cast("int"), (m["start"] - s["at"]).cast("int")), F.lit(mask)))
            ).alias("parts"),
        ),
        lambda s: F.concat(F.array_join(s["parts"], ""), body.substr((s["at"] + 1).cast("int"), F.length(body))),
    )
    return F.when(F.size(secrets) > 0, walked).otherwise(F.col(text))
