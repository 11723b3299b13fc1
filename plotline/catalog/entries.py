"""The registry: key -> Spark query, key -> check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from plotline.sources import sample_market as market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Named sub-queries shared by the check SQL, in order of dependence.
PARTS: dict[str, str] = {
    "sale_lines": market.as_sql(market.SALE_LINES),
    "commune_rows": market.as_sql(market.COMMUNES),
    "request_rows": market.as_sql(market.REQUESTS),
    "address_rows": market.as_sql(market.ADDRESSES),
    "hit_rows": market.as_sql(market.HITS),
    "lead_rows": market.as_sql(market.LEADS),
}


def part(name: str, text: str) -> None:
    PARTS[name] = text


def sql(body: str) -> str:
    """Prefix ``body`` with the sub-queries it needs."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(PARTS[name])

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in PARTS if name in needed)
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


def query(key: str, check: str | None = None):
    """Register a query, and its check when SQL can state the result."""

    def register(fn):
        QUERIES[key] = fn
        if check is not None:
            ORACLES[key] = sql(check)
        return fn

    return register


_settled: dict[tuple, DataFrame] = {}


def shared(name: str, spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A settled intermediate that several registered queries read."""
    key = (name, spark.sparkContext.applicationId, folder)
    if key not in _settled:
        _settled[key] = build()
    return _settled[key]


def forget_shared() -> None:
    """Drop settled intermediates, so that a timing starts from the tables."""
    _settled.clear()


@lru_cache(maxsize=1)
def _load() -> None:
    from plotline.catalog import (  # noqa: F401
        backtest,
        calibration,
        comparables,
        leads,
        maintenance,
        places,
        quality,
        sales,
        second_wave,
        valuation,
        written,
    )


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
