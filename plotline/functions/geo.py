"""Distances and grid cells as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RAD = 0.017453292519943295
_A = 6378137.0
_E2 = 0.00669437999014
_MEAN_RADIUS = 6371008.8
_FAR_M = 50_000.0

#: Metres per degree, never above the true length anywhere in the plausible
#: box (latitude -22 to 52), so a cell is never narrower than the radius.
_M_PER_DEG_LAT = 110_000.0
_M_PER_DEG_LON = 68_000.0


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on WGS84, to the millimetre.

    Local radii of curvature at mid-latitude up to 50 km, the great circle
    beyond, where the figure is only a weight.
    """
    mid = (lat1 + lat2) / 2.0 * F.lit(_RAD)
    s = F.sin(mid)
    w = F.lit(1.0) - F.lit(_E2) * s * s
    north_radius = F.lit(_A * (1.0 - _E2)) / (w * F.sqrt(w))
    east_radius = F.lit(_A) / F.sqrt(w)
    dx = east_radius * F.cos(mid) * ((lon2 - lon1) * F.lit(_RAD))
    dy = north_radius * ((lat2 - lat1) * F.lit(_RAD))
    near = F.sqrt(dx * dx + dy * dy)
    half_lat = F.sin((lat2 - lat1) * F.lit(_RAD) / 2.0)
    half_lon = F.sin((lon2 - lon1) * F.lit(_RAD) / 2.0)
    chord = half_lat * half_lat + F.cos(lat1 * F.lit(_RAD)) * F.cos(lat2 * F.lit(_RAD)) * half_lon * half_lon
    far = F.lit(2.0 * _MEAN_RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))
    return F.round(F.when(near > _FAR_M, far).otherwise(near), 3)


def distance_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """The same formula as SQL text, for checks on another engine."""
    mid = f"(({lat1} + {lat2}) / 2.0 * {_RAD})"
    w = f"(1.0 - {_E2}::DOUBLE * sin({mid}) * sin({mid}))"
    dx = f"({_A}::DOUBLE / sqrt({w}) * cos({mid}) * (({lon2} - {lon1}) * {_RAD}))"
    dy = f"({_A * (1.0 - _E2)!r}::DOUBLE / ({w} * sqrt({w})) * (({lat2} - {lat1}) * {_RAD}))"
    near = f"sqrt({dx} * {dx} + {dy} * {dy})"
    hlat = f"sin(({lat2} - {lat1}) * {_RAD} / 2.0)"
    hlon = f"sin(({lon2} - {lon1}) * {_RAD} / 2.0)"
    chord = f"({hlat} * {hlat} + cos({lat1} * {_RAD}) * cos({lat2} * {_RAD}) * {hlon} * {hlon})"
    far = f"({2.0 * _MEAN_RADIUS!r} * asin(least(1.0, sqrt({chord}))))"
    return f"round(CASE WHEN {near} > {_FAR_M} THEN {far} ELSE {near} END, 3)"


def cell(coordinate: Column, radius_m: float, per_degree: float) -> Column:
    return F.floor(coordinate / F.lit(radius_m / per_degree)).cast("int")


def cell_x(lon: Column, radius_m: float) -> Column:
    return cell(lon, radius_m, _M_PER_DEG_LON)


def cell_y(lat: Column, radius_m: float) -> Column:
    return cell(lat, radius_m, _M_PER_DEG_LAT)


def reach_x(radius_m: float) -> float:
    """Degrees of longitude that no distance of ``radius_m`` exceeds in the plausible box."""
    return radius_m / _M_PER_DEG_LON


def reach_y(radius_m: float) -> float:
    return radius_m / _M_PER_DEG_LAT


def neighbours(index: Column) -> Column:
    return F.sequence(index - 1, index + 1)
