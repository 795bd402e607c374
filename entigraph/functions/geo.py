"""Geographic predicates over struct columns with ``lat`` and ``lon`` in degrees; distances in kilometres."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def distance(point: Column, lat: float, lon: float) -> Column:
    """Great-circle distance by the haversine formula."""
    a_lat, b_lat = F.radians(point["lat"]), F.radians(F.lit(float(lat)))
    d_lat, d_lon = b_lat - a_lat, F.radians(F.lit(float(lon))) - F.radians(point["lon"])
    h = F.pow(F.sin(d_lat / 2), F.lit(2.0)) + F.cos(a_lat) * F.cos(b_lat) * F.pow(F.sin(d_lon / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def within_box(point: Column, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """Inclusive on all sides; boxes don't wrap at the antimeridian."""
    return point["lat"].between(float(min_lat), float(max_lat)) & point["lon"].between(float(min_lon), float(max_lon))


def within_radius(point: Column, lat: float, lon: float, km: float) -> Column:
    """A latitude band first, which a scan can use, then the exact distance."""
    band = math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9
    return point["lat"].between(lat - band, lat + band) & (distance(point, lat, lon) <= float(km))


def within_polygon(point: Column, vertices: tuple[tuple[float, float], ...]) -> Column:
    """Ray casting; the polygon closes itself, fewer than three vertices hold nothing."""
    if len(vertices) < 3:
        return F.lit(False)
    lats, lons = [v[0] for v in vertices], [v[1] for v in vertices]
    lat, lon = point["lat"], point["lon"]
    crossings = []
    for (a_lat, a_lon), (b_lat, b_lon) in zip(vertices, [*vertices[1:], vertices[0]]):
        if a_lat == b_lat:
            continue
        spans = (F.lit(float(a_lat)) > lat) != (F.lit(float(b_lat)) > lat)
        at = (F.lit(float(b_lon)) - F.lit(float(a_lon))) * (lat - F.lit(float(a_lat))) / F.lit(float(b_lat - a_lat)) + F.lit(float(a_lon))
        crossings.append((spans & (lon < at)).cast("int"))
    inside = functools.reduce(operator.add, crossings) % 2 == 1 if crossings else F.lit(False)
    return within_box(point, min(lats), min(lons), max(lats), max(lons)) & inside
