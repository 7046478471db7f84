"""Distances, boxes and grid cells."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
EARTH_RADIUS_MILES = 3958.8
METERS_TO_MILES = 0.000621371
# ----------------------------------------------------------------------------------
MILES_PER_DEGREE = EARTH_RADIUS_MILES * math.pi / 180


def miles_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, NULL when a coordinate is missing.

    ``least`` keeps rounding from leaving the domain of asin, but passes over NULLs.
    """
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


Box = tuple[float, float, list[tuple[float, float]]]


def box(lat: float, lon: float, miles: float) -> Box:
    """(min_lat, max_lat, longitude ranges) that hold a circle around one point, as plain numbers.

    The reach in longitude is asin(sin(r) / cos(lat)); a circle over a pole takes all, one over the antimeridian two
    ranges.  A hair is added against rounding.
    """
    angle = miles / EARTH_RADIUS_MILES
    reach = math.degrees(angle) + 1e-9
    ratio = math.sin(angle) / max(math.cos(math.radians(lat)), 1e-12)
    if abs(lat) + reach >= 90 or ratio >= 1:
        return lat - reach, lat + reach, [(-180.0, 180.0)]
    wide = math.degrees(math.asin(ratio)) + 1e-9
    low, high = lon - wide, lon + wide
    ranges = [(low, high)]
    if low < -180:
        ranges = [(-180.0, high), (low + 360, 180.0)]
    elif high > 180:
        ranges = [(low, 180.0), (-180.0, high - 360)]
    return lat - reach, lat + reach, ranges


def in_box(lat: Column, lon: Column, bounds: Box) -> Column:
    """Comparisons with constants, so that they reach the Parquet scan."""
    low_lat, high_lat, ranges = bounds
    return lat.between(low_lat, high_lat) & reduce(or_, [lon.between(low, high) for low, high in ranges])


def cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / F.lit(size)).cast("long")


def lat_span(lat: Column, miles: Column | float, size: float) -> Column:
    """Latitude cells that a circle touches."""
    reach = (miles if isinstance(miles, Column) else F.lit(float(miles))) / F.lit(MILES_PER_DEGREE) + F.lit(1e-9)
    return F.sequence(cell(lat - reach, size), cell(lat + reach, size))


def lon_span(lat: Column, lon: Column, miles: Column | float, size: float) -> Column:
    """Longitude cells that a circle touches, wrapped at the antimeridian.

    The exact reach is asin(sin(r) / cos(lat)); a circle that covers a pole touches all.
    """
    m = miles if isinstance(miles, Column) else F.lit(float(miles))
    angle = m / F.lit(EARTH_RADIUS_MILES)
    ratio = F.sin(angle) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    polar = (F.abs(lat) + F.degrees(angle) >= 90) | (ratio >= 1)
    reach = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0))))) + F.lit(1e-9)
    cells = round(360.0 / size)
    low = F.lit(int(math.floor(-180.0 / size)))
    raw = F.when(polar, F.sequence(low, low + (cells - 1))).otherwise(F.sequence(cell(lon - reach, size), cell(lon + reach, size)))
    return F.array_distinct(F.transform(raw, lambda x: F.pmod(x - low, F.lit(cells)) + low))


def lon_cell(lon: Column, size: float) -> Column:
    cells = round(360.0 / size)
    low = int(math.floor(-180.0 / size))
    return F.pmod(cell(lon, size) - F.lit(low), F.lit(cells)) + F.lit(low)


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def distance_text(metres: Column) -> Column:
    """'850 m' below a kilometre, '1.2 km' from there on."""
    return F.when(metres < 1000, F.concat(F.format_string("%.0f", metres), F.lit(" m"))).when(
        metres >= 1000, F.concat(F.format_string("%.1f", metres / 1000), F.lit(" km"))
    )
