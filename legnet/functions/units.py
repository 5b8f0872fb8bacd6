"""Units, calibration and text forms of single values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor of each unit to metres or radians.
UNIT_FACTOR = {
    "metres": 1.0,
    "feet": 0.3048,
    "yards": 0.9144,
    "degs": math.pi / 180,
    "quadrants": math.pi / 180,
    "grads": math.pi / 200,
    "percent": 0.01,
    "minutes": math.pi / 10800,
}


def unit_factor(unit) -> Column:
    """Factor for a unit name, or for a column of unit names (NULL if unknown)."""
    if isinstance(unit, str):
        return F.lit(UNIT_FACTOR[unit])
    pairs = [F.lit(p) for kv in UNIT_FACTOR.items() for p in kv]
    return F.create_map(*pairs)[F.lower(unit)]


def to_metres(value: Column, unit, multiplier=1.0) -> Column:
    return value * unit_factor(unit) * F.lit(multiplier)


def to_radians(value: Column, unit="degs", multiplier=1.0) -> Column:
    return value * unit_factor(unit) * F.lit(multiplier)


def calibrate(value: Column, unit=1.0, zero=0.0, scale=1.0) -> Column:
    """(value * unit - zero) * scale; the zero error is already in base units."""
    return (value * unit - zero) * scale


def count_length(start: Column, end: Column, unit=1.0, scale=1.0) -> Column:
    """Length from a counter instrument: no zero error applies."""
    return (end - start) * unit * scale


def percent_to_gradient(value: Column) -> Column:
    return F.atan(value * 0.01)


def parse_quadrant(text: Column) -> Column:
    """'N30E' or 'S12.5W' or a bare compass point, in degrees; NULL if invalid."""
    t = F.upper(F.trim(text))
    angle = F.regexp_extract(t, r"^[NS](\d+\.?\d*|\.\d+)[EW]$", 1).cast("double")
    north, east = t.startswith("N"), t.endswith("E")
    point = F.create_map(
        *[F.lit(v) for kv in (("N", 0.0), ("E", 90.0), ("S", 180.0), ("W", 270.0)) for v in kv]
    )[t]
    between = (
        F.when(north & east, angle)
        .when(north, 360.0 - angle)
        .when(east, 180.0 - angle)
        .otherwise(180.0 + angle)
    )
    return F.coalesce(point, F.when(angle <= 90.0, between))


def parse_dms(text: Column) -> Column:
    """'12:30:15', '50g', '1600m', '12.5d' or a plain number, in degrees.

    The sign of the first part applies to every part; minutes and seconds only
    follow a whole number of degrees or minutes.
    """
    t = F.lower(F.trim(text))
    shape = r"^([+-]?)(\d+\.?\d*|\.\d+)(?::(\d+\.?\d*))?(?::(\d+\.?\d*))?([dgm]?)$"
    whole = r"^[+-]?\d+(:\d+(:\d+\.?\d*)?|:\d+\.\d*)$"
    part = [F.regexp_extract(t, shape, i) for i in range(1, 6)]
    number = [F.coalesce(p.try_cast("double"), F.lit(0.0)) for p in part[1:4]]
    size = number[0] + number[1] / 60.0 + number[2] / 3600.0
    scaled = (
        F.when(part[4] == "g", size * 0.9)
        .when(part[4] == "m", size * (180.0 / 3200.0))
        .otherwise(size)
    )
    ok = t.rlike(shape) & (~t.contains(":") | (t.rlike(whole)))
    return F.when(ok, F.when(part[0] == "-", -scaled).otherwise(scaled))


def parse_hemisphere(text: Column) -> Column:
    """'N41:16:42' or 'W3.5' in signed degrees (S and W negative)."""
    t = F.upper(F.trim(text))
    size = parse_dms(F.substr(t, F.lit(2)))
    head = F.substring(t, 1, 1)
    return F.when(
        t.rlike(r"^[NSEW][\d.]"), F.when(head.isin("S", "W"), -size).otherwise(size)
    )
