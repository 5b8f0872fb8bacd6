"""Classification of legs and stations for distributions and colouring."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the error and length scales, and the hash prime.
MAX_ERROR = 12.0
LOG_LENGTH_MAX = 1.5
HASH_PRIME = 29363


def depth_band(z: Column, zmin, extent, bands: int) -> Column:
    """0-based band of a height; heights outside the range go to the end bands."""
    offset = z - zmin
    inner = F.floor(offset / extent * (bands - 1)).cast("int")
    return F.when(offset <= 0.0, 0).when(offset >= extent, bands - 1).otherwise(inner)


def band_floor(band: Column, zmin, extent, bands: int) -> Column:
    """Height of the lower edge of a band."""
    return extent * band / (bands - 1) + zmin


def date_fraction(days1: Column, days2: Column, first, extent) -> Column:
    """Place of the mid date in the range of dates; NULL when undated."""
    middle = days1 + ((days2 - days1) / 2).cast("int")
    offset = middle - first
    return F.when(days1.isNull() | (days1 == -1), None).otherwise(
        F.when(offset == 0, 0.0).otherwise(offset / extent)
    )


def error_fraction(error: Column) -> Column:
    return F.when(error >= 0.0, F.least(error / MAX_ERROR, F.lit(1.0)))


def gradient_fraction(d: Column) -> Column:
    flat = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])
    return F.abs(F.atan2(d["z"], flat)) / (math.pi / 2)


def length_fraction(length: Column) -> Column:
    share = F.log10(length) / LOG_LENGTH_MAX
    return F.when(length <= 0.0, 0.0).otherwise(
        F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    )


def survey_hash(name: Column) -> Column:
    """32-bit polynomial hash of the UTF-8 bytes, from the last to the first."""
    data = F.hex(F.encode(name, "UTF-8"))
    size = F.length(data) / 2
    codes = F.transform(
        F.sequence(size.cast("int"), F.lit(1), F.lit(-1)),
        lambda i: F.conv(F.substring(data, 2 * i - 1, F.lit(2)), 16, 10).cast("long"),
    )
    return F.when(name == "", F.lit(0).cast("long")).otherwise(
        F.aggregate(
            codes,
            F.lit(0).cast("long"),
            lambda acc, c: (acc * HASH_PRIME + c) % (1 << 32),
        )
    )
