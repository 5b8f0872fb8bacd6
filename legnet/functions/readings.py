"""Instrument readings: repeats, backsights, bearings, slopes and flags."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from legnet.schema import LEG_DUPLICATE, LEG_SPLAY, LEG_SURFACE, STN_ANON, STN_WALL

EPSILON = 1e-6


def mean_reading(readings: Column) -> Column:
    """Mean of a repeated reading; NULL when there is none."""
    n = F.size(readings)
    total = F.aggregate(readings, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 0, total / n)


def repeat_variance(variance, readings: Column) -> Column:
    """Variance of a repeated reading: divided by the root of the count."""
    n = F.size(readings)
    return F.when(n > 0, F.lit(variance) / F.sqrt(n))


def norm_bearing(angle: Column) -> Column:
    """Bearing in [0, 2pi]; out-of-range values wrap, a full turn stays."""
    turn = 2 * math.pi
    outside = (angle < 0.0) | (angle - turn > EPSILON)
    return F.when(outside, angle - F.floor(angle / turn) * turn).otherwise(angle)


def bearing_suspicious(angle: Column) -> Column:
    return (angle < 0.0) | (angle - 2 * math.pi > EPSILON)


def classify_clino(token: Column, unit=math.pi / 180, infer_plumbs=False) -> Column:
    """struct(ctype, value): what a slope token means and its value in radians.

    ctype is READING, PLUMB, INFERPLUMB, HORIZ or OMIT; NULL for bad text.
    """
    t = F.upper(F.trim(F.coalesce(token, F.lit("-"))))
    number = t.try_cast("double") * unit
    up, down = t.isin("U", "UP", "+V"), t.isin("D", "DOWN", "-V")
    level, omitted = t.isin("H", "LEVEL"), t.isin("-", "")
    inferred = (F.abs(F.abs(number) - math.pi / 2) <= EPSILON) & F.lit(infer_plumbs)
    ctype = (
        F.when(up | down, "PLUMB")
        .when(level, "HORIZ")
        .when(omitted, "OMIT")
        .when(inferred, "INFERPLUMB")
        .when(number.isNotNull(), "READING")
    )
    value = (
        F.when(up, math.pi / 2)
        .when(down, -math.pi / 2)
        .when(level | omitted, 0.0)
        .otherwise(number)
    )
    return F.struct(ctype.alias("ctype"), value.alias("value"))


def slope_number(value: Column, infer_plumbs=False) -> Column:
    """struct(ctype, value) of a slope given as a number of radians or NULL."""
    ctype = F.when(value.isNull(), "OMIT")
    if infer_plumbs:
        ctype = ctype.when(F.abs(F.abs(value) - math.pi / 2) <= EPSILON, "INFERPLUMB")
    return F.struct(
        ctype.otherwise("READING").alias("ctype"),
        F.coalesce(value, F.lit(0.0)).alias("value"),
    )


def _weighted(a, va, b, vb) -> Column:
    # The combined variance below is used as the weight scale on purpose.
    return (a / va + b / vb) * ((va + vb) / 4.0)


def _combined(fore, vf, back, vb, both, differ) -> Column:
    has_f, has_b = fore.isNotNull(), back.isNotNull()
    value = F.when(has_f & has_b, both).otherwise(F.coalesce(fore, back))
    var = F.when(has_f & has_b, (vf + vb) / 4.0).when(has_f, vf).when(has_b, vb)
    bad = has_f & has_b & (differ * differ / 9.0 > vf + vb)
    return F.struct(
        value.alias("value"),
        var.alias("var"),
        F.coalesce(bad, F.lit(False)).alias("disagree"),
    )


def combine_tape(fore, vf, back, vb) -> Column:
    """struct(value, var, disagree) of calibrated fore and back lengths."""
    return _combined(fore, vf, back, vb, _weighted(fore, vf, back, vb), fore - back)


def combine_compass(fore, vf, back, vb, declination=0.0) -> Column:
    """struct(value, var, disagree); back bearings are turned round first."""
    f = fore + declination
    b = back + declination - math.pi
    gap = f - b
    turn = F.when(F.abs(gap) > math.pi, math.pi).otherwise(0.0)
    wrapped = gap - F.floor((gap + math.pi) / (2 * math.pi)) * (2 * math.pi)
    return _combined(f, vf, b, vb, _weighted(f, vf, b, vb) + turn, wrapped)


def combine_clino(fore, vf, back, vb) -> Column:
    """struct(value, var, disagree); the back slope has the opposite sign."""
    return _combined(fore, vf, -back, vb, _weighted(fore, vf, -back, vb), fore + back)


def swap_direction(direction: Column, from_stn: Column, to_stn: Column) -> Column:
    """struct(from_stn, to_stn) with a leg read backwards turned round."""
    back = F.upper(F.coalesce(direction, F.lit("F"))).startswith("B")
    return F.struct(
        F.when(back, to_stn).otherwise(from_stn).alias("from_stn"),
        F.when(back, from_stn).otherwise(to_stn).alias("to_stn"),
    )


# Names that stand for unnamed stations.
SPLAY_NAMES = (".", "..", "-")
WALL_NAMES = ("..", "-")
ANON_NAMES = (".", "..", "-", "...")


def is_anon_name(name: Column) -> Column:
    return name.isin(*ANON_NAMES)


def splay_flag(from_stn: Column, to_stn: Column) -> Column:
    """Leg flag bit implied by an unnamed end."""
    hit = from_stn.isin(*SPLAY_NAMES) | to_stn.isin(*SPLAY_NAMES)
    return F.when(hit, LEG_SPLAY).otherwise(0)


def anon_station_flags(name: Column) -> Column:
    """Station flag bits implied by an unnamed end."""
    return F.when(name.isin(*WALL_NAMES), STN_ANON | STN_WALL).when(
        is_anon_name(name), STN_ANON
    ).otherwise(0)


def map_shot_flags(letters: Column) -> Column:
    """struct(flags, excluded, fixed_var) from shot flag letters L, P, S, X, C."""
    t = F.coalesce(letters, F.lit(""))

    def bit(letter, value):
        return F.when(t.contains(letter), value).otherwise(0)

    return F.struct(
        bit("L", LEG_DUPLICATE)
        .bitwiseOR(bit("P", LEG_SURFACE))
        .bitwiseOR(bit("S", LEG_SPLAY))
        .alias("flags"),
        t.contains("X").alias("excluded"),
        F.when(t.contains("C"), 1e-6).alias("fixed_var"),
    )
