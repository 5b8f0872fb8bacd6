"""Table contracts and fixed values of the survey data model."""

from __future__ import annotations

import math

from pyspark.sql import types as T

# Bit masks of leg flags and station flags.
LEG_SURFACE, LEG_DUPLICATE, LEG_SPLAY = 1, 2, 4
STN_SURFACE, STN_UNDERGROUND, STN_ENTRANCE = 1, 2, 4
STN_EXPORTED, STN_FIXED, STN_ANON, STN_WALL = 8, 16, 32, 64
LEG_EXCLUDED_FROM_TOTALS = LEG_SURFACE | LEG_DUPLICATE | LEG_SPLAY

STYLES = ("NORMAL", "DIVING", "CARTESIAN", "CYLPOLAR", "NOSURVEY")

METRES_PER_FOOT = 0.3048

# Standard deviations of the default error model (metres, radians).
DEFAULT_SD = {
    "position": 0.05,
    "length": 0.05,
    "backlength": 0.05,
    "count": 0.05,
    "dx": 0.05,
    "dy": 0.05,
    "dz": 0.05,
    "depth": 0.05,
    "left": 0.05,
    "right": 0.05,
    "up": 0.05,
    "down": 0.05,
    "bearing": math.radians(0.5),
    "backbearing": math.radians(0.5),
    "gradient": math.radians(0.5),
    "backgradient": math.radians(0.5),
    "plumb": math.radians(0.25),
    "level": math.radians(0.25),
}

# Days between 1900-01-01 and the Unix epoch.
EPOCH_1900 = "1900-01-01"


def _struct(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names.split()])


VEC = _struct("x y z")
COV = _struct("xx yy zz xy zx yz")


def _fields(spec: str) -> T.StructType:
    kinds = {
        "s": T.StringType(),
        "l": T.LongType(),
        "i": T.IntegerType(),
        "d": T.DoubleType(),
        "a": T.ArrayType(T.DoubleType()),
        "t": T.DateType(),
        "b": T.BooleanType(),
        "V": VEC,
        "C": COV,
    }
    return T.StructType(
        [T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in spec.split())]
    )


READINGS = _fields(
    "reading_id:l scope:s seq:l style:s from_stn:s to_stn:s "
    "tape:a backtape:a compass:a backcompass:a clino:a backclino:a "
    "from_depth:d to_depth:d depth_change:d from_count:d to_count:d "
    "dx:d dy:d dz:d clino_token:s backclino_token:s direction:s flags:i date1:t date2:t"
)
SETTINGS = _fields("scope:s seq:l quantity:s unit:d zero:d scale:d sd:d")
FIXES = _fields(
    "station:s seq:l x:d y:d z:d sdx:d sdy:d sdz:d cxy:d cyz:d czx:d is_reference:b"
)
LEGS = _fields(
    "leg_id:l from_stn:s to_stn:s survey:s d:V v:C flags:i style:s days1:i days2:i"
)
STATIONS = _fields("name:s survey:s x:d y:d z:d sflags:i component:l")
TRAVERSES = _fields(
    "trav_id:l from_stn:s to_stn:s n_legs:l length:d moved:d E:d H:d V:d"
)
XSECTS = _fields("tube_id:l seq:l station:s l:d r:d u:d d:d days1:i days2:i")
