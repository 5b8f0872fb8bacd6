"""Readings to legs: a displacement and its covariance for every reading.

Each operator is one projection over the input (no shuffle), so it also runs
unchanged on a streaming DataFrame. Rows that cannot be reduced keep NULL in
`d` and `v` and say why in `reject`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legnet.functions import readings as R
from legnet.functions.units import calibrate, count_length
from legnet.functions.vec import AXES, PARTS, cov
from legnet.schema import DEFAULT_SD

DEG = math.pi / 180


class Calibration:
    """Unit, zero error, scale and standard deviation per quantity.

    Values may be numbers or Columns (such as the result of settings
    resolution), so one plan serves fixed and per-row calibration.
    """

    ANGLES = {"bearing", "backbearing", "gradient", "backgradient"}

    def __init__(self, overrides: dict | None = None):
        self.overrides = overrides or {}

    def __call__(self, quantity: str) -> dict:
        base = {
            "unit": DEG if quantity in self.ANGLES else 1.0,
            "zero": 0.0,
            "scale": 1.0,
            "sd": DEFAULT_SD[quantity],
        }
        return {**base, **self.overrides.get(quantity, {})}

    def var(self, quantity: str):
        sd = self(quantity)["sd"]
        return F.lit(sd) * F.lit(sd)

    def apply(self, quantity: str, value: Column) -> Column:
        c = self(quantity)
        return calibrate(value, c["unit"], c["zero"], c["scale"])


def _mean(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    if dict(df.dtypes)[name].startswith("array"):
        return R.mean_reading(F.col(name))
    return F.col(name).cast("double")


def _variance(df: DataFrame, name: str, cal: Calibration, quantity: str) -> Column:
    if name in df.columns and dict(df.dtypes)[name].startswith("array"):
        return R.repeat_variance(cal.var(quantity), F.col(name))
    return cal.var(quantity)


def _propagate(terms) -> tuple[Column, ...]:
    """Covariance parts of sum over terms of variance * partial * partial'."""
    parts = []
    for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (2, 0), (1, 2)):
        total = None
        for var, partial in terms:
            piece = var * partial[i] * partial[j]
            total = piece if total is None else total + piece
        parts.append(total)
    return tuple(parts)


def with_tape(df: DataFrame, cal: Calibration) -> DataFrame:
    """Adds _tape struct(value, var, disagree): calibrated fore and back length."""
    fore = cal.apply("length", _mean(df, "tape"))
    if {"from_count", "to_count"} <= set(df.columns):
        c = cal("count")
        counted = count_length(F.col("from_count"), F.col("to_count"), c["unit"], c["scale"])
        fore = F.coalesce(counted, fore)
    staged = df.withColumns(
        {
            "_ft": fore,
            "_bt": cal.apply("backlength", _mean(df, "backtape")),
            "_vft": _variance(df, "tape", cal, "length"),
            "_vbt": _variance(df, "backtape", cal, "backlength"),
        }
    )
    parts = [F.col(c) for c in ("_ft", "_vft", "_bt", "_vbt")]
    return staged.withColumn("_tape", R.combine_tape(*parts)).drop("_ft", "_vft", "_bt", "_vbt")


def with_compass(df: DataFrame, cal: Calibration, declination=0.0) -> DataFrame:
    """Adds _comp struct(value, var, disagree) and the normalised raw bearings."""
    fore, back = cal("bearing"), cal("backbearing")
    staged = df.withColumns(
        {
            "_fb": _mean(df, "compass") * fore["unit"],
            "_bb": _mean(df, "backcompass") * back["unit"],
        }
    ).withColumns(
        {
            "_raw_comp": R.norm_bearing(F.col("_fb")),
            "_raw_backcomp": R.norm_bearing(F.col("_bb")),
            "_vfb": _variance(df, "compass", cal, "bearing"),
            "_vbb": _variance(df, "backcompass", cal, "backbearing"),
        }
    )
    staged = staged.withColumns(
        {
            "_fb": (F.col("_raw_comp") - fore["zero"]) * fore["scale"],
            "_bb": (F.col("_raw_backcomp") - back["zero"]) * back["scale"],
        }
    )
    parts = [F.col(c) for c in ("_fb", "_vfb", "_bb", "_vbb")]
    return staged.withColumn("_comp", R.combine_compass(*parts, declination)).drop(
        "_fb", "_vfb", "_bb", "_vbb"
    )


def with_clino(df: DataFrame, cal: Calibration, infer_plumbs=False) -> DataFrame:
    """Adds _fore and _back struct(ctype, value): meaning of the slope readings."""
    sides = (("clino", "gradient", "_fore"), ("backclino", "backgradient", "_back"))
    for name, quantity, out in sides:
        unit = cal(quantity)["unit"]
        number = _mean(df, name)
        plain = R.slope_number(number * unit, infer_plumbs)
        token = f"{name}_token"
        if token in df.columns:
            df = df.withColumn(out, F.when(F.col(token).isNotNull(), R.classify_clino(F.col(token), unit, infer_plumbs)).otherwise(plain))
        else:
            df = df.withColumn(out, plain)
    if not infer_plumbs:
        return df
    plain_back = (F.col("_fore.ctype") == "INFERPLUMB") & (F.col("_back.ctype") == "READING")
    return df.withColumn(
        "_fore",
        F.struct(
            F.when(plain_back, "READING").otherwise(F.col("_fore.ctype")).alias("ctype"),
            F.col("_fore.value").alias("value"),
        ),
    )


_WORK = (
    "_tape _comp _raw_comp _raw_backcomp _fore _back _clin _t _vt _g _vg _b _vb "
    "_sg _cg _sb _cb _plumbed _omitted _up _flat _flat2 _along _dx _dy _dz "
    "_xx _yy _zz _xy _zx _yz"
).split()


def _finish(df: DataFrame, reject: Column, keep_work: bool) -> DataFrame:
    """Packs the working columns into d and v, NULL where the row is rejected."""
    ok = F.col("reject").isNull()
    d = F.struct(*[F.col(f"_d{a}").alias(a) for a in AXES])
    v = F.struct(*[F.col(f"_{p}").alias(p) for p in PARTS])
    out = df.withColumn("reject", reject).withColumns(
        {"d": F.when(ok, d), "v": F.when(ok, v)}
    )
    return out if keep_work else out.drop(*_WORK)


# Every operator below adds its terms in several small projections. One huge
# expression would compile to a method too long for the JIT.
def reduce_normal(
    df: DataFrame,
    cal: Calibration | None = None,
    declination=0.0,
    infer_plumbs=False,
    keep_work=False,
) -> DataFrame:
    """Length, bearing and slope (with any backsights) to a leg."""
    cal = cal or Calibration()
    df = with_clino(with_compass(with_tape(df, cal), cal, declination), cal, infer_plumbs)
    fg, bg = cal("gradient"), cal("backgradient")
    fore_reading = F.when(
        F.col("_fore.ctype") == "READING",
        (F.col("_fore.value") - fg["zero"]) * fg["scale"],
    )
    back_reading = F.when(
        F.col("_back.ctype") == "READING",
        (F.col("_back.value") - bg["zero"]) * bg["scale"],
    )
    df = df.withColumn(
        "_clin",
        R.combine_clino(
            fore_reading, _variance(df, "clino", cal, "gradient"),
            back_reading, _variance(df, "backclino", cal, "backgradient"),
        ),
    )
    pos = cal.var("position") / 3.0
    ftype, btype = F.col("_fore.ctype"), F.col("_back.ctype")
    df = df.withColumns(
        {
            "_t": F.col("_tape.value"),
            "_g": F.coalesce(F.col("_clin.value"), F.lit(0.0)),
            "_b": F.col("_comp.value"),
            "_vb": F.col("_comp.var"),
            "_plumbed": ftype.isin("PLUMB", "INFERPLUMB") | btype.isin("PLUMB", "INFERPLUMB"),
            "_omitted": (ftype == "OMIT") & (btype == "OMIT"),
            "_up": F.when(ftype != "OMIT", F.col("_fore.value") > 0).otherwise(
                F.col("_back.value") < 0
            ),
        }
    )
    # A plumbed leg is a slope of 90 degrees with the plumb line's error to both
    # sides; a leg of length 0 has only the position error.
    plumbed, still = F.col("_plumbed"), F.col("_t") == 0.0
    df = df.withColumns(
        {
            "_sg": F.when(~plumbed, F.sin("_g")).when(F.col("_up"), 1.0).otherwise(-1.0),
            "_cg": F.when(plumbed, 0.0).otherwise(F.cos("_g")),
            "_sb": F.when(plumbed, 1.0).otherwise(F.sin("_b")),
            "_cb": F.when(plumbed, 1.0).otherwise(F.cos("_b")),
            "_vt": F.when(still & ~plumbed, 0.0).otherwise(F.col("_tape.var")),
            "_vg": F.when(plumbed, cal.var("plumb")).otherwise(
                F.coalesce(F.col("_clin.var"), cal.var("level"))
            ),
            "_vb": F.when(plumbed, 0.0).otherwise(F.col("_vb")),
        }
    )
    tape, vt, vg, vb = (F.col(c) for c in ("_t", "_vt", "_vg", "_vb"))
    sin_g, cos_g, sin_b, cos_b = (F.col(c) for c in ("_sg", "_cg", "_sb", "_cb"))
    df = df.withColumns({"_flat": tape * cos_g, "_dz": tape * sin_g}).withColumns(
        {"_dx": F.col("_flat") * sin_b, "_dy": F.col("_flat") * cos_b}
    )
    flat, dx, dy, dz = (F.col(c) for c in ("_flat", "_dx", "_dy", "_dz"))
    xx, yy, zz, xy, zx, yz = _propagate(
        [
            (vt, (cos_g * sin_b, cos_g * cos_b, sin_g)),
            (vb, (dy, -dx, F.lit(0.0))),
            (vg, (-dz * sin_b, -dz * cos_b, flat)),
        ]
    )
    guess = F.col("_omitted") & ~still
    df = df.withColumns(
        {
            "_xx": pos + xx,
            "_yy": pos + yy,
            "_zz": pos + F.when(guess, tape * tape * 0.1).otherwise(zz),
        }
    ).withColumns({"_xy": F.when(plumbed, 0.0).otherwise(xy), "_zx": zx, "_yz": yz})
    both_given = (ftype != "OMIT") & (btype != "OMIT")
    same_way = (F.col("_fore.value") > 0) == (F.col("_back.value") > 0)
    reject = (
        F.when(tape.isNull(), "tape missing")
        .when(ftype.isNull() | btype.isNull(), "clino unreadable")
        .when(both_given & (ftype != btype), "clino types differ")
        .when(plumbed & both_given & same_way, "plumbed in same direction")
        .when(~plumbed & F.col("_b").isNull(), "compass missing")
    )
    return _finish(df, reject, keep_work)


def _depth_change(df: DataFrame, cal: Calibration) -> Column:
    c = cal("depth")
    pair = (F.col("to_depth") - F.col("from_depth")) * c["unit"] * c["scale"]
    if "depth_change" not in df.columns:
        return pair
    return F.coalesce(cal.apply("depth", F.col("depth_change")), pair)


def _with_terms(df: DataFrame, cal: Calibration) -> DataFrame:
    """Adds the depth change, the combined readings and the bearing's sine and cosine."""
    return df.withColumns(
        {
            "_dz": _depth_change(df, cal),
            "_t": F.col("_tape.value"),
            "_vt": F.col("_tape.var"),
            "_b": F.col("_comp.value"),
            "_vb": F.col("_comp.var"),
        }
    ).withColumns({"_sb": F.sin("_b"), "_cb": F.cos("_b")})


def _shift_covariances(parts, compat):
    """Slots of (xy, yz, zx); compat puts each value one slot on."""
    xy, yz, zx = parts
    return (zx, xy, yz) if compat else (xy, yz, zx)


def reduce_diving(
    df: DataFrame, cal: Calibration | None = None, declination=0.0, compat=False,
    keep_work=False,
) -> DataFrame:
    """Length, bearing and depths to a leg."""
    cal = cal or Calibration()
    df = with_compass(with_tape(df, cal), cal, declination)
    pos, zero = cal.var("position") / 3.0, F.lit(0.0)
    vd = 2.0 * cal.var("depth")
    df = _with_terms(df, cal)
    tape, vt, b, vb = (F.col(c) for c in ("_t", "_vt", "_b", "_vb"))
    sin_b, cos_b, dz = F.col("_sb"), F.col("_cb"), F.col("_dz")
    still = (tape == 0.0) & (dz == 0.0)
    flat2 = F.col("_flat2")
    # Without room for a horizontal part, depth and length are two estimates of
    # one vertical distance.
    fall = dz * vt + F.when(
        F.when(b.isNull(), dz >= 0).otherwise(dz > 0), tape
    ).otherwise(-tape) * vd
    whole = vt + vd
    blend = F.when(b.isNull(), fall / (vt * vd if compat else whole)).otherwise(fall / whole)
    level = ~still & b.isNotNull() & (flat2 > 0.0)
    df = (
        df.withColumn("_flat2", tape * tape - dz * dz)
        .withColumns(
            {
                "_plumbed": ~still & b.isNull(),
                "_omitted": level,
                "_flat": F.when(level, F.sqrt(flat2)).otherwise(0.0),
                "_along": F.when(level, (vt * tape * tape + vd * flat2) / flat2),
            }
        )
        .withColumn("_dz", F.when(still | F.col("_omitted"), dz).otherwise(blend))
    )
    level, plumbed, along = F.col("_omitted"), F.col("_plumbed"), F.col("_along")
    df = df.withColumns(
        {
            "_dx": F.when(level, F.col("_flat") * sin_b).otherwise(0.0),
            "_dy": F.when(level, F.col("_flat") * cos_b).otherwise(0.0),
        }
    )
    dx, dy = F.col("_dx"), F.col("_dy")
    side = pos + F.when(plumbed, dz * dz * cal.var("plumb")).otherwise(0.0)
    xy, yz, zx = _shift_covariances(
        (sin_b * cos_b * (along + vb * flat2), -vd * cos_b, -vd * sin_b), compat
    )
    df = df.withColumns(
        {
            "_xx": F.when(level, pos + sin_b * sin_b * along + vb * dy * dy).otherwise(side),
            "_yy": F.when(level, pos + cos_b * cos_b * along + vb * dx * dx).otherwise(side),
            "_zz": pos
            + F.when(still, 0.0)
            .when(level, vd)
            .when(plumbed, vt * vd / (vt + cal.var("depth")))
            .otherwise(vt * vd / whole),
        }
    ).withColumns(
        {
            "_xy": F.when(level, xy).otherwise(zero),
            "_yz": F.when(level, yz).otherwise(zero),
            "_zx": F.when(level, zx).otherwise(zero),
        }
    )
    reject = F.when(tape.isNull(), "tape missing").when(dz.isNull(), "depth missing")
    return _finish(df, reject, keep_work)


def reduce_cartesian(
    df: DataFrame, cal: Calibration | None = None, rotation=0.0, compat=False,
    keep_work=False,
) -> DataFrame:
    """Measured offsets, turned by `rotation` radians to the network's north."""
    cal = cal or Calibration()
    x, y, z = (cal.apply(q, F.col(q)) for q in ("dx", "dy", "dz"))
    turn = F.lit(rotation)
    df = df.withColumns({"_sb": F.sin(turn), "_cb": F.cos(turn)})
    s, c = F.col("_sb"), F.col("_cb")
    vx, vy = cal.var("dx"), cal.var("dy")
    cross = -vx if compat else vx
    xy, yz, zx = _shift_covariances(
        ((vx + vy) * s * c, F.lit(0.0), F.lit(0.0)), compat
    )
    df = df.withColumns(
        {
            "_dx": x * c + y * s,
            "_dy": y * c - x * s,
            "_dz": z,
            "_xx": vx * c * c + vy * s * s,
            "_yy": vy * c * c + cross * s * s,
            "_zz": cal.var("dz"),
            "_xy": xy,
            "_yz": yz,
            "_zx": zx,
        }
    )
    missing = F.col("_dx").isNull() | F.col("_dy").isNull() | F.col("_dz").isNull()
    return _finish(df, F.when(missing, "offset missing"), keep_work)


def reduce_cylpolar(
    df: DataFrame, cal: Calibration | None = None, declination=0.0, compat=False,
    keep_work=False,
) -> DataFrame:
    """Horizontal length, bearing and depth change to a leg."""
    cal = cal or Calibration()
    df = with_compass(with_tape(df, cal), cal, declination)
    pos, zero = cal.var("position") / 3.0, F.lit(0.0)
    df = _with_terms(df, cal)
    tape, vt, b, vb = (F.col(c) for c in ("_t", "_vt", "_b", "_vb"))
    sin_b, cos_b, dz = F.col("_sb"), F.col("_cb"), F.col("_dz")
    plumbed = b.isNull()
    df = df.withColumns(
        {
            "_dx": F.when(plumbed, 0.0).otherwise(tape * sin_b),
            "_dy": F.when(plumbed, 0.0).otherwise(tape * cos_b),
        }
    )
    dx, dy = F.col("_dx"), F.col("_dy")
    side = pos + dz * dz * cal.var("plumb")
    xy, yz, zx = _shift_covariances(
        (F.when(plumbed, 0.0).otherwise((vt - vb * tape * tape) * sin_b * cos_b), zero, zero),
        compat,
    )
    df = df.withColumns(
        {
            "_xx": F.when(plumbed, side).otherwise(pos + vt * sin_b * sin_b + vb * dy * dy),
            "_yy": F.when(plumbed, side).otherwise(pos + vt * cos_b * cos_b + vb * dx * dx),
            "_zz": pos + 2.0 * cal.var("depth"),
            "_xy": xy,
            "_yz": yz,
            "_zx": zx,
        }
    )
    reject = F.when(tape.isNull(), "tape missing").when(dz.isNull(), "depth missing")
    return _finish(df, reject, keep_work)


def override_variance(v: Column, vx: Column, vy: Column, vz: Column) -> Column:
    """Covariance with given axis variances; an overridden axis loses its links."""
    hit = {"x": vx, "y": vy, "z": vz}

    def link(name, *axes):
        any_hit = hit[axes[0]].isNotNull() | hit[axes[1]].isNotNull()
        return F.when(any_hit, 0.0).otherwise(v[name])

    return cov(
        F.coalesce(vx, v["xx"]),
        F.coalesce(vy, v["yy"]),
        F.coalesce(vz, v["zz"]),
        link("xy", "x", "y"),
        link("zx", "z", "x"),
        link("yz", "y", "z"),
    )


def reduce_xsect(df: DataFrame, cal: Calibration | None = None) -> DataFrame:
    """Calibrated passage dimensions; an omitted one becomes -1."""
    cal = cal or Calibration()
    names = (("l", "left"), ("r", "right"), ("u", "up"), ("d", "down"))
    for short, quantity in names:
        df = df.withColumn(short, F.coalesce(cal.apply(quantity, F.col(short)), F.lit(-1.0)))
    return df


_BY_STYLE = {
    "NORMAL": reduce_normal,
    "DIVING": reduce_diving,
    "CARTESIAN": reduce_cartesian,
    "CYLPOLAR": reduce_cylpolar,
}


def reduce_readings(df: DataFrame, cal: Calibration | None = None) -> DataFrame:
    """Legs of a table that mixes styles: one branch per style, then a union."""
    out = None
    for style, op in _BY_STYLE.items():
        part = op(df.where(F.col("style") == style), cal)
        out = part if out is None else out.unionByName(part)
    return out
