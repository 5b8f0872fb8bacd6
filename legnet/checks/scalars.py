"""Scalar functions P1-P46 over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from legnet.checks.views import r, table, view, with_views
from legnet.functions import bands as B
from legnet.functions import dates as D
from legnet.functions import geometry as G
from legnet.functions import names as N
from legnet.functions import readings as R
from legnet.functions import units as U
from legnet.functions import vec as V
from legnet.operators import reduce as X

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def r6(col, digits=6):
    return F.round(col, digits)


KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = [k.strip() for k in KEY.split(",")]

SD2 = "2.5e-3"
ANG2 = "(radians(5e-1) * radians(5e-1))"

_UNIT_SQL = (
    "CASE l_linenumber % 7 WHEN 0 THEN 1e0 WHEN 1 THEN 3.048e-1 WHEN 2 THEN 9.144e-1"
    " WHEN 3 THEN pi() / 180 WHEN 4 THEN pi() / 200 WHEN 5 THEN 1e-2 ELSE pi() / 10800 END"
)
_UNIT_NAMES = ["metres", "feet", "yards", "degs", "grads", "percent", "minutes"]


@query(
    "p1_units",
    with_views(
        f"SELECT {KEY}, {r(f'tape * {_UNIT_SQL}')} AS value, "
        f"{r('compass * pi() / 200')} AS bearing FROM tv1",
        "tv1",
    ),
)
def p1(spark, sf):
    unit = F.element_at(
        F.array(*[F.lit(u) for u in _UNIT_NAMES]), F.col("l_linenumber") % 7 + 1
    )
    return view(spark, sf, "tv1").select(
        *KEYS,
        r6(U.to_metres(F.col("tape"), unit)).alias("value"),
        r6(U.to_radians(F.col("compass"), "grads")).alias("bearing"),
    )


@query(
    "p2_calibrate",
    with_views(
        f"SELECT {KEY}, {r('(tape * 3.048e-1 - 1.5e-1) * 1.02e0')} AS length, "
        f"{r('(radians(clino) - radians(2e0)) * -1e0')} AS slope FROM tv1",
        "tv1",
    ),
)
def p2(spark, sf):
    return view(spark, sf, "tv1").select(
        *KEYS,
        r6(U.calibrate(F.col("tape"), 0.3048, 0.15, 1.02)).alias("length"),
        r6(U.calibrate(F.col("clino"), math.pi / 180, math.radians(2), -1.0)).alias("slope"),
    )


@query(
    "p3_count_length",
    with_views(
        f"SELECT {KEY}, {r('(to_count - from_count) * 3.048e-1 * 9.8e-1')} AS length FROM tv1",
        "tv1",
    ),
)
def p3(spark, sf):
    return view(spark, sf, "tv1").select(
        *KEYS,
        r6(U.count_length(F.col("from_count"), F.col("to_count"), 0.3048, 0.98)).alias("length"),
    )


_N4 = "(l_linenumber % 4)"


@query(
    "p4_mean_reading",
    f"""SELECT {KEY}, CAST({_N4} AS INTEGER) AS n,
 CASE {_N4} WHEN 1 THEN {r('l_quantity')} WHEN 2 THEN {r('(l_quantity + l_tax) / 2')} WHEN 3 THEN {r('(l_quantity + l_tax + l_discount) / 3')} END AS mean,
 CASE WHEN {_N4} > 0 THEN {r(f'25e-4 / sqrt({_N4})')} END AS var FROM lineitem""",
)
def p4(spark, sf):
    every = F.array("l_quantity", "l_tax", "l_discount")
    readings = F.slice(every, 1, F.col("l_linenumber") % 4)
    df = table(spark, sf, "lineitem").select(*KEYS, readings.alias("readings"))
    return df.select(
        *KEYS,
        F.size("readings").alias("n"),
        r6(R.mean_reading(F.col("readings"))).alias("mean"),
        r6(R.repeat_variance(0.0025, F.col("readings"))).alias("var"),
    )


_Q_ANGLE = "(l_orderkey % 97)"
_Q_HEAD = "CASE l_linenumber % 2 WHEN 0 THEN 'N' ELSE 'S' END"
_Q_TAIL = "CASE l_partkey % 2 WHEN 0 THEN 'E' ELSE 'W' END"


@query(
    "p5_parse_quadrant",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN {_Q_ANGLE} > 90 THEN NULL
         WHEN l_linenumber % 2 = 0 AND l_partkey % 2 = 0 THEN {_Q_ANGLE} * 1e0
         WHEN l_linenumber % 2 = 0 THEN 36e1 - {_Q_ANGLE}
         WHEN l_partkey % 2 = 0 THEN 18e1 - {_Q_ANGLE}
         ELSE 18e1 + {_Q_ANGLE} END AS bearing FROM lineitem""",
)
def p5(spark, sf):
    text = F.concat(
        F.when(F.col("l_linenumber") % 2 == 0, "N").otherwise("S"),
        (F.col("l_orderkey") % 97).cast("string"),
        F.when(F.col("l_partkey") % 2 == 0, "E").otherwise("W"),
    )
    return table(spark, sf, "lineitem").select(
        *KEYS, U.parse_quadrant(text).alias("bearing")
    )


@query(
    "p6_percent_to_gradient",
    f"SELECT {KEY}, {r('atan(l_quantity * 1e-2)')} AS gradient FROM lineitem",
)
def p6(spark, sf):
    return table(spark, sf, "lineitem").select(
        *KEYS, r6(U.percent_to_gradient(F.col("l_quantity"))).alias("gradient")
    )


_B7 = "(radians(compass) * 3e0 - 4e0)"


@query(
    "p7_norm_bearing",
    with_views(
        f"""SELECT {KEY}, {_B7} < 0 OR {_B7} - 2 * pi() > 1e-6 AS suspicious,
        {r(f'CASE WHEN {_B7} < 0 OR {_B7} - 2 * pi() > 1e-6 THEN {_B7} - floor({_B7} / (2 * pi())) * 2 * pi() ELSE {_B7} END')} AS bearing
        FROM tv1""",
        "tv1",
    ),
)
def p7(spark, sf):
    a = F.radians("compass") * 3.0 - 4.0
    return view(spark, sf, "tv1").select(
        *KEYS,
        R.bearing_suspicious(a).alias("suspicious"),
        r6(R.norm_bearing(a)).alias("bearing"),
    )


_TOKEN = """CASE l_orderkey % 9 WHEN 0 THEN 'UP' WHEN 1 THEN 'd' WHEN 2 THEN 'LEVEL'
 WHEN 3 THEN '-' WHEN 4 THEN '+V' WHEN 5 THEN '-V' WHEN 6 THEN '90' WHEN 7 THEN 'x'
 ELSE CAST(l_linenumber AS STRING) END"""


@query(
    "p8_classify_clino",
    f"""SELECT {KEY}, CASE l_orderkey % 9 WHEN 0 THEN 'PLUMB' WHEN 1 THEN 'PLUMB' WHEN 2 THEN 'HORIZ'
 WHEN 3 THEN 'OMIT' WHEN 4 THEN 'PLUMB' WHEN 5 THEN 'PLUMB' WHEN 6 THEN 'INFERPLUMB' WHEN 7 THEN NULL ELSE 'READING' END AS ctype,
 CASE l_orderkey % 9 WHEN 0 THEN {r('pi() / 2')} WHEN 1 THEN {r('-pi() / 2')} WHEN 2 THEN 0e0 WHEN 3 THEN 0e0
 WHEN 4 THEN {r('pi() / 2')} WHEN 5 THEN {r('-pi() / 2')} WHEN 6 THEN {r('pi() / 2')} WHEN 7 THEN NULL ELSE {r('radians(l_linenumber)')} END AS value
 FROM lineitem""",
)
def p8(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("token", F.expr(_TOKEN))
    c = R.classify_clino(F.col("token"), infer_plumbs=True)
    return df.select(*KEYS, c["ctype"].alias("ctype"), r6(c["value"]).alias("value"))


_T9 = f"CASE WHEN backtape IS NULL THEN tape ELSE (tape + backtape) / {SD2} * ({SD2} + {SD2}) / 4 END"


@query(
    "p9_combine_tape",
    with_views(
        f"""SELECT {KEY}, {r(_T9)} AS value, {r(f'CASE WHEN backtape IS NULL THEN {SD2} ELSE ({SD2} + {SD2}) / 4 END')} AS var,
 coalesce((tape - backtape) * (tape - backtape) / 9 > {SD2} + {SD2}, false) AS disagree FROM tv1""",
        "tv1",
    ),
)
def p9(spark, sf):
    c = R.combine_tape(F.col("tape"), F.lit(0.0025), F.col("backtape"), F.lit(0.0025))
    return view(spark, sf, "tv1").select(
        *KEYS, r6(c["value"]).alias("value"), r6(c["var"]).alias("var"), c["disagree"].alias("disagree")
    )


# Bearings used by the checks below: normalised fore and back readings.
_NORM = "CASE WHEN {a} < 0 OR {a} - 2 * pi() > 1e-6 THEN {a} - floor({a} / (2 * pi())) * 2 * pi() ELSE {a} END"
COMPASS_STEPS = f"""
n0 AS (SELECT *, {_NORM.format(a='radians(compass)')} + {{decl}} AS cf,
              {_NORM.format(a='radians(backcompass)')} + {{decl}} - pi() AS cb FROM tv1),
n1 AS (SELECT *, CASE WHEN cb IS NULL THEN cf
         ELSE (cf / {ANG2} + cb / {ANG2}) * ({ANG2} + {ANG2}) / 4 + CASE WHEN abs(cf - cb) > pi() THEN pi() ELSE 0 END END AS comp,
       CASE WHEN cb IS NULL THEN {ANG2} ELSE {ANG2} / 2 END AS vcomp,
       CASE WHEN backclino IS NULL THEN radians(clino) ELSE (radians(clino) - radians(backclino)) / 2 END AS g,
       CASE WHEN backclino IS NULL THEN {ANG2} ELSE {ANG2} / 2 END AS vg,
       {_T9} AS t, CASE WHEN backtape IS NULL THEN {SD2} ELSE {SD2} / 2 END AS vt FROM n0)"""


@query(
    "p10_combine_compass",
    with_views(
        f"""WITH {COMPASS_STEPS.format(decl='radians(15e-1)')}
 SELECT {KEY}, {r('comp')} AS value, {r('vcomp')} AS var,
   coalesce(pow(((cf - cb) - floor((cf - cb + pi()) / (2 * pi())) * 2 * pi()) / 3, 2) > {ANG2} + {ANG2}, false) AS disagree
 FROM n1""",
        "tv1",
    ),
)
def p10(spark, sf):
    var = F.lit(math.radians(0.5) ** 2)
    c = R.combine_compass(
        R.norm_bearing(F.radians("compass")), var,
        R.norm_bearing(F.radians("backcompass")), var, math.radians(1.5),
    )
    return view(spark, sf, "tv1").select(
        *KEYS, r6(c["value"]).alias("value"), r6(c["var"]).alias("var"), c["disagree"].alias("disagree")
    )


@query(
    "p11_combine_clino",
    with_views(
        f"""WITH {COMPASS_STEPS.format(decl='0e0')}
 SELECT {KEY}, {r('g')} AS value, {r('vg')} AS var,
   coalesce(pow((radians(clino) + radians(backclino)) / 3, 2) > {ANG2} + {ANG2}, false) AS disagree
 FROM n1""",
        "tv1",
    ),
)
def p11(spark, sf):
    var = F.lit(math.radians(0.5) ** 2)
    c = R.combine_clino(F.radians("clino"), var, F.radians("backclino"), var)
    return view(spark, sf, "tv1").select(
        *KEYS, r6(c["value"]).alias("value"), r6(c["var"]).alias("var"), c["disagree"].alias("disagree")
    )


@query(
    "p12_swap_direction",
    with_views(
        f"""SELECT {KEY}, CASE WHEN l_linestatus = 'F' THEN to_stn ELSE from_stn END AS from_stn,
 CASE WHEN l_linestatus = 'F' THEN from_stn ELSE to_stn END AS to_stn FROM tv1""",
        "tv1",
    ),
)
def p12(spark, sf):
    s = R.swap_direction(
        F.when(F.col("l_linestatus") == "F", "B").otherwise("F"), F.col("from_stn"), F.col("to_stn")
    )
    return view(spark, sf, "tv1").select(*KEYS, s["from_stn"].alias("from_stn"), s["to_stn"].alias("to_stn"))


def leg_columns():
    return [r6(F.col(f"d.{a}")).alias(f"d{a}") for a in V.AXES] + [
        r6(F.col(f"v.{p}")).alias(f"v{p}") for p in V.PARTS
    ]


def leg_sql(exprs: dict) -> str:
    return ", ".join(f"{r(e)} AS {n}" for n, e in exprs.items())


POSVAR = f"{SD2} / 3"
PLUMB2 = "(radians(25e-2) * radians(25e-2))"

# Expected normal legs, written from the measurement formulas (no matrix helper).
NORMAL = {
    "dx": "t * cos(g) * sin(comp)",
    "dy": "t * cos(g) * cos(comp)",
    "dz": "t * sin(g)",
    "vxx": f"{POSVAR} + vt * pow(cos(g) * sin(comp), 2) + vcomp * pow(t * cos(g) * cos(comp), 2) + vg * pow(t * sin(g) * sin(comp), 2)",
    "vyy": f"{POSVAR} + vt * pow(cos(g) * cos(comp), 2) + vcomp * pow(t * cos(g) * sin(comp), 2) + vg * pow(t * sin(g) * cos(comp), 2)",
    "vzz": f"{POSVAR} + vt * pow(sin(g), 2) + vg * pow(t * cos(g), 2)",
    "vxy": "sin(comp) * cos(comp) * (vt * pow(cos(g), 2) + vg * pow(t * sin(g), 2)) - vcomp * pow(t * cos(g), 2) * sin(comp) * cos(comp)",
    "vzx": "vt * sin(comp) * sin(g) * cos(g) - vg * t * t * sin(g) * cos(g) * sin(comp)",
    "vyz": "vt * cos(comp) * sin(g) * cos(g) - vg * t * t * sin(g) * cos(g) * cos(comp)",
}


@query(
    "p13_reduce_normal",
    with_views(
        f"WITH {COMPASS_STEPS.format(decl='0e0')} SELECT {KEY}, {leg_sql(NORMAL)} FROM n1", "tv1"
    ),
)
def p13(spark, sf):
    return X.reduce_normal(_no_counts(view(spark, sf, "tv1"))).select(*KEYS, *leg_columns())


def _no_counts(df):
    return df.drop("from_count", "to_count")


@query(
    "p13_reduce_normal_special",
    with_views(
        f"""WITH k AS (SELECT *, l_orderkey % 4 AS kind, tape AS t, radians(compass) AS b FROM tv1)
 SELECT {KEY}, {r('CASE kind WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 ELSE t * sin(b) END')} AS dx,
   {r('CASE kind WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 ELSE t * cos(b) END')} AS dy,
   {r('CASE kind WHEN 0 THEN t WHEN 1 THEN -t ELSE 0e0 END')} AS dz,
   {r(f'CASE WHEN kind < 2 THEN {POSVAR} + t * t * {PLUMB2} ELSE {POSVAR} + {SD2} * pow(sin(b), 2) + {ANG2} * pow(t * cos(b), 2) END')} AS vxx,
   {r(f'CASE WHEN kind < 2 THEN {POSVAR} + {SD2} WHEN kind = 2 THEN {POSVAR} + t * t * {PLUMB2} ELSE {POSVAR} + t * t * 1e-1 END')} AS vzz
 FROM k""",
        "tv1",
    ),
)
def p13b(spark, sf):
    token = F.element_at(F.array(F.lit("U"), F.lit("D"), F.lit("H"), F.lit("-")), (F.col("l_orderkey") % 4 + 1).cast("int"))
    df = view(spark, sf, "tv1").withColumn("clino_token", token)
    df = _no_counts(df).drop("backtape", "backcompass", "backclino", "clino")
    out = X.reduce_normal(df)
    return out.select(
        *KEYS,
        *[r6(F.col(f"d.{a}")).alias(f"d{a}") for a in V.AXES],
        r6(F.col("v.xx")).alias("vxx"),
        r6(F.col("v.zz")).alias("vzz"),
    )


DIVING_STEPS = f"""d0 AS (SELECT *, radians(compass) AS b, (to_depth - from_depth) AS h, tape AS t FROM tv1),
d1 AS (SELECT *, t * t - h * h AS f2 FROM d0),
d2 AS (SELECT *, CASE WHEN f2 <= 0 THEN 0e0 ELSE sqrt(f2) * sin(b) END AS dx,
  CASE WHEN f2 <= 0 THEN 0e0 ELSE sqrt(f2) * cos(b) END AS dy,
  CASE WHEN f2 > 0 THEN h WHEN h > 0 THEN (h * {SD2} + t * 2 * {SD2}) / (3 * {SD2}) ELSE (h * {SD2} - t * 2 * {SD2}) / (3 * {SD2}) END AS dz,
  CASE WHEN f2 > 0 THEN ({SD2} * t * t + 2 * {SD2} * f2) / f2 END AS fd FROM d1)"""
DIVING = {
    "dx": "dx",
    "dy": "dy",
    "dz": "dz",
    "vxx": f"{POSVAR} + CASE WHEN f2 <= 0 THEN 0e0 ELSE pow(sin(b), 2) * fd + {ANG2} * dy * dy END",
    "vyy": f"{POSVAR} + CASE WHEN f2 <= 0 THEN 0e0 ELSE pow(cos(b), 2) * fd + {ANG2} * dx * dx END",
    "vzz": f"{POSVAR} + CASE WHEN f2 <= 0 THEN 2e0 * {SD2} / 3 ELSE 2 * {SD2} END",
    "vxy": f"CASE WHEN f2 <= 0 THEN 0e0 ELSE sin(b) * cos(b) * (fd + {ANG2} * f2) END",
    "vzx": f"CASE WHEN f2 <= 0 THEN 0e0 ELSE -2 * {SD2} * sin(b) END",
    "vyz": f"CASE WHEN f2 <= 0 THEN 0e0 ELSE -2 * {SD2} * cos(b) END",
}


@query(
    "p14_reduce_diving",
    with_views(f"WITH {DIVING_STEPS} SELECT {KEY}, {leg_sql(DIVING)} FROM d2", "tv1"),
)
def p14(spark, sf):
    df = _no_counts(view(spark, sf, "tv1")).drop("backtape", "backcompass")
    return X.reduce_diving(df).select(*KEYS, *leg_columns())


@query(
    "p14_reduce_diving_plumb",
    with_views(
        f"""WITH {DIVING_STEPS}, p AS (SELECT *, (h * {SD2} + CASE WHEN h < 0 THEN -t ELSE t END * 2 * {SD2}) / (3 * {SD2}) AS z FROM d2)
 SELECT {KEY}, 0e0 AS dx, {r('z')} AS dz, {r(f'{POSVAR} + z * z * {PLUMB2}')} AS vxx,
  {r(f'{POSVAR} + 2 * {SD2} * {SD2} / (2 * {SD2})')} AS vzz FROM p""",
        "tv1",
    ),
)
def p14b(spark, sf):
    df = _no_counts(view(spark, sf, "tv1")).drop("backtape", "backcompass", "compass")
    out = X.reduce_diving(df)
    return out.select(
        *KEYS,
        r6(F.col("d.x")).alias("dx"),
        r6(F.col("d.z")).alias("dz"),
        r6(F.col("v.xx")).alias("vxx"),
        r6(F.col("v.zz")).alias("vzz"),
    )


@query(
    "p15_reduce_cartesian",
    "WITH k AS (SELECT *, radians(l_tax * 1e2) AS a, l_quantity AS x, l_discount * 1e2 AS y, l_tax * 50 AS z FROM lineitem) SELECT "
    + KEY
    + ", "
    + leg_sql(
        {
            "dx": "x * cos(a) + y * sin(a)",
            "dy": "y * cos(a) - x * sin(a)",
            "dz": "z",
            "vxx": f"{SD2}",
            "vyy": f"{SD2}",
            "vzz": f"{SD2}",
            "vxy": f"2 * {SD2} * sin(a) * cos(a)",
            "vzx": "0e0",
            "vyz": "0e0",
        }
    )
    + " FROM k",
)
def p15(spark, sf):
    df = table(spark, sf, "lineitem").select(
        *KEYS,
        F.radians(F.col("l_tax") * 100).alias("turn"),
        F.col("l_quantity").alias("dx"),
        (F.col("l_discount") * 100).alias("dy"),
        (F.col("l_tax") * 50).alias("dz"),
    )
    out = X.reduce_cartesian(df, rotation=F.col("turn")).drop("dx", "dy", "dz")
    return out.select(*KEYS, *leg_columns())


@query(
    "p16_reduce_cylpolar",
    with_views(
        f"WITH {DIVING_STEPS} SELECT {KEY}, "
        + leg_sql(
            {
                "dx": "t * sin(b)",
                "dy": "t * cos(b)",
                "dz": "h",
                "vxx": f"{POSVAR} + {SD2} * pow(sin(b), 2) + {ANG2} * pow(t * cos(b), 2)",
                "vyy": f"{POSVAR} + {SD2} * pow(cos(b), 2) + {ANG2} * pow(t * sin(b), 2)",
                "vzz": f"{POSVAR} + 2 * {SD2}",
                "vxy": f"({SD2} - {ANG2} * t * t) * sin(b) * cos(b)",
                "vzx": "0e0",
                "vyz": "0e0",
            }
        )
        + " FROM d2",
        "tv1",
    ),
)
def p16(spark, sf):
    df = _no_counts(view(spark, sf, "tv1")).drop("backtape", "backcompass")
    return X.reduce_cylpolar(df).select(*KEYS, *leg_columns())


@query(
    "p17_override_variance",
    with_views(
        f"WITH {COMPASS_STEPS.format(decl='0e0')} SELECT {KEY}, "
        + leg_sql(
            {
                "vxx": f"CASE WHEN l_linenumber = 1 THEN 1e-2 ELSE {NORMAL['vxx']} END",
                "vyy": f"CASE WHEN l_linenumber = 2 THEN 2e-2 ELSE {NORMAL['vyy']} END",
                "vzz": NORMAL["vzz"],
                "vxy": f"CASE WHEN l_linenumber IN (1, 2) THEN 0e0 ELSE {NORMAL['vxy']} END",
                "vzx": f"CASE WHEN l_linenumber = 1 THEN 0e0 ELSE {NORMAL['vzx']} END",
                "vyz": f"CASE WHEN l_linenumber = 2 THEN 0e0 ELSE {NORMAL['vyz']} END",
            }
        )
        + " FROM n1",
        "tv1",
    ),
)
def p17(spark, sf):
    out = X.reduce_normal(_no_counts(view(spark, sf, "tv1")))
    v = X.override_variance(
        F.col("v"),
        F.when(F.col("l_linenumber") == 1, 0.01),
        F.when(F.col("l_linenumber") == 2, 0.02),
        F.lit(None).cast("double"),
    )
    return out.withColumn("v", v).select(
        *KEYS, *[r6(F.col(f"v.{p}")).alias(f"v{p}") for p in V.PARTS]
    )


@query(
    "p18_reduce_xsect",
    f"""SELECT {KEY}, {r('CASE WHEN l_linenumber % 2 = 0 THEN -1e0 ELSE l_quantity * 3.048e-1 END')} AS l,
 {r('(l_quantity + 1) * 3.048e-1')} AS r, {r('l_tax * 10 - 1e-1')} AS u, {r('CASE WHEN l_linenumber % 3 = 0 THEN -1e0 ELSE l_discount * 10 END')} AS d FROM lineitem""",
)
def p18(spark, sf):
    df = table(spark, sf, "lineitem").select(
        *KEYS,
        F.when(F.col("l_linenumber") % 2 != 0, F.col("l_quantity")).alias("l"),
        (F.col("l_quantity") + 1).alias("r"),
        (F.col("l_tax") * 10).alias("u"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") * 10).alias("d"),
    )
    cal = X.Calibration({"left": {"unit": 0.3048}, "right": {"unit": 0.3048}, "up": {"zero": 0.1}})
    out = X.reduce_xsect(df, cal)
    return out.select(*KEYS, *[r6(F.col(c)).alias(c) for c in "lrud"])


_ANON = "CASE l_linenumber WHEN 1 THEN '.' WHEN 2 THEN '..' WHEN 3 THEN '...' WHEN 4 THEN '-' ELSE concat('s', CAST(l_suppkey AS STRING)) END"


@query(
    "p19_splay_flag",
    f"""SELECT {KEY}, CASE WHEN l_linenumber IN (1, 2, 4) THEN 4 ELSE 0 END AS flags,
 CASE WHEN l_linenumber IN (2, 4) THEN 96 WHEN l_linenumber IN (1, 3) THEN 32 ELSE 0 END AS sflags FROM lineitem""",
)
def p19(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("to_stn", F.expr(_ANON))
    return df.select(
        *KEYS,
        R.splay_flag(F.lit("a"), F.col("to_stn")).alias("flags"),
        R.anon_station_flags(F.col("to_stn")).alias("sflags"),
    )


_SHOT = "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'L' ELSE '' END, CASE WHEN l_partkey % 3 = 0 THEN 'P' ELSE '' END, CASE WHEN l_suppkey % 5 = 0 THEN 'S' ELSE '' END, CASE WHEN l_orderkey % 7 = 0 THEN 'X' ELSE '' END, CASE WHEN l_orderkey % 11 = 0 THEN 'C' ELSE '' END)"


@query(
    "p20_map_shot_flags",
    f"""SELECT {KEY}, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END
 + CASE WHEN l_suppkey % 5 = 0 THEN 4 ELSE 0 END AS flags, l_orderkey % 7 = 0 AS excluded,
 CASE WHEN l_orderkey % 11 = 0 THEN 1e-6 END AS fixed_var FROM lineitem""",
)
def p20(spark, sf):
    m = R.map_shot_flags(F.expr(_SHOT))
    return table(spark, sf, "lineitem").select(
        *KEYS, m["flags"].alias("flags"), m["excluded"].alias("excluded"), m["fixed_var"].alias("fixed_var")
    )


# Vector and covariance algebra: operands from the columns of a line.
_VEC = "WITH k AS (SELECT *, l_quantity AS ax, l_tax * 100 AS ay, l_discount * 100 AS az, l_discount * 10 AS ux, l_quantity / 4 AS uy, l_tax * 7 AS uz, l_quantity + 10 AS xx, l_quantity / 2 + 8 AS yy, l_quantity / 5 + 9 AS zz, l_tax * 30 AS xy, l_discount * 20 - 1 AS zx, l_tax * 10 - l_discount AS yz FROM lineitem) "


def _operands(spark, sf):
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        *KEYS,
        V.vec(q, t * 100, d * 100).alias("a"),
        V.vec(d * 10, q / 4, t * 7).alias("b"),
        V.cov(q + 10, q / 2 + 8, q / 5 + 9, t * 30, d * 20 - 1, t * 10 - d).alias("s"),
    )


def _spread(col, names, digits=6):
    return [r6(F.col(f"{col}.{n}"), digits).alias(f"{col}_{n}") for n in names]


@query(
    "p21_vector_sums",
    _VEC
    + f"SELECT {KEY}, "
    + ", ".join(f"{r(f'a{i} + u{i}')} AS sum_{i}, {r(f'a{i} - u{i}')} AS diff_{i}" for i in "xyz")
    + " FROM k",
)
def p21(spark, sf):
    df = _operands(spark, sf).withColumns(
        {"sum": V.vadd(F.col("a"), F.col("b")), "diff": V.vsub(F.col("a"), F.col("b"))}
    )
    return df.select(*KEYS, *_spread("sum", V.AXES), *_spread("diff", V.AXES))


@query(
    "p22_covariance_sums",
    _VEC
    + f"SELECT {KEY}, "
    + ", ".join(f"{r(f'{p} + 2 * {p}')} AS sum_{p}, {r(f'{p} - 2 * {p}')} AS diff_{p}" for p in V.PARTS)
    + " FROM k",
)
def p22(spark, sf):
    s = F.col("s")
    df = _operands(spark, sf).withColumns(
        {"sum": V.sadd(s, V.sscale(s, 2.0)), "diff": V.ssub(s, V.sscale(s, 2.0))}
    )
    return df.select(*KEYS, *_spread("sum", V.PARTS), *_spread("diff", V.PARTS))


@query(
    "p23_covariance_products",
    _VEC
    + f"SELECT {KEY}, "
    + ", ".join(
        f"{r(e)} AS {n}"
        for n, e in {
            "p_x": "xx * ax + xy * ay + zx * az",
            "p_y": "xy * ax + yy * ay + yz * az",
            "p_z": "zx * ax + yz * ay + zz * az",
            "m_m11": "xx * xx + xy * xy + zx * zx",
            "m_m12": "xx * xy + xy * yy + zx * yz",
            "m_m23": "xy * zx + yy * yz + yz * zz",
            "m_m33": "zx * zx + yz * yz + zz * zz",
        }.items()
    )
    + " FROM k",
)
def p23(spark, sf):
    s = F.col("s")
    df = _operands(spark, sf).withColumns({"p": V.smul_vec(s, F.col("a")), "m": V.smul(s, s)})
    return df.select(*KEYS, *_spread("p", V.AXES), *_spread("m", ("m11", "m12", "m23", "m33")))


_DET = "(xx * yy * zz + 2 * xy * yz * zx - xx * yz * yz - yy * zx * zx - zz * xy * xy)"


@query(
    "p24_covariance_inverse",
    _VEC
    + f"SELECT {KEY}, "
    + ", ".join(
        f"{r(e)} AS {n}"
        for n, e in {
            "inv_xx": f"(yy * zz - yz * yz) / {_DET}",
            "inv_yy": f"(xx * zz - zx * zx) / {_DET}",
            "inv_zz": f"(xx * yy - xy * xy) / {_DET}",
            "inv_xy": f"(zx * yz - xy * zz) / {_DET}",
            "sol_x": f"((yy * zz - yz * yz) * ax + (zx * yz - xy * zz) * ay + (xy * yz - yy * zx) * az) / {_DET}",
        }.items()
    )
    + ", true AS singular_is_null FROM k",
)
def p24(spark, sf):
    s = F.col("s")
    flat = V.cov(F.lit(1.0), F.lit(1.0), F.lit(0.0))
    df = _operands(spark, sf).withColumns({"inv": V.sinv(s), "sol": V.ssolve(s, F.col("a"))})
    return df.select(
        *KEYS,
        *_spread("inv", ("xx", "yy", "zz", "xy")),
        *_spread("sol", ("x",)),
        V.sinv(flat).isNull().alias("singular_is_null"),
    )


@query(
    "p25_is_exact",
    f"SELECT {KEY}, l_tax = 0 AND l_discount = 0 AS exact FROM lineitem",
)
def p25(spark, sf):
    t, d, z = F.col("l_tax"), F.col("l_discount"), F.lit(0.0)
    return table(spark, sf, "lineitem").select(
        *KEYS, V.is_exact(V.cov(t, t, d, z, z, d)).alias("exact")
    )


_BRG = "CASE WHEN degrees(atan2(dx, dy)) < 0 THEN degrees(atan2(dx, dy)) + 360 ELSE degrees(atan2(dx, dy)) END"
_GRD = "degrees(atan2(dz, sqrt(dx * dx + dy * dy)))"


@query(
    "p26_measure",
    with_views(
        f"""SELECT cust, seq, {r('sqrt(dx * dx + dy * dy)')} AS horizontal, {r('dz')} AS vertical,
 {r('sqrt(dx * dx + dy * dy + dz * dz)')} AS distance, {r(_BRG)} AS bearing, {r(f'({_BRG}) / 9e-1')} AS bearing_grads,
 {r(_GRD)} AS gradient, {r(f'({_GRD}) / 9e-1')} AS gradient_grads,
 trunc(1e2 * tan(radians({_GRD}))) + 0e0 AS gradient_percent FROM tv2""",
        "tv2",
    ),
)
def p26(spark, sf):
    z = F.lit(0.0)
    m = G.measure(V.vec(z, z, z), V.vec(F.col("dx"), F.col("dy"), F.col("dz")))
    names = ("horizontal", "vertical", "distance", "bearing", "bearing_grads", "gradient", "gradient_grads", "gradient_percent")
    return view(spark, sf, "tv2").select("cust", "seq", m.alias("m")).select(
        "cust", "seq", *[r6(F.col(f"m.{n}")).alias(n) for n in names]
    )


_A27, _T27 = "radians(3e1)", "radians(2e1)"


@query(
    "p27_project_view",
    with_views(
        f"""SELECT cust, seq, {r(f'dx * cos({_A27}) - dy * sin({_A27})')} AS px,
 {r(f'dz * cos({_T27}) - (dx * sin({_A27}) + dy * cos({_A27})) * sin({_T27})')} AS py,
 {r(f'-(dz * sin({_T27}) + (dx * sin({_A27}) + dy * cos({_A27})) * cos({_T27}))')} AS pz FROM tv2""",
        "tv2",
    ),
)
def p27(spark, sf):
    p = G.project_view(V.vec(F.col("dx"), F.col("dy"), F.col("dz")), 30.0, 20.0)
    return view(spark, sf, "tv2").select("cust", "seq", p.alias("p")).select(
        "cust", "seq", *[r6(F.col(f"p.{a}")).alias(f"p{a}") for a in V.AXES]
    )


# Hierarchical names from the orders table: nation, customer, order.
_TV4 = """tv4 AS (SELECT o_orderkey, concat('N', CAST(c_nationkey AS STRING), '.', CASE WHEN o_orderkey % 3 = 0 THEN 'Cust00' ELSE 'cust' END,
 CAST(o_custkey AS STRING), '.', CAST(o_orderkey AS STRING)) AS name,
 c_nationkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey)"""


def names_view(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    df = o.join(c, o.o_custkey == c.c_custkey)
    name = F.concat(
        F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("."),
        F.when(F.col("o_orderkey") % 3 == 0, "Cust00").otherwise("cust"),
        F.col("o_custkey").cast("string"), F.lit("."), F.col("o_orderkey").cast("string"),
    )
    return df.select("o_orderkey", name.alias("name"), "c_nationkey", "o_custkey")


NAMES_SQL = _TV4


@query(
    "p29_canon_name",
    f"""WITH {_TV4} SELECT o_orderkey, lower(name) AS folded,
 concat(substr(split_part(lower(name), '.', 1), 1, 4), '.', substr(split_part(lower(name), '.', 2), 1, 4), '.', substr(split_part(lower(name), '.', 3), 1, 4)) AS cut,
 upper(name) AS shouted FROM tv4""",
)
def p29(spark, sf):
    n = F.col("name")
    return names_view(spark, sf).select(
        "o_orderkey",
        N.canon_name(n).alias("folded"),
        N.canon_name(n, truncate=4).alias("cut"),
        N.canon_name(n, case="upper").alias("shouted"),
    )


@query(
    "p30_name_parts",
    f"""WITH {_TV4} SELECT o_orderkey, concat(split_part(name, '.', 1), '.', split_part(name, '.', 2)) AS survey,
 split_part(name, '.', 3) AS leaf, concat('all.', name) AS inner_name, name AS top_name, CAST(3 AS INTEGER) AS depth,
 '' AS top_survey FROM tv4""",
)
def p30(spark, sf):
    n = F.col("name")
    return names_view(spark, sf).select(
        "o_orderkey",
        N.survey_of(n).alias("survey"),
        N.leaf(n).alias("leaf"),
        N.full_name(F.lit("all"), n).alias("inner_name"),
        N.full_name(F.lit(""), n).alias("top_name"),
        N.depth_of(n).alias("depth"),
        N.survey_of(F.lit("top")).alias("top_survey"),
    )


_NUM = "concat(chr(2), lpad(CAST(length(ltrim({t}, '0')) AS VARCHAR), 5, '0'), ltrim({t}, '0'), lpad(CAST(99999 - (length({t}) - length(ltrim({t}, '0'))) AS VARCHAR), 5, '0'))"


@query(
    "p32_natural_key",
    f"""WITH {_TV4}, p AS (SELECT o_orderkey, CAST(c_nationkey AS VARCHAR) AS a,
   concat(CASE WHEN o_orderkey % 3 = 0 THEN '00' ELSE '' END, CAST(o_custkey AS VARCHAR)) AS b,
   CASE WHEN o_orderkey % 3 = 0 THEN 'Cust' ELSE 'cust' END AS w, CAST(o_orderkey AS VARCHAR) AS c FROM tv4)
 SELECT o_orderkey, concat('N', {_NUM.format(t='a')}, chr(1), w, {_NUM.format(t='b')}, chr(1), {_NUM.format(t='c')}) AS sort_key FROM p""",
)
def p32(spark, sf):
    return names_view(spark, sf).select("o_orderkey", N.natural_key(F.col("name")).alias("sort_key"))


@query(
    "p33_escapes",
    """SELECT doc_id, CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13))
   THEN concat('"', replace(text, '"', '""'), '"') ELSE text END AS csv,
 replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml,
 replace(replace(replace(replace(replace(text, '^', '^^'), ' ', '^_'), chr(10), '^J'), chr(9), '^I'), chr(13), '^M') AS plot FROM documents""",
)
def p33(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", N.csv_quote(t).alias("csv"), N.xml_escape(t).alias("xml"), N.plot_escape(t).alias("plot")
    )


@query(
    "p34_days_since_1900",
    f"""SELECT o_orderkey, CAST(date_diff('day', DATE '1900-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
 strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS back FROM orders""",
)
def p34(spark, sf):
    d = D.days_since_1900(F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select(
        "o_orderkey", d.alias("days"), D.date_from_days(d).cast("string").alias("back")
    )


@query(
    "p35_decimal_year",
    f"""SELECT o_orderkey, {r("year(o_orderdate) + (dayofyear(o_orderdate) - 1) / CASE WHEN year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) THEN 366e0 ELSE 365e0 END")} AS year FROM orders""",
)
def p35(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", r6(D.decimal_year(F.col("o_orderdate").cast("date"))).alias("year")
    )


@query(
    "p36_mid_date",
    """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST(floor((o_custkey % 400) / 2e0) AS INTEGER), '%Y-%m-%d') AS middle FROM orders""",
)
def p36(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        D.mid_date(d, F.date_add(d, (F.col("o_custkey") % 400).cast("int"))).cast("string").alias("middle"),
    )


_Y, _M, _DD = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"


@query(
    "p37_parse_partial_date",
    f"""WITH k AS (SELECT o_orderkey, o_orderkey % 6 AS kind, CAST(o_orderdate AS DATE) AS d FROM orders)
 SELECT o_orderkey, CASE kind WHEN 0 THEN strftime(d, '%Y-01-01') WHEN 1 THEN strftime(d, '%Y-%m-01') WHEN 2 THEN strftime(d, '%Y-%m-%d')
   WHEN 3 THEN strftime(d, '%Y-%m-%d') WHEN 4 THEN concat('19', lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0'), '-01-01') END AS date1,
 CASE kind WHEN 0 THEN strftime(d, '%Y-12-31') WHEN 1 THEN strftime(last_day(d), '%Y-%m-%d') WHEN 2 THEN strftime(d, '%Y-%m-%d')
   WHEN 3 THEN strftime(make_date(year(d) + 1, 12, 31), '%Y-%m-%d') WHEN 4 THEN concat('19', lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0'), '-12-31') END AS date2,
 CASE WHEN kind = 5 THEN 'invalid month' END AS problem FROM k""",
)
def p37(spark, sf):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.date_format(d, "yyyy"))
        .when(k == 1, F.date_format(d, "yyyy.MM"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 3, F.concat(F.date_format(d, "yyyy.MM.dd"), F.lit("-"), (F.year(d) + 1).cast("string")))
        .when(k == 4, F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
        .otherwise(F.concat(F.date_format(d, "yyyy"), F.lit(".13")))
    )
    p = D.parse_partial_date(text)
    return table(spark, sf, "orders").select("o_orderkey", p.alias("p")).select(
        "o_orderkey",
        F.col("p.date1").cast("string").alias("date1"),
        F.col("p.date2").cast("string").alias("date2"),
        F.col("p.problem").alias("problem"),
    )


_LEN = "sqrt(dx * dx + dy * dy + dz * dz)"


@query(
    "p38_depth_band",
    with_views(
        """WITH b AS (SELECT min(dz) AS lo, max(dz) - min(dz) AS ext FROM tv2)
 SELECT cust, seq, CAST(CASE WHEN dz - lo <= 0 THEN 0 WHEN dz - lo >= ext THEN 12 ELSE floor((dz - lo) / ext * 12) END AS INTEGER) AS band FROM tv2, b""",
        "tv2",
    ),
)
def p38(spark, sf):
    df = view(spark, sf, "tv2")
    lim = df.agg(F.min("dz").alias("lo"), (F.max("dz") - F.min("dz")).alias("ext"))
    return df.crossJoin(F.broadcast(lim)).select(
        "cust", "seq", B.depth_band(F.col("dz"), F.col("lo"), F.col("ext"), 13).alias("band")
    )


_DAYS = "CAST(date_diff('day', DATE '1900-01-01', date1) AS INTEGER)"


@query(
    "p40_date_fraction",
    with_views(
        f"""WITH b AS (SELECT min({_DAYS}) AS lo, max({_DAYS}) - min({_DAYS}) AS ext FROM tv2)
 SELECT cust, seq, {r(f'({_DAYS} - lo) / CAST(ext AS DOUBLE)')} AS share FROM tv2, b""",
        "tv2",
    ),
)
def p40(spark, sf):
    df = view(spark, sf, "tv2").withColumn("days", D.days_since_1900(F.col("date1")))
    lim = df.agg(F.min("days").alias("lo"), (F.max("days") - F.min("days")).alias("ext"))
    return df.crossJoin(F.broadcast(lim)).select(
        "cust", "seq",
        r6(B.date_fraction(F.col("days"), F.col("days"), F.col("lo"), F.col("ext"))).alias("share"),
    )


@query(
    "p41_error_fraction",
    f"SELECT {KEY}, CASE WHEN l_quantity - 5 >= 0 THEN {r('least((l_quantity - 5) / 12, 1e0)')} END AS share FROM lineitem",
)
def p41(spark, sf):
    return table(spark, sf, "lineitem").select(
        *KEYS, r6(B.error_fraction(F.col("l_quantity") - 5)).alias("share")
    )


@query(
    "p42_gradient_fraction",
    with_views(
        f"SELECT cust, seq, {r('abs(atan2(dz, sqrt(dx * dx + dy * dy))) / (pi() / 2)')} AS share FROM tv2", "tv2"
    ),
)
def p42(spark, sf):
    d = V.vec(F.col("dx"), F.col("dy"), F.col("dz"))
    return view(spark, sf, "tv2").select("cust", "seq", r6(B.gradient_fraction(d)).alias("share"))


@query(
    "p43_length_fraction",
    with_views(
        f"SELECT cust, seq, {r(f'least(greatest(log10({_LEN}) / 15e-1, 0e0), 1e0)')} AS share FROM tv2", "tv2"
    ),
)
def p43(spark, sf):
    d = V.vec(F.col("dx"), F.col("dy"), F.col("dz"))
    return view(spark, sf, "tv2").select("cust", "seq", r6(B.length_fraction(V.norm(d))).alias("share"))


@query(
    "p44_survey_hash",
    f"""WITH {_TV4} SELECT o_orderkey, list_reduce(list_transform(range(length(name), 0, -1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT)),
   lambda acc, c: (acc * 29363 + c) % 4294967296, CAST(0 AS BIGINT)) AS hash FROM tv4""",
)
def p44(spark, sf):
    return names_view(spark, sf).select("o_orderkey", B.survey_hash(F.col("name")).alias("hash"))


@query(
    "p45_parse_dms",
    f"""SELECT {KEY}, {r("CASE l_linenumber % 4 WHEN 0 THEN -(l_orderkey % 180 + l_partkey % 60 / 6e1 + l_suppkey % 60 / 36e2) WHEN 1 THEN (l_orderkey % 400) * 9e-1 WHEN 2 THEN (l_orderkey % 6400) * 180 / 32e2 ELSE l_orderkey % 180 + l_partkey % 60 / 6e1 END")} AS angle FROM lineitem""",
)
def p45(spark, sf):
    o, p, s = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    k = F.col("l_linenumber") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("-"), (o % 180).cast("string"), F.lit(":"), (p % 60).cast("string"), F.lit(":"), (s % 60).cast("string")))
        .when(k == 1, F.concat((o % 400).cast("string"), F.lit("g")))
        .when(k == 2, F.concat((o % 6400).cast("string"), F.lit("m")))
        .otherwise(F.concat((o % 180).cast("string"), F.lit(":"), (p % 60).cast("string")))
    )
    return table(spark, sf, "lineitem").select(*KEYS, r6(U.parse_dms(text)).alias("angle"))


@query(
    "p46_parse_hemisphere",
    f"""SELECT {KEY}, {r("CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * (l_orderkey % 90 + l_partkey % 60 / 6e1 + l_suppkey % 60 / 36e2)")} AS angle FROM lineitem""",
)
def p46(spark, sf):
    o, p, s = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    text = F.concat(
        F.when(F.col("l_linenumber") % 2 == 0, "N").otherwise("W"),
        (o % 90).cast("string"), F.lit(":"), (p % 60).cast("string"), F.lit(":"), (s % 60).cast("string"),
    )
    return table(spark, sf, "lineitem").select(*KEYS, r6(U.parse_hemisphere(text)).alias("angle"))
