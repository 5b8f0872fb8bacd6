"""Data-quality rules: each gives rows (rule, severity, station, reading_id, detail).

Rules over single rows are filters without a shuffle; the others are anti joins or
grouped counts. `report` unions any of them and `gate` turns them into a verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legnet.functions import readings as R
from legnet.functions.names import ancestors
from legnet.functions.vec import is_exact
from legnet.operators.joins import first_fixes
from legnet.operators.reduce import Calibration, reduce_diving, reduce_normal

WARNING, ERROR = "warning", "error"

# Columns that each style needs.
REQUIRED = {
    "NORMAL": ("from_stn", "to_stn", "tape"),
    "DIVING": ("from_stn", "to_stn", "tape"),
    "CARTESIAN": ("from_stn", "to_stn", "dx", "dy", "dz"),
    "CYLPOLAR": ("from_stn", "to_stn", "tape"),
    "NOSURVEY": ("from_stn", "to_stn"),
}


def _rows(df: DataFrame, rule: str, severity, station=None, reading=None, detail=None) -> DataFrame:
    def col(value, kind):
        if value is None:
            return F.lit(None).cast(kind)
        return value if isinstance(value, Column) else F.lit(value)

    return df.select(
        F.lit(rule).alias("rule"),
        col(severity, "string").alias("severity"),
        col(station, "string").alias("station"),
        (F.col("reading_id") if reading is None and "reading_id" in df.columns else col(reading, "bigint"))
        .cast("bigint")
        .alias("reading_id"),
        col(detail, "string").alias("detail"),
    )


def same_station(legs: DataFrame, severity=ERROR) -> DataFrame:
    """Q1: a leg with one station at both ends."""
    hit = legs.where(F.col("from_stn") == F.col("to_stn"))
    return _rows(hit, "Q1", severity, F.col("from_stn"))


def unused_fixes(fixes: DataFrame, legs: DataFrame, equates: DataFrame | None = None) -> DataFrame:
    """Q2: a fixed station that no leg or equate uses."""
    used = legs.select(F.explode(F.array("from_stn", "to_stn")).alias("station"))
    if equates is not None:
        used = used.unionByName(equates.select(F.explode(F.array("a", "b")).alias("station")))
    hit = fixes.select("station").distinct().join(used, "station", "left_anti")
    return _rows(hit, "Q2", WARNING, F.col("station"))


def _several_places(groups: DataFrame, key: str, rule: str) -> DataFrame:
    apart = (
        (F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")) | (F.col("z1") != F.col("z2"))
    )
    return _rows(
        groups.where(F.col("n") > 1), rule, F.when(apart, ERROR).otherwise(WARNING), F.col(key),
        detail=F.when(apart, "different coordinates").otherwise("same coordinates"),
    )


def _spans():
    out = [F.count(F.lit(1)).alias("n")]
    for a in "xyz":
        out += [F.min(a).alias(f"{a}1"), F.max(a).alias(f"{a}2")]
    return out


def fixed_twice(fixes: DataFrame) -> DataFrame:
    """Q3: a station fixed more than once; an error if the places differ."""
    return _several_places(fixes.groupBy("station").agg(*_spans()), "station", "Q3")


def equated_fixes(fixes: DataFrame, classes: DataFrame) -> DataFrame:
    """Q4: fixed stations equated to each other; an error if the places differ."""
    once = first_fixes(fixes).select("station", "x", "y", "z")
    groups = once.join(classes, "station").groupBy("class").agg(*_spans())
    return _several_places(groups, "class", "Q4")


def self_equates(equates: DataFrame) -> DataFrame:
    """Q5: a station equated to itself."""
    return _rows(equates.where(F.col("a") == F.col("b")), "Q5", WARNING, F.col("a"))


def disagreements(readings: DataFrame, cal: Calibration | None = None) -> DataFrame:
    """Q6: fore and back readings more than three standard deviations apart."""
    worked = reduce_normal(readings, cal, keep_work=True)
    kinds = F.array(
        *[
            F.when(F.col(f"{c}.disagree"), F.lit(n))
            for c, n in (("_tape", "tape"), ("_comp", "compass"), ("_clin", "clino"))
        ]
    )
    hit = worked.select("reading_id", "from_stn", F.explode(F.array_compact(kinds)).alias("kind"))
    return _rows(hit, "Q6", WARNING, F.col("from_stn"), detail=F.col("kind"))


def suspicious_compass(readings: DataFrame, cal: Calibration | None = None) -> DataFrame:
    """Q7: a bearing outside a full circle."""
    cal = cal or Calibration()
    kinds = F.array(
        *[
            F.when(R.bearing_suspicious(F.col(c) * cal(q)["unit"]), F.lit(c))
            for c, q in (("compass", "bearing"), ("backcompass", "backbearing"))
            if c in readings.columns
        ]
    )
    hit = readings.select("reading_id", "from_stn", F.explode(F.array_compact(kinds)).alias("kind"))
    return _rows(hit, "Q7", WARNING, F.col("from_stn"), detail=F.col("kind"))


def steep_clino(readings: DataFrame, cal: Calibration | None = None) -> DataFrame:
    """Q8: a slope over a right angle; from 0 to 180 where the zero error is near 90."""
    cal = cal or Calibration()
    kinds = []
    quarter = R.math.pi / 2
    for c, q in (("clino", "gradient"), ("backclino", "backgradient")):
        if c not in readings.columns:
            continue
        value = F.col(c) * cal(q)["unit"]
        zero = F.lit(cal(q)["zero"])
        half_circle = (zero > quarter / 2) & (zero < 1.5 * quarter)
        over = F.abs(value) - quarter > R.EPSILON
        outside = (value < 0.0) | (value - 2 * quarter > R.EPSILON)
        kinds.append(F.when(F.when(half_circle, outside).otherwise(over), F.lit(c)))
    hit = readings.select(
        "reading_id", "from_stn", F.explode(F.array_compact(F.array(*kinds))).alias("kind")
    )
    return _rows(hit, "Q8", WARNING, F.col("from_stn"), detail=F.col("kind"))


def negative_tape(readings: DataFrame, cal: Calibration | None = None) -> DataFrame:
    """Q9: a length that is negative after calibration."""
    worked = reduce_normal(readings, cal, keep_work=True)
    return _rows(worked.where(F.col("_tape.value") < 0), "Q9", WARNING, F.col("from_stn"))


def tape_under_depth(readings: DataFrame, cal: Calibration | None = None) -> DataFrame:
    """Q10: a length shorter than the change of depth."""
    from legnet.operators.reduce import _depth_change, with_tape

    cal = cal or Calibration()
    worked = with_tape(readings, cal)
    hit = worked.where(F.col("_tape.value") < F.abs(_depth_change(worked, cal)))
    return _rows(hit, "Q10", WARNING, F.col("from_stn"))


_REJECT_RULE = {
    "tape missing": "Q11",
    "compass missing": "Q11",
    "plumbed in same direction": "Q13",
    "clino types differ": "Q13",
}


def rejected_readings(readings: DataFrame, cal: Calibration | None = None, **options) -> DataFrame:
    """Q11 and Q13: readings that cannot become a leg, with the reason."""
    hit = reduce_normal(readings, cal, **options).where(F.col("reject").isNotNull())
    pairs = [F.lit(v) for kv in _REJECT_RULE.items() for v in kv]
    out = _rows(hit, "Q11", ERROR, F.col("from_stn"), detail=F.col("reject"))
    return out.withColumn("rule", F.coalesce(F.create_map(*pairs)[F.col("detail")], F.lit("Q11")))


def compass_on_plumb(readings: DataFrame, cal: Calibration | None = None, **options) -> DataFrame:
    """Q12: a bearing given on a plumbed leg.

    An inferred plumb may carry a bearing of 0 (and a back bearing of 0 or 180).
    """
    worked = reduce_normal(readings, cal, keep_work=True, **options)
    fore, back = F.col("_fore.ctype"), F.col("_back.ctype")
    raw, raw_back = F.col("_raw_comp"), F.col("_raw_backcomp")
    given = raw.isNotNull() | raw_back.isNotNull()
    plain = F.coalesce(raw, F.lit(0.0)) == 0.0
    plain_back = (F.coalesce(raw_back, F.lit(0.0)) == 0.0) | (
        F.abs(raw_back - R.math.pi) <= R.EPSILON
    )
    hit = given & (
        (fore == "PLUMB") | ((fore == "INFERPLUMB") & ~plain)
        | (back == "PLUMB") | ((back == "INFERPLUMB") & ~plain_back)
    )
    return _rows(worked.where(hit), "Q12", WARNING, F.col("from_stn"))


def never_used(marks: DataFrame, legs: DataFrame, kind: str) -> DataFrame:
    """Q14: a station marked as entrance or exported that no leg uses."""
    used = legs.select(F.explode(F.array("from_stn", "to_stn")).alias("station"))
    hit = marks.select("station").distinct().join(used, "station", "left_anti")
    return _rows(hit, "Q14", WARNING, F.col("station"), detail=kind)


def not_exported(depths: DataFrame, exports: DataFrame) -> DataFrame:
    """Q15: a station used from more levels up than it is exported to.

    depths: from `export_depth`; exports: (station, levels).
    """
    declared = exports.groupBy("station").agg(F.max("levels").alias("declared"))
    hit = depths.join(declared, "station", "left").where(
        F.col("levels") > F.coalesce("declared", F.lit(0))
    )
    return _rows(hit, "Q15", ERROR, F.col("station"), detail=F.col("levels").cast("string"))


def probable_typos(uses: DataFrame) -> DataFrame:
    """Q16: a name used just once, with its survey written out.

    uses: (station, explicit) for every use of a name.
    """
    hit = (
        uses.groupBy("station")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or("explicit").alias("explicit"))
        .where((F.col("n") == 1) & F.col("explicit"))
    )
    return _rows(hit, "Q16", WARNING, F.col("station"))


def station_and_survey(names: DataFrame, sep=".") -> DataFrame:
    """Q17: a name that is a station and also a survey of other stations."""
    distinct = names.select(F.col(names.columns[0]).alias("station")).distinct()
    surveys = distinct.select(F.explode(ancestors(F.col("station"), sep)).alias("station"))
    return _rows(distinct.join(surveys, "station", "left_semi"), "Q17", ERROR, F.col("station"))


def bad_dates(df: DataFrame, today: str, text: str = "date_text") -> DataFrame:
    """Q18: dates in the future, reversed ranges, invalid years, months or days."""
    from legnet.functions.dates import parse_partial_date

    worked = df.withColumn("_p", parse_partial_date(F.col(text)))
    future = F.col("_p.date1") > F.lit(today).cast("date")
    problem = F.coalesce(F.col("_p.problem"), F.when(future, "date in the future"))
    severity = F.when(F.col("detail") == "range reversed", ERROR).otherwise(WARNING)
    hit = worked.withColumn("_d", problem).where(F.col("_d").isNotNull())
    return _rows(hit, "Q18", WARNING, detail=F.col("_d")).withColumn("severity", severity)


def unknown_xsects(rejects: DataFrame) -> DataFrame:
    """Q19: cross-sections at stations that do not exist (see `place_xsects`)."""
    return _rows(rejects, "Q19", ERROR, F.col("station"))


def unattached(hanging_stations: DataFrame) -> DataFrame:
    """Q20: stations not attached to a fixed one (see `hanging`)."""
    return _rows(hanging_stations, "Q20", WARNING, F.col("name"))


def anonymous_legs(legs: DataFrame) -> DataFrame:
    """Q21: a leg between two unnamed stations."""
    hit = legs.where(R.is_anon_name(F.col("from_stn")) & R.is_anon_name(F.col("to_stn")))
    return _rows(hit, "Q21", ERROR)


def bad_settings(settings: DataFrame) -> DataFrame:
    """Q22: a standard deviation that is not positive; a unit or scale of zero."""
    problem = (
        F.when(F.col("sd") <= 0, "standard deviation not positive")
        .when(F.col("unit") == 0, "unit is zero")
        .when(F.col("scale") == 0, "scale is zero")
    )
    hit = settings.withColumn("_d", problem).where(F.col("_d").isNotNull())
    return _rows(hit, "Q22", ERROR, F.col("scope"), detail=F.concat_ws(": ", "quantity", "_d"))


def missing_columns(readings: DataFrame) -> DataFrame:
    """Q23: a required column of the row's style is empty."""
    gaps = []
    for style, names in REQUIRED.items():
        for n in names:
            empty = F.col(n).isNull() if n in readings.columns else F.lit(True)
            gaps.append(F.when((F.col("style") == style) & empty, F.lit(n)))
    hit = readings.withColumn("_gap", F.explode(F.array_compact(F.array(*gaps))))
    station = F.col("from_stn") if "from_stn" in readings.columns else None
    return _rows(hit, "Q23", ERROR, station, detail=F.col("_gap"))


def infer_equates(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q24: (readings, equates): legs of no length at one depth become equates."""

    def nothing(name):
        return (F.coalesce(F.col(name), F.lit(0.0)) == 0.0) if name in readings.columns else F.lit(True)

    flat = F.lit(True)
    if {"from_depth", "to_depth"} <= set(readings.columns):
        flat = F.coalesce("from_depth", F.lit(0.0)) == F.coalesce("to_depth", F.lit(0.0))
    hit = nothing("tape") & nothing("backtape") & flat
    equates = readings.where(hit & (F.col("from_stn") != F.col("to_stn"))).select(
        F.col("from_stn").alias("a"), F.col("to_stn").alias("b")
    )
    return readings.where(~hit), equates


def exact_legs(legs: DataFrame) -> DataFrame:
    """Q26: a leg without a variance, which the adjustment refuses.

    A warning for one of length zero (its stations should be equated), else an error.
    """
    length2 = sum((F.col(f"d.{a}") * F.col(f"d.{a}") for a in "yz"), F.col("d.x") * F.col("d.x"))
    severity = F.when(length2 == 0.0, WARNING).otherwise(ERROR)
    detail = F.concat(F.col("from_stn"), F.lit(" "), F.col("to_stn"))
    return _rows(legs.where(is_exact(F.col("v"))), "Q26", severity, F.col("from_stn"), detail=detail)


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class QualityError(Exception):
    pass


def gate(problems: DataFrame, warnings_too=False) -> None:
    """Q25: raises if there is any error (or any warning, if asked)."""
    bad = problems if warnings_too else problems.where(F.col("severity") == ERROR)
    first = bad.limit(1).collect()
    if first:
        r = first[0]
        raise QualityError(f"{r.rule} {r.severity}: {r.station or r.reading_id} {r.detail or ''}")


def gated(df: DataFrame, problems: DataFrame, warnings_too=False) -> DataFrame:
    """df if nothing is wrong, else no rows; as a plan, without an action."""
    bad = problems if warnings_too else problems.where(F.col("severity") == ERROR)
    verdict = bad.limit(1).agg((F.count(F.lit(1)) == 0).alias("_ok"))
    return df.crossJoin(F.broadcast(verdict)).where("_ok").drop("_ok")
