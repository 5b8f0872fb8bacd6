"""Joins of survey tables: positions, fixes, settings, declination, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legnet.functions.geometry import measure
from legnet.functions.names import ancestors, depth_of
from legnet.functions.vec import cov, vec
from legnet.plans.scan import CHUNK, ordered_scan
from legnet.plans.skew import lookup
from legnet.schema import LEG_SPLAY, LEG_SURFACE, STN_ENTRANCE, STN_EXPORTED
from legnet.schema import STN_FIXED, STN_SURFACE, STN_UNDERGROUND


#: Days and epochs (two numbers each) that one scan window holds.
DAYS_PER_CHUNK = 4000


def _ends(positions: DataFrame, side: str) -> DataFrame:
    return positions.select(
        F.col("name").alias(f"{side}_stn"), vec(*[F.col(a) for a in "xyz"]).alias(f"{side}_pos")
    )


def with_positions(
    legs: DataFrame, positions: DataFrame, how="inner", rows: int | None = None
) -> DataFrame:
    """Legs with the positions of both ends; positions has one row per name."""
    for side in ("from", "to"):
        legs = lookup(legs, f"{side}_stn", _ends(positions, side), rows, how)
    return legs


def solved_links(links: DataFrame, positions: DataFrame, rows: int | None = None) -> DataFrame:
    """Links without measurements whose two ends both have a position."""
    return with_positions(links, positions, "inner", rows)


def place_xsects(xsects: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cross-sections with a position, cross-sections at unknown stations)."""
    at = stations.select(F.col("name").alias("station"), "x", "y", "z")
    placed = lookup(xsects, "station", at)
    return placed, xsects.join(at.select("station"), "station", "left_anti")


def anchor_name(station: Column) -> Column:
    return F.concat(F.lit("\u0000anchor:"), station)


def first_fixes(fixes: DataFrame, key: str = "station") -> DataFrame:
    """One fix per station: the first by `seq`.

    Equal numbers, or a table without them, are put in order by the place, so the
    choice never changes between runs.
    """
    turn = [F.col(c) for c in ("seq", "x", "y", "z") if c in fixes.columns]
    rest = [c for c in fixes.columns if c != key]
    return fixes.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*turn)).alias("_f")).select(key, "_f.*")


def apply_fixes(legs: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(legs with anchor legs for uncertain fixes, pinned points).

    An exact fix pins its station. An uncertain one pins an unnamed anchor at the
    given place and ties the station to it by a leg of length zero that has the
    covariance of the fix. Of several fixes of one station the first counts
    (`quality.fixed_twice` reports the others).
    """
    first = first_fixes(fixes)
    exact = F.coalesce(F.col("sdx"), F.lit(0.0)) == 0.0
    sure = first.where(exact).select(F.col("station").alias("name"), "x", "y", "z")
    unsure = first.where(~exact)
    anchors = unsure.select(anchor_name(F.col("station")).alias("name"), "x", "y", "z")
    sdy = F.coalesce(F.col("sdy"), F.col("sdx"))
    sdz = F.coalesce(F.col("sdz"), F.col("sdx"))
    zero = F.lit(0.0)
    ties = unsure.select(
        anchor_name(F.col("station")).alias("from_stn"),
        F.col("station").alias("to_stn"),
        vec(zero, zero, zero).alias("d"),
        cov(
            F.col("sdx") * F.col("sdx"), sdy * sdy, sdz * sdz,
            F.coalesce("cxy", zero), F.coalesce("czx", zero), F.coalesce("cyz", zero),
        ).alias("v"),
        F.lit(True).alias("fake"),
    )
    all_legs = legs.withColumn("fake", F.lit(False)).unionByName(ties, allowMissingColumns=True)
    return all_legs, sure.unionByName(anchors)


def resolve_settings(
    readings: DataFrame, settings: DataFrame, quantities: list[str], sep=".",
    chunk: int = CHUNK,
) -> DataFrame:
    """Readings with the setting in force for each quantity.

    A reading takes the latest earlier setting of its own scope, else of the
    nearest outer scope that has one. Readings meet settings in one ordered scan
    per scope. Adds a struct column cal_<quantity>(unit, zero, scale, sd).
    """
    value = F.struct("unit", "zero", "scale", "sd")
    events = settings.select(
        F.col("scope").alias("_scope"),
        (F.col("seq") * 2).alias("_seq"),
        F.lit(None).cast("long").alias("reading_id"),
        *[F.when(F.col("quantity") == q, value).alias(f"s_{q}") for q in quantities],
    )
    # One row per scope and sequence number, as several quantities may share it.
    events = events.groupBy("_scope", "_seq", "reading_id").agg(
        *[F.first(f"s_{q}", ignorenulls=True).alias(f"s_{q}") for q in quantities]
    )
    # Distinct places suffice: readings at one place share their settings.
    own = F.concat(ancestors(F.col("scope"), sep), F.array(F.col("scope")), F.array(F.lit("")))
    probes = readings.select(
        F.explode(F.array_distinct(own)).alias("_scope"),
        (F.col("seq") * 2 + 1).alias("_seq"),
        "reading_id",
    )
    # A unique order inside a scope: settings are even, readings odd.
    both = events.unionByName(probes, allowMissingColumns=True)
    seen = ordered_scan(
        both, ["_scope"], "_seq", carry={f"c_{q}": F.col(f"s_{q}") for q in quantities},
        chunk=chunk,
    ).where(F.col("reading_id").isNotNull())
    depth = depth_of(F.col("_scope"), sep)
    nearest = seen.groupBy("reading_id").agg(
        *[
            F.max_by(f"c_{q}", F.when(F.col(f"c_{q}").isNotNull(), depth)).alias(f"cal_{q}")
            for q in quantities
        ]
    )
    return readings.join(nearest, "reading_id", "left")


def declination_at(
    readings: DataFrame, table: DataFrame, days1="days1", days2="days2", convergence=0.0
) -> DataFrame:
    """Adds `declination` (as the table's unit) of the middle of the date range.

    `table` has (epoch, declination, rate per day). Between epochs the value is
    linear, after the last it follows the rate. There are at most as many distinct
    days as the calendar allows, so days meet epochs in a small ordered scan and
    the result is a lookup by day.
    """
    middle = F.col(days1) + F.floor((F.col(days2) - F.col(days1)) / 2).cast("int")
    dated = readings.withColumn("_day", middle)
    days = dated.where(F.col("_day").isNotNull()).select("_day").distinct()
    marks = (
        table.groupBy(F.col("epoch").alias("_day"))
        .agg(F.min(F.struct("declination", "rate")).alias("e"))
        .select("_day", F.col("e.declination").alias("d0"), F.col("e.rate").alias("r0"))
    )
    every = days.withColumns(
        {"d0": F.lit(None).cast("double"), "r0": F.lit(None).cast("double"), "_ask": F.lit(1)}
    ).unionByName(marks.withColumn("_ask", F.lit(0)))
    # One row per day and kind, scanned forwards and backwards in chunks of days.
    here = F.when(F.col("_ask") == 0, F.struct("_day", "d0", "r0"))
    ordered = every.withColumns(
        {"_all": F.lit(0), "_seq": F.col("_day").cast("long") * 2 + F.col("_ask")}
    )
    scanned = ordered_scan(ordered, ["_all"], "_seq", carry={"p": here}, chunk=DAYS_PER_CHUNK)
    scanned = scanned.withColumn("_back", -F.col("_seq"))
    known = ordered_scan(scanned, ["_all"], "_back", carry={"n": here}, chunk=DAYS_PER_CHUNK)
    known = known.where(F.col("_ask") == 1)
    p, n = F.col("p"), F.col("n")
    share = (F.col("_day") - p["_day"]) / (n["_day"] - p["_day"])
    value = (
        F.when(n.isNotNull() & p.isNotNull(), p["d0"] + share * (n["d0"] - p["d0"]))
        .when(p.isNotNull(), p["d0"] + (F.col("_day") - p["_day"]) * p["r0"])
        .otherwise(n["d0"])
    )
    per_day = known.select("_day", (value - convergence).alias("declination"))
    return dated.join(per_day, "_day", "left").drop("_day")


def degrees_of(legs: DataFrame) -> DataFrame:
    """(name, degree): number of leg ends at every station."""
    ends = legs.select(F.explode(F.array("from_stn", "to_stn")).alias("name"))
    return ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def attach_splays(legs: DataFrame) -> DataFrame:
    """Splays with (station, free_end, problem).

    A splay hangs on the end that has other legs; its other end must have none.
    """
    splay = F.col("flags").bitwiseAND(F.lit(LEG_SPLAY)) != 0
    solid = degrees_of(legs.where(~splay)).select("name", F.lit(True).alias("solid"))
    out = legs.where(splay)
    for side in ("from", "to"):
        mark = solid.select(F.col("name").alias(f"{side}_stn"), F.col("solid").alias(f"{side}_solid"))
        out = out.join(mark, f"{side}_stn", "left")
    f, t = F.col("from_solid").isNotNull(), F.col("to_solid").isNotNull()
    ok = f != t
    return out.withColumns(
        {
            "station": F.when(ok, F.when(f, F.col("from_stn")).otherwise(F.col("to_stn"))),
            "free_end": F.when(ok, F.when(f, F.col("to_stn")).otherwise(F.col("from_stn"))),
            "problem": F.when(f & t, "not a dead end").when(~f & ~t, "isolated"),
        }
    ).drop("from_solid", "to_solid")


def point_key(x: Column, y: Column, z: Column, digits=6) -> Column:
    """Equality key of a place, free of negative zeros."""
    return F.concat_ws("|", *[F.round(c, digits).cast("decimal(28,6)").cast("string") for c in (x, y, z)])


def name_at(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points with the name of the first label at the same place."""
    key = point_key(F.col("x"), F.col("y"), F.col("z"))
    first = labels.groupBy(key.alias("_at")).agg(F.min_by("name", "seq").alias("name"))
    return points.withColumn("_at", key).join(first, "_at", "left").drop("_at")


def measure_from(stations: DataFrame, name: str) -> DataFrame:
    """Distance, bearing and slope from one station to all others."""
    start = stations.where(F.col("name") == name).limit(1).select(
        vec(F.col("x"), F.col("y"), F.col("z")).alias("_from")
    )
    here = vec(F.col("x"), F.col("y"), F.col("z"))
    return (
        stations.crossJoin(F.broadcast(start))
        .withColumn("m", measure(F.col("_from"), here))
        .select("name", "m.*")
        .where(F.col("name") != name)
    )


def attach_traverse_errors(legs: DataFrame, errors: DataFrame) -> DataFrame:
    """Legs with the error figures of their traverse; none where all are zero."""
    live = errors.where((F.col("E") != 0) | (F.col("H") != 0) | (F.col("V") != 0))
    return lookup(legs, "trav_id", live.select("trav_id", "n_legs", "length", "E", "H", "V"), how="left")


def station_flags(
    legs: DataFrame,
    stations: DataFrame,
    entrances: DataFrame | None = None,
    fixes: DataFrame | None = None,
    exports: DataFrame | None = None,
) -> DataFrame:
    """Stations with their marks and the surface/underground bits of their legs."""
    surface = F.col("flags").bitwiseAND(F.lit(LEG_SURFACE)) != 0
    marks = legs.select(
        F.explode(F.array("from_stn", "to_stn")).alias("name"),
        F.when(surface, STN_SURFACE).otherwise(STN_UNDERGROUND).alias("bit"),
    )
    for table, bit in ((entrances, STN_ENTRANCE), (fixes, STN_FIXED), (exports, STN_EXPORTED)):
        if table is not None:
            marks = marks.unionByName(
                table.select(F.col("station").alias("name"), F.lit(bit).alias("bit"))
            )
    merged = marks.groupBy("name").agg(F.bit_or("bit").alias("sflags"))
    return stations.join(merged, "name", "left").withColumn(
        "sflags", F.coalesce("sflags", F.lit(0))
    )
