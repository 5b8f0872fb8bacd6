"""Filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from legnet.checks.scalars import (
    COMPASS_STEPS, KEY, KEYS, NAMES_SQL, NORMAL, PLUMB2, POSVAR, SD2, _no_counts, names_view, r6,
)
from legnet.checks.views import r, table, view, with_views
from legnet.functions import bands as B
from legnet.functions import dates as D
from legnet.functions import geometry as G
from legnet.functions import names as N
from legnet.functions import readings as R
from legnet.functions import vec as V
from legnet.operators import aggregates as A
from legnet.operators import diff as DF
from legnet.operators import filters as FL
from legnet.operators import joins as J
from legnet.operators import order as O
from legnet.operators import passages as PS
from legnet.operators import reduce as X
from legnet.operators import windows as W
from legnet.plans.scan import segment

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- filters


@query(
    "f1_in_survey",
    f"""WITH {NAMES_SQL} SELECT o_orderkey, name LIKE 'N1.%' AS station_in,
 concat(split_part(name, '.', 1), '.', split_part(name, '.', 2)) LIKE 'N1.%' OR split_part(name, '.', 1) = 'N1' AS leg_in FROM tv4""",
)
def f1(spark, sf):
    n = F.col("name")
    return names_view(spark, sf).select(
        "o_orderkey",
        FL.in_survey(n, "N1").alias("station_in"),
        FL.in_survey(N.survey_of(n), "N1", station=False).alias("leg_in"),
    )


@query(
    "s6_sub_survey",
    f"WITH {NAMES_SQL} SELECT o_orderkey, substr(name, 4) AS name FROM tv4 WHERE name LIKE 'N1.%'",
)
def s6(spark, sf):
    return FL.sub_survey(names_view(spark, sf), "name", "N1.").select("o_orderkey", "name")


@query(
    "f2_visible",
    f"""WITH {NAMES_SQL} SELECT o_orderkey FROM tv4 WHERE c_nationkey IN (1, 2, 3)
 OR (o_custkey % 10 = 0 AND o_orderkey % 3 <> 0)""",
)
def f2(spark, sf):
    df = names_view(spark, sf)
    picks = df.where(F.col("c_nationkey").isin(1, 2, 3)).select(
        N.survey_of(N.survey_of(F.col("name"))).alias("prefix")
    ).unionAll(
        df.where((F.col("o_custkey") % 10 == 0) & (F.col("o_orderkey") % 3 != 0)).select(
            N.survey_of(F.col("name")).alias("prefix")
        )
    )
    return FL.visible(df, "name", picks).select("o_orderkey")


@query(
    "f3_leg_flags",
    with_views(f"SELECT {KEY}, flags FROM tv1 WHERE flags & 6 <> 0 AND flags & 4 = 0", "tv1"),
)
def f3(spark, sf):
    return view(spark, sf, "tv1").where(FL.leg_flags(F.col("flags"), any_of=6, none_of=4)).select(*KEYS, "flags")


@query(
    "f4_station_class",
    with_views(
        """SELECT name, CASE WHEN k % 7 = 0 THEN 'ENTRANCE' WHEN k % 11 = 0 THEN 'FIXED' WHEN k % 5 = 0 THEN 'EXPORTED' ELSE 'PLAIN' END AS class FROM tvs""",
        "tvs",
    ),
)
def f4(spark, sf):
    return view(spark, sf, "tvs").select("name", FL.station_class(F.col("sflags")).alias("class"))


@query("f5_named", with_views("SELECT name FROM tvs WHERE k % 13 <> 0", "tvs"))
def f5(spark, sf):
    return view(spark, sf, "tvs").where(FL.named(F.col("sflags"))).select("name")


@query(
    "f6_sink_mask",
    with_views(
        "SELECT count(*) AS stations, 'entrances,labels' AS features FROM tvs WHERE k % 13 <> 0", "tvs"
    ),
)
def f6(spark, sf):
    mask = FL.sink_mask("csv", {"labels", "entrances", "legs"})
    df = view(spark, sf, "tvs")
    if "anonymous" not in mask:
        df = df.where(FL.named(F.col("sflags")))
    return df.agg(F.count(F.lit(1)).alias("stations")).withColumn("features", F.lit(",".join(sorted(mask))))


@query(
    "f7_find_stations",
    f"""WITH {NAMES_SQL} SELECT o_orderkey, contains(lower(name), 'cust1') AS part,
 regexp_matches(lower(name), '^n.\\.cust.*7$') AS whole, contains(name, '.') AS dot FROM tv4""",
)
def f7(spark, sf):
    n = F.col("name")
    return names_view(spark, sf).select(
        "o_orderkey",
        FL.find_stations(n, "CUST1").alias("part"),
        FL.find_stations(n, "n?.cust*7").alias("whole"),
        FL.find_stations(n, ".").alias("dot"),
    )


@query("f8_excluded_shot", f"SELECT {KEY} FROM lineitem WHERE l_orderkey % 7 <> 0")
def f8(spark, sf):
    df = table(spark, sf, "lineitem").withColumn(
        "shot_flags", F.when(F.col("l_orderkey") % 7 == 0, "LX").when(F.col("l_orderkey") % 2 == 0, "L")
    )
    return FL.drop_excluded(df).select(*KEYS)


@query("f9_ignored_block", f"SELECT {KEY} FROM lineitem WHERE l_linestatus <> 'O'")
def f9(spark, sf):
    df = table(spark, sf, "lineitem").withColumn(
        "style", F.when(F.col("l_linestatus") == "O", "IGNORE").otherwise("NORMAL")
    )
    return FL.drop_ignored(df).select(*KEYS)


# ---------------------------------------------------------------- joins


def tv3_legs(spark, sf):
    df = view(spark, sf, "tv3")
    return df.select(
        "leg_id", "from_stn", "to_stn",
        V.vec(F.col("dx"), F.col("dy"), F.col("dz")).alias("d"),
        V.cov(F.col("vx"), F.col("vy"), F.col("vz")).alias("v"),
    )


def tv2_legs(spark, sf, name="tv2"):
    df = view(spark, sf, name)
    return df.select(
        "cust", "leg_id", "seq", "from_stn", "to_stn", "date1",
        V.vec(F.col("dx"), F.col("dy"), F.col("dz")).alias("d"),
        V.cov(F.col("vx"), F.col("vy"), F.col("vz")).alias("v"),
    )


@query(
    "j1_legs_with_positions",
    with_views(
        f"""SELECT t.leg_id, t.from_stn, t.to_stn, {r('b.x - a.x - t.dx')} AS ex, {r('b.y - a.y - t.dy')} AS ey, {r('b.z')} AS to_z
 FROM tv3 t JOIN tvs a ON a.name = t.from_stn JOIN tvs b ON b.name = t.to_stn""",
        "tv3", "tvs",
    ),
)
def j1(spark, sf):
    out = J.with_positions(tv3_legs(spark, sf), view(spark, sf, "tvs"))
    return out.select(
        "leg_id", "from_stn", "to_stn",
        r6(F.col("to_pos.x") - F.col("from_pos.x") - F.col("d.x")).alias("ex"),
        r6(F.col("to_pos.y") - F.col("from_pos.y") - F.col("d.y")).alias("ey"),
        r6(F.col("to_pos.z")).alias("to_z"),
    )


@query(
    "j2_solved_links",
    with_views(
        """SELECT l_orderkey, l_linenumber, concat('p', CAST(l_partkey AS VARCHAR)) AS from_stn, concat('s', CAST(l_suppkey AS VARCHAR)) AS to_stn, a.x AS x1, b.x AS x2
 FROM lineitem JOIN tvs a ON a.name = concat('p', CAST(l_partkey AS VARCHAR)) JOIN tvs b ON b.name = concat('s', CAST(l_suppkey AS VARCHAR))
 WHERE a.k % 4 <> 0 AND b.k % 3 <> 0""",
        "tvs",
    ),
)
def j2(spark, sf):
    solved = view(spark, sf, "tvs").where(
        (F.col("name").startswith("p") & (F.col("k") % 4 != 0))
        | (F.col("name").startswith("s") & (F.col("k") % 3 != 0))
    )
    links = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("from_stn"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to_stn"),
    )
    return J.solved_links(links, solved).select(
        "l_orderkey", "l_linenumber", "from_stn", "to_stn",
        F.col("from_pos.x").alias("x1"), F.col("to_pos.x").alias("x2"),
    )


def xsects_view(spark, sf):
    """Cross-sections: one tube per order, sections in line order."""
    df = table(spark, sf, "lineitem")
    return df.select(
        F.col("l_orderkey").alias("tube_id"),
        (F.col("l_linenumber") * 10**17 + F.col("l_partkey") * 10**8 + F.col("l_suppkey")).alias("seq"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("station"),
        (F.col("l_quantity") / 10).alias("l"),
        F.when(F.col("l_linenumber") % 3 == 0, -1.0).otherwise(F.col("l_quantity") / 20).alias("r"),
        (F.col("l_tax") * 10).alias("u"),
        (F.col("l_discount") * 10).alias("d"),
    )


XS = "xs AS (SELECT l_orderkey AS tube_id, l_linenumber * CAST(100000000000000000 AS BIGINT) + l_partkey * CAST(100000000 AS BIGINT) + l_suppkey AS seq, l_partkey, concat('p', CAST(l_partkey AS VARCHAR)) AS station, l_quantity / 10 AS l, CASE WHEN l_linenumber % 3 = 0 THEN -1e0 ELSE l_quantity / 20 END AS r, l_tax * 10 AS u, l_discount * 10 AS d FROM lineitem)"


@query(
    "j4_place_xsects",
    with_views(
        f"""WITH {XS} SELECT tube_id, seq, station, p.x AS x, p.z AS z, CAST(NULL AS VARCHAR) AS problem FROM xs JOIN tvs p ON p.name = station WHERE p.k % 4 <> 0
 UNION ALL SELECT tube_id, seq, station, NULL, NULL, 'unknown station' FROM xs WHERE l_partkey % 4 = 0""",
        "tvs",
    ),
)
def j4(spark, sf):
    known = view(spark, sf, "tvs").where(F.col("k") % 4 != 0)
    placed, rejects = J.place_xsects(xsects_view(spark, sf), known)
    none = F.lit(None).cast("double")
    return placed.select("tube_id", "seq", "station", "x", "z", F.lit(None).cast("string").alias("problem")).unionByName(
        rejects.select("tube_id", "seq", "station", none.alias("x"), none.alias("z"), F.lit("unknown station").alias("problem"))
    )


def fixes_view(spark, sf):
    s = view(spark, sf, "tvs").where(F.col("k") % 10 == 0)
    sd = F.when(F.col("k") % 20 == 0, 0.5)
    none = F.lit(None).cast("double")
    return s.select(
        F.col("name").alias("station"), "x", "y", "z", sd.alias("sdx"), none.alias("sdy"),
        (sd * 2).alias("sdz"), none.alias("cxy"), none.alias("cyz"), none.alias("czx"),
    )


@query(
    "j5_apply_fixes",
    with_views(
        """SELECT CAST(count(*) AS BIGINT) AS n, 'leg' AS kind, sum(CASE WHEN dx IS NULL THEN 0e0 ELSE round(vx, 6) END) AS vsum FROM tv3
 UNION ALL SELECT count(*), 'anchor leg', sum(25e-2 + 25e-2 + 1) FROM tvs WHERE k % 20 = 0
 UNION ALL SELECT count(*), 'pinned', round(sum(x), 4) FROM tvs WHERE k % 10 = 0""".replace(
            "sum(CASE WHEN dx IS NULL THEN 0e0 ELSE round(vx, 6) END)", "round(sum(vx), 4)"
        ).replace("sum(25e-2 + 25e-2 + 1)", "round(sum(15e-1), 4)"),
        "tv3", "tvs",
    ),
)
def j5(spark, sf):
    legs, pinned = J.apply_fixes(tv3_legs(spark, sf), fixes_view(spark, sf))
    one = legs.groupBy(F.when(F.col("fake"), "anchor leg").otherwise("leg").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.when(F.col("fake"), F.col("v.xx") + F.col("v.yy") + F.col("v.zz")).otherwise(F.col("v.xx"))), 4).alias("vsum"),
    )
    two = pinned.agg(F.lit("pinned").alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("vsum"))
    return one.unionByName(two).select("n", "kind", "vsum")


def versions(spark, sf):
    """Two versions of the named orders: rows dropped, added, moved."""
    o = table(spark, sf, "orders")
    base = o.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_totalprice") / 100).alias("x"), (F.col("o_custkey") * 1.0).alias("y"),
        (F.col("o_totalprice") / 1000).alias("z"), "o_orderkey",
    )
    k = F.col("o_orderkey")
    old = base.where(k % 11 != 0)
    new = base.where(k % 13 != 0).withColumns(
        {
            "x": F.when(k % 5 == 0, F.col("x") + 0.5).otherwise(F.col("x")),
            "y": F.when(k % 7 == 0, F.col("y") + 0.009).otherwise(F.col("y")),
            "z": F.when(k % 17 == 0, F.col("z") - 2).otherwise(F.col("z")),
        }
    )
    return old.drop("o_orderkey"), new.drop("o_orderkey")


_MOVES = "CASE WHEN o_orderkey % 5 = 0 THEN 5e-1 ELSE 0e0 END AS dx, CASE WHEN o_orderkey % 7 = 0 THEN 9e-3 ELSE 0e0 END AS dy, CASE WHEN o_orderkey % 17 = 0 THEN -2e0 ELSE 0e0 END AS dz"
_DIFF = f"""k AS (SELECT concat('o', CAST(o_orderkey AS VARCHAR)) AS name, o_orderkey, {_MOVES} FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 13 <> 0),
dd AS (SELECT name, CASE WHEN o_orderkey % 11 = 0 THEN 'Added' WHEN o_orderkey % 13 = 0 THEN 'Deleted' WHEN dx <> 0 OR dz <> 0 THEN 'Moved' ELSE 'Same' END AS status, dx, dy, dz FROM k)"""


@query(
    "j6_position_diff",
    f"""WITH {_DIFF} SELECT name, status, CASE WHEN status IN ('Added', 'Deleted') THEN NULL ELSE round(dx, 4) END AS dx,
 CASE WHEN status IN ('Added', 'Deleted') THEN NULL ELSE round(dy, 4) END AS dy, CASE WHEN status IN ('Added', 'Deleted') THEN NULL ELSE round(dz, 4) END AS dz FROM dd""",
)
def j6(spark, sf):
    out = DF.position_diff(*versions(spark, sf))
    return out.select("name", "status", *[F.round(c, 4).alias(c) for c in ("dx", "dy", "dz")])


@query(
    "j6_diff_repeated",
    """WITH o AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS gone FROM orders GROUP BY o_custkey)
 SELECT CAST(sum(n - gone) AS BIGINT) AS n, 'Same' AS status FROM o UNION ALL SELECT CAST(sum(gone) AS BIGINT), 'Deleted' FROM o""",
)
def j6b(spark, sf):
    """Labels repeated per customer at distinct places; some places vanish."""
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 1.0).alias("x"),
        F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
    )
    out = DF.position_diff(o, o.where(F.col("seq") % 11 != 0))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j6_moved_repeats",
    """WITH o AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS gone FROM orders GROUP BY o_custkey)
 SELECT CAST(sum(n - gone) AS BIGINT) AS n, 'Same' AS status FROM o UNION ALL SELECT CAST(sum(gone) AS BIGINT), 'Deleted' FROM o""",
)
def j6c(spark, sf):
    """Repeated labels that all move by half to the whole threshold, along several axes."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), k.alias("seq"),
        (k * 1.0 + 0.004).alias("x"), (k % 3 * 0.5).alias("y"), (k % 7 * 0.25).alias("z"),
    )
    moved = o.where(F.col("seq") % 11 != 0).withColumns(
        {
            "x": F.col("x") + 0.0095 * F.when(F.col("seq") % 2 == 0, 1).otherwise(-1),
            "y": F.col("y") - 0.006,
            "z": F.col("z") + F.when(F.col("seq") % 3 == 0, 0.0099).otherwise(0.005),
            "seq": -F.col("seq"),
        }
    )
    out = DF.position_diff(o, moved)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def settings_view(spark, sf):
    """Length calibration events: per nation survey and, for some, per customer."""
    c = table(spark, sf, "customer")
    outer = table(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("scope"),
        F.lit(-1).cast("long").alias("seq"), F.lit("length").alias("quantity"),
        F.lit(1.0).alias("unit"), (F.col("n_nationkey") * 1.0).alias("zero"),
        F.lit(1.0).alias("scale"), F.lit(0.05).alias("sd"),
    )
    inner = c.where(F.col("c_custkey") % 2 == 0).select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit(".c"), F.col("c_custkey").cast("string")).alias("scope"),
        F.lit(7000).cast("long").alias("seq"), F.lit("length").alias("quantity"),
        F.lit(0.3048).alias("unit"), (F.col("c_custkey") * 1000.0).alias("zero"),
        F.lit(1.0).alias("scale"), F.lit(0.1).alias("sd"),
    )
    return outer.unionByName(inner)


@query(
    "j7_resolve_settings",
    """SELECT o_orderkey AS reading_id, CASE WHEN o_custkey % 2 = 0 AND o_orderkey >= 7000 THEN o_custkey * 1e3 ELSE c_nationkey * 1e0 END AS zero,
 CASE WHEN o_custkey % 2 = 0 AND o_orderkey >= 7000 THEN 3.048e-1 ELSE 1e0 END AS unit, true AS no_bearing FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def j7(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    readings = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("reading_id"), F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit(".c"), F.col("o_custkey").cast("string")).alias("scope"),
    )
    out = J.resolve_settings(readings, settings_view(spark, sf), ["length", "bearing"])
    return out.select(
        "reading_id", F.col("cal_length.zero").alias("zero"), F.col("cal_length.unit").alias("unit"),
        F.col("cal_bearing").isNull().alias("no_bearing"),
    )


def epochs_view(spark, sf):
    """Declination epochs: one per region, five years apart from 1990."""
    k = F.col("r_regionkey")
    return table(spark, sf, "region").select(
        F.datediff(F.make_date(1990 + k * 4, F.lit(1), F.lit(1)), F.lit("1900-01-01").cast("date")).alias("epoch"),
        (-5.0 + 0.7 * k + 0.1 * k * k).alias("declination"), (0.0001 * (k + 1)).alias("rate"),
    )


_EPOCHS = "e AS (SELECT CAST(date_diff('day', DATE '1900-01-01', make_date(1990 + r_regionkey * 4, 1, 1)) AS INTEGER) AS epoch, -5e0 + 7e-1 * r_regionkey + 1e-1 * r_regionkey * r_regionkey AS declination, 1e-4 * (r_regionkey + 1) AS rate FROM region), ee AS (SELECT *, lead(epoch) OVER (ORDER BY epoch) AS e2, lead(declination) OVER (ORDER BY epoch) AS d2 FROM e)"
_ODAY = "CAST(date_diff('day', DATE '1900-01-01', CAST(o_orderdate AS DATE)) AS INTEGER)"
_DECL = f"""decl AS (SELECT o_orderkey, o_custkey, {_ODAY} + 5 AS day,
 (SELECT CASE WHEN e2 IS NULL THEN declination + ({_ODAY} + 5 - epoch) * rate ELSE declination + ({_ODAY} + 5 - epoch) / CAST(e2 - epoch AS DOUBLE) * (d2 - declination) END
   FROM ee WHERE epoch <= {_ODAY} + 5 AND (e2 IS NULL OR e2 > {_ODAY} + 5)) - 5e-1 AS declination FROM orders)"""


def declined(spark, sf):
    o = table(spark, sf, "orders")
    d1 = D.days_since_1900(F.col("o_orderdate").cast("date"))
    readings = o.select("o_orderkey", "o_custkey", d1.alias("days1"), (d1 + 11).alias("days2"))
    return J.declination_at(readings, epochs_view(spark, sf), convergence=0.5)


@query("j8_declination_at", f"WITH {_EPOCHS}, {_DECL} SELECT o_orderkey, {r('declination')} AS declination FROM decl")
def j8(spark, sf):
    return declined(spark, sf).select("o_orderkey", r6(F.col("declination")).alias("declination"))


@query(
    "j9_attach_splays",
    """WITH l AS (SELECT o_orderkey, o_custkey % 3 AS kind FROM orders)
 SELECT o_orderkey, CASE kind WHEN 0 THEN concat('m', CAST(o_orderkey AS VARCHAR)) END AS station,
 CASE kind WHEN 0 THEN concat('w', CAST(o_orderkey AS VARCHAR)) END AS free_end,
 CASE kind WHEN 1 THEN 'not a dead end' WHEN 2 THEN 'isolated' END AS problem FROM l""",
)
def j9(spark, sf):
    o = table(spark, sf, "orders")
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 3
    main, wall = F.concat(F.lit("m"), key), F.concat(F.lit("w"), key)
    splays = o.select("o_orderkey", wall.alias("from_stn"), main.alias("to_stn"), F.lit(4).alias("flags"))
    legs = o.where(kind != 2).select("o_orderkey", main.alias("from_stn"), F.concat(F.lit("z"), key).alias("to_stn"), F.lit(0).alias("flags"))
    more = o.where(kind == 1).select("o_orderkey", wall.alias("from_stn"), F.concat(F.lit("y"), key).alias("to_stn"), F.lit(0).alias("flags"))
    out = J.attach_splays(splays.unionAll(legs).unionAll(more))
    return out.select("o_orderkey", "station", "free_end", "problem")


@query(
    "j10_name_at",
    """WITH f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey)
 SELECT o_orderkey, concat('o', CAST(k AS VARCHAR)) AS name FROM orders JOIN f USING (o_custkey)""",
)
def j10(spark, sf):
    o = table(spark, sf, "orders")
    at = [(F.col("o_custkey") * -0.1).alias("x"), (F.col("o_custkey") * 0.0 - 0.0).alias("y"), (F.col("o_custkey") / 3).alias("z")]
    labels = o.select(*at, F.col("o_orderkey").alias("seq"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"))
    return J.name_at(o.select("o_orderkey", *at), labels).select("o_orderkey", "name")


@query(
    "j11_measure_from",
    with_views(
        f"""SELECT b.name, {r('sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2))')} AS horizontal, {r('sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2))')} AS distance, {r('b.z - a.z')} AS vertical
 FROM tvs a, tvs b WHERE a.name = 's1' AND b.name <> 's1'""",
        "tvs",
    ),
)
def j11(spark, sf):
    out = J.measure_from(view(spark, sf, "tvs"), "s1")
    return out.select("name", *[r6(F.col(c)).alias(c) for c in ("horizontal", "distance", "vertical")])


# Traverse figures of TV2: a closed chain is one traverse from the fixed
# station back to it, with a misclosure of views.GAP.
CLOSED = "closed AS (SELECT cust FROM tv2 WHERE leg_id < 0)"
TRAV = f"""{CLOSED}, trav AS (SELECT cust AS trav_id, CAST(count(*) AS BIGINT) AS n_legs, sum(sqrt(dx * dx + dy * dy + dz * dz)) AS length,
 sqrt(pow(sum(dx), 2) + pow(sum(dy), 2) + pow(sum(dz), 2)) AS moved, sum(dx) AS sx, sum(dy) AS sy, sum(dz) AS sz,
 sum(vx) AS vx, sum(vy) AS vy, sum(vz) AS vz FROM tv2 WHERE cust IN (SELECT cust FROM closed) GROUP BY cust),
err AS (SELECT *, moved / n_legs AS moved_per_leg, 100 * moved / length AS percent, sqrt((sx * sx + sy * sy + sz * sz) / (vx + vy + vz)) AS e3,
 sqrt((sx * sx + sy * sy) / (vx + vy)) AS eh, sqrt(sz * sz / vz) AS ev FROM trav)"""


def ring_legs(spark, sf):
    """Legs of the closed chains, each chain one traverse."""
    legs = tv2_legs(spark, sf)
    closed = legs.where(F.col("leg_id") < 0).select("cust")
    start = F.concat(F.lit("c"), F.col("cust").cast("string"), F.lit(".0"))
    return legs.join(closed, "cust", "left_semi").select(
        "*", F.col("cust").alias("trav_id"), start.alias("trav_from"), start.alias("trav_to")
    )


def ring_errors(spark, sf):
    legs = ring_legs(spark, sf)
    at = legs.select(F.col("trav_from").alias("name")).distinct().select(
        "name", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")
    )
    return A.traverse_errors(legs, at)


_ERR = ", ".join(
    f"{r(e)} AS {n}"
    for n, e in {"length": "length", "moved": "moved", "moved_per_leg": "moved_per_leg", "percent": "percent", "E": "e3", "H": "eh", "V": "ev"}.items()
)


def err_columns():
    return [r6(F.col(c)).alias(c) for c in ("length", "moved", "moved_per_leg", "percent", "E", "H", "V")]


@query(
    "a11_traverse_errors",
    with_views(f"WITH {TRAV} SELECT trav_id, n_legs, {_ERR} FROM err", "tv2"),
)
def a11(spark, sf):
    return ring_errors(spark, sf).select("trav_id", "n_legs", *err_columns())


@query(
    "j12_attach_traverse_errors",
    with_views(
        f"WITH {TRAV} SELECT leg_id, seq, tv2.cust AS trav_id, {r('e3')} AS e3, n_legs FROM tv2 JOIN err ON cust = trav_id",
        "tv2",
    ),
)
def j12(spark, sf):
    out = J.attach_traverse_errors(ring_legs(spark, sf), ring_errors(spark, sf))
    return out.select("leg_id", "seq", "trav_id", r6(F.col("E")).alias("e3"), "n_legs")


@query(
    "j13_station_flags",
    with_views(
        """WITH m AS (SELECT from_stn AS name, CASE WHEN flags & 1 <> 0 OR l_tax = 0 THEN 1 ELSE 2 END AS bit FROM tv1 UNION ALL SELECT to_stn, CASE WHEN flags & 1 <> 0 OR l_tax = 0 THEN 1 ELSE 2 END FROM tv1
   UNION ALL SELECT name, 4 FROM tvs WHERE k % 7 = 0 UNION ALL SELECT name, 16 FROM tvs WHERE k % 11 = 0 UNION ALL SELECT name, 8 FROM tvs WHERE k % 5 = 0)
 SELECT tvs.name, CAST(coalesce(bit_or(bit), 0) AS INTEGER) AS sflags FROM tvs LEFT JOIN m ON m.name = tvs.name GROUP BY tvs.name""",
        "tv1", "tvs",
    ),
)
def j13(spark, sf):
    s = view(spark, sf, "tvs")
    legs = view(spark, sf, "tv1").withColumn(
        "flags", F.when(F.col("l_tax") == 0, F.col("flags").bitwiseOR(F.lit(1))).otherwise(F.col("flags"))
    )

    def pick(n):
        return s.where(F.col("k") % n == 0).select(F.col("name").alias("station"))

    return J.station_flags(legs, s.select("name"), pick(7), pick(11), pick(5)).select("name", "sflags")


# ---------------------------------------------------------------- aggregates


@query(
    "a1_average_repeats",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
 g AS (SELECT *, CASE WHEN lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS step FROM k WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
 h AS (SELECT *, sum(step) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
 SELECT l_orderkey, l_returnflag AS from_stn, min(l_linenumber * CAST(100000000000000000 AS BIGINT) + l_partkey * CAST(100000000 AS BIGINT) + l_suppkey) AS seq, CAST(count(*) AS BIGINT) AS n, {r('avg(l_quantity)')} AS dx, {r('avg(l_tax)')} AS vxx
 FROM h GROUP BY l_orderkey, run, l_returnflag""",
)
def a1(spark, sf):
    z = F.lit(0.0)
    legs = table(spark, sf, "lineitem").select(
        "l_orderkey",
        (F.col("l_linenumber") * 10**17 + F.col("l_partkey") * 10**8 + F.col("l_suppkey")).alias("seq"),
        F.col("l_returnflag").alias("from_stn"), F.lit("x").alias("to_stn"),
        V.vec(F.col("l_quantity"), z, z).alias("d"), V.cov(F.col("l_tax"), z, z).alias("v"),
    )
    out = A.average_repeats(legs, ["l_orderkey"])
    return out.select("l_orderkey", "from_stn", "seq", "n", r6(F.col("d.x")).alias("dx"), r6(F.col("v.xx")).alias("vxx"))


@query(
    "a2_combine_parallel",
    with_views(
        f"""SELECT from_stn, to_stn, CAST(count(*) AS BIGINT) AS n, {r('sum(dx / vx) / sum(1 / vx)', 5)} AS dx, {r('sum(dy / vy) / sum(1 / vy)', 5)} AS dy, {r('1 / sum(1 / vz) + 3.3e-11', 8)} AS vzz
 FROM (SELECT from_stn, to_stn, dx + vx AS dx, dy, vx, vy, vz FROM tv3) t GROUP BY from_stn, to_stn""",
        "tv3",
    ),
)
def a2(spark, sf):
    legs = tv3_legs(spark, sf)
    d = F.col("d")
    noisy = legs.withColumn("d", V.vec(d["x"] + F.col("v.xx"), d["y"], d["z"]))
    # Half of the legs are measured the other way round.
    flip = F.col("leg_id") % 2 == 0
    turned = noisy.select(
        F.when(flip, F.col("to_stn")).otherwise(F.col("from_stn")).alias("from_stn"),
        F.when(flip, F.col("from_stn")).otherwise(F.col("to_stn")).alias("to_stn"),
        V.vscale(d, F.when(flip, -1.0).otherwise(1.0)).alias("d"), "v",
    )
    out = A.combine_parallel(turned)
    return out.select(
        "from_stn", "to_stn", "n", F.round("d.x", 5).alias("dx"), F.round("d.y", 5).alias("dy"), F.round(F.col("v.zz") + 3.3e-11, 8).alias("vzz")
    )


_T1 = f"WITH {COMPASS_STEPS.format(decl='0e0')}, lg AS (SELECT *, {NORMAL['dx']} AS dx, {NORMAL['dy']} AS dy, {NORMAL['dz']} AS dz FROM n1)"


def tv1_legs(spark, sf):
    return X.reduce_normal(_no_counts(view(spark, sf, "tv1")))


@query(
    "a3_survey_totals",
    with_views(
        f"""{_T1} SELECT scope, CAST(count(*) AS BIGINT) AS legs, {r('sum(sqrt(dx * dx + dy * dy + dz * dz)) + 3.3e-6', 3)} AS length,
 {r('sum(sqrt(dx * dx + dy * dy)) + 3.3e-6', 3)} AS plan_length, {r('sum(abs(dz)) + 3.3e-6', 3)} AS vertical_length FROM lg WHERE flags & 7 = 0 GROUP BY scope""",
        "tv1",
    ),
)
def a3(spark, sf):
    out = A.survey_totals(tv1_legs(spark, sf), ["scope"])
    names = ("length", "plan_length", "vertical_length")
    return out.select("scope", "legs", *[F.round(F.col(c) + 3.3e-6, 3).alias(c) for c in names])


def _ranges_sql(where):
    rows = []
    for a in "xyz":
        rows.append(
            f"""SELECT '{a}' AS axis, min({a}) AS low, (SELECT min(name) FROM s WHERE {a} = (SELECT min({a}) FROM s)) AS low_station,
 max({a}) AS high, (SELECT min(name) FROM s WHERE {a} = (SELECT max({a}) FROM s)) AS high_station, {r(f'max({a}) - min({a})')} AS extent FROM s"""
        )
    return f"WITH s AS (SELECT * FROM tvs WHERE {where}) " + " UNION ALL ".join(rows)


@query("a4_ranges", with_views(_ranges_sql("k % 3 <> 0"), "tvs"))
def a4(spark, sf):
    return A.ranges(view(spark, sf, "tvs")).withColumn("extent", F.round("extent", 6))


@query("a4_ranges_named", with_views(_ranges_sql("k % 3 <> 0 AND k % 13 <> 0"), "tvs"))
def a4b(spark, sf):
    return A.ranges(view(spark, sf, "tvs"), "named").withColumn("extent", F.round("extent", 6))


@query("a4_ranges_all", with_views(_ranges_sql("true"), "tvs"))
def a4c(spark, sf):
    return A.ranges(view(spark, sf, "tvs"), "all").withColumn("extent", F.round("extent", 6))


@query(
    "a6_node_degree_histogram",
    with_views(
        """WITH e AS (SELECT from_stn AS name FROM tv2 UNION ALL SELECT to_stn FROM tv2), d AS (SELECT name, count(*) AS degree FROM e GROUP BY name)
 SELECT CAST(degree AS BIGINT) AS degree, CAST(count(*) AS BIGINT) AS nodes FROM d GROUP BY degree""",
        "tv2",
    ),
)
def a6(spark, sf):
    return A.node_degree_histogram(tv2_legs(spark, sf))


@query(
    "a7_rollup_by_survey",
    f"""WITH {NAMES_SQL}, p AS (SELECT *, split_part(name, '.', 1) AS a, concat(split_part(name, '.', 1), '.', split_part(name, '.', 2)) AS b FROM tv4),
 u AS (SELECT '' AS survey, o_orderkey FROM p UNION ALL SELECT a, o_orderkey FROM p UNION ALL SELECT b, o_orderkey FROM p)
 SELECT survey, CAST(count(*) AS BIGINT) AS stations, CAST(count(*) AS BIGINT) AS legs, {r('sum(sqrt(o_orderkey * o_orderkey + 9e0))', 3)} AS length FROM u GROUP BY survey""",
)
def a7(spark, sf):
    s = names_view(spark, sf)
    legs = s.select(
        F.col("name").alias("from_stn"), V.vec(F.col("o_orderkey") * 1.0, F.lit(3.0), F.lit(0.0)).alias("d")
    )
    out = A.rollup_by_survey(s, legs)
    return out.withColumn("length", F.round("length", 3))


def tv1_placed(spark, sf):
    legs = view(spark, sf, "tv1").select(
        *KEYS, "from_stn", "to_stn", "l_linestatus", "l_tax",
        F.when(F.col("l_tax") == 0, 1).otherwise(F.col("flags")).alias("flags"),
        F.when(F.col("l_discount") > 0, D.days_since_1900(F.col("date1"))).alias("days1"),
    ).withColumn("days2", F.col("days1") + 3)
    return J.with_positions(legs, view(spark, sf, "tvs"))


@query(
    "a8_model_summary",
    with_views(
        """WITH l AS (SELECT t.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS bey, b.z AS bz, CASE WHEN l_tax = 0 THEN 1 ELSE flags END AS fl,
   CASE WHEN l_discount > 0 THEN CAST(date_diff('day', DATE '1900-01-01', date1) AS INTEGER) + 1 END AS mid FROM tv1 t JOIN tvs a ON a.name = from_stn JOIN tvs b ON b.name = to_stn),
 s AS (SELECT count(*) FILTER (k % 7 = 0) AS entrances, count(*) FILTER (k % 11 = 0) AS fixed, count(*) FILTER (k % 5 = 0) AS exported FROM tvs)
 SELECT least(min(ax), min(bx)) AS x_min, greatest(max(ax), max(bx)) AS x_max, least(min(ay), min(bey)) AS y_min, greatest(max(ay), max(bey)) AS y_max, least(min(az), min(bz)) AS z_min, greatest(max(az), max(bz)) AS z_max,
 least(min(az) FILTER (fl & 1 = 0), min(bz) FILTER (fl & 1 = 0)) AS depth_min, round(greatest(max(az) FILTER (fl & 1 = 0), max(bz) FILTER (fl & 1 = 0)) - least(min(az) FILTER (fl & 1 = 0), min(bz) FILTER (fl & 1 = 0)), 6) AS depth_extent,
 CAST(min(mid) AS INTEGER) AS date_min, CAST(max(mid) - min(mid) AS INTEGER) AS date_extent, bool_and(mid IS NOT NULL) AS complete_dates, bool_or(fl & 1 <> 0) AS has_surface, bool_or(fl & 1 = 0) AS has_underground,
 bool_or(fl & 4 <> 0) AS has_splays, bool_or(fl & 2 <> 0) AS has_duplicates, any_value(entrances) AS entrances, any_value(fixed) AS fixed, any_value(exported) AS exported FROM l, s""",
        "tv1", "tvs",
    ),
)
def a8(spark, sf):
    return A.model_summary(tv1_placed(spark, sf), view(spark, sf, "tvs")).withColumn(
        "depth_extent", F.round("depth_extent", 6)
    )


@query(
    "a9_declination_range",
    f"""WITH {_EPOCHS}, {_DECL}, q AS (SELECT o_custkey AS scope, declination AS d, day FROM decl)
 SELECT scope, {r('min(d) + 3.3e-8', 4)} AS min_declination, {r('max(d) + 3.3e-8', 4)} AS max_declination FROM q GROUP BY scope""",
)
def a9(spark, sf):
    d = declined(spark, sf).select(
        F.col("o_custkey").alias("scope"), "declination", (F.col("days1") + 5).alias("day")
    )
    out = A.declination_range(d)
    return out.select("scope", r6(F.col("min_declination") + 3.3e-8, 4).alias("min_declination"), r6(F.col("max_declination") + 3.3e-8, 4).alias("max_declination"))


@query(
    "a12_traverse_polylines",
    with_views(
        """WITH g AS (SELECT *, CASE WHEN lag(fl) OVER w IS DISTINCT FROM fl THEN 1 ELSE 0 END AS step FROM (SELECT *, CAST(seq % 4 AS INTEGER) // 2 AS fl FROM tv2) t WINDOW w AS (PARTITION BY cust ORDER BY seq)),
 h AS (SELECT *, sum(step) OVER (PARTITION BY cust ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pl FROM g)
 SELECT cust, CAST(pl AS BIGINT) AS polyline, CAST(fl AS INTEGER) AS flags, CAST(count(*) AS BIGINT) AS legs, CAST(count(*) + 1 AS INTEGER) AS points, min(a) * 1e0 AS first_x, max(b) * 1e0 AS last_x FROM (SELECT *, CASE WHEN leg_id < 0 THEN a + 1 ELSE b END AS bb FROM h) q GROUP BY cust, pl, fl""".replace("max(b)", "max(bb)"),
        "tv2",
    ),
)
def a12(spark, sf):
    items = _items(spark, sf)
    out = A.traverse_polylines(items, ["cust"])
    return out.select(
        "cust", "polyline", "flags", "legs", F.size("points").alias("points"),
        F.col("points")[0]["x"].alias("first_x"), F.element_at("points", -1)["x"].alias("last_x"),
    )


def _items(spark, sf):
    """Item stream of TV2: a move to each chain's start, then a line per leg."""
    legs = view(spark, sf, "tv2")
    lines = legs.select(
        "cust", "seq", F.lit(False).alias("move"), (F.col("a") + 1).cast("double").alias("x"),
        F.col("dy").alias("y"), F.col("dz").alias("z"),
        F.floor((F.col("seq") % 4) / 2).cast("int").alias("flags"), F.lit("s").alias("survey"),
        F.lit("NORMAL").alias("style"), F.lit(1).alias("days1"),
    )
    z = F.lit(0.0)
    moves = legs.where(F.col("seq") == 1).select(
        "cust", F.lit(0).cast("long").alias("seq"), F.lit(True).alias("move"), z.alias("x"), z.alias("y"), z.alias("z"),
        F.lit(0).alias("flags"), F.lit("").alias("survey"), F.lit("").alias("style"), F.lit(1).alias("days1"),
    )
    return lines.unionByName(moves)


@query(
    "a13_search_count",
    f"WITH {NAMES_SQL} SELECT CAST(count(*) AS BIGINT) AS matches FROM tv4 WHERE regexp_matches(lower(name), '^n1.*9$')",
)
def a13(spark, sf):
    return A.search_count(names_view(spark, sf), "N1*9")


@query(
    "a14_length_by_band",
    with_views(
        f"""WITH b AS (SELECT min(z) AS lo, max(z) - min(z) AS ext FROM tvs), t AS (SELECT dx, dy, dz, s.z FROM tv3 JOIN tvs s ON s.name = to_stn)
 SELECT CAST(CASE WHEN z - lo <= 0 THEN 0 WHEN z - lo >= ext THEN 12 ELSE floor((z - lo) / ext * 12) END AS INTEGER) AS band, CAST(count(*) AS BIGINT) AS legs, {r('sum(sqrt(dx * dx + dy * dy + dz * dz))', 3)} AS length FROM t, b GROUP BY 1""",
        "tv3", "tvs",
    ),
)
def a14(spark, sf):
    s = view(spark, sf, "tvs")
    legs = J.with_positions(tv3_legs(spark, sf), s)
    lim = s.agg(F.min("z").alias("lo"), (F.max("z") - F.min("z")).alias("ext"))
    df = legs.crossJoin(F.broadcast(lim))
    band = B.depth_band(F.col("to_pos.z"), F.col("lo"), F.col("ext"), 13)
    return A.length_by(df, band).withColumn("length", F.round("length", 3))


@query(
    "a14_length_by_year_and_survey",
    with_views(
        f"""{_T1} SELECT year(date1) AS year, scope AS survey, CAST(count(*) AS BIGINT) AS legs, {r('sum(sqrt(dx * dx + dy * dy + dz * dz)) + 3.3e-6', 3)} AS length FROM lg GROUP BY 1, 2""",
        "tv1",
    ),
)
def a14b(spark, sf):
    legs = tv1_legs(spark, sf)
    out = A.length_by(legs, F.struct(F.year("date1").alias("year"), F.col("scope").alias("survey")), "k")
    return out.select("k.year", "k.survey", "legs", F.round(F.col("length") + 3.3e-6, 3).alias("length"))


@query(
    "a15_export_depth",
    f"""WITH {NAMES_SQL} SELECT name AS station, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS INTEGER) AS levels, o_orderkey % 4 < 2 AS exported FROM tv4""",
)
def a15(spark, sf):
    n, k = F.col("name"), F.col("o_orderkey") % 4
    s = names_view(spark, sf)
    own = s.select(n.alias("station"), N.survey_of(n).alias("scope"))
    outer = s.where(k < 2).select(
        n.alias("station"), F.when(k == 0, "").otherwise(N.survey_of(N.survey_of(n))).alias("scope")
    )
    return A.export_depth(own.unionByName(outer))


@query(
    "p39_split_leg_at_bands",
    with_views(
        f"""WITH b AS (SELECT min(z) AS lo, max(z) - min(z) AS ext FROM tvs), l AS (SELECT leg_id, from_stn, to_stn, a.z AS z1, c.z AS z2, a.x AS x1, c.x AS x2 FROM tv3 JOIN tvs a ON a.name = from_stn JOIN tvs c ON c.name = to_stn),
 m AS (SELECT *, CAST(CASE WHEN z1 - lo <= 0 THEN 0 WHEN z1 - lo >= ext THEN 4 ELSE floor((z1 - lo) / ext * 4) END AS INTEGER) AS b1, CAST(CASE WHEN z2 - lo <= 0 THEN 0 WHEN z2 - lo >= ext THEN 4 ELSE floor((z2 - lo) / ext * 4) END AS INTEGER) AS b2 FROM l, b),
 p AS (SELECT *, unnest(range(0, abs(b2 - b1) + 1)) AS piece FROM m)
 SELECT leg_id, from_stn, to_stn, CAST(piece AS INTEGER) AS piece, CAST(b1 + piece * sign(b2 - b1) AS INTEGER) AS band,
 {r('CASE WHEN piece = abs(b2 - b1) THEN z2 WHEN b2 > b1 THEN ext * (b1 + piece + 1) / 4 + lo ELSE ext * (b1 - piece) / 4 + lo END')} AS z_end,
 {r('CASE WHEN piece = abs(b2 - b1) THEN x2 ELSE x1 + ((CASE WHEN b2 > b1 THEN ext * (b1 + piece + 1) / 4 + lo ELSE ext * (b1 - piece) / 4 + lo END) - z1) / (z2 - z1) * (x2 - x1) END + 3.3e-8')} AS x_end FROM p""",
        "tv3", "tvs",
    ),
)
def p39(spark, sf):
    s = view(spark, sf, "tvs")
    lim = s.agg(F.min("z").alias("lo"), (F.max("z") - F.min("z")).alias("ext"))
    legs = J.with_positions(tv3_legs(spark, sf), s).crossJoin(F.broadcast(lim))
    out = A.split_legs_at_bands(legs, F.col("lo"), F.col("ext"), 5)
    return out.select(
        "leg_id", "from_stn", "to_stn", "piece", "band",
        r6(F.col("piece_to.z")).alias("z_end"), r6(F.col("piece_to.x") + 3.3e-8).alias("x_end"),
    )


@query(
    "p28_offset",
    with_views(
        f"""WITH b AS (SELECT min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2 FROM tvs)
 SELECT name, {r('x - (x1 + x2) / 2')} AS cx, {r('z - (z1 + z2) / 2')} AS cz, {r('x - x1')} AS ox, {r('y - y1')} AS oy, {r('x')} AS fx FROM tvs, b""",
        "tvs",
    ),
)
def p28(spark, sf):
    from legnet.operators.layout import offset_points

    s = view(spark, sf, "tvs").withColumn("p", V.vec(F.col("x"), F.col("y"), F.col("z")))
    c = offset_points(s, "p", "centred", "c")
    both = offset_points(offset_points(c, "p", "origin", "o"), "p", "full", "f")
    return both.select(
        "name", r6(F.col("c.x")).alias("cx"), r6(F.col("c.z")).alias("cz"),
        r6(F.col("o.x")).alias("ox"), r6(F.col("o.y")).alias("oy"), r6(F.col("f.x")).alias("fx"),
    )


@query(
    "p31_pick_separator",
    """SELECT CASE WHEN EXISTS (SELECT 1 FROM documents WHERE contains(text, '.')) THEN
 CASE WHEN EXISTS (SELECT 1 FROM documents WHERE contains(text, '/')) THEN CASE WHEN EXISTS (SELECT 1 FROM documents WHERE contains(text, ':')) THEN
 CASE WHEN EXISTS (SELECT 1 FROM documents WHERE contains(text, ';')) THEN CASE WHEN EXISTS (SELECT 1 FROM documents WHERE contains(text, ',')) THEN CASE WHEN EXISTS (SELECT 1 FROM documents WHERE contains(text, '!')) THEN '|' ELSE '!' END ELSE ',' END ELSE ';' END ELSE ':' END ELSE '/' END ELSE '.' END AS separator""",
)
def p31(spark, sf):
    from legnet.operators.layout import pick_separator

    return pick_separator(table(spark, sf, "documents").select(F.col("text").alias("name")))


# ---------------------------------------------------------------- windows


@query(
    "w1_pair_points",
    with_views("SELECT cust, seq, a * 1e0 AS from_x, a * 1e0 + 1 AS x FROM tv2", "tv2"),
)
def w1(spark, sf):
    return W.pair_points(_items(spark, sf), ["cust"]).select("cust", "seq", "from_x", "x")


@query(
    "w2_segment",
    with_views(
        """WITH g AS (SELECT cust, seq, CASE WHEN lag(date1) OVER w IS DISTINCT FROM date1 THEN 1 ELSE 0 END AS step FROM tv2 WINDOW w AS (PARTITION BY cust ORDER BY seq))
 SELECT cust, seq, CAST(sum(step) OVER (PARTITION BY cust ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment FROM g""",
        "tv2",
    ),
)
def w2(spark, sf):
    # A chunk shorter than the longest chain also takes the path across chunks.
    return segment(tv2_legs(spark, sf), ["cust"], "seq", ["date1"], chunk=7).select("cust", "seq", "segment")


@query(
    "w3_interleaved_to_legs",
    with_views("SELECT cust, seq * 2 AS seq, from_stn, to_stn, round(dx, 4) AS tape FROM tv2", "tv2"),
)
def w3(spark, sf):
    legs = view(spark, sf, "tv2").withColumn("dx", F.round("dx", 4))
    none = F.lit(None)
    stations = legs.select("cust", (F.col("seq") * 2 + 1).alias("seq"), F.col("to_stn").alias("station"), none.cast("double").alias("tape"))
    first = legs.where(F.col("seq") == 1).select("cust", F.lit(1).cast("long").alias("seq"), F.col("from_stn").alias("station"), none.cast("double").alias("tape"))
    readings = legs.select("cust", (F.col("seq") * 2).alias("seq"), none.cast("string").alias("station"), F.col("dx").alias("tape"))
    rows = stations.unionByName(first).unionByName(readings)
    return W.interleaved_to_legs(rows, ["cust"], chunk=5).select("cust", "seq", "from_stn", "to_stn", "tape")


@query(
    "w4_carry_depth",
    with_views("SELECT cust, seq, round(lag(dz) OVER (PARTITION BY cust ORDER BY seq), 4) AS from_depth, round(dz, 4) AS to_depth FROM tv2", "tv2"),
)
def w4(spark, sf):
    rows = view(spark, sf, "tv2").select("cust", "seq", F.col("dz").alias("to_depth"))
    return W.carry_previous(rows, ["cust"], "to_depth", "from_depth", chunk=4).select(
        "cust", "seq", F.round("from_depth", 4).alias("from_depth"), F.round("to_depth", 4).alias("to_depth")
    )


def placed_xsects(spark, sf):
    return J.place_xsects(xsects_view(spark, sf), view(spark, sf, "tvs"))[0]


FRAMES = f"""{XS}, px AS (SELECT xs.*, p.x, p.y, p.z FROM xs JOIN tvs p ON p.name = station),
 nb AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY tube_id) AS n FROM px WINDOW w AS (PARTITION BY tube_id ORDER BY seq)),
 u AS (SELECT *, CASE WHEN x0 IS NULL OR (x = x0 AND y = y0) THEN 0e0 ELSE (y - y0) / sqrt(pow(x - x0, 2) + pow(y - y0, 2)) END AS ax, CASE WHEN x0 IS NULL OR (x = x0 AND y = y0) THEN 0e0 ELSE -(x - x0) / sqrt(pow(x - x0, 2) + pow(y - y0, 2)) END AS ay,
   CASE WHEN x2 IS NULL OR (x = x2 AND y = y2) THEN 0e0 ELSE (y2 - y) / sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) END AS cx, CASE WHEN x2 IS NULL OR (x = x2 AND y = y2) THEN 0e0 ELSE -(x2 - x) / sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) END AS cy FROM nb WHERE n > 1),
 s AS (SELECT *, ax + cx AS sx, ay + cy AS sy, sqrt(pow(ax + cx, 2) + pow(ay + cy, 2)) AS sz FROM u),
 q AS (SELECT *, last_value(CASE WHEN sz > 0 THEN sx / sz END IGNORE NULLS) OVER w AS rx0, last_value(CASE WHEN sz > 0 THEN sy / sz END IGNORE NULLS) OVER w AS ry0 FROM s WINDOW w AS (PARTITION BY tube_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 fr AS (SELECT *, coalesce(rx0, 1e0) AS rx, coalesce(ry0, 0e0) AS ry FROM q)"""


@query(
    "w5_tube_frames",
    with_views(
        f"WITH {FRAMES} SELECT tube_id, seq, {r('degrees(atan2(rx, ry)) + 3.3e-6', 4)} AS right_bearing FROM fr",
        "tvs",
    ),
)
def w5(spark, sf):
    out = PS.tube_frames(placed_xsects(spark, sf))
    return out.select("tube_id", "seq", F.round(F.col("right_bearing") + 3.3e-6, 4).alias("right_bearing"))


@query(
    "w6_tube_corners",
    with_views(
        f"WITH {FRAMES} SELECT tube_id, seq, {r('x - rx * abs(l)', 5)} AS left_x, {r('y + ry * abs(r)', 5)} AS right_y, {r('z + abs(u)', 5)} AS up_z, {r('z - abs(d)', 5)} AS down_z FROM fr",
        "tvs",
    ),
)
def w6(spark, sf):
    out = PS.tube_corners(PS.tube_frames(placed_xsects(spark, sf)))
    return out.select(
        "tube_id", "seq", F.round("left_up.x", 5).alias("left_x"), F.round("right_down.y", 5).alias("right_y"),
        F.round("left_up.z", 5).alias("up_z"), F.round("left_down.z", 5).alias("down_z"),
    )


@query(
    "w6_walls",
    with_views(
        f"""WITH {FRAMES} SELECT tube_id, seq, 'left' AS side, {r('x - rx * l', 5)} AS wx, {r('y - ry * l', 5)} AS wy FROM fr
 UNION ALL SELECT tube_id, seq, 'right', {r('x + rx * r', 5)}, {r('y + ry * r', 5)} FROM fr""",
        "tvs",
    ),
)
def w6b(spark, sf):
    out = PS.wall_points(PS.tube_frames(placed_xsects(spark, sf)))
    return out.select("tube_id", "seq", "side", F.round("wx", 5).alias("wx"), F.round("wy", 5).alias("wy"))


@query(
    "w6_passage_quads",
    with_views(
        f"""WITH {FRAMES}, a AS (SELECT tube_id, seq, x + rx * r AS rgx, y + ry * r AS rgy, x - rx * l AS lfx FROM fr),
 b AS (SELECT *, lag(rgx) OVER w AS prgx, lag(lfx) OVER w AS plfx, lag(seq) OVER w AS pseq FROM a WINDOW w AS (PARTITION BY tube_id ORDER BY seq))
 SELECT tube_id, seq, {r('prgx', 5)} AS c0x, {r('plfx', 5)} AS c1x, {r('lfx', 5)} AS c2x, {r('rgx', 5)} AS c3x, {r('prgx', 5)} AS c4x FROM b WHERE pseq IS NOT NULL""",
        "tvs",
    ),
)
def w6c(spark, sf):
    out = PS.passage_quads(PS.tube_frames(placed_xsects(spark, sf)))
    return out.select("tube_id", "seq", *[F.round(F.col("ring")[i]["x"], 5).alias(f"c{i}x") for i in range(5)])


@query(
    "w6_active_runs",
    f"""WITH {XS}, g AS (SELECT *, l_partkey % 5 = 0 AS gap FROM xs) SELECT tube_id, seq, CAST(run AS BIGINT) AS run FROM
 (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY tube_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g) t WHERE NOT gap""",
)
def w6d(spark, sf):
    df = xsects_view(spark, sf)
    keep = F.substring("station", 2, 20).cast("long") % 5 != 0
    return PS.active_runs(df, keep).select("tube_id", "seq", "run")


RING_W = "WINDOW w AS (PARTITION BY cust ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
RINGS = """rg AS (SELECT *, sum(dx) OVER (PARTITION BY cust) AS tx, sum(dy) OVER (PARTITION BY cust) AS ty, sum(dz) OVER (PARTITION BY cust) AS tz,
 sum(vx) OVER (PARTITION BY cust) AS tvx, sum(vy) OVER (PARTITION BY cust) AS tvy, sum(vz) OVER (PARTITION BY cust) AS tvz,
 max(CASE WHEN leg_id < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cust) AS closed FROM tv2)"""


def ring_sql(closed="closed = 1 AND leg_id >= 0"):
    cols = ", ".join(
        f"{r(f'(sum(d{a}) OVER w) - CASE WHEN closed = 1 THEN t{a} * (sum(v{a}) OVER w) / tv{a} ELSE 0e0 END', 4)} AS {a}"
        for a in "xyz"
    )
    return f"SELECT * FROM (SELECT cust, seq, to_stn AS name, {cols}, closed, leg_id FROM rg {RING_W}) t WHERE {closed}"


@query(
    "w7_distribute_misclosure",
    with_views(f"WITH {RINGS} SELECT cust AS trav_id, seq, name, x, y, z FROM ({ring_sql()}) q", "tv2"),
)
def w7(spark, sf):
    legs = ring_legs(spark, sf)
    z = F.lit(0.0)
    ends = legs.select("trav_id").distinct().select(
        "trav_id", V.vec(z, z, z).alias("start"), V.vec(z, z, z).alias("finish")
    )
    out = W.distribute_misclosure(legs, ends, rows=legs.count())
    return out.select("trav_id", "seq", "name", *[F.round(a, 4).alias(a) for a in "xyz"])


# ---------------------------------------------------------------- sorts and sets


@query(
    "o1_worst_traverses",
    with_views(f"WITH {TRAV} SELECT trav_id, {_ERR} FROM err ORDER BY e3 DESC, trav_id LIMIT 25", "tv2"),
)
def o1(spark, sf):
    return O.worst_traverses(ring_errors(spark, sf), "E", 25).select("trav_id", *err_columns())


@query(
    "o1_worst_by_per_leg",
    with_views(f"WITH {TRAV} SELECT trav_id, {_ERR} FROM err ORDER BY round(moved_per_leg, 9) DESC, trav_id LIMIT 25", "tv2"),
)
def o1b(spark, sf):
    e = ring_errors(spark, sf).withColumn("moved_per_leg", F.round("moved_per_leg", 9))
    return O.worst_traverses(e, "per_leg", 25).select("trav_id", *err_columns())


@query(
    "w9_rank_errors",
    with_views(f"WITH {TRAV} SELECT trav_id, {_ERR} FROM err ORDER BY round(ev, 9) DESC, trav_id LIMIT 40", "tv2"),
)
def w9(spark, sf):
    e = ring_errors(spark, sf).withColumn("V", F.round("V", 9))
    return O.worst_traverses(e, "V", 40).select("trav_id", *err_columns())


@query(
    "s7_union_inputs",
    """SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS name, p_retailprice AS x, CAST(NULL AS DOUBLE) AS y FROM part
 UNION ALL SELECT concat('s', CAST(s_suppkey AS VARCHAR)), NULL, s_acctbal FROM supplier
 UNION ALL SELECT concat('c', CAST(c_custkey AS VARCHAR)), c_acctbal, c_acctbal FROM customer""",
)
def s7(spark, sf):
    def part(name, prefix, key, **cols):
        named = F.concat(F.lit(prefix), F.col(key).cast("string")).alias("name")
        return table(spark, sf, name).select(named, *[F.col(c).alias(n) for n, c in cols.items()])

    return DF.union_inputs(
        part("part", "p", "p_partkey", x="p_retailprice"),
        part("supplier", "s", "s_suppkey", y="s_acctbal"),
        part("customer", "c", "c_custkey", x="c_acctbal", y="c_acctbal"),
    )


@query(
    "o2_sort_names",
    with_views("SELECT to_stn AS name, row_number() OVER (ORDER BY cust, b, seq) AS rank FROM tv2", "tv2"),
)
def o2(spark, sf):
    names = view(spark, sf, "tv2").select(F.col("to_stn").alias("name"))
    return O.rank_names(names)


@query(
    "o3_plot_order",
    with_views(
        """SELECT name, row_number() OVER (ORDER BY CASE WHEN k % 7 = 0 THEN 0 WHEN k % 11 = 0 THEN 1 WHEN k % 5 = 0 THEN 2 ELSE 3 END, substr(name, 1, 1), k) AS rank FROM tvs""",
        "tvs",
    ),
)
def o3(spark, sf):
    return O.rank_plot_order(view(spark, sf, "tvs")).select("name", "rank")


@query(
    "o4_pick_start",
    with_views(
        """SELECT name, z, CAST(0 AS INTEGER) AS rank FROM tvs WHERE k % 7 = 0 AND name IN (SELECT from_stn FROM tv3 UNION SELECT to_stn FROM tv3) ORDER BY z DESC, name LIMIT 1""",
        "tvs", "tv3",
    ),
)
def o4(spark, sf):
    return O.pick_start(view(spark, sf, "tvs"), tv3_legs(spark, sf)).select("name", "z", "rank")


@query("u1_added", "SELECT concat('o', CAST(o_orderkey AS VARCHAR)) AS name FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0")
def u1(spark, sf):
    return DF.added(*versions(spark, sf))


@query("u1_deleted", "SELECT concat('o', CAST(o_orderkey AS VARCHAR)) AS name FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0")
def u1b(spark, sf):
    return DF.deleted(*versions(spark, sf))


@query("u2_unchanged", f"WITH {_DIFF} SELECT name FROM dd WHERE status = 'Same'")
def u2(spark, sf):
    return DF.unchanged(*versions(spark, sf))


@query(
    "u3_union_inputs",
    """SELECT o_orderkey AS id, CAST(o_custkey AS BIGINT) AS cust, NULL AS acctbal FROM orders UNION ALL SELECT c_custkey, CAST(NULL AS BIGINT), c_acctbal FROM customer""",
)
def u3(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"))
    return DF.union_inputs(o, c)
