"""Unrolled elevations."""

from __future__ import annotations

from pyspark.sql import functions as F

from legnet.checks.tables import tv2_legs
from legnet.checks.views import r, with_views
from legnet.functions import vec as V
from legnet.operators import extend as E
from legnet.operators import windows as W
from legnet.plans.store import cut
from legnet.schema import LEG_SPLAY

QUERIES, SQL = {}, {}

#: Where a splay at station 1 ends, seen from there.
_SPLAY = {"x": 0.7123, "y": -1.3391, "z": 0.4}


def unrolled(spark, sf):
    """All chains and rings of TV2 from one common start, with every kind of rule.

    Some turn at station 2, some go left; a third of the rings is broken at its last
    station, other rings are cut where the two ways round meet; some chains end at a
    broken station. Station 1 of every customer has a splay.
    """
    legs = tv2_legs(spark, sf)
    closed = legs.where(F.col("leg_id") < 0).select("cust", F.lit(True).alias("closed"))
    legs = cut(legs.join(closed, "cust", "left").withColumn("closed", F.coalesce("closed", F.lit(False))))
    chains = legs.where(F.col("leg_id") >= 0).withColumn("trav_id", F.col("cust"))
    zero = F.lit(0.0)
    starts = chains.select("trav_id").distinct().select("trav_id", V.vec(zero, zero, zero).alias("start"))
    walked = cut(W.walk_from(chains, starts))
    at = walked.select("name", "x", "y", "z")
    hub = spark.range(1).select(F.lit("c").alias("name"), zero.alias("x"), zero.alias("y"), zero.alias("z"))
    wall = F.concat(F.lit("s"), F.col("trav_id").cast("string"))
    first = walked.where(F.col("seq") == 1)
    tips = first.select(wall.alias("name"), *[(F.col(a) + F.lit(_SPLAY[a])).alias(a) for a in "xyz"])
    near = F.when(F.col("seq") == 1, "c").otherwise(F.col("from_stn"))
    far = F.when(F.col("leg_id") < 0, "c").otherwise(F.col("to_stn"))
    net = legs.select(near.alias("from_stn"), far.alias("to_stn"), F.lit(0).alias("flags"), "seq")
    splays = first.select(
        F.col("name").alias("from_stn"), wall.alias("to_stn"), F.lit(LEG_SPLAY).alias("flags"),
        F.lit(0).cast("long").alias("seq"),
    )
    cust, seq, none = F.col("cust"), F.col("seq"), F.lit(None).cast("string")

    def rule(kind, where, a, b=none):
        return legs.where(where).select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    whole = F.col("leg_id") >= 0
    rules = (
        rule("swap", whole & (cust % 5 == 0) & (seq == 2), F.col("to_stn"))
        .unionByName(rule("left", whole & (cust % 5 != 0) & (cust % 7 == 0) & (seq == 1), F.lit("c"), F.col("to_stn")))
        .unionByName(rule("break", ~whole & (cust % 6 == 0), F.col("from_stn"), F.lit("c")))
        .unionByName(rule("break", ~F.col("closed") & (cust % 9 == 1) & (seq == 3), F.col("from_stn")))
    )
    return E.extend_elevation(
        net.unionByName(splays), at.unionByName(hub).unionByName(tips), "c", rules, show_breaks=True
    )


def g13(spark, sf):
    out = unrolled(spark, sf)
    none, empty = F.lit(None).cast("double"), F.lit(None).cast("string")

    def part(df, kind, a, b, x1, z1, x2, y2, z2, copy=None):
        cells = {"x1": x1, "z1": z1, "x2": x2, "y2": y2, "z2": z2}
        return df.select(
            F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"),
            *[F.round(F.round(c, 4) + 0.0, 4).alias(n) for n, c in cells.items()],
            (F.lit(None).cast("boolean") if copy is None else copy).alias("copy"),
        )

    c = F.col
    return (
        part(out.stations, "station", c("name"), empty, c("x"), c("z"), none, none, none, c("copy"))
        .unionByName(part(out.legs, "leg", c("from_stn"), c("to_stn"), c("x1"), c("z1"), c("x2"), none, c("z2")))
        .unionByName(part(out.splays, "splay", c("station"), c("free_end"), c("x1"), c("z1"), c("x2"), c("y2"), c("z2")))
        .unionByName(part(out.breaks, "break", c("name"), empty, c("x1"), c("z"), c("x2"), none, none))
    )


QUERIES["g13_extend_elevation"] = g13


def _row(kind, a, b, x1, z1, x2="NULL", y2="NULL", z2="NULL", copy="NULL") -> str:
    cells = ", ".join(
        f"{'CAST(NULL AS DOUBLE)' if e == 'NULL' else r(e, 4)} AS {n}"
        for n, e in {"x1": x1, "z1": z1, "x2": x2, "y2": y2, "z2": z2}.items()
    )
    return f"SELECT '{kind}' AS kind, {a} AS a, {b} AS b, {cells}, CAST({copy} AS BOOLEAN) AS copy"


def _sql() -> str:
    """Stations of a ring are reached the shorter way round, of two the one by leg order.

    x and y: places by the way forward and backward; k: number of the leg and of the
    station it leads to; m: the leg where both ways of a ring meet.
    """
    none = "CAST(NULL AS VARCHAR)"
    # Splay: the plane is that of the two legs at station 1.
    bend = "(CASE WHEN seven THEN -pi() / 2 ELSE pi() / 2 END - atan2(tx, ty))"
    sx, sy = (f"{_SPLAY[a]!r}e0" for a in "xy")
    parts = [
        _row("station", "'c'", none, "0e0", "0e0", copy="false"),
        _row("station", "name", none, "x", "pz", copy="stop AND k = 2") + " FROM s WHERE forward",
        _row("station", "name", none, "y", "pz", copy="false") + " FROM s WHERE NOT forward",
        _row("leg", "before", "name", "x0", "pz0", "x", "NULL", "pz") + " FROM s WHERE forward",
        _row("leg", "after", "name", "y1", "pz1", "y", "NULL", "pz") + " FROM s WHERE NOT forward",
        _row("station", "name", none, "x2", "z2", copy="true") + " FROM cut",
        _row("leg", "other", "name", "x1", "z1", "x2", "NULL", "z2") + " FROM cut",
        _row("break", "name", none, "old", "z2", "x2") + " FROM cut",
        _row(
            "splay", "name", "concat('s', CAST(cust AS VARCHAR))", "x", "pz",
            f"x + {sx} * cos({bend}) + {sy} * sin({bend})", f"{sy} * cos({bend}) - {sx} * sin({bend})",
            f"pz + {_SPLAY['z']!r}e0",
        ) + " FROM s WHERE k = 1",
    ]
    return f"""WITH o AS (
  SELECT *, count(*) OVER c AS len, max(CASE WHEN leg_id < 0 THEN 1 ELSE 0 END) OVER c = 1 AS closed,
    sum(dx) OVER w - dx AS px0, sum(dy) OVER w - dy AS py0, sum(dz) OVER w - dz AS pz0
  FROM tv2 WINDOW c AS (PARTITION BY cust), w AS (PARTITION BY cust ORDER BY seq)),
f AS (
  SELECT *, closed AND cust % 6 = 0 AS brk, NOT closed AND cust % 9 = 1 AND len >= 3 AS stop,
    cust % 5 <> 0 AND cust % 7 = 0 AS seven,
    CASE WHEN cust % 5 = 0 AND seq >= 3 OR cust % 5 <> 0 AND cust % 7 = 0 THEN -1 ELSE 1 END AS h,
    CASE WHEN leg_id < 0 THEN sqrt(px0 * px0 + py0 * py0) ELSE sqrt(dx * dx + dy * dy) END AS run,
    CASE WHEN leg_id < 0 THEN 0e0 ELSE pz0 + dz END AS pz,
    CASE WHEN seq = 1 THEN 'c' ELSE from_stn END AS before, CASE WHEN leg_id < 0 THEN 'c' ELSE to_stn END AS name
  FROM o),
g AS (
  SELECT *, sum(run * h) OVER w AS x, (sum(run) OVER c) - (sum(run) OVER w) AS y, seq AS k
  FROM f WINDOW c AS (PARTITION BY cust), w AS (PARTITION BY cust ORDER BY seq)),
t AS (
  SELECT *, x - run * h AS x0, lead(y) OVER w AS y1, lead(pz) OVER w AS pz1, lead(name) OVER w AS after,
    lag(x) OVER w AS xb, lag(y) OVER w AS yb, lag(pz) OVER w AS zb,
    dx + CASE WHEN lead(leg_id) OVER w >= 0 THEN lead(dx) OVER w ELSE 0e0 END AS tx,
    dy + CASE WHEN lead(leg_id) OVER w >= 0 THEN lead(dy) OVER w ELSE 0e0 END AS ty,
    NOT closed OR brk OR 2 * k <= len AS forward
  FROM g WINDOW w AS (PARTITION BY cust ORDER BY seq)),
s AS (SELECT * FROM t WHERE leg_id >= 0 AND NOT (stop AND k > 2)),
cut AS (
  SELECT name, before AS other, x0 AS x1, pz0 AS z1, x0 + run * h AS x2, pz AS z2, y AS old
  FROM t WHERE closed AND NOT brk AND len % 2 = 1 AND k = (len + 1) // 2
  UNION ALL SELECT before, name, y, pz, y + run, pz0, x0
  FROM t WHERE closed AND NOT brk AND len % 2 = 0 AND k = len // 2 + 1
  UNION ALL SELECT before, 'c', 0e0, 0e0, run, pz0, x0 FROM t WHERE brk AND leg_id < 0)
""" + "\nUNION ALL ".join(parts)


SQL["g13_extend_elevation"] = with_views(_sql(), "tv2")
