"""Passage outlines from cross-sections in ordered tubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legnet.functions.vec import vec
from legnet.plans.scan import _COUNT, CHUNK, large_groups, ordered_scan


def _unit_right(a, b):
    """Unit vector to the right of the walk from a to b; zero if it is vertical."""
    x, y = b["y"] - a["y"], a["x"] - b["x"]
    size = F.sqrt(x * x + y * y)
    return F.struct(
        F.when(size > 0, x / size).otherwise(0.0).alias("x"),
        F.when(size > 0, y / size).otherwise(0.0).alias("y"),
    )


def tube_frames(xsects: DataFrame, chunk: int = CHUNK, large=_COUNT) -> DataFrame:
    """Cross-sections with the unit vector to their right and its bearing.

    xsects: tube_id, seq, x, y, z, l, r, u, d. At the ends of a tube the vector
    is square to the leg, at a bend it halves the angle of the two legs; where
    that is undefined (a vertical run) the last defined vector stays, and a tube
    that starts vertical faces east. Tubes of one section have no frame. `large` may
    name the long tubes as `large_groups` gives them, where they are known already.
    """
    keys = ["tube_id"]
    here = F.struct("x", "y", "z")
    if large is _COUNT:
        large = large_groups(xsects, keys, chunk)
    df = ordered_scan(
        xsects, keys, "seq", lag={"_prev": here}, lead={"_next": here}, chunk=chunk, large=large
    )
    df = df.where(F.col("_prev").isNotNull() | F.col("_next").isNotNull())
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    r1 = F.when(F.col("_prev").isNotNull(), _unit_right(F.col("_prev"), here)).otherwise(zero)
    r2 = F.when(F.col("_next").isNotNull(), _unit_right(here, F.col("_next"))).otherwise(zero)
    df = df.withColumns({"_r1": r1, "_r2": r2})
    df = df.withColumns(
        {"_rx": F.col("_r1.x") + F.col("_r2.x"), "_ry": F.col("_r1.y") + F.col("_r2.y")}
    )
    size = F.sqrt(F.col("_rx") * F.col("_rx") + F.col("_ry") * F.col("_ry"))
    df = df.withColumn("_size", size)
    own = F.when(
        F.col("_size") > 0,
        F.struct((F.col("_rx") / F.col("_size")).alias("x"), (F.col("_ry") / F.col("_size")).alias("y")),
    )
    df = df.withColumn("_own", own)
    df = ordered_scan(df, keys, "seq", carry={"_right": F.col("_own")}, chunk=chunk, large=large)
    east = F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))
    df = df.withColumn("right", F.coalesce("_right", east))
    return df.withColumn(
        "right_bearing", F.degrees(F.atan2(F.col("right.x"), F.col("right.y")))
    ).drop("_prev", "_next", "_r1", "_r2", "_rx", "_ry", "_size", "_own", "_right")


def tube_corners(frames: DataFrame) -> DataFrame:
    """Left-up, right-up, right-down and left-down corner of every section."""
    rx, ry = F.col("right.x"), F.col("right.y")

    def corner(side, height):
        return vec(F.col("x") + rx * side, F.col("y") + ry * side, F.col("z") + height)

    left, right, up, down = (F.abs(F.col(c)) for c in ("l", "r", "u", "d"))
    return frames.withColumns(
        {
            "left_up": corner(-left, up),
            "right_up": corner(right, up),
            "right_down": corner(right, -down),
            "left_down": corner(-left, -down),
        }
    )


def active_runs(xsects: DataFrame, keep, chunk: int = CHUNK) -> DataFrame:
    """Sections that pass a filter, with tubes ended where one is filtered out."""
    step = ordered_scan(
        xsects.withColumn("_gap", (~keep).cast("long")), ["tube_id"], "seq",
        running={"run": F.col("_gap")}, chunk=chunk,
    )
    return step.where(F.col("_gap") == 0).drop("_gap")


def wall_points(frames: DataFrame, elevation=False) -> DataFrame:
    """Points of the two wall lines of every tube, in plan or in elevation.

    Sides are 'left' and 'right' in plan, 'up' and 'down' in elevation. Offsets
    are signed: an omitted dimension (-1) lies on the far side of the centreline.
    """
    rx, ry = F.col("right.x"), F.col("right.y")
    if elevation:
        sides = (("up", F.lit(0.0), F.lit(0.0), F.col("u")), ("down", F.lit(0.0), F.lit(0.0), -F.col("d")))
    else:
        sides = (
            ("left", -rx * F.col("l"), -ry * F.col("l"), F.lit(0.0)),
            ("right", rx * F.col("r"), ry * F.col("r"), F.lit(0.0)),
        )
    points = F.array(
        *[
            F.struct(
                F.lit(name).alias("side"),
                (F.col("x") + dx).alias("wx"),
                (F.col("y") + dy).alias("wy"),
                (F.col("z") + dz).alias("wz"),
            )
            for name, dx, dy, dz in sides
        ]
    )
    return frames.select("tube_id", "seq", F.inline(points))


def passage_quads(frames: DataFrame, keys=("tube_id",), chunk: int = CHUNK, large=_COUNT) -> DataFrame:
    """One closed quadrilateral between every two consecutive sections, in plan.

    `large` may name the long tubes, as for `tube_frames`.
    """
    rx, ry = F.col("right.x"), F.col("right.y")
    z = F.col("z")
    df = frames.withColumns(
        {
            "_l": vec(F.col("x") - rx * F.col("l"), F.col("y") - ry * F.col("l"), z),
            "_r": vec(F.col("x") + rx * F.col("r"), F.col("y") + ry * F.col("r"), z),
        }
    )
    df = ordered_scan(df, list(keys), "seq", lag={"_was": F.struct("_l", "_r")}, chunk=chunk, large=large)
    return df.where(F.col("_was").isNotNull()).select(
        *keys,
        "seq",
        F.array("_was._r", "_was._l", "_l", "_r", "_was._r").alias("ring"),
    )
