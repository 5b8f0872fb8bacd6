"""Small surveys with known answers."""

import pytest
from pyspark.sql import functions as F

from legnet.operators import adjust as AD
from legnet.operators import aggregates as A
from legnet.operators import diff as D
from legnet.operators import graph as G
from legnet.operators import joins as J
from legnet.operators.reduce import reduce_normal
from networks import pins_frame

LOLLIPOP = [
    ("1", "a", 3, 90, 0), ("a", "2", 3, 90, 0), ("a", "b", 3, 0, 0),
    ("b", "c", 2, 0, 0), ("c", "b", 2, 180, 0), ("1", "s", 1, 180, 0),
]
CROSS = [("1", "a", 3, 90, 0), ("2", "a", 3, 0, 0), ("3", "a", 3, 270, 0), ("4", "a", 3, 180, 0)]
ROOT3 = 1.73205080
TRIANGLE = [
    ("0", "c", 1, 0, 0), ("0", "b", 1, 120, 0), ("0", "a", 1, 240, 0),
    ("c", "b", ROOT3, 150, 0), ("b", "a", ROOT3, 270, 0), ("a", "c", ROOT3, 30, 0),
]


def reduced(spark, rows):
    df = spark.createDataFrame(
        [(f, t, float(a), float(b), float(c)) for f, t, a, b, c in rows],
        "from_stn string, to_stn string, tape double, compass double, clino double",
    )
    return reduce_normal(df).withColumn("flags", F.lit(0))


def positions(result):
    return {r.name: (r.x, r.y, r.z) for r in result.positions.collect()}


def close(got, want):
    assert set(got) == set(want)
    for name, place in want.items():
        assert got[name] == pytest.approx(place, abs=0.005), name


def test_loop_on_a_stick_and_two_fixes(spark):
    legs = reduced(spark, LOLLIPOP)
    out = AD.adjust(legs, pins_frame(spark, {"1": (0, 0, 0), "2": (4, 0, 0)}))
    got = positions(out)
    close(got, {"1": (0, 0, 0), "2": (4, 0, 0), "a": (2, 0, 0), "b": (2, 3, 0), "c": (2, 5, 0), "s": (0, -1, 0)})

    counts = A.network_counts(G.component_names(legs), legs).collect()[0]
    assert (counts.stations, counts.legs, counts.loops, counts.components) == (6, 6, 1, 1)
    totals = A.survey_totals(AD.adjusted_legs(legs, out.positions)).collect()[0]
    assert totals.length == pytest.approx(14.0)
    assert totals.adjusted_length == pytest.approx(12.0, abs=0.005)
    limits = {r.axis: r for r in A.ranges(J.station_flags(legs, out.positions)).collect()}
    assert (limits["y"].extent, limits["y"].high_station, limits["y"].low_station) == (pytest.approx(6, abs=0.01), "c", "s")
    assert (limits["x"].extent, limits["x"].high_station) == (pytest.approx(4, abs=0.01), "2")
    # The leg to s is a dead end; the double leg b-c is a loop behind a bridge.
    marks = {(r.from_stn, r.to_stn): (r.dead_end, r.bridge) for r in out.legs.collect()}
    assert marks[("1", "s")] == (True, True)
    assert marks[("a", "b")] == (False, True)
    assert marks[("b", "c")] == (False, False)
    assert marks[("1", "a")] == (False, False)


def test_four_anchors(spark):
    pins = {"1": (0, 4, 0), "2": (4, 0, 0), "3": (8, 4, 0), "4": (4, 8, 0)}
    got = positions(AD.adjust_blocks(reduced(spark, CROSS), pins_frame(spark, pins)))
    close(got, {**pins, "a": (4, 4, 0)})


def test_triangle_with_centre(spark):
    got = positions(AD.adjust(reduced(spark, TRIANGLE), pins_frame(spark, {"0": (0, 0, 0)})))
    close(got, {"0": (0, 0, 0), "a": (-0.87, -0.5, 0), "b": (0.87, -0.5, 0), "c": (0, 1, 0)})


def stations(spark, rows):
    return spark.createDataFrame(
        [(n, i, float(x), 0.0, 0.0) for i, (n, x) in enumerate(rows)],
        "name string, seq int, x double, y double, z double",
    )


def statuses(df):
    return sorted((r.name, r.status) for r in df.collect())


def test_diff_added_deleted_and_threshold(spark):
    one, two = stations(spark, [("1", 0), ("2", 5)]), stations(spark, [("2", 5.01)])
    assert statuses(D.position_diff(one, two)) == [("1", "Deleted"), ("2", "Same")]
    assert statuses(D.position_diff(two, one)) == [("1", "Added"), ("2", "Same")]
    moved = stations(spark, [("1", 0), ("2", 5.02)])
    assert statuses(D.position_diff(one, moved)) == [("1", "Same"), ("2", "Moved")]


def test_diff_repeated_name_prefers_the_unmoved(spark):
    old = stations(spark, [("a", 0), ("a", 10), ("a", 20)])
    new = stations(spark, [("a", 20.0), ("a", 0.001)])
    got = statuses(D.position_diff(old, new, chunk=1))
    assert got == [("a", "Deleted"), ("a", "Same"), ("a", "Same")]


def test_uncertain_fix_gives_an_anchor_leg(spark):
    legs = reduced(spark, [("a", "b", 10, 0, 0)]).select("from_stn", "to_stn", "d", "v")
    fixes = spark.createDataFrame(
        [("a", 0.0, 0.0, 0.0, None), ("b", 0.0, 12.0, 0.0, 1.0)],
        "station string, x double, y double, z double, sdx double",
    )
    for c in ("sdy", "sdz", "cxy", "cyz", "czx"):
        fixes = fixes.withColumn(c, F.lit(None).cast("double"))
    all_legs, pinned = J.apply_fixes(legs, fixes)
    got = positions(AD.adjust(all_legs.select("from_stn", "to_stn", "d", "v"), pinned))
    # The fix of b is far weaker than the leg.
    assert got["b"][1] == pytest.approx(10.0, abs=0.02)
    assert got["b"][1] > 10.0


def test_compat_switches_change_only_what_they_name(spark):
    from legnet.operators.reduce import reduce_cartesian, reduce_diving

    row = spark.createDataFrame(
        [("a", "b", 10.0, 30.0, 0.0, 4.0, 3.0, 4.0, 5.0)],
        "from_stn string, to_stn string, tape double, compass double, from_depth double, to_depth double, "
        "dx double, dy double, dz double",
    )
    plain, old = (reduce_diving(row.drop("dx", "dy", "dz"), compat=c).collect()[0] for c in (False, True))
    assert plain.d == old.d and plain.v.xx == old.v.xx
    assert (old.v.yz, old.v.zx, old.v.xy) == (plain.v.xy, plain.v.yz, plain.v.zx)
    turn = 0.5
    plain, old = (reduce_cartesian(row, rotation=turn, compat=c).collect()[0] for c in (False, True))
    assert plain.d == old.d and plain.v.yy > old.v.yy
