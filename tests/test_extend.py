"""Unrolled elevations of small networks."""

import math

import pytest

from legnet.operators.extend import extend_elevation

PLACES = {"a": (0, 0, 10), "b": (0, 10, 8), "c": (0, 20, 6), "d": (10, 20, 4), "e": (20, 20, 2), "d1": (10, 30, 5), "w": (0, 13, 9)}


def frames(spark, legs, rules=()):
    places = spark.createDataFrame(
        [(k, *[float(x) for x in v]) for k, v in PLACES.items()], "name string, x double, y double, z double"
    )
    df = spark.createDataFrame(legs, "from_stn string, to_stn string, flags int")
    r = spark.createDataFrame(list(rules), "kind string, a string, b string") if rules else None
    return df, places, r


TREE = [("a", "b", 0), ("b", "c", 0), ("c", "d", 0), ("d", "e", 0), ("d1", "d", 0)]


def places_of(out):
    return sorted((r.name, round(r.x, 6), r.z) for r in out.stations.collect())


def test_rules_on_a_tree(spark):
    legs, places, rules = frames(spark, TREE, [("left", "c", None), ("swap", "d", "d1")])
    out = extend_elevation(legs, places, "b", rules)
    # From c the way goes left; the leg to d1 swaps back to the right.
    assert places_of(out) == [
        ("a", 10.0, 10.0), ("b", 0.0, 8.0), ("c", 10.0, 6.0), ("d", 0.0, 4.0), ("d1", 10.0, 5.0), ("e", -10.0, 2.0),
    ]


def test_loop_is_cut_once_and_breaks_where_told(spark):
    loop = TREE + [("e", "a", 0)]
    legs, places, rules = frames(spark, loop, [("break", "e", "a")])
    out = extend_elevation(legs, places, "a", rules, show_breaks=True)
    got = [(n, x) for n, x, _ in places_of(out)]
    far = math.hypot(20, 20)
    # The leg e-a is cut at e, so e is placed along the chain and again from a.
    assert ("e", 40.0) in got and ("e", round(far, 6)) in got
    assert len(got) == 7 and out.legs.count() == 6
    cuts = out.breaks.collect()
    assert [(c.name, c.x1, round(c.x2, 6)) for c in cuts] == [("e", 40.0, round(far, 6))]


def test_splay_lies_in_the_plane(spark):
    legs, places, _ = frames(spark, [("a", "b", 0), ("b", "c", 0), ("b", "w", 4)])
    out = extend_elevation(legs, places, "a")
    s = out.splays.collect()
    assert len(s) == 1
    # The passage runs north, the splay points the same way: all of it along X.
    assert (s[0].x1, s[0].x2, s[0].z2) == (pytest.approx(10), pytest.approx(13), 9.0)
    assert s[0].y2 == pytest.approx(0, abs=1e-9)
