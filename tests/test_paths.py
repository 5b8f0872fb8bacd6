"""Levels over graphs of all shapes against a plain breadth-first walk."""

import random
from collections import defaultdict, deque

import pytest

from legnet.operators.paths import hop_levels


def plain(edges, root):
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    level, queue = {root: 0}, deque([root])
    while queue:
        u = queue.popleft()
        for v in near[u] - set(level):
            level[v] = level[u] + 1
            queue.append(v)
    return level


def network(seed, n):
    """A long chain with shortcuts, dead ends, parallel legs, loops and a part of its own."""
    rnd = random.Random(seed)
    edges = [(i, i + 1) for i in range(n - 1)] + [(i, i) for i in range(0, n, 9)]
    edges += [(i, min(n - 1, i + rnd.randint(2, 9))) for i in range(0, n, 7)]
    edges += [(rnd.randrange(n), -k - 1) for k in range(n // 6)] + edges[:5]
    edges += [(10_000, 10_001), (10_001, 10_002)]
    places = {x: ((x % 10_000) * 5.0, float(rnd.randint(0, 3)), 0.0) for e in edges for x in e}
    return edges, places


@pytest.mark.parametrize(
    "seed, n, sizes", [(1, 400, {}), (2, 150, {"leaf": 8, "fan": 2}), (3, 90, {"leaf": 4, "fan": 3, "front": 5})]
)
def test_levels(spark, seed, n, sizes):
    edges, places = network(seed, n)
    df = spark.createDataFrame(edges, "u long, v long")
    at = spark.createDataFrame([(k, *v) for k, v in places.items()], "node long, x double, y double, z double")
    got = {r.node: r.level for r in hop_levels(df, at, 3, **sizes).collect()}
    assert got == plain(edges, 3)


def test_a_start_without_legs(spark):
    df = spark.createDataFrame([(1, 2)], "u long, v long")
    at = spark.createDataFrame([(k, 0.0, 0.0, 0.0) for k in (1, 2, 5)], "node long, x double, y double, z double")
    assert [tuple(r) for r in hop_levels(df, at, 5).collect()] == [(5, 0)]
