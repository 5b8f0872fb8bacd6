"""Small networks as DataFrames, and plain solutions to compare with."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from legnet.functions import vec as V


def legs_frame(spark, legs):
    """legs: (from, to, d, 3x3 covariance)."""
    rows = [
        (f, t, *[float(x) for x in d], *[float(m[i][j]) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))])
        for f, t, d, m in legs
    ]
    names = "from_stn string, to_stn string, dx double, dy double, dz double, " + ", ".join(
        f"{p} double" for p in V.PARTS
    )
    df = spark.createDataFrame(rows, names)
    return df.select(
        "from_stn", "to_stn", V.vec(*[F.col(f"d{a}") for a in V.AXES]).alias("d"),
        V.cov(*[F.col(p) for p in V.PARTS]).alias("v"),
    )


def pins_frame(spark, pins):
    return spark.createDataFrame(
        [(k, *[float(x) for x in v]) for k, v in pins.items()], "name string, x double, y double, z double"
    )


def dense(legs, pins):
    """Least squares by numpy."""
    names = sorted({n for leg in legs for n in leg[:2]})
    free = [n for n in names if n not in pins]
    at = {n: 3 * i for i, n in enumerate(free)}
    a, b = np.zeros((3 * len(free),) * 2), np.zeros(3 * len(free))
    for f, t, d, m in legs:
        w = np.linalg.inv(np.array(m))
        for n, other, sign in ((f, t, -1), (t, f, 1)):
            if n not in at:
                continue
            i = at[n]
            a[i : i + 3, i : i + 3] += w
            b[i : i + 3] += sign * (w @ np.array(d))
            if other in at:
                a[i : i + 3, at[other] : at[other] + 3] -= w
            else:
                b[i : i + 3] += w @ np.array(pins[other])
    x = np.linalg.solve(a, b).reshape(-1, 3)
    return {**{n: x[i // 3] for n, i in at.items()}, **{k: np.array(v, float) for k, v in pins.items()}}


def classify(edges, pins):
    """(dead ends, bridges) of (eid, u, v) with all pins as one node, by brute force."""
    ends = {i: tuple("*" if x in pins else x for x in (u, v)) for i, u, v in edges}
    touching = defaultdict(set)
    for i, pair in ends.items():
        for n in pair:
            touching[n].add(i)
    dead, again = set(), True
    while again:
        again = False
        for n, all_edges in touching.items():
            left = all_edges - dead
            if n != "*" and len(left) == 1:
                dead |= left
                again = True
    bridges = set()
    for skip, (u, v) in ends.items():
        if u == v:
            continue
        seen, stack = {u}, [u]
        while stack:
            for i in touching[stack.pop()] - {skip}:
                for n in ends[i]:
                    if n not in seen:
                        seen.add(n)
                        stack.append(n)
        if v not in seen:
            bridges.add(skip)
    return dead, bridges
