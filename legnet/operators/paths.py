"""Legs between a station and the start, over the whole network at once.

Ranges of stations along a space-filling curve take out their inner stations by the
shortest ways between the rest (minus and plus in place of plus and times, see
`plans.nested`), so the rounds grow with the logarithm of the network and not with its
depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legnet.functions.geometry import curve_place
from legnet.functions.vec import AXES
from legnet.operators.graph import components_near
from legnet.operators.pieces import by_blocks, levels_from, whole_blocks
from legnet.plans.nested import NODE, PAIR, Front, sweep
from legnet.plans.rank import ranked
from legnet.plans.skew import lookup
from legnet.plans.store import store

#: Edges of a block that is walked inside a task; larger ones are swept.
SMALL = 10_000
#: Farther than any way; sums of two stay exact.
FAR = float(1 << 50)


def _least_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of a[i, k] + b[k, j] over k."""
    out = np.full((a.shape[0], b.shape[1]), FAR)
    for k in range(a.shape[1]):
        np.minimum(out, a[:, k, None] + b[k], out=out)
    return out


def _shortcuts(front: Front) -> Iterator[dict]:
    """One range without its inner stations: shortest ways between those on its rim."""
    k, inner, rim = len(front.nodes), front.inner, front.rim
    way = np.full((k, k), FAR)
    np.minimum.at(way, (front.i, front.j), front.rows["way"][front.inside])
    begin = front.rows["begin"][front.own].copy()
    if len(inner):
        own = way[np.ix_(inner, inner)]
        np.fill_diagonal(own, 0.0)
        for t in range(len(inner)):
            np.minimum(own, own[:, t, None] + own[t], out=own)
        near = rim[(way[np.ix_(inner, rim)] < FAR).any(0)]
        reach = way[np.ix_(inner, near)]
        gain = _least_sums(own, reach)
        alone = _least_sums(own, begin[inner, None])
        way[np.ix_(near, near)] = np.minimum(way[np.ix_(near, near)], _least_sums(reach.T, gain))
        begin[near] = np.minimum(begin[near], _least_sums(reach.T, alone)[:, 0])
        yield front.back(near, alone, gain)
    if len(rim):
        left = way[np.ix_(rim, rim)]
        np.fill_diagonal(left, FAR)
        i, j = np.nonzero(left < FAR)
        ids = front.nodes[rim]
        yield front.row(NODE, ids, ids, begin=begin[rim])
        yield front.row(PAIR, ids[i], ids[j], way=left[i, j])
        yield front.unchanged()


def _fill(n: int, near: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    alone, gain = numbers[:n, None], numbers[n:].reshape(n, -1)
    return np.minimum(np.minimum(alone, _least_sums(gain, near)), FAR)


def _walk(now: DataFrame) -> DataFrame:
    """(a, level) of a graph with ranges too large for a task: round after round."""
    pairs = store(now.where(F.col("kind") == PAIR).select("a", "b", "way"))
    state = store(now.where(F.col("kind") == NODE).select("a", F.col("begin").alias("level")))
    while True:
        known = state.df.where(F.col("level") < FAR).select(F.col("a").alias("b"), F.col("level").alias("from"))
        ways = lookup(pairs.df, "b", known, pairs.stats["rows"])
        best = ways.groupBy("a").agg(F.min(F.col("from") + F.col("way")).alias("best"))
        nearer = F.coalesce(F.col("best") < F.col("level"), F.lit(False))
        step = state.df.join(best, "a", "left").select("a", F.least("level", "best").alias("level"), nearer.alias("moved"))
        after = store(step, moved=F.count_if("moved"))
        state.drop()
        state = after
        if not after.stats["moved"]:
            pairs.drop()
            return after.df.select("a", "level")


def _blocks_of_root(edges: DataFrame, root: int, near: str) -> tuple[DataFrame, DataFrame | None]:
    """(levels of the nodes in small blocks, edges of the others or None).

    Without the root the graph falls into blocks; ways to the root stay inside one.
    """
    start = F.lit(root)
    rows = store(
        edges.where(F.col("u") != F.col("v")).select("u", "v", near),
        free=F.count_if((F.col("u") != start) & (F.col("v") != start)),
    )
    free = rows.df.where((F.col("u") != start) & (F.col("v") != start))
    parts = components_near(free, near, rows.stats["free"]).df
    node = F.when(F.col("u") == start, F.col("v")).otherwise(F.col("u"))
    tagged = lookup(rows.df.select("u", "v", node.alias("node")), "node", parts, rows.stats["rows"], "left")
    tagged = store(tagged.select("u", "v", F.coalesce("component", "node").alias("block")))
    sizes = tagged.df.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    large = store(sizes.where(F.col("n") > SMALL).select("block"))
    small, others = tagged.df, None
    if large.stats["rows"]:
        small = tagged.df.join(large.df, "block", "left_anti")
        others = tagged.df.join(large.df, "block", "left_semi").select("u", "v")
    dealt = by_blocks(small, rows.stats["rows"])
    out = "node long, level long"

    def run(batches):
        for table in whole_blocks(batches):
            real = np.stack([table["u"].to_numpy(), table["v"].to_numpy()])
            nodes, levels = levels_from(real, real == root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(levels)], names=["node", "level"])

    return dealt.mapInArrow(run, out).unionByName(
        edges.sparkSession.range(1).select(start.cast("long").alias("node"), F.lit(0).cast("long").alias("level"))
    ), others


def hop_levels(edges: DataFrame, places: DataFrame, root: int, near: str | None = None, **sizes) -> DataFrame:
    """(node, level): the least number of edges from root, of every node it is joined to.

    edges: u, v; places: node, x, y, z of every node of the edges. With `near`, whole
    numbers of which those of neighbouring edges tend to be near, small blocks around
    the root are walked inside a task. sizes: leaf, fan and front of the sweep.
    """
    if near is not None:
        small, others = _blocks_of_root(edges, root, near)
        if others is not None:
            others = store(others).df
            ends = others.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            swept = hop_levels(others, places.join(ends, "node", "left_semi"), root, **sizes)
            small = small.unionByName(swept.where(F.col("node") != F.lit(root)))
        return store(small).df
    at = store(places.select("node", *AXES))
    spans = at.df.agg(*[f(a).alias(f"{n}{a}") for n, f in (("l", F.min), ("h", F.max)) for a in AXES]).first()
    corner = [spans[f"l{a}"] or 0.0 for a in AXES]
    extent = max((spans[f"h{a}"] or 0.0) - (spans[f"l{a}"] or 0.0) for a in AXES)
    place = curve_place([F.col(a) for a in AXES], corner, extent)
    order = store(ranked(at.df.withColumn("_place", place), "_place", "node", name="a", start=0).select("a", "node"))
    pairs = edges.where(F.col("u") != F.col("v")).select("u", "v")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    for side, out in (("u", "a"), ("v", "b")):
        both = lookup(both, side, order.df.select(F.col("node").alias(side), F.col("a").alias(out)))
    begin = F.when(F.col("node") == F.lit(root), 0.0).otherwise(FAR)
    rows = order.df.select(
        F.lit(NODE).alias("kind"), "a", F.col("a").alias("b"), F.lit(0.0).alias("way"), begin.alias("begin")
    ).unionByName(both.select(F.lit(PAIR).alias("kind"), "a", "b", F.lit(1.0).alias("way"), F.lit(0.0).alias("begin")))
    found = sweep(
        store(rows).df, ["way", "begin"], order.stats["rows"], _shortcuts, _fill, {"level": "begin"}, _walk, **sizes
    )
    near = found.where(F.col("level") < FAR).join(order.df, "a")
    return store(near.select("node", F.col("level").cast("long").alias("level"))).df
