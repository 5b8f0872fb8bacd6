"""Differences between two versions of a set of named positions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legnet.plans.scan import CHUNK, ordered_scan
from legnet.plans.store import store

# Default threshold and the slack added to it (metres).
DEFAULT_THRESHOLD = 0.01
SLACK = 1e-6


def within(a, b, threshold: float) -> Column:
    """Whether two places agree on every axis."""
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & (F.abs(F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) - threshold <= SLACK)
    return ok


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(
        "name", F.col("seq").alias(f"{side}_seq"), *[F.col(c).alias(f"{side}_{c}") for c in "xyz"]
    )


def _occurrence(df: DataFrame, keys: list[str], seq: str, chunk: int) -> DataFrame:
    return ordered_scan(df, keys, seq, running={"_occ": F.lit(1).cast("long")}, chunk=chunk)


def _cell(side: str, threshold: float, shift: tuple[int, ...]) -> list[Column]:
    """Cells of twice the threshold, each axis shifted by half a cell or not.

    Two places within the threshold on every axis share a cell in one at least of
    the eight grids.
    """
    size = 2.002 * (max(threshold, 0.0) + SLACK)
    return [
        F.floor(F.col(f"{side}_{c}") / size + half / 2).alias(f"_{c}")
        for c, half in zip("xyz", shift)
    ]


def _pair_repeated(o: DataFrame, n: DataFrame, threshold: float, chunk: int, columns) -> DataFrame:
    """Pairs of places of repeated names, unpaired places on either side included.

    Places within the threshold are paired first, grid by grid by their order in a
    cell, until no grid finds a pair more; what is left is paired by order.
    """
    found = []
    old, new = store(o), store(n)
    keys = ["name", "_x", "_y", "_z"]
    grids, idle = list(product((0, 1), repeat=3)), 0
    while idle < len(grids) and old.stats["rows"] and new.stats["rows"]:
        grid = grids[0]
        grids = [*grids[1:], grid]
        left = _occurrence(old.df.select("*", *_cell("old", threshold, grid)), keys, "old_seq", chunk)
        right = _occurrence(new.df.select("*", *_cell("new", threshold, grid)), keys, "new_seq", chunk)
        both = left.join(right, [*keys, "_occ"]).where(within("new", "old", threshold))
        hit = store(both.select(*columns))
        idle += 1
        if hit.stats["rows"]:
            idle = 0
            found.append(hit.df)
            rest_old = store(old.df.join(hit.df.select("name", "old_seq"), ["name", "old_seq"], "left_anti"))
            rest_new = store(new.df.join(hit.df.select("name", "new_seq"), ["name", "new_seq"], "left_anti"))
            old.drop()
            new.drop()
            old, new = rest_old, rest_new
    left = _occurrence(old.df, ["name"], "old_seq", chunk)
    right = _occurrence(new.df, ["name"], "new_seq", chunk)
    out = left.join(right, ["name", "_occ"], "full").select(*columns)
    for pairs in found:
        out = out.unionByName(pairs)
    return out


def position_diff(
    old: DataFrame, new: DataFrame, threshold: float = DEFAULT_THRESHOLD, chunk: int = CHUNK
) -> DataFrame:
    """Every station as Same, Moved, Added or Deleted, with the move.

    Inputs: name, seq, x, y, z. A name that occurs once on both sides is compared
    directly. Places of a repeated name are paired with a partner within the
    threshold where there is one, else by order of occurrence. Every pass is an
    equality join on a numbered occurrence: a name repeated many times never forms
    all pairs.
    """
    o, n = _side(old, "old"), _side(new, "new")
    repeated = store(
        old.select("name", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionAll(new.select("name", F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy("name")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where((F.col("a") > 1) | (F.col("b") > 1))
        .select("name")
    )
    if not repeated.stats["rows"]:
        out = o.join(n, "name", "full")
    else:
        names = repeated.df
        out = o.join(names, "name", "left_anti").join(n.join(names, "name", "left_anti"), "name", "full")
        out = out.unionByName(
            _pair_repeated(
                o.join(names, "name", "left_semi"), n.join(names, "name", "left_semi"),
                threshold, chunk, out.columns,
            )
        )
    status = (
        F.when(F.col("old_seq").isNull(), "Added")
        .when(F.col("new_seq").isNull(), "Deleted")
        .when(within("new", "old", threshold), "Same")
        .otherwise("Moved")
    )
    moves = [(F.col(f"new_{c}") - F.col(f"old_{c}")).alias(f"d{c}") for c in "xyz"]
    return out.withColumn("status", status).select("name", "status", *moves)


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names in new more often than in old, once per extra occurrence."""
    return new.select("name").exceptAll(old.select("name"))


def deleted(old: DataFrame, new: DataFrame) -> DataFrame:
    return added(new, old)


def unchanged(old: DataFrame, new: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Names on both sides at the same place within the threshold."""
    return position_diff(old, new, threshold).where(F.col("status") == "Same").select("name")


def union_inputs(*tables: DataFrame) -> DataFrame:
    """Several inputs as one table; a column missing from one is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
