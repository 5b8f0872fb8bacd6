"""A solved network kept in versions, and solved again only where it changes.

The parts of a network without legs between them are independent. A change touches the
components of the stations it names: these are solved anew, all other positions stay as
they are, and only the buckets that hold the touched components are written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legnet.operators.adjust import adjust
from legnet.operators.graph import component_names
from legnet.operators.joins import apply_fixes
from legnet.plans.skew import lookup
from legnet.plans.store import cut
from legnet.sources.versions import Version, bucket_of, newest, publish


def _errors() -> dict[str, Column]:
    """Positions that are no numbers stop a version."""
    return {"stations": ~(F.abs("x") + F.abs("y") + F.abs("z") < float("inf"))}


def _parts(legs: DataFrame, fixes: DataFrame) -> DataFrame:
    """(name, component): the component is called after its first station by name."""
    named = component_names(legs.select("from_stn", "to_stn"))
    first = named.groupBy("component").agg(F.min("name").alias("least"))
    linked = lookup(named, "component", first).select("name", F.col("least").alias("component"))
    alone = fixes.select(F.col("station").alias("name")).distinct().join(linked, "name", "left_anti")
    return linked.unionByName(alone.withColumn("component", F.col("name")))


def _solved(legs: DataFrame, fixes: DataFrame) -> dict[str, DataFrame]:
    """legs, fixes and stations with component and bucket, positions solved."""
    legs, fixes = cut(legs), cut(fixes)
    parts = cut(_parts(legs, fixes))
    tied, pinned = apply_fixes(legs, fixes)
    places = adjust(tied.select("from_stn", "to_stn", "d", "v"), pinned.select("name", "x", "y", "z")).positions
    out = {"legs": (legs, "from_stn"), "fixes": (fixes, "station"), "stations": (places, "name")}

    def tagged(df: DataFrame, key: str) -> DataFrame:
        of = parts.select(F.col("name").alias(key), "component")
        return lookup(df, key, of).withColumn("bucket", bucket_of(F.col("component")))

    return {name: cut(tagged(*given)) for name, given in out.items()}


def solve_first(spark: SparkSession, path: str, legs: DataFrame, fixes: DataFrame) -> Version:
    """Solves and publishes a whole network.

    legs: leg_id, from_stn, to_stn, d, v and more; fixes: as schema.FIXES. Stations of a
    component without a fix have no position and are not in the table of stations.
    """
    return publish(spark, path, _solved(legs, fixes), errors=_errors())


def solve_change(
    spark: SparkSession, path: str, changed: DataFrame | None = None, removed: DataFrame | None = None,
) -> Version:
    """The next version after legs were added or replaced (`changed`) or `removed`.

    changed: as the legs, a leg replaces the one of its leg_id; removed: leg_id. A change
    may join components or split them.
    """
    before = newest(spark, path)
    every = before.read(spark, "legs")
    new = changed if changed is not None else every.limit(0)
    new = cut(new.select(*[c for c in every.columns if c not in ("component", "bucket")]))
    gone = new.select("leg_id")
    if removed is not None:
        gone = gone.unionByName(removed.select("leg_id"))
    gone = cut(gone.distinct())
    old = every.join(gone, "leg_id", "left_semi").select("component")
    names = new.select(F.explode(F.array("from_stn", "to_stn")).alias("name")).distinct()
    for table, key in (("legs", "from_stn"), ("legs", "to_stn"), ("fixes", "station")):
        have = before.read(spark, table).select(F.col(key).alias("name"), "component")
        old = old.unionByName(have.join(names, "name", "left_semi").select("component"))
    touched = cut(old.distinct())
    # At most BUCKETS numbers.
    held = {r[0] for r in touched.select(bucket_of(F.col("component"))).distinct().collect()}

    def part(table: str, buckets: set[int], how: str) -> DataFrame:
        return before.read(spark, table, buckets).join(touched, "component", how)

    legs = part("legs", held, "left_semi").drop("component", "bucket").join(gone, "leg_id", "left_anti")
    fixes = part("fixes", held, "left_semi").drop("component", "bucket")
    fresh = _solved(legs.unionByName(new), fixes)
    for df in fresh.values():
        held |= {r[0] for r in df.select("bucket").distinct().collect()}
    tables = {t: df.unionByName(part(t, held, "left_anti")) for t, df in fresh.items()}
    return publish(spark, path, tables, before, held, _errors())
