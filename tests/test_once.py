"""Long input plans run once; tasks of a scan hold a bounded number of rows."""

import pytest
from pyspark.sql import functions as F

from legnet.operators import aggregates as A
from legnet.operators import forest as FO
from legnet.operators import graph as GR
from legnet.operators import windows as W
from legnet.plans import scan


def counted(df):
    """df, and how many of its rows were made so far."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), made


def test_edges_are_made_once_for_dead_ends(spark):
    edges = spark.range(40).select(F.col("id").alias("eid"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    df, made = counted(edges)
    pinned = spark.createDataFrame([(0,), (20,)], "id long")
    rows = FO.peel_dead_ends(df, pinned).collect()
    assert {r.eid for r in rows if r.dead_end} == set(range(20, 40))
    assert made.value == 40


def test_edges_are_made_once_for_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(i, 90) for i in range(30, 50)] + [(70, 70), (5, 5), (90, 30)]
    df, made = counted(spark.createDataFrame(pairs, "u long, v long"))
    got = {r.node: r.component for r in GR.components(df).df.collect()}
    assert got == {i: 0 for i in range(21)} | {i: 30 for i in (*range(30, 50), 90)} | {70: 70}
    assert made.value == len(pairs)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_interleaved_rows_are_made_once(spark, chunk):
    rows = [("a", 1, "s1", None), ("a", 2, None, 1.0), ("a", 3, "s2", None), ("a", 4, "s3", None), ("a", 5, None, 2.0),
            ("a", 6, None, 3.0), ("a", 7, "s4", None), ("a", 8, None, 4.0), ("b", 1, None, 5.0), ("b", 2, "t1", None),
            ("b", 3, None, 6.0), ("b", 4, "t2", None)]
    df, made = counted(spark.createDataFrame(rows, "k string, seq long, station string, tape double"))
    got = W.interleaved_to_legs(df, ["k"], chunk=chunk).collect()
    assert {tuple(r) for r in got} == {
        ("a", 2, "s1", "s2", 1.0), ("a", 6, "s3", "s4", 3.0), ("b", 3, "t1", "t2", 6.0),
    }
    assert made.value == len(rows)


def test_tasks_of_a_scan_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ROWS", 100)
    legs = spark.range(2000).select(
        F.floor(F.col("id") / 5).alias("k"), F.col("id").alias("seq"), F.lit("p").alias("from_stn"), F.lit("q").alias("to_stn"),
        F.struct(*[F.col("id").cast("double").alias(a) for a in "xyz"]).alias("d"),
        F.struct(*[F.lit(1.0).alias(p) for p in ("xx", "yy", "zz", "xy", "yz", "zx")]).alias("v"),
    )
    out = A.average_repeats(legs, ["k"])
    parts = out.select("n", F.spark_partition_id().alias("p")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in parts) == 2000 and max(r.n for r in parts) < 400
    assert {(r.k, r.seq, r.n, r.d.x) for r in out.collect()} == {(k, 5 * k, 5, 5 * k + 2.0) for k in range(400)}


def test_large_tables_are_not_broadcast_unasked(spark):
    from legnet.plans.session import tune

    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    try:
        for given, want in (("10MB", 1 << 20), ("256k", 256 << 10), ("-1", -1)):
            spark.conf.set(key, given)
            tune(spark)
            assert spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() == want
    finally:
        spark.conf.set(key, was)


def test_inputs_of_an_elevation_are_made_once(spark):
    from legnet.operators.extend import extend_elevation
    from test_extend import PLACES, TREE

    places = spark.createDataFrame([(k, *map(float, v)) for k, v in PLACES.items()], "name string, x double, y double, z double")
    legs = spark.createDataFrame(TREE + [("e", "a", 0), ("b", "w", 4)], "from_stn string, to_stn string, flags int")
    rules = spark.createDataFrame([("left", "c", None), ("break", "e", "a")], "kind string, a string, b string")
    inputs = [counted(df) for df in (legs, places, rules)]
    out = extend_elevation(inputs[0][0], inputs[1][0], "a", inputs[2][0], show_breaks=True)
    assert (out.stations.count(), out.legs.count(), out.splays.count(), out.breaks.count()) == (7, 6, 1, 1)
    assert [made.value for _, made in inputs] == [7, 7, 2]
