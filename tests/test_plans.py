"""Skew-safe joins and chunked scans give what plain joins and windows give."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from legnet.plans.scan import ordered_scan, segment
from legnet.plans.skew import heavy_keys, lookup
from legnet.plans.store import store, work_folder


def hot(spark):
    """A third of the rows has one key."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 100).cast("long").alias("k"),
        F.col("id").alias("row"),
    )


def test_heavy_keys_are_few(spark):
    keys = heavy_keys(hot(spark), "k", 900, 10).collect()
    assert [r.k for r in keys] == [7]
    assert keys[0]._salts >= 3


def test_salted_lookup_equals_plain_join(spark):
    table = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        plain = hot(spark).join(table.where(F.col("k") < 130), "k", how)
        salted = lookup(hot(spark), "k", table.where(F.col("k") < 130), 900, how, floor=0, pieces=10)
        assert sorted(map(tuple, salted.select("k", "row", "w").collect()), key=repr) == sorted(
            map(tuple, plain.select("k", "row", "w").collect()), key=repr
        )


def test_salted_rows_are_spread(spark):
    table = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    plan = lookup(hot(spark), "k", table, 900, floor=0, pieces=10)
    assert plan.count() == 900


@pytest.mark.parametrize("chunk", [7, 1000])
def test_scan_across_chunks(spark, chunk):
    df = spark.range(60).select(
        F.when(F.col("id") % 2 == 0, "a").alias("g"), F.col("id").alias("seq"),
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("mark"),
    )
    got = ordered_scan(
        df, ["g"], "seq", lag={"prev": F.col("seq")}, carry={"held": F.col("mark")},
        running={"total": F.col("seq")}, chunk=chunk, lead={"following": F.col("mark")},
    )
    w = Window.partitionBy("g").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns(
        {"prev": F.lag("seq").over(w), "held": F.last("mark", True).over(upto), "total": F.sum("seq").over(upto),
         "following": F.lead("mark").over(w)}
    )
    cols = ["g", "seq", "mark", "prev", "held", "total", "following"]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(
        map(tuple, want.select(cols).collect()), key=repr
    )


def test_segments(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("aabbbac")], "seq long, c string").withColumn("g", F.lit(1))
    got = [r.segment for r in segment(df, ["g"], "seq", ["c"], chunk=2).orderBy("seq").collect()]
    assert got == [1, 1, 2, 2, 2, 3, 4]


def test_store_observes_and_drops(spark):
    import os

    s = store(spark.range(10).toDF("x"), total=F.sum("x"))
    assert s.stats == {"rows": 10, "total": 45}
    assert s.path.startswith(work_folder(spark))
    s.drop()
    assert not os.path.exists(s.path)
