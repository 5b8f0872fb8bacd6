"""Sinks and lists leave no more on disk than they must."""

import gzip
import os

from pyspark.sql import functions as F

from legnet.checks import files
from legnet.operators import aggregates as A
from legnet.operators import passages as PS
from legnet.plans.scan import large_groups
from legnet.sinks import render as K
from test_once import counted


def test_gzip_files_joined_are_the_rendered_file(spark, tmp_path):
    lines = spark.range(3000).select(
        (F.col("id") % 3).alias("part"), F.format_string("%05d", "id").alias("place"), F.format_string("line %d", "id").alias("value")
    )
    whole = {}
    for kind in ("none", "gzip"):
        path = str(tmp_path / kind)
        K.write_lines(lines, path, kind)
        whole[kind] = b"".join(open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.startswith("part-"))
    assert gzip.decompress(whole["gzip"]) == whole["none"]
    want = [f"line {i}" for k in range(3) for i in range(k, 3000, 3)]
    assert whole["none"].decode().splitlines() == want


def test_queries_keep_their_files_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_path", lambda _: str(tmp_path / "out"))
    lines = spark.range(20000).select(F.lit(0).alias("part"), F.lit("").alias("place"), F.lit("<coordinates>").alias("value"))
    assert files._written(spark, lines).count() == 20000
    assert sum(f.stat().st_size for f in (tmp_path / "out").iterdir()) < 20000


def test_lists_are_gathered_from_sorted_rows(spark):
    lists = spark.range(4000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sort_array(F.collect_list("id")).alias("v"))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan
    assert all(r.v == [r.k + 1000 * i for i in range(4)] for r in lists.collect())


def test_sections_are_made_once_where_long_tubes_are_known(spark):
    rows = [(t, i, float(i), float(t), 0.0, 1.0, 1.0, 1.0, 1.0) for t in range(3) for i in range(4)]
    df, made = counted(spark.createDataFrame(rows, "tube_id long, seq long, x double, y double, z double, l double, r double, u double, d double"))
    got = PS.passage_quads(PS.tube_frames(df, large=None), large=None).collect()
    assert len(got) == 9 and made.value == 12
    # Long tubes take the way across chunks with the same keys.
    large = large_groups(df, ["tube_id"], 3)
    assert large.count() == 3
    again = PS.passage_quads(PS.tube_frames(df, 3, large), chunk=3, large=large).collect()
    assert sorted(again) == sorted(got)


def test_items_of_polylines_are_counted_once(spark):
    rows = [(k, i, i == 0, float(i), 0.0, 0.0, int(i > 2), "s", "NORMAL", 1) for k in range(2) for i in range(6)]
    df, made = counted(spark.createDataFrame(
        rows, "k int, seq long, move boolean, x double, y double, z double, flags int, survey string, style string, days1 int"
    ))
    for chunk in (4, 1000):
        got = {(r.k, r.polyline, r.flags, r.seq, r.prev.x, r.x) for r in A.ordered_items(df, ["k"], "seq", chunk).collect()}
        assert got == {(k, 1 + (i > 2), int(i > 2), i, i - 1.0, float(i)) for k in range(2) for i in range(1, 6)}, chunk
    made_before = made.value
    A.ordered_items(df, ["k"], "seq", 1000).collect()
    assert made.value - made_before == 2 * len(rows)
