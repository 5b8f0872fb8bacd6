"""Ranks over a whole table without a window over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legnet.plans.store import store


def ranked(df: DataFrame, *order: Column | str, name: str = "rank", start: int = 1) -> DataFrame:
    """df with the place of every row in the given order (ties in any order).

    Rows are dealt by ranges and sorted inside them; the number of rows before a
    range is added to the place in it. Only one count per task goes through the
    driver.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = store(
        dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_pos"))
    ).df
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], start
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    heads = df.sparkSession.createDataFrame(before, "_part int, _before long")
    row = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(heads), "_part")
        .withColumn(name, row + F.col("_before"))
        .drop("_part", "_pos", "_before")
    )
