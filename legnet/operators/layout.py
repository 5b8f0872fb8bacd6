"""Whole-table layout helpers: offsets and the choice of a separator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legnet.functions.names import SEPARATOR_CANDIDATES
from legnet.functions.vec import AXES, vec


def offset_points(df: DataFrame, point: str, mode: str, out: str) -> DataFrame:
    """Points as they are ('full'), around their centre or from the lowest corner."""
    if mode == "full":
        return df.withColumn(out, F.col(point))
    shift = []
    for a in AXES:
        c = F.col(f"{point}.{a}")
        middle = (F.min(c) + F.max(c)) / 2.0
        shift.append((middle if mode == "centred" else F.min(c)).alias(f"_s{a}"))
    moved = vec(*[F.col(f"{point}.{a}") - F.col(f"_s{a}") for a in AXES])
    one = df.agg(*shift)
    return df.crossJoin(F.broadcast(one)).withColumn(out, moved).drop(*[f"_s{a}" for a in AXES])


def pick_separator(names: DataFrame, separators: DataFrame | None = None) -> DataFrame:
    """First candidate character that no name contains, as one row.

    `separators` (one column) lists characters that were used as separators; such
    a character is preferred. '.' is the answer when nothing else is left.
    """
    spark = names.sparkSession
    chars = names.select(F.explode(F.split("name", "")).alias("c")).distinct()
    ranked = spark.createDataFrame(list(enumerate(SEPARATOR_CANDIDATES)), "rank int, c string")
    free = ranked.join(chars, "c", "left_anti")
    if separators is not None:
        used = separators.toDF("c").distinct().withColumn("_used", F.lit(0))
        free = free.join(used, "c", "left").withColumn(
            "rank", F.col("rank") + F.coalesce("_used", F.lit(1000))
        )
    best = free.agg(F.min_by("c", "rank").alias("c"))
    return best.select(F.coalesce("c", F.lit(".")).alias("separator"))
