"""Joins that stay balanced when one key holds a large share of the rows.

A key is heavy when it holds more than 1/pieces of all rows, so there are at
most `pieces` heavy keys: that list has a proven size and may be broadcast. Rows
of a heavy key are spread over numbered salts, and the matching row of the
lookup side is copied once per salt (fewer than 2 * pieces copies in total).
No task then gets more than about 1/pieces of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Below this row count a single key fits one task whatever its share.
SKEW_FLOOR = 20_000_000
MIN_PIECES = 1000


def pieces_for(df: DataFrame) -> int:
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_PIECES, 4 * shuffle)


def heavy_keys(df: DataFrame, key: str, rows: int, pieces: int) -> DataFrame:
    """(key, _salts) of keys with more than rows/pieces rows: at most `pieces`."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") * pieces > rows)
        .select(key, F.ceil(F.col("_n") * F.lit(pieces) / F.lit(rows)).cast("int").alias("_salts"))
    )


def lookup(
    df: DataFrame,
    key: str,
    table: DataFrame,
    rows: int | None = None,
    how: str = "inner",
    floor: int = SKEW_FLOOR,
    pieces: int | None = None,
    spread: list[str] | None = None,
) -> DataFrame:
    """df joined to a table holding at most one row per `key` (same name both sides).

    `rows` is the row count of df, known in loops that store their tables. Above
    `floor` rows heavy keys are salted; smaller inputs take a plain join. Without a
    count the join is left to adaptive execution, which splits the partitions of
    heavy keys as it finds them (see `session.tune`). The salt is a hash of the `spread` columns
    (all columns by default), so a repeated task puts every row where it was.
    """
    if rows is None or rows < floor:
        return df.join(table, key, how)
    pieces = pieces or pieces_for(df)
    heavy = F.broadcast(heavy_keys(df, key, rows, pieces))
    cells = F.xxhash64(*(spread or df.columns))
    salted = df.join(heavy, key, "left").withColumn(
        "_salt",
        F.when(
            F.col("_salts").isNotNull(), F.pmod(cells, F.col("_salts")).cast("int")
        ).otherwise(0),
    )
    copies = table.join(heavy, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return salted.drop("_salts").join(copies.drop("_salts"), [key, "_salt"], how).drop("_salt")
