"""Arrow batches in and out of tasks, and a total order cut into buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a batch that goes to Python: long texts must fit many times over.
BATCH_ROWS = 500


def tune(spark: SparkSession) -> None:
    """Session settings that the operators with Python stages rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame,
    fn: Callable[[dict], Iterator[dict] | dict],
    schema: StructType,
) -> DataFrame:
    """df through fn, a function from columns (lists) to columns (lists or arrays).

    fn is called once per Arrow batch and sees no other rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.to_pydict())
                arrays = [pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Order:
    """A total order by (id, tie) cut into buckets of bounded size.

    `edges` come from approximate quantiles, so buckets are near equal whatever the
    ids are; any edges give right results, and ids are compared as integers. An id that
    fills a whole bucket (and the missing ids) gets a bucket of its own, cut again by the
    tie hash.
    """

    SUBS = 256

    def __init__(self, df: DataFrame, key: str, rows_per_bucket: int = 100_000):
        rows = df.count()
        n = max(1, -(-rows // rows_per_bucket), shuffle_partitions(df.sparkSession))
        self.rows = rows
        found = []
        if rows:
            found = df.select(F.col(key).cast("double").alias("k")).approxQuantile(
                "k", [i / n for i in range(1, n)], 0.2 / n
            )
        seen, heavy = set(), set()
        for x in map(int, found):
            (heavy if x in seen else seen).add(x)
        # Beyond 2 ** 53 several ids share a quantile: those that fill a bucket are counted.
        if rough := [x for x in heavy if abs(x) >= 1 << 53]:
            ids = df.select(F.col(key).cast("long").alias("k"))
            held = ids.where(F.col("k").cast("double").isin([float(x) for x in rough]))
            full = held.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * n > rows)
            heavy = (heavy - set(rough)) | {r["k"] for r in full.collect()}
        least, most = -(1 << 63), (1 << 63) - 1
        self.heavy = sorted(heavy)
        edges = seen | heavy | {h + 1 for h in heavy}
        self.edges = sorted({min(max(e, least), most) for e in edges})

    def bucket(self, key: Column, tie: Column) -> Column:
        """Number of the bucket: increasing in (key, tie), missing keys first.

        `tie` is a number below 2**63 that never is NULL.
        """
        edges, heavy, subs = np.array(self.edges, np.int64), np.array(self.heavy, np.int64), self.SUBS

        @F.pandas_udf("long")
        def find(k, missing, t):
            import pandas as pd

            none, x = missing.to_numpy(dtype=bool), k.to_numpy(dtype="int64")
            place = np.searchsorted(edges, x, side="right").astype(np.int64) + 1
            place[none] = 0
            split = none | np.isin(x, heavy)
            sub = np.where(split, t.to_numpy(dtype="int64") >> 55, 0)
            return pd.Series(place * subs + sub)

        # A column with missing numbers would reach Python as doubles.
        whole = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
        return find(whole, key.isNull(), tie)


def tie_hash(*columns: Column) -> Column:
    """A hash from 0 to 2**63 - 1 of the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)
