"""Cutting lineage in driver loops.

Every round of an iterative operator is written as a Parquet table in the
shared folder named by `spark.checkpoint.dir`. A written table survives the loss
of executors, gives the optimizer true sizes and lets later rounds read only the
columns they need. Counts that steer the loop are observed while writing, so a
round is one job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """Shared folder of the cluster; a temporary one only in a local session without it."""
    context = spark.sparkContext
    folder = spark.conf.get(_KEY, None) or context.getConf().get(_KEY)
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder that all executors share")
        app = context.applicationId
        folder = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="legnet-"))
    return folder.rstrip("/")


class Stored:
    """A written table with the values observed while writing it."""

    def __init__(self, df: DataFrame, path: str, stats: dict):
        self.df, self.path, self.stats = df, path, stats

    def drop(self) -> None:
        """Removes the files of a table that no later plan reads."""
        spark = self.df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, **stats) -> Stored:
    """Writes df and returns it read back, with observed aggregates in .stats.

    `stats` are aggregate Columns; the row count is always observed as `rows`.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/legnet-{uuid.uuid4().hex}"
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [c.alias(name) for name, c in stats.items()]
    df.observe(seen, *metrics).write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path, seen.get)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage replaced by a written table."""
    return store(df).df
