"""The adjusted network as stored tables, the interchange between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks, and so files, of one outermost survey.
PIECES = 16

TABLES = ("stations", "legs", "traverses", "xsects")


def top_survey(name, sep="."):
    """Partition value: the outermost survey of a name, '_' where there is none."""
    head = F.substring_index(name, sep, 1)
    return F.when(F.instr(name, sep) > 0, head).otherwise("_")


def write_network(path: str, sep=".", **tables: DataFrame) -> None:
    """Writes the given tables as Parquet; stations and legs by outermost survey.

    Rows are dealt by survey first, and a survey to PIECES tasks at most, so there
    are few files per survey and no task has a whole large one.
    """
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        writer = df.write.mode("overwrite")
        key = {"stations": "name", "legs": "from_stn"}.get(name)
        if key:
            df = df.withColumn("top", top_survey(F.col(key), sep))
            piece = F.pmod(F.xxhash64(*df.columns[:2]), F.lit(PIECES))
            writer = df.repartition("top", piece).write.mode("overwrite").partitionBy("top")
        writer.parquet(f"{path}/{name}")


def read_network(spark: SparkSession, path: str, name: str, survey: str = "", sep=".") -> DataFrame:
    """A stored table; with a survey only its partition and rows are read."""
    df = spark.read.parquet(f"{path}/{name}")
    key = {"stations": "name", "legs": "from_stn"}.get(name)
    if survey and key:
        top = survey.split(sep)[0]
        df = df.where((F.col("top") == top) & F.col(key).startswith(survey + sep))
    return df.drop("top") if key else df
