"""Reductions on a stream of readings.

The reductions, scalar functions and row rules are projections and filters, so a
streaming DataFrame goes through them unchanged in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from legnet.operators.reduce import Calibration, reduce_normal


def read_readings_stream(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def reduce_stream(readings: DataFrame, cal: Calibration | None = None) -> DataFrame:
    return reduce_normal(readings, cal)


def write_legs(legs: DataFrame, path: str, checkpoint: str):
    """Appends legs as Parquet; the checkpoint makes each reading count once."""
    return (
        legs.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
