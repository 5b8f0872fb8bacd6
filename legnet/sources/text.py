"""Numbered lines of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legnet.plans.rank import ranked
from legnet.plans.store import cut


# Lines of consecutive parts are numbered this far apart.
PART_SPAN = 1 << 42


def numbered_lines(spark: SparkSession, path: str, parts=False) -> DataFrame:
    """(file, line_no, value): lines with a number that rises along each file.

    A file may be read in several splits. A line's number is the byte offset of
    its split plus its place in the split; a line takes at least one byte, so
    numbers never clash and keep the order of the file (they are not dense). The
    lines are stored once, so both sides of the join see the same splits. With
    `parts` all files count as one, ordered by name.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_replace("value", r"\r$", "").alias("value"),
    )
    raw = cut(raw)
    first = raw.groupBy("file", "block").agg(F.min("row").alias("first"))
    number = F.col("block") + F.col("row") - F.col("first")
    if parts:
        first = first.join(ranked(first.select("file").distinct(), "file", start=0), "file")
        number = F.col("rank") * F.lit(PART_SPAN) + number
    lines = raw.join(first, ["file", "block"])
    file = F.lit(path) if parts else F.col("file")
    return lines.select(file.alias("file"), number.alias("line_no"), "value")
