"""Text formats as a Spark data source that drops other surveys while reading.

A file is a row of records: lines of a position listing, form-feed separated survey
blocks, sections of a plot file. Each has a key that is found without parsing the
record: the station's name, the survey, the section. Conditions on the key
(`startswith`, `=`, `IN`) are pushed into the reader, so the text of other surveys
never leaves it; what is left is parsed by the expressions of the readers. Files are
read in splits of bytes: a split owns the records that start in it.

Files are opened with pyarrow's file systems, in the tasks. Compressed files are one
split each. A record must fit a task; batches are cut by rows and by bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith,
)

from legnet.sources import readers as S

FORMAT = "survey_records"
SPLIT_BYTES = 128 << 20
READ_BYTES = 1 << 20
#: Endings of files that pyarrow unpacks; these cannot be split.
PACKED = ("gz", "bz2", "lz4", "zst")
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20

_SURVEY = re.compile(rb"SURVEY NAME:[ \t\n\x0b\f\r]*(\S*)")
_SECTION = re.compile(rb"N(\S*)")


def _station(line: bytes) -> bytes | None:
    place, mark, name = line.rstrip(b"\r").partition(b")")
    if not mark:
        return None
    name = name.lstrip(b" \t")
    return name[1:] if name.startswith(b"\\") else name


def _survey(block: bytes) -> bytes:
    lines = block[:READ_BYTES].replace(b"\r", b"").lstrip(b"\n").split(b"\n", 9)
    found = _SURVEY.search(b"\n".join(lines[:9]))
    return found[1] if found else b""


def _section(part: bytes) -> bytes | None:
    found = _SECTION.match(part)
    return found[1] if found else None


#: Mark before which a record ends (its first byte belongs to no record), and the key.
KINDS = {"positions": (b"\n", _station), "blocks": (b"\f", _survey), "sections": (b"\nN", _section)}


def records(stream, start: int, end: int | None, mark: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records that start in [start, end)."""
    base = max(start - 1, 0)  # offset of data[0]
    if base:
        stream.seek(base)
    data, low, scan = b"", 0, 0
    inside = start == 0
    while end is None or base + low < end:
        hit = data.find(mark, scan)
        if hit < 0:
            more = stream.read(max(READ_BYTES, len(data) - low))
            if not more:
                if inside and low < len(data):
                    yield base + low, data[low:]
                return
            if not inside:  # nothing of what was searched is wanted
                low = max(low, len(data) - len(mark) + 1)
            scan = max(0, len(data) - len(mark) + 1 - low)
            data, base, low = data[low:] + more, base + low, 0
            continue
        if inside:
            yield base + low, data[low:hit]
        inside, low = True, hit + 1
        scan = low


def _resolve(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class RecordReader(DataSourceReader):
    def __init__(self, path: str, kind: str, split: int):
        self.path, self.kind, self.split = path, kind, split
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | IsNotNull | StringStartsWith) and f.attribute == ("key",):
                self.tests.append(f)
            else:
                yield f

    def wanted(self, key: str | None) -> bool:
        """Whether a key meets all pushed conditions; a missing key meets none."""
        for f in self.tests:
            if key is None:
                return False
            if isinstance(f, StringStartsWith) and not key.startswith(f.value):
                return False
            if isinstance(f, EqualTo) and key != f.value:
                return False
            if isinstance(f, In) and key not in f.value:
                return False
        return True

    def partitions(self) -> list[Split]:
        system, path = _resolve(self.path)
        found = system.get_file_info(path)
        if found.type == FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found]
        if found.type == FileType.Directory:
            files = sorted(system.get_file_info(FileSelector(path)), key=lambda f: f.path)
        out = []
        for f in files:
            if f.type == FileType.File and f.size and not f.base_name.startswith(("_", ".")):
                step = self.split
                if f.extension in PACKED:
                    out.append(Split(f.path, 0, None))
                else:
                    out += [Split(f.path, a, a + step) for a in range(0, f.size, step)]
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        system, _ = _resolve(self.path)
        mark, key_of = KINDS[self.kind]
        shape = pa.schema([("file", pa.string()), ("start", pa.int64()), ("key", pa.string()), ("text", pa.string())])
        rows, size = [], 0
        packed = partition.end is None
        with system.open_input_stream(partition.path) if packed else system.open_input_file(partition.path) as stream:
            for at, body in records(stream, partition.start, partition.end, mark):
                raw = key_of(body)
                key = None if raw is None else raw.decode("utf-8", "replace")
                if not self.wanted(key):
                    continue
                rows.append((partition.path, at, key, body.decode("utf-8", "replace")))
                size += len(body)
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), shape)], schema=shape)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), shape)], schema=shape)


class SurveyRecords(DataSource):
    """Options: path (a file or a folder of files), kind (see KINDS), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, start long, key string, text string"

    def reader(self, schema) -> RecordReader:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        split = int(self.options.get("splitBytes", SPLIT_BYTES))
        if split < 1:
            raise ValueError("splitBytes must be positive")
        return RecordReader(self.options["path"], kind, split)


def read_records(spark: SparkSession, path: str, kind: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, start, key, text) of every record; `start` is its offset in bytes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SurveyRecords)
    return spark.read.format(FORMAT).option("kind", kind).option("splitBytes", split_bytes).load(path)


def positions(spark: SparkSession, path: str, survey: str = "", bad=False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """As `readers.read_pos`. Conditions on `name`, also later ones, reach the reader."""
    lines = read_records(spark, path, "positions", split_bytes).select(
        "file", F.col("start").alias("line_no"), "key", F.regexp_replace("text", r"\r$", "").alias("value")
    )
    return S.positions_of(lines, survey, bad, name=F.col("key"))


def survey_blocks(
    spark: SparkSession, path: str, corrected=False, survey: str = "", bad=False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """As `readers.read_survey_blocks`; blocks of other surveys are dropped by the reader."""
    blocks = read_records(spark, path, "blocks", split_bytes)
    if survey:
        blocks = blocks.where(F.col("key") == survey)
    blocks = blocks.select(
        "file", F.col("start").alias("block"), F.lit(0).cast("long").alias("row"), F.col("text").alias("value")
    )
    return S.shots_of(blocks, corrected, survey, bad)


def plot_lines(
    spark: SparkSession, path: str, survey: str = "", bad=False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """As `readers.read_plot_lines`; other sections are dropped by the reader.

    A line's number is its section's offset plus its place in it.
    """
    parts = read_records(spark, path, "sections", split_bytes)
    if survey:
        parts = parts.where(F.col("key") == survey)
    lines = parts.select("file", "start", F.posexplode(F.split("text", "\n")).alias("place", "line")).select(
        "file", (F.col("start") + F.col("place")).alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("value")
    )
    return S.points_of(lines, survey, bad)
