"""Tables kept in versions: a manifest names the files, and only a manifest is renamed.

A version is written beside the one before it. Buckets that did not change are named
again, not copied. Readers take the newest manifest; a version whose rows fail its check
never gets one, so what was readable stays readable. Two writers of one number exclude
each other, as a rename does not replace a file.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table, by a hash of the component's name.
BUCKETS = 64
#: Files of one bucket at most, per write.
PIECES = 16


class GateError(RuntimeError):
    """Rows that must not be published; the version before stays the newest."""


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        if not self.fs.exists(self.at(path)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(path))]

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.at(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, old: str, new: str) -> bool:
        return not self.fs.exists(self.at(new)) and self.fs.rename(self.at(old), self.at(new))

    def drop(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


@dataclass
class Version:
    """One manifest: for every table its schema and the folder of each bucket."""

    path: str
    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)

    def folders(self, table: str) -> dict[int, str]:
        return {int(k): v for k, v in self.tables.get(table, {}).get("buckets", {}).items()}

    def read(self, spark: SparkSession, table: str, buckets: set[int] | None = None) -> DataFrame:
        """A table with its column `bucket`; only the named buckets' files are opened."""
        schema = StructType.fromJson(json.loads(self.tables[table]["schema"]))
        by: dict[str, list[int]] = {}
        for k, folder in self.folders(table).items():
            if buckets is None or k in buckets:
                by.setdefault(folder, []).append(k)
        out = spark.createDataFrame([], schema)
        for folder, ks in by.items():
            reader = spark.read.schema(schema).option("basePath", folder)
            out = out.unionByName(reader.parquet(*[f"{folder}/bucket={k}" for k in ks]))
        return out


def newest(spark: SparkSession, path: str) -> Version:
    """The newest version of a folder; number 0 where there is none."""
    files = _Files(spark, path)
    numbers = [int(n[9:-5]) for n in files.names(path) if n.startswith("manifest-") and n.endswith(".json")]
    if not numbers:
        return Version(path)
    data = json.loads(files.read(f"{path}/manifest-{max(numbers)}.json"))
    return Version(path, data["number"], data["tables"])


def bucket_of(component: Column) -> Column:
    return F.pmod(F.xxhash64(component), F.lit(BUCKETS)).cast("int")


def publish(
    spark: SparkSession, path: str, tables: dict[str, DataFrame], before: Version | None = None,
    changed: set[int] | None = None, errors: dict[str, Column] | None = None,
) -> Version:
    """Writes the tables (each with a column `bucket`) as the next version.

    With `changed` the tables hold the rows of these buckets alone and all other buckets
    are taken over from `before`. Rows for which a table's condition in `errors` holds are
    counted while they are written; any of them stops the version (GateError).
    """
    files = _Files(spark, path)
    before = before or newest(spark, path)
    run, found, made = uuid.uuid4().hex, {}, []
    try:
        for name, df in tables.items():
            folder = f"{path}/{name}/{run}"
            made.append(folder)
            seen = Observation()
            bad = F.count_if((errors or {}).get(name, F.lit(False))).alias("bad")
            piece = F.pmod(F.xxhash64(*[c for c in df.columns if c != "bucket"][:2]), F.lit(PIECES))
            df.observe(seen, bad).repartition("bucket", piece).write.partitionBy("bucket").parquet(folder)
            if seen.get["bad"]:
                raise GateError(f"{seen.get['bad']} rows of {name} must not be published")
            kept = {k: f for k, f in before.folders(name).items() if changed is not None and k not in changed}
            new = {int(n[7:]): folder for n in files.names(folder) if n.startswith("bucket=")}
            schema = StructType([*[f for f in df.schema if f.name != "bucket"], df.schema["bucket"]])
            found[name] = {"schema": schema.json(), "buckets": kept | new}
        after = Version(path, before.number + 1, found)
        draft = f"{path}/draft-{run}.json"
        made.append(draft)
        files.write(draft, json.dumps({"number": after.number, "tables": found}))
        if not files.move(draft, f"{path}/manifest-{after.number}.json"):
            raise GateError(f"version {after.number} was published by another run")
    except BaseException:
        for m in made:
            files.drop(m)
        raise
    return newest(spark, path)
