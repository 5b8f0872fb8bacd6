"""Settings on a stream against the batch join."""

import random

from pyspark.sql import functions as F

from legnet.operators.joins import resolve_settings
from legnet.streaming.settings_stream import unplaced, write_resolved

READING = "reading_id long, scope string, seq long, at timestamp, tape double, note string"
SETTING = "scope string, quantity string, unit double, zero double, scale double, sd double, seq long, at timestamp"
START, BIG = 1_700_000_000, 1 << 60



def table(spark, rows, ddl):
    names = ddl.replace(",", "").split()[::2]
    df = spark.createDataFrame(rows, ddl.replace("at timestamp", "at string"))
    return df.withColumn("at", F.expr("timestamp_micros(cast(at as long))")).select(*names)


def micros(seq):
    return str((START * 10 + seq) * 100_000 + seq % 7)


def test_stream_equals_batch(spark, tmp_path):
    pick = random.Random(5)
    scopes = ["", "a", "a.b", "a.b.c", "a.bc", "d", "d.e"]
    numbers = pick.sample(range(2000), 500)
    readings, settings = [], []
    for i, seq in enumerate(sorted(numbers)):
        if i % 3:
            scope = pick.choice([*scopes[1:], "d.e.f", None])
            readings.append((BIG + seq, scope, seq, micros(seq), seq / 7, None if i % 5 else 'x "é"'))
        else:
            quantity = pick.choice(["length", "bearing", "other"])
            settings.append((pick.choice(scopes), quantity, 0.1 * seq, seq / 3, None, 1.0, seq, micros(seq)))
    # A setting and a reading of one number: the setting counts.
    settings.append(("a", "length", 1.0, 2.0, 3.0, 4.0, 2001, micros(2001)))
    readings.append((BIG + 2001, "a.b.zz", 2001, micros(2001), 1.0, ""))
    end = (-1, "end", 10**6, micros(10**6), 0.0, "closes the stream")
    lost = (-2, "a", 5, None, 0.0, "no time")

    # Four parts by time; rows come up to half a part late, settings mostly after readings.
    def part(seq, late):
        return min(int((seq + late) // 500), 3)

    groups = [([], []) for _ in range(4)]
    for r in readings:
        groups[part(r[2], pick.choice([0, 200]))][0].append(r)
    for s in settings:
        groups[part(s[6], pick.choice([0, 200, 240]))][1].append(s)
    groups.append(([end, lost], []))
    quantities = ["length", "bearing"]

    def put(rows, ddl, name):
        table(spark, rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        def stream(name, ddl):
            return spark.readStream.schema(ddl).parquet(str(tmp_path / name))

        query = write_resolved(
            stream("r", READING), stream("s", SETTING), quantities, str(tmp_path / "out"), str(tmp_path / "ck"),
            delay="60 seconds", salts=3,
        )
        query.awaitTermination(120)
        assert query.exception() is None and not query.isActive

    for r, s in groups:  # stopped and started again between parts
        put(r, READING, "r")
        put(s, SETTING, "s")
        run()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    kept = table(spark, readings, READING)
    want = resolve_settings(kept, table(spark, settings, SETTING), quantities)
    columns = want.columns
    assert got.count() == len(readings)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.collect()))
    assert [r.reading_id for r in unplaced(table(spark, [*readings, lost], READING)).collect()] == [-2]
