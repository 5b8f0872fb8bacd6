"""Settings in force on a stream of readings.

Readings and settings come in any order within `delay` of each other's times. A reading
waits until the watermark has passed its time, so every setting before it has come; then
it takes the settings that `joins.resolve_settings` gives it. State is kept by scope: the
settings in force, the younger ones, and the places of waiting readings. A reading asks
its own scope and all outer ones; as an outer scope may be asked by every reading, each
scope is kept in `salts` copies, of which a reading asks one. All answers to a reading
leave in one micro-batch, so the nearest is picked there, without more state.

`seq` must rise with the time `at`. Rows later than the watermark are dropped by Spark;
rows without a time or a sequence number cannot be placed: `unplaced` returns them.
Readings younger than the watermark stay waiting when a run ends and leave in a later one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from legnet.functions.names import ancestors, depth_of

VALUE = ("unit", "zero", "scale", "sd")
#: Timestamps keep their microseconds on the way through JSON.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _placed() -> Column:
    return F.col("at").isNotNull() & F.col("seq").isNotNull()


def unplaced(rows: DataFrame) -> DataFrame:
    """Readings or settings without a time or a sequence number."""
    return rows.where(~_placed())


def _events(readings: DataFrame, settings: DataFrame, sep: str, salts: int) -> DataFrame:
    none = F.lit(None).cast("string")
    told = settings.where(_placed()).select(
        F.col("scope").alias("_scope"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        "seq", "at", "quantity",
        F.to_json(F.struct(*VALUE), {"ignoreNullFields": "false"}).alias("value"),
        none.alias("rid"), none.alias("body"),
    )
    scope = F.col("scope")
    # A reading without a scope asks one that no setting has.
    places = F.array_distinct(F.concat(F.array(scope), ancestors(scope, sep), F.array(F.lit(""))))
    asked = readings.where(_placed()).select(
        F.posexplode(F.coalesce(places, F.array(none))).alias("_i", "_scope"),
        F.pmod(F.xxhash64("reading_id"), F.lit(salts)).cast("int").alias("_salt"),
        "seq", "at", none.alias("quantity"), none.alias("value"),
        F.coalesce(F.col("reading_id").cast("string"), F.lit("")).alias("rid"),
        F.to_json(F.struct("*"), _JSON).alias("body"),
    )
    asked = asked.withColumn("body", F.when(F.col("_i") == 0, F.col("body"))).drop("_i")
    return told.unionByName(asked).withColumn("ms", F.unix_millis("at"))


def _answer(places: list[str]):
    """The state function: answers of one scope to the readings whose time has passed."""
    shape = ["rid", "_scope", "body", *(f"v{i}" for i in range(len(places)))]
    number = {q: i for i, q in enumerate(places)}

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, waiting = json.loads(state.get[0]) if state.exists else ([], [])
        for rows in frames:
            columns = [rows[c].tolist() for c in ("seq", "ms", "quantity", "value", "rid", "body")]
            for seq, ms, quantity, value, rid, body in zip(*columns):
                if isinstance(rid, str):
                    waiting.append([seq, ms, rid, body if isinstance(body, str) else None])
                elif quantity in number:
                    told.append([seq, ms, number[quantity], value])
        passed = state.getCurrentWatermarkMs() - 1
        ready = sorted((w for w in waiting if w[1] < passed), key=lambda w: w[0])
        waiting = [w for w in waiting if w[1] >= passed]
        told.sort(key=lambda t: (t[0], t[2], t[3]))
        out, force, at = [], [None] * len(places), 0
        for seq, _, rid, body in ready:
            while at < len(told) and told[at][0] <= seq:
                force[told[at][2]] = told[at][3]
                at += 1
            out.append((rid, key[0], body, *force))
        # Of the settings that have passed only the last of each quantity can matter again.
        last = {t[2]: t for t in told if t[1] < passed}
        told = [*last.values(), *(t for t in told if t[1] >= passed)]
        if told or waiting:
            state.update((json.dumps([told, waiting]),))
            if waiting:
                state.setTimeoutTimestamp(min(w[1] for w in waiting) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=shape, dtype=object)

    return run


def answers(
    readings: DataFrame, settings: DataFrame, quantities: list[str], delay="1 hour", sep=".", salts: int = 16
) -> DataFrame:
    """A streaming table with a row per reading and scope it asks."""
    events = _events(readings, settings, sep, salts).withWatermark("at", delay)
    shape = ", ".join(["rid string, _scope string, body string", *(f"v{i} string" for i in range(len(quantities)))])
    return events.groupBy("_scope", "_salt").applyInPandasWithState(
        _answer(quantities), shape, "state string", "append", GroupStateTimeout.EventTimeTimeout
    )


def nearest(
    batch: DataFrame, quantities: list[str], reading: StructType, value: StructType, sep="."
) -> DataFrame:
    """The readings of one micro-batch of answers, each with its settings."""
    picked = batch.withColumn("_depth", depth_of(F.col("_scope"), sep)).groupBy("rid").agg(
        F.max("body").alias("body"),
        *[
            F.max_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), F.col("_depth"))).alias(f"v{i}")
            for i in range(len(quantities))
        ],
    )
    return picked.select(
        F.from_json("body", reading, _JSON).alias("_r"),
        *[F.from_json(f"v{i}", value).alias(f"cal_{q}") for i, q in enumerate(quantities)],
    ).select("_r.*", *[f"cal_{q}" for q in quantities])


def write_resolved(
    readings: DataFrame, settings: DataFrame, quantities: list[str], path: str, checkpoint: str,
    delay="1 hour", sep=".", salts: int = 16,
):
    """Starts the stream; every micro-batch overwrites its own folder, so none counts twice.

    Reading ids must be unique.
    """
    value = settings.select(*VALUE).schema
    shape = readings.schema

    def save(batch: DataFrame, number: int) -> None:
        resolved = nearest(batch, quantities, shape, value, sep)
        resolved.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        answers(readings, settings, quantities, delay, sep, salts)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
