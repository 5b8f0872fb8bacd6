"""Sharding by jump consistent hashing.

A key and a number of shards give the shard by arithmetic alone, without a ring
table. With one shard more, a key stays or moves into the new shard: only the
necessary fraction moves.

Defined results: a missing key is replaced by the hash of the text, so such rows spread
too; a missing text has one byte (its size plus 1) and the checksum of no bytes; equal
keys share a shard; slots number the rows of a shard from 0 by key and then text, without
gaps also among repeated rows; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legnet.llm.batches import Order, tie_hash
from legnet.llm.words import mix
from legnet.plans.store import cut

#: Multiplier of the published jump hash.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key: the last place below `shards` that its jumps reach."""
    state = keys.astype(np.uint64, copy=True)
    place = np.zeros(len(state), dtype=np.int64)
    reach = np.zeros(len(state), dtype=np.float64)
    live = np.arange(len(state))
    while len(live):
        place[live] = reach[live].astype(np.int64)
        state[live] = state[live] * STEP + np.uint64(1)
        spread = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        reach[live] = np.floor((place[live] + 1) * (float(1 << 31) / spread))
        live = live[reach[live] < shards]
    return place


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of an integer key that never is NULL; the key is mixed first."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def find(k: pd.Series) -> pd.Series:
        return pd.Series(jump(mix(k.to_numpy(dtype="int64").view(np.uint64)), shards))

    return find(key.cast("long"))


def assign(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """id, size, text_crc32, shard, slot and grown_shard (the shard among one more).

    Texts never leave their scan: only ids and checksums are shuffled. Slots are
    numbered inside buckets of bounded size; a prefix sum over the buckets' counts,
    of which there are few, makes them gapless.
    """
    body = F.coalesce(docs[text], F.lit(""))
    tie = tie_hash(docs[text])
    order = Order(docs, id_col)
    rows = docs.select(
        docs[id_col].cast("long").alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        tie.alias("tie"),
    )
    key = F.coalesce("id", "tie")
    rows = rows.withColumns(
        {
            "shard": shard_of(key, shards),
            "grown_shard": shard_of(key, shards + 1),
            "bucket": order.bucket(F.col("id"), F.col("tie")),
        }
    )
    rows = cut(rows)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        rows.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "tie")
    placed = rows.withColumn("slot", F.row_number().over(inside) - 1).join(heads, ["shard", "bucket"])
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("slot") + F.col("base")).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(
    docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text: str = "text",
    files_per_shard: int = 8,
) -> None:
    """Writes all columns of docs under path/shard=N; a shard is several files, by key."""
    key = F.coalesce(docs[id_col].cast("long"), tie_hash(docs[text]))
    part = F.pmod(F.xxhash64(key, tie_hash(docs[text])), F.lit(files_per_shard))
    out = docs.withColumn("shard", shard_of(key, shards)).withColumn("_part", part)
    out = out.repartition(shards * files_per_shard, "shard", "_part").drop("_part")
    out.write.partitionBy("shard").parquet(path)
