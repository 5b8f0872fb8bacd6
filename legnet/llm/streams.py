"""Rows of one group after another from Arrow batches, and id filters of checked size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legnet.plans.store import store

#: Lists of ids up to this many rows (8 MB of longs) are sent to every task.
BROADCAST_IDS = 1_000_000


def only_ids(docs: DataFrame, id_col: str, ids: DataFrame, rows: int, how="left_semi") -> DataFrame:
    """The rows of docs whose id is in the first column of ids (`rows` of them, counted).

    A list of bounded size is broadcast, so texts stay where they are read; a longer
    one is joined by the id.
    """
    ids = ids.select(F.col(ids.columns[0]).alias("_wanted"))
    if rows <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids["_wanted"], how)


def without_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in the first column of ids, rows without an id too."""
    listed = store(ids.where(F.col(ids.columns[0]).isNotNull()).distinct())
    return only_ids(docs, id_col, listed.df, listed.stats["rows"], "left_anti")


class KeyFilter:
    """A Bloom filter of 64-bit keys, made by Spark and sent to every task.

    A key sets three bits of one 64-bit word. There are as many words as half the keys,
    up to MOST_WORDS (32 MB): with more keys the filter lets more others pass, which the
    join behind it drops, and it never drops a key.
    """

    MOST_WORDS = 1 << 22

    def __init__(self, keys: DataFrame, rows: int):
        column = keys.columns[0]
        self.words = min(self.MOST_WORDS, 1 << max(6, (rows // 2).bit_length()))
        bit = [f"shiftleft(1L, cast(shiftrightunsigned({column}, {s}) & 63L as int))" for s in (32, 40, 48)]
        found = (
            keys.select(F.expr(f"{column} & {self.words - 1}L").alias("at"), F.expr(" | ".join(bit)).alias("mask"))
            .groupBy("at")
            .agg(F.bit_or("mask").alias("mask"))
            .toArrow()
        )
        table = np.zeros(self.words, np.uint64)
        table[found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that are not in the filter."""
        k = keys.view(np.uint64)
        mask = np.zeros(len(k), np.uint64)
        for s in (32, 40, 48):
            mask |= np.uint64(1) << ((k >> np.uint64(s)) & np.uint64(63))
        return self.table.value[(k & np.uint64(self.words - 1)).astype(np.int64)] & mask == mask


def groups(batches, keys: list[str]) -> Iterator[dict[str, list]]:
    """Columns of each run of rows with equal keys, from batches sorted by the keys.

    Only one group is held at a time; groups are of bounded size by construction.
    """
    held: dict[str, list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = batch.to_pydict()
        rows = list(zip(*(cols[k] for k in keys)))
        start = 0
        for end in [*(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]:
            part = {c: v[start:end] for c, v in cols.items()}
            if held is not None and tuple(held[k][0] for k in keys) == rows[start]:
                for c in held:
                    held[c].extend(part[c])
            else:
                if held is not None:
                    yield held
                held = part
            start = end
    if held is not None:
        yield held


def bits(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, dtype=np.uint64)
