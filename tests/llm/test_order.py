"""The order of ids: above 2 ** 53, negative, one in half the rows, and none at all."""

import hashlib

import pytest
from llm_cases import documents, prose

from legnet.llm import sharding, syncmers
from legnet.llm.batches import Order, tie_hash

BIG = 10**18
CASES = {
    "above doubles": [BIG + i for i in range(60)],
    "edges of the range": [2**63 - 1 - i for i in range(20)] + [-(2**63) + i for i in range(20)] + list(range(-9, 9)),
    "spread": [(-1) ** i * 7**i for i in range(22)],
}


def edited(ids, texts):
    """SHA-256 of every edited text, from all documents in one list."""
    rows = sorted(zip(ids, texts), key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        n = len(text) // 3
        more = rows[(k + 1) % len(rows)][1][:n]
        out[i] = hashlib.sha256((text[: len(text) - n] + more).encode()).hexdigest()
    return out


@pytest.mark.parametrize("name", CASES)
def test_the_next_document_and_slots(spark, monkeypatch, name):
    ids = CASES[name]
    texts = [prose(k, 20 + k % 30) for k in range(len(ids))]
    df = documents(spark, list(zip(ids, texts))).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = {r.doc_id: r.edited_sha256 for r in syncmers.edited_likeness(df).collect()}
        assert got == edited(ids, texts)
        shards = {}
        for r in sharding.assign(df, 3).collect():
            shards.setdefault(r.shard, []).append((r.slot, r.doc_id))
        for rows in shards.values():
            rows.sort()
            assert [s for s, _ in rows] == list(range(len(rows)))
            assert [i for _, i in rows] == sorted(i for _, i in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("heavy", [5, BIG + 1, None])
def test_an_id_in_half_the_rows_is_cut_by_its_texts(spark, heavy):
    ids = [heavy] * 2000 + [BIG + 2 + i for i in range(1000)] + list(range(-500, 500))
    rows = [(i, f"text {k} of them") for k, i in enumerate(ids)]
    df = documents(spark, rows)
    order = Order(df, "doc_id", rows_per_bucket=100)
    tied = df.withColumn("tie", tie_hash(df["text"]))
    found = tied.withColumn("bucket", order.bucket(tied["doc_id"], tied["tie"])).collect()
    turn = sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    assert [r.bucket for r in turn] == sorted(r.bucket for r in found)
    sizes = {}
    for r in found:
        sizes[r.bucket] = sizes.get(r.bucket, 0) + 1
    assert max(sizes.values()) < 400
    slots = sharding.assign(df, 2).collect()
    for shard in (0, 1):
        got = sorted(r.slot for r in slots if r.shard == shard)
        assert got == list(range(len(got)))
