"""Document fingerprints from closed syncmers.

A run of K code points is a closed syncmer when the smallest hash among its runs of S
code points lies at its first or last place. Whether a run is chosen depends on the run
alone, so a passage gives the same anchors wherever it stands. A fingerprint holds all
anchors, with their positions, in text order: it grows with the text, so a passage leaves
its anchors in a long text too.

Two fingerprints are compared over the hashes of both together: the share of them that
both hold and that stand in the same order (longest increasing chain). With a `size` only
so many smallest hashes are held and compared.

Defined results: a missing text counts as empty; texts are read whole, whatever their
length; a text without a closed syncmer has one anchor, the hash of the whole text; an
empty text has an empty fingerprint, which is like another empty one (1) and unlike
all others (0); of several anchors with one hash the first stands; equal texts have
equal fingerprints; the next document of the last one is the first; equal ids are put
in order by a hash of the text; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from legnet.llm.batches import Order, shuffle_partitions, tie_hash
from legnet.llm.words import BASE, mix
from legnet.plans.store import cut

K, S = 10, 4
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
# Digits of written fingerprints (RFC 1924); the last of a distance is below _ENDS.
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~"
_DIGITS = np.frombuffer(_ALPHABET.encode(), np.uint8)
_VALUES = {c: i for i, c in enumerate(_ALPHABET)}
_POWERS = 85 ** np.arange(4, -1, -1)
_ENDS, _MORE = 43, 42


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def anchors(texts: list[str], k: int = K, s: int = S, size: int | None = None):
    """(hashes, positions) of every text's fingerprint, in text order, as lists."""
    return [(h.tolist(), p.tolist()) for h, p in _anchors(texts, k, s, size)]


def _anchors(texts: list[str], k: int = K, s: int = S, size: int | None = None):
    """As `anchors`, as arrays.

    The texts of a batch are hashed together; a run that crosses two texts is left out.
    """
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(b) // 4 for b in raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(lengths)
    codes = np.frombuffer(b"".join(raw), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    places = np.zeros(0, np.int64)
    if n >= k:
        inner = codes[: n - s + 1].copy()
        for j in range(1, s):
            inner *= BASE
            inner += codes[j : n - s + 1 + j]
        inner = mix(inner)
        width = k - s + 1
        low = _slide_min(inner, width)
        places = np.flatnonzero((low == inner[: len(low)]) | (low == inner[width - 1 :]))
        # A run is hashed by its inner runs, end to end, the last one flush right.
        steps = [*range(0, k - s, s), k - s]
        grams = np.zeros(len(places), np.uint64)
        for j in steps:
            grams = grams * _SPREAD + inner[places + j]
        grams = mix(grams) >> np.uint64(32)
    out = []
    starts = ends - lengths
    lo = np.searchsorted(places, starts)
    hi = np.searchsorted(places, ends - k, side="right")
    for i, t in enumerate(texts):
        if hi[i] > lo[i]:
            found, first = np.unique(grams[lo[i] : hi[i]], return_index=True)
            found, first = found[:size], first[:size]
            turn = np.argsort(first)
            at = places[lo[i] : hi[i]][first[turn]] - starts[i]
            out.append((found[turn].astype(np.int64), at))
        elif t:
            digest = sha256(t.encode("utf-8", "surrogatepass")).digest()
            out.append((np.array([int.from_bytes(digest[:4], "big")]), np.zeros(1, np.int64)))
        else:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


def written(print_) -> str:
    """A fingerprint as text: for each anchor five digits of its hash, then its distance.

    Digits have base 85. The distance from the anchor before (of the first, its place) is
    one digit below `_ENDS`; a longer one has digits from there on before that, least first.
    """
    hashes, places = (np.asarray(x, np.int64) for x in print_)
    columns = list((hashes[:, None] // _POWERS % 85).astype(np.int8).T)
    rest = np.diff(places, prepend=0)
    while (rest >= 0).any():
        long = rest >= _ENDS
        columns.append(np.where(long, _ENDS + rest % _MORE, rest).astype(np.int8))
        rest = np.where(long, rest // _MORE, -1)
    digits = np.column_stack(columns)
    return _DIGITS[digits[digits >= 0]].tobytes().decode("ascii")


def read(text: str) -> tuple[list[int], list[int]]:
    """(hashes, positions) of a written fingerprint."""
    digits, at, place = [_VALUES[c] for c in text], 0, 0
    hashes, places = [], []
    while at < len(digits):
        code = 0
        for d in digits[at : at + 5]:
            code = code * 85 + d
        at, unit = at + 5, 1
        while digits[at] >= _ENDS:
            place += (digits[at] - _ENDS) * unit
            at, unit = at + 1, unit * _MORE
        place += digits[at] * unit
        at += 1
        hashes.append(code)
        places.append(place)
    return hashes, places


def likeness(a, b, size: int | None = None) -> float:
    """0 to 1; 1 for equal fingerprints."""
    a, b = [np.asarray(x[0], np.int64) for x in (a, b)]
    if np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    common, at, rank = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = len(a) + len(b) - len(common)
    if size is not None and both > size:
        both = size
        held = common <= np.union1d(a, b)[size - 1]
        at, rank = at[held], rank[held]
    # In a's order: the longest chain that b holds in order too.
    order = rank[np.argsort(at)]
    if (order[1:] > order[:-1]).all():
        return len(order) / both
    tails: list[int] = []
    for i in order.tolist():
        if not tails or i > tails[-1]:
            tails.append(i)
        else:
            tails[bisect_left(tails, i)] = i
    return len(tails) / both


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The kept columns and `fingerprint`, as written."""
    from legnet.llm.batches import map_batches

    keep = [id_col] if keep is None else keep
    fields = [docs.schema[c] for c in keep]
    names = [f"_{i}" for i in range(len(keep))]

    def run(rows):
        found = _anchors([t or "" for t in rows["_text"]])
        return {c: rows[c] for c in names} | {"_print": [written(x) for x in found]}

    schema = StructType()
    for n, f in zip(names, fields):
        schema = schema.add(n, f.dataType)
    schema = schema.add("_print", "string")
    given = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names)], docs[text].alias("_text"))
    return map_batches(given, run, schema).toDF(*keep, "fingerprint")


def with_next(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int]:
    """Rows (bucket, ghost, id, tie, text), dealt by bucket and sorted by descending id.

    Every bucket ends with a ghost: a copy of the row that follows its last one, which
    stands in the next bucket (after the last bucket: in the first). So a task finds the
    successor of each of its rows without seeing another bucket.
    """
    order = Order(docs, id_col, rows_per_bucket=5_000)
    rows = docs.select(
        docs[id_col].cast("long").alias("id"),
        F.coalesce(docs[text], F.lit("")).alias("text"),
        tie_hash(docs[text]).alias("tie"),
    )
    rows = rows.withColumn("bucket", order.bucket(F.col("id"), F.col("tie")))
    # One row per bucket: a hundred-thousandth of the documents or less is in this table.
    first = rows.groupBy("bucket").agg(
        F.max(F.struct(F.col("id"), F.col("tie"))).alias("head")
    )
    turn = Window.orderBy(F.desc("bucket"))
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = cut(
        first.select(
            F.col("bucket").alias("of"),
            F.coalesce(F.lead("head").over(turn), F.first("head").over(whole)).alias("head"),
        )
    )
    heads = heads.select("of", F.col("head.id").alias("hid"), F.col("head.tie").alias("htie"))
    ghosts = rows.join(
        F.broadcast(heads), rows["id"].eqNullSafe(heads["hid"]) & (rows["tie"] == heads["htie"])
    )
    # Repeated rows may match one head several times; a bucket needs one.
    ghosts = ghosts.select(F.col("of").alias("bucket"), F.lit(1).alias("ghost"), "id", "tie", "text")
    rows = rows.select("bucket", F.lit(0).alias("ghost"), "id", "tie", "text")
    tasks = max(shuffle_partitions(docs.sparkSession), order.rows // 20_000)
    dealt = rows.unionByName(ghosts).repartition(tasks, "bucket")
    return dealt.sortWithinPartitions(
        F.desc("bucket"), "ghost", F.desc_nulls_last("id"), F.desc("tie")
    ), tasks


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The edited text has its last third (rounded down, in code points) replaced by as
    many first code points of the next document in descending order of ids.
    """
    schema = StructType.fromDDL(
        "id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    dealt, _ = with_next(docs, id_col, text)

    def run(batches):
        last = None  # the row before this batch: (bucket, id, text, fingerprint)
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = batch.to_pydict()
            texts = cols["text"]
            prints = _anchors(texts)
            rows = list(zip(cols["bucket"], cols["ghost"], cols["id"], texts, prints))
            if last is not None:
                rows.insert(0, last)
            last = rows[-1]
            pairs = [
                (a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]
            ]
            if not pairs:
                continue
            changed = [a[3][: len(a[3]) - len(a[3]) // 3] + b[3][: len(a[3]) // 3] for a, b in pairs]
            second = _anchors(changed)
            out = {
                "id": [a[2] for a, _ in pairs],
                "n_chars": [len(a[3]) for a, _ in pairs],
                "edited_sha256": [
                    sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed
                ],
                "fingerprint": [written(a[4]) for a, _ in pairs],
                "edited_fingerprint": [written(x) for x in second],
                "near_edited": [likeness(a[4], x) for (a, _), x in zip(pairs, second)],
                "near_next": [likeness(a[4], b[4]) for a, b in pairs],
            }
            arrays = [pa.array(out[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
