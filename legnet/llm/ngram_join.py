"""N-gram Jaccard join by parity sketches.

Two sets of shingles with Jaccard similarity of 0.9 or more differ in at most
D = (n + m) / 19 shingles. A sketch XORs the hash of every shingle into one of D + 1 + z
words per size band: as a shingle touches one word only, two similar sets agree in 1 + z
words at least (pigeonhole). So documents meet in buckets of equal (band, word number,
word). A word that no shingle has touched says nothing; a set with at most z such words
needs none of them, one with more emits them too. A second sketch flips one bit per
shingle: its Hamming distance is at most the difference of the sets, which rules out most
pairs of a bucket. The rest is verified on the shingles themselves.

Copies are one class from the start. Inside a bucket or a cluster links are found by
walking the link graph: a document that has been reached is not compared again, so a
group of near copies costs about one comparison each, and only a spanning forest leaves
the task, never all pairs. Large groups are cut into blocks: each block is walked
with the group's first document. The documents outside the largest component found so
far are then dealt into blocks anew, and every pair of such a block and another block of
the group is a cell of its own: a task holds two blocks, and two documents meet in one
cell. Cells, and so copied rows, still grow with the square of a group that has many
documents outside.

Defined results: a missing or empty text has no shingles and is linked with nothing;
texts are read whole; a text of fewer words than a shingle is one shingle; equal sets
are linked; rows that share an id count as one document; rows without an id have no
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legnet.llm.batches import shuffle_partitions
from legnet.llm.streams import KeyFilter, bits, groups, only_ids
from legnet.llm.words import gram_hashes, mix, split_words, word_hashes
from legnet.operators.graph import components
from legnet.plans.store import Stored, cut, store

#: Documents of a block in a cluster (with their shingles) and in a bucket (with their
#: sketches); a group with more is cut.
BLOCK, BUCKET_BLOCK = 256, 2048


class Similarity:
    """A Jaccard threshold as a fraction num / den, with exact integer bounds."""

    def __init__(self, num: int = 9, den: int = 10):
        self.num, self.den = num, den

    def difference(self, sizes):
        """Largest symmetric difference of similar sets whose sizes have this sum."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def linked(self, common: int, sizes: int) -> bool:
        return common * (self.num + self.den) >= self.num * sizes

    def largest(self, size: int) -> int:
        """Size of the largest set that can be similar to one of this size."""
        return size * self.den // self.num

    def least(self) -> int:
        """Smallest size of a set that is similar to a different one."""
        n = 1
        while self.difference(n + self.largest(n)) < 1:
            n += 1
        return n

    def bands(self, upto: int) -> list[int]:
        """First sizes of the bands: partners lie in the same band or the next."""
        firsts = [self.least()]
        while firsts[-1] <= upto or len(firsts) < 2:
            firsts.append(self.largest(firsts[-1]) + 1)
        return firsts


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; A-Z are read as a-z."""
    words = split_words(texts, lower=True)
    hashes = word_hashes(words)
    grams = gram_hashes(hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(gram_hashes(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity(values: np.ndarray, words: int, place: np.ndarray) -> np.ndarray:
    """`words` words of 64 bits: each value flips one bit of the word at its place."""
    cell = place * 64 + (mix(values) & np.uint64(63)).astype(np.int64)
    flips = np.bincount(cell, minlength=words * 64).astype(np.uint8) & 1
    return np.packbits(flips, bitorder="little").view(np.uint64)


def sketch(values: np.ndarray) -> np.ndarray:
    """A whole sketch with a bit or more per shingle, foldable to half its size."""
    words = 1 << max(0, (len(values) - 1) // 64).bit_length()
    return parity(values, words, (values & np.uint64(words - 1)).astype(np.int64))


def fold(s: np.ndarray, words: int) -> np.ndarray:
    return s if len(s) == words else np.bitwise_xor.reduce(s.reshape(-1, words), axis=0)


def layout(like: Similarity, firsts: list[int]) -> list[tuple[int, int]]:
    """(words, z) of every band: z exceeds the untouched words that nearly all sets have."""
    out = []
    for low, nxt in zip(firsts, firsts[1:]):
        need = like.difference(nxt - 1 + like.largest(nxt - 1)) + 1
        z = 0
        while z < low // 8:
            idle = (need + z) * math.exp(-low / (need + z))
            if idle + 4 * math.sqrt(idle) <= z:
                break
            z += 1
        out.append((need + z, z))
    return out


def band_keys(values: np.ndarray, firsts: list[int], bands: list[tuple[int, int]]) -> np.ndarray:
    """Bucket keys of one set: its sketch words in its own band and in the one before."""
    n = len(values)
    if n < firsts[0]:
        return np.zeros(0, np.int64)
    own = int(np.searchsorted(firsts, n, side="right")) - 1
    spread, keys = mix(values), []
    for band in (own, own - 1) if own else (own,):
        words, z = bands[band]
        place = ((values >> np.uint64(33)) % np.uint64(words)).astype(np.int64)
        found = np.zeros(words, np.uint64)
        np.bitwise_xor.at(found, place, spread)
        at = np.arange(words, dtype=np.uint64)
        used = np.bincount(place, minlength=words) > 0
        if words - int(used.sum()) <= z:
            found, at = found[used], at[used]
        keys.append(mix(found + mix(at + np.uint64(band << 32))))
    return np.concatenate(keys).view(np.int64)


def _walk(batches, keys: list[str], like: Similarity, exact: bool, arrow: pa.Schema):
    """Spanning forests of the link graphs of all groups, as (u, v) rows.

    Where rows have a `side`, those of side 0 are compared with those of side 1 only,
    unless all have one side.
    """
    for g in groups(batches, keys):
        m = len(g["rep"])
        if m < 2:
            continue
        reps = np.array(g["rep"], dtype=np.int64)
        sizes = np.array(g["n"], dtype=np.int64)
        sketches = [bits(s) for s in g["sketch"]]
        words = min(len(s) for s in sketches)
        table = np.stack([fold(s, words) for s in sketches])
        sets = [bits(s) for s in g["shingles"]] if exact else None
        labels = np.array(g["label"], dtype=np.int64) if "label" in g else reps
        sides = np.array(g["side"], dtype=np.int64) if "side" in g else np.zeros(m, np.int64)
        across = sides.min() != sides.max()
        left = np.ones(m, dtype=bool)
        us, vs = [], []
        for first in range(m):
            if not left[first]:
                continue
            left[first] = False
            todo = [first]
            while todo:
                x = todo.pop()
                same = np.flatnonzero(left & (labels == labels[x]))
                left[same] = False
                todo.extend(same.tolist())
                rest = np.flatnonzero(left & (sides != sides[x]) if across else left)
                if not len(rest):
                    continue
                sums = sizes[rest] + sizes[x]
                near = np.bitwise_count(table[rest] ^ table[x]).sum(axis=1, dtype=np.int64)
                hits = rest[near <= like.difference(sums)]
                if exact:
                    hits = [
                        y for y in hits.tolist()
                        if like.linked(
                            len(np.intersect1d(sets[x], sets[y], assume_unique=True)),
                            int(sizes[x] + sizes[y]),
                        )
                    ]
                for y in hits:
                    us.append(int(reps[x]))
                    vs.append(int(reps[y]))
                    left[y] = False
                    todo.append(int(y))
        if us:
            yield pa.RecordBatch.from_pydict({"u": us, "v": vs}, schema=arrow)


def cells_of(rows: DataFrame, most: int) -> DataFrame:
    """Rows of large groups copied to their cells (`block`), with their `side` of the cell.

    rows: g, rep, label, main (the label of most documents of g), k (how many those are)
    and m (documents of g). Documents with another label fill the first blocks, the
    others the rest; a cell is a pair of blocks of which the first is of the first kind.
    """
    outer = F.ceil((F.col("m") - F.col("k")) / F.lit(most)).cast("long")
    every = outer + F.ceil(F.col("k") / F.lit(most)).cast("long")
    hashed = F.xxhash64("rep", F.lit(1))
    own = F.when(F.col("label") != F.col("main"), F.pmod(hashed, F.col("_outer"))).otherwise(
        F.col("_outer") + F.pmod(hashed, F.col("_every") - F.col("_outer"))
    )
    placed = rows.withColumns({"_outer": outer, "_every": every}).withColumn("_own", own)
    # The other block of each cell: any for a document outside, else one of the first kind.
    last = F.when(F.col("_own") < F.col("_outer"), F.col("_every")).otherwise(F.col("_outer")) - 1
    spread = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return spread.withColumns(
        {"block": low * F.col("_every") + high, "side": (F.col("_own") > F.col("_other")).cast("int")}
    ).drop("_outer", "_every", "_own", "_other", "main", "k", "m")


def linked(rows: DataFrame, like: Similarity, exact: bool) -> Stored:
    """(u, v): a spanning forest of the links inside every group `g` of rows.

    rows: g, rep, n, sketch and, if exact, shingles.
    """
    tasks = shuffle_partitions(rows.sparkSession)
    arrow = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def walk(given: DataFrame) -> DataFrame:
        dealt = given.repartition(tasks, "g", "block").sortWithinPartitions("g", "block")
        return dealt.mapInArrow(
            lambda batches: _walk(batches, ["g", "block"], like, exact, arrow), "u long, v long"
        )

    most = BLOCK if exact else BUCKET_BLOCK
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("pivot"))
    large = store(
        sizes.where(F.col("m") > most).select(
            "g", "pivot", F.ceil(F.col("m") / F.lit(most)).cast("int").alias("blocks")
        )
    )
    if not large.stats["rows"]:
        return store(walk(rows.withColumn("block", F.lit(0))).distinct())
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = rows.join(large.df, "g", "left")
    # Every block of a large group is walked with the group's first document.
    spots = F.when(
        F.col("blocks").isNull(), F.array(F.lit(0))
    ).when(
        F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)
    ).otherwise(F.array(block))
    cells = placed.withColumn("block", F.explode(spots)).drop("pivot", "blocks")
    first = store(walk(cells).distinct())

    found = components(first.df).df.withColumnRenamed("node", "rep")
    big = cut(
        rows.join(large.df.select("g", "blocks"), "g")
        .join(found, "rep", "left")
        .withColumn("label", F.coalesce("component", "rep"))
        .drop("component")
    )
    counts = big.groupBy("g", "label").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("g").agg(
        F.max(F.struct(F.col("k"), F.col("label"))).alias("most"),
        F.count(F.lit(1)).alias("labels"),
        F.sum("k").alias("m"),
    ).where(F.col("labels") > 1).select("g", F.col("most.label").alias("main"), F.col("most.k").alias("k"), "m")
    second = walk(cells_of(big.drop("blocks").join(cut(main), "g"), most))
    return store(first.df.unionByName(second).distinct())


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = 3,
    like: Similarity | None = None,
) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    like = like or Similarity()
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text"))

    def describe(batches):
        schema = pa.schema(
            [("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]
        )
        for batch in batches:
            cols = batch.to_pydict()
            sets = shingle_sets(cols["text"], size)
            h1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            h2 = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            out = {"id": cols["id"], "n": [len(s) for s in sets], "h1": h1, "h2": h2}
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    described = store(
        docs.mapInArrow(describe, "id long, n long, h1 long, h2 long"), top=F.max("n")
    )
    every = described.df
    classes = cut(
        every.where((F.col("n") > 0) & F.col("id").isNotNull())
        .groupBy("h1", "h2", "n")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    firsts = like.bands(described.stats["top"] or 0)
    bands = layout(like, firsts)
    reps = store(classes.where(F.col("n") >= firsts[0]).select("rep").distinct())

    def buckets(batches, known=None):
        schema = pa.schema([("g", pa.int64()), ("rep", pa.int64())])
        for batch in batches:
            cols = batch.to_pydict()
            keys = [band_keys(s, firsts, bands) for s in shingle_sets(cols["text"], size)]
            ids = np.repeat(np.array(cols["id"], dtype=np.int64), [len(k) for k in keys])
            keys = np.concatenate(keys)
            if known is not None:
                keep = known.may_hold(keys)
                keys, ids = keys[keep], ids[keep]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], schema=schema)

    unique = only_ids(docs, "id", reps.df, reps.stats["rows"])
    # Keys are counted first; the second pass sends on only what the filter lets pass.
    index = unique.mapInArrow(buckets, "g long, rep long")
    shared = store(index.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"))
    known_keys = KeyFilter(shared.df, shared.stats["rows"])
    index = unique.mapInArrow(lambda batches: buckets(batches, known_keys), "g long, rep long")
    met = store(index.join(shared.df, "g"))
    involved = store(met.df.select("rep").distinct())

    def contents(batches):
        schema = pa.schema(
            [("rep", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("shingles", pa.binary())]
        )
        for batch in batches:
            cols = batch.to_pydict()
            sets = shingle_sets(cols["text"], size)
            out = {
                "rep": cols["id"], "n": [len(s) for s in sets],
                "sketch": [sketch(s).tobytes() for s in sets],
                "shingles": [s.tobytes() for s in sets],
            }
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    known = store(
        only_ids(docs, "id", involved.df, involved.stats["rows"]).mapInArrow(
            contents, "rep long, n long, sketch binary, shingles binary"
        )
    )
    near = linked(met.df.join(known.df.drop("shingles"), "rep"), like, exact=False)
    clusters = components(near.df).df.select(F.col("node").alias("rep"), F.col("component").alias("g"))
    links = linked(known.df.join(clusters, "rep"), like, exact=True)
    for table in (shared, met, involved, known, near, reps):
        table.drop()
    # Rows with one id are one document, whatever their texts.
    found = components(links.df).df.select(F.col("node").alias("rep"), "component")

    copies = cut(classes.where("copies > 1").select("h1", "h2", F.col("n").alias("_n"), "rep"))
    named = every.join(
        copies.withColumnsRenamed({"h1": "_h1", "h2": "_h2"}),
        (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") == F.col("_n")),
        "left",
    ).select("id", "n", F.coalesce("rep", "id").alias("rep"))
    return named.join(found, "rep", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        # A row without an id has no component, also where its set equals a class.
        F.when(
            F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "rep")
        ).otherwise(F.col("id")).alias("component_id"),
    )
