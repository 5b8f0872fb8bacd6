"""The trie of conversations' common beginnings, as balanced parentheses per shard.

A node is a distinct sequence of first turns. Its key is a 128-bit sum of hashes of
(place, turn), so keys come from running sums and no text is moved. Nodes are counted
by key; the smallest conversation of a node owns it, and the nodes a conversation owns
are the end of its path. Only owners go on: their paths, cut into pieces of bounded
depth, are dealt in order of their first keys, so common beginnings stand together.

A shard writes its pieces as balanced parentheses. Blocks with the least and greatest
excess find the closing parenthesis of every node, which delimits its subtree; the rank
of leaf pairs and a cumulative array in preorder give leaves and savings below it. Every
leaf and saving is counted in one shard, that of its owner, and what lies below a cut
path enters at its last node, so spines that several shards share merge by adding.

Defined results: rows without conv_id belong to no conversation; a null role or text is
empty, null turns come first, rows of one turn stand in order of their digest; repeated
rows are turns of their own; an empty table has no root; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from legnet.llm.batches import shuffle_partitions
from legnet.plans.rank import ranked
from legnet.plans.scan import ordered_scan
from legnet.plans.store import Stored, store

#: Conversations of more rows than this are numbered and summed in chunks.
LONG = 50_000
#: Depths of one piece of a path, and rows of paths in one shard.
DEPTHS, SHARD_ROWS = 512, 100_000
#: Conversations of one family share the first turns of its first member.
FAMILY, MOST_SHARED = 5, 9
#: Parentheses under one entry of the excess blocks, at every level.
BLOCK = 64
KEY = ["ka", "kb"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0, by turn), digest of role and text, bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = store(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("digest"),
            F.octet_length(text).cast("long").alias("bytes"),
        )
    ).df
    order = [F.asc_nulls_first("turn"), F.col("digest")]
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = store(sizes.where(F.col("n") > LONG).select("conv_id"))
    at = Window.partitionBy("conv_id").orderBy(*order)
    place = (F.row_number().over(at) - 1).cast("long").alias("place")
    wanted = ["conv_id", "place", "digest", "bytes"]
    if not long.stats["rows"]:
        return rows.select("conv_id", place, "digest", "bytes")
    short = rows.join(long.df, "conv_id", "left_anti").select("conv_id", place, "digest", "bytes")
    rest = ranked(rows.join(long.df, "conv_id", "left_semi"), "conv_id", *order, name="rank")
    heads = rest.groupBy("conv_id").agg(F.min("rank").alias("head"))
    rest = rest.join(heads, "conv_id").withColumn("place", F.col("rank") - F.col("head"))
    return short.unionByName(rest.select(*wanted))


def rebuilt(placed: DataFrame) -> DataFrame:
    """conv_id, depth (from 0, a row for the root), digest, bytes, ends.

    Conversation c begins with the first h turns of its family's first conversation,
    c less its rest by 5, where h is the CRC-32 of its decimal id by 9, and goes on
    with its own turns after its first h.
    """
    sizes = store(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))).df
    rest = F.pmod(F.col("conv_id"), F.lit(FAMILY))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = (
        sizes.withColumns({"h": h, "base": F.try_subtract("conv_id", rest)})
        .join(base, "base", "left")
        .withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("length", F.col("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
        .select("conv_id", "h", "lent", "length")
    )
    plan = store(plan).df
    depth = F.col("depth")
    ends = (depth == F.col("length")).alias("ends")
    own = placed.join(plan, "conv_id").where(F.col("place") >= F.col("h"))
    own = own.withColumn("depth", F.col("place") - F.col("h") + F.col("lent") + 1)
    heads = placed.where((rest == 0) & (F.col("place") < MOST_SHARED))
    heads = heads.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(FAMILY - 1))))
    heads = heads.withColumn("conv_id", F.try_add("conv_id", F.col("member").cast("long")))
    lent = heads.join(plan, "conv_id").where(F.col("place") < F.col("h"))
    lent = lent.withColumn("depth", F.col("place") + 1)
    root = plan.withColumns(
        {"depth": F.lit(0).cast("long"), "digest": F.lit(b""), "bytes": F.lit(0).cast("long")}
    )
    parts = [x.select("conv_id", "depth", "digest", "bytes", ends) for x in (own, lent, root)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def keyed(paths: DataFrame) -> DataFrame:
    """paths with the key of every node (ka, kb) and of its parent (pa, pb).

    Four sums of 32 bits each, of hashes of (depth, digest); the root has the key 0, 0.
    """
    mask = F.lit(0xFFFFFFFF)
    one, two = F.xxhash64("digest", "depth"), F.xxhash64("depth", F.lit(1), "digest")
    limbs = {}
    for name, hashed in (("a", one), ("b", two)):
        inner = F.when(F.col("depth") > 0, hashed).otherwise(F.lit(0).cast("long"))
        limbs[f"{name}1"] = F.shiftrightunsigned(inner, 32)
        limbs[f"{name}0"] = inner.bitwiseAND(mask)
    rows = paths.withColumns(limbs).drop("digest")
    large = store(
        rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG)
        .select(F.col("conv_id").alias("_k0"))
    )
    sums = ordered_scan(
        rows, ["conv_id"], "depth", running={f"s{x}": F.col(x) for x in limbs}, chunk=LONG,
        large=large.df if large.stats["rows"] else None,
    )

    def word(name: str, less: bool) -> Column:
        high, low = (
            (F.col(f"s{name}{i}") - F.col(f"{name}{i}") if less else F.col(f"s{name}{i}")).bitwiseAND(mask)
            for i in (1, 0)
        )
        return F.shiftleft(high, 32).bitwiseOR(low)

    return sums.select(
        "conv_id", "depth", "bytes", "ends", word("a", False).alias("ka"), word("b", False).alias("kb"),
        word("a", True).alias("pa"), word("b", True).alias("pb"),
    )


class Parentheses:
    """Balanced parentheses with blocks of least and greatest excess, level over level."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        excess = np.cumsum(np.where(opens, 1, -1))
        self.levels = [(excess, excess)]
        while len(self.levels[-1][0]) > BLOCK:
            least, most = self.levels[-1]
            least, most = (self._blocks(x, fill) for x, fill in ((least, 1 << 40), (most, -(1 << 40))))
            self.levels.append((least.min(1), most.max(1)))

    @staticmethod
    def _blocks(x: np.ndarray, fill: int) -> np.ndarray:
        out = np.full(-(-len(x) // BLOCK) * BLOCK, fill, np.int64)
        out[: len(x)] = x
        return out.reshape(-1, BLOCK)

    def _first(self, level: int, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First entry from start to its block's end whose range holds target, or -1."""
        least, most = self.levels[level]
        at = (start // BLOCK)[:, None] * BLOCK + np.arange(BLOCK)
        inside = (at >= start[:, None]) & (at < len(least))
        at = np.minimum(at, len(least) - 1)
        holds = inside & (least[at] <= target[:, None]) & (most[at] >= target[:, None])
        found = holds.argmax(1)
        return np.where(holds.any(1), (start // BLOCK) * BLOCK + found, -1)

    def close(self, places: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: up over the blocks, then down."""
        out = np.empty(len(places), np.int64)
        for a in range(0, len(places), 1 << 14):
            some = places[a : a + (1 << 14)]
            target = self.levels[0][0][some] - 1
            found, level = np.full(len(some), -1), np.zeros(len(some), np.int64)
            start, left = some + 1, np.arange(len(some))
            for up in range(len(self.levels)):
                got = self._first(up, start[left], target[left])
                found[left], level[left] = got, up
                left = left[got < 0]
                start[left] = start[left] // BLOCK + 1
            for down in range(len(self.levels) - 1, 0, -1):
                here = np.flatnonzero(level == down)
                found[here] = self._first(down - 1, found[here] * BLOCK, target[here])
                level[here] = down - 1
            out[a : a + (1 << 14)] = found
        return out


def subtree_sums(opens: np.ndarray, leaf: np.ndarray, weight: np.ndarray):
    """Sums below every node in preorder: of `leaf` over leaf pairs, of `weight` over all."""
    tree = Parentheses(opens)
    at = np.flatnonzero(opens)
    close = tree.close(at)
    pair = np.zeros(len(opens), np.int64)
    last = ~opens[np.minimum(at + 1, len(opens) - 1)]  # nodes closed at once: leaf pairs
    pair[at[last]] = leaf[last]
    rank = np.concatenate([[0], np.cumsum(pair)])
    before = np.concatenate([[0], np.cumsum(opens)])  # nodes opened before a place
    total = np.concatenate([[0], np.cumsum(weight)])
    return rank[close] - rank[at], total[before[close]] - total[before[at]]


def _shard(keys: np.ndarray, starts: np.ndarray, leaf: np.ndarray, weight: np.ndarray) -> dict:
    """Partial sums of the nodes of a shard: keys (n, 2) of pieces beginning at starts."""
    raw = np.ascontiguousarray(keys.astype(">i8"))
    ends = [*starts[1:], len(keys)]
    order = sorted(zip(starts, ends), key=lambda p: raw[p[0] : p[1]].tobytes())
    marks, node = [], np.empty(len(keys), np.int64)
    path: list[bytes] = []
    stack: list[int] = []
    n = 0
    for a, b in order:
        new = [raw[i].tobytes() for i in range(a, b)]
        common = 0
        while common < min(len(path), len(new)) and path[common] == new[common]:
            common += 1
        marks += [False] * (len(path) - common) + [True] * (len(new) - common)
        stack[common:] = range(n, n + len(new) - common)
        n += len(new) - common
        node[a:b] = stack
        path = new
    marks += [False] * len(path)
    kept = np.empty((n, 2), np.int64)
    kept[node] = keys
    by = [np.zeros(n, np.int64) for _ in range(2)]
    for sums, values in zip(by, (leaf, weight)):
        np.add.at(sums, node, values)
    leaves, saved = subtree_sums(np.array(marks, bool), *by)
    return {"ka": kept[:, 0], "kb": kept[:, 1], "n_leaves": leaves, "saved_tokens": saved}


def _shards(batches, schema: pa.Schema):
    """Shards of whole pieces, one after another, from rows sorted by piece and depth."""
    names = ("conv_id", "stripe", "ka", "kb", "leaf", "weight")
    held: list[np.ndarray] = []
    rows = 0

    def flush(table: np.ndarray):
        starts = np.flatnonzero(np.r_[True, (table[1:, :2] != table[:-1, :2]).any(1)])
        out = _shard(table[:, 2:4], starts, table[:, 4], table[:, 5])
        arrays = [pa.array(out[f.name], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for batch in batches:
        if batch.num_rows:
            held.append(np.column_stack([batch[c].to_numpy() for c in names]))
            rows += batch.num_rows
        if rows >= SHARD_ROWS:
            table = np.concatenate(held)
            # The last piece may go on in the next batch.
            cut = len(table) - 1
            while cut > 0 and (table[cut, :2] == table[cut - 1, :2]).all():
                cut -= 1
            if cut:
                yield flush(table[:cut])
            held, rows = [table[cut:]], len(table) - cut
    if rows:
        yield flush(np.concatenate(held))


def below(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ka, kb, n_leaves, saved_tokens) of every node, from the paths of the owners."""
    owned = nodes.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("weight"),
    )
    rows = paths.select("conv_id", "depth", *KEY).join(nodes.select("conv_id").distinct(), "conv_id", "left_semi")
    rows = rows.join(owned, ["conv_id", "depth"], "left").fillna(0, ["leaf", "weight"])
    rows = rows.withColumn("stripe", F.floor(F.col("depth") / F.lit(DEPTHS)))
    step = F.col("depth") - F.col("stripe") * DEPTHS
    pieces = rows.groupBy("conv_id", "stripe").agg(
        F.sum("leaf").alias("leaf"), F.sum("weight").alias("weight"),
        *[F.coalesce(F.max(F.when(step == i, F.col("ka"))), F.lit(0)).alias(f"k{i}") for i in (0, 1, 2, 3)],
    )
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("stripe")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns(
        {f"more_{c}": F.coalesce(F.sum(c).over(deeper), F.lit(0)) for c in ("leaf", "weight")}
    ).drop("leaf", "weight")
    rows = rows.join(pieces, ["conv_id", "stripe"])
    # What lies below a cut path enters at the last node before the cut.
    last = step == DEPTHS - 1
    rows = rows.withColumns(
        {c: F.col(c) + F.when(last, F.col(f"more_{c}")).otherwise(0) for c in ("leaf", "weight")}
    )
    order = ["stripe", "k0", "k1", "k2", "k3", "conv_id"]
    parts = shuffle_partitions(paths.sparkSession)
    dealt = rows.select(*order, *KEY, "depth", "leaf", "weight").repartitionByRange(parts, *order)
    schema = StructType.fromDDL("ka long, kb long, n_leaves long, saved_tokens long")
    arrow = to_arrow_schema(schema)
    sums = dealt.sortWithinPartitions(*order, "depth").mapInArrow(lambda b: _shards(b, arrow), schema)
    return sums.groupBy(*KEY).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )


def end_digests(paths: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256): SHA-256 of the ids that end at a node, ascending.

    Ids are sorted and joined in ranges of 65536; the ranges of a node stream through
    one digest, which is a chain and cannot be cut.
    """
    ids = F.array_sort(F.collect_list("conv_id"))
    parts = paths.where("ends").groupBy(*KEY, F.shiftright("conv_id", 16).alias("range")).agg(
        F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("part")
    )
    schema = StructType.fromDDL("ka long, kb long, ends_sha256 string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, sha, done = None, None, []

        def flush():
            cols = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for *k, part in zip(*(batch[c].to_pylist() for c in (*KEY, "part"))):
                if k != key:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = k, sha256(part.encode())
                else:
                    sha.update(f",{part}".encode())
            if len(done) >= 10_000:
                yield flush()
        if key:
            done.append((*key, sha.hexdigest()))
            yield flush()

    n = shuffle_partitions(paths.sparkSession)
    return parts.repartition(n, *KEY).sortWithinPartitions(*KEY, "range").mapInArrow(run, schema)


def trie(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of paths (conv_id, depth, digest, bytes, ends).

    conv_id: its smallest member; depth; parent_conv_id; n_convs, n_children; n_leaves:
    childless nodes below or at it; saved_tokens: bytes not stored again below or at it;
    ends_sha256: of the ids of members that end here.
    """
    tables: list[Stored] = []

    def kept(df: DataFrame) -> DataFrame:
        tables.append(store(df))
        return tables[-1].df

    rows = kept(keyed(paths))
    found = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.count(F.lit(1)).alias("n_convs"),
    )
    found = kept(found)
    children = found.where(F.col("depth") > 0).groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.toDF(*KEY, "n_children")
    nodes = kept(found.join(children, KEY, "left").fillna(0, ["n_children"]))
    parents = nodes.select(
        F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id")
    )
    inner = nodes.where(F.col("depth") > 0).join(parents, ["pa", "pb"])
    root = nodes.where(F.col("depth") == 0).withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = inner.unionByName(root).join(below(rows, nodes), KEY).join(end_digests(rows), KEY, "left")
    done = store(
        out.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
    for t in tables:
        t.drop()
    return done.df


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(rebuilt(turns(conversations)))
