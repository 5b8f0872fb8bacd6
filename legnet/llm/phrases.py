"""Substring dedup by repeated-phrase automata.

A window is `size` consecutive words of one document. Words covered by a window that
also starts earlier (in a document of a smaller id, or before it in the same document)
are removed.

1. Confirm: every window has an anchor, the smallest hash among its runs of eight words,
   so equal windows share it. Only windows whose anchor lies in two documents or more are
   counted; those found in two documents are the recurring phrases, each owned by the
   document where it comes first.
2. Compile: owners emit their phrases as passages. They are dealt by anchor into shards,
   and each shard becomes one Aho-Corasick automaton over word numbers. The windows of a
   very frequent anchor are dealt one by one, by their content, so a window and its phrase
   meet in one shard; only a phrase that itself lies in very many documents is copied, once
   for every SHARD_DOCS of them.
3. Stream: all other stretches of text with such an anchor go to the automata of their
   shard, which find every occurrence word by word; the ranges found go back to their
   documents.

Whole copies and repeats inside one document need no automaton: both are settled where
the document is read.

Defined results: a missing or empty text has no words; texts are read whole; a text with
fewer words than a window keeps all; of equal texts the smallest id stays, and all rows
with that id; rows without an id, and rows of an id that names several texts, are
compared with themselves only; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legnet.llm.batches import shuffle_partitions
from legnet.llm.streams import BROADCAST_IDS, only_ids
from legnet.llm.syncmers import _slide_min
from legnet.llm.words import gram_hashes, mix, split_words, word_hashes
from legnet.plans.store import Stored, cut, store, work_folder

SIZE, ANCHOR = 20, 8
#: Phrases of one automaton on average, and documents whose windows of one anchor (or, of
#: a frequent anchor, whose equal windows) go to one shard.
SHARD_PHRASES, SHARD_DOCS = 20_000, 1_000


class Windows:
    """Windows of a batch of texts: per text, anchor and content hash of every start."""

    def __init__(self, texts, size: int = SIZE, anchor: int = ANCHOR):
        self.words = split_words(texts)
        hashes = word_hashes(self.words)
        self.size = size
        whole = gram_hashes(hashes, size)
        # 128 bits tell windows apart: two hashes of different seeds.
        self.a, self.b = whole, gram_hashes(hashes, size, seed=1)
        small = gram_hashes(hashes, anchor)
        self.h = _slide_min(small, size - anchor + 1) if len(whole) else whole

    def __len__(self) -> int:
        return len(self.words.first) - 1

    def of(self, i: int):
        """(anchors, contents, repeats) of text i; a repeat equals an earlier window of it."""
        lo = int(self.words.first[i])
        n = int(self.words.first[i + 1]) - lo - self.size + 1
        if n <= 0:
            none = np.zeros(0, np.uint64)
            return none, none, np.zeros(0, bool)
        h, a, b = (x[lo : lo + n] for x in (self.h, self.a, self.b))
        again = np.zeros(n, bool)
        values = np.sort(a)
        if (values[1:] == values[:-1]).any():
            order = np.lexsort((b, a))  # stable: of equal windows the first comes first
            same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            again[order[1:][same]] = True
        return h, a, again

    def anchors(self, i: int) -> np.ndarray:
        """Anchors of the windows of text i."""
        lo = int(self.words.first[i])
        return self.h[lo : max(lo, int(self.words.first[i + 1]) - self.size + 1)]

    def listed(self, i: int) -> list[bytes]:
        """Words of text i."""
        lo, hi = int(self.words.first[i]), int(self.words.first[i + 1])
        if lo == hi:
            return []
        return self.words.data[int(self.words.start[lo]) : int(self.words.end[hi - 1])].split()


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of every run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def kept(words: list[bytes], gone: np.ndarray, size: int = SIZE) -> tuple[int, str, bytes]:
    """(removed, digest, text) after removing the words that the flagged windows cover."""
    n = len(words)
    steps = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(gone)
    steps[at] += 1
    np.subtract.at(steps, at + size, 1)
    covered = np.cumsum(steps[:n]) > 0
    left = [w for w, c in zip(words, covered.tolist()) if not c] if covered.any() else words
    text = b" ".join(left)
    return n - len(left), sha256(text).hexdigest(), text


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )


def _describe(batches):
    """Every text by itself: words, what its own repeats remove, digest of all its words."""
    schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("lost", pa.int64()), ("sha", pa.string()), ("whole", pa.string())]
    )
    for batch in batches:
        cols = batch.to_pydict()
        w = Windows(cols["text"])
        out = {"id": cols["id"], "n": [], "lost": [], "sha": [], "whole": []}
        for i in range(len(w)):
            words = w.listed(i)
            again = w.of(i)[2]
            whole = sha256(b" ".join(words)).hexdigest()
            lost, sha = kept(words, again)[:2] if again.any() else (0, whole)
            for c, v in zip(("n", "lost", "sha", "whole"), (len(words), lost, sha, whole)):
                out[c].append(v)
        yield _batch(out, schema)


def _anchors(batches):
    """(h, n, k): distinct anchors, the texts and the windows they lie in, added up per batch."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("k", pa.int64())])
    for batch in batches:
        w = Windows(batch.to_pydict()["text"])
        own = []
        for i in range(len(w)):
            h, _, again = w.of(i)
            own.append(np.unique(h[~again], return_counts=True))
        h, at, n = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True, return_counts=True)
        k = np.zeros(len(h), np.int64)
        np.add.at(k, at, np.concatenate([x for _, x in own]))
        yield _batch({"h": h.view(np.int64), "n": n, "k": k}, schema)


def _anchors_of(batches):
    """(id, h): distinct anchors of every text."""
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64())])
    for batch in batches:
        cols = batch.to_pydict()
        w = Windows(cols["text"])
        own = [np.unique(w.anchors(i)) for i in range(len(w))]
        ids = np.repeat(np.array(cols["id"], dtype=np.int64), [len(x) for x in own])
        yield _batch({"id": ids, "h": np.concatenate(own).view(np.int64)}, schema)


def _candidates(batches):
    """(h, w, id, start): windows with a recurring anchor, repeats inside a text left out."""
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("id", pa.int64()), ("start", pa.int32())])
    for batch in batches:
        cols = batch.to_pydict()
        w = Windows(cols["text"])
        hs, ws, starts, sizes = [], [], [], []
        for i in range(len(w)):
            h, a, again = w.of(i)
            at = np.flatnonzero(np.isin(h, np.array(cols["hs"][i], dtype=np.int64).view(np.uint64)) & ~again)
            hs.append(h[at])
            ws.append(a[at])
            starts.append(at)
            sizes.append(len(at))
        out = {
            "h": np.concatenate(hs).view(np.int64),
            "w": np.concatenate(ws).view(np.int64),
            "id": np.repeat(np.array(cols["id"], dtype=np.int64), sizes),
            "start": np.concatenate(starts).astype(np.int32),
        }
        yield _batch(out, schema)


def _stretches(batches, wide: int):
    """Passages that a document owns (kind 0) and stretches to look up (kind 1).

    Both are runs of windows with one anchor; `text` holds their words. An anchor of more
    than `wide` windows gives single windows with their content hash `w` instead; `docs`
    is the number of documents that such a phrase lies in, where it exceeds SHARD_DOCS.
    """
    schema = pa.schema(
        [("h", pa.int64()), ("w", pa.int64()), ("docs", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("start", pa.int32()), ("text", pa.binary())]
    )
    for batch in batches:
        cols = batch.to_pydict()
        w = Windows(cols["text"])
        out = {n: [] for n in schema.names}
        for i in range(len(w)):
            h, content, again = w.of(i)
            known = np.array(cols["hs"][i], dtype=np.int64).view(np.uint64)
            frequent = known[np.array(cols["ks"][i], dtype=np.int64) > wide]
            live = np.isin(h, known) & ~again
            single = np.isin(h, frequent)
            owned = np.zeros(len(h), bool)
            owned[cols["starts"][i] or []] = True
            common = {x["start"]: x["n"] for x in cols["common"][i] or []}
            signed, contents = h.view(np.int64), content.view(np.int64)
            words = w.listed(i)
            for lo, hi in runs(live):
                here, nxt = slice(lo, hi - 1), slice(lo + 1, hi)
                cuts = np.flatnonzero((h[nxt] != h[here]) | (owned[nxt] != owned[here]) | single[here])
                edges = [lo, *(cuts + lo + 1).tolist(), hi]
                for a, b in zip(edges, edges[1:]):
                    one = bool(single[a])
                    row = (
                        int(signed[a]), int(contents[a]) if one else None, common.get(a) if one else None,
                        0 if owned[a] else 1, cols["id"][i], a, b" ".join(words[a : b + SIZE - 1]),
                    )
                    for c, v in zip(schema.names, row):
                        out[c].append(v)
        yield _batch(out, schema)


def automaton(passages: list[list[bytes]], size: int = SIZE):
    """(automaton, numbers): one key per window of the passages, over word numbers."""
    numbers: dict[bytes, int] = {}
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for words in passages:
        ids = [numbers.setdefault(x, len(numbers) + 1) for x in words]
        for i in range(len(ids) - size + 1):
            found.add_word(tuple(ids[i : i + size]))
    found.make_automaton()
    return found, numbers


def _locate(batches):
    """(id, lo, hi): ranges of window starts that are phrases of other documents.

    Rows come by shard, passages first: the automaton is compiled when the first
    stretch of a shard arrives, and dropped with the shard.
    """
    schema = pa.schema([("id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
    shard, passages, find, numbers = None, [], None, {}
    for batch in batches:
        cols = batch.to_pydict()
        out = {n: [] for n in schema.names}
        for s, kind, i, start, text in zip(*(cols[c] for c in ("shard", "kind", "id", "start", "text"))):
            if s != shard:
                shard, passages, find = s, [], None
            words = text.split()
            if kind == 0:
                passages.append(words)
                continue
            if find is None:
                if not passages:
                    continue
                find, numbers = automaton(passages)
            ids = tuple([numbers.get(x, 0) for x in words])
            flags = np.zeros(len(ids), bool)
            hits = [end - SIZE + 1 for end, _ in find.iter(ids)]
            if hits:
                flags[hits] = True
                for a, b in runs(flags):
                    out["id"].append(i)
                    out["lo"].append(start + a)
                    out["hi"].append(start + b)
        yield _batch(out, schema)


def _remove(batches):
    """(id, lost, sha) of texts with located ranges."""
    schema = pa.schema([("id", pa.int64()), ("lost", pa.int64()), ("sha", pa.string())])
    for batch in batches:
        cols = batch.to_pydict()
        w = Windows(cols["text"])
        out = {n: [] for n in schema.names}
        for i in range(len(w)):
            gone = w.of(i)[2]
            for r in cols["ranges"][i]:
                gone[r["lo"] : r["hi"]] = True
            lost, sha, _ = kept(w.listed(i), gone)
            for c, v in zip(schema.names, (cols["id"][i], lost, sha)):
                out[c].append(v)
        yield _batch(out, schema)


class Bucketed:
    """A table bucketed by id in the shared folder: joins by id need no shuffle of it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.name = f"legnet_{uuid.uuid4().hex}"
        self.path = f"{work_folder(self.spark)}/{self.name}"
        writer = df.write.option("path", self.path).option("compression", "zstd").format("parquet")
        writer.bucketBy(shuffle_partitions(self.spark), "id").sortBy("id").saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        Stored(self.df, self.path, {}).drop()


def dealt_rows(rows: DataFrame, common: DataFrame, n_common: int) -> DataFrame:
    """rows of `_stretches` with the `salt` that, with h and w, chooses their shard.

    common: (h, w, seen) of the phrases in more than SHARD_DOCS documents. Such a phrase
    goes to a salt for every SHARD_DOCS documents, its stretches to one of them; all
    other rows have salt 0.
    """
    def salts(docs: str):
        return F.ceil(F.coalesce(F.col(docs), F.lit(1)) / F.lit(SHARD_DOCS)).cast("int")

    if n_common:
        known = F.broadcast(common) if n_common <= BROADCAST_IDS else common
        rows = rows.join(known, ["h", "w"], "left")
    else:
        rows = rows.withColumn("seen", F.lit(None).cast("long"))
    spots = F.when(F.col("kind") == 0, F.sequence(F.lit(0), salts("docs") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("id", "start"), salts("seen")).cast("int"))
    )
    return rows.withColumn("salt", F.explode(spots))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every document."""
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text"))
    base = cut(docs.mapInArrow(_describe, "id long, n long, lost long, sha string, whole string"))
    clear = (
        base.where(F.col("id").isNotNull()).groupBy("id")
        .agg(F.min("whole").alias("whole"), F.max("whole").alias("other"), F.max("n").alias("n"))
        .where("whole = other")
    )
    classes = cut(
        clear.where(F.col("n") >= SIZE).groupBy("whole")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("ids"))
    )
    owners = store(classes.select(F.col("first").alias("id")))
    sources = only_ids(docs, "id", owners.df, owners.stats["rows"])

    # 1. Recurring anchors, then recurring windows and their owners.
    shared = store(
        sources.mapInArrow(_anchors, "h long, n long, k long").groupBy("h")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n > 1").select("h", "k")
    )
    anchors = shared.df if shared.stats["rows"] > BROADCAST_IDS else F.broadcast(shared.df)
    hits = store(
        sources.mapInArrow(_anchors_of, "id long, h long").join(anchors, "h").groupBy("id")
        .agg(F.collect_list("h").alias("hs"), F.collect_list("k").alias("ks"))
    )
    texts = Bucketed(only_ids(docs, "id", hits.df.select("id"), hits.stats["rows"]).join(hits.df, "id"))
    first = (
        texts.df.select("id", "text", "hs").mapInArrow(_candidates, "h long, w long, id long, start int")
        .groupBy("h", "w").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    # Phrases of very many documents, with their numbers of documents.
    often = F.when(F.col("n") > SHARD_DOCS, F.struct("h", "w", F.col("first.start").alias("start"), "n"))
    owned = store(
        first.groupBy("first.id").agg(
            F.collect_list("first.start").alias("starts"), F.collect_list(often).alias("common")
        ),
        phrases=F.sum(F.size("starts")),
    )
    common = store(owned.df.select(F.explode("common").alias("c")).select("c.h", "c.w", F.col("c.n").alias("seen")))

    # 2. and 3. Passages and stretches, dealt into shards by anchor or by window.
    given = texts.df.join(owned.df, "id", "left").select("id", "text", "hs", "ks", "starts", "common")
    wide = SHARD_DOCS * (SIZE - ANCHOR + 1)
    rows = given.mapInArrow(
        lambda batches: _stretches(batches, wide),
        "h long, w long, docs long, kind int, id long, start int, text binary",
    )
    dealt = dealt_rows(rows, common.df, common.stats["rows"])
    tasks = shuffle_partitions(spark)
    shards = max(4 * tasks, -(-(owned.stats["phrases"] or 0) // SHARD_PHRASES))
    dealt = dealt.select(
        F.pmod(F.xxhash64("h", "w", "salt"), F.lit(shards)).alias("shard"), "kind", "id", "start", "text"
    )
    dealt = dealt.repartition(max(tasks, shards // 4), "shard").sortWithinPartitions("shard", "kind")
    found = cut(
        dealt.mapInArrow(_locate, "id long, lo int, hi int").groupBy("id")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    )
    changed = cut(
        texts.df.select("id", "text").join(found, "id").mapInArrow(_remove, "id long, lost long, sha string")
        .distinct()
    )
    texts.drop()

    copies = cut(classes.where("ids > 1").select(F.col("whole").alias("of"), "first"))
    gone = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("first"))
    several = cut(
        base.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("whole").alias("x"), F.max("whole").alias("y"))
        .where("x <> y").select(F.col("id").alias("several"))
    )
    changed = changed.select(F.col("id").alias("cid"), F.col("lost").alias("clost"), F.col("sha").alias("csha"))
    done = (
        base.join(copies, base["whole"] == copies["of"], "left")
        .join(several, F.col("id") == F.col("several"), "left")
        .withColumn("copy", gone & F.col("several").isNull())
        .join(changed, F.col("id") == F.col("cid"), "left")
    )
    empty = sha256(b"").hexdigest()
    return done.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("clost", "lost")).alias("n_removed"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("csha", "sha")).alias("kept_sha256"),
    )
