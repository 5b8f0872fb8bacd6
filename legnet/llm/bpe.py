"""Byte-pair encoding and decoding with a public vocabulary file.

A text is cut at the special tokens, normalised (NFC, lower case), split into
pieces by the file's pattern, and each piece is merged: symbols form a doubly
linked list, a heap holds (rank, place) of the pairs that may merge, and an entry
whose pair has changed since is stale and skipped. Decoding joins the vocabulary
strings of the ids.

Defined results: a missing or empty text has no ids and decodes to the empty text;
texts of any length are encoded whole; repeated rows give repeated results; other
columns, whatever their names, pass through `keep` or are left out. Letters that
Unicode added after version 15.1 follow Python's tables, not the file's own engine.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from legnet.llm.batches import map_batches

#: Pieces remembered per worker in each of two generations: a full young one becomes
#: the old one, and a piece found in the old one is young again.
MEMORY = 250_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else from U+0100 on."""
    letters, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(free))
            free += 1
    return letters


class Codec:
    """Vocabulary, merges and splitting rule of one file (its JSON text)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for table in (vocab, self.special):
            for text, i in table.items():
                self.strings[i] = text
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        splits = [p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # White space is the Unicode property, as in the file's own engine.
        pattern = splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.find = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.memory: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece."""
        raw = piece.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges, heap = self.merges, []
        for i in range(n - 1):
            if (m := merges.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i))
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = merges.get((ids[i], ids[j]))
            if m is None or m[0] != rank:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = m[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (x[0], i))
            if (h := before[i]) >= 0 and (x := merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (x[0], h))
        return tuple(i for i in ids if i >= 0)

    def pieces(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # Letter by letter, so a sigma at a word's end is a sigma as anywhere.
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return self.find(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for part in self.cut(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            known = self.memory.get
            for piece in self.pieces(part):
                ids = known(piece)
                if ids is None:
                    if len(self.memory) >= MEMORY:
                        self.old, self.memory = self.memory, {}
                        known = self.memory.get
                    ids = self.old.get(piece) or self.merge(piece)
                    self.memory[piece] = ids
                out += ids
        return out

    def decode(self, ids: Iterable[int] | None) -> str:
        """The vocabulary strings of ids, joined by the space of a file without decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in ids]) if ids else ""


_HELD: list = [None, None]


class Shared:
    """A vocabulary file, read on the driver and sent once to each executor.

    The file is a parameter with a known size (a few MB), not a table.
    """

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.digest = hashlib.sha256(spec.encode()).hexdigest()
        self.spec = spark.sparkContext.broadcast(spec)

    def codec(self) -> Codec:
        # One codec a worker, for all stages and runs of a file; another file takes its place.
        if _HELD[0] != self.digest:
            _HELD[:] = self.digest, Codec(self.spec.value)
        return _HELD[1]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and `ids`, an array of the text's token ids."""
    keep = [c for c in docs.columns if c not in (text, "ids")] if keep is None else keep
    shared = Shared(docs.sparkSession, path)
    fields = [docs.schema[c] for c in keep] + [StructField("ids", ArrayType(IntegerType()))]

    def run(rows):
        codec = shared.codec()
        out = {f"_{i}": rows[f"_{i}"] for i in range(len(keep))}
        return out | {"ids": [codec.encode(t) for t in rows["_text"]]}

    inner = [StructField(f"_{i}", f.dataType) for i, f in enumerate(fields[:-1])] + fields[-1:]
    given = docs.select(*[docs[c].alias(f"_{i}") for i, c in enumerate(keep)], docs[text].alias("_text"))
    return map_batches(given, run, StructType(inner)).toDF(*[f.name for f in fields])


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with the text of its ids."""
    shared = Shared(tokens.sparkSession, path)
    names = tokens.columns
    fields = [StructField(f"_{i}", f.dataType) for i, f in enumerate(tokens.schema.fields)]
    place = f"_{names.index(ids)}"

    def run(rows):
        codec = shared.codec()
        return rows | {"_text": [codec.decode(x) for x in rows[place]]}

    given = tokens.toDF(*[f.name for f in fields])
    schema = StructType([*fields, StructField("_text", StringType())])
    return map_batches(given, run, schema).toDF(*names, out)


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one stage.

    Token ids go through the same encoder and decoder as in `encode` and `decode`,
    but only their digests leave the task.
    """
    from hashlib import sha256

    shared = Shared(docs.sparkSession, path)
    schema = StructType.fromDDL("id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(rows):
        codec = shared.codec()
        numbers = list(map(str, range(len(codec.strings))))
        n, ids_sha, text_sha = [], [], []
        for t in rows["_text"]:
            ids = codec.encode(t)
            n.append(len(ids))
            ids_sha.append(sha256(" ".join([numbers[i] for i in ids]).encode()).hexdigest())
            text_sha.append(sha256(codec.decode(ids).encode()).hexdigest())
        return {"id": rows["_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    given = docs.select(docs[id_col].cast("long").alias("_id"), docs[text].alias("_text"))
    return map_batches(given, run, schema).withColumnRenamed("id", id_col)
