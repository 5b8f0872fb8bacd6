"""Byte-level byte-pair encoding and decoding through a serialised sentencepiece model.

A file of ranks (`base64 rank` a line) becomes a sentencepiece BPE model: every byte
stands as one letter, every token as one piece whose score is the negative of its
place in rank order, and the normaliser changes nothing. That model is written field
by field as a protocol buffer, sent once to each executor and asked for the pieces of
every pre-token, a match of the splitting pattern. A pre-token that is a token itself
is that token. Decoding maps the pieces' letters back to bytes and joins them.

Defined results: a missing or empty text has no ids and decodes to no bytes; texts of
any length are encoded whole; repeated rows give repeated results; other columns,
whatever their names, pass through `keep` or are left out; missing ids decode to no
bytes, ids outside the file raise an error. Ranks must give each of the 256 bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable
from hashlib import sha256
from itertools import chain

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from legnet.llm.batches import map_batches

#: Characters of pre-tokens a worker remembers before it starts anew.
MEMORY = 8_000_000

#: Byte b stands as the letter U+0100 + b, so no piece holds white space or a control sign.
_LETTERS = {b: 0x100 + b for b in range(256)}
_BYTES = {letter: b for b, letter in _LETTERS.items()}


def as_letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_LETTERS)


def as_bytes(letters: str) -> bytes:
    return letters.translate(_BYTES).encode("latin-1")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and rank of every line of a rank file."""
    lines = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _score(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


# Fixed field and enum numbers of the sentencepiece model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _PIECE_SCORE, _PIECE_TYPE, _UNKNOWN = 1, 2, 3, 2
_MODEL_TYPE, _BPE, _VOCAB_SIZE, _UNK_ID = 3, 2, 4, 40
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of tokens in rank order; the unknown piece comes last."""
    parts = [
        _block(_PIECES, _block(_PIECE, as_letters(t).encode()) + _score(_PIECE_SCORE, -float(i)))
        for i, t in enumerate(tokens)
    ]
    unknown = _block(_PIECE, b"<unk>") + _score(_PIECE_SCORE, 0.0) + _number(_PIECE_TYPE, _UNKNOWN)
    trainer = _number(_MODEL_TYPE, _BPE) + _number(_VOCAB_SIZE, len(tokens) + 1)
    trainer += _number(_UNK_ID, len(tokens))
    identity = _block(_NAME, b"identity")
    identity += b"".join(_number(f, 0) for f in (_DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES))
    parts += [_block(_PIECES, unknown), _block(_TRAINER, trainer), _block(_NORMALIZER, identity)]
    return b"".join(parts)


class Codec:
    """Encoder and decoder of one rank file and splitting pattern."""

    def __init__(self, data: bytes, pattern: str):
        ranks = read_ranks(data)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no rank for {len(missing)} of the 256 bytes")
        tokens = sorted(ranks, key=ranks.__getitem__)
        if len(tokens) > 1 << 24:
            raise ValueError("scores of more than 2 ** 24 tokens are not exact")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.ids = [ranks[t] for t in tokens]
        self.strings = {
            i: as_bytes(self.model.id_to_piece(place)) for place, i in enumerate(self.ids)
        }
        # White space is the Unicode property; Python's \s has four controls more.
        space = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find = regex.compile(space).findall
        # Tokens that their own merges do not reach stand for themselves all the same.
        letters = [as_letters(t) for t in tokens]
        found = self.model.encode(letters, num_threads=1)
        self.whole = {x: (self.ids[i],) for i, x in enumerate(letters) if found[i] != [i]}
        self.memory: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _learn(self, fresh: list[str]) -> None:
        letters = [as_letters(p.encode()) for p in fresh]
        ids = self.ids
        for p, x, places in zip(fresh, letters, self.model.encode(letters, num_threads=1)):
            self.memory[p] = self.whole.get(x) or tuple([ids[i] for i in places])
            self.held += len(p)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text, each pre-token merged by itself."""
        if not text:
            return np.empty(0, np.uint32)
        if self.held > MEMORY:
            self.memory, self.held = {}, 0
        pieces = self.find(text)
        if fresh := [p for p in set(pieces) if p not in self.memory]:
            self._learn(fresh)
        return np.fromiter(chain.from_iterable(map(self.memory.__getitem__, pieces)), np.uint32)

    def decode(self, ids: Iterable[int] | None) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids)) if ids is not None else b""


_HELD: list = [None, None]


class Shared:
    """A rank file, read on the driver and sent once to each executor.

    The file is a parameter with a known size (a few MB), not a table.
    """

    def __init__(self, spark, path: str, pattern: str):
        with open(path, "rb") as f:
            self.spec = spark.sparkContext.broadcast((f.read(), pattern))

    def codec(self) -> Codec:
        # One codec a worker; a task of another file finds another value and reads anew.
        if _HELD[0] is not self.spec.value:
            _HELD[:] = self.spec.value, Codec(*self.spec.value)
        return _HELD[1]


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The kept columns and `ids`, an array of the text's token ids as longs."""
    keep = [c for c in docs.columns if c not in (text, "ids")] if keep is None else keep
    shared = Shared(docs.sparkSession, path, pattern)
    fields = [docs.schema[c] for c in keep] + [StructField("ids", ArrayType(LongType()))]

    def run(rows):
        codec = shared.codec()
        out = {f"_{i}": rows[f"_{i}"] for i in range(len(keep))}
        return out | {"ids": [codec.encode(t).astype(np.int64) for t in rows["_text"]]}

    inner = [StructField(f"_{i}", f.dataType) for i, f in enumerate(fields[:-1])] + fields[-1:]
    given = docs.select(
        *[docs[c].alias(f"_{i}") for i, c in enumerate(keep)], docs[text].alias("_text")
    )
    return map_batches(given, run, StructType(inner)).toDF(*[f.name for f in fields])


def decode(
    tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """tokens with the bytes of its ids, which need not be whole letters of UTF-8."""
    shared = Shared(tokens.sparkSession, path, pattern)
    names = tokens.columns
    fields = [StructField(f"_{i}", f.dataType) for i, f in enumerate(tokens.schema.fields)]
    place = f"_{names.index(ids)}"

    def run(rows):
        codec = shared.codec()
        return rows | {"_bytes": [codec.decode(x) for x in rows[place]]}

    given = tokens.toDF(*[f.name for f in fields])
    schema = StructType([*fields, StructField("_bytes", BinaryType())])
    return map_batches(given, run, schema).toDF(*names, out)


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256.

    Ids and bytes come from the same encoder and decoder as in `encode` and `decode`,
    but only their digests leave the task.
    """
    shared = Shared(docs.sparkSession, path, pattern)
    schema = StructType.fromDDL("id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(rows):
        codec = shared.codec()
        n, ids_sha, text_sha = [], [], []
        for t in rows["_text"]:
            ids = codec.encode(t)
            n.append(len(ids))
            ids_sha.append(sha256(ids.astype("<u4").tobytes()).hexdigest())
            text_sha.append(sha256(codec.decode(ids.tolist())).hexdigest())
        return {"id": rows["_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    given = docs.select(docs[id_col].cast("long").alias("_id"), docs[text].alias("_text"))
    return map_batches(given, run, schema).withColumnRenamed("id", id_col)
