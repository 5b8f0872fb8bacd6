"""The byte-level codec against the library that reads the same rank file."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward, documents

from legnet.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _both(path):
    with open(path, "rb") as f:
        data = f.read()
    ranks = byte_bpe.read_ranks(data)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.Codec(data, PATTERN), library


ONE, TWO = _both(PATH), _both(MULTI)


@settings(max_examples=400, deadline=None)
@given(
    st.one_of(
        st.text(max_size=40),
        st.text(st.sampled_from("aB's'llé日本한𝄞\x1c\x85 ​　 \n\t019%<|endoftext|>"), max_size=60),
    )
)
def test_codec_is_the_library(text):
    for own, library in (ONE, TWO):
        want = library.encode_ordinary(text)
        assert own.encode(text).tolist() == want
        assert own.decode(want) == text.encode()


def test_long_pre_tokens():
    for text in ("a" * 100_000, " " * 50_001 + "x", "日" * 20_000, "ab1!" * 30_000):
        own, library = ONE
        assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_every_token_decodes_to_its_bytes():
    own, library = ONE
    for token, i in byte_bpe.read_ranks(open(PATH, "rb").read()).items():
        assert own.decode([i]) == token == library.decode_single_token_bytes(i)


def test_memory_starts_anew(monkeypatch):
    own, library = _both(PATH)
    monkeypatch.setattr(byte_bpe, "MEMORY", 10)
    for text in ("some words here", "and others there", "some words here", ""):
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    assert own.held < 40


def test_ranks_with_gaps_and_a_token_out_of_reach():
    """ids are the file's ranks; a token that no merges lead to stands for its own pre-token."""
    import base64

    ranks = {bytes([b]): 2 * b for b in range(256)} | {b"ab": 600, b"zxcv": 1000}
    data = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    own = byte_bpe.Codec(data, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("ab", "zxcv", " zxcv", "zxcv ab", "abab zxcvz"):
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    with pytest.raises(ValueError):
        byte_bpe.Codec(base64.b64encode(b"a") + b" 0", PATTERN)


def test_query(spark):
    rows = [*awkward(), (16, "tail ' ll 's 'S  \n\n x"), (17, None), (17, "twice"), (17, "twice")]
    got = byte_bpe.round_trip(documents(spark, rows), PATH, PATTERN).collect()
    library = ONE[1]

    def row(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return (
            str(doc_id), len(ids),
            hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        )

    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(row(*r[:2]) for r in rows)
    ids = byte_bpe.encode(documents(spark, rows), PATH, PATTERN, keep=["doc_id", "id"])
    both = byte_bpe.decode(ids, PATH, PATTERN)
    assert both.columns == ["doc_id", "id", "ids", "decoded"]
    texts = sorted((r[1] or "").encode() for r in rows)
    assert sorted(bytes(r.decoded) for r in both.collect()) == texts
    assert byte_bpe.round_trip(documents(spark, []), PATH, PATTERN).count() == 0
