"""Operators that work text by text: codec, personal data, fingerprints, pages, archives."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward, base_spans, documents, prose
from tokenizers import Tokenizer

from legnet.llm import bpe, html_extract, pii, sharding, syncmers, warc
from legnet.llm.dom import features, parse

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aàbÉΣσİi'sd<|endoftx> \t́ 019%日𝄞thing"), max_size=60))
def test_codec_is_the_library(text):
    own = bpe.Codec(open(PATH, encoding="utf-8").read()) if not _KEPT else _KEPT[0]
    if not _KEPT:
        _KEPT.extend([own, Tokenizer.from_file(PATH)])
    want = _KEPT[1].encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == _KEPT[1].decode(want, skip_special_tokens=False)


_KEPT: list = []


def test_bpe_query(spark, codec, library):
    rows = awkward()
    got = {r.doc_id: r for r in bpe.round_trip(documents(spark, rows), PATH).collect()}
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    both = bpe.decode(bpe.encode(documents(spark, rows), PATH, keep=["doc_id", "id"]), PATH)
    assert both.columns == ["doc_id", "id", "ids", "decoded"] and both.count() == len(rows)
    assert bpe.round_trip(documents(spark, []), PATH).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("a1.@-+ ()0925%_é\n"), max_size=60))
def test_base_spans_are_the_patterns(text):
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == base_spans(text)


def test_pii_query(spark):
    rows = [
        *awkward(),
        (20, "Card 4111-1111-1111-1111, 999.1.1.1 1.2.3.4.5, x@y@z.org, token = \"f33e61083db5dbdf\""),
        (21, "IBAN GB82 WEST 1234 5698 7654 32 and https://joe:pa55@example.org/x"),
        (22, "9" * 5000 + ".1.2.3 " + "7" * 20),
    ]
    got = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        want = pii.written(base_spans(text))
        assert got[doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[20].n_secret, got[21].n_iban, got[21].n_login) == (1, 1, 1)
    assert got[2].spans == "" and got[1].n_email == 0
    clean = {r.doc_id: r.text for r in pii.redacted(documents(spark, rows)).collect()}
    assert clean[14] == "mail <email> or <phone>, ip <ip> card <card>"
    assert clean[1] is None and clean[8] == rows[8][1]
    assert pii.find(documents(spark, [])).count() == 0


def account(country: str, size: int, seed: int) -> str:
    """A valid account number: check digits by the rule, body from a seed."""
    body = "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[(seed * 7 + i * i * 5 + i) % 36] for i in range(size - 4))
    rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{98 - rest:02d}{body}"


def test_pii_accounts_and_secrets():
    planted, caught = 0, 0
    for seed, (country, size) in enumerate(sorted(pii.IBAN_LENGTHS.items())):
        whole = account(country, size, seed)
        spaced = " ".join(whole[i : i + 4] for i in range(0, size, 4))
        for form in (whole, spaced):
            for text in (form, f"pay to {form}, thanks", f"({form})", f"IBAN: {form} 2024", f"{form} 2024 was"):
                at = text.index(form)
                planted += 1
                caught += ("iban", at, at + len(form)) in pii.spans(text)
        wrong = whole[:2] + f"{(int(whole[2:4]) + 1) % 100:02d}" + whole[4:]
        for clean in (wrong, f"x{whole}", f"{whole}x", whole.lower()):
            assert not [s for s in pii.spans(clean) if s[0] == "iban"], clean
    assert caught == planted
    value = "f33e61083db5dbdf"
    for text in (f"token = {value}", f"token is {value}", f'API_KEY="{value}"', f"the password is '{value}'"):
        assert [text[a:b] for k, a, b in pii.spans(text) if k == "secret"] == [value], text
    for text in ("the secret is internationalisation", "a token is 12345678901234567890", "token is short1"):
        assert not [s for s in pii.spans(text) if s[0] == "secret"], text
    for text, number in (
        ("account_number: 12345678", "12345678"), ("Account No. 1234-5678 9", "1234-5678 9"),
        ("ACCT #123456", "123456"), ('"account": "00112233"', "00112233"), ("account number is 123456789", "123456789"),
    ):
        assert [text[a:b] for k, a, b in pii.spans(text) if k == "account"] == [number], text
    for text in ("account 2024", "on account of 123456 things", "account: 12345", "account no. " + "1" * 18, "acct=12ab34cd"):
        assert not [s for s in pii.spans(text) if s[0] == "account"], text
    assert not pii.spans("account_number: " * 2000) and not pii.spans("GB82 " * 2000)
    assert pii.redact(f"account no. 123456789, {account('GB', 22, 3)}") == "account no. <account>, <iban>"


def test_jump_hash():
    keys = np.arange(50_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def plain(key, shards):
        b, j = -1, 0
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert a[:500].tolist() == [plain(int(k), 16) for k in keys[:500]]
    assert ((a == b) | (b == 16)).all()
    assert abs((b == 16).mean() - 1 / 17) < 0.01 and np.bincount(a).min() > 2800


def test_sharding_query(spark, sf, tmp_path):
    import zlib

    real = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in real.collect()]
    rows += [(5000 + (i % 3), "hot") for i in range(40)] + [(None, "a"), (None, None), (None, "b")]
    got = sharding.assign(documents(spark, rows), 16).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(documents(spark, []), 16).count() == 0
    sharding.write_shards(documents(spark, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 4


def test_syncmers_are_context_free():
    text = prose(3, 400)
    whole = set(syncmers.anchors([text], size=10**6)[0][0])
    part = set(syncmers.anchors([text[500:1500]], size=10**6)[0][0])
    assert part <= whole and len(part) > 100
    a, b = syncmers.anchors([text, text + " tail"])
    assert syncmers.likeness(a, b) > 0.9 > 0.1 > syncmers.likeness(a, syncmers.anchors([prose(4, 400)])[0])
    assert syncmers.read(syncmers.written(a)) == a


def test_passages_of_long_texts_keep_their_anchors():
    passage = prose(8, 50)
    texts = [prose(9, 15000) + " " + passage, passage + " " + prose(10, 15000)]
    a, b = (set(x[0]) for x in syncmers.anchors(texts))
    own = set(syncmers.anchors([passage])[0][0])
    assert len(own) > 30 and own <= a and own <= b


def test_fingerprint_query(spark):
    rows = [r for r in awkward() if r[0] is not None] + [(100 + i, prose(i, 50)) for i in range(60)]
    got = {r.doc_id: r for r in syncmers.edited_likeness(documents(spark, rows)).collect()}
    turn = sorted(rows, key=lambda r: -r[0])
    for (i, t, *_), (j, nxt, *_) in zip(turn, [*turn[1:], turn[0]]):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r, own = got[i], syncmers.anchors([t])[0]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == syncmers.written(own)
        assert r.near_edited == syncmers.likeness(own, syncmers.anchors([edited])[0])
        assert r.near_next == syncmers.likeness(own, syncmers.anchors([nxt])[0])
    assert len(got) == len(rows)
    assert syncmers.edited_likeness(documents(spark, [])).count() == 0
    alone = syncmers.edited_likeness(documents(spark, [(None, None)])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, id long")


def test_extraction_on_unseen_layouts():
    model = html_extract.default_model()
    right = every = 0
    for html in html_extract.labelled_pages(150, seed=4242):
        nodes = parse(html)
        belief = model.marginals(nodes, features(nodes))
        for node, y, b in zip(nodes, html_extract.truth(nodes), belief):
            if node.text is not None:
                every += 1
                right += (b >= 0.5) == bool(y)
    assert right / every > 0.985


def test_marginals_are_exact():
    import itertools
    import math

    model = html_extract.default_model()
    html = "<div class=ad>x y</div><article><h1>A b</h1><p>One two three.</p></article>"
    nodes = parse(html)
    own = features(nodes)
    unary = [sum(model.weights.get(f, 0.0) for f in fs) for fs in own]
    total, each = 0.0, [0.0] * len(nodes)
    for ys in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(u * y for u, y in zip(unary, ys))
        for i, n in enumerate(nodes[1:], 1):
            s += model.pairs[html_extract.kind(n)][ys[n.parent]][ys[i]]
        total += math.exp(s)
        for i, y in enumerate(ys):
            each[i] += y * math.exp(s)
    assert model.marginals(nodes, own) == pytest.approx([e / total for e in each], abs=1e-9)


def test_extraction_query(spark, sf):
    html = (
        "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
        "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies.</p><button>OK</button></div>"
        "<article><h1>A  title</h1><p>First &amp; <b>bold</b>\n text.</p><p>Second&nbsp;one.</p>"
        "<div class=ad>Buy now</div></article><section class=comments><h3>Comments</h3>"
        "<div class=comment><p>Nice read.</p></div></section><footer>&copy; us</footer></body></html>"
    )
    rows = [(1, "u", html, "t", 1), (2, None, None, None, None), (3, "", "", "", 0), (1, "u", html, "t", 1),
            (4, "v", "<p>open <b>text of a page. <div", "", 0), (None, "w", "<" * 5000, "", 0)]
    got = html_extract.extract(pages(spark, rows)).collect()
    text = "A title\n\nFirst & bold text.\n\nSecond one."
    assert [r.text for r in got if r.page_id == 1] == [text] * 2
    assert {r.page_id: r.text for r in got}[2] == "" and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_archive_query(spark, sf):
    real = [(r.page_id, r.url, r.html, "", 0) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    copy = real[0][2]
    rows = real + [(900, "http://a.b/c", copy, "", 0), (901, None, copy, "", 0), (902, "not a url\n", "short", "", 0),
                   (903, "x", "short", "", 0), (904, real[1][1], None, "", 0), (905, "http://[bad", "é" * 200, "", 0)]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows)).collect()}
    first = {}
    for i, _, h, *_ in sorted(rows):
        first.setdefault(h or "", i)
    for i, _, h, *_ in rows:
        raw, r = (h or "").encode(), got[i]
        refers = first[h or ""] if len(raw) >= 100 and first[h or ""] != i else None
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == ("response" if refers is None else "revisit", refers)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_surt():
    assert warc.surt("https://a.Example.org:8080/x?y=1#z") == "org,example,a:8080)/x?y=1"
    assert warc.surt(None) == "" and "\n" not in warc.surt("no url\n")
