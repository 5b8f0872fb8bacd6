"""Pages that are broken on purpose, and captures that share a URL and a page."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from legnet.llm import warc
from legnet.llm.dom import _Tags, parse

#: The grammar of a token, as one pattern that may look at a place many times.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)


@settings(max_examples=3000, deadline=None)
@given(st.text(st.sampled_from("<<<>/a\"' b=!-?Z\n"), max_size=24))
def test_tags_are_those_of_the_grammar(html):
    tags, at = _Tags(html), 0
    while True:
        want, got = TOKEN.search(html, at), tags.search(at)
        assert (want is None) == (got is None)
        if want is None:
            break
        assert got[:2] == want.span() and got[3] == want[2]
        if want[2] is not None:
            assert (got[2], got[4]) == (want[1] == "/", want[3])
        at = want.end()


@pytest.mark.parametrize("piece", ["<a ", "<aaaa", "<a\"", "<a href=\"x", "<a '\"", "</script ", "<", "<p>", "<!-", "'\"<b x"])
def test_a_megabyte_of_it_is_read_in_time(piece):
    for page in (piece * (1_000_000 // len(piece)), "<a" * 3 + "x" * 1_000_000, "<script>" + piece * (1_000_000 // len(piece))):
        began = time.process_time()
        _ = [t for t in _all(page)]
        assert time.process_time() - began < 4


def _all(html):
    tags, at = _Tags(html), 0
    while (found := tags.search(at)) is not None:
        yield found
        at = found[1]


def test_raw_text_without_an_end_is_skipped_in_time():
    began = time.process_time()
    assert [n.text for n in parse("<p>one</p><script>" + "</script " * 110_000) if n.text] == ["one"]
    assert time.process_time() - began < 4


def test_captures_of_one_url_and_page_all_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)  # equal lines lie in several blocks
    texts = [f"<p>{i}</p>" * 30 for i in range(12)]
    rows = [(None, "http://a.example/x", t) for t in texts[:5]] + [(7, "http://a.example/x", t) for t in texts[5:10]]
    rows += [(8, "http://a.example/x", texts[10]), (9, "http://b.example/", texts[11]), (9, "http://b.example/", texts[11])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_digest) for r in warc.round_trip(df).collect())
    assert got == sorted((str(p), hashlib.sha256(t.encode()).hexdigest()) for p, _, t in rows)
