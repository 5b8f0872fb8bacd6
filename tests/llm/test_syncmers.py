"""Written fingerprints: every anchor comes back, in about six letters each."""

import numpy as np
import pytest
from llm_cases import prose

from legnet.llm import syncmers


@pytest.mark.parametrize("places", [[], [0], [42], [43], [0, 42, 84, 127], [1, 1849, 1850, 128657, 10**12]])
def test_written_fingerprints_are_read_back(places):
    hashes = [(1 << 32) - 1 - 7**i for i in range(len(places))]
    assert syncmers.read(syncmers.written((hashes, places))) == (hashes, places)
    again = syncmers.written((np.array(hashes, np.int64), np.array(places, np.int64)))
    assert again == syncmers.written((hashes, places)) and again.isascii()


def test_an_anchor_takes_six_letters():
    [(hashes, places)] = syncmers.anchors([prose(5, 4000)])
    text = syncmers.written((hashes, places))
    assert syncmers.read(text) == (hashes, places) and len(hashes) > 4000
    assert len(text) < 6.2 * len(hashes)


def test_a_longer_text_begins_with_the_same_letters():
    text = prose(6, 300)
    short, whole = (syncmers.written(x) for x in syncmers.anchors([text[:900], text]))
    assert whole.startswith(short[:-60]) and len(whole) > len(short) > 600
