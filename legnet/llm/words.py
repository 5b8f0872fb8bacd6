"""Vectorised words and hashes of a batch of texts (numpy, inside tasks).

A word is a run of bytes other than 0x20 and 0x09-0x0D, the ASCII white space; no
byte of a longer UTF-8 character is one of these, so words of the UTF-8 bytes are
the words of the text. Hashes are polynomials modulo 2**64 over bytes (or over
word hashes), mixed by a bijection: they select candidates and are the same on
every executor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def inverse(odd: int) -> int:
    """The number whose product with `odd` is 1 modulo 2**64."""
    return pow(int(odd), -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: Runs of up to this many hashes are added up one by one.
LOOP_SIZE = 6
#: Bytes whose words are hashed at once.
SLICE = 1 << 17

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; kept per worker, grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of several texts: start and end byte in `data`, first word of each text."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1 positions in start

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(texts, lower: bool = False) -> Words:
    """Words of all texts (None: no words); lower turns A-Z into a-z."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n"
    if lower:
        data = data.lower()  # bytes.lower changes A-Z only
    codes = np.frombuffer(data, dtype=np.uint8)
    gap = np.concatenate(([True], (codes == 32) | ((codes >= 9) & (codes <= 13))))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(b) + 1 for b in raw), dtype=np.int64, count=len(raw))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    return Words(data, start, end, np.searchsorted(start, begins))


def word_hashes(w: Words) -> np.ndarray:
    """One 64-bit hash per word.

    Words are taken in runs of about SLICE bytes, as a byte takes some 50 in the numbers here.
    """
    out = np.zeros(len(w.start), np.uint64)
    data = np.frombuffer(w.data, dtype=np.uint8)
    first = 0
    while first < len(out):
        begin = int(w.start[first])
        last = max(first + 1, int(np.searchsorted(w.end, begin + SLICE, side="right")))
        codes = data[begin : int(w.end[last - 1])].astype(np.uint64) + np.uint64(1)
        n = len(codes)
        total = np.concatenate(
            (np.zeros(1, np.uint64), np.cumsum(codes * powers(int(BASE), n), dtype=np.uint64))
        )
        start, end = w.start[first:last] - begin, w.end[first:last] - begin
        out[first:last] = mix((total[end] - total[start]) * powers(inverse(int(BASE)), n)[start])
        first = last
    return out


def gram_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of `size` consecutive hashes (runs may cross texts).

    Entry i covers i to i + size - 1; the result has len(hashes) - size + 1 entries.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((int(BASE) * (2 * seed + 3)) % 2**64 | 1)
    if size <= LOOP_SIZE:
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out *= base
            out += hashes[j : j + n]
    else:  # the same numbers as differences of one running sum, whatever the size
        terms = hashes * powers(inverse(int(base)), len(hashes))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        out = (total[size:] - total[:-size]) * powers(int(base), len(hashes))[size - 1 :]
    return mix(out + np.uint64(size))
