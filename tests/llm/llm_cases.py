"""Awkward documents and plain Python versions of the operators."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql.types import LongType, StringType, StructField, StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # Names that operators use inside.
        StructField("id", StringType()),
        StructField("n", LongType()),
        StructField("rep", LongType()),
        StructField("bucket", LongType()),
        StructField("_text", StringType()),
    ]
)


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, "en", "web")[:4] if len(r) == 2 else r
        full.append((doc_id, text, lang, source, len(text or ""), "x", 1, 2, 3, "y"))
    return spark.createDataFrame(full, DOCS)


def prose(seed, n):
    import random

    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghijklm", k=rnd.randint(2, 7))) for _ in range(n))


def awkward():
    """Nulls, empty, very long, tied and repeated texts; ids are unique but for one missing."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [
        (None, base),
        (1, None),
        (2, ""),
        (3, " \t\n\x0b "),
        (4, "One"),
        (5, "one"),
        (6, "two words"),
        (7, "same " * 300),
        (8, base),
        (9, near, None, None),
        (10, base.upper()),
        (11, prose(2, 30000), "de", "books"),
        (12, "start " + base[: len(base) // 2] + " ünï €𝄞 end"),
        (13, base, "xx", ""),
        (14, "mail a.b@c.example.org or +1 (415) 555-0100, ip 10.0.0.255 card 4111 1111 1111 1111"),
        (15, "퟿\U0010ffff ''' <|endoftext|> ÀÉ"),
    ]


def jaccard_components(rows, size=3, num=90, den=100):
    low = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        if len(w) >= size:
            sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1))
        else:
            sets[i] = frozenset([tuple(w)]) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(i)
        for j, c in common.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i in sets:
        least[find(i)] = min(i, least.get(find(i), i))
    return {i: (len(s), least[find(i)]) for i, s in sets.items()}


def windows_removed(rows, size=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            if k in seen:
                gone[s : s + size] = [True] * size
            seen.add(k)
        text = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(text.encode()).hexdigest())
    return out


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    def good(kind, s):
        digits = [int(c) for c in s if c.isdigit()]
        if kind == "ip":
            return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
        if kind == "card":
            odd = sum(digits[-1::-2])
            even = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            return 13 <= len(digits) <= 19 and (odd + even) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return [
        (kind, m.start(), m.end())
        for kind, pattern in BASE.items()
        for m in pattern.finditer(text or "")
        if good(kind, m[0])
    ]
