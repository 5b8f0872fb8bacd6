"""The trie and the repair of conversations against plain Python."""

import random
import zlib
from collections import defaultdict
from functools import cache
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from legnet.llm import prefix_trie, repair

COLUMNS = "conv_id long, turn long, role string, text string, n long, place long, ends string, _key string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "x", "y") for r in rows], COLUMNS)


def talk(seed, n):
    """Conversations with shared beginnings, copies, gaps, odd roles and nulls."""
    rnd, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "superuser"]
    texts = ["Hi.", "Well, yes", " ", "", None, "Done! ", "é𝄞?\n", "a.b.c", "no end"]
    for c in range(n):
        c = c * 3 - 7 if rnd.random() < 0.2 else c
        for t in range(rnd.choice([0, 1, 2, 3, 5, 9, 14])):
            role = ["system", "user", "assistant"][t % 3] if rnd.random() < 0.6 else rnd.choice(roles)
            text = rnd.choice(texts) if rnd.random() < 0.7 else f"turn {t} of many."
            rows.append((c, t * rnd.choice([1, 1, 2]), role, text))
    rows += [(4, None, "system", "null turn."), (None, 1, "user", "nobody"), (None, None, None, None)]
    return rows + rows[:3]


def ordered(rows):
    """Turns of each conversation as the trie orders them."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            out[c].append((t is not None, t or 0, mark, role, text))
    return {c: [(r[3], r[4]) for r in sorted(x)] for c, x in out.items()}


def plain_trie(rows):
    own = ordered(rows)
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, who in members.items():
        saved = (len(who) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += not kids[p]
            below[p[:d]][1] += saved
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if paths[c] == p)
        out.append((
            min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], *below[p],
            sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def trie_rows(df):
    assert df.columns == TRIE
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie(spark):
    rows = talk(1, 60)
    assert trie_rows(prefix_trie.conversation_trie(conversations(spark, rows))) == plain_trie(rows)


def test_trie_in_many_chunks_pieces_and_shards(spark, monkeypatch):
    """Long conversations, cut paths and shards of a few rows give the same trie."""
    for name, value in (("LONG", 7), ("DEPTHS", 4), ("SHARD_ROWS", 9), ("BLOCK", 4)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = talk(2, 25) + [(c, t, "user", f"same {t}") for c in (50, 55, 60) for t in range(40)]
    rows += [(61, t, "assistant", f"tail {t}") for t in range(30)]
    assert trie_rows(prefix_trie.conversation_trie(conversations(spark, rows))) == plain_trie(rows)


def test_trie_edges(spark):
    assert prefix_trie.conversation_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(conversations(spark, [(None, 0, "user", "x")])).count() == 0
    for rows in ([(5, 0, None, None)], [(-3, 1, "user", "x"), (-5, 1, "user", "y")],
                 [(2**63 - 1, 0, "user", "big"), (-(2**63), 0, "user", "small")],
                 [(c, 0, "user", "x" * 300_000) for c in range(7)]):
        assert trie_rows(prefix_trie.conversation_trie(conversations(spark, rows))) == plain_trie(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=300), st.sampled_from([2, 4, 64]))
def test_closing_parentheses(parents, block):
    """Any forest in preorder: the blocks find what a stack finds, sums are those of subtrees."""
    before, prefix_trie.BLOCK = prefix_trie.BLOCK, block
    try:
        opens, depth = [], 0
        for p in [0, *parents]:
            up = min(p, depth)
            opens += [False] * up + [True]
            depth += 1 - up
        opens = np.array(opens + [False] * depth)
        stack, want, size = [], {}, []
        for i, o in enumerate(opens):
            if o:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(opens)
        assert prefix_trie.Parentheses(opens).close(at).tolist() == [want[i] for i in at]
        weight = np.arange(1, len(at) + 1)
        leaves, total = prefix_trie.subtree_sums(opens, np.ones(len(at), np.int64), weight)
        for k, i in enumerate(at):
            inside = [j for j, x in enumerate(at) if i <= x < want[i]]
            assert total[k] == weight[inside].sum()
            assert leaves[k] == sum(want[at[j]] == at[j] + 1 for j in inside)
    finally:
        prefix_trie.BLOCK = before


def plain_repair(signs):
    """Cheapest edits from the end to the beginning; signs as (first letter, gone, cut)."""
    step = {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @cache
    def best(i, state, inserts):
        found = [(0, "")] if i == len(signs) and state in "na" else []
        if inserts < 2:
            found += [(c + 2, "I" + a) for r in "ua" if (state, r) in step
                      for c, a in [best(i, step[state, r], inserts + 1)]]
        if i < len(signs):
            ini, gone, cut = signs[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 3, "D" + a))
            if not gone:
                for r in "sua":
                    if (state, r) in step:
                        c, a = best(i + 1, step[state, r], 0)
                        if r == ini:
                            found.append((c + cut, "K" + a))
                        if r != "s":
                            found.append((c + 2 + cut, "R" + a))
        return min(found, default=(10**9, ""))

    return best(0, "n", 0)


def plain_lines(rows, audit):
    out, rest = [], list(rows)
    for e in audit:
        turn = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e == "I":
            out.append((turn, ""))
            continue
        role, text = rest.pop(0)
        if e != "D":
            out.append((role if e == "K" else turn, text))
    assert not rest
    return "\n".join(f"{r}:{t}" for r, t in out)


def plain_row(rows):
    """rows: (turn, role, text) in order, after damage."""
    signs, seen, count = [], set(), defaultdict(int)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        again, cut = (role, text) in seen, not bare.endswith((".", "!", "?"))
        seen.add((role, text))
        fault = "blank" if not bare else "duplicate" if again else "truncated" if cut else ""
        count[fault] += 1
        signs.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = plain_repair(tuple(signs))
    text = plain_lines([r[1:] for r in rows], audit)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            sha256(text.encode()).hexdigest())


def plain_query(rows):
    found = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault = zlib.crc32(key.encode()) % 20
        kept = found[c]
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
        kept += [(t, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(((c, *plain_row(sorted(x, key=order))) for c, x in found.items()), key=str)


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired_rows(df):
    assert df.columns == REPAIR
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=600, deadline=None)
@given(st.text("suaSUA-_x", max_size=9))
def test_agenda_finds_the_lightest(signs):
    rows = tuple((s.lower() if s in "suaSUA" else "?", s == "x", s in "SUA_") for s in signs)
    assert repair.repaired(signs) == plain_repair(rows)


@settings(max_examples=200, deadline=None)
@given(st.text("suaSUA-_x", min_size=1, max_size=12), st.integers(1, 4), st.integers(2, 3))
def test_joined_chunks_find_the_same(signs, size, fan):
    """Items of chunks joined over and over have the value of the whole conversation."""
    level = [repair._items(len(s), repair._row_edges(s))
             for s in (signs[i : i + size] for i in range(0, len(signs), size))]
    while len(level) > 1:
        pads = {"_key": "k", "conv_id": 1, "_group": 0, "_first": "", "_last": "", "_low": None,
                "_high": None, "_turns": 0, **dict.fromkeys(repair._COUNTS, 0)}
        parts = [level[i : i + fan] for i in range(0, len(level), fan)]
        level = [
            repair._joined({k: [v] * len(p) for k, v in pads.items()} | {"_chunk": list(range(len(p)))}
                           | {k: [x[k] for x in p] for k in ("_p", "_q", "_cost", "_audit")})
            for p in parts
        ]
    got = min((c, a) for p, q, c, a in zip(*(level[0][k] for k in ("_p", "_q", "_cost", "_audit")))
              if p == repair.NONE and q in repair.GOALS)
    assert got == repair.repaired(signs)
    edits = got[1]
    assert "".join(repair.pieces(edits, size)) == edits


@pytest.mark.parametrize("rows_in, bytes_in, fan", [(2000, 16_000_000, 64), (3, 16_000_000, 2), (5, 60, 3)])
def test_repair(spark, monkeypatch, rows_in, bytes_in, fan):
    monkeypatch.setattr(repair, "CHUNK_ROWS", rows_in)
    monkeypatch.setattr(repair, "CHUNK_BYTES", bytes_in)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = talk(3, 60) + [(99, t // 2, "user", f"line {t % 9}.") for t in range(40)]
    rows += [(98, t, "assistant", None) for t in range(9)] + [(97, None, "user", "x.")] * 8
    broken = repair.damage(conversations(spark, rows))
    assert repaired_rows(repair.repair(broken, lost=broken["lost"])) == plain_query(rows)


def test_repair_edges(spark):
    assert repair.repair(conversations(spark, [])).count() == 0
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "w" * 400_000 + "."), (2, 0, "system", "Only.")]
    got = {r.conv_id: r for r in repair.repair(conversations(spark, rows)).collect()}
    assert (got[1].audit, got[1].cost, got[2].audit, got[2].cost) == ("KK", 0, "D", 3)
    gone = repair.repair(conversations(spark, rows), lost=F.col("conv_id") == 2).collect()
    assert [tuple(r)[1:] for r in gone if r.conv_id == 2] == [(0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
