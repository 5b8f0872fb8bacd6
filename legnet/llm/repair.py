"""Repair of the structure of conversations by Knuth's lightest derivation.

A conversation should read system (once, first, optional), then user and assistant in
turn. Repairing it is a weighted deduction: an item (i, state) says that its first i
rows have been turned into roles that end in `state`; a row may be kept, given another
role or deleted, and empty turns may be inserted. An agenda pops items by (cost, audit),
where the audit spells the edits so far, until the goal item is final. Both parts of a
value grow by appending, so results are never below their premises (superior). Two
audits of one item and equal cost never are one the beginning of the other, as they
differ by inserts that cost something, so their order stays when both grow (monotone).

A long conversation is cut into chunks: a chunk is a set of items (state before, state
after) with values of their own, and the same agenda joins neighbouring chunks, many at
a time, until one is left. Its rows then stream past the chunk's part of the audit.

Defined results: a null role or text is one space, null turns come first, rows of one
turn stand in order of role and text, rows without conv_id form one conversation of
their own; repeated rows are duplicates; a role counts by its first letter alone; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from legnet.llm.batches import shuffle_partitions
from legnet.llm.streams import groups
from legnet.plans.rank import ranked
from legnet.plans.store import store

#: A conversation of more rows or bytes of text than this is cut into chunks of rows.
CHUNK_ROWS, CHUNK_BYTES = 2_000, 16_000_000
#: Chunks joined at a time.
FAN = 64
#: White space of the contract.
BLANKS = " \t\n\x0b\x0c\r"

#: Cost of an edit by its initial; an undeleted truncated row costs one more.
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
#: States by the last role: none yet, system, user, assistant; and the steps of roles.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES, GOALS = (NONE, SYSTEM, USER, ASSISTANT), (NONE, ASSISTANT)
STEPS = {
    "s": {NONE: SYSTEM},
    "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
NAMES = {USER: "user", ASSISTANT: "assistant"}

Edge = tuple[int, str, int, int]  # cost, edits, rows taken, state after


def _edges_of(sign: str, p: int) -> list[Edge]:
    """Edits of a row in state p. Signs: s u a - by role, S U A _ if truncated, x must go."""
    out = [(INSERT[1], INSERT[0], 0, to[p]) for r in "ua" if p in (to := STEPS[r])]
    if not sign:
        return out
    out.append((DELETE[1], DELETE[0], 1, p))
    if sign == "x":
        return out
    cut = int(sign in "SUA_")
    if p in STEPS.get(sign.lower(), ()):
        out.append((KEEP[1] + cut, KEEP[0], 1, STEPS[sign.lower()][p]))
    out += [(REROLE[1] + cut, REROLE[0], 1, to[p]) for r in "ua" if p in (to := STEPS[r])]
    return out


_EDGES = {(sign, p): _edges_of(sign, p) for sign in [*"suaSUA-_x", ""] for p in STATES}


def lightest(
    n: int, edges: Callable[[int, int], Iterable[Edge]], start: int, goals=()
) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) of the items (n, state), by state.

    With goals the agenda stops at the first of them; without, when it is empty.
    """
    agenda, final = [(0, "", 0, start)], {}
    while agenda:
        cost, audit, i, p = heappop(agenda)
        if (i, p) in final:
            continue
        final[i, p] = cost, audit
        if i == n and p in goals:
            return {p: (cost, audit)}
        for c, edits, taken, q in edges(i, p):
            if (i + taken, q) not in final:
                heappush(agenda, (cost + c, audit + edits, i + taken, q))
    return {p: value for (i, p), value in final.items() if i == n}


def _row_edges(signs: str) -> Callable[[int, int], list[Edge]]:
    signs_to = [*signs, ""]
    return lambda i, p: _EDGES[signs_to[i], p]


def repaired(signs: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation, given the sign of each row."""
    return min(lightest(len(signs), _row_edges(signs), NONE, GOALS).values())


@lru_cache(1 << 16)
def _repaired_short(signs: str) -> tuple[int, str]:
    return repaired(signs)


class Lines:
    """The repaired rows of one conversation, in order, from rows and edits."""

    def __init__(self):
        self.state, self.sha, self.first = NONE, sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def insert(self) -> None:
        self.state = ASSISTANT if self.state == USER else USER
        self._put(NAMES[self.state], "")

    def row(self, edit: str, role: str, text: str) -> None:
        if edit == "D":
            return
        if edit == "K" and role[:1] == "s":
            self.state = SYSTEM
        else:
            self.state = ASSISTANT if self.state == USER else USER
        self._put(role if edit == "K" else NAMES[self.state], text)


def _signed(rows: DataFrame) -> DataFrame:
    """rows with _ini, the role's first letter, and _sign, but for duplicates."""
    end = F.rtrim("text", F.lit(BLANKS))
    ini = F.substring("role", 1, 1)
    known = ini.isin("s", "u", "a")
    whole = F.right(end, F.lit(1)).isin(".", "!", "?")
    sign = (
        F.when(end == "", "x")
        .when(whole, F.when(known, ini).otherwise("-"))
        .otherwise(F.when(known, F.upper(ini)).otherwise("_"))
    )
    return rows.withColumns({"_ini": ini, "_sign": sign})


_LEGAL = {"su", "ua", "au"}
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string"
)


def _counts(signs: list[str], twice: list[bool], inis: list[str]) -> dict[str, int]:
    late = [d for s, d in zip(signs, twice) if s != "x"]
    return {
        "blank": signs.count("x"),
        "duplicate": sum(late),
        "truncated": sum(s in "SUA_" and not d for s, d in zip(signs, twice)),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(inis, inis[1:])),
    }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _repair_whole(rows: DataFrame) -> DataFrame:
    """Conversations that fit one chunk, each by one agenda."""
    schema = StructType.fromDDL(_RESULT)
    arrow = to_arrow_schema(schema)

    def one(g: dict[str, list]) -> dict:
        place = [i for i, lost in enumerate(g["_lost"]) if not lost]
        roles, texts = [g["role"][i] for i in place], [g["text"][i] for i in place]
        signs, seen, twice = [g["_sign"][i] for i in place], set(), []
        for pair in zip(roles, texts):
            twice.append(pair in seen)
            seen.add(pair)
        turns = {t for i in place if (t := g["turn"][i]) is not None}
        out = {"conv_id": g["conv_id"][0], **_counts(signs, twice, [g["_ini"][i] for i in place])}
        out["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        spelled = "".join(["x" if d else s for s, d in zip(signs, twice)])
        out["cost"], out["audit"] = (_repaired_short if len(spelled) <= 64 else repaired)(spelled)
        lines, at = Lines(), 0
        for edit in out["audit"]:
            if edit == "I":
                lines.insert()
            else:
                lines.row(edit, roles[at], texts[at])
                at += 1
        return out | {"repaired_sha256": lines.sha.hexdigest()}

    def run(batches):
        yield from _batches(map(one, groups(batches, ["_key"])), arrow)

    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartition(parts, "_key").sortWithinPartitions(
        "_key", F.asc_nulls_first("turn"), "role", "text"
    )
    return dealt.mapInArrow(run, schema)


# A summary of neighbouring chunks: its counts, its ends and its lightest items.
_SUMMARY = (
    "_key string, conv_id long, _chunk long, blank long, duplicate long, truncated long, "
    "illegal long, _first string, _last string, _low long, _high long, _turns long, "
    "_p array<int>, _q array<int>, _cost array<long>, _audit array<string>"
)


def _items(n: int, edges) -> dict[str, list]:
    found = [(p, q, *v) for p in STATES for q, v in lightest(n, edges, p).items()]
    return dict(zip(("_p", "_q", "_cost", "_audit"), map(list, zip(*found))))


def _summary(g: dict[str, list]) -> dict:
    """One chunk of rows as a summary."""
    turns = [t for t in g["turn"] if t is not None]
    spelled = "".join(["x" if d else s for s, d in zip(g["_sign"], g["_twice"])])
    return {
        "_key": g["_key"][0], "conv_id": g["conv_id"][0], "_chunk": g["_chunk"][0],
        **_counts(g["_sign"], g["_twice"], g["_ini"]),
        "_first": g["_ini"][0], "_last": g["_ini"][-1],
        "_low": turns[0] if turns else None, "_high": turns[-1] if turns else None,
        "_turns": len(set(turns)), **_items(len(spelled), _row_edges(spelled)),
    }


def _joined(g: dict[str, list]) -> dict:
    """Summaries of neighbouring chunks as one, by the same agenda over their items."""
    n = len(g["_chunk"])
    by: list[dict[int, list[Edge]]] = []
    for p, q, cost, audit in zip(g["_p"], g["_q"], g["_cost"], g["_audit"]):
        by.append({s: [] for s in STATES})
        for a, b, c, edits in zip(p, q, cost, audit):
            by[-1][a].append((c, edits, 1, b))
    seams = zip(g["_last"], g["_first"][1:])
    ends = [t for t in zip(g["_low"], g["_high"]) if t[0] is not None]
    out = {
        "_key": g["_key"][0], "conv_id": g["conv_id"][0], "_chunk": g["_group"][0],
        **{c: sum(g[c]) for c in _COUNTS}, "_first": g["_first"][0], "_last": g["_last"][-1],
        "_low": ends[0][0] if ends else None, "_high": ends[-1][1] if ends else None,
        # Rows stand by turn, so a turn in two chunks ends one and begins the next.
        "_turns": sum(g["_turns"]) - sum(a[1] == b[0] for a, b in zip(ends, ends[1:])),
        **_items(n, lambda i, p: by[i][p] if i < n else ()),
    }
    out["illegal"] += sum(a + b not in _LEGAL for a, b in seams)
    return out


def _map_groups(rows: DataFrame, keys: list[str], order: list, fn, ddl: str) -> DataFrame:
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches):
        yield from _batches(map(fn, groups(batches, keys)), arrow, 8)

    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def pieces(audit: str, size: int) -> list[str]:
    """The audit cut after every `size` edits that take a row; inserts at the end stay last."""
    cuts = [m.end() for m in re.finditer(rf"(?:I*[^I]){{1,{size}}}", audit)]
    cuts[-1] = len(audit)
    return [audit[a:b] for a, b in zip([0, *cuts], cuts)]


def _digests(rows: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """(_key, repaired_sha256) of long conversations: rows stream past their edits."""
    cut = to_arrow_schema(StructType.fromDDL("_key string, _chunk long, _piece string"))

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts = ({"_key": row["_key"], "_chunk": i, "_piece": p}
                         for i, p in enumerate(pieces(row["audit"], size)))
                yield from _batches(parts, cut)

    dealt = ends.select("_key", "audit").mapInArrow(deal, "_key string, _chunk long, _piece string")
    stream = rows.select("_key", "_chunk", "_place", "role", "text").unionByName(
        dealt.withColumn("_place", F.lit(-1).cast("long")), allowMissingColumns=True
    )
    schema = StructType.fromDDL("_key string, repaired_sha256 string")
    arrow = to_arrow_schema(schema)

    def hashed(batches) -> Iterator[dict]:
        key, lines, edits = None, None, iter("")

        def end():
            for _ in edits:  # inserts behind the last row
                lines.insert()
            return {"_key": key, "repaired_sha256": lines.sha.hexdigest()}

        for batch in batches:
            for k, role, text, piece in zip(*(batch[c].to_pylist() for c in ("_key", "role", "text", "_piece"))):
                if k != key:
                    if lines:
                        yield end()
                    key, lines, edits = k, Lines(), iter("")
                if piece is not None:
                    edits = iter(piece)
                    continue
                while (edit := next(edits)) == "I":
                    lines.insert()
                lines.row(edit, role, text)
        if lines:
            yield end()

    parts = shuffle_partitions(rows.sparkSession)
    dealt = stream.repartition(parts, "_key").sortWithinPartitions("_key", "_chunk", "_place")
    return dealt.mapInArrow(lambda batches: _batches(hashed(batches), arrow), schema)


def _repair_long(rows: DataFrame) -> DataFrame:
    """Conversations of any length, by chunks."""
    size = CHUNK_ROWS
    placed = ranked(rows, "_key", F.asc_nulls_first("turn"), "role", "text", name="_rank")
    heads = placed.groupBy("_key").agg(F.min("_rank").alias("_head"))
    placed = placed.join(heads, "_key").withColumn("_place", F.col("_rank") - F.col("_head"))
    placed = placed.withColumn("_chunk", F.floor(F.col("_place") / F.lit(size)))
    pair = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = placed.groupBy("_key", pair.alias("_pair")).agg(F.min("_place").alias("_place"))
    first = first.select("_key", "_place", F.lit(False).alias("_once"))
    facts = placed.select("_key", "conv_id", "_chunk", "_place", "turn", "_ini", "_sign")
    facts = facts.join(first, ["_key", "_place"], "left").withColumn("_twice", F.isnull("_once"))
    done = store(
        _map_groups(facts.drop("_once"), ["_key", "_chunk"], ["_place"], _summary, _SUMMARY),
        most=F.max("_chunk"),
    )
    while done.stats["most"] > 0:
        grouped = done.df.withColumn("_group", F.floor(F.col("_chunk") / F.lit(FAN)))
        step = store(
            _map_groups(grouped, ["_key", "_group"], ["_chunk"], _joined, _SUMMARY),
            most=F.max("_chunk"),
        )
        done.drop()
        done = step
    whole = F.filter(
        F.transform(
            F.arrays_zip("_p", "_q", "_cost", "_audit"),
            lambda x: F.struct(
                x["_cost"].alias("cost"), x["_audit"].alias("audit"), x["_p"].alias("p"), x["_q"].alias("q")
            ),
        ),
        lambda x: (x["p"] == NONE) & x["q"].isin(*GOALS),
    )
    ends = done.df.withColumn("_best", F.array_min(whole)).select(
        "_key", "conv_id",
        F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_turns"), F.lit(0)).alias("gaps"),
        *_COUNTS, "_best.cost", "_best.audit",
    )
    return ends.join(_digests(placed, ends, size), "_key").drop("_key")


def repair(rows: DataFrame, lost: Column | None = None) -> DataFrame:
    """One row per conversation: what is wrong with it, its cheapest repair, its digest.

    rows: conv_id, turn, role, text. Rows where `lost` holds only name their
    conversation. gaps: turns missing between the first and the last. blank, duplicate,
    truncated: rows by their first fault. illegal: neighbours that should not be. cost,
    audit: the edits in order, Keep, Rerole, Delete and Insert by their initials, the
    cheapest and of those the least in ASCII. repaired_sha256: of the lines role:text.
    """
    space = F.lit(" ")
    gone = F.lit(False) if lost is None else lost
    named = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("string"), space).alias("_key"),
        F.col("turn").cast("long").alias("turn"),
        F.when(~gone, F.coalesce("role", space)).alias("role"),
        F.when(~gone, F.coalesce("text", space)).alias("text"),
        gone.alias("_lost"),
    )
    named = _signed(named)
    sizes = named.where(~F.col("_lost")).groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")
    )
    long = store(sizes.where((F.col("n") > CHUNK_ROWS) | (F.col("bytes") > CHUNK_BYTES)).select("_key"))
    if not long.stats["rows"]:
        long.drop()
        return _repair_whole(named)
    short = _repair_whole(named.join(long.df, "_key", "left_anti"))
    rest = named.where(~F.col("_lost")).join(long.df, "_key", "left_semi").drop("_lost")
    return short.unionByName(_repair_long(rest).select(*short.columns))


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with faults by crc32("conv_id:turn") % 20; dropped rows are `lost`.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes its role user; nulls count as one space.
    """
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("_fault"),
    )
    fault = F.col("_fault")
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        (fault == 0).alias("lost"), F.explode(copies).alias("_copy"),
    ).drop("_copy")
