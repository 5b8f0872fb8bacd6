"""Mixing sources to target weights, in DataFrame functions only.

Tokens are summed per cell of (source, language, topic). Iterative proportional
fitting rakes a rate onto every cell until the weighted tokens of each source, language
and topic meet their targets; documents are then sampled, each with a probability in
proportion to its cell's rate, up to 1, such that a share `keep` of all tokens is expected.
A cell whose rate asks for more than all its documents keeps them all and reports the rest
as `shortfall`, so a rare cell does not decide how much of the others is kept. Without
`keep` the largest rate gets probability 1: the largest sample with exact proportions.

Targets are shares of a marginal, by default its own shares raised to a power below 1
(`temper`): small sources gain, the largest one gives.

Defined results: missing source, language or topic is the value ''; a missing or empty
text has no tokens and is sampled like its cell; a value without tokens keeps rate 1;
repeated rows of one id are drawn together; an empty table gives no rows; other columns
are ignored (`weights`) or kept (`sample`). Targets that no rates can meet leave a `gap`
above 0 (the largest relative distance of a marginal from its target). Default targets
contradict each other where a source has one language, say; if the sweeps leave them
unmet, rates come from one tempered joint table instead, `gap` is their distance from the
separate targets, and a warning tells it. Given targets that stay unmet raise an error.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legnet.llm.quality import words_of
from legnet.llm.streams import without_ids
from legnet.plans.skew import lookup
from legnet.plans.store import cut, store

DIMS = ("source", "lang", "topic")
TEMPER = {"source": 0.7, "lang": 0.85, "topic": 0.95}
SWEEPS, TOLERANCE = 40, 1e-12
#: Sweeps over a small table of cells that are one plan.
SWEEPS_A_TABLE = 5
#: Targets count as met up to this gap.
MET = 1e-6
#: Share of all tokens that a sample is expected to have.
KEEP = 0.7
#: A table of cells up to this many rows is raked in one task and sent to every task; a
#: larger one is summed and joined.
BROADCAST_ROWS = 100_000
#: Probabilities are compared with this many bits of a hash.
BITS = 52


def topic_of(text: Column, n_tokens: Column) -> Column:
    """Topic by form, for tables without a topic: licence, table, credentials, else by length."""
    return (
        F.when(F.contains(text, F.lit("License")), "licence")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("token = ")), "credentials")
        .when(n_tokens < 100, "note")
        .when(n_tokens < 600, "article")
        .otherwise("long")
    )


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") / float(1 << BITS)


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): shares of the marginal's tokens to a power."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
    raised = sums.select(dim, F.pow("t", F.lit(float(power))).alias("raised"))
    whole = raised.agg(F.sum("raised").alias("whole"))
    return raised.crossJoin(whole).select(dim, (F.col("raised") / F.col("whole")).alias("target"))


def rake(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    sweeps: int = SWEEPS,
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, float, int]:
    """(cells with `rate`, gap, number of cells).

    cells: the dimensions and `tokens`; targets: per dimension its values and `target`
    shares. Each sweep scales every dimension to its targets. Up to BROADCAST_ROWS cells are
    one partition and take SWEEPS_A_TABLE sweeps a written table, without a shuffle; more
    cells are summed and joined, one sweep a table.
    """
    # Sums of shares, so that targets and weights have the same total.
    whole = cells.agg(F.sum("tokens").alias("whole"))
    start = cells.crossJoin(whole).select(
        *DIMS, (F.col("tokens") / F.col("whole")).alias("share"), F.lit(1.0).alias("rate")
    )
    for dim, goal in targets.items():
        start = start.join(goal.select(dim, F.col("target").alias(f"_t_{dim}")), dim, "left")
    state = store(start)
    n, gap, done = state.stats["rows"], 0.0, 0
    few = n <= BROADCAST_ROWS
    while n and done < sweeps:
        now = state.df.coalesce(1) if few else state.df
        turns = min(SWEEPS_A_TABLE, sweeps - done) if few else 1
        for _ in range(turns):
            now = swept(now, list(targets), few)
        new = store(now, off=F.max("off"))
        state.drop()
        state, gap, done = new, new.stats["off"], done + turns
        if gap < tolerance:
            break
    return state.df.select(*DIMS, "share", "rate"), gap, n


def swept(now: DataFrame, dims: list[str], few: bool) -> DataFrame:
    """Every dimension scaled to its targets once; `off` is how far one was from them."""
    off = F.lit(0.0)
    kept = [c for c in now.columns if c not in ("rate", "off")]
    now = now.select(*kept, "rate")
    for dim in dims:
        mass = F.sum(F.col("share") * F.col("rate"))
        if few:  # the cells are one partition, which windows read without a shuffle
            now = now.withColumn("_mass", mass.over(Window.partitionBy(dim)))
        else:  # hashed on the executors: a broadcast a sweep would pile up on the driver
            sums = now.groupBy(dim).agg(mass.alias("_mass"))
            now = now.join(sums.hint("shuffle_hash"), dim, "left")
        met = (F.col("_mass") > 0) & F.col(f"_t_{dim}").isNotNull()
        now = now.withColumn(f"_f_{dim}", F.when(met, F.col(f"_t_{dim}") / F.col("_mass")).otherwise(F.lit(1.0)))
        now = now.withColumn("rate", F.col("rate") * F.col(f"_f_{dim}")).drop("_mass")
        off = F.greatest(off, F.abs(F.col(f"_f_{dim}") - 1))
    return now.select(*kept, "rate", off.alias("off"))


def tempered_jointly(
    raked: DataFrame, targets: dict[str, DataFrame], powers: dict[str, float]
) -> tuple[DataFrame, float]:
    """(cells with `rate`, gap to the targets) of a joint table tempered cell by cell.

    A cell's share is multiplied by its marginals' shares to their powers less 1, so the
    new marginals belong to one table and can be met together.
    """
    now = raked.select(*DIMS, "share").withColumn("_f", F.lit(1.0))
    for dim in DIMS:
        sums = raked.groupBy(dim).agg(F.sum("share").alias("_s"))
        factor = F.when(F.col("_s") > 0, F.pow("_s", F.lit(float(powers[dim] - 1)))).otherwise(F.lit(1.0))
        now = now.join(sums.hint("shuffle_hash"), dim, "left").withColumn("_f", F.col("_f") * factor).drop("_s")
    now = cut(now)
    whole = now.agg(F.sum(F.col("share") * F.col("_f"))).first()[0]
    rate = F.when(F.col("share") > 0, F.col("_f") / F.lit(whole)).otherwise(F.lit(1.0))
    rates, gap = now.select(*DIMS, "share", rate.alias("rate")), 0.0
    for dim, goal in targets.items():
        mass = rates.groupBy(dim).agg(F.sum(F.col("share") * F.col("rate")).alias("_mass")).where("_mass > 0")
        off = mass.join(goal, dim).agg(F.max(F.abs(F.col("target") / F.col("_mass") - 1))).first()[0]
        gap = max(gap, off or 0.0)
    return rates, gap


def scale_for(raked: DataFrame, budget: float) -> float:
    """The c for which the sum of share * min(1, c * rate) is the budget (a share).

    The sum is concave in c, so each round comes nearer from below, and the last one is
    exact; a round is one aggregate, and only one that fills more cells has a next.
    """
    if budget >= 1:
        least = raked.where((F.col("share") > 0) & (F.col("rate") > 0)).agg(F.min("rate")).first()[0]
        return 1 / least if least else 1.0
    c, filled = budget, -1
    while True:
        full = F.col("rate") * F.lit(c) >= 1
        now = raked.where("share > 0").agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("share"))), F.lit(0.0)).alias("full"),
            F.sum(F.when(~full, F.col("share") * F.col("rate"))).alias("rest"),
        ).first()
        if now["n"] == filled or not now["rest"]:
            return c
        c, filled = max(c, (budget - now["full"]) / now["rest"]), now["n"]


def measured(docs: DataFrame, id_col: str, text: str, topic: str | None) -> DataFrame:
    """id, source, lang, topic and n_tokens of every document, as a written table."""
    n = F.size(words_of(F.coalesce(docs[text], F.lit("")))).cast("long")
    rows = docs.select(
        docs[id_col].alias("id"),
        F.coalesce(docs["source"], F.lit("")).alias("source"),
        F.coalesce(docs["lang"], F.lit("")).alias("lang"),
        (F.coalesce(docs[topic], F.lit("")) if topic else F.lit(None).cast("string")).alias("topic"),
        docs[text].alias("body"),
        n.alias("n_tokens"),
    )
    if not topic:
        rows = rows.withColumn("topic", topic_of(F.col("body"), F.col("n_tokens")))
    return cut(rows.drop("body"))


def weights(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    topic: str | None = None,
    temper: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    fraction: float = 1.0,
    seed: int = 7,
    keep: float | None = KEEP,
    joint: bool = True,
) -> DataFrame:
    """id, source, lang, topic, n_tokens, rate, probability, shortfall, sampled and gap.

    `keep` is the share of all tokens to expect; None takes the largest exact sample.
    `fraction` scales either down. `shortfall` is the part of its due tokens that a cell
    lacks. Without a topic column topics are taken from the text's form. Without `joint`
    unmet default targets keep the rates of the last sweep, with a warning.
    """
    rows = measured(docs, id_col, text, topic)
    cells = cut(cells_of(rows))
    powers = TEMPER | (temper or {})
    goals = {d: (targets or {}).get(d) for d in DIMS}
    goals = {d: tempered(cells, d, powers[d]) if g is None else g for d, g in goals.items()}
    raked, gap, n_cells = rake(cells, goals, SWEEPS)
    if gap > MET:
        unmet = f"mixture targets cannot be met together: after {SWEEPS} sweeps a marginal is off by {gap:.3g}"
        if targets:
            raise ValueError(unmet)
        if joint:
            raked, gap = tempered_jointly(raked, goals, powers)
            unmet += f"; rates are of the joint table, {gap:.3g} from the separate targets"
        warnings.warn(unmet, stacklevel=2)
    if keep is None:
        top = raked.agg(F.max(F.when(F.col("share") > 0, F.col("rate"))).alias("top"))
        due = fraction * F.col("rate") / F.coalesce("top", F.lit(1.0))
        scaled = raked.crossJoin(top)
    else:
        due = F.lit(scale_for(raked, fraction * keep)) * F.col("rate")
        scaled = raked
    rates = scaled.withColumn("due", due).select(
        *DIMS,
        "rate",
        F.least(F.lit(1.0), "due").alias("probability"),
        F.when(F.col("due") > 1, 1 - 1 / F.col("due")).otherwise(F.lit(0.0)).alias("shortfall"),
    )
    if n_cells <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(rates), list(DIMS), "left")
    else:  # a cell may hold a third of the documents: heavy ones are salted
        def cell() -> Column:
            return F.struct(*DIMS)

        joined = lookup(
            rows.withColumn("_cell", cell()),
            "_cell",
            rates.select(cell().alias("_cell"), "rate", "probability", "shortfall"),
            rows=rows.count(),
            how="left",
            floor=0,
        ).drop("_cell")
    return joined.select(
        F.col("id").alias(id_col),
        *DIMS,
        "n_tokens",
        "rate",
        "probability",
        "shortfall",
        (draw(F.col("id"), seed) < F.col("probability")).alias("sampled"),
        F.lit(float(gap)).alias("gap"),
    )


def sample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents drawn, with all columns; rows without an id stay."""
    drawn = weights(docs, id_col, text, **options).groupBy(id_col).agg(F.max("sampled").alias("sampled"))
    return without_ids(docs, id_col, drawn.where(~F.col("sampled")).select(id_col))


def sql(source: str = "documents", sweeps: int = SWEEPS, seed: int = 7) -> str:
    """CTEs up to `mixed`: the same weights as DuckDB SQL, all sweeps run.

    The scale is the greatest (budget - full tokens) / (rate of the rest) over the cells
    filled in order of their rates, as the sum it solves is concave.
    """
    steps = [
        f"""
rows_ AS MATERIALIZED (
  SELECT doc_id, source, lang, n_tokens,
    CASE WHEN contains(text, 'License') THEN 'licence' WHEN contains(text, ' | ') THEN 'table'
      WHEN contains(text, 'token = ') THEN 'credentials' WHEN n_tokens < 100 THEN 'note'
      WHEN n_tokens < 600 THEN 'article' ELSE 'long' END AS topic
  FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {source})),
cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows_ GROUP BY ALL),
s0 AS MATERIALIZED (
  SELECT source, lang, topic, tokens / (SELECT sum(tokens) FROM cells) AS share, 1e0 AS rate FROM cells)"""
    ]
    for d in DIMS:
        steps.append(f"""
goal_{d} AS MATERIALIZED (
  SELECT {d}, r / sum(r) OVER () AS target FROM (
    SELECT {d}, pow(sum(tokens), {TEMPER[d]}) AS r FROM cells GROUP BY {d} HAVING sum(tokens) > 0))""")
    last = "s0"
    for i in range(sweeps):
        for d in DIMS:
            name = f"s{i}_{d}"
            steps.append(f"""
{name} AS MATERIALIZED (
  SELECT c.* REPLACE (rate * coalesce(target / mass, 1) AS rate) FROM {last} c
  LEFT JOIN (SELECT {d}, sum(share * rate) AS mass FROM {last} GROUP BY {d} HAVING sum(share * rate) > 0) m
    ON m.{d} = c.{d} LEFT JOIN goal_{d} g ON g.{d} = m.{d})""")
            last = name
    # How far the last sweep moved a marginal: of every dimension the masses before its turn.
    before = [f"s{sweeps - 2}_{DIMS[-1]}" if sweeps > 1 else "s0", *[f"s{sweeps - 1}_{d}" for d in DIMS[:-1]]]
    offs = " UNION ALL ".join(
        f"SELECT max(abs(target / mass - 1)) AS off FROM (SELECT {d}, sum(share * rate) AS mass FROM {name} "
        f"GROUP BY {d} HAVING sum(share * rate) > 0) JOIN goal_{d} USING ({d})"
        for d, name in zip(DIMS, before)
    )
    sums = ", ".join(f"sum(share) OVER (PARTITION BY {d}) AS t_{d}" for d in DIMS)
    raised = " * ".join(f"pow(t_{d}, {TEMPER[d] - 1})" for d in DIMS)
    far = " UNION ALL ".join(
        f"SELECT max(abs(target / mass - 1)) AS off FROM (SELECT {d}, sum(share * rate) AS mass FROM joint "
        f"GROUP BY {d} HAVING sum(share * rate) > 0) JOIN goal_{d} USING ({d})"
        for d in DIMS
    )
    steps.append(f"""
unmet AS MATERIALIZED (SELECT coalesce(max(off), 0) AS off FROM ({offs})),
joint AS MATERIALIZED (
  SELECT source, lang, topic, share, CASE WHEN share > 0 THEN f / sum(share * f) OVER () ELSE 1 END AS rate
  FROM (SELECT *, CASE WHEN share > 0 THEN {raised} ELSE 1 END AS f FROM (SELECT *, {sums} FROM s0))),
raked AS MATERIALIZED (
  SELECT source, lang, topic, share, rate, off AS gap FROM {last}, unmet WHERE off <= {MET}
  UNION ALL SELECT source, lang, topic, share, rate, (SELECT max(off) FROM ({far})) FROM joint, unmet WHERE off > {MET}),
scale AS MATERIALIZED (
  SELECT max(({KEEP} - filled) / rest) AS c FROM (
    SELECT coalesce(sum(share) OVER before, 0) AS filled,
      sum(share * rate) OVER (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM raked WHERE share > 0
    WINDOW before AS (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
mixed AS MATERIALIZED (
  SELECT doc_id, source, lang, topic, n_tokens, rate, least(1e0, c * rate) AS probability,
    CASE WHEN c * rate > 1 THEN 1 - 1 / (c * rate) ELSE 0 END AS shortfall,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT
      / {float(1 << BITS)} < least(1e0, c * rate) AS sampled, gap
  FROM rows_ JOIN raked USING (source, lang, topic), scale)""")
    return ",".join(steps)
