"""Unrolled elevation: the network laid out flat along its legs.

Every station gets X = the sum of plan lengths along a breadth-first tree from the
start, added or taken away according to the direction in force, and keeps its
height: it is reached by as few legs as can be, of several such ways by the leg that
comes first. Levels come from a sweep over nested ranges of stations. Direction rules
at stations and legs are functions of the direction so far; functions compose, so
pointer jumping towards the start evaluates all of them in a number of rounds that is
the logarithm of the depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legnet.operators.graph import HOPS, legs_to_edges, node_ids
from legnet.operators.joins import attach_splays
from legnet.operators.paths import hop_levels
from legnet.plans.skew import lookup
from legnet.plans.store import Stored, store
from legnet.schema import LEG_SPLAY, LEG_SURFACE

LEFT, RIGHT, SWAP, KEEP = -1, 1, 2, 0
_RULES = {"left": LEFT, "right": RIGHT, "swap": SWAP}


@dataclass
class Elevation:
    stations: DataFrame  # name, x, z, copy (a second place of a station where a loop is cut)
    legs: DataFrame  # from_stn, to_stn, x1, z1, x2, z2
    splays: DataFrame  # station, x1, z1, x2, y2, z2
    breaks: DataFrame  # name, x1, x2, z: lines between the places of one station


def _turn(rule: Column, direction: Column) -> Column:
    return F.when(rule == SWAP, -direction).when(rule == KEEP, direction).otherwise(rule)


def _station_rules(rules: DataFrame, kinds) -> DataFrame:
    pairs = [F.lit(v) for kv in kinds.items() for v in kv]
    return rules.where(F.col("b").isNull() & F.col("kind").isin(*kinds)).groupBy("a").agg(
        F.max(F.create_map(*pairs)[F.col("kind")]).alias("rule")
    )


def _path_directions(steps: DataFrame, root: int) -> Stored:
    """(node, direction, x) at each node, from (node, parent, r1, r2, run).

    r1 is the rule on leaving the parent, r2 the rule of the leg, run the plan
    length. State: for each direction at the far end, the direction here and the
    distance run (suffix l or r).
    """
    state = {}
    for tag, d in (("l", LEFT), ("r", RIGHT)):
        out = _turn(F.col("r2"), _turn(F.col("r1"), F.lit(d)))
        state[f"g{tag}"] = out.cast("int")
        state[f"x{tag}"] = out * F.col("run")
    now = store(
        steps.select(
            "node",
            F.when(F.col("parent") != F.lit(root), F.col("parent")).alias("next"),
            *[c.alias(n) for n, c in state.items()],
        ),
        open=F.count("next"),
    )
    while now.stats["open"]:
        ahead = now.df.select(
            F.col("node").alias("next"), F.col("next").alias("next2"),
            *[F.col(c).alias(f"{c}2") for c in ("gl", "gr", "xl", "xr")],
        )
        hop = now.df.where(F.col("next").isNotNull())
        for _ in range(HOPS):
            new = []
            for tag in "lr":
                through, found = F.col(f"g{tag}2"), F.col("gl2").isNotNull()
                g = F.when(through == LEFT, F.col("gl")).otherwise(F.col("gr"))
                x = F.when(through == LEFT, F.col("xl")).otherwise(F.col("xr")) + F.col(f"x{tag}2")
                new.append(F.when(found, g).otherwise(F.col(f"g{tag}")).alias(f"g{tag}"))
                new.append(F.when(found, x).otherwise(F.col(f"x{tag}")).alias(f"x{tag}"))
            hop = lookup(hop, "next", ahead, now.stats["open"], "left").select(
                "node", F.col("next2").alias("next"), *new
            )
        step = store(
            hop.unionByName(now.df.where(F.col("next").isNull())), open=F.count("next")
        )
        now.drop()
        now = step
    # The start faces right.
    return Stored(
        now.df.select("node", F.col("gr").alias("direction"), F.col("xr").alias("x")),
        now.path, now.stats,
    )


def extend_elevation(
    legs: DataFrame, stations: DataFrame, start: str, rules: DataFrame | None = None,
    show_breaks=False,
) -> Elevation:
    """The start's component unrolled; other components are left out.

    legs: from_stn, to_stn, flags and maybe seq, their order; stations: name, x, y, z;
    rules: (kind, a, b) with kind left, right, swap or break, at station a or, with b,
    at the leg a-b (a leg is broken at its end a). A station with a break is an end for
    each of its legs. A leg outside the tree closes a loop: it is drawn from the end
    nearer to the start (as measured, where both are as near) to a copy of the other.
    """
    spark = legs.sparkSession
    if rules is None:
        rules = spark.createDataFrame([], "kind string, a string, b string")
    # The inputs may be long plans and are needed several times.
    rules, legs = store(rules.select("kind", "a", "b")).df, store(legs).df
    flags = F.col("flags")
    shown = legs.where(flags.bitwiseAND(F.lit(LEG_SURFACE)) == 0)
    order = F.col("seq").cast("long") if "seq" in legs.columns else F.lit(0).cast("long")
    solid = shown.where(flags.bitwiseAND(F.lit(LEG_SPLAY)) == 0).select(
        "from_stn", "to_stn", order.alias("seq"), F.monotonically_increasing_id().alias("near")
    )
    at = store(stations.select("name", "x", "y", "z")).df
    ids = node_ids(at.select("name"))
    edges = legs_to_edges(solid, ids.df)

    # Rules of legs, in either order of the two names.
    both = rules.where(F.col("b").isNotNull())
    turned = both.select("kind", F.col("b").alias("from_stn"), F.col("a").alias("to_stn"), F.lit(False).alias("at_from"))
    listed = both.select("kind", F.col("a").alias("from_stn"), F.col("b").alias("to_stn"), F.lit(True).alias("at_from"))
    pairs = [F.lit(v) for kv in _RULES.items() for v in kv]
    on_legs = listed.unionByName(turned).groupBy("from_stn", "to_stn").agg(
        F.max(F.create_map(*pairs)[F.col("kind")]).alias("r2"),
        F.bool_or((F.col("kind") == "break") & F.col("at_from")).alias("cut_u"),
        F.bool_or((F.col("kind") == "break") & ~F.col("at_from")).alias("cut_v"),
    )
    edges = edges.join(on_legs, ["from_stn", "to_stn"], "left")
    broken = rules.where((F.col("kind") == "break") & F.col("b").isNull() & (F.col("a") != start))
    for side, name in (("u", "from_stn"), ("v", "to_stn")):
        mark = broken.select(F.col("a").alias(name), F.lit(True).alias(f"broken_{side}")).distinct()
        edges = lookup(edges, name, mark, how="left")
    table = store(edges.withColumn("eid", F.monotonically_increasing_id()))
    # A cut end becomes a node of its own: negative ids below the real ones.
    cut = {s: F.coalesce(F.col(f"cut_{s}"), F.lit(False)) | F.col(f"broken_{s}").isNotNull() for s in "uv"}
    graph = store(
        table.df.select(
            "eid", "seq", "near", "from_stn", "to_stn", F.coalesce("r2", F.lit(KEEP)).alias("r2"),
            F.col("u").alias("real_u"), F.col("v").alias("real_v"),
            F.when(cut["u"], -F.col("eid") * 2 - 2).otherwise(F.col("u")).alias("u"),
            F.when(cut["v"], -F.col("eid") * 2 - 3).otherwise(F.col("v")).alias("v"),
        )
    )
    table.drop()
    known = ids.df.where(F.col("name") == start).select("id").collect()
    if not known:
        raise ValueError(f"no station {start}")
    root = known[0].id
    place = ids.df.join(at, "name").select(F.col("id").alias("real"), "name", "x", "y", "z")

    def with_places(df: DataFrame) -> DataFrame:
        for side in ("src", "dst"):
            key = place.select(
                F.col("real").alias(f"{side}_real"), F.col("name").alias(f"{side}_name"),
                *[F.col(a).alias(f"{side}_{a}") for a in "xyz"],
            )
            df = lookup(df, f"{side}_real", key)
        return df

    turns = _station_rules(rules, _RULES).select(F.col("a").alias("src_name"), F.col("rule").alias("r1"))
    detail = graph.df.select("eid", "seq", F.col("u").alias("eu"), "real_u", "real_v", "r2")

    def described(arcs: DataFrame) -> DataFrame:
        """Arcs (eid, src, dst) with names, places, rules and plan length."""
        df = arcs.join(detail, "eid")
        ahead = F.col("src") == F.col("eu")
        df = df.withColumns(
            {
                "src_real": F.when(ahead, F.col("real_u")).otherwise(F.col("real_v")),
                "dst_real": F.when(ahead, F.col("real_v")).otherwise(F.col("real_u")),
            }
        )
        df = lookup(with_places(df), "src_name", turns, how="left")
        gap = [F.col(f"dst_{a}") - F.col(f"src_{a}") for a in "xy"]
        return df.withColumns(
            {"r1": F.coalesce("r1", F.lit(KEEP)), "run": F.hypot(*gap)}
        )

    ends = [graph.df.select(F.col(c).alias("node"), F.col(f"real_{c}").alias("real")) for c in "uv"]
    start_row = ids.df.where(F.col("name") == start).select(F.col("id").alias("node"), F.col("id").alias("real"))
    nodes = ends[0].unionByName(ends[1]).unionByName(start_row).distinct()
    levels = hop_levels(graph.df.select("u", "v", "near"), lookup(nodes, "real", place), root, "near")
    reached = graph.df.select("eid", "seq", "u", "v")
    for side in "uv":
        reached = lookup(reached, side, levels.select(F.col("node").alias(side), F.col("level").alias(f"level_{side}")))
    reached = store(reached)
    up, down = F.col("level_u"), F.col("level_v")
    ahead = up <= down
    arcs = reached.df.select(
        "eid", "seq", F.when(ahead, F.col("u")).otherwise(F.col("v")).alias("src"),
        F.when(ahead, F.col("v")).otherwise(F.col("u")).alias("dst"), (up != down).alias("steps"),
    )
    first = arcs.where("steps").groupBy("dst").agg(F.min_by(F.struct("eid", "src"), F.struct("seq", "eid")).alias("e"))
    first = store(first.select("e.eid", "e.src", "dst"))
    tree = store(described(first.df))
    steps = tree.df.select(F.col("dst").alias("node"), F.col("src").alias("parent"), "r1", "r2", "run")
    found = _path_directions(steps, root)
    origin = spark.range(1).select(
        F.lit(root).alias("node"), F.lit(RIGHT).alias("direction"), F.lit(0.0).alias("x")
    )
    state = store(found.df.unionByName(origin))
    here = state.df.select(F.col("node").alias("src"), F.col("direction").alias("d0"), F.col("x").alias("x1"))
    drawn = lookup(tree.df, "src", here, tree.stats["rows"])

    # Legs left out of the tree run from their nearer end to a copy of the other.
    extra = arcs.join(first.df.select("eid"), "eid", "left_anti").select("eid", "src", "dst")
    loose = lookup(described(extra), "src", here, reached.stats["rows"])
    every = drawn.withColumn("copy", F.lit(False)).unionByName(
        loose.withColumn("copy", F.lit(True)), allowMissingColumns=True
    )
    heading = _turn(F.col("r2"), _turn(F.col("r1"), F.col("d0")))
    every = store(every.withColumns({"heading": heading, "x2": F.col("x1") + heading * F.col("run")}))

    own = at.where(F.col("name") == start).select(
        "name", F.lit(0.0).alias("x"), "z", F.lit(False).alias("copy")
    )
    cut_off = F.col("copy") | (F.col("dst") < 0)
    places = own.unionByName(
        every.df.select(
            F.col("dst_name").alias("name"), F.col("x2").alias("x"), F.col("dst_z").alias("z"),
            cut_off.alias("copy"),
        )
    )
    out_legs = every.df.select(
        F.col("src_name").alias("from_stn"), F.col("dst_name").alias("to_stn"), "x1",
        F.col("src_z").alias("z1"), "x2", F.col("dst_z").alias("z2"),
    )
    first = places.where(~F.col("copy")).groupBy("name").agg(F.min("x").alias("x1"))
    breaks = places.where("copy").join(first, "name").where(F.col("x") != F.col("x1")).select(
        "name", "x1", F.col("x").alias("x2"), "z"
    )
    if not show_breaks:
        breaks = breaks.limit(0)
    return Elevation(places, out_legs, _splays(shown, at, every.df, start), breaks)


def _splays(legs: DataFrame, at: DataFrame, drawn: DataFrame, start: str) -> DataFrame:
    """Splays turned into the plane of the passage at their station."""
    hung = attach_splays(legs).where(F.col("problem").isNull()).select("station", "free_end")
    vec = {f"v{a}": F.col(f"dst_{a}") - F.col(f"src_{a}") for a in "xy"}
    arcs = drawn.where(~F.col("copy")).withColumns(vec)
    arrive = arcs.where(F.col("dst") >= 0).select(
        F.col("dst_name").alias("station"), F.col("x2").alias("x1"), F.col("dst_z").alias("z1"),
        F.col("vx").alias("ix"), F.col("vy").alias("iy"), F.col("heading").alias("arriving"),
        *[F.col(f"dst_{a}").alias(f"s{a}") for a in "xyz"],
    )
    zero = F.lit(0.0)
    begin = at.where(F.col("name") == start).select(
        F.col("name").alias("station"), zero.alias("x1"), F.col("z").alias("z1"), zero.alias("ix"),
        zero.alias("iy"), F.lit(RIGHT).alias("arriving"),
        F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"),
    )
    leave = arcs.groupBy(F.col("src_name").alias("station")).agg(
        F.min_by(F.struct("vx", "vy", "heading"), F.struct("seq", "eid")).alias("o")
    )
    frame = arrive.unionByName(begin).join(leave, "station", "left").select(
        "station", "x1", "z1", "sx", "sy", "sz",
        (F.col("ix") + F.coalesce("o.vx", zero)).alias("tx"),
        (F.col("iy") + F.coalesce("o.vy", zero)).alias("ty"),
        F.coalesce("o.heading", "arriving").alias("heading"),
    ).where((F.col("tx") != 0) | (F.col("ty") != 0))
    quarter = F.lit(1.5707963267948966)
    bearing = F.atan2("tx", "ty")
    angle = F.when(F.col("heading") == LEFT, -quarter).otherwise(quarter) - bearing
    ends = at.select(F.col("name").alias("free_end"), *[F.col(a).alias(f"f{a}") for a in "xyz"])
    df = lookup(lookup(hung, "station", frame), "free_end", ends).withColumn("_a", angle)
    dx, dy = F.col("fx") - F.col("sx"), F.col("fy") - F.col("sy")
    c, s = F.cos("_a"), F.sin("_a")
    return df.select(
        "station", "free_end", "x1", "z1",
        (F.col("x1") + dx * c + dy * s).alias("x2"),
        (dy * c - dx * s).alias("y2"),
        (F.col("z1") + F.col("fz") - F.col("sz")).alias("z2"),
    )
