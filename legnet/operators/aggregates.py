"""Totals, ranges, counts and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legnet.functions import bands as B
from legnet.functions.names import ancestors, depth_of, survey_of
from legnet.functions.vec import AXES, PARTS, cov, norm, sinv, smul_vec, vec, vscale
from legnet.operators.joins import degrees_of
from legnet.plans.scan import CHUNK, segment
from legnet.schema import LEG_EXCLUDED_FROM_TOTALS, LEG_SURFACE, STN_ANON, STN_ENTRANCE
from legnet.schema import LEG_DUPLICATE, LEG_SPLAY, STN_EXPORTED, STN_FIXED, STN_UNDERGROUND


def _means(aliased=True):
    d = vec(*[F.avg(f"d.{a}") for a in AXES])
    v = cov(*[F.avg(f"v.{p}") for p in PARTS])
    return d, v


def average_repeats(
    legs: DataFrame, keys: list[str], seq="seq", chunk: int = CHUNK
) -> DataFrame:
    """Consecutive legs with the same ends in the same order become their mean.

    Both the displacement and the covariance are averaged; the repeats count as
    one leg. Keeps the sequence number of the first repeat.
    """
    runs = segment(legs, keys, seq, ["from_stn", "to_stn"], "_run", chunk)
    d, v = _means()
    return (
        runs.groupBy(*keys, "_run", "from_stn", "to_stn")
        .agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias("n"), d.alias("d"), v.alias("v"))
        .drop("_run")
    )


def combine_parallel(legs: DataFrame) -> DataFrame:
    """One leg per station pair: the inverse-covariance weighted combination.

    Legs are turned to run from the lesser name. An exact leg (singular
    covariance) replaces all others of its pair. Only sums are shuffled, so a
    pair with any number of legs reduces map-side.
    """
    turned = F.col("from_stn") > F.col("to_stn")
    sign = F.when(turned, -1.0).otherwise(1.0)
    one = legs.select(
        F.least("from_stn", "to_stn").alias("from_stn"),
        F.greatest("from_stn", "to_stn").alias("to_stn"),
        vscale(F.col("d"), sign).alias("d"),
        F.col("v"),
        sinv(F.col("v")).alias("w"),
    ).withColumn("wd", smul_vec(F.col("w"), F.col("d")))
    exact = F.col("w").isNull()
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(f"w.{p}").alias(f"w_{p}") for p in PARTS]
    aggs += [F.sum(f"wd.{a}").alias(f"wd_{a}") for a in AXES]
    # Means over the exact legs of a pair, if it has any.
    aggs += [F.avg(F.when(exact, F.col(f"d.{a}"))).alias(f"e_{a}") for a in AXES]
    aggs += [F.avg(F.when(exact, F.col(f"v.{p}"))).alias(f"ev_{p}") for p in PARTS]
    sums = one.groupBy("from_stn", "to_stn").agg(*aggs)
    combined = sums.withColumn("v", sinv(cov(*[F.col(f"w_{p}") for p in PARTS])))
    d = smul_vec(F.col("v"), vec(*[F.col(f"wd_{a}") for a in AXES]))
    fixed = F.col("e_x").isNotNull()
    return combined.select(
        "from_stn",
        "to_stn",
        "n",
        F.when(fixed, vec(*[F.col(f"e_{a}") for a in AXES])).otherwise(d).alias("d"),
        F.when(fixed, cov(*[F.col(f"ev_{p}") for p in PARTS])).otherwise(F.col("v")).alias("v"),
    )


def counted(flags: Column) -> Column:
    """Legs that count in totals: not surface, duplicate or splay."""
    return F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(LEG_EXCLUDED_FROM_TOTALS)) == 0


def survey_totals(legs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Length, plan length and vertical length; adjusted length with positions."""
    keep = legs.where(counted(F.col("flags")))
    if "fake" in legs.columns:
        keep = keep.where(~F.col("fake"))
    d = F.col("d")
    aggs = [
        F.count(F.lit(1)).alias("legs"),
        F.sum(norm(d)).alias("length"),
        F.sum(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])).alias("plan_length"),
        F.sum(F.abs(d["z"])).alias("vertical_length"),
    ]
    if "from_pos" in legs.columns:
        f, t = F.col("from_pos"), F.col("to_pos")
        gap = vec(*[t[a] - f[a] for a in AXES])
        aggs.insert(2, F.sum(norm(gap)).alias("adjusted_length"))
    return keep.groupBy(*by).agg(*aggs) if by else keep.agg(*aggs)


def ranges(stations: DataFrame, variant="underground") -> DataFrame:
    """Least and greatest value per axis with the station's name.

    variant: 'underground', 'named' (underground without anonymous) or 'all'. Of
    several stations at the limit the first by name is given.
    """
    s = stations
    if variant != "all":
        s = s.where(F.col("sflags").bitwiseAND(F.lit(STN_UNDERGROUND)) != 0)
    if variant == "named":
        s = s.where(F.col("sflags").bitwiseAND(F.lit(STN_ANON)) == 0)
    aggs = []
    for a in AXES:
        aggs.append(F.min(F.struct(F.col(a).alias("v"), F.col("name").alias("n"))).alias(f"lo_{a}"))
        aggs.append(
            F.min(F.struct((-F.col(a)).alias("v"), F.col("name").alias("n"))).alias(f"hi_{a}")
        )
    one = s.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("axis"),
                F.col(f"lo_{a}.v").alias("low"),
                F.col(f"lo_{a}.n").alias("low_station"),
                (-F.col(f"hi_{a}.v")).alias("high"),
                F.col(f"hi_{a}.n").alias("high_station"),
            )
            for a in AXES
        ]
    )
    return one.select(F.inline(rows)).withColumn("extent", F.col("high") - F.col("low"))


def network_counts(stations: DataFrame, legs: DataFrame) -> DataFrame:
    """Stations, legs (equates count, anchor legs do not), components and loops.

    `stations` has (name, component).
    """
    s = stations.agg(
        F.count(F.lit(1)).alias("stations"), F.count_distinct("component").alias("components")
    )
    real = legs.where(~F.col("fake")) if "fake" in legs.columns else legs
    n = real.agg(F.count(F.lit(1)).alias("legs"))
    return s.crossJoin(F.broadcast(n)).withColumn(
        "loops", F.col("components") + F.col("legs") - F.col("stations")
    )


def node_degree_histogram(legs: DataFrame) -> DataFrame:
    return degrees_of(legs).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def rollup_by_survey(
    stations: DataFrame, legs: DataFrame, sep=".", levels: int | None = None
) -> DataFrame:
    """Station and leg totals of every survey at every level ('' is everything)."""

    def up(name: Column) -> Column:
        paths = F.concat(F.array(F.lit("")), name)
        return F.slice(paths, 1, levels + 1) if levels is not None else paths

    s = stations.select(F.explode(up(ancestors(F.col("name"), sep))).alias("survey")).groupBy(
        "survey"
    ).agg(F.count(F.lit(1)).alias("stations"))
    survey = survey_of(F.col("from_stn"), sep)
    own = F.when(survey == "", F.array().cast("array<string>")).otherwise(
        F.concat(ancestors(survey, sep), F.array(survey))
    )
    n = legs.select(F.explode(up(own)).alias("survey"), norm(F.col("d")).alias("len")).groupBy(
        "survey"
    ).agg(F.count(F.lit(1)).alias("legs"), F.sum("len").alias("length"))
    return s.join(n, "survey", "full").select(
        "survey",
        F.coalesce("stations", F.lit(0)).alias("stations"),
        F.coalesce("legs", F.lit(0)).alias("legs"),
        F.coalesce("length", F.lit(0.0)).alias("length"),
    )


def model_summary(legs: DataFrame, stations: DataFrame) -> DataFrame:
    """One row: bounds, depth and date ranges, flags present, station classes.

    legs: from_pos, to_pos, flags, days1, days2 (NULL when undated).
    """
    flags = F.col("flags")
    f, t = F.col("from_pos"), F.col("to_pos")
    surface = flags.bitwiseAND(F.lit(LEG_SURFACE)) != 0
    mid = F.col("days1") + ((F.col("days2") - F.col("days1")) / 2).cast("int")

    def lo(a, b):
        return F.min(F.least(a, b))

    def hi(a, b):
        return F.max(F.greatest(a, b))

    bounds = []
    for a in AXES:
        bounds += [lo(f[a], t[a]).alias(f"{a}_min"), hi(f[a], t[a]).alias(f"{a}_max")]
    deep = [F.when(~surface, p["z"]) for p in (f, t)]
    summary = legs.agg(
        *bounds,
        lo(*deep).alias("depth_min"),
        (hi(*deep) - lo(*deep)).alias("depth_extent"),
        F.min(mid).alias("date_min"),
        (F.max(mid) - F.min(mid)).alias("date_extent"),
        F.bool_and(F.col("days1").isNotNull()).alias("complete_dates"),
        F.bool_or(surface).alias("has_surface"),
        F.bool_or(~surface).alias("has_underground"),
        F.bool_or(flags.bitwiseAND(F.lit(LEG_SPLAY)) != 0).alias("has_splays"),
        F.bool_or(flags.bitwiseAND(F.lit(LEG_DUPLICATE)) != 0).alias("has_duplicates"),
    )
    marks = stations.agg(
        *[
            F.coalesce(
                F.sum((F.col("sflags").bitwiseAND(F.lit(bit)) != 0).cast("long")), F.lit(0)
            ).alias(n)
            for n, bit in (("entrances", STN_ENTRANCE), ("fixed", STN_FIXED), ("exported", STN_EXPORTED))
        ]
    )
    return summary.crossJoin(F.broadcast(marks))


def declination_range(readings: DataFrame, by="scope") -> DataFrame:
    """Least and greatest declination per scope, with the day of each."""
    low = F.min(F.struct("declination", "day")).alias("lo")
    high = F.min(F.struct((-F.col("declination")).alias("declination"), F.col("day"))).alias("hi")
    return readings.where(F.col("declination").isNotNull()).groupBy(by).agg(low, high).select(
        by,
        F.col("lo.declination").alias("min_declination"),
        F.col("lo.day").alias("min_day"),
        (-F.col("hi.declination")).alias("max_declination"),
        F.col("hi.day").alias("max_day"),
    )


def convergence_range(stations: DataFrame, to_convergence) -> DataFrame:
    """Least and greatest convergence over the six extreme stations.

    to_convergence(x, y) is a Column function (see functions.geometry).
    """
    limits = []
    for a in AXES:
        row = F.struct(F.col("name"), F.col("x"), F.col("y"))
        for sign in (1, -1):
            limits.append(F.min(F.struct((F.col(a) * sign).alias("k"), row.alias("s"))))
    ends = stations.agg(F.array(*limits).alias("e")).select(F.inline("e")).select("s.*")
    c = ends.withColumn("convergence", to_convergence(F.col("x"), F.col("y")))
    return c.agg(
        F.min(F.struct("convergence", "name")).alias("lo"),
        F.min(F.struct((-F.col("convergence")).alias("convergence"), F.col("name"))).alias("hi"),
    ).select(
        F.col("lo.convergence").alias("min_convergence"),
        F.col("lo.name").alias("min_station"),
        (-F.col("hi.convergence")).alias("max_convergence"),
        F.col("hi.name").alias("max_station"),
    )


def traverse_errors(legs: DataFrame, positions: DataFrame) -> DataFrame:
    """Misclosure figures of every traverse that is part of a loop.

    legs: trav_id, from_stn, to_stn as walked, trav_from, trav_to, d (along the
    walk), v, and optionally bridge. `moved` is the gap between the adjusted ends
    and the sum of the legs; E, H, V are in standard deviations, using only the
    diagonal of the covariance.
    """
    live = legs.where(~F.col("bridge")) if "bridge" in legs.columns else legs
    exact = (F.col("v.xx") == 0) & (F.col("v.yy") == 0) & (F.col("v.zz") == 0)
    length = norm(F.col("d"))
    sums = live.groupBy("trav_id").agg(
        F.first("trav_from").alias("from_stn"),
        F.first("trav_to").alias("to_stn"),
        F.sum((~exact).cast("long")).alias("n_legs"),
        F.sum(F.when(~exact, length).otherwise(0.0)).alias("length"),
        *[F.sum(f"d.{a}").alias(f"s{a}") for a in AXES],
        *[F.sum(f"v.{p}").alias(f"v{p}") for p in ("xx", "yy", "zz")],
    ).where(F.col("n_legs") > 0)
    at = positions.select("name", *AXES)
    for side in ("from", "to"):
        sums = sums.join(
            at.select(F.col("name").alias(f"{side}_stn"), *[F.col(a).alias(f"{side}_{a}") for a in AXES]),
            f"{side}_stn",
        )
    e = [F.col(f"to_{a}") - F.col(f"from_{a}") - F.col(f"s{a}") for a in AXES]
    sums = sums.withColumns({f"e{a}": x for a, x in zip(AXES, e)})
    h2 = F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")
    z2 = F.col("ez") * F.col("ez")
    hv = F.col("vxx") + F.col("vyy")
    moved = F.sqrt(h2 + z2)
    return sums.select(
        "trav_id",
        "from_stn",
        "to_stn",
        "n_legs",
        "length",
        moved.alias("moved"),
        (moved / F.col("n_legs")).alias("moved_per_leg"),
        F.when(F.col("length") > 0, 100.0 * moved / F.col("length")).alias("percent"),
        F.sqrt((h2 + z2) / (hv + F.col("vzz"))).alias("E"),
        F.sqrt(h2 / hv).alias("H"),
        F.sqrt(z2 / F.col("vzz")).alias("V"),
        "ex",
        "ey",
        "ez",
        (hv + F.col("vzz")).alias("expected2"),
    )


def traverse_polylines(
    items: DataFrame, keys: list[str], seq="seq", chunk: int = CHUNK
) -> DataFrame:
    """Polylines of consecutive legs with one flag, survey and style.

    items: seq, x, y, z, move (start of a walk), flags, survey, style, days1 per
    point. A polyline also holds the point that its first leg comes from, so one
    point may be in two. One row per polyline with an ordered `points` array; a
    polyline longer than a chunk continues in the next `part`, which starts with
    the last point of the one before, so no array grows without limit.
    """
    marked = ordered_items(items, keys, seq, chunk)
    marked = marked.withColumn("_piece", F.floor(F.col(seq) / F.lit(chunk)))
    first = Window.partitionBy(*keys, "polyline").orderBy("_piece")
    return (
        marked.groupBy(*keys, "polyline", "_piece")
        .agg(
            F.first("flags").alias("flags"),
            F.first("survey").alias("survey"),
            F.first("style").alias("style"),
            F.count(F.lit(1)).alias("legs"),
            F.array_sort(
                F.collect_list(F.struct(F.col(seq).alias("seq"), "prev", "x", "y", "z", "days1"))
            ).alias("legs_in_order"),
        )
        .withColumn("part", F.row_number().over(first))
        .select(
            *keys,
            "polyline",
            "part",
            "flags",
            "survey",
            "style",
            "legs",
            F.concat(
                F.array(
                    F.struct(
                        F.col("legs_in_order")[0]["prev"]["x"].alias("x"),
                        F.col("legs_in_order")[0]["prev"]["y"].alias("y"),
                        F.col("legs_in_order")[0]["prev"]["z"].alias("z"),
                        F.lit(None).cast("int").alias("date"),
                    )
                ),
                F.transform(
                    "legs_in_order",
                    lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["days1"].alias("date")),
                ),
            ).alias("points"),
        )
    )


def ordered_items(items: DataFrame, keys: list[str], seq: str, chunk: int = CHUNK) -> DataFrame:
    """Leg items with the previous point and a polyline number."""
    from legnet.plans.scan import large_groups, ordered_scan

    was = F.struct("x", "y", "z", "flags", "survey", "style", "move")
    large = large_groups(items, keys, chunk)
    step = ordered_scan(items, keys, seq, lag={"_was": was}, chunk=chunk, large=large)
    new = F.col("_was.move")
    for c in ("flags", "survey", "style"):
        new = new | ~F.col(c).eqNullSafe(F.col(f"_was.{c}"))
    legs = step.where(~F.col("move")).withColumn("_new", new.cast("long"))
    return ordered_scan(legs, keys, seq, running={"polyline": F.col("_new")}, chunk=chunk, large=large).withColumn(
        "prev", F.struct("_was.x", "_was.y", "_was.z")
    ).drop("_was", "_new")


def search_count(stations: DataFrame, pattern: str) -> DataFrame:
    from legnet.operators.filters import find_stations

    return stations.where(find_stations(F.col("name"), pattern)).agg(
        F.count(F.lit(1)).alias("matches")
    )


def length_by(legs: DataFrame, key: Column, name="band") -> DataFrame:
    """Total length and number of legs per class of a colour key."""
    return legs.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("legs"), F.sum(norm(F.col("d"))).alias("length")
    )


def export_depth(uses: DataFrame, sep=".") -> DataFrame:
    """How many survey levels above its own each station is used from.

    uses: (scope, station) for every use of a full station name inside a scope.
    """
    above = depth_of(survey_of(F.col("station"), sep), sep) - depth_of(F.col("scope"), sep)
    level = F.greatest(above, F.lit(0))
    out = uses.groupBy("station").agg(F.max(level).alias("levels"))
    return out.withColumn("exported", F.col("levels") > 0)


def split_legs_at_bands(
    legs: DataFrame, zmin: float | Column, extent: float | Column, bands: int
) -> DataFrame:
    """Legs cut where they cross from one depth band to the next.

    legs: from_pos, to_pos. Each piece has its band, number and end points.
    """
    zmin, extent = F.lit(zmin), F.lit(extent)
    f, t = F.col("from_pos"), F.col("to_pos")
    b1 = B.depth_band(f["z"], zmin, extent, bands)
    b2 = B.depth_band(t["z"], zmin, extent, bands)
    df = legs.withColumns({"_b1": b1, "_b2": b2})
    step = F.when(F.col("_b1") <= F.col("_b2"), 1).otherwise(-1)
    df = df.withColumn("band", F.explode(F.sequence("_b1", "_b2", step))).withColumn("_step", step)

    def cut(edge: Column) -> Column:
        z = B.band_floor(edge, zmin, extent, bands)
        share = (z - f["z"]) / (t["z"] - f["z"])
        return vec(f["x"] + share * (t["x"] - f["x"]), f["y"] + share * (t["y"] - f["y"]), z)

    rising = F.col("_step") > 0
    enter = F.when(rising, F.col("band")).otherwise(F.col("band") + 1)
    leave = F.when(rising, F.col("band") + 1).otherwise(F.col("band"))
    return df.withColumns(
        {
            "piece": F.abs(F.col("band") - F.col("_b1")),
            "piece_from": F.when(F.col("band") == F.col("_b1"), f).otherwise(cut(enter)),
            "piece_to": F.when(F.col("band") == F.col("_b2"), t).otherwise(cut(leave)),
        }
    ).drop("_b1", "_b2", "_step")
