"""Row filters and class columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legnet.functions.names import ancestors
from legnet.schema import STN_ANON, STN_ENTRANCE, STN_EXPORTED, STN_FIXED


def in_survey(name: Column, prefix: str, sep=".", station=True) -> Column:
    """Station below a survey; with station=False also the survey itself."""
    below = name.startswith(prefix + sep)
    return below if station else below | (name == prefix)


def sub_survey(df: DataFrame, name: str, prefix: str, sep=".") -> DataFrame:
    """Rows of one sub-survey with names made relative to it."""
    prefix = prefix[: -len(sep)] if prefix.endswith(sep) else prefix
    if not prefix:
        return df
    cut = len(prefix) + len(sep)
    return df.where(in_survey(F.col(name), prefix, sep)).withColumn(
        name, F.substr(F.col(name), F.lit(cut + 1))
    )


def top_prefixes(prefixes: DataFrame, sep=".") -> DataFrame:
    """Distinct prefixes without those nested in another listed one."""
    p = prefixes.select(F.col(prefixes.columns[0]).alias("prefix")).distinct()
    inside = p.select("prefix", F.explode(ancestors(F.col("prefix"), sep)).alias("up"))
    nested = inside.join(p.withColumnRenamed("prefix", "up"), "up", "left_semi")
    return p.join(nested.select("prefix"), "prefix", "left_anti")


def visible(df: DataFrame, name: str, prefixes: DataFrame, sep=".") -> DataFrame:
    """Rows whose name is one of the prefixes or lies below one.

    Each name is matched through its own prefixes by equality. No listed prefix
    lies inside another one after normalising, so no row is matched twice.
    """
    keys = top_prefixes(prefixes, sep)
    own = F.concat(ancestors(F.col(name), sep), F.array(F.col(name)))
    return (
        df.withColumn("prefix", F.explode(own)).join(keys, "prefix", "left_semi").drop("prefix")
    )


def leg_flags(flags: Column, any_of=0, none_of=0) -> Column:
    """Legs with at least one bit of any_of (if given) and no bit of none_of."""
    keep = flags.bitwiseAND(F.lit(none_of)) == 0
    return keep & (flags.bitwiseAND(F.lit(any_of)) != 0) if any_of else keep


def has_bit(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def station_class(sflags: Column) -> Column:
    """One class per station: entrance before fixed before exported."""
    return (
        F.when(has_bit(sflags, STN_ENTRANCE), "ENTRANCE")
        .when(has_bit(sflags, STN_FIXED), "FIXED")
        .when(has_bit(sflags, STN_EXPORTED), "EXPORTED")
        .otherwise("PLAIN")
    )


def named(sflags: Column) -> Column:
    return ~has_bit(sflags, STN_ANON)


# Features that each sink can carry, and those it shows by default.
SINK_FEATURES = {
    "csv": ("labels entrances fixes exports anonymous", "labels"),
    "gpx": ("labels legs surface splays entrances fixes exports anonymous", "labels"),
    "json": ("legs surface splays", "legs"),
    "kml": (
        "labels legs surface splays passages xsects walls entrances fixes exports anonymous",
        "labels legs",
    ),
    "plt": ("labels anonymous legs surface splays", "labels anonymous legs"),
    "pos": ("labels entrances fixes exports anonymous", "labels"),
}


def sink_mask(fmt: str, requested: set[str] | None = None) -> set[str]:
    """Features to write: the default ones, or the requested that the sink carries."""
    able, default = (set(t.split()) for t in SINK_FEATURES[fmt])
    return default if not requested else requested & able


def find_stations(name: Column, pattern: str) -> Column:
    """Search without case: part of a name, or a whole name with * and ?."""
    if not pattern:
        return F.lit(False)
    parts = {"*": ".*", "?": "."}
    body = "".join(parts.get(c, re.escape(c)) for c in pattern)
    wild = "*" in pattern or "?" in pattern
    return name.rlike(f"(?is)^{body}$" if wild else f"(?i){body}")


def drop_excluded(df: DataFrame, letters="shot_flags") -> DataFrame:
    """Shots without the X (exclude) flag."""
    return df.where(~F.coalesce(F.col(letters), F.lit("")).contains("X"))


def drop_ignored(df: DataFrame) -> DataFrame:
    return df.where(F.col("style") != "IGNORE")
