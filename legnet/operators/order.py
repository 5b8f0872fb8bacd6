"""Sorted and top-n results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legnet.functions.names import leaf, natural_key
from legnet.operators.filters import has_bit, station_class
from legnet.operators.joins import degrees_of
from legnet.plans.rank import ranked
from legnet.schema import STN_ENTRANCE

ERROR_KEYS = {
    "E": "E",
    "H": "H",
    "V": "V",
    "percent": "percent",
    "per_leg": "moved_per_leg",
}


def worst_traverses(errors: DataFrame, by="E", n: int | None = None) -> DataFrame:
    """Traverses by falling error; equal errors in order of their id."""
    out = errors.orderBy(F.desc_nulls_last(ERROR_KEYS[by]), "trav_id")
    return out.limit(n) if n else out


def sort_names(stations: DataFrame, name="name", sep=".") -> DataFrame:
    return stations.orderBy(natural_key(F.col(name), sep), name)


def rank_names(stations: DataFrame, name="name", sep=".") -> DataFrame:
    """stations with `rank`, their place in natural order from 1."""
    return ranked(stations, natural_key(F.col(name), sep), name)


def plot_rank(sflags: Column) -> Column:
    order = F.create_map(
        *[F.lit(v) for kv in (("ENTRANCE", 0), ("FIXED", 1), ("EXPORTED", 2), ("PLAIN", 3)) for v in kv]
    )
    return order[station_class(sflags)]


def plot_order(stations: DataFrame, sep=".") -> DataFrame:
    """Order in which labels claim space: class, last part, shorter name, name."""
    return stations.orderBy(*_plot_keys(sep))


def rank_plot_order(stations: DataFrame, sep=".") -> DataFrame:
    """stations with `rank`, their place in `plot_order` from 1."""
    return ranked(stations, *_plot_keys(sep))


def _plot_keys(sep: str) -> list[Column]:
    name = F.col("name")
    return [
        plot_rank(F.col("sflags")),
        natural_key(leaf(name, sep), sep),
        F.length(name),
        natural_key(name, sep),
    ]


def pick_start(stations: DataFrame, legs: DataFrame) -> DataFrame:
    """The station to unroll from, as one row.

    The highest entrance with legs, else the highest end of a single leg, else
    the highest station with legs, else the highest station.
    """
    deg = degrees_of(legs)
    df = stations.join(deg, "name", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0))
    )
    rank = (
        F.when(has_bit(F.col("sflags"), STN_ENTRANCE) & (F.col("degree") > 0), 0)
        .when(F.col("degree") == 1, 1)
        .when(F.col("degree") > 0, 2)
        .otherwise(3)
    )
    return df.withColumn("rank", rank).orderBy("rank", F.desc("z"), "name").limit(1)
