"""From legs, equates and fixes to an adjusted network, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legnet.functions.names import survey_of
from legnet.operators.adjust import Adjustment, adjust, adjusted_legs
from legnet.operators.graph import canonical_legs, default_fix, equate_classes
from legnet.operators.joins import apply_fixes, first_fixes, station_flags
from legnet.plans.skew import lookup
from legnet.plans.store import cut


@dataclass
class Network:
    stations: DataFrame  # name, survey, x, y, z, sflags: every name, equated ones too
    legs: DataFrame  # legs with their ends' positions and place in the network
    adjustment: Adjustment


def solve_network(
    legs: DataFrame,
    fixes: DataFrame,
    equates: DataFrame | None = None,
    entrances: DataFrame | None = None,
    exports: DataFrame | None = None,
    max_nodes: int = 0,
    sep: str = ".",
) -> Network:
    """legs: from_stn, to_stn, d, v, flags and seq; fixes: as schema.FIXES.

    Equated stations share one position. Uncertain fixes become anchor legs; with
    no fix at all the first station with a leg is put at the origin. Positions
    found by an earlier run may be passed as exact fixes.
    """
    work = legs.withColumns({"stn_a": F.col("from_stn"), "stn_b": F.col("to_stn")})
    held = fixes
    classes = None
    if equates is not None:
        classes = cut(equate_classes(equates))
        work = canonical_legs(work, classes).where(F.col("from_stn") != F.col("to_stn"))
        held = lookup(fixes, "station", classes, how="left").withColumn(
            "station", F.coalesce("class", "station")
        ).drop("class")
        held = first_fixes(held)
    tied, pinned = apply_fixes(work, held)
    pinned = default_fix(work, pinned).select("name", "x", "y", "z")
    result = adjust(tied, pinned, max_nodes=max_nodes)

    real = result.positions.where(~F.col("name").startswith("\u0000"))
    if classes is not None:
        # Every name of a class is at the class's place.
        alias = classes.where(F.col("station") != F.col("class")).select(
            F.col("class").alias("name"), "station"
        )
        others = lookup(alias, "name", real).select(F.col("station").alias("name"), "x", "y", "z")
        real = real.unionByName(others)
    real = cut(real)
    solid = result.legs.where(~F.col("fake"))
    named = solid.withColumns({"from_stn": F.col("stn_a"), "to_stn": F.col("stn_b")}).drop("stn_a", "stn_b")
    stations = station_flags(named, real, entrances, fixes, exports).withColumn(
        "survey", survey_of(F.col("name"), sep)
    )
    return Network(stations, adjusted_legs(named, real), result)
