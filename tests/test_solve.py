"""The whole way from legs, equates and fixes to stations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from legnet.plans.solve import solve_network
from networks import legs_frame


def test_equates_uncertain_fix_and_flags(spark):
    eye = np.eye(3) * 0.01
    legs = [
        ("a.1", "a.2", (1, 0, 0), eye), ("b.1", "b.2", (0, 2, 0), eye),
        ("b.2", "a.1", (-1, -2, 0.2), eye), ("b.2", "b.3", (0, 0, 5), eye),
    ]
    df = legs_frame(spark, legs).withColumns({"flags": F.lit(0), "seq": F.lit(1)})
    fixes = spark.createDataFrame(
        [("a.1", 10.0, 0.0, 0.0, None, False)],
        "station string, x double, y double, z double, sdx double, is_reference boolean",
    )
    for c in ("sdy", "sdz", "cxy", "cyz", "czx"):
        fixes = fixes.withColumn(c, F.lit(None).cast("double"))
    equates = spark.createDataFrame([("a.2", "b.1"), ("b.1", "x.9")], "a string, b string")
    doors = spark.createDataFrame([("b.3",)], "station string")
    net = solve_network(df, fixes, equates, entrances=doors, max_nodes=50)
    got = {r.name: r for r in net.stations.collect()}
    assert set(got) == {"a.1", "a.2", "b.1", "b.2", "b.3", "x.9"}
    for name in ("b.1", "x.9"):
        assert (got[name].x, got[name].y, got[name].z) == (got["a.2"].x, got["a.2"].y, got["a.2"].z)
    # The gap of 0.2 is shared by the three legs of the loop.
    assert got["a.2"].z == pytest.approx(-0.2 / 3)
    assert got["b.3"].z == pytest.approx(5 - 0.4 / 3)
    assert got["a.1"].sflags == 2 | 16 and got["b.3"].sflags == 2 | 4
    assert got["b.3"].survey == "b"
    assert net.legs.count() == 4
