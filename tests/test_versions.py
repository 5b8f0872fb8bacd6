"""Versions of a stored network: what a change rewrites, and what a gate keeps away."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from legnet.plans.resolve import solve_change, solve_first
from legnet.sources import versions as VS
from networks import dense, legs_frame


def rings(n):
    """Closed rings of four stations, each with a fix, and one loose pair."""
    rnd, legs, pins = np.random.default_rng(n), [], {}
    for k in range(n):
        for i in range(4):
            legs.append((f"r{k}.{i}", f"r{k}.{(i + 1) % 4}", rnd.normal(size=3), np.eye(3) * (0.01 + 0.01 * i)))
        pins[f"r{k}.0"] = (float(k), 0.0, 1.0)
    return legs + [("loose.a", "loose.b", (1, 1, 1), np.eye(3))], pins


def frame(spark, legs, ids=None):
    """The legs with leg_id: their places in the list, or those given."""
    numbered = [(f"{i}|{f}", t, d, v) for i, (f, t, d, v) in zip(ids or range(len(legs)), legs)]
    return legs_frame(spark, numbered).withColumns(
        {
            "leg_id": F.substring_index("from_stn", "|", 1).cast("int"),
            "from_stn": F.substring_index("from_stn", "|", -1),
        }
    )


def fixes(spark, pins):
    df = spark.createDataFrame([(k, *v) for k, v in pins.items()], "station string, x double, y double, z double")
    return df.withColumns({c: F.lit(None).cast("double") for c in ("sdx", "sdy", "sdz", "cxy", "cyz", "czx")})


def places(spark, version):
    return {r.name: (r.x, r.y, r.z) for r in version.read(spark, "stations").collect()}


def same(got, legs, pins):
    linked = [leg for leg in legs if not leg[0].startswith("loose")]
    want = dense(linked, pins)
    assert set(got) == set(want)
    for name, at in want.items():
        assert got[name] == pytest.approx(tuple(at), abs=1e-6)


def test_a_change_rewrites_its_component_alone(spark, tmp_path):
    legs, pins = rings(12)
    path = str(tmp_path / "net")
    first = solve_first(spark, path, frame(spark, legs), fixes(spark, pins))
    same(places(spark, first), legs, pins)
    # One leg of one ring is measured again.
    f, t, d, v = legs[9]
    legs[9] = (f, t, np.array(d) + 0.5, v)
    second = solve_change(spark, path, changed=frame(spark, [legs[9]], [9]))
    assert second.number == 2 and VS.newest(spark, path).number == 2
    same(places(spark, second), legs, pins)
    for table in ("legs", "stations", "fixes"):
        old, new = first.folders(table), second.folders(table)
        assert set(old) == set(new) and sum(old[k] != new[k] for k in old) == 1
    # The version before is still there as it was.
    assert places(spark, first) != places(spark, second)
    # Two rings are joined by a new leg, another ring loses all but two of its legs.
    legs.append(("r0.2", "r1.2", (0.3, 0.1, 0.2), np.eye(3) * 0.02))
    third = solve_change(
        spark, path, changed=frame(spark, [legs[-1]], [len(legs) - 1]),
        removed=spark.createDataFrame([(12,), (15,)], "leg_id int"),
    )
    left = [leg for i, leg in enumerate(legs) if i not in (12, 15)]
    cut_off = {"r3.1", "r3.2", "r3.3"}
    got = places(spark, third)
    assert not cut_off & set(got) and got["r3.0"] == (3.0, 0.0, 1.0)
    same(got, [leg for leg in left if leg[0] not in cut_off], pins)
    assert third.read(spark, "legs").count() == len(left)


def test_a_failing_version_stays_unseen(spark, tmp_path):
    path = str(tmp_path / "gate")
    df = spark.range(20).select("id", VS.bucket_of(F.col("id").cast("string")).alias("bucket"))
    VS.publish(spark, path, {"t": df})
    with pytest.raises(VS.GateError):
        VS.publish(spark, path, {"t": df.withColumn("id", F.col("id") + 100)}, errors={"t": F.col("id") == 107})
    now = VS.newest(spark, path)
    assert now.number == 1 and now.read(spark, "t").agg(F.max("id")).first()[0] == 19
    # Files of the failed run are gone, and a second run of one number is refused.
    assert len(VS._Files(spark, path).names(f"{path}/t")) == 1
    stale = VS.Version(path)
    with pytest.raises(VS.GateError):
        VS.publish(spark, path, {"t": df}, before=stale)
    assert VS.newest(spark, path).number == 1
    assert VS.newest(spark, str(tmp_path / "none")).number == 0
