"""Text formats, on files with known content."""

import pytest
from pyspark.sql import functions as F

from legnet.sources import readers as S

FOOT = 0.3048


def block(survey, date, fmt, settings, shots):
    """One record of a survey-block file, by the layout of the format."""
    head = ["Quarry", f"SURVEY NAME: {survey}", f"SURVEY DATE: {date}", "SURVEY TEAM:", "nobody"]
    head += [f"DECLINATION: {settings[0]} FORMAT: {fmt} {settings[1]}", "", "FROM TO LEN", ""]
    return "\n".join([*head, *(" ".join(map(str, x)) for x in shots)]) + "\n\f"


def polygon(n, length):
    """Legs of a regular polygon: (tape, bearing) each."""
    return [(length + i / 4, (360 // n) * i) for i in range(n)]


#: No back readings; then back readings of which one angle is about -999; then a diving format.
LEGS = polygon(5, 30)
BLOCKS = (
    block("WEIR", "11 30 2004", "DMMDUDRLLADN", (2.5, ""),
          [(f"W{i}", f"W{i + 1}", t, c, 3 * i - 6, 4, 4, 4, -9) for i, (t, c) in enumerate(LEGS)])
    + block("ADIT", "0 0 0", "DMMDUDRLLAaDdBT", (0, "CORRECTIONS: 0.5 -0.75 1 CORRECTIONS2: 3 4"),
            [("A0", "A1", 12.5, 75, -999.25, 1, 1, 1, 1, 256, 8, "#|S#"), ("A1", "A2", "?", 0, 0, 0, 0, 0, 0, 0, 0),
             ("A1", "A3", 20, -998.9, 2, 0, 0, 0, 0, 15, -2)])
    + block("POOL", "2 29 2008", "DMMWUDRLLADN", (-1, "CORRECTIONS: 1 2 3"), [("P1", "P2", 9, 180, 0, 5, 6, 7, 8, "#|L#")])
)


def plot_line(kind, north, east, up, name, size):
    return " ".join([kind, str(north), str(east), str(up), f"S{name}", "P", *map(str, size)])


#: A square in two surveys; the second starts with a leg that cannot be read.
SQUARE = [(0, 0), (40, 0), (40, 40), (0, 40)]
PLOT = "\n".join(
    ["NRIM D 7 14 2010"]
    + [plot_line("D" if i else "M", n, e, 5 * i, f"r{i}", (i, 1, 2, -9)) for i, (n, e) in enumerate(SQUARE)]
    + ["NDEN D 12 31 2011", plot_line("M", "?", 0, 0, "d0", (1, 1, 1, 1)), plot_line("D", 8, 9, 10, "d1", (1, 2, 3, 4)), ""]
)


@pytest.fixture()
def put(tmp_path):
    def write(text, name="f.txt"):
        path = tmp_path / name
        path.write_bytes(text.encode())
        return str(path)

    return write


def test_survey_blocks(spark, put):
    path = put(BLOCKS)
    rows = S.read_survey_blocks(spark, path).collect()
    weir = sorted((r for r in rows if r.survey == "WEIR"), key=lambda r: r.from_stn)
    assert [(r.tape, r.compass) for r in weir] == LEGS
    assert [r.clino for r in weir] == [-6, -3, 0, 3, 6]
    assert {(r.declination, r.corr_compass, r.corr_tape, r.backcompass, r.r) for r in weir} == {(2.5, 0, 0, None, None)}
    one, two = sorted((r for r in rows if r.survey == "ADIT"), key=lambda r: r.to_stn)
    assert (one.compass, one.clino, one.backcompass, one.backclino) == (75, None, 256, 8)
    assert (two.compass, two.clino, two.backcompass, two.backclino) == (None, 2, 15, -2)
    assert (one.corr_compass, one.corr_clino, one.corr_tape) == (0.5, -0.75, 1)
    assert (one.corr_backcompass, one.corr_backclino) == (3, 4)
    assert one.days1 is None and weir[0].days1 is not None
    (pool,) = (r for r in rows if r.survey == "POOL")
    assert pool.recorded_style == "DIVING" and weir[0].recorded_style == "NORMAL"
    assert (pool.l, pool.u, pool.d, pool.r) == (5, 6, 7, 8)
    assert pool.flags != 0 and one.flags != pool.flags and two.flags == 0
    plain = S.read_survey_blocks(spark, path, corrected=True).where("survey = 'POOL'").first()
    assert (plain.corr_compass, plain.corr_clino, plain.corr_tape) == (0, 0, 0)
    assert [r.value.split()[1] for r in S.read_survey_blocks(spark, path, bad=True).collect()] == ["A2"]
    assert S.read_survey_blocks(spark, path, survey="WEIR").count() == len(LEGS)


def test_plot_lines(spark, put):
    path = put(PLOT)
    rows = S.read_plot_lines(spark, path).orderBy("seq").collect()
    assert [(r.station, r.move) for r in rows] == [*((f"RIM r{i}", i == 0) for i in range(4)), ("DEN d1", False)]
    for i, ((north, east), r) in enumerate(zip(SQUARE, rows)):
        assert (r.x, r.y, r.z) == pytest.approx((east * FOOT, north * FOOT, 5 * i * FOOT))
    assert len({r.days1 for r in rows}) == 2
    assert [r.value.split()[4] for r in S.read_plot_lines(spark, path, bad=True).collect()] == ["Sd0"]
    assert [r.station for r in S.read_plot_lines(spark, path, survey="DEN").collect()] == ["d1"]


def test_positions(spark, put):
    text = (
        "( Easting, Northing, Altitude )\n(    2.00,     3.00,    -1.50 ) a.b\n"
        "(    0.00,     0.00,     0.00 )\n(  1.0, west, 2.0 ) a.c\n( 1.2.3, 0.0, 2.0 ) a.d\n"
    )
    rows = S.read_pos(spark, put(text)).orderBy("seq").collect()
    assert [(r.name, r.x, r.y, r.z, r.sflags) for r in rows] == [("a.b", 2.0, 3.0, -1.5, 2), ("", 0.0, 0.0, 0.0, 34)]
    part = S.read_pos(spark, put(text), "a").collect()
    assert [r.name for r in part] == ["b"]
    assert sorted(r.value[-3:] for r in S.read_pos(spark, put(text), bad=True).collect()) == ["a.c", "a.d"]


def test_shot_listing(spark, put):
    text = (
        "  Listing\n Old   New\n ------\n"
        "K1     K1            .00     .00     .00       .00       .00      .00\n"
        "K1     K2.1        05.00   14.00   -6.00     05.00     14.00    -6.00\n"
        "K2.1   K3          05.00   wide    -6.00     05.00     14.00    -6.00\n"
        "       K2.2   FIRST CHAMBER\n"
    )
    rows = S.read_xyz_shots(spark, put(text)).orderBy("seq").collect()
    assert [(r.from_stn, r.to_stn, r.move) for r in rows] == [("K1", "K1", True), ("K1", "K2.1", False)]
    assert rows[1].y == pytest.approx(14 * 0.3048)
    assert rows[1].from_y == pytest.approx(0.0)
    assert S.read_xyz_shots(spark, put(text), bad=True).count() == 1


def test_readings_csv_keeps_bad_rows(spark, put):
    from legnet.schema import READINGS

    head = ",".join(READINGS.names)
    row = {"reading_id": "1", "from_stn": "a", "tape": "3 5", "from_depth": "2.5"}
    good = ",".join(row.get(n, "") for n in READINGS.names)
    bad = ",".join({**row, "from_depth": "deep"}.get(n, "") for n in READINGS.names)
    rows, rejects = S.read_readings(spark, put(f"{head}\n{good}\n{bad}\n", "r.csv"), "csv")
    assert [(r.reading_id, r.tape, r.from_depth) for r in rows.collect()] == [(1, [3.0, 5.0], 2.5)]
    assert rejects.count() == 1


def test_streaming_reduction_equals_batch(spark, tmp_path):
    from legnet.operators.reduce import reduce_normal
    from legnet.streaming.reduce_stream import read_readings_stream, reduce_stream, write_legs

    df = spark.range(200).select(
        F.col("id").alias("reading_id"), F.lit("a").alias("from_stn"), F.lit("b").alias("to_stn"),
        (F.col("id") + 1.5).alias("tape"), (F.col("id") % 360 * 1.0).alias("compass"),
        (F.col("id") % 80 - 40.0).alias("clino"),
    )
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_readings_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    query = write_legs(reduce_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("reading_id", "d", "v")
    want = reduce_normal(df).select("reading_id", "d", "v")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
