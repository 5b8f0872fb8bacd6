"""Readers: readings tables, positions, plot files, listings, survey blocks.

A line that looks like data but does not parse is left out of the result. With
`bad=True` a reader returns these lines instead, as (file, line_no, value), so none
vanishes without a word. With `survey` only that sub-survey is read, under names
relative to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legnet.functions.dates import days_since_1900
from legnet.functions.names import full_name
from legnet.functions.readings import map_shot_flags
from legnet.operators.filters import sub_survey
from legnet.plans.scan import ordered_scan
from legnet.schema import METRES_PER_FOOT, READINGS, STN_ANON, STN_UNDERGROUND
from legnet.schema import LEG_SURFACE
from legnet.sources.text import numbered_lines

CORRUPT = "_corrupt_record"


def read_readings(spark: SparkSession, path: str, fmt="parquet") -> tuple[DataFrame, DataFrame]:
    """(readings, bad rows) of a Parquet, JSON or CSV table of readings.

    CSV files start with a heading of the column names in the order of the schema;
    a repeated reading is a list of numbers separated by spaces. A row that does
    not fit the schema is kept aside with its text.
    """
    if fmt == "parquet":
        df = spark.read.schema(READINGS).parquet(path)
        return df, df.limit(0).select(F.lit(None).cast("string").alias(CORRUPT))
    flat = T.StructType(
        [
            T.StructField(f.name, T.StringType() if fmt == "csv" and isinstance(f.dataType, T.ArrayType) else f.dataType)
            for f in READINGS
        ]
        + [T.StructField(CORRUPT, T.StringType())]
    )
    # Parsing lines of text keeps a bad row's text next to the parsed columns.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "")
    if fmt == "json":
        parsed = F.from_json("value", flat, options)
    else:
        lines = lines.where(F.col("value") != ",".join(READINGS.names))
        parsed = F.from_csv("value", F.lit(flat.simpleString()[7:-1].replace(":", " ")), options)
    df = lines.select(parsed.alias("r")).select("r.*")
    if fmt == "csv":
        for f in READINGS:
            if isinstance(f.dataType, T.ArrayType):
                numbers = F.transform(F.split(F.col(f.name), r"\s+"), lambda t: t.try_cast("double"))
                df = df.withColumn(f.name, F.when(F.col(f.name).isNotNull(), numbers))
    good = df.where(F.col(CORRUPT).isNull()).select(*READINGS.names)
    return good, df.where(F.col(CORRUPT).isNotNull()).select("reading_id", CORRUPT)


def _sound(rows: DataFrame, needed: list[str], bad: bool) -> DataFrame:
    """Rows whose needed columns all parsed, or the lines of the others."""
    ok = F.lit(True)
    for c in needed:
        ok = ok & F.col(c).isNotNull()
    if bad:
        return rows.where(~ok).select("file", "line_no", "value")
    return rows.where(ok).drop("file", "line_no", "value")


def read_pos(spark: SparkSession, path: str, survey: str = "", bad=False) -> DataFrame:
    """Stations of a position listing: `(E, N, A ) name` per line.

    The heading is skipped. A line without a name is an unnamed station.
    """
    return positions_of(numbered_lines(spark, path), survey, bad)


def positions_of(lines: DataFrame, survey: str = "", bad=False, name: Column | None = None) -> DataFrame:
    """Stations of the lines (file, line_no, value) of position listings.

    `name` is the station's name where it is known without parsing.
    """
    number = r"\s*([-+]?[\d.]+(?:[eE][-+]?\d+)?)\s*"
    shape = rf"^\({number},{number},{number}\)[ \t]*(.*)$"
    heading = F.col("value").rlike(r"^\(\s*Easting\s*,\s*Northing\s*,\s*Altitude\s*\)")
    lines = lines.where(~heading & (F.trim("value") != ""))
    part = [F.regexp_extract("value", shape, i) for i in range(1, 5)]
    name = F.regexp_replace(part[3], r"^\\", "") if name is None else name
    out = lines.select(
        name.alias("name"),
        *[part[i].try_cast("double").alias(a) for i, a in enumerate("xyz")],
        F.when(name == "", STN_UNDERGROUND | STN_ANON).otherwise(STN_UNDERGROUND).alias("sflags"),
        F.col("line_no").alias("seq"),
        "file", "line_no", "value",
    )
    out = _sound(out, ["x", "y", "z"], bad)
    return sub_survey(out, "name", survey) if survey and not bad else out


def _feet(text: Column) -> Column:
    return text.try_cast("double") * METRES_PER_FOOT


def _date(month: Column, day: Column, year: Column) -> Column:
    """Days since 1900 of a month-day-year date; NULL for the 'unknown' date."""
    full = F.when(year < 1900, year + 1900).otherwise(year)
    known = month.between(1, 12) & day.between(1, 31) & ~((full == 1901) & (month == 1) & (day == 1))
    return F.when(
        known,
        days_since_1900(
            F.try_to_timestamp(
                F.format_string("%04d-%02d-%02d", full, month, day), F.lit("yyyy-MM-dd")
            ).cast("date")
        ),
    )


def read_plot_lines(
    spark: SparkSession, path: str, parts=False, survey: str = "", bad=False
) -> DataFrame:
    """Points of line-coded plot files, in order.

    With `parts` the files found are consecutive parts of one plot file, in the
    order of their names, as an ordered write leaves them.

    Columns: file, seq, move (starts a walk), section, station ('section name'),
    x, y, z (metres), flags, days1, l, r, u, d (-1 where not given). Points of a
    section that is not open (after X, F or S until the next N) are skipped. A
    `survey` is the name of one section.
    """
    return points_of(numbered_lines(spark, path, parts), survey, bad)


def points_of(lines: DataFrame, survey: str = "", bad=False) -> DataFrame:
    """Points of the lines (file, line_no, value) of plot files."""
    lines = lines.where(F.col("value").rlike("^[NXFSMDd]"))
    op, rest = F.substring("value", 1, 1), F.expr("substring(value, 2)")
    head = r"^(\S*)\s*(?:D\s*(\d+)\s+(\d+)\s+(\d+))?"
    part = [F.regexp_extract(rest, head, i) for i in range(1, 5)]
    section = F.struct(
        (op == "N").alias("open"),
        part[0].alias("name"),
        _date(part[1].try_cast("int"), part[2].try_cast("int"), part[3].try_cast("int")).alias("days1"),
    )
    staged = lines.withColumns(
        {"op": op, "_head": F.when(op.isin("N", "X", "F", "S"), section)}
    )
    held = ordered_scan(staged, ["file"], "line_no", carry={"_at": F.col("_head")})
    points = held.where(F.col("op").isin("M", "D", "d") & F.col("_at.open"))
    shape = (
        r"^.\s*(\S+)\s+(\S+)\s+(\S+)\s+S(\S*)"
        r"(?:\s*P\s*(\S+)\s+(\S+)\s+(\S+)\s+(\S+))?(?:\s*I\s*\S*)?(?:\s*F([A-Za-z]*))?"
    )
    p = [F.regexp_extract("value", shape, i) for i in range(1, 10)]
    points = points.withColumns({f"_p{i}": c for i, c in enumerate(p)})
    letters = map_shot_flags(F.col("_p8"))
    surface = F.when(F.col("op") == "d", LEG_SURFACE).otherwise(0)

    def size(i: int) -> Column:
        v = F.col(f"_p{i}").try_cast("double")
        return F.when((v >= 0) & (v <= 900), v * METRES_PER_FOOT).otherwise(-1.0)

    points = points.select(
        "file", "line_no", "value",
        F.col("file").alias("_file"),
        F.col("line_no").alias("seq"),
        (F.col("op") == "M").alias("move"),
        F.col("_at.name").alias("section"),
        full_name(F.col("_at.name"), F.col("_p3"), " ").alias("station"),
        # Plot files give north before east.
        _feet(F.col("_p1")).alias("x"),
        _feet(F.col("_p0")).alias("y"),
        _feet(F.col("_p2")).alias("z"),
        F.when(F.col("op") == "M", 0).otherwise(letters["flags"].bitwiseOR(surface)).alias("flags"),
        F.col("_at.days1").alias("days1"),
        size(4).alias("l"),
        size(5).alias("r"),
        size(6).alias("u"),
        size(7).alias("d"),
    )
    # A file may start with a draw; its first point is a move all the same.
    if bad:
        return _sound(points, ["x", "y", "z"], True)
    points = _sound(points, ["x", "y", "z"], False).withColumnRenamed("_file", "file")
    if survey:
        points = points.where(F.col("section") == survey).withColumn(
            "station", F.substr("station", F.lit(len(survey) + 2))
        )
    first = ordered_scan(points, ["file"], "seq", lag={"_before": F.lit(1)})
    return first.withColumn("move", F.col("move") | F.col("_before").isNull()).drop("_before")


def _cells(spark: SparkSession, path: str, least: int) -> DataFrame:
    lines = numbered_lines(spark, path)
    solid = (F.col("value") != "") & ~F.col("value").startswith(" ")
    return lines.where(
        solid & ~F.col("value").startswith("\u001a") & (F.length("value") >= least)
    )


def _heading() -> Column:
    """Title, column names and rules of a listing: lines without a digit."""
    return ~F.col("value").rlike("[0-9]")


def _cut(start: int, size: int) -> Column:
    return _feet(F.trim(F.substring("value", start, size)))


def _name(start: int, size: int) -> Column:
    return F.substring_index(F.substring("value", start, size), " ", 1)


def read_xyz_stations(spark: SparkSession, path: str, survey: str = "", bad=False) -> DataFrame:
    """Stations of a fixed-width listing in feet; the first line of a name counts."""
    rows = _cells(spark, path, 37).select(
        _name(1, 6).alias("name"), _cut(7, 9).alias("x"), _cut(16, 9).alias("y"),
        _cut(25, 8).alias("z"), F.col("line_no").alias("seq"), "file", "line_no", "value",
    )
    rows = _sound(rows.where(~_heading()), ["x", "y", "z"], bad)
    if bad:
        return rows
    rows = sub_survey(rows, "name", survey) if survey else rows
    first = rows.groupBy("name").agg(F.min_by(F.struct("x", "y", "z", "seq"), "seq").alias("r"))
    return first.select("name", "r.*", F.lit(STN_UNDERGROUND).alias("sflags"))


def read_xyz_shots(spark: SparkSession, path: str, survey: str = "", bad=False) -> DataFrame:
    """Shots of a fixed-width listing in feet, with both end points.

    A shot from a station to itself only places that station (move = true).
    """
    rows = _cells(spark, path, 61).select(
        F.col("line_no").alias("seq"), _name(1, 7).alias("from_stn"), _name(8, 7).alias("to_stn"),
        _cut(16, 9).alias("dx"), _cut(25, 8).alias("dy"), _cut(33, 8).alias("dz"),
        _cut(41, 10).alias("x"), _cut(51, 10).alias("y"), _cut(61, 9).alias("z"),
        "file", "line_no", "value",
    )
    rows = _sound(rows.where(~_heading()), ["x", "y", "z", "dx", "dy", "dz"], bad)
    if bad:
        return rows
    if survey:
        rows = sub_survey(sub_survey(rows, "from_stn", survey), "to_stn", survey)
    return rows.withColumns(
        {f"from_{a}": F.col(a) - F.col(f"d{a}") for a in "xyz"}
        | {"move": F.col("from_stn") == F.col("to_stn")}
    ).drop("dx", "dy", "dz")


_MISSING = 999.0 - 360.0


def read_survey_blocks(
    spark: SparkSession, path: str, corrected=False, survey: str = "", bad=False
) -> DataFrame:
    """Shots of form-feed separated survey records, with their survey's settings.

    Lengths stay in feet and angles in degrees; corr_* are the corrections to add
    (0 when `corrected`, for files that have them applied). Angles given as about
    -999 and dimensions below 0 are NULL.
    """
    blocks = spark.read.option("lineSep", "\f").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    return shots_of(blocks, corrected, survey, bad)


def shots_of(blocks: DataFrame, corrected=False, survey: str = "", bad=False) -> DataFrame:
    """Shots of survey records (file, block, row, value)."""
    text = F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"^\n+", "")
    blocks = blocks.select("file", "block", "row", text.alias("text")).where(F.col("text").rlike(r"\S"))
    # The settings end at the first blank line, after a fixed heading of nine lines.
    lines = blocks.withColumn("_l", F.split("text", "\n"))
    head = F.lit(9)
    number = r"\s*(-?[\d.]+)"

    def find(pattern: str, i: int) -> Column:
        return F.regexp_extract(F.array_join(F.slice("_l", 1, head), "\n"), pattern, i)

    fmt = find(r"FORMAT:\s*(\S+)", 1)
    mark = F.when(F.length(fmt) >= 15, F.substring(fmt, 14, 1)).when(
        F.length(fmt) >= 12, F.substring(fmt, 12, 1)
    )
    date = [find(r"SURVEY DATE:\s*(\d+)\s+(\d+)\s+(\d+)", i).try_cast("int") for i in (1, 2, 3)]
    first = [find(rf"CORRECTIONS:{number}{number}{number}", i).try_cast("double") for i in (1, 2, 3)]
    second = [find(rf"CORRECTIONS2:{number}{number}", i).try_cast("double") for i in (1, 2)]
    zero = F.lit(0.0)

    def fix(*choices: Column) -> Column:
        return zero if corrected else F.coalesce(*choices, zero)

    heads = lines.select(
        "file", "block", "row",
        find(r"SURVEY NAME:\s*(\S*)", 1).alias("survey"),
        _date(*date).alias("days1"),
        F.coalesce(find(rf"DECLINATION:{number}", 1).try_cast("double"), zero).alias("declination"),
        F.coalesce(mark.isin("B", "C"), F.lit(False)).alias("backsights"),
        F.when(F.substring(fmt, 4, 1) == "W", "DIVING").otherwise("NORMAL").alias("recorded_style"),
        fix(first[0]).alias("corr_compass"),
        fix(first[1]).alias("corr_clino"),
        fix(first[2]).alias("corr_tape"),
        fix(second[0], first[0]).alias("corr_backcompass"),
        fix(second[1], first[1]).alias("corr_backclino"),
        # Name, three header lines, team, settings and a heading between blanks.
        F.posexplode(F.expr("slice(_l, 10, greatest(size(_l) - 9, 0))")).alias("line_no", "line"),
    )
    shots = heads.where(F.col("line").rlike(r"\S")).withColumn(
        "_t", F.split(F.trim("line"), r"\s+")
    )

    def cell(i: int) -> Column:
        return F.get("_t", F.lit(i))

    def num(i: int) -> Column:
        return cell(i).try_cast("double")

    def angle(i: int) -> Column:
        return F.when(F.abs(num(i)) <= _MISSING, num(i))

    def dimension(i: int) -> Column:
        return F.when(num(i) >= 0, num(i))

    flag_at = F.when(F.col("backsights"), 11).otherwise(9)
    letters = F.regexp_extract(F.get("_t", flag_at), r"^#\|([A-Z]*)#", 1)
    back = F.col("backsights")
    shots = shots.withColumn("_f", map_shot_flags(letters))
    if survey:
        shots = shots.where(F.col("survey") == survey)
    tape = num(2)
    if bad:
        return shots.where(tape.isNull()).select("file", "line_no", F.col("line").alias("value"))
    shots = shots.where(tape.isNotNull())
    return shots.select(
        "file", "block", "row", "line_no", "survey", "days1", "declination", "recorded_style",
        *[f"corr_{c}" for c in ("compass", "clino", "tape", "backcompass", "backclino")],
        cell(0).alias("from_stn"),
        cell(1).alias("to_stn"),
        num(2).alias("tape"),
        angle(3).alias("compass"),
        angle(4).alias("clino"),
        dimension(5).alias("l"),
        dimension(6).alias("u"),
        dimension(7).alias("d"),
        dimension(8).alias("r"),
        F.when(back, angle(9)).alias("backcompass"),
        F.when(back, angle(10)).alias("backclino"),
        F.col("_f.flags").alias("flags"),
        F.col("_f.excluded").alias("excluded"),
        F.col("_f.fixed_var").alias("fixed_var"),
    )
