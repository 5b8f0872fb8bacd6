"""Readers and sinks: tables written as text, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from legnet.checks.scalars import NAMES_SQL, names_view
from legnet.checks.tables import _items, ring_errors, TRAV, tv2_legs, placed_xsects, FRAMES
from legnet.checks.views import r, table, view, with_views
from legnet.operators import aggregates as A
from legnet.operators import passages as PS
from legnet.operators import windows as W
from legnet.plans.scan import large_groups
from legnet.plans.store import work_folder
from legnet.sinks import render as K
from legnet.sources import network as NW
from legnet.sources import readers as S
from legnet.sources import records as RC

QUERIES, SQL = {}, {}


# Bounds of a plot file in feet, north before east.
_BOX = ", ".join(f"{f}({a}) / 3.048e-1" for a in "yxz" for f in ("min", "max"))


def _z(expr: str, digits: int = 2) -> str:
    """What would print as a negative zero is zero."""
    return f"CASE WHEN abs({expr}) < {0.5 / 10**digits!r} THEN 0e0 ELSE ({expr}) + 0e0 END"



def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _path(spark) -> str:
    return f"{work_folder(spark)}/files-{uuid.uuid4().hex}"


def _written(spark, lines):
    """Rendered lines after a round trip through text files."""
    path = _path(spark)
    K.write_lines(lines, path, "gzip")
    return spark.read.text(path).select("value")


@query(
    "s1_read_readings",
    with_views(
        """SELECT reading_id, from_stn, to_stn, tape, compass, date1 IS NOT NULL AS dated, false AS bad FROM tv1 WHERE l_orderkey % 50 <> 0
 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true FROM tv1 WHERE l_orderkey % 50 = 0""",
        "tv1",
    ),
)
def s1(spark, sf):
    df = view(spark, sf, "tv1").select(
        "reading_id", "scope", "from_stn", "to_stn", F.array("tape").alias("tape"),
        F.array("compass").alias("compass"), "date1", "l_orderkey",
    )
    good = F.to_json(F.struct(*[c for c in df.columns if c != "l_orderkey"]))
    path = _path(spark)
    text = df.select(F.when(F.col("l_orderkey") % 50 == 0, "{broken").otherwise(good).alias("value"))
    text.write.text(path)
    rows, bad = S.read_readings(spark, path, "json")
    none = F.lit(None)
    return rows.select(
        "reading_id", "from_stn", "to_stn", F.col("tape")[0].alias("tape"), F.col("compass")[0].alias("compass"),
        F.col("date1").isNotNull().alias("dated"), F.lit(False).alias("bad"),
    ).unionByName(
        bad.select(
            none.cast("long").alias("reading_id"), none.cast("string").alias("from_stn"),
            none.cast("string").alias("to_stn"), none.cast("double").alias("tape"),
            none.cast("double").alias("compass"), none.cast("boolean").alias("dated"), F.lit(True).alias("bad"),
        )
    )


@query(
    "s2_read_pos",
    with_views(
        "SELECT CASE WHEN k % 13 = 0 THEN '' ELSE name END AS name, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, CAST(CASE WHEN k % 13 = 0 THEN 34 ELSE 2 END AS INTEGER) AS sflags FROM tvs",
        "tvs",
    ),
)
def s2(spark, sf):
    path = _path(spark)
    K.write_lines(K.render_pos(view(spark, sf, "tvs")), path)
    return S.read_pos(spark, path).select("name", "x", "y", "z", "sflags")


@query(
    "s2_pushed_survey",
    with_views(
        "SELECT name, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z FROM tvs WHERE k % 13 <> 0 AND k % 5 = 3",
        "tvs",
    ),
)
def s2b(spark, sf):
    path = _path(spark)
    below = F.concat(F.lit("r"), (F.col("k") % 5).cast("string"), F.lit("."), F.col("name"))
    K.write_lines(K.render_pos(view(spark, sf, "tvs").withColumn("name", below)), path)
    return RC.positions(spark, path, survey="r3").select("name", "x", "y", "z")


@query(
    "k2_write_pos",
    with_views(
        """SELECT concat(printf('(%8.2f, %8.2f, %8.2f )', x, y, z), CASE WHEN k % 13 = 0 THEN '' ELSE concat(' ', name) END) AS value FROM tvs
 UNION ALL SELECT '( Easting, Northing, Altitude )'""",
        "tvs",
    ),
)
def k2(spark, sf):
    return _written(spark, K.render_pos(view(spark, sf, "tvs")))


@query(
    "k1_write_csv",
    with_views(
        """SELECT concat(printf('%.2f,%.2f,%.2f,', x, y, z), CASE WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 THEN concat(chr(34), name, ',', chr(34), chr(34), 'x', chr(34), chr(34), chr(34)) ELSE name END) AS value FROM tvs
 UNION ALL SELECT 'Easting,Northing,Altitude,Station Name'""",
        "tvs",
    ),
)
def k1(spark, sf):
    s = view(spark, sf, "tvs").withColumn(
        "name", F.when(F.col("k") % 17 == 0, F.concat("name", F.lit(',"x"'))).otherwise(F.col("name"))
    )
    return _written(spark, K.render_csv(s))


def _stream(spark, sf):
    """The item stream of all chains with one global order."""
    return _items(spark, sf).withColumns(
        {"seq": F.col("cust") * 1000000 + F.col("seq"), "flags": F.when(F.col("move"), 0).otherwise(F.col("flags") * 2)}
    )


def _labels(spark, sf):
    items = _stream(spark, sf)
    return items.where(F.col("seq") % 3 != 0).select(
        F.concat(F.lit("n "), F.col("seq").cast("string")).alias("name"), "seq", "x", "y", "z"
    )


_PLT = """it AS (SELECT cust * 1000000 + seq AS seq, false AS move, a + 1e0 AS x, dy AS y, dz AS z, CASE WHEN seq % 4 >= 2 THEN 2 ELSE 0 END AS flags FROM tv2
 UNION ALL SELECT cust * 1000000, true, 0e0, 0e0, 0e0, 0 FROM tv2 WHERE seq = 1)"""


@query(
    "s3_read_plot_lines",
    with_views(
        f"WITH {_PLT} SELECT move, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, CAST(flags AS INTEGER) AS flags, 'X' AS section, CAST(NULL AS INTEGER) AS days1, -1e0 AS l FROM it",
        "tv2",
    ),
)
def s3(spark, sf):
    path = _path(spark)
    K.write_lines(K.render_plot_lines(_stream(spark, sf), _labels(spark, sf)), path)
    out = S.read_plot_lines(spark, path, parts=True)
    return out.select("move", *[F.round(a, 2).alias(a) for a in "xyz"], "flags", "section", "days1", "l")


@query(
    "k6_write_plot_lines",
    with_views(
        f"""WITH {_PLT}, lb AS (SELECT x, y, z, min(seq) AS s FROM it WHERE seq % 3 <> 0 GROUP BY x, y, z)
 SELECT concat(CASE WHEN move THEN 'M ' ELSE 'D ' END, printf('%.3f %.3f %.3f ', round(it.y / 3.048e-1, 6) + 0e0, round(it.x / 3.048e-1, 6) + 0e0, round(it.z / 3.048e-1, 6) + 0e0), 'S', CASE WHEN s IS NULL THEN concat('^', CAST(seq AS VARCHAR)) ELSE concat('n^_', CAST(s AS VARCHAR)) END,
   ' P -9 -9 -9 -9', CASE WHEN flags = 2 THEN ' FL' ELSE '' END) AS value FROM it LEFT JOIN lb ON lb.x = it.x AND lb.y = it.y AND lb.z = it.z
 UNION ALL SELECT 'NX D 1 1 1 CX'
 UNION ALL SELECT concat(op, printf(' %.3f %.3f %.3f %.3f %.3f %.3f', {_BOX})) FROM it, (VALUES ('Z'), ('X')) v(op) GROUP BY op""",
        "tv2",
    ),
)
def k6(spark, sf):
    return _written(spark, K.render_plot_lines(_stream(spark, sf), _labels(spark, sf)))


# Names of a listing have six characters: a letter and the number to base 36.
_SHORT = "concat(substr(name, 1, 1), lower(to_base(k, 36)))"


def _listing(spark, sf):
    short = F.concat(F.substring("name", 1, 1), F.lower(F.conv(F.col("k").cast("string"), 10, 36)))
    return view(spark, sf, "tvs").withColumn("name", short)


@query(
    "s4_read_xyz_stations",
    with_views(
        f"SELECT {_SHORT} AS name, round(round(x, 2) * 3.048e-1, 6) AS x, round(round(y, 2) * 3.048e-1, 6) AS y, round(round(z, 2) * 3.048e-1, 6) AS z FROM tvs", "tvs"
    ),
)
def s4(spark, sf):
    s = _listing(spark, sf)
    line = F.concat(F.rpad("name", 6, " "), F.format_string("%9.2f%9.2f%8.2f", "x", "y", "z"), F.lit("    0"))
    path = _path(spark)
    lines = s.select(line.alias("value")).unionAll(spark.range(1).select(F.lit(" Station  East North").alias("value")))
    lines.write.text(path)
    out = S.read_xyz_stations(spark, path)
    return out.select("name", *[F.round(a, 6).alias(a) for a in "xyz"])


@query(
    "s4_read_xyz_shots",
    with_views(
        f"""SELECT concat('a', {_SHORT}) AS from_stn, concat('b', {_SHORT}) AS to_stn, round(round(x, 2) * 3.048e-1, 6) AS x, round(round(x, 2) * 3.048e-1 - 25e-1 * 3.048e-1, 6) AS from_x,
 round(round(z, 2) * 3.048e-1 + 125e-2 * 3.048e-1, 6) AS from_z, false AS move FROM tvs""",
        "tvs",
    ),
)
def s4b(spark, sf):
    s = _listing(spark, sf)
    key = F.col("name")
    line = F.concat(
        F.rpad(F.concat(F.lit("a"), key), 7, " "), F.rpad(F.concat(F.lit("b"), key), 8, " "),
        F.format_string("%9.2f%8.2f%8.2f%10.2f%10.2f%9.2f", F.lit(2.5), F.lit(0.0), F.lit(-1.25), "x", "y", "z"),
    )
    path = _path(spark)
    s.select(line.alias("value")).write.text(path)
    out = S.read_xyz_shots(spark, path)
    return out.select("from_stn", "to_stn", "move", *[F.round(a, 6).alias(a) for a in ("x", "from_x", "from_z")])


@query(
    "s5_read_survey_blocks",
    with_views(
        """SELECT concat('S', CAST(cust AS VARCHAR)) AS survey, concat('f', CAST(seq AS VARCHAR)) AS from_stn, concat('t', CAST(seq AS VARCHAR)) AS to_stn, abs(round(dx, 2)) AS tape,
 CASE WHEN seq % 3 = 0 THEN NULL ELSE 1e2 END AS compass, round(dz, 2) AS clino, CASE WHEN cust % 2 = 0 THEN 28e1 END AS backcompass, CASE WHEN seq % 2 = 0 THEN NULL ELSE 1e0 END AS l,
 CAST(CASE WHEN seq % 4 = 0 THEN 3 ELSE 0 END AS INTEGER) AS flags, 15e-1 AS declination, 2e0 AS corr_compass, CAST(29218 AS INTEGER) AS days1 FROM tv2""",
        "tv2",
    ),
)
def s5(spark, sf):
    df = view(spark, sf, "tv2")
    cust, seq = F.col("cust"), F.col("seq")
    two = cust % 2 == 0
    # A record holds at most a thousand shots, however long the chain.
    record = F.floor((seq - 1) / 1000).alias("record")
    head = df.where((seq - 1) % 1000 == 0).select(
        "cust", record,
        F.posexplode(
            F.array(
                F.lit("\fCave"),
                F.concat(F.lit("SURVEY NAME: S"), cust.cast("string")),
                F.lit("SURVEY DATE: 12 31 1979  COMMENT:x"),
                F.lit("SURVEY TEAM: "),
                F.lit("Us"),
                F.concat(
                    F.lit("DECLINATION: 1.50  FORMAT: "), F.when(two, "DDDDLRUDLADB").otherwise("DDDDLRUDLADN"),
                    F.lit(" CORRECTIONS: 2.00 3.00 0.50"),
                ),
                F.lit(""), F.lit("FROM TO LENGTH"), F.lit(""),
            )
        ).alias("place", "value"),
    )
    shots = df.select(
        "cust", record, (seq + 100).cast("int").alias("place"),
        F.concat(
            F.format_string("  f%d t%d %.2f ", seq, seq, F.abs(F.col("dx"))),
            F.when(seq % 3 == 0, "-999.0").otherwise("100.0"), F.format_string(" %.2f ", F.col("dz") + 0.0),
            F.when(seq % 2 == 0, "-9").otherwise("1"), F.lit(" 2 3 4"),
            F.when(two, " 280 -5").otherwise(""), F.when(seq % 4 == 0, " #|PL#").otherwise(""),
        ).alias("value"),
    )
    path = _path(spark)
    lines = head.unionByName(shots)
    spread = lines.repartition("cust", "record").sortWithinPartitions("cust", "record", "place")
    spread.select("value").write.text(path)
    out = S.read_survey_blocks(spark, path)
    return out.select(
        "survey", "from_stn", "to_stn", "tape", "compass", "clino", "backcompass", "l", "flags", "declination",
        "corr_compass", "days1",
    )


@query(
    "s8_network_tables",
    f"WITH {NAMES_SQL} SELECT name, CAST(o_custkey AS BIGINT) AS cust FROM tv4 WHERE name LIKE 'N3.%'",
)
def s8(spark, sf):
    path = _path(spark)
    NW.write_network(path, stations=names_view(spark, sf))
    return NW.read_network(spark, path, "stations", "N3").select("name", F.col("o_custkey").alias("cust"))


_LINES = """pl AS (SELECT *, CASE WHEN lag(fl) OVER w IS DISTINCT FROM fl THEN 1 ELSE 0 END AS step FROM (SELECT *, CASE WHEN seq % 4 >= 2 THEN 1 ELSE 0 END AS fl FROM tv2) t WINDOW w AS (PARTITION BY cust ORDER BY seq)),
 pm AS (SELECT *, sum(step) OVER w AS p, lag(dy) OVER w0 AS py, lag(dz) OVER w0 AS pz FROM pl WINDOW w AS (PARTITION BY cust ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w0 AS (PARTITION BY cust ORDER BY seq)),
 pp AS (SELECT cust, p, fl, seq, a + 1e0 AS x, dy AS y, dz AS z FROM pm UNION ALL SELECT cust, p, fl, seq - 1, a * 1e0, coalesce(py, 0e0), coalesce(pz, 0e0) FROM pm WHERE step = 1)"""


def _polylines(spark, sf):
    return A.traverse_polylines(_items(spark, sf), ["cust"])


def _poly_order():
    return K._order(F.col("cust"), F.col("polyline"), F.col("part"))


@query(
    "k3_to_json",
    with_views(
        f"""WITH {_LINES}, j AS (SELECT concat('[', string_agg(printf('[%.2f,%.2f,%.2f]', {_z('x')}, {_z('z')}, {_z('y')}), ',' ORDER BY seq), ']') AS value FROM pp GROUP BY cust, p)
 SELECT value FROM j UNION ALL SELECT '"traverses":[' UNION ALL SELECT ']}}' UNION ALL SELECT printf('{{"bounds":[%.2f,%.2f,%.2f,%.2f,%.2f,%.2f],', min(x), min(z), min(y), max(x), max(z), max(y)) FROM pp""",
        "tv2",
    ),
)
def k3(spark, sf):
    out = _written(spark, K.render_json(_polylines(spark, sf), _poly_order()))
    return out.select(F.regexp_replace("value", r"^,\[", "[").alias("value"))


def _flat_lonlat(x, y):
    return F.struct((x / 1000).alias("lon"), (y / 1000).alias("lat"))


_CLASS = "CASE WHEN k % 7 = 0 THEN '{0}' WHEN k % 11 = 0 THEN '{1}' WHEN k % 5 = 0 THEN '{2}' ELSE '' END"


@query(
    "k4_to_gpx",
    with_views(
        f"""WITH {_LINES} SELECT concat(printf('<wpt lon="%.8f" lat="%.8f"><ele>%.2f</ele><name>', x / 1000, y / 1000, z), name, '</name>', {_CLASS.format('<sym>Pin, Green</sym>', '<sym>Pin, Red</sym>', '<sym>Pin, Blue</sym>')}, '</wpt>') AS value FROM tvs WHERE k % 13 <> 0
 UNION ALL SELECT concat('<trkseg>', string_agg(printf('<trkpt lon="%.8f" lat="%.8f"><ele>%.2f</ele></trkpt>', {_z('x / 1000', 8)}, {_z('y / 1000', 8)}, {_z('z')}), '' ORDER BY seq), '</trkseg>') FROM pp GROUP BY cust, p
 UNION ALL SELECT unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<gpx version="1.0" creator="legnet" xmlns="http://www.topografix.com/GPX/1/0">',
   '<name>all &amp; more</name>', '<trk><name>all &amp; more</name>', '</trk>', '</gpx>'])""",
        "tvs", "tv2",
    ),
)
def k4(spark, sf):
    return _written(spark, K.render_gpx(view(spark, sf, "tvs"), _polylines(spark, sf), "all & more", _flat_lonlat, _poly_order()))


_ABSOLUTE = "<altitudeMode>absolute</altitudeMode>"


def _at(x: str, y: str, z: str) -> str:
    return f"printf('%.8f,%.8f,%.2f', {_z(f'({x}) / 1000', 8)}, {_z(f'({y}) / 1000', 8)}, {_z(z)})"


def _kml_sql() -> str:
    """Every line of the file: head, passages, sections, walls, legs, stations and foot."""
    head = K._KML_HEAD.format(title="all") + "\n</Document></kml>"
    left, right = _at("x - rx * l", "y - ry * l", "z"), _at("x + rx * r", "y + ry * r", "z")
    one = f"<Placemark><name></name><LineString>{_ABSOLUTE}<coordinates>"
    end = "</coordinates></LineString></Placemark>"
    ring = [
        "'<Placemark><name></name><MultiGeometry>'",
        f"'<Polygon>{_ABSOLUTE}<outerBoundaryIs><LinearRing><coordinates>'",
        "pr", "pl", "lf", "rg", "pr",
        "'</coordinates></LinearRing></outerBoundaryIs></Polygon>'", "'</MultiGeometry></Placemark>'",
    ]
    legs = "</coordinates></LineString></MultiGeometry></Placemark>"
    style = "CASE WHEN fl = 1 THEN '<styleUrl>#surf</styleUrl>' ELSE '' END"
    sides = " UNION ALL ".join(
        f"SELECT list_concat(list_concat(['{one}'], list({side} ORDER BY seq)), ['{end}']) AS v FROM edges GROUP BY tube_id"
        for side in ("lf", "rg")
    )
    return f"""WITH {FRAMES}, {_LINES},
 edges AS (SELECT tube_id, seq, {left} AS lf, {right} AS rg FROM fr),
 quads AS (SELECT *, lag(lf) OVER w AS pl, lag(rg) OVER w AS pr FROM edges WINDOW w AS (PARTITION BY tube_id ORDER BY seq)),
 lines AS (
  SELECT [{', '.join(ring)}] AS v FROM quads WHERE pl IS NOT NULL
  UNION ALL SELECT list_concat(['{one}'], list_concat(list_concat(list(lf), list(rg)), ['{end}'])) FROM edges GROUP BY tube_id, seq
  UNION ALL {sides}
  UNION ALL SELECT list_concat(list_concat(
    [concat('<Placemark>', {style}, '<MultiGeometry><LineString>{_ABSOLUTE}<coordinates>')],
    list({_at('x', 'y', 'z')} ORDER BY seq)), ['{legs}']) FROM pp GROUP BY cust, p, fl
  UNION ALL SELECT [concat('<Placemark><Point><coordinates>', printf('%.8f,%.8f,%.2f', x / 1000, y / 1000, z), '</coordinates></Point>',
    CASE WHEN k % 13 = 0 THEN '' ELSE concat('<name>', name, '</name>', {_CLASS.format('<styleUrl>#ent</styleUrl>', '<styleUrl>#fix</styleUrl>', '<styleUrl>#exp</styleUrl>')}) END, '</Placemark>')] FROM tvs
  UNION ALL SELECT string_split('{head}', chr(10)))
 SELECT unnest(v) AS value FROM lines"""


@query("k5_to_kml", with_views(_kml_sql(), "tvs", "tv2"))
def k5(spark, sf):
    xsects = placed_xsects(spark, sf)
    large = large_groups(xsects, ["tube_id"])
    frames = PS.tube_frames(xsects, large=large)
    sides = PS.wall_points(frames)
    point = F.struct("seq", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
    walls = sides.groupBy("tube_id", "side").agg(F.sort_array(F.collect_list(point)).alias("points"))
    both = F.sort_array(F.collect_list(F.struct("side", point.alias("p"))))
    across = sides.groupBy("tube_id", "seq").agg(F.transform(both, lambda e: e["p"]).alias("points"))
    lines = K.render_kml(
        view(spark, sf, "tvs"), _polylines(spark, sf), "all", _flat_lonlat, _poly_order(),
        quads=PS.passage_quads(frames, large=large),
        walls=walls.withColumn("key", K._order(F.col("tube_id"), F.col("side"))),
        xsects=across.withColumn("key", K._order(F.col("tube_id"), F.col("seq"))),
    )
    return _written(spark, lines)


@query(
    "k7_dump_items",
    with_views(
        f"""SELECT concat(printf('LEG %.2f %.2f %.2f %.2f %.2f %.2f [', a * 1e0, {_z('coalesce(lag(dy) OVER w, 0e0)')}, {_z('coalesce(lag(dz) OVER w, 0e0)')}, a + 1e0, {_z('dy')}, {_z('dz')}), 's] STYLE=NORMAL', CASE WHEN seq % 4 >= 2 THEN ' SURFACE' ELSE '' END, ' 1900-01-02') AS value FROM tv2 WINDOW w AS (PARTITION BY cust ORDER BY seq)
 UNION ALL SELECT concat(printf('NODE %.2f %.2f %.2f [', x, y, z), name, ']', CASE WHEN k % 3 = 0 THEN ' SURFACE' ELSE ' UNDERGROUND' END, CASE WHEN k % 7 = 0 THEN ' ENTRANCE' ELSE '' END, CASE WHEN k % 5 = 0 THEN ' EXPORTED' ELSE '' END, CASE WHEN k % 11 = 0 THEN ' FIXED' ELSE '' END, CASE WHEN k % 13 = 0 THEN ' ANON' ELSE '' END) FROM tvs""",
        "tv2", "tvs",
    ),
)
def k7(spark, sf):
    legs = W.pair_points(_items(spark, sf), ["cust"]).withColumns(
        {"days2": F.col("days1"), "seq": F.col("cust") * 1000000 + F.col("seq")}
    )
    stations = view(spark, sf, "tvs").withColumn("seq", F.col("k"))
    return _written(spark, K.dump_items(legs, stations))


@query(
    "k8_write_traverse_errors",
    with_views(
        f"""WITH {TRAV} SELECT concat('c', CAST(trav_id AS VARCHAR), '.0') AS from_stn, CAST(n_legs AS VARCHAR) AS n_legs, printf('%.2f', length) AS length, printf('%.2f', moved) AS moved, printf('%.6f', e3) AS "E" FROM err""",
        "tv2",
    ),
)
def k8(spark, sf):
    path = _path(spark)
    K.write_traverse_errors(ring_errors(spark, sf), path)
    out = spark.read.option("header", True).csv(path)
    return out.select("from_stn", "n_legs", "length", "moved", "E")
