"""Sinks: tables rendered to rows of text, in order, and written by many tasks.

A renderer returns (part, place, value) rows: `part` orders the sections of the
file, `place` the lines inside one. Lines are built on the executors; the ordered
write is a range partitioning, so no task holds the whole file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legnet.functions.names import csv_quote, natural_key, plot_escape, xml_escape
from legnet.operators.filters import has_bit, named, station_class
from legnet.operators.joins import point_key
from legnet.schema import LEG_DUPLICATE, LEG_SPLAY, LEG_SURFACE, METRES_PER_FOOT, STN_ANON


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    """Text files whose concatenation in name order is the rendered file.

    With "gzip" it is the rendered file in that format, as gzip files may be concatenated.
    """
    spread = lines.orderBy("part", "place").select("value")
    spread.write.mode("overwrite").text(path, compression=compression)


def _line(spark, part: int, value: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(part).alias("part"), F.lit("").alias("place"), F.lit(value).alias("value")
    )


def _part(df: DataFrame, part: int, place: Column, value: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), place.cast("string").alias("place"), value.alias("value"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _order(*numbers: Column) -> Column:
    """Text key that sorts like the numbers."""
    return F.concat(*[F.lpad(n.cast("string"), 20, "0") for n in numbers])


def _zero(col: Column, digits: int) -> Column:
    """col, with what would print as a (negative) zero set to zero."""
    return F.when(F.abs(col) < 0.5 / 10**digits, F.lit(0.0)).otherwise(col)


def _n(fmt: str, *cols: Column) -> Column:
    """The numbers formatted, never with a negative zero."""
    digits = [int(d) for d in re.findall(r"%[0-9]*\.([0-9])f", fmt)]
    return F.format_string(fmt, *[_zero(c, d) for c, d in zip(cols, digits, strict=True)])


def _somewhere(*cols: str) -> Column:
    """Text key without a meaning of its own, so rows without a name spread over tasks."""
    return F.format_string("%016x", F.xxhash64(*cols))


def _xyz(fmt: str) -> Column:
    return _n(fmt, F.col("x"), F.col("y"), F.col("z"))


def render_csv(stations: DataFrame, sep=".") -> DataFrame:
    """Easting, Northing, Altitude, Station Name; unnamed stations come last."""
    spark = stations.sparkSession
    name = F.col("name")
    lines = F.concat(_xyz("%.2f,%.2f,%.2f,"), csv_quote(name))
    keep = stations.where(named(F.col("sflags")))
    anon = stations.where(~named(F.col("sflags")))
    return _union(
        _line(spark, 0, "Easting,Northing,Altitude,Station Name"),
        _part(keep, 1, natural_key(name, sep), lines),
        _part(anon, 2, _somewhere("x", "y", "z"), _xyz("%.2f,%.2f,%.2f,")),
    )


def render_pos(stations: DataFrame, sep=".") -> DataFrame:
    """`(E, N, A ) name` in columns; unnamed stations come last."""
    spark = stations.sparkSession
    at = _xyz("(%8.2f, %8.2f, %8.2f )")
    keep = stations.where(named(F.col("sflags")))
    anon = stations.where(~named(F.col("sflags")))
    return _union(
        _line(spark, 0, "( Easting, Northing, Altitude )"),
        _part(keep, 1, natural_key(F.col("name"), sep), F.concat(at, F.lit(" "), F.col("name"))),
        _part(anon, 2, _somewhere("x", "y", "z"), at),
    )


def render_json(polylines: DataFrame, order: Column) -> DataFrame:
    """Bounds and polylines; axes in the order x, z, y. One polyline per row.

    polylines: points array<struct<x,y,z,...>>. `order` is a text key.
    """
    spark = polylines.sparkSession
    df = polylines.withColumn("_k", order)
    p = F.col("points")
    point = F.transform(p, lambda q: _n("[%.2f,%.2f,%.2f]", q["x"], q["z"], q["y"]))
    body = F.concat(F.lit("["), F.array_join(point, ","), F.lit("]"))
    lim = [
        f(F.expr(f"array_{f.__name__}(transform(points, q -> q.{a}))"))
        for f in (F.min, F.max)
        for a in "xzy"
    ]
    names = [f"{f}_{a}" for f in ("lo", "hi") for a in "xzy"]
    one = df.agg(*[c.alias(n) for c, n in zip(lim, names)], F.min("_k").alias("_first"))
    head = F.concat(F.lit('{"bounds":['), _n(",".join(["%.2f"] * 6), *[F.col(n) for n in names]), F.lit("],"))
    rows = df.crossJoin(F.broadcast(one.select("_first")))
    comma = F.when(F.col("_k") == F.col("_first"), "").otherwise(",")
    return _union(
        _part(one, 0, F.lit("0"), head),
        _line(spark, 1, '"traverses":['),
        _part(rows, 2, F.col("_k"), F.concat(comma, body)),
        _line(spark, 3, "]}"),
    )


# Pin colours and style ids by station class.
_PIN = {"FIXED": "Red", "EXPORTED": "Blue", "ENTRANCE": "Green"}
_STYLE = {"FIXED": "fix", "EXPORTED": "exp", "ENTRANCE": "ent"}


def _by_class(table: dict, before: str, after: str) -> Column:
    pairs = [F.lit(v) for k, t in table.items() for v in (k, before + t + after)]
    return F.coalesce(F.create_map(*pairs)[station_class(F.col("sflags"))], F.lit(""))


def render_gpx(stations: DataFrame, polylines: DataFrame, title: str, to_lonlat, order: Column) -> DataFrame:
    """Waypoints with a pin by class, and one track segment per polyline.

    to_lonlat(x, y) gives struct(lon, lat) in degrees (functions.geometry).
    """
    spark = stations.sparkSession
    ll = stations.where(named(F.col("sflags"))).withColumn("_ll", to_lonlat(F.col("x"), F.col("y")))
    wpt = F.concat(
        _n(
            '<wpt lon="%.8f" lat="%.8f"><ele>%.2f</ele><name>', F.col("_ll.lon"), F.col("_ll.lat"), F.col("z")
        ),
        xml_escape(F.col("name")),
        F.lit("</name>"),
        _by_class(_PIN, "<sym>Pin, ", "</sym>"),
        F.lit("</wpt>"),
    )
    track = F.array_join(
        F.transform(
            "points",
            lambda q: _n(
                '<trkpt lon="%.8f" lat="%.8f"><ele>%.2f</ele></trkpt>',
                to_lonlat(q["x"], q["y"])["lon"], to_lonlat(q["x"], q["y"])["lat"], q["z"],
            ),
        ),
        "",
    )
    escaped = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return _union(
        _line(
            spark, 0,
            '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.0" creator="legnet" '
            'xmlns="http://www.topografix.com/GPX/1/0">\n<name>' + escaped + "</name>",
        ),
        _part(ll, 1, natural_key(F.col("name")), wpt),
        _line(spark, 2, f"<trk><name>{escaped}</name>"),
        _part(polylines, 3, order, F.concat(F.lit("<trkseg>"), track, F.lit("</trkseg>"))),
        _line(spark, 4, "</trk>"),
        _line(spark, 5, "</gpx>"),
    )


def _coords(points: Column, to_lonlat, xyz=("x", "y", "z"), glue="\n") -> Column:
    def one(q):
        ll = to_lonlat(q[xyz[0]], q[xyz[1]])
        return _n("%.8f,%.8f,%.2f", ll["lon"], ll["lat"], q[xyz[2]])

    return F.array_join(F.transform(points, one), glue)


# Icon and line styles of the placemark file.
_KML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n'
    "<Document><name>{title}</name>\n"
    '<Style id="fix"><IconStyle><color>ff0000ff</color></IconStyle></Style>\n'
    '<Style id="exp"><IconStyle><color>ffff0000</color></IconStyle></Style>\n'
    '<Style id="ent"><IconStyle><color>ff00ff00</color></IconStyle></Style>\n'
    '<Style id="surf"><LineStyle><color>ff00ff00</color></LineStyle></Style>\n'
    '<Style id="splay"><LineStyle><color>40ff00ff</color></LineStyle></Style>'
)


def render_kml(
    stations: DataFrame, polylines: DataFrame, title: str, to_lonlat, order: Column,
    quads: DataFrame | None = None, walls: DataFrame | None = None, xsects: DataFrame | None = None,
    clamp=False,
) -> DataFrame:
    """Placemarks of passages, cross-sections, walls, legs and stations.

    quads: tube_id, seq, ring (from `passage_quads`); walls: wall, points; xsects:
    key, points (two ends); each row becomes one placemark.
    """
    spark = stations.sparkSession
    alt = "" if clamp else "<altitudeMode>absolute</altitudeMode>"
    parts = [_line(spark, 0, _KML_HEAD.format(title=title.replace("&", "&amp;").replace("<", "&lt;")))]
    if quads is not None:
        ring = F.concat(
            F.lit(f"<Placemark><name></name><MultiGeometry>\n<Polygon>{alt}<outerBoundaryIs><LinearRing><coordinates>\n"),
            _coords(F.col("ring"), to_lonlat),
            F.lit("\n</coordinates></LinearRing></outerBoundaryIs></Polygon>\n</MultiGeometry></Placemark>"),
        )
        parts.append(_part(quads, 1, _order(F.col("tube_id"), F.col("seq")), ring))
    for part, df in ((2, xsects), (3, walls)):
        if df is not None:
            line = F.concat(
                F.lit(f"<Placemark><name></name><LineString>{alt}<coordinates>\n"),
                _coords(F.col("points"), to_lonlat),
                F.lit("\n</coordinates></LineString></Placemark>"),
            )
            parts.append(_part(df, part, F.col("key"), line))
    flags = F.col("flags")
    style = (
        F.when(has_bit(flags, LEG_SURFACE), "<styleUrl>#surf</styleUrl>")
        .when(has_bit(flags, LEG_SPLAY), "<styleUrl>#splay</styleUrl>")
        .otherwise("")
    )
    legs = F.concat(
        F.lit("<Placemark>"), style, F.lit(f"<MultiGeometry><LineString>{alt}<coordinates>\n"),
        _coords(F.col("points"), to_lonlat),
        F.lit("\n</coordinates></LineString></MultiGeometry></Placemark>"),
    )
    parts.append(_part(polylines, 4, order, legs))
    ll = stations.withColumn("_ll", to_lonlat(F.col("x"), F.col("y")))
    at = F.concat(
        F.lit("<Placemark><Point><coordinates>"),
        _n("%.8f,%.8f,%.2f", F.col("_ll.lon"), F.col("_ll.lat"), F.col("z")),
        F.lit("</coordinates></Point>"),
    )
    label = F.concat(
        at, F.lit("<name>"), xml_escape(F.col("name")), F.lit("</name>"),
        _by_class(_STYLE, "<styleUrl>#", "</styleUrl>"), F.lit("</Placemark>"),
    )
    parts.append(_part(ll.where(named(F.col("sflags"))), 5, natural_key(F.col("name")), label))
    anon = ll.where(has_bit(F.col("sflags"), STN_ANON))
    parts.append(_part(anon, 6, _somewhere("x", "y", "z"), F.concat(at, F.lit("</Placemark>"))))
    parts.append(_line(spark, 7, "</Document></kml>"))
    return _union(*parts)


def render_plot_lines(items: DataFrame, labels: DataFrame, title="X") -> DataFrame:
    """Line-coded plot file in feet, north before east.

    items: seq, move, x, y, z, flags; labels: name, seq, x, y, z. A point without
    a label gets a name of its own that starts with '^'.
    """
    spark = items.sparkSession
    first = labels.groupBy(point_key(F.col("x"), F.col("y"), F.col("z")).alias("_at")).agg(
        F.min_by("name", "seq").alias("name")
    )
    at = point_key(F.col("x"), F.col("y"), F.col("z"))
    df = items.withColumn("_at", at).join(first, "_at", "left")
    name = F.coalesce(plot_escape(F.col("name")), F.concat(F.lit("^"), F.col("seq").cast("string")))
    feet = [F.col(a) / METRES_PER_FOOT for a in "yxz"]
    flags = F.col("flags")
    letters = F.concat(
        *[
            F.when(has_bit(flags, b), t).otherwise("")
            for b, t in ((LEG_DUPLICATE, "L"), (LEG_SURFACE, "P"), (LEG_SPLAY, "S"))
        ]
    )
    tail = F.when(~F.col("move") & (letters != ""), F.concat(F.lit(" F"), letters)).otherwise("")
    value = F.concat(
        F.when(F.col("move"), "M ").otherwise("D "),
        _n("%.3f %.3f %.3f ", *feet), F.lit("S"), name, F.lit(" P -9 -9 -9 -9"), tail,
    )
    lim = items.agg(
        *[f((F.col(a) / METRES_PER_FOOT)).alias(f"{f.__name__}_{a}") for a in "yxz" for f in (F.min, F.max)]
    )
    box = _n(" ".join(["%.3f"] * 6), *[F.col(f"{f}_{a}") for a in "yxz" for f in ("min", "max")])
    return _union(
        _part(lim, 0, F.lit(""), F.concat(F.lit("Z "), box)),
        _line(spark, 1, f"NX D 1 1 1 C{title}"),
        _part(df, 2, _order(F.col("seq")), value),
        _part(lim, 3, F.lit(""), F.concat(F.lit("X "), box)),
    )


def _date_text(days: Column, sep: str) -> Column:
    from legnet.functions.dates import date_from_days

    return F.date_format(date_from_days(days), f"yyyy'{sep}'MM'{sep}'dd")


def dates_text(days1: Column, days2: Column, sep="-", between=" ") -> Column:
    """' 2001-02-03' or a range; empty when undated."""
    one = F.concat(F.lit(" "), _date_text(days1, sep))
    two = F.concat(one, F.lit(between), _date_text(days2, sep))
    return F.when(days1.isNull(), "").when(days1 == days2, one).otherwise(two)


def _bits(flags: Column, names) -> Column:
    return F.concat(*[F.when(has_bit(flags, b), f" {n}").otherwise("") for b, n in names])


# Words of the dump for leg and station flags.
LEG_WORDS = ((1, "SURFACE"), (2, "DUPLICATE"), (4, "SPLAY"))
STATION_WORDS = (
    (1, "SURFACE"), (2, "UNDERGROUND"), (4, "ENTRANCE"), (8, "EXPORTED"), (16, "FIXED"),
    (32, "ANON"), (64, "WALL"),
)


def dump_items(
    legs: DataFrame | None = None, stations: DataFrame | None = None,
    xsects: DataFrame | None = None, errors: DataFrame | None = None, dates=True,
) -> DataFrame:
    """Audit text of every item: legs as from/to pairs, stations, sections, errors.

    Each table has a `seq`; legs carry from_x.. and x.., survey, style, flags,
    days1, days2.
    """
    out = []
    if legs is not None:
        when = dates_text(F.col("days1"), F.col("days2")) if dates else F.lit("")
        out.append(
            _part(
                legs, 0, _order(F.col("seq")),
                F.concat(
                    _n("LEG %.2f %.2f %.2f %.2f %.2f %.2f [", *[F.col(f"from_{a}") for a in "xyz"], *[F.col(a) for a in "xyz"]),
                    F.col("survey"), F.lit("]"),
                    F.when(F.col("style").isNull(), "").otherwise(F.concat(F.lit(" STYLE="), F.col("style"))),
                    _bits(F.col("flags"), LEG_WORDS), when,
                ),
            )
        )
    if errors is not None:
        out.append(
            _part(
                errors, 1, _order(F.col("seq")),
                F.format_string(
                    "ERROR_INFO #legs %d, len %.2fm, E %.2f H %.2f V %.2f",
                    F.col("n_legs"), F.col("length"), F.col("E"), F.col("H"), F.col("V"),
                ),
            )
        )
    if stations is not None:
        out.append(
            _part(
                stations, 2, _order(F.col("seq")),
                F.concat(_xyz("NODE %.2f %.2f %.2f ["), F.col("name"), F.lit("]"), _bits(F.col("sflags"), STATION_WORDS)),
            )
        )
    if xsects is not None:
        out.append(
            _part(
                xsects, 3, _order(F.col("tube_id"), F.col("seq")),
                F.concat(_n("XSECT %.2f %.2f %.2f %.2f [", *[F.col(c) for c in "lrud"]), F.col("station"), F.lit("]")),
            )
        )
    return _union(*out)


ERROR_COLUMNS = ("from_stn", "to_stn", "n_legs", "length", "moved", "moved_per_leg", "percent", "E", "H", "V")


def write_traverse_errors(errors: DataFrame, path: str) -> None:
    """Traverse error report as CSV with a heading."""
    two = {"length", "moved", "moved_per_leg", "percent"}
    cols = [
        F.format_string("%.2f" if c in two else "%.6f", F.col(c)).alias(c) if c in two | {"E", "H", "V"} else F.col(c)
        for c in ERROR_COLUMNS
    ]
    errors.select(*cols).write.mode("overwrite").option("header", True).csv(path)
