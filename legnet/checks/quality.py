"""Data-quality rules Q1-Q25."""

from __future__ import annotations

from pyspark.sql import functions as F

from legnet.checks.scalars import _no_counts
from legnet.checks.tables import settings_view, tv2_legs, xsects_view
from legnet.checks.scalars import COMPASS_STEPS, names_view, NAMES_SQL
from legnet.checks.views import r, table, view, with_views
from legnet.operators import aggregates as A
from legnet.operators import graph as GR
from legnet.operators import joins as J
from legnet.operators import quality as Q
from legnet.operators.reduce import Calibration

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def line(rule, severity, station="NULL", reading="NULL", detail="NULL"):
    """Select list of one rule's rows."""
    s = f"'{severity}'" if severity in ("error", "warning") else severity
    return (
        f"'{rule}' AS rule, {s} AS severity, CAST({station} AS VARCHAR) AS station, "
        f"CAST({reading} AS BIGINT) AS reading_id, CAST({detail} AS VARCHAR) AS detail"
    )


def readings(spark, sf):
    return _no_counts(view(spark, sf, "tv1"))


@query("q1_same_station", with_views(f"SELECT {line('Q1', 'error', 'from_stn', 'reading_id')} FROM (SELECT reading_id, replace(from_stn, 'p', 's') AS from_stn, to_stn FROM tv1) t WHERE from_stn = to_stn", "tv1"))
def q1(spark, sf):
    legs = view(spark, sf, "tv1").withColumn("from_stn", F.regexp_replace("from_stn", "p", "s"))
    return Q.same_station(legs)


def fixes(spark, sf):
    c = table(spark, sf, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".0"))
    k = F.col("c_custkey")
    base = c.select(name.alias("station"), "c_custkey", (k * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    again = base.where(k % 5 == 0).withColumn("x", F.when(k % 10 == 0, F.col("x")).otherwise(F.col("x") + 1))
    return base.unionByName(again)


@query("q2_unused_fixes", f"SELECT {line('Q2', 'warning', '''concat('c', CAST(c_custkey AS VARCHAR), '.0')''')} FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 4 <> 0) AND c_custkey % 3 <> 0")
def q2(spark, sf):
    f = fixes(spark, sf)
    eq = f.where(F.col("c_custkey") % 3 == 0).select(F.col("station").alias("a"), F.lit("elsewhere").alias("b"))
    return Q.unused_fixes(f, tv2_legs(spark, sf).where(F.col("cust") % 4 != 0), eq)


@query("q3_fixed_twice", f"""SELECT {line('Q3', "CASE WHEN c_custkey % 10 = 0 THEN 'warning' ELSE 'error' END", "concat('c', CAST(c_custkey AS VARCHAR), '.0')", 'NULL', "CASE WHEN c_custkey % 10 = 0 THEN 'same coordinates' ELSE 'different coordinates' END")} FROM customer WHERE c_custkey % 5 = 0""")
def q3(spark, sf):
    return Q.fixed_twice(fixes(spark, sf))


@query("q4_equated_fixes", f"""SELECT {line('Q4', 'error', "concat('n', CAST(c_nationkey AS VARCHAR))", 'NULL', "'different coordinates'")} FROM customer GROUP BY c_nationkey HAVING count(*) > 1""")
def q4(spark, sf):
    c = table(spark, sf, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".0"))
    classes = c.select(name.alias("station"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("class"))
    return Q.equated_fixes(fixes(spark, sf).where(F.col("x") == F.col("c_custkey")), classes)


@query("q5_self_equates", f"SELECT {line('Q5', 'warning', 'CAST(l_partkey AS VARCHAR)')} FROM lineitem WHERE l_partkey = l_suppkey")
def q5(spark, sf):
    return Q.self_equates(
        table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"))
    )


_A2 = "(radians(5e-1) * radians(5e-1))"


@query(
    "q6_disagreements",
    with_views(
        f"""WITH {COMPASS_STEPS.format(decl='0e0')}
 SELECT {line('Q6', 'warning', 'from_stn', 'reading_id', "'tape'")} FROM n1 WHERE pow((tape - backtape) / 3, 2) > 5e-3
 UNION ALL SELECT {line('Q6', 'warning', 'from_stn', 'reading_id', "'compass'")} FROM n1 WHERE pow(((cf - cb) - floor((cf - cb + pi()) / (2 * pi())) * 2 * pi()) / 3, 2) > 2 * {_A2}
 UNION ALL SELECT {line('Q6', 'warning', 'from_stn', 'reading_id', "'clino'")} FROM n1 WHERE pow((radians(clino) + radians(backclino)) / 3, 2) > 2 * {_A2}""",
        "tv1",
    ),
)
def q6(spark, sf):
    return Q.disagreements(readings(spark, sf))


@query("q7_suspicious_compass", with_views(f"""SELECT {line('Q7', 'warning', 'from_stn', 'reading_id', "'backcompass'")} FROM tv1 WHERE radians(backcompass) - 2 * pi() > 1e-6 OR backcompass < 0
 UNION ALL SELECT {line('Q7', 'warning', 'from_stn', 'reading_id', "'compass'")} FROM tv1 WHERE radians(compass) - 2 * pi() > 1e-6""", "tv1"))
def q7(spark, sf):
    return Q.suspicious_compass(readings(spark, sf))


@query("q8_steep_clino", with_views(f"""SELECT {line('Q8', 'warning', 'from_stn', 'reading_id', "'clino'")} FROM tv1 WHERE abs(clino * 4) > 90.0001
 UNION ALL SELECT {line('Q8', 'warning', 'from_stn', 'reading_id', "'backclino'")} FROM tv1 WHERE abs(backclino) > 90.0001""", "tv1"))
def q8(spark, sf):
    df = readings(spark, sf)
    return Q.steep_clino(df.withColumn("clino", F.col("clino") * 4))


@query("q9_negative_tape", with_views(f"SELECT {line('Q9', 'warning', 'from_stn', 'reading_id')} FROM tv1 WHERE CASE WHEN backtape IS NULL THEN tape - 10 ELSE (tape - 10 + backtape) / 2 END < 0", "tv1"))
def q9(spark, sf):
    return Q.negative_tape(readings(spark, sf), Calibration({"length": {"zero": 10.0}}))


@query("q10_tape_under_depth", with_views(f"SELECT {line('Q10', 'warning', 'from_stn', 'reading_id')} FROM tv1 WHERE tape < abs(to_depth - from_depth)", "tv1"))
def q10(spark, sf):
    return Q.tape_under_depth(readings(spark, sf).drop("backtape"))


@query(
    "q11_q13_rejected_readings",
    with_views(
        f"""SELECT {line('Q11', 'error', 'from_stn', 'reading_id', "'tape missing'")} FROM tv1 WHERE l_orderkey % 11 = 0
 UNION ALL SELECT {line('Q13', 'error', 'from_stn', 'reading_id', "CASE WHEN l_orderkey % 5 = 0 THEN 'clino types differ' ELSE 'plumbed in same direction' END")} FROM tv1 WHERE l_orderkey % 11 <> 0 AND (l_orderkey % 5 = 0 OR l_orderkey % 5 = 1)
 UNION ALL SELECT {line('Q11', 'error', 'from_stn', 'reading_id', "'compass missing'")} FROM tv1 WHERE l_orderkey % 11 <> 0 AND l_orderkey % 5 > 1 AND l_orderkey % 7 = 0""",
        "tv1",
    ),
)
def q11(spark, sf):
    k = F.col("l_orderkey")
    df = readings(spark, sf).drop("backtape", "backcompass", "backclino").withColumns(
        {
            "tape": F.when(k % 11 != 0, F.col("tape")),
            "compass": F.when(k % 7 != 0, F.col("compass")),
            "clino_token": F.when(k % 5 < 2, "UP").when(k % 5 == 2, "LEVEL"),
            "backclino_token": F.when(k % 5 == 0, "3").when(k % 5 == 1, "U"),
        }
    )
    return Q.rejected_readings(df)


@query("q12_compass_on_plumb", with_views(f"SELECT {line('Q12', 'warning', 'from_stn', 'reading_id')} FROM tv1 WHERE l_orderkey % 4 = 0 OR (l_orderkey % 4 = 1 AND l_linenumber % 2 = 0)", "tv1"))
def q12(spark, sf):
    k = F.col("l_orderkey") % 4
    df = readings(spark, sf).drop("backtape", "backcompass", "backclino", "clino").withColumns(
        {
            "compass": F.when((k == 1) & (F.col("l_linenumber") % 2 != 0), 0.0).otherwise(F.col("compass")),
            "clino_token": F.when(k == 0, "UP").when(k == 1, "-90").when(k == 2, "5"),
        }
    )
    return Q.compass_on_plumb(df, infer_plumbs=True)


@query("q14_never_used", f"""SELECT {line('Q14', 'warning', "concat('c', CAST(c_custkey AS VARCHAR), '.0')", 'NULL', "'entrance'")} FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 4 <> 0)""")
def q14(spark, sf):
    return Q.never_used(fixes(spark, sf), tv2_legs(spark, sf).where(F.col("cust") % 4 != 0), "entrance")


@query("q15_not_exported", f"WITH {NAMES_SQL} SELECT {line('Q15', 'error', 'name', 'NULL', '''CASE WHEN o_orderkey % 4 = 0 THEN '2' ELSE '1' END''')} FROM tv4 WHERE (o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0) OR (o_orderkey % 4 = 1 AND o_orderkey % 5 <> 0)")
def q15(spark, sf):
    from legnet.functions import names as N

    n, k = F.col("name"), F.col("o_orderkey")
    s = names_view(spark, sf)
    own = s.select(n.alias("station"), N.survey_of(n).alias("scope"))
    outer = s.where(k % 4 < 2).select(
        n.alias("station"), F.when(k % 4 == 0, "").otherwise(N.survey_of(N.survey_of(n))).alias("scope")
    )
    exports = s.where(k % 3 == 0).select(n.alias("station"), F.when(k % 4 == 0, 2).otherwise(0).alias("levels"))
    exports = exports.unionByName(s.where(k % 5 == 0).select(n.alias("station"), F.when(k % 4 == 1, 1).otherwise(0).alias("levels")))
    return Q.not_exported(A.export_depth(own.unionByName(outer)), exports)


@query("q16_probable_typos", f"SELECT {line('Q16', 'warning', 'CAST(l_orderkey AS VARCHAR)')} FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1 AND max(l_linenumber % 2) = 1")
def q16(spark, sf):
    return Q.probable_typos(
        table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("station"), (F.col("l_linenumber") % 2 == 1).alias("explicit"))
    )


@query("q17_station_and_survey", f"WITH {NAMES_SQL} SELECT DISTINCT {line('Q17', 'error', '''concat(split_part(name, '.', 1), '.', split_part(name, '.', 2))''')} FROM tv4 WHERE o_orderkey % 50 = 0")
def q17(spark, sf):
    from legnet.functions import names as N

    s = names_view(spark, sf)
    both = s.select("name").unionByName(
        s.where(F.col("o_orderkey") % 50 == 0).select(N.survey_of(F.col("name")).alias("name"))
    )
    return Q.station_and_survey(both)


@query("q18_bad_dates", f"""SELECT {line('Q18', "CASE WHEN o_orderkey % 5 = 2 THEN 'error' ELSE 'warning' END", 'NULL', 'o_orderkey', "CASE o_orderkey % 5 WHEN 0 THEN 'invalid day' WHEN 1 THEN 'invalid month' WHEN 2 THEN 'range reversed' ELSE 'date in the future' END")}
 FROM orders WHERE o_orderkey % 5 <= 2 OR (o_orderkey % 5 = 3 AND year(o_orderdate) > 1998)""")
def q18(spark, sf):
    k = F.col("o_orderkey") % 5
    year = F.date_format("o_orderdate", "yyyy")
    text = (
        F.when(k == 0, F.concat(year, F.lit(".02.30")))
        .when(k == 1, F.concat(year, F.lit(".14")))
        .when(k == 2, F.concat(year, F.lit(".03-"), (F.year("o_orderdate") - 1).cast("string")))
        .when(k == 3, F.date_format("o_orderdate", "yyyy"))
    )
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("reading_id"), text.alias("date_text"))
    return Q.bad_dates(df.where(F.col("date_text").isNotNull()), "1998-12-31")


@query("q19_unknown_xsects", f"SELECT {line('Q19', 'error', '''concat('p', CAST(l_partkey AS VARCHAR))''')} FROM lineitem WHERE l_partkey % 4 = 0")
def q19(spark, sf):
    known = view(spark, sf, "tvs").where(F.col("k") % 4 != 0)
    return Q.unknown_xsects(J.place_xsects(xsects_view(spark, sf), known)[1])


@query("q20_unattached", with_views(f"SELECT DISTINCT {line('Q20', 'warning', 'name')} FROM (SELECT cust, from_stn AS name FROM tv2 UNION SELECT cust, to_stn FROM tv2) t WHERE cust % 2 = 0", "tv2"))
def q20(spark, sf):
    legs = tv2_legs(spark, sf)
    named = GR.component_names(legs)
    fixed = legs.where(F.col("cust") % 2 == 1).select(
        F.concat(F.lit("c"), F.col("cust").cast("string"), F.lit(".1")).alias("name")
    ).distinct()
    return Q.unattached(GR.hanging(named, fixed))


@query("q21_anonymous_legs", with_views(f"SELECT {line('Q21', 'error', 'NULL', 'reading_id')} FROM tv1 WHERE l_linenumber = 1 AND l_suppkey % 3 = 0", "tv1"))
def q21(spark, sf):
    df = view(spark, sf, "tv1").withColumns(
        {
            "from_stn": F.when(F.col("l_linenumber") == 1, "..").otherwise(F.col("from_stn")),
            "to_stn": F.when(F.col("l_suppkey") % 3 == 0, "...").otherwise(F.col("to_stn")),
        }
    )
    return Q.anonymous_legs(df)


@query("q22_bad_settings", f"""SELECT {line('Q22', 'error', "concat('N', CAST(c_nationkey AS VARCHAR), '.c', CAST(c_custkey AS VARCHAR))", 'NULL', "CASE WHEN c_custkey % 3 = 0 THEN 'length: standard deviation not positive' ELSE 'length: unit is zero' END")} FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 3 = 0 OR c_custkey % 5 = 0)""")
def q22(spark, sf):
    k = F.col("zero") / 1000
    inner = F.col("scope").contains(".c")
    df = settings_view(spark, sf).withColumns(
        {
            "sd": F.when(inner & (k % 3 == 0), 0.0).otherwise(F.col("sd")),
            "unit": F.when(inner & (k % 5 == 0), 0.0).otherwise(F.col("unit")),
        }
    )
    return Q.bad_settings(df)


@query("q23_missing_columns", with_views(f"""SELECT {line('Q23', 'error', 'from_stn', 'reading_id', "'tape'")} FROM tv1 WHERE l_linestatus = 'O' AND l_orderkey % 3 = 0
 UNION ALL SELECT {line('Q23', 'error', 'from_stn', 'reading_id', "d")} FROM tv1, (SELECT unnest(['dx', 'dy', 'dz']) AS d) u WHERE l_linestatus <> 'O'""", "tv1"))
def q23(spark, sf):
    df = readings(spark, sf).withColumns(
        {
            "style": F.when(F.col("l_linestatus") == "O", "NORMAL").otherwise("CARTESIAN"),
            "tape": F.when(F.col("l_orderkey") % 3 != 0, F.col("tape")),
        }
    )
    return Q.missing_columns(df)


@query("q24_infer_equates", with_views("""SELECT from_stn AS a, to_stn AS b, 'equate' AS kind, CAST(count(*) AS BIGINT) AS n FROM tv1 WHERE l_orderkey % 4 = 0 AND l_linenumber % 3 <> 0 GROUP BY 1, 2
 UNION ALL SELECT NULL, NULL, 'reading', count(*) FROM tv1 WHERE NOT (l_orderkey % 4 = 0 AND l_linenumber % 3 <> 0)""", "tv1"))
def q24(spark, sf):
    df = readings(spark, sf).withColumns(
        {"tape": F.when(F.col("l_orderkey") % 4 != 0, F.col("tape")), "to_depth": F.col("from_depth")}
    )
    rest, equates = Q.infer_equates(df)
    none = F.lit(None).cast("string")
    return equates.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b", F.lit("equate").alias("kind"), "n").unionByName(
        rest.agg(F.count(F.lit(1)).alias("n")).select(none.alias("a"), none.alias("b"), F.lit("reading").alias("kind"), "n")
    )


@query("q25_gate", "SELECT CAST(count(*) AS BIGINT) AS passed_clean, CAST(0 AS BIGINT) AS passed_bad FROM orders")
def q25(spark, sf):
    o = table(spark, sf, "orders")
    legs = tv2_legs(spark, sf)
    clean = Q.gated(o, Q.same_station(legs))
    bad = Q.gated(o, Q.fixed_twice(fixes(spark, sf)))
    return clean.agg(F.count(F.lit(1)).alias("passed_clean")).crossJoin(
        bad.agg(F.count(F.lit(1)).alias("passed_bad"))
    )
