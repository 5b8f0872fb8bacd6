"""Survey tables derived from the given tables, as SQL text for both engines.

The same text runs in Spark and in DuckDB, so a registered query and its check
start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from legnet.plans.session import tune

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Readings with every kind of column: each line item is a leg from a part to a
# supplier. About a third of the rows carry back readings.
TV1 = """
SELECT l_orderkey * 10 + l_linenumber AS reading_id,
       concat('b', CAST(l_suppkey % 10 AS STRING), '.', l_returnflag) AS scope,
       concat('p', CAST(l_partkey AS STRING)) AS from_stn,
       concat('s', CAST(l_suppkey AS STRING)) AS to_stn,
       l_quantity + 1.7e-1 AS tape,
       CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 36000 AS DOUBLE) / 1e2 + 3.7e-3 AS compass,
       (l_discount - 4.9e-2) * 6e2 AS clino,
       CASE WHEN l_linenumber % 3 = 0 THEN l_quantity + 1.7e-1 + (l_tax - 3.91e-2) * 1e1 END AS backtape,
       CASE WHEN l_linenumber % 2 = 0 THEN CAST((CAST(ROUND(l_extendedprice * 100) AS BIGINT) + 18000) % 36000 AS DOUBLE) / 1e2 + 3.7e-3 + (l_tax + 1.13e-2) * 3e1 END AS backcompass,
       CASE WHEN l_linenumber % 2 = 0 THEN (4.9e-2 - l_discount) * 6e2 + (l_tax - 3.91e-2) * 6e1 END AS backclino,
       l_quantity * -3e-1 AS from_depth,
       l_quantity * -3e-1 + (l_discount - 4.9e-2) * 2.3e1 * l_quantity AS to_depth,
       l_tax * 1e3 + 1e2 AS from_count, l_tax * 1e3 + 1e2 + l_quantity AS to_count,
       CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 0
            ELSE 4 * CAST(l_linenumber % 2 AS INT) END AS flags,
       CAST(l_shipdate AS DATE) AS date1,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
       l_returnflag, l_linestatus
FROM lineitem
"""

# Gap of a closed chain. Its digits keep adjusted coordinates, sums of whole hundredths
# and shares of this gap, from ending on a half, where the order of a sum would decide.
GAP = {"x": "3.1830988618379e-1", "y": "-2.0371832715763e-1", "z": "1.0610329539460e-1"}

# Chains per customer in date order; even customers with three or more orders
# close their chain with a misclosure of GAP.
TV2 = f"""
WITH o AS (
  SELECT o_custkey AS cust, o_orderkey AS leg_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
         count(*) OVER (PARTITION BY o_custkey) AS n,
         CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 9973 AS DOUBLE) / 1e2 - 5e1 AS dx,
         CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 7919 AS DOUBLE) / 1e2 - 4e1 AS dy,
         CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 1009 AS DOUBLE) / 1e2 - 5e0 AS dz,
         CAST(o_orderdate AS DATE) AS date1
  FROM orders),
open_legs AS (
  SELECT cust, leg_id, seq, seq - 1 AS a, seq AS b, dx, dy, dz,
         1e-3 + 1e-4 * abs(dx) AS vx, 1e-3 + 1e-4 * abs(dy) AS vy, 1e-3 + 2e-4 * abs(dz) AS vz,
         date1
  FROM o),
closing AS (
  SELECT cust, -cust - 1 AS leg_id, n + 1 AS seq, n AS a, CAST(0 AS BIGINT) AS b,
         {GAP['x']} - sum(dx) AS dx, {GAP['y']} - sum(dy) AS dy, {GAP['z']} - sum(dz) AS dz,
         2e-3 AS vx, 2e-3 AS vy, 4e-3 AS vz, max(date1) AS date1
  FROM o WHERE cust % 2 = 0 AND n >= 3 GROUP BY cust, n)
SELECT cust, leg_id, seq, a, b, concat('c', CAST(cust AS STRING), '.', CAST(a AS STRING)) AS from_stn,
       concat('c', CAST(cust AS STRING), '.', CAST(b AS STRING)) AS to_stn, dx, dy, dz, vx, vy, vz, date1
FROM (SELECT * FROM open_legs UNION ALL SELECT * FROM closing) u
"""

# Rings on a stick: as TV2, but a closed chain comes back to station 1, so leg 1
# is a bridge to the fixed point.
TV2B = TV2.replace("CAST(0 AS BIGINT) AS b", "CAST(1 AS BIGINT) AS b")
for _axis in "xyz":
    TV2B = TV2B.replace(f"sum(d{_axis})", f"sum(CASE WHEN seq > 1 THEN d{_axis} ELSE 0e0 END)")

# One large consistent network on the station pairs of TV1: every station has a
# position by formula and legs are exact differences of these.
_POS = {
    "x": "CAST(({k} * 7919 + {s}) % 10007 AS DOUBLE) / 1e1",
    "y": "CAST(({k} * 6101 + {s}) % 9973 AS DOUBLE) / 1e1",
    "z": "CAST(({k} * 104 + {s}) % 997 AS DOUBLE) / 1e1",
}


def position_formula(axis: str, key: str, shift: int) -> str:
    return _POS[axis].format(k=key, s=shift)


TV3 = "\n".join(
    [
        "SELECT l_orderkey * 10 + l_linenumber AS leg_id,",
        "       concat('p', CAST(l_partkey AS STRING)) AS from_stn,",
        "       concat('s', CAST(l_suppkey AS STRING)) AS to_stn,",
        *[
            f"       {position_formula(a, 'l_suppkey', 500)} - {position_formula(a, 'l_partkey', 0)} AS d{a},"
            for a in "xyz"
        ],
        "       1e-2 + 1e-4 * l_quantity AS vx, 1e-2 + 2e-4 * l_quantity AS vy,",
        "       2e-2 + 1e-4 * l_quantity AS vz",
        "FROM lineitem",
    ]
)

# Stations of TV3 with their formula positions and some flag bits.
def _stations(prefix: str, key: str, shift: int, source: str) -> str:
    pos = ", ".join(f"{position_formula(a, key, shift)} AS {a}" for a in "xyz")
    return (
        f"SELECT concat('{prefix}', CAST({key} AS STRING)) AS name, {key} AS k, {pos}, "
        f"CAST(CASE WHEN {key} % 3 = 0 THEN 1 ELSE 2 END + CASE WHEN {key} % 7 = 0 THEN 4 ELSE 0 END "
        f"+ CASE WHEN {key} % 5 = 0 THEN 8 ELSE 0 END + CASE WHEN {key} % 11 = 0 THEN 16 ELSE 0 END "
        f"+ CASE WHEN {key} % 13 = 0 THEN 32 ELSE 0 END AS INT) AS sflags FROM {source}"
    )


TVS = (
    _stations("p", "p_partkey", 0, "part")
    + " UNION ALL "
    + _stations("s", "s_suppkey", 500, "supplier")
)

_LEGS_OF = TV2[TV2.index("WITH o AS (") : TV2.index("open_legs AS (")].rstrip().rstrip(",")
_VARIANCES = "1e-3 + 1e-4 * abs(dx) AS vx, 1e-3 + 1e-4 * abs(dy) AS vy, 1e-3 + 2e-4 * abs(dz) AS vz"

# Three chains per customer with three or more orders, from a pinned station P to a
# free one J; their sums differ, so J is a real unknown.
TV4 = _LEGS_OF + f""",
c AS (
  SELECT *, seq % 3 AS ch, row_number() OVER (PARTITION BY cust, seq % 3 ORDER BY seq) AS k,
         count(*) OVER (PARTITION BY cust, seq % 3) AS len
  FROM o WHERE n >= 3)
SELECT cust, leg_id, ch, k, len, dx, dy, dz, {_VARIANCES},
       concat('t', CAST(cust AS STRING), CASE WHEN k = 1 THEN '.P' ELSE concat('.', CAST(ch AS STRING), '.', CAST(k - 1 AS STRING)) END) AS from_stn,
       concat('t', CAST(cust AS STRING), CASE WHEN k = len THEN '.J' ELSE concat('.', CAST(ch AS STRING), '.', CAST(k AS STRING)) END) AS to_stn
FROM c
"""

# A triangle with its centre per customer with six or more orders: the centre O is
# pinned, the corners A, B and C are free and no loop closes.
TV5 = _LEGS_OF + f"""
SELECT cust, leg_id, seq, dx, dy, dz, {_VARIANCES},
       concat('m', CAST(cust AS STRING), '.', CASE seq WHEN 4 THEN 'A' WHEN 5 THEN 'B' WHEN 6 THEN 'C' ELSE 'O' END) AS from_stn,
       concat('m', CAST(cust AS STRING), '.', CASE seq WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'B' WHEN 5 THEN 'C' ELSE 'A' END) AS to_stn
FROM o WHERE n >= 6 AND seq <= 6
"""

VIEWS = {"tv4": TV4, "tv5": TV5, "tv1": TV1, "tv2": TV2, "tv2b": TV2B, "tv3": TV3, "tvs": TVS}


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived survey table as a DataFrame."""
    tune(spark)
    sources = {"tvs": ("part", "supplier"), "tv1": ("lineitem",), "tv3": ("lineitem",)}
    register(spark, sf_dir, *sources.get(name, ("orders",)))
    return spark.sql(VIEWS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """SQL text with the derived tables it uses defined in front."""
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {heads}, {sql.lstrip()[5:]}"
    return f"WITH {heads} {sql}"


def r(expr: str, digits: int = 6) -> str:
    """Rounded value without a negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0e0 ELSE round({expr}, {digits}) END"
