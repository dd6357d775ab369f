"""Daily and hourly series derived from the given tables, in Spark and in SQL.

Raw rows meet only in ``groupBy(series, day)`` aggregates, which Spark combines on
the map side. So a hot series sends one partial row per task and day, and what the
windows see afterwards is at most one row per series and calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raingrid.operators.align import complete_grid


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def exact_mean(col, scale: int):
    """Mean of two-decimal (or whole) numbers, cut to four decimals, in integers.

    Summing integers gives the same result in any order of tasks, so a series
    never differs in its last digit from run to run.
    """
    total = F.sum(F.round(F.col(col) * scale).cast("bigint"))
    return F.floor(total * (10000 // scale) / F.count(col)) / 10000


def e1(spark, sf):
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("ds"))
        .agg(exact_mean("value", 100).alias("value"))
    )


def e2(spark, sf):
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").cast("string").alias("series"), F.to_date("ts").alias("ds"))
        .agg(exact_mean("value", 100).alias("value"))
    )


def e2_grid(spark, sf):
    return complete_grid(e2(spark, sf))


def o1(spark, sf):
    """Whole currency units per day, so that sums of them are exact in any order."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("ds"))
        .agg(F.floor(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100)
             .cast("double").alias("value"))
    )


def o1_grid(spark, sf):
    return complete_grid(o1(spark, sf))


def l1(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("ds"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def m1(spark, sf):
    """One station per hundred customers, so stations grow with the data; days have gaps."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("c")
    station = F.concat(F.lit("S"), F.floor(F.col("o_custkey") / 100).cast("string"))
    daily = table(spark, sf, "orders").groupBy(
        station.alias("series"), F.to_date("o_orderdate").alias("ds")).agg(cents)
    return daily.select(
        "series",
        "ds",
        (F.pmod("c", F.lit(2500)) / 100).alias("rr"),
        (17 + F.pmod(F.floor(F.col("c") / 7), F.lit(2200)) / 100).alias("tavg"),
        (50 + F.pmod(F.floor(F.col("c") / 11), F.lit(4800)) / 100).alias("rh"),
    )


def m1_grid(spark, sf):
    return complete_grid(m1(spark, sf), values=("rr", "tavg", "rh"))


def m2(spark, sf):
    day = F.unix_date(F.col("ds")) % 7
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("ds"))
        .agg(F.max("l_quantity").alias("x"), F.min("l_quantity").alias("n"),
             exact_mean("l_quantity", 1).alias("a"))
        .select("series", "ds", F.when(day != 0, F.col("x")).alias("tx"),
                F.when(day != 1, F.col("n")).alias("tn"),
                F.when(day != 2, F.col("a")).alias("tavg"))
    )


def m3(spark, sf):
    hour = F.hour("ts")
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.round(F.max("value") % 360, 4).alias("d"),
             (exact_mean("value", 100) / 10).alias("f"))
        .select("series", F.to_date("ts").alias("ds"), hour.alias("hour"),
                F.when(hour % 5 != 0, F.col("d")).alias("direction"),
                F.when(hour % 5 != 1, F.col("f")).alias("speed"))
    )


def r1(spark, sf):
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", F.to_date("l_shipdate").alias("ds"))
    order = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return (
        line.join(order, line.l_orderkey == order.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .drop("o_orderkey", "p_partkey")
    )


# The same series as SQL common table expressions.
E1 = """e1 AS (SELECT event_type AS series, CAST(ts AS DATE) AS ds,
  floor(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 100 / count(value)) / 10000 AS value FROM events GROUP BY 1, 2)"""
E2 = """e2 AS (SELECT CAST(user_id AS VARCHAR) AS series, CAST(ts AS DATE) AS ds,
  floor(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 100 / count(value)) / 10000 AS value FROM events GROUP BY 1, 2)"""


def grid_sql(name: str, source: str, values=("value",)) -> str:
    cols = ", ".join(f"s.{v}" for v in values)
    return f"""{name} AS (SELECT g.series, g.ds, {cols} FROM
  (SELECT series, CAST(unnest(generate_series(CAST(min(ds) AS TIMESTAMP),
     CAST(max(ds) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds
   FROM {source} GROUP BY series) g
  LEFT JOIN {source} s ON s.series = g.series AND s.ds = g.ds)"""


E2G = E2 + ",\n" + grid_sql("e2g", "e2")
O1 = """o1 AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ds,
  CAST(floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"""
O1G = O1 + ",\n" + grid_sql("o1g", "o1")
L1 = """l1 AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS ds,
  sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"""
M1 = """m0 AS (SELECT 'S' || CAST(o_custkey // 100 AS VARCHAR) AS series, CAST(o_orderdate AS DATE) AS ds,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c FROM orders GROUP BY 1, 2),
m1 AS (SELECT series, ds, (c % 2500) / 100 AS rr,
  17 + (CAST(floor(c / 7) AS BIGINT) % 2200) / 100 AS tavg,
  50 + (CAST(floor(c / 11) AS BIGINT) % 4800) / 100 AS rh FROM m0)"""
M1G = M1 + ",\n" + grid_sql("m1g", "m1", ("rr", "tavg", "rh"))
M2 = """m2 AS (SELECT series, ds,
  CASE WHEN dn % 7 <> 0 THEN x END AS tx, CASE WHEN dn % 7 <> 1 THEN n END AS tn,
  CASE WHEN dn % 7 <> 2 THEN a END AS tavg FROM
  (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS ds,
     date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS dn,
     max(l_quantity) AS x, min(l_quantity) AS n, floor(CAST(sum(CAST(round(l_quantity * 1) AS BIGINT)) AS BIGINT) * 10000 / count(l_quantity)) / 10000 AS a
   FROM lineitem GROUP BY 1, 2, 3))"""
M3 = """m3 AS (SELECT series, CAST(h AS DATE) AS ds, CAST(hour(h) AS INTEGER) AS hour,
  CASE WHEN hour(h) % 5 <> 0 THEN d END AS direction,
  CASE WHEN hour(h) % 5 <> 1 THEN f END AS speed FROM
  (SELECT event_type AS series, date_trunc('hour', ts) AS h,
     round(max(value) % 360, 4) AS d, floor(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 100 / count(value)) / 10000 / 10 AS f
   FROM events GROUP BY 1, 2))"""
R1 = """r1 AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_returnflag, CAST(l_shipdate AS DATE) AS ds, o_totalprice, p_retailprice, p_size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def season_sql(col: str, scheme: str) -> str:
    from raingrid import fixed

    cases = " ".join(
        f"WHEN month({col}) IN ({', '.join(map(str, m))}) THEN '{n}'"
        for n, m in fixed.SEASONS[scheme].items())
    return f"CASE {cases} END"
