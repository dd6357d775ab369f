"""Queries: joins, grids and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from raingrid.operators import align as A
from raingrid.plans import series as S
from raingrid.plans.registry import query


def _three_frames(spark, sf):
    base = S.e1(spark, sf)
    day = F.dayofmonth("ds")
    return {
        "sst": base.where(day % 2 == 0),
        "rain": base.where(day % 3 == 0).withColumn("value", F.col("value") * 2),
        "wind": base.where((day % 5 != 0) | (day % 2 == 1)).withColumn("value", F.col("value") + 1),
    }


THREE = S.E1 + """, sst AS (SELECT * FROM e1 WHERE day(ds) % 2 = 0),
rain AS (SELECT series, ds, value * 2 AS value FROM e1 WHERE day(ds) % 3 = 0),
wind AS (SELECT series, ds, value + 1 AS value FROM e1 WHERE day(ds) % 5 <> 0 OR day(ds) % 2 = 1)"""


@query("outer_merge", f"""WITH {THREE} SELECT series, ds, sst.value AS sst, rain.value AS rain,
  wind.value AS wind FROM sst FULL OUTER JOIN rain USING (series, ds)
  FULL OUTER JOIN wind USING (series, ds)""")
def outer_merge(spark, sf):
    return A.outer_merge(_three_frames(spark, sf))


@query("complete_grid", f"WITH {S.E2G} SELECT series, ds, value FROM e2g")
def complete_grid(spark, sf):
    return S.e2_grid(spark, sf)


LIMITS = {"1-URGENT": ("1996-01-01", "1997-12-31"), "2-HIGH": ("1998-05-05", "1998-06-30"),
          "5-LOW": ("1995-01-01", "2000-01-01")}
LIMITS_SQL = "lim AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in LIMITS.items()) + ") t(series, a, b))"


@query("complete_grid_ranges", f"""WITH {S.O1}, {LIMITS_SQL}, g AS (SELECT series,
  CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)
  AS ds FROM lim) SELECT series, ds, value FROM g LEFT JOIN o1 USING (series, ds)""")
def complete_grid_ranges(spark, sf):
    ranges = spark.createDataFrame(
        [(k, a, b) for k, (a, b) in LIMITS.items()], "series string, a string, b string",
    ).select("series", F.to_date("a").alias("start"), F.to_date("b").alias("end"))
    return A.complete_grid(S.o1(spark, sf), ranges=ranges)


@query("union_index_join", f"""WITH {THREE}, days AS (SELECT series, ds FROM sst UNION
  SELECT series, ds FROM rain UNION SELECT series, ds FROM wind)
  SELECT series, ds, CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month,
  CAST(day(ds) AS INTEGER) AS day, sst.value AS sst, rain.value AS rain, wind.value AS wind
  FROM days LEFT JOIN sst USING (series, ds) LEFT JOIN rain USING (series, ds)
  LEFT JOIN wind USING (series, ds)""")
def union_index_join(spark, sf):
    return A.union_index_join(_three_frames(spark, sf))


@query("nearest_within", f"""WITH {S.E2G}, k AS (SELECT *, date_diff('day', d, ds) AS back FROM
  (SELECT series, ds, value,
    last_value(CASE WHEN value IS NOT NULL THEN ds END IGNORE NULLS) OVER f AS d,
    last_value(value IGNORE NULLS) OVER f AS pv,
    last_value(CASE WHEN value IS NOT NULL THEN ds END IGNORE NULLS) OVER b AS d2,
    last_value(value IGNORE NULLS) OVER b AS nv FROM e2g
    WINDOW f AS (PARTITION BY series ORDER BY ds ROWS UNBOUNDED PRECEDING),
           b AS (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING)))
  SELECT series, ds, value, CASE WHEN back < 3 AND (d2 IS NULL OR back <= date_diff('day', ds, d2))
    THEN pv WHEN date_diff('day', ds, d2) < 3 THEN nv END AS filled FROM k""")
def nearest_within(spark, sf):
    return A.nearest_within(S.e2_grid(spark, sf), days=3)


@query("location_cutoffs", f"""WITH {S.O1}, {LIMITS_SQL} SELECT series, ds, value FROM o1
  JOIN lim USING (series) WHERE ds BETWEEN a AND b""")
def location_cutoffs(spark, sf):
    return A.location_cutoffs(S.o1(spark, sf), LIMITS)


def _hidden(spark, sf):
    """O1 on its grid, with every value hidden in March."""
    return S.o1_grid(spark, sf).withColumn(
        "value", F.when(F.month("ds") != 3, F.col("value")))


@query("stat_lookup", f"""WITH {S.O1G}, h AS (SELECT series, ds,
  CASE WHEN month(ds) <> 3 THEN value END AS value, {S.season_sql('ds', 'quarters')} AS q FROM o1g)
  SELECT series, ds, value, round(coalesce(value, avg(value) OVER (PARTITION BY series, month(ds)),
    avg(value) OVER (PARTITION BY series, q), avg(value) OVER (PARTITION BY series)), 2) AS filled
  FROM h""")
def stat_lookup(spark, sf):
    return A.stat_lookup(_hidden(spark, sf)).withColumn("filled", F.round("filled", 2))


@query("align_inner", f"""WITH {S.E1} SELECT a.series, a.ds, a.value AS actual, f.value AS forecast
  FROM e1 a JOIN e1 f ON f.series = a.series AND f.ds = a.ds - 7""".replace(
    "f.ds = a.ds - 7", "f.ds + 7 = a.ds"))
def align_inner(spark, sf):
    base = S.e1(spark, sf)
    return A.align_inner(base, base.withColumn("ds", F.date_add("ds", 7)))


@query("window_member", f"""WITH {S.M1}, wet AS (SELECT ds FROM m1 WHERE rr > 20)
  SELECT series, ds, rr, tavg, rh FROM m1 SEMI JOIN wet ON m1.ds = wet.ds""")
def window_member(spark, sf):
    days = S.m1(spark, sf)
    return A.window_member(days, days.where(F.col("rr") > 20).select("ds"))


@query("union_all", """SELECT CAST(o_orderdate AS DATE) AS ds, o_totalprice AS value,
  NULL::VARCHAR AS note FROM orders WHERE year(o_orderdate) < 1996
  UNION ALL SELECT CAST(o_orderdate AS DATE), o_totalprice, o_orderpriority FROM orders
  WHERE year(o_orderdate) >= 1996""")
def union_all(spark, sf):
    orders = S.table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("ds"), F.col("o_totalprice").alias("value"),
        F.col("o_orderpriority").alias("note"))
    first = orders.where(F.year("ds") < 1996).drop("note")
    return A.union_all(first, orders.where(F.year("ds") >= 1996))


@query("index_intersection", f"""WITH {S.E1} SELECT ds FROM e1 WHERE value > 45
  INTERSECT SELECT ds FROM e1 WHERE value <= 45""")
def index_intersection(spark, sf):
    days = S.e1(spark, sf)
    return A.index_intersection(days.where("value > 45"), days.where("value <= 45"))


@query("complete_grid_duplicates", f"""WITH dy AS (SELECT CAST(user_id AS VARCHAR) AS series,
  CAST(ts AS DATE) AS ds, max(value) AS value FROM events GROUP BY 1, 2),
  {S.grid_sql("dyg", "dy")} SELECT series, ds, value FROM dyg""")
def complete_grid_duplicates(spark, sf):
    """Several rows for a day: one grid row with their greatest value."""
    return A.complete_grid(S.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("series"), F.to_date("ts").alias("ds"), "value"))
