"""Queries: projections, cleaning and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from raingrid.functions import values as V
from raingrid.operators import clean as C
from raingrid.plans import series as S
from raingrid.plans.registry import query


def _coded(spark, sf):
    day = F.dayofmonth("ds") % 7
    return S.e1(spark, sf).withColumn(
        "raw", F.when(day == 0, 8888.0).when(day == 1, 9999.0).otherwise(F.col("value")))


CODED = S.E1 + """, coded AS (SELECT *, CASE day(ds) % 7 WHEN 0 THEN 8888.0 WHEN 1 THEN 9999.0
  ELSE value END AS raw FROM e1)"""


@query("sentinel_to_null", f"""WITH {CODED} SELECT series, ds, raw,
  CASE WHEN raw NOT IN (8888, 9999) THEN raw END AS cleaned FROM coded""")
def sentinel_to_null(spark, sf):
    return _coded(spark, sf).select(
        "series", "ds", "raw", V.sentinel_to_null(F.col("raw")).alias("cleaned"))


def _tokens(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1)
    n = k.cast("int") % 10
    return S.table(spark, sf, "events").select("event_id", (
        F.when(n == 0, " - ").when(n == 1, "nan").when(n == 2, "NULL").when(n == 3, "")
        .when(n == 4, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit(" "), k))).alias("token"))


TOKENS = """tok AS (SELECT event_id, CASE CAST(k AS INTEGER) % 10 WHEN 0 THEN ' - '
  WHEN 1 THEN 'nan' WHEN 2 THEN 'NULL' WHEN 3 THEN '' WHEN 4 THEN 'x' || k ELSE ' ' || k END AS token
  FROM (SELECT event_id, regexp_extract(props, '(\\d+)', 1) AS k FROM events))"""


@query("text_missing_to_null", f"""WITH {TOKENS} SELECT event_id, token,
  CASE WHEN trim(token) NOT IN ('-', 'nan', 'NaN', 'NULL', '') THEN trim(token) END AS cleaned
  FROM tok""")
def text_missing_to_null(spark, sf):
    return _tokens(spark, sf).withColumn("cleaned", V.text_missing_to_null(F.col("token")))


@query("coerce_numeric", f"""WITH {TOKENS} SELECT event_id, CASE WHEN token <> 'nan'
  THEN TRY_CAST(trim(token) AS DOUBLE) END AS number FROM tok""")
def coerce_numeric(spark, sf):
    return _tokens(spark, sf).select("event_id", V.coerce_numeric(F.col("token")).alias("number"))


@query("parse_date_multi", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3
  THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def parse_date_multi(spark, sf):
    kind = F.col("o_orderkey") % 4
    text = (F.when(kind == 0, F.date_format("o_orderdate", "dd-MM-yyyy"))
            .when(kind == 1, F.date_format("o_orderdate", "yyyyMMdd HHmm"))
            .when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .otherwise(F.lit("no date")))
    formats = ("dd-MM-yyyy", "yyyyMMdd HHmm", "yyyy-MM-dd")
    return S.table(spark, sf, "orders").select(
        "o_orderkey", V.parse_date_multi(text, formats).alias("parsed"))


@query("date_from_parts", """SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate),
  day(o_orderdate)) AS built FROM orders""")
def date_from_parts(spark, sf):
    d = F.col("o_orderdate")
    parts = S.table(spark, sf, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"))
    return C.date_from_parts(parts, "y", "m", "d", "built").select("o_orderkey", "built")


@query("date_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day,
  CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year,
  CAST(quarter(o_orderdate) AS INTEGER) AS quarter, monthname(o_orderdate) AS month_name
  FROM orders""")
def date_parts(spark, sf):
    rows = S.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ds"))
    return C.date_parts(rows).drop("ds")


@query("season", f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS ds, count(*) AS n
  FROM orders GROUP BY 1) SELECT ds, n, {S.season_sql('ds', 'two_sep')} AS two_sep,
  {S.season_sql('ds', 'two_oct')} AS two_oct, {S.season_sql('ds', 'quarters')} AS quarters,
  {S.season_sql('ds', 'binned')} AS binned, {S.season_sql('ds', 'farm')} AS farm FROM d""")
def season(spark, sf):
    days = S.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("ds")).agg(
        F.count(F.lit(1)).alias("n"))
    schemes = ("two_sep", "two_oct", "quarters", "binned", "farm")
    return days.select("ds", "n", *[V.season(F.col("ds"), s).alias(s) for s in schemes])


@query("select_order_rename", """SELECT CAST(o_orderdate AS DATE) AS "Tanggal",
  CAST(year(o_orderdate) AS INTEGER) AS "Year", CAST(month(o_orderdate) AS INTEGER) AS "Month",
  CAST(day(o_orderdate) AS INTEGER) AS "Day", o_totalprice AS "RAD", o_totalprice / 10 AS "TEMP_10m",
  o_totalprice / 20 AS "TEMP_20m", o_totalprice / 100 AS "TEMP_100m", o_totalprice / 2 AS "WSPD",
  o_orderpriority AS "Location" FROM orders""")
def select_order_rename(spark, sf):
    p = F.col("o_totalprice")
    rows = S.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("Location"), (p / 2).alias("WSPD"),
        (p / 100).alias("TEMP_100m"), (p / 20).alias("TEMP_20m"), (p / 10).alias("TEMP_10m"),
        p.alias("RAD"), F.to_date("o_orderdate").alias("Date"))
    return C.order_columns(rows).withColumnRenamed("Date", "Tanggal")


@query("filter_global_range", """SELECT o_orderkey, o_totalprice FROM orders
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'""")
def filter_global_range(spark, sf):
    return C.filter_global_range(
        S.table(spark, sf, "orders"), "1996-03-01", "1997-02-28", "o_orderdate",
    ).select("o_orderkey", "o_totalprice")


def _e2_three(spark, sf):
    v, u = F.col("value"), F.col("series").cast("int")
    d = F.dayofmonth("ds")
    return S.e2_grid(spark, sf).select(
        "series", "ds", v.alias("a"), F.when(d % 3 != 0, v).alias("b"),
        F.when(u % 2 == 0, v).alias("c"))


E2_THREE = S.E2G + """, three AS (SELECT series, ds, value AS a,
  CASE WHEN day(ds) % 3 <> 0 THEN value END AS b,
  CASE WHEN CAST(series AS INTEGER) % 2 = 0 THEN value END AS c FROM e2g)"""


@query("drop_all_null", f"""WITH {E2_THREE} SELECT * FROM three
  WHERE NOT (a IS NULL AND b IS NULL AND c IS NULL)""")
def drop_all_null(spark, sf):
    return C.drop_all_null(_e2_three(spark, sf), ["a", "b", "c"])


@query("drop_thresh", f"""WITH {E2_THREE} SELECT * FROM three
  WHERE CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT) >= 2""")
def drop_thresh(spark, sf):
    return C.drop_thresh(_e2_three(spark, sf), 2, ["a", "b", "c"])


@query("clip", f"""WITH {S.E1} SELECT series, ds, value,
  CASE WHEN value < 35 THEN 35 WHEN value > 60 THEN 60 ELSE value END AS both_sides,
  CASE WHEN value < 40 THEN 40 ELSE value END AS lower_only FROM e1""")
def clip(spark, sf):
    v = F.col("value")
    return S.e1(spark, sf).withColumns(
        {"both_sides": V.bound(v, 35, 60), "lower_only": V.bound(v, low=40)})


@query("cap_with_mean", f"""WITH {S.E1} SELECT series, ds, value,
  round(CASE WHEN value > 60 THEN avg(value) OVER (PARTITION BY series) ELSE value END, 6) AS capped
  FROM e1""")
def cap_with_mean(spark, sf):
    return C.cap_with_mean(S.e1(spark, sf), 60.0).withColumn("capped", F.round("capped", 6))


@query("outliers_to_median", f"""WITH {S.E1}, q AS (SELECT series, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM e1 GROUP BY 1)
  SELECT series, ds, value, round(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR
  value > q3 + 1.5 * (q3 - q1) THEN q2 ELSE value END, 6) AS capped FROM e1 JOIN q USING (series)""")
def outliers_to_median(spark, sf):
    return C.outliers_to_median(S.e1(spark, sf), 1.5).withColumn("capped", F.round("capped", 6))


@query("narrow_integral", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity,
  l_discount FROM lineitem""")
def narrow_integral(spark, sf):
    rows = S.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return C.narrow_integral(rows, ["l_quantity", "l_discount"])


@query("missing_flag", f"""WITH {S.E2G} SELECT series, ds, value,
  CAST(value IS NULL AS INTEGER) AS is_missing FROM e2g""")
def missing_flag(spark, sf):
    return S.e2_grid(spark, sf).withColumn("is_missing", V.missing_flag(F.col("value")))


@query("count_equal_negative", """SELECT event_type, count(*) FILTER (floor(value) = 8) AS n_equal,
  count(*) FILTER (value - 20 < 0) AS n_negative FROM events GROUP BY 1""")
def count_equal_negative(spark, sf):
    v = F.col("value")
    return S.table(spark, sf, "events").groupBy("event_type").agg(
        C.count_equal(F.floor(v), 8).alias("n_equal"),
        C.count_negative(v - 20).alias("n_negative"))
