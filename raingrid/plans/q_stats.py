"""Queries: aggregations and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from raingrid.functions import values as V
from raingrid.operators import quality as Q
from raingrid.operators import stats as A
from raingrid.operators import windows as W
from raingrid.plans import series as S
from raingrid.plans.registry import query


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("resample_month", f"""WITH {S.O1} SELECT series, CAST(date_trunc('month', ds) AS DATE) AS period,
  round(avg(value), 6) AS value FROM o1 GROUP BY 1, 2""")
def resample_month(spark, sf):
    return rounded(A.resample(S.o1(spark, sf), "month"), 6, "value")


@query("resample_month_end", f"""WITH {S.O1} SELECT series, last_day(ds) AS period,
  round(avg(value), 6) AS value FROM o1 GROUP BY 1, 2""")
def resample_month_end(spark, sf):
    return rounded(A.resample(S.o1(spark, sf), "month", label="end"), 6, "value")


@query("resample_year", f"""WITH {S.O1} SELECT series, CAST(date_trunc('year', ds) AS DATE) AS period,
  round(avg(value), 2) AS mean, round(sum(value), 2) AS total FROM o1 GROUP BY 1, 2""")
def resample_year(spark, sf):
    rows = S.o1(spark, sf)
    year = F.trunc("ds", "year")
    return rounded(rows.groupBy("series", year.alias("period")).agg(
        F.avg("value").alias("mean"), F.sum("value").alias("total")), 2, "total").withColumn(
        "mean", F.round("mean", 2))


@query("month_climatology", f"""WITH {S.O1}, mm AS (SELECT series, date_trunc('month', ds) AS p,
  avg(value) AS v FROM o1 GROUP BY 1, 2), a AS (SELECT series, CAST(month(ds) AS INTEGER) AS month,
  avg(value) AS m FROM o1 GROUP BY 1, 2), b AS (SELECT series, CAST(month(p) AS INTEGER) AS month,
  avg(v) AS m FROM mm GROUP BY 1, 2) SELECT series, month, round(a.m, 2) AS of_days,
  round(b.m, 2) AS of_months FROM a JOIN b USING (series, month)""")
def month_climatology(spark, sf):
    rows = S.o1(spark, sf)
    days = A.month_climatology(rows).withColumnRenamed("mean", "of_days")
    months = A.month_climatology(rows, two_step=True).withColumnRenamed("mean", "of_months")
    return rounded(days.join(months, ["series", "month"]), 2, "of_days", "of_months")


@query("season_stats", f"""WITH {S.O1} SELECT series, {S.season_sql('ds', 'binned')} AS season,
  round(avg(value), 2) AS mean, round(stddev_samp(value), 3) AS std, min(value) AS min,
  max(value) AS max FROM o1 GROUP BY 1, 2""")
def season_stats(spark, sf):
    return rounded(A.season_stats(S.o1(spark, sf)), 3, "std").withColumn(
        "mean", F.round("mean", 2))


@query("sum_by_date", """SELECT CAST(o_orderdate AS DATE) AS ds, round(sum(o_totalprice), 2) AS value
  FROM orders GROUP BY 1""")
def sum_by_date(spark, sf):
    rows = S.table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("ds"), F.col("o_totalprice").alias("value"))
    return rounded(A.sum_by_date(rows), 2, "value")


@query("value_counts", """SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def value_counts(spark, sf):
    return A.value_counts(S.table(spark, sf, "events"), "event_type")


@query("extent", """SELECT event_type, count(DISTINCT user_id) AS "distinct",
  min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events GROUP BY 1""")
def extent(spark, sf):
    rows = S.table(spark, sf, "events").select(
        "event_type", "user_id", F.to_date("ts").alias("ds"))
    return A.extent(rows, "user_id", by=("event_type",))


CIRCULAR = """sqrt(power(avg(sin(radians(direction))), 2) + power(avg(cos(radians(direction))), 2))"""
ANGLE = """(degrees(atan2(avg(sin(radians(direction))), avg(cos(radians(direction))))) + 360) % 360"""


@query("circular_mean", f"""WITH {S.M3} SELECT series, CAST(month(ds) AS INTEGER) AS month,
  round({ANGLE}, 5) AS mean_direction, round({CIRCULAR}, 6) AS consistency, count(direction) AS n
  FROM m3 GROUP BY 1, 2""")
def circular_mean(spark, sf):
    rows = S.m3(spark, sf).withColumn("month", F.month("ds"))
    return rounded(A.circular_stats(rows, ("series", "month")), 6, "consistency").withColumn(
        "mean_direction", F.round("mean_direction", 5))


@query("circular_mean_season", f"""WITH {S.M3} SELECT series, {S.season_sql('ds', 'two_sep')} AS season,
  round({ANGLE}, 5) AS mean_direction, round({CIRCULAR}, 6) AS consistency, count(direction) AS n
  FROM m3 GROUP BY 1, 2""")
def circular_mean_season(spark, sf):
    rows = S.m3(spark, sf).withColumn("season", V.season(F.col("ds"), "two_sep"))
    return rounded(A.circular_stats(rows, ("series", "season")), 6, "consistency").withColumn(
        "mean_direction", F.round("mean_direction", 5))


#: Directions of one station per hundred customers, on all days of several years.
WINDS = """m3 AS (SELECT 'S' || CAST(o_custkey // 100 AS VARCHAR) AS series, CAST(o_orderdate AS DATE) AS ds,
  round((CAST(round(o_totalprice * 100) AS BIGINT) % 3600) / 10, 4) AS direction FROM orders)"""


def _winds(spark, sf):
    return S.table(spark, sf, "orders").select(
        F.concat(F.lit("S"), F.floor(F.col("o_custkey") / 100).cast("string")).alias("series"),
        F.to_date("o_orderdate").alias("ds"),
        (F.pmod(F.round(F.col("o_totalprice") * 100).cast("bigint"), F.lit(3600)) / 10).alias("direction"))


@query("circular_mean_by_month", f"""WITH {WINDS} SELECT series, CAST(month(ds) AS INTEGER) AS month,
  round({ANGLE}, 5) AS mean_direction, round({CIRCULAR}, 6) AS consistency, count(direction) AS n
  FROM m3 GROUP BY 1, 2""")
def circular_mean_by_month(spark, sf):
    rows = _winds(spark, sf).withColumn("month", F.month("ds"))
    return rounded(A.circular_stats(rows, ("series", "month")), 6, "consistency").withColumn(
        "mean_direction", F.round("mean_direction", 5))


@query("circular_mean_by_season", f"""WITH {WINDS} SELECT series, {S.season_sql('ds', 'binned')} AS season,
  round({ANGLE}, 5) AS mean_direction, round({CIRCULAR}, 6) AS consistency, count(direction) AS n
  FROM m3 GROUP BY 1, 2""")
def circular_mean_by_season(spark, sf):
    rows = _winds(spark, sf).withColumn("season", V.season(F.col("ds"), "binned"))
    return rounded(A.circular_stats(rows, ("series", "season")), 6, "consistency").withColumn(
        "mean_direction", F.round("mean_direction", 5))


@query("mode_by", """WITH c AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, o_orderpriority AS v,
  count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT month, v AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY month ORDER BY n DESC, v) = 1
  UNION ALL (SELECT CAST(0 AS INTEGER), v, n FROM (SELECT v, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1)
  ORDER BY n DESC, v LIMIT 1)""")
def mode_by(spark, sf):
    rows = S.table(spark, sf, "orders").select(
        F.explode(F.array(F.month("o_orderdate"), F.lit(0))).alias("month"), "o_orderpriority")
    return A.mode_by(rows, ("month",), "o_orderpriority")


@query("correlation", f"""WITH {S.R1}, x AS (SELECT l_returnflag AS series, l_quantity AS qty,
  l_extendedprice AS price, CASE WHEN p_size > 10 THEN p_retailprice END AS retail FROM r1)
  SELECT series, 'qty' AS a, 'price' AS b, round(corr(qty, price), 6) AS r, count(*) AS n FROM x
  GROUP BY 1 UNION ALL SELECT series, 'qty', 'retail', round(corr(qty, retail), 6), count(retail)
  FROM x GROUP BY 1 UNION ALL SELECT series, 'price', 'retail', round(corr(price, retail), 6),
  count(retail) FROM x GROUP BY 1""")
def correlation(spark, sf):
    rows = S.r1(spark, sf).select(
        F.col("l_returnflag").alias("series"), F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("retail"))
    return rounded(A.correlation(rows, ["qty", "price", "retail"], ("series",)), 6, "r")


REGR = """round(regr_slope(y, x), 1) AS slope, round(regr_intercept(y, x), -3) AS intercept,
  round(corr(y, x), 6) AS r, round(regr_r2(y, x), 6) AS r2,
  round(sqrt((regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2)
  / regr_sxx(y, x)), 1) AS stderr, count(*) AS n"""


def _regression_rounded(df):
    return df.withColumns({
        "slope": F.round("slope", 1), "intercept": F.round("intercept", -3), "r": F.round("r", 6),
        "r2": F.round("r2", 6), "stderr": F.round("stderr", 1)})


def _year_hidden(spark, sf):
    return S.o1(spark, sf).withColumn("value", F.when(F.year("ds") != 1994, F.col("value")))


HIDDEN = S.O1 + """, hd AS (SELECT series, ds, CASE WHEN year(ds) <> 1994 THEN value END AS value FROM o1),
yr AS (SELECT series, year(ds) AS yr, avg(value) AS y FROM hd GROUP BY 1, 2),
en AS (SELECT series FROM hd GROUP BY 1 HAVING count(*) >= 365)"""


@query("linear_trend", f"""WITH {HIDDEN}, y AS (SELECT series, y,
  row_number() OVER (PARTITION BY series ORDER BY yr) - 1 AS x FROM yr SEMI JOIN en USING (series)
  WHERE y IS NOT NULL) SELECT series, {REGR} FROM y GROUP BY 1 HAVING count(*) >= 3""")
def linear_trend(spark, sf):
    return _regression_rounded(A.linear_trend(_year_hidden(spark, sf)))


@query("linear_trend_on_year", f"""WITH {HIDDEN}, y AS (SELECT series, y, yr AS x FROM yr
  SEMI JOIN en USING (series) WHERE y IS NOT NULL) SELECT series, {REGR} FROM y GROUP BY 1
  HAVING count(*) >= 3""")
def linear_trend_on_year(spark, sf):
    return _regression_rounded(A.linear_trend(_year_hidden(spark, sf), on_year=True))


@query("yearly_sum_trend", f"""WITH {S.O1}, y AS (SELECT series, sum(value) AS y,
  year(ds) + dayofyear(make_date(year(ds), 12, 31)) / 365.25::DOUBLE AS x FROM o1 GROUP BY series, year(ds))
  SELECT series, {REGR} FROM y GROUP BY 1""")
def yearly_sum_trend(spark, sf):
    return _regression_rounded(A.yearly_sum_trend(S.o1(spark, sf)))


DEPTHS = (10, 20, 40, 100)


@query("vertical_profile", """WITH p AS (SELECT unnest([10.0, 20.0, 40.0, 100.0]::DOUBLE[]) AS depth,
  p_size FROM part) SELECT depth, round(avg(CASE WHEN p_size >= depth / 2 THEN p_size / depth END), 6)
  AS mean FROM p GROUP BY 1 ORDER BY depth""")
def vertical_profile(spark, sf):
    size = F.col("p_size")
    rows = S.table(spark, sf, "part").select(
        *[F.when(size >= d / 2, size / d).alias(f"TEMP_{d}m") for d in DEPTHS])
    return rounded(A.vertical_profile(rows, [f"TEMP_{d}m" for d in DEPTHS]), 6, "mean")


ROSE = """ROSE AS (SELECT series, CAST(CAST(floor(dir / 22.5 + 0.5) AS BIGINT) % 16 AS INTEGER) AS sector,
  CAST(CASE WHEN spd >= 15 THEN 6 WHEN spd >= 10.4 THEN 5 WHEN spd >= 8.3 THEN 4 WHEN spd >= 6.3 THEN 3
  WHEN spd >= 4.2 THEN 2 WHEN spd >= 2.2 THEN 1 WHEN spd >= 0 THEN 0 END AS INTEGER) AS speed_bin,
  count(*) AS n FROM W WHERE spd IS NOT NULL AND dir IS NOT NULL GROUP BY 1, 2, 3)
  SELECT series, sector, speed_bin, n, round(100.0 * n / sum(n) OVER (PARTITION BY series), 6) AS percent
  FROM ROSE QUALIFY sum(n) OVER (PARTITION BY series) >= 30"""


@query("wind_rose_table", f"""WITH {S.M3}, W AS (SELECT series, speed AS spd, direction AS dir FROM m3),
  {ROSE}""")
def wind_rose_table(spark, sf):
    return rounded(A.wind_rose_table(S.m3(spark, sf)), 6, "percent")


@query("wind_rose_from_components", f"""WITH {S.M3}, uv AS (SELECT series,
  speed * sin(radians(direction)) AS u, speed * cos(radians(direction)) AS v FROM m3),
  W AS (SELECT series, sqrt(u * u + v * v) AS spd, (270 - degrees(atan2(v, u)) + 360) % 360 AS dir
  FROM uv), {ROSE}""")
def wind_rose_from_components(spark, sf):
    rad = F.radians("direction")
    u, v = F.col("speed") * F.sin(rad), F.col("speed") * F.cos(rad)
    speed, direction = V.wind_from_components(F.col("u"), F.col("v"))
    rows = S.m3(spark, sf).select("series", u.alias("u"), v.alias("v")).select(
        "series", speed.alias("speed"), direction.alias("direction"))
    return rounded(A.wind_rose_table(rows), 6, "percent")


@query("box_stats", f"""WITH {S.O1} SELECT series, CAST(month(ds) AS INTEGER) AS month, min(value) AS min,
  round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median,
  round(quantile_cont(value, 0.75), 4) AS q3, max(value) AS max FROM o1 GROUP BY 1, 2""")
def box_stats(spark, sf):
    rows = S.o1(spark, sf).withColumn("month", F.month("ds"))
    return rounded(A.box_stats(rows, ("series", "month")), 4, "q1", "median", "q3")


@query("density_histogram", f"""WITH {S.O1G}, f AS (SELECT series, value IS NULL AS imputed,
  coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds
  ROWS UNBOUNDED PRECEDING)) AS v FROM o1g), r AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi
  FROM f WINDOW w AS (PARTITION BY series)),
  c AS (SELECT series, imputed, lo, hi, CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS INTEGER)
  AS bin, count(*) AS n FROM r GROUP BY ALL)
  SELECT series, imputed, bin, n, round(1e6 * n / (sum(n) OVER (PARTITION BY series, imputed) *
  ((hi - lo) / 50)), 6) AS density, round(lo + bin * ((hi - lo) / 50), 4) AS left FROM c""")
def density_histogram(spark, sf):
    rows = W.ffill(S.o1_grid(spark, sf)).select(
        "series", F.col("value").isNull().alias("imputed"), F.col("filled").alias("value"))
    out = A.density_histogram(rows, group=("imputed",))
    return out.withColumns({"density": F.round(F.col("density") * 1e6, 6),
                            "left": F.round("left", 4)})


RESID = """rs AS (SELECT series, ds, value - avg(value) OVER
  (PARTITION BY series ORDER BY ds ROWS 6 PRECEDING) AS residual FROM e1)"""


def _residuals(spark, sf):
    rows = W.sma(S.e1(spark, sf), 7, min_periods=1)
    return rows.select("series", "ds", (F.col("value") - F.col("sma")).alias("residual"),
                       F.col("sma").alias("fitted"))


@query("residual_shape", f"""WITH {S.E1}, {RESID}, m AS (SELECT series, residual,
  avg(residual) OVER w AS mu, stddev_pop(residual) OVER w AS sd FROM rs
  WINDOW w AS (PARTITION BY series))
  SELECT series, count(*) AS n, round(avg(residual), 6) AS mean, round(stddev_pop(residual), 6) AS std,
  round(avg(power((residual - mu) / sd, 3)), 6) AS skewness,
  round(avg(power((residual - mu) / sd, 4)) - 3, 6) AS kurtosis FROM m GROUP BY 1""")
def residual_shape(spark, sf):
    return rounded(A.residual_shape(_residuals(spark, sf)), 6, "mean", "std", "skewness", "kurtosis")


@query("residual_histogram", f"""WITH {S.E1}, {RESID}, r AS (SELECT series, residual AS v,
  min(residual) OVER w AS lo, max(residual) OVER w AS hi FROM rs WINDOW w AS (PARTITION BY series))
  SELECT series, CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n
  FROM r GROUP BY 1, 2""")
def residual_histogram(spark, sf):
    return A.density_histogram(_residuals(spark, sf), bins=10, value="residual").drop(
        "density", "left")


@query("quantile_pairs", f"""WITH {S.E1}, {RESID}, p AS (SELECT series, ds, residual,
  (row_number() OVER (PARTITION BY series ORDER BY residual) - 0.5::DOUBLE) /
  count(*) OVER (PARTITION BY series) AS p FROM rs),
  t AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p),
  z AS (SELECT *, t - (2.515517::DOUBLE + 0.802853::DOUBLE * t + 0.010328::DOUBLE * t * t) /
  (1 + 1.432788::DOUBLE * t + 0.189269::DOUBLE * t * t + 0.001308::DOUBLE * t * t * t) AS z FROM t)
  SELECT series, ds, round(residual, 6) AS residual,
  round(CASE WHEN p < 0.5 THEN -z ELSE z END, 6) AS theoretical FROM z""")
def quantile_pairs(spark, sf):
    rows = A.quantile_pairs(_residuals(spark, sf)).drop("fitted")
    return rounded(rows, 6, "residual", "theoretical")


@query("residual_against_fitted", f"""WITH {S.E1}, f AS (SELECT series, ds, value,
  avg(value) OVER (PARTITION BY series ORDER BY ds ROWS 6 PRECEDING) AS m FROM e1)
  SELECT series, ds, round(m, 6) AS fitted, round(value - m, 6) AS residual FROM f""")
def residual_against_fitted(spark, sf):
    return rounded(_residuals(spark, sf), 6, "residual", "fitted")


@query("describe_wide", f"""WITH {S.E2G}, f AS (SELECT series, value * 2 AS sst, value * 5 AS rad
  FROM e2g) SELECT series, 'sst' AS variable, count(sst) AS count, round(avg(sst), 8) AS mean,
  min(sst) AS min, max(sst) AS max FROM f GROUP BY 1 UNION ALL
  SELECT series, 'rad', count(rad), round(avg(rad), 8), min(rad), max(rad) FROM f GROUP BY 1""")
def describe_wide(spark, sf):
    rows = S.e2_grid(spark, sf).select(
        "series", (F.col("value") * 2).alias("sst"), (F.col("value") * 5).alias("rad"))
    long = rows.unpivot(["series"], ["sst", "rad"], "variable", "value")
    return Q.describe_by(long, ("series", "variable")).select(
        "series", "variable", "count", F.round("mean", 8).alias("mean"), "min", "max")
