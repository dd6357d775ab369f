"""Queries: fills learned with ``pyspark.ml``; SQL states what they must keep to."""

from __future__ import annotations

from pyspark.sql import functions as F

from raingrid.operators import patterns as L
from raingrid.plans import series as S
from raingrid.plans.registry import query

PREDICTORS = ["tavg", "rh", "tx", "tn", "ss"]


def _station_days(spark, sf):
    """Daily weather per order priority; about a third of the days are dry."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("c")
    rows = S.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("ds")).agg(cents)
    c = F.col("c")
    tavg = 17 + F.pmod(F.floor(c / 7), F.lit(2200)) / 100
    rh = 50 + F.pmod(F.floor(c / 11), F.lit(4800)) / 100
    rain = F.greatest(F.lit(0.0), (rh - 66) / 2 + F.pmod(c, F.lit(500)) / 100)
    known = F.pmod(F.floor(c / 13), F.lit(9)) != 0
    return rows.select(
        "series", "ds", F.when(known, rain).alias("rr"), tavg.alias("tavg"), rh.alias("rh"),
        (tavg + 5).alias("tx"), (tavg - 5).alias("tn"),
        (F.pmod(F.floor(c / 17), F.lit(120)) / 10).alias("ss"),
        F.when(F.pmod(c, F.lit(7)) != 0, rh / 10 + tavg / 20).alias("wind"))


DAYS = """d AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ds,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c FROM orders GROUP BY 1, 2),
k AS (SELECT *, CAST(floor(c / 13) AS BIGINT) % 9 <> 0 AS rain_known, c % 7 <> 0 AS wind_known FROM d)"""


def _kept(value):
    """Per series: what a fill must not do, counted beside the rows and the known values."""
    v, f = F.col(value), F.col("filled")
    return [F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_known"),
            F.count_if(v.isNotNull() & ~v.eqNullSafe(f)).alias("n_changed"),
            F.count_if(f.isNull()).alias("n_null_left")]


@query("pattern_median_fill", f"""WITH {DAYS} SELECT series, count(*) AS n_rows,
  count(*) FILTER (wind_known) AS n_known, 0::BIGINT AS n_changed, 0::BIGINT AS n_null_left,
  0::BIGINT AS n_outside FROM k GROUP BY 1""")
def pattern_median_fill(spark, sf):
    """No known value changed, no null left, and no fill outside the known range."""
    rows = _station_days(spark, sf).select("series", "ds", "tavg", "rh", "wind")
    filled = L.pattern_median_fill(rows, ["tavg", "rh"], "wind")
    span = filled.groupBy("series").agg(F.min("wind").alias("lo"), F.max("wind").alias("hi"))
    return filled.join(span, "series").groupBy("series").agg(
        *_kept("wind"),
        F.count_if(~F.col("filled").between(F.col("lo"), F.col("hi"))).alias("n_outside"))


@query("rain_occurrence_fill", f"""WITH {DAYS} SELECT series, count(*) AS n_rows,
  count(*) FILTER (rain_known) AS n_known, 0::BIGINT AS n_changed, 0::BIGINT AS n_null_left,
  0::BIGINT AS n_outside FROM k GROUP BY 1""")
def rain_occurrence_fill(spark, sf):
    """No known value changed, no null left, and every fill dry or a known wet day's value.

    Series with too few complete days are interpolated; there the fill lies in the known range.
    """
    days = _station_days(spark, sf).drop("wind")
    filled = L.rain_occurrence_fill(days, PREDICTORS)
    wet = days.where("rr > 0").select("series", F.col("rr").alias("filled")).distinct().withColumn(
        "_wet", F.lit(True))
    known = days.groupBy("series").agg(F.count("rr").alias("_n"), F.max("rr").alias("_top"))
    fits = (F.col("filled") == 0) | F.when(
        F.col("_n") >= 100, F.col("_wet").isNotNull()).otherwise(F.col("filled").between(0, F.col("_top")))
    return filled.join(wet, ["series", "filled"], "left").join(known, "series").groupBy("series").agg(
        *_kept("rr"), F.count_if(F.col("rr").isNull() & ~fits).alias("n_outside"))


@query("rain_model_scores", f"""WITH {DAYS} SELECT count(*) AS n, true AS better_than_guessing,
  true AS f1_in_range FROM k WHERE rain_known AND
  CAST('0x' || md5(series || '|' || CAST(ds AS VARCHAR))[1:8] AS BIGINT) % 5 = 4""")
def rain_model_scores(spark, sf):
    """Held-out days, and whether the forest beats the more frequent answer."""
    rows = _station_days(spark, sf).withColumn("month", F.month("ds").cast("double"))
    _, tested = L.rain_model(rows, [*PREDICTORS, "month"])
    return L.model_scores(tested).select(
        "n", (F.col("accuracy") > F.greatest(F.col("wet"), 1 - F.col("wet"))).alias("better_than_guessing"),
        F.col("f1").between(0, 1).alias("f1_in_range"))


@query("rain_model_importances", "SELECT unnest(['" + "', '".join([*PREDICTORS, "month"]) + """'])
  AS predictor, true AS in_range, true AS adds_up""")
def rain_model_importances(spark, sf):
    rows = _station_days(spark, sf).withColumn("month", F.month("ds").cast("double"))
    names = [*PREDICTORS, "month"]
    forest, _ = L.rain_model(rows, names)
    weights = L.importances(forest, names, spark)
    whole = weights.agg(F.collect_list(F.struct("predictor", "importance")).alias("all"),
                        F.sum("importance").alias("total"))
    return whole.select("total", F.explode("all").alias("x")).select(
        "x.predictor", F.col("x.importance").between(0, 1).alias("in_range"),
        (F.abs(F.col("total") - 1) < 1e-6).alias("adds_up"))
