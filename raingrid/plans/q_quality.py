"""Queries: quality control and coverage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.operators import quality as Q
from raingrid.plans import series as S
from raingrid.plans.registry import query


def _tokens(spark, sf):
    """Compact value tokens of every accepted and rejected shape, from events."""
    v = F.format_string("%.2f", "value")
    q, s = (F.col("event_id") % 6).cast("string"), (F.col("event_id") % 9).cast("string")
    kind = F.col("event_id") % 11
    token = (
        F.when(kind == 0, F.concat_ws("_", v, q, s)).when(kind == 1, F.concat_ws(" ", v, q, s))
        .when(kind == 2, v).when(kind == 3, F.lit("C")).when(kind == 4, F.lit("-9.99"))
        .when(kind == 5, F.concat_ws("_", v, q, F.lit("C"))).when(kind == 6, F.concat(F.lit("-1"), v))
        .when(kind == 7, F.lit("")).when(kind == 8, F.lit("bad value"))
        .when(kind == 9, F.concat_ws("_", v, q)).otherwise(F.concat(F.lit(" "), v, F.lit(" "))))
    return S.table(spark, sf, "events").select("event_id", "event_type", token.alias("token"))


TOKENS = """tk AS (SELECT event_id, event_type, v, CAST(event_id % 6 AS INTEGER) AS q,
  CAST(event_id % 9 AS INTEGER) AS s, CAST(event_id % 11 AS INTEGER) AS k FROM
  (SELECT event_id, event_type, printf('%.2f', value) AS v FROM events)),
pc AS (SELECT event_id, event_type,
  CASE k WHEN 0 THEN v || '_' || q || '_' || s WHEN 1 THEN v || ' ' || q || ' ' || s
    WHEN 2 THEN v WHEN 3 THEN 'C' WHEN 4 THEN '-9.99' WHEN 5 THEN v || '_' || q || '_C'
    WHEN 6 THEN '-1' || v WHEN 7 THEN '' WHEN 8 THEN 'bad value' WHEN 9 THEN v || '_' || q
    ELSE ' ' || v || ' ' END AS token,
  CASE WHEN k IN (0, 1, 2, 10) THEN CAST(v AS DOUBLE) END AS value,
  CASE WHEN k IN (0, 1) THEN q WHEN k IN (2, 10) THEN 2
    WHEN k IN (4, 6) THEN 0 END AS q,
  CASE WHEN k IN (0, 1) THEN s WHEN k IN (2, 10) THEN 1 WHEN k IN (4, 6) THEN 0 END AS s,
  k IN (0, 1, 2, 10) AS valid,
  CASE k WHEN 3 THEN 'Special adjustment indicator (C)' WHEN 4 THEN 'Missing data indicator'
    WHEN 5 THEN 'Contains special adjustment indicator (C)' WHEN 6 THEN 'Missing value'
    WHEN 7 THEN 'Empty/NaN' WHEN 8 THEN 'Unable to parse value' WHEN 9 THEN 'Unable to parse value'
    END AS reason FROM tk)"""


@query("parse_value_codes", f"""WITH {TOKENS} SELECT event_id, token, value, q, s, valid, reason
  FROM pc""")
def parse_value_codes(spark, sf):
    return Q.parse_value_codes(_tokens(spark, sf)).drop("event_type")


@query("rejection_summary", f"""WITH {TOKENS} SELECT event_type, reason, count(*) AS rejected
  FROM pc WHERE reason IS NOT NULL GROUP BY 1, 2""")
def rejection_summary(spark, sf):
    return Q.rejection_summary(Q.parse_value_codes(_tokens(spark, sf)), "event_type")


def _coded(spark, sf):
    day = F.dayofmonth("ds")
    return S.e1(spark, sf).withColumns({"q": day % 6, "s": day % 9})


CODED = S.E1 + """, cd AS (SELECT *, CAST(day(ds) % 6 AS INTEGER) AS q,
  CAST(day(ds) % 9 AS INTEGER) AS s FROM e1)"""


@query("quality_filter", f"""WITH {CODED} SELECT series, ds, CASE WHEN q IN (1, 2, 3)
  AND s IN (1, 2, 3, 5, 6, 7, 8) THEN value END AS value, q, s FROM cd""")
def quality_filter(spark, sf):
    return Q.quality_filter(_coded(spark, sf))


@query("quality_rows", f"""WITH {CODED} SELECT series, ds, value, q, s,
  CASE q WHEN 3 THEN 'adjusted' WHEN 4 THEN 'low' ELSE 'high' END AS data_quality,
  CAST(CASE s WHEN 5 THEN 5 WHEN 6 THEN 4 WHEN 7 THEN 3 WHEN 8 THEN 2 ELSE 1 END AS INTEGER)
  AS source_priority FROM cd WHERE q NOT IN (0, 5)""")
def quality_rows(spark, sf):
    return Q.quality_rows(_coded(spark, sf))


@query("interpolated_share", f"""WITH {CODED} SELECT series,
  count(*) FILTER (s IN (3, 7, 8)) AS interpolated,
  round(100.0 * count(*) FILTER (s IN (3, 7, 8)) / count(*), 6) AS percent FROM cd GROUP BY 1""")
def interpolated_share(spark, sf):
    return Q.interpolated_share(_coded(spark, sf)).withColumn("percent", F.round("percent", 6))


def _station(spark, sf):
    v = F.col("value")
    return S.e1(spark, sf).select("series", "ds", v.alias("TX"), (v - 15).alias("TN"),
                                  (v * 2).alias("RH_AVG"), (v - 30).alias("SS"))


STATION = S.E1 + """, st AS (SELECT series, ds, value AS "TX", value - 15 AS "TN",
  value * 2 AS "RH_AVG", value - 30 AS "SS" FROM e1)"""


@query("range_to_null", f"""WITH {STATION} SELECT series, ds,
  CASE WHEN "TX" BETWEEN -5 AND 45 THEN "TX" END AS "TX",
  CASE WHEN "TN" BETWEEN -10 AND 35 THEN "TN" END AS "TN",
  CASE WHEN "RH_AVG" BETWEEN 0 AND 100 THEN "RH_AVG" END AS "RH_AVG",
  CASE WHEN "SS" BETWEEN 0 AND 14 THEN "SS" END AS "SS" FROM st""")
def range_to_null(spark, sf):
    return Q.range_to_null(_station(spark, sf), fixed.STATION_LIMITS)


@query("range_violations", f"""WITH {STATION} SELECT series,
  count(*) FILTER ("TX" NOT BETWEEN -5 AND 45) AS "TX_outside",
  count(*) FILTER ("TN" NOT BETWEEN -10 AND 35) AS "TN_outside",
  count(*) FILTER ("RH_AVG" NOT BETWEEN 0 AND 100) AS "RH_AVG_outside",
  count(*) FILTER ("SS" NOT BETWEEN 0 AND 14) AS "SS_outside" FROM st GROUP BY 1""")
def range_violations(spark, sf):
    return Q.range_violations(_station(spark, sf), fixed.STATION_LIMITS)


@query("zscore_outliers", f"""WITH {S.O1}, z AS (SELECT *,
  abs(value - avg(value) OVER w) / stddev_pop(value) OVER w > 2.5 AS is_outlier FROM o1
  WINDOW w AS (PARTITION BY series)) SELECT series, ds, value, is_outlier,
  CASE WHEN NOT is_outlier THEN value END AS cleaned FROM z""")
def zscore_outliers(spark, sf):
    return Q.zscore_outliers(S.o1(spark, sf), 2.5)


@query("iqr_outliers", f"""WITH {S.O1}, q AS (SELECT series, quantile_cont(value, 0.25) AS a,
  quantile_cont(value, 0.75) AS b FROM o1 GROUP BY 1)
  SELECT series, ds, value, round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high
  FROM o1 JOIN q USING (series) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def iqr_outliers(spark, sf):
    return Q.iqr_outliers(S.o1(spark, sf)).withColumns(
        {"low": F.round("low", 4), "high": F.round("high", 4)})


@query("iqr_outlier_summary", f"""WITH {S.O1}, q AS (SELECT series, quantile_cont(value, 0.25) AS a,
  quantile_cont(value, 0.75) AS b FROM o1 GROUP BY 1)
  SELECT series, count(*) AS outliers, min(value) AS smallest FROM o1 JOIN q USING (series)
  WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) GROUP BY 1""")
def iqr_outlier_summary(spark, sf):
    return Q.iqr_outliers(S.o1(spark, sf)).groupBy("series").agg(
        F.count(F.lit(1)).alias("outliers"), F.min("value").alias("smallest"))


@query("percentile_outlier_count", f"""WITH {S.O1}, q AS (SELECT series,
  quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM o1 GROUP BY 1)
  SELECT series, count(*) FILTER (value < a OR value > b) AS outliers
  FROM o1 JOIN q USING (series) GROUP BY 1""")
def percentile_outlier_count(spark, sf):
    return Q.percentile_outlier_count(S.o1(spark, sf))


@query("constraint_report", f"""WITH {S.E2G}, w AS (SELECT series, value * 2 AS v, 'SST' AS variable,
  20 AS lo, 35 AS hi FROM e2g UNION ALL SELECT series, value * 5, 'RAD', 0, 500 FROM e2g)
  SELECT series, variable, min(v) AS min, max(v) AS max, count(*) FILTER (v < lo) AS below,
  count(*) FILTER (v > hi) AS above, count(*) FILTER (v IS NULL) AS nulls FROM w GROUP BY 1, 2""")
def constraint_report(spark, sf):
    rows = S.e2_grid(spark, sf).select(
        "series", (F.col("value") * 2).alias("SST"), (F.col("value") * 5).alias("RAD"))
    return Q.constraint_report(rows, fixed.PHYSICAL_LIMITS)


@query("suspicious_patterns", """WITH v AS (SELECT o_orderpriority AS series,
  o_totalprice - 100000 AS x FROM orders), c AS (SELECT series, count(x) AS n,
  count(*) FILTER (x > 1000) AS a, count(*) FILTER (x < 0) AS b,
  count(*) FILTER (regexp_matches(printf('%.2f', x), '\\d{5,}')) AS d FROM v GROUP BY 1),
u AS (SELECT series, n, 'over_1000' AS pattern, a AS hits FROM c UNION ALL
  SELECT series, n, 'negative', b FROM c UNION ALL SELECT series, n, 'five_digits', d FROM c)
  SELECT *, round(100.0 * hits / n, 6) AS percent FROM u WHERE 100.0 * hits / n > 0.1""")
def suspicious_patterns(spark, sf):
    rows = S.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"), (F.col("o_totalprice") - 100000).alias("value"))
    return Q.suspicious_patterns(rows).withColumn("percent", F.round("percent", 6))


def _wide(spark, sf):
    v, d = F.col("value"), F.dayofmonth("ds")
    return S.e2_grid(spark, sf).select(
        "series", "ds", v.alias("sst"), F.when(d % 3 != 0, v).alias("rain"),
        F.when(d % 2 == 0, v).alias("rh"), F.when(d < 10, v).alias("rad"))


WIDE = S.E2G + """, wd AS (SELECT series, ds, value AS sst,
  CASE WHEN day(ds) % 3 <> 0 THEN value END AS rain, CASE WHEN day(ds) % 2 = 0 THEN value END AS rh,
  CASE WHEN day(ds) < 10 THEN value END AS rad FROM e2g),
cov AS (SELECT series, variable, count(v) AS valid, count(*) AS total,
  100.0::DOUBLE * count(v) / count(*) AS percent FROM
  (SELECT series, 'sst' AS variable, sst AS v FROM wd UNION ALL SELECT series, 'rain', rain FROM wd
   UNION ALL SELECT series, 'rh', rh FROM wd UNION ALL SELECT series, 'rad', rad FROM wd)
  GROUP BY 1, 2)"""


@query("completeness", f"""WITH {WIDE} SELECT series, variable, valid, total,
  round(percent, 6) AS percent, CASE WHEN percent >= 80 THEN 'excellent' WHEN percent >= 60 THEN 'good'
  WHEN percent >= 40 THEN 'fair' ELSE 'poor' END AS band FROM cov""")
def completeness(spark, sf):
    return Q.completeness(_wide(spark, sf), ["sst", "rain", "rh", "rad"]).withColumn(
        "percent", F.round("percent", 6))


@query("missing_percent", f"""WITH {WIDE} SELECT series,
  round(100.0 * count(*) FILTER (sst IS NULL) / count(*), 6) AS sst,
  round(100.0 * count(*) FILTER (rain IS NULL) / count(*), 6) AS rain,
  round(100.0 * count(*) FILTER (rad IS NULL) / count(*), 6) AS rad FROM wd GROUP BY 1""")
def missing_percent(spark, sf):
    cols = ["sst", "rain", "rad"]
    return Q.missing_percent(_wide(spark, sf), cols).withColumns({c: F.round(c, 6) for c in cols})


@query("top_variables", f"""WITH {WIDE}, r AS (SELECT series, variable, round(percent, 6) AS percent,
  row_number() OVER (PARTITION BY series ORDER BY round(percent, 6) DESC, variable) AS rank FROM cov)
  SELECT series, variable, percent, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def top_variables(spark, sf):
    coverage = Q.completeness(_wide(spark, sf), ["sst", "rain", "rh", "rad"]).withColumn(
        "percent", F.round("percent", 6))
    return Q.top_variables(coverage).select("series", "variable", "percent", "rank")


DEPTHS = (10, 20, 40, 100)


@query("depth_availability", """WITH p AS (SELECT unnest([10.0, 20.0, 40.0, 100.0]::DOUBLE[]) AS depth,
  p_size FROM part), c AS (SELECT depth,
  100.0::DOUBLE * count(*) FILTER (p_size >= depth / 2) / count(*) AS percent FROM p GROUP BY 1)
  SELECT depth, round(percent, 6) AS percent, CASE WHEN percent >= 70 THEN 'good'
  WHEN percent >= 50 THEN 'fair' ELSE 'poor' END AS band FROM c ORDER BY depth""")
def depth_availability(spark, sf):
    size = F.col("p_size")
    rows = S.table(spark, sf, "part").select(
        *[F.when(size >= d / 2, size).alias(f"TEMP_{d}m") for d in DEPTHS])
    return Q.depth_availability(rows, [f"TEMP_{d}m" for d in DEPTHS]).withColumn(
        "percent", F.round("percent", 6))


@query("order_repair", f"""WITH {S.M2}, x AS (SELECT series, ds, tx, tn,
  CASE WHEN day(ds) % 3 = 0 THEN tavg + 20 WHEN day(ds) % 3 = 1 THEN tavg - 24 ELSE tavg END AS t
  FROM m2), y AS (SELECT *, CASE WHEN t > tx THEN tx ELSE t END AS c FROM x)
  SELECT series, ds, tx, tn, CASE WHEN c < tn THEN tn ELSE c END AS tavg FROM y""")
def order_repair(spark, sf):
    d, t = F.dayofmonth("ds") % 3, F.col("tavg")
    rows = S.m2(spark, sf).withColumn(
        "tavg", F.when(d == 0, t + 20).when(d == 1, t - 24).otherwise(t))
    return Q.order_repair(rows)


@query("describe_by", f"""WITH {S.O1G} SELECT series, count(value) AS count, round(avg(value), 2) AS mean,
  round(stddev_samp(value), 3) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 3) AS q25,
  round(quantile_cont(value, 0.5), 3) AS q50, round(quantile_cont(value, 0.75), 3) AS q75,
  max(value) AS max, round(100.0 * count(*) FILTER (value IS NULL) / count(*), 6) AS missing_pct
  FROM o1g GROUP BY 1""")
def describe_by(spark, sf):
    cols = {c: F.round(c, 3) for c in ("std", "q25", "q50", "q75")}
    return Q.describe_by(S.o1_grid(spark, sf)).withColumns(
        {**cols, "mean": F.round("mean", 2), "missing_pct": F.round("missing_pct", 6)})
