"""Queries: rolling, filling, gap, lag and ordering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from raingrid.operators import hotscan as K
from raingrid.operators import longscan as X
from raingrid.operators import windows as W
from raingrid.plans import series as S
from raingrid.plans.registry import query

R6 = lambda c: F.round(c, 6)


@query("sma", f"""WITH {S.L1}, w AS (SELECT series, ds, value,
  avg(value) OVER a AS t, count(value) OVER a AS tn, avg(value) OVER b AS c7,
  avg(value) OVER c AS c30, count(value) OVER c AS c30n FROM l1
  WINDOW a AS (PARTITION BY series ORDER BY ds ROWS 29 PRECEDING),
    b AS (PARTITION BY series ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
    c AS (PARTITION BY series ORDER BY ds ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING))
  SELECT series, ds, value, round(CASE WHEN tn >= 30 THEN t END, 6) AS trailing_30,
  round(c7, 6) AS centred_7, round(CASE WHEN c30n >= 3 THEN c30 END, 6) AS centred_30 FROM w""")
def sma(spark, sf):
    rows = W.sma(S.l1(spark, sf), 30, out="trailing_30")
    rows = W.sma(rows, 7, center=True, min_periods=1, out="centred_7")
    rows = W.sma(rows, 30, center=True, min_periods=3, out="centred_30")
    return rows.withColumns({c: R6(c) for c in ("trailing_30", "centred_7", "centred_30")})


EWMA_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) AS rn FROM e1),
ew AS (SELECT a.series, a.ds, any_value(a.value) AS value,
  sum(b.value * power(1 - 2.0::DOUBLE / 31, a.rn - b.rn)) /
  sum(power(1 - 2.0::DOUBLE / 31, a.rn - b.rn)) AS e
  FROM n a JOIN n b ON a.series = b.series AND b.rn <= a.rn GROUP BY 1, 2)"""


@query("ewma", f"WITH {S.E1}, {EWMA_SQL} SELECT series, ds, value, round(e, 6) AS ewma FROM ew")
def ewma(spark, sf):
    return W.ewma(S.e1(spark, sf), 30).withColumn("ewma", R6("ewma"))


@query("ewma_long", f"WITH {S.E1}, {EWMA_SQL} SELECT series, ds, value, round(e, 6) AS ewma FROM ew")
def ewma_long(spark, sf):
    """Blocks of a week, each in a task of its own."""
    return X.ewma_long(S.e1(spark, sf), 30, block_days=7).withColumn("ewma", R6("ewma"))


FILL_WINDOWS = """WINDOW f AS (PARTITION BY series ORDER BY ds ROWS UNBOUNDED PRECEDING),
  b AS (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING),
  f2 AS (PARTITION BY series ORDER BY ds ROWS 2 PRECEDING),
  b2 AS (PARTITION BY series ORDER BY ds DESC ROWS 2 PRECEDING)"""


@query("ffill_bfill", f"""WITH {S.E2G} SELECT series, ds, value,
  last_value(value IGNORE NULLS) OVER f AS forward, last_value(value IGNORE NULLS) OVER b AS backward,
  last_value(value IGNORE NULLS) OVER f2 AS forward_2,
  last_value(value IGNORE NULLS) OVER b2 AS backward_2 FROM e2g {FILL_WINDOWS}""")
def ffill_bfill(spark, sf):
    rows = W.ffill(S.e2_grid(spark, sf), out="forward")
    rows = W.ffill(rows, 2, out="forward_2")
    return W.bfill(W.bfill(rows, out="backward"), 2, out="backward_2")


def _ragged(spark, sf):
    """E2 on its grid with the first and last days of each series hidden."""
    w = S.e2_grid(spark, sf)
    return w.withColumn("value", F.when(F.dayofmonth("ds").between(4, 26), F.col("value")))


RAGGED = S.E2G + """, rg AS (SELECT series, ds, CASE WHEN day(ds) BETWEEN 4 AND 26 THEN value END
  AS value FROM e2g), nb AS (SELECT *, CASE WHEN value IS NOT NULL THEN rn END AS krn FROM
  (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) AS rn FROM rg)),
pn AS (SELECT series, ds, value, rn, last_value(krn IGNORE NULLS) OVER f AS prn,
  last_value(value IGNORE NULLS) OVER f AS pv, last_value(krn IGNORE NULLS) OVER b AS nrn,
  last_value(value IGNORE NULLS) OVER b AS nv FROM nb
  WINDOW f AS (PARTITION BY series ORDER BY ds ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING)),
li AS (SELECT *, CASE WHEN value IS NOT NULL THEN value
  WHEN prn IS NOT NULL AND nrn IS NOT NULL THEN pv + (nv - pv) * (rn - prn) / (nrn - prn)
  ELSE coalesce(pv, nv) END AS line FROM pn)"""


@query("interpolate", f"""WITH {RAGGED} SELECT series, ds, value,
  round(CASE WHEN value IS NOT NULL OR prn IS NOT NULL THEN line END, 6) AS linear,
  round(CASE WHEN value IS NOT NULL OR rn - prn <= 2 THEN line END, 6) AS linear_2,
  round(CASE WHEN value IS NOT NULL OR rn - prn <= 3 OR nrn - rn <= 3 THEN line END, 6) AS both_3,
  round(line, 6) AS time_both FROM li""")
def interpolate(spark, sf):
    rows = W.interpolate(_ragged(spark, sf), out="linear")
    rows = W.interpolate(rows, limit=2, out="linear_2")
    rows = W.interpolate(rows, limit=3, direction="both", out="both_3")
    rows = W.interpolate(rows, method="time", direction="both", out="time_both")
    return rows.withColumns({c: R6(c) for c in ("linear", "linear_2", "both_3", "time_both")})


@query("interpolate_time", f"""WITH {S.O1}, h AS (SELECT series, ds,
  CASE WHEN day(ds) % 4 <> 0 THEN value END AS value FROM o1),
p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ds END IGNORE NULLS) OVER f AS pd,
  last_value(value IGNORE NULLS) OVER f AS pv,
  last_value(CASE WHEN value IS NOT NULL THEN ds END IGNORE NULLS) OVER b AS nd,
  last_value(value IGNORE NULLS) OVER b AS nv FROM h
  WINDOW f AS (PARTITION BY series ORDER BY ds ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING))
  SELECT series, ds, value, round(CASE WHEN value IS NOT NULL THEN value
    WHEN pd IS NOT NULL AND nd IS NOT NULL THEN pv + (nv - pv) * date_diff('day', pd, ds) /
    date_diff('day', pd, nd) ELSE coalesce(pv, nv) END, 6) AS filled FROM p""")
def interpolate_time(spark, sf):
    rows = S.o1(spark, sf).withColumn(
        "value", F.when(F.dayofmonth("ds") % 4 != 0, F.col("value")))
    return W.interpolate(rows, method="time", direction="both").withColumn(
        "filled", F.round("filled", 6))


@query("gaps", f"""WITH {S.E2G}, r AS (SELECT *,
  row_number() OVER (PARTITION BY series ORDER BY ds) - row_number() OVER
  (PARTITION BY series, value IS NULL ORDER BY ds) AS island FROM e2g)
  SELECT series, min(ds) AS gap_start, max(ds) AS gap_end, count(*) AS gap_length FROM r
  WHERE value IS NULL GROUP BY series, island""")
def gaps(spark, sf):
    return W.gaps(S.e2_grid(spark, sf))


# Hides days so that both short and long gaps appear.
def _wide(spark, sf):
    return S.e1(spark, sf).withColumn(
        "value", F.when(~(F.dayofmonth("ds") % 13).between(5, 9)
                        & (F.dayofmonth("ds") != 3), F.col("value")))


WIDE = S.E1 + """, wd AS (SELECT series, ds, CASE WHEN NOT (day(ds) % 13 BETWEEN 5 AND 9)
  AND day(ds) <> 3 THEN value END AS value FROM e1),
k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) AS rn FROM wd),
kn AS (SELECT series, rn, value AS v, lag(rn) OVER w AS rn0, lag(value) OVER w AS v0,
  lead(rn) OVER w AS rn3, lead(value) OVER w AS v3 FROM k WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY series ORDER BY rn)),
c AS (SELECT k.series, k.ds, k.value, k.rn AS x, p.rn AS x1, p.v AS y1, p.rn0 AS x0, p.v0 AS y0,
  n.rn AS x2, n.v AS y2, n.rn3 AS x3, n.v3 AS y3 FROM k
  ASOF LEFT JOIN kn p ON k.series = p.series AND k.rn >= p.rn
  ASOF LEFT JOIN kn n ON k.series = n.series AND k.rn <= n.rn)"""
GAP_SQL = f"""WITH {WIDE}, g AS (SELECT *, x2 - x1 - 1 AS len,
  y1 + (y2 - y1) * (x - x1) / (x2 - x1) AS line,
  y0 * (x-x1)/(x0-x1) * (x-x2)/(x0-x2) * (x-x3)/(x0-x3) +
  y1 * (x-x0)/(x1-x0) * (x-x2)/(x1-x2) * (x-x3)/(x1-x3) +
  y2 * (x-x0)/(x2-x0) * (x-x1)/(x2-x1) * (x-x3)/(x2-x3) +
  y3 * (x-x0)/(x3-x0) * (x-x1)/(x3-x1) * (x-x2)/(x3-x2) AS cubic FROM c)
  SELECT series, ds, value, round(least(greatest(coalesce(value,
    CASE WHEN len <= 3 THEN line ELSE coalesce(cubic, line) END, y1, y2), 20), 70), 6) AS filled FROM g"""


@query("gap_routed_fill", GAP_SQL)
def gap_routed_fill(spark, sf):
    return W.gap_routed_fill(_wide(spark, sf), (20.0, 70.0)).withColumn("filled", R6("filled"))


@query("difference", f"""WITH {S.L1} SELECT series, ds, value,
  value - lag(value, 1) OVER w AS d1, value - lag(value, 365) OVER w AS d365 FROM l1
  WINDOW w AS (PARTITION BY series ORDER BY ds)""")
def difference(spark, sf):
    return W.difference(W.difference(S.l1(spark, sf), 1, out="d1"), 365, out="d365")


@query("smoothing_residual", f"""WITH {S.E1}, {EWMA_SQL}, s AS (SELECT *,
  avg(value) OVER w AS m, count(value) OVER w AS c FROM ew
  WINDOW w AS (PARTITION BY series ORDER BY ds ROWS 6 PRECEDING))
  SELECT series, ds, round(CASE WHEN c >= 7 THEN value - m END, 6) AS sma_residual,
  round(value - e, 6) AS ewma_residual FROM s""")
def smoothing_residual(spark, sf):
    rows = W.sma(W.ewma(S.e1(spark, sf), 30), 7)
    return rows.select("series", "ds", R6(F.col("value") - F.col("sma")).alias("sma_residual"),
                       R6(F.col("value") - F.col("ewma")).alias("ewma_residual"))


def _lag_query(name, length):
    @query(name, f"""WITH {S.L1}, w AS (SELECT series, ds, value AS label,
  lag(value, {length}) OVER o AS oldest, lag(value, 1) OVER o AS newest,
  avg(value) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING) AS m
  FROM l1 WINDOW o AS (PARTITION BY series ORDER BY ds))
  SELECT series, ds, label, CAST({length} AS INTEGER) AS n, oldest, newest, round(m, 6) AS lag_mean
  FROM w WHERE oldest IS NOT NULL""")
    def run(spark, sf):
        lags = F.col("lags")
        mean = F.aggregate(lags, F.lit(0.0), lambda a, x: a + x) / F.size(lags)
        return W.lag_windows(S.l1(spark, sf), length).select(
            "series", "ds", "label", F.size(lags).alias("n"), lags[0].alias("oldest"),
            lags[length - 1].alias("newest"), R6(mean).alias("lag_mean"))

    return run


_lag_query("lag_windows", 60)
_lag_query("lag_windows_year", 365)
_lag_query("lag_windows_two_years", 700)

ACF = """c AS (SELECT series, value - avg(value) OVER (PARTITION BY series) AS d,
  row_number() OVER (PARTITION BY series ORDER BY ds) AS rn FROM l1),
ac AS (SELECT a.series, CAST(k.lag AS INTEGER) AS lag,
  sum(a.d * b.d) / any_value(t.c0) AS r FROM range(0, {most}) k(lag), c a
  JOIN c b ON a.series = b.series AND b.rn = a.rn + k.lag
  JOIN (SELECT series, sum(d * d) AS c0 FROM c GROUP BY 1) t ON t.series = a.series GROUP BY 1, 2)"""


@query("acf", f"WITH {S.L1}, {ACF.replace('{most}', '401')} SELECT series, lag, round(r, 6) AS acf FROM ac")
def acf(spark, sf):
    return W.acf(S.l1(spark, sf), 400).withColumn("acf", R6("acf"))


@query("pacf", f"""WITH RECURSIVE {S.L1}, {ACF.replace('{most}', '51')}, rr AS (SELECT series, list(r ORDER BY lag) AS r
  FROM ac GROUP BY 1), dl AS (
  SELECT series, r, 0 AS k, []::DOUBLE[] AS phi, 1.0::DOUBLE AS p FROM rr UNION ALL
  SELECT series, r, k + 1, list_append([phi[j] - t * phi[k + 1 - j] FOR j IN range(1, k + 1)], t), t
  FROM (SELECT series, r, k, phi,
    (r[k + 2] - coalesce(list_sum([phi[j] * r[k + 2 - j] FOR j IN range(1, k + 1)]), 0)) /
    (1 - coalesce(list_sum([phi[j] * r[j + 1] FOR j IN range(1, k + 1)]), 0)) AS t
    FROM dl WHERE k < 50))
  SELECT series, CAST(k AS INTEGER) AS lag, round(p, 6) AS pacf FROM dl""")
def pacf(spark, sf):
    return W.pacf(S.l1(spark, sf), 50).withColumn("pacf", R6("pacf"))


@query("chrono_split", f"""WITH {S.E1}, n AS (SELECT series, ds,
  row_number() OVER (PARTITION BY series ORDER BY ds) AS rn,
  count(*) OVER (PARTITION BY series) AS c FROM e1)
  SELECT series, ds, CASE WHEN rn <= floor(c * 0.9) THEN 'train' ELSE 'test' END AS by_ratio,
  CASE WHEN rn <= CASE WHEN c > 60 THEN c - 60 ELSE floor(c * 0.8) END THEN 'train' ELSE 'test' END
  AS by_last FROM n""")
def chrono_split(spark, sf):
    rows = W.chrono_split(S.e1(spark, sf), ratio=0.9, out="by_ratio")
    return W.chrono_split(rows, last=60, out="by_last").drop("value")


@query("future_spine", f"""WITH {S.E1}, m AS (SELECT series, max(ds) AS e FROM e1 GROUP BY 1)
  SELECT series, CAST(h AS INTEGER) AS h, CAST(e + CAST(h AS INTEGER) AS DATE) AS ds
  FROM m, range(1, 61) r(h)""")
def future_spine(spark, sf):
    return W.future_spine(S.e1(spark, sf), 60)


@query("sort", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds, o_orderpriority FROM orders
  ORDER BY ds, o_orderpriority, o_orderkey""")
def sort(spark, sf):
    return S.table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("ds"), "o_orderpriority",
    ).orderBy("ds", "o_orderpriority", "o_orderkey")


@query("head_tail", f"""WITH {S.O1}, r AS (SELECT *, row_number() OVER
  (PARTITION BY series ORDER BY ds) AS a, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS z
  FROM o1) SELECT 'head' AS kind, series, ds, value FROM r WHERE a <= 5
  UNION ALL SELECT 'tail', series, ds, value FROM r WHERE z <= 60""")
def head_tail(spark, sf):
    rows = S.o1(spark, sf)
    return W.head(rows, 5).withColumn("kind", F.lit("head")).unionByName(
        W.tail(rows, 60).withColumn("kind", F.lit("tail")))


#: Raw events by type, three of four values unknown, and the SQL of their neighbours.
RAW = """ev AS (SELECT event_type AS series, event_id, epoch_us(ts) / 1e6 AS x,
  CASE WHEN event_id % 4 = 0 THEN value END AS value FROM events),
nb AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN {'x': x, 'v': value} END IGNORE NULLS) OVER f AS p,
  last_value(CASE WHEN value IS NOT NULL THEN {'x': x, 'v': value} END IGNORE NULLS) OVER b AS n FROM ev
  WINDOW f AS (PARTITION BY series ORDER BY x, event_id ROWS UNBOUNDED PRECEDING),
  b AS (PARTITION BY series ORDER BY x DESC, event_id DESC ROWS UNBOUNDED PRECEDING))"""
HOUR = 3600.0


def _raw(spark, sf):
    rows = S.table(spark, sf, "events").select(
        F.col("event_type").alias("series"), "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"),
        F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("value"))
    return rows


@query("ffill_long", f"""WITH {RAW} SELECT series, event_id, round(coalesce(value, p.v), 6) AS filled FROM nb""")
def ffill_long(spark, sf):
    """Raw rows of five types, in blocks of six hours."""
    rows = K.ffill_long(_raw(spark, sf), F.col("x"), 6 * HOUR, ties=("event_id",))
    return rows.select("series", "event_id", R6("filled").alias("filled"))


@query("nearest_within_long", f"""WITH {RAW} SELECT series, event_id, round(coalesce(value, CASE
  WHEN p IS NOT NULL AND (n IS NULL OR x - p.x <= n.x - x) THEN CASE WHEN x - p.x < 900 THEN p.v END
  WHEN n.x - x < 900 THEN n.v END), 6) AS filled FROM nb""")
def nearest_within_long(spark, sf):
    rows = K.nearest_within_long(_raw(spark, sf), F.col("x"), 6 * HOUR, 900.0, ties=("event_id",))
    return rows.select("series", "event_id", R6("filled").alias("filled"))


@query("interpolate_long", f"""WITH {RAW} SELECT series, event_id, round(coalesce(value, CASE
  WHEN p IS NOT NULL AND n IS NOT NULL THEN p.v + (n.v - p.v) * CASE WHEN n.x > p.x THEN (x - p.x) / (n.x - p.x)
  ELSE 0 END ELSE p.v END), 6) AS filled FROM nb""")
def interpolate_long(spark, sf):
    rows = K.interpolate_long(_raw(spark, sf), F.col("x"), 6 * HOUR, ties=("event_id",))
    return rows.select("series", "event_id", R6("filled").alias("filled"))
