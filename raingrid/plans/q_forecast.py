"""Queries: smoothing, decomposition, forecasting and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from raingrid.operators import forecast as P
from raingrid.operators import longscan as X
from raingrid.operators import smoothing as H
from raingrid.operators import windows as W
from raingrid.operators.common import to_arrays, whole_series
from raingrid.plans import series as S
from raingrid.plans.q_stats import rounded
from raingrid.plans.registry import query


def smooth_sql(name: str, arrays: str, cand: str, trend=True) -> str:
    """Recursive CTE ``name``: one row per series, candidate and step.

    ``arrays`` has (series, v) and ``cand`` has (series, candidate, alpha, beta,
    gamma, phi, m, kind); both are CTEs of usable rows.
    """
    slope = "beta * (l2 - l) + (1 - beta) * phi * b" if trend else "0.0::DOUBLE"
    first = """CASE WHEN m > 0 THEN (list_avg(v[m + 1 : 2 * m]) - list_avg(v[1 : m])) / m
      ELSE v[2] - v[1] END""" if trend else "0.0::DOUBLE"
    return f"""{name}_0 AS (SELECT *, CASE WHEN m > 0 THEN list_avg(v[1 : m]) ELSE v[1] END AS l0
  FROM {arrays} JOIN {cand} USING (series)),
{name} AS (SELECT series, candidate, 0 AS t, l0 AS l, CAST({first} AS DOUBLE) AS b,
    CASE WHEN kind = 'mul' THEN [x / l0 FOR x IN v[1 : m]] ELSE [x - l0 FOR x IN v[1 : m]] END AS s,
    NULL::DOUBLE AS y, NULL::DOUBLE AS fitted FROM {name}_0
  UNION ALL
  SELECT series, candidate, t, l2, {slope}, CASE WHEN m = 0 THEN s ELSE list_append(s[2 : m],
    gamma * CASE WHEN kind = 'mul' THEN y / base ELSE y - base END + (1 - gamma) * s[1]) END, y, ahead
  FROM (SELECT *, alpha * CASE kind WHEN 'none' THEN y WHEN 'mul' THEN y / s[1] ELSE y - s[1] END
      + (1 - alpha) * base AS l2,
      CASE kind WHEN 'none' THEN base WHEN 'mul' THEN base * s[1] ELSE base + s[1] END AS ahead
    FROM (SELECT r.series, r.candidate, r.t + 1 AS t, r.l, r.b, r.s, c.v[r.t + 1] AS y,
        r.l + c.phi * r.b AS base, c.alpha, c.beta, c.gamma, c.phi, c.m, c.kind
      FROM {name} r JOIN {name}_0 c ON c.series = r.series AND c.candidate = r.candidate
      WHERE r.t < len(c.v))))"""


def cand_sql(name: str, settings: list[dict], series: str) -> str:
    rows = ", ".join(
        f"({i}, {c['alpha']}::DOUBLE, {c['beta']}::DOUBLE, {c['gamma']}::DOUBLE, "
        f"{c['phi']}::DOUBLE, {c['m']}, '{c['kind']}')" for i, c in enumerate(settings))
    return f"""{name} AS (SELECT s.series, c.* FROM (SELECT DISTINCT series FROM {series}) s,
  (VALUES {rows}) c(candidate, alpha, beta, gamma, phi, m, kind))"""


def ahead_sql(h="h"):
    return f"""(l + CASE WHEN phi = 1 THEN {h} ELSE phi * (1 - power(phi, {h})) / (1 - phi) END * b)"""


def season_value(h="h"):
    return f"""CASE kind WHEN 'none' THEN {ahead_sql(h)}
  WHEN 'mul' THEN {ahead_sql(h)} * s[CAST(({h} - 1) % m AS INTEGER) + 1]
  ELSE {ahead_sql(h)} + s[CAST(({h} - 1) % m AS INTEGER) + 1] END"""


def arr_sql(source: str, name="arr") -> str:
    return f"""{name} AS (SELECT series, list(value ORDER BY ds) AS v, list(ds ORDER BY ds) AS d
  FROM {source} GROUP BY 1)"""


def one_sql(base, source, settings, trend=True):
    return f"""WITH RECURSIVE {base}, {arr_sql(source)}, {cand_sql('cand', [settings], source)},
{smooth_sql('hw', 'arr', 'cand', trend)}"""


FITTED = """ SELECT series, arr.d[t] AS ds, y AS value, round(fitted, 6) AS fitted FROM hw
  JOIN arr USING (series) WHERE t > 0"""


def last_sql(h: int) -> str:
    return f"""fin AS (SELECT hw.*, c.phi, c.m, c.kind, arr.d FROM hw JOIN arr USING (series)
  JOIN cand c USING (series, candidate) WHERE t = len(arr.v)),
bias AS (SELECT series, avg(y - fitted) AS bias, sqrt(avg(power(y - fitted, 2))) AS rmse
  FROM hw WHERE t > 0 GROUP BY 1),
fc AS (SELECT series, CAST(h AS INTEGER) AS h, CAST(d[-1] + CAST(h AS INTEGER) AS DATE) AS ds,
  {season_value()} AS yhat FROM fin, range(1, {h + 1}) g(h))"""


SES = H.candidate(alpha=0.3, beta=0.0, kind="none")


@query("ses", one_sql(S.E1, "e1", SES, trend=False) + FITTED)
def ses(spark, sf):
    return rounded(H.fitted_rows(H.ses(S.e1(spark, sf), 0.3)), 6, "fitted").drop("candidate")


HOLT = H.candidate(alpha=0.3, beta=0.1, kind="none")


@query("holt", one_sql(S.E1, "e1", HOLT) + FITTED)
def holt(spark, sf):
    return rounded(H.fitted_rows(H.holt(S.e1(spark, sf), 0.3, 0.1)), 6, "fitted").drop("candidate")


@query("ses_long", one_sql(S.L1, "l1", SES, trend=False) + FITTED)
def ses_long(spark, sf):
    """Blocks of 128 days, each smoothed in a task of its own."""
    return rounded(X.ses_long(S.l1(spark, sf), 0.3, block_days=128), 6, "fitted")


@query("holt_long", one_sql(S.L1, "l1", HOLT) + FITTED)
def holt_long(spark, sf):
    return rounded(X.holt_long(S.l1(spark, sf), 0.3, 0.1, block_days=128), 6, "fitted")


DAMPED = H.candidate(alpha=0.3, beta=0.05, gamma=0.2, phi=0.98, m=7)
RATIO = H.candidate(alpha=0.3, beta=0.05, gamma=0.2, m=7, kind="mul")


@query("holt_winters_fitted", one_sql(S.E1, "e1", DAMPED) + FITTED)
def holt_winters_fitted(spark, sf):
    fits = H.holt_winters(S.e1(spark, sf), **DAMPED)
    return rounded(H.fitted_rows(fits), 6, "fitted").drop("candidate")


@query("holt_winters_additive", one_sql(S.E1, "e1", DAMPED) + f""", {last_sql(14)}
  SELECT series, h, ds, round(yhat, 6) AS yhat FROM fc""")
def holt_winters_additive(spark, sf):
    fits = H.holt_winters(S.e1(spark, sf), **DAMPED)
    return rounded(H.forecast(fits, 14), 6, "yhat").drop("candidate")


@query("holt_winters_multiplicative", one_sql(S.E1, "e1", RATIO) + f""", {last_sql(14)}
  SELECT series, h, ds, round(yhat, 6) AS yhat FROM fc""")
def holt_winters_multiplicative(spark, sf):
    fits = H.holt_winters(S.e1(spark, sf), **RATIO)
    return rounded(H.forecast(fits, 14), 6, "yhat").drop("candidate")


@query("holt_winters_unbiased", one_sql(S.E1, "e1", DAMPED) + f""", {last_sql(14)}
  SELECT series, h, ds, round(greatest(yhat + bias, 35), 6) AS yhat FROM fc JOIN bias USING (series)""")
def holt_winters_unbiased(spark, sf):
    fits = H.holt_winters(S.e1(spark, sf), **DAMPED)
    return rounded(H.forecast(fits, 14, remove_bias=True, floor=35), 6, "yhat").drop("candidate")


YEARLY = H.candidate(alpha=0.1, beta=0.01, gamma=0.1, phi=0.98, m=365)


@query("holt_winters_yearly", one_sql(S.L1, "l1", YEARLY) + f""", {last_sql(365)}
  SELECT series, h, ds, round(yhat, 4) AS yhat FROM fc""")
def holt_winters_yearly(spark, sf):
    fits = H.holt_winters(S.l1(spark, sf), **YEARLY)
    return rounded(H.forecast(fits, 365), 4, "yhat").drop("candidate")


GRID = H.season_candidates("RR", alphas=(0.2, 0.5), lengths=(14, 7, 5, 3))


def grid_sql(base, source, settings, last=60):
    return f"""WITH RECURSIVE {base}, {arr_sql(source, 'whole')},
cut AS (SELECT *, CASE WHEN len(v) > {last} THEN len(v) - {last} ELSE CAST(floor(len(v) * 0.8) AS BIGINT) END
  AS k FROM whole), arr AS (SELECT series, v[1 : k] AS v, v[k + 1 :] AS test, d FROM cut),
{cand_sql('cand_all', settings, source)},
cand AS (SELECT c.* FROM cand_all c JOIN whole USING (series) JOIN arr USING (series)
  WHERE c.m < len(arr.v) / 2 AND (kind <> 'mul' OR list_min(whole.v) > 0)),
{smooth_sql('hw', 'arr', 'cand')},
bias AS (SELECT series, candidate, avg(y - fitted) AS bias FROM hw WHERE t > 0 GROUP BY 1, 2),
fin AS (SELECT hw.series, hw.candidate, hw.l, hw.b, hw.s, c.phi, c.m, c.kind, arr.test FROM hw
  JOIN arr USING (series) JOIN cand c USING (series, candidate) WHERE t = len(arr.v)),
err AS (SELECT series, candidate, avg(power(test[h] - ({season_value()}) - bias, 2)) AS mse
  FROM (SELECT fin.*, unnest(range(1, len(test) + 1)) AS h FROM fin) JOIN bias USING (series, candidate)
  GROUP BY 1, 2),
best AS (SELECT * FROM err QUALIFY row_number() OVER (PARTITION BY series ORDER BY mse, candidate) = 1)"""


@query("hw_grid_search", grid_sql(S.E1, "e1", GRID) + """
  SELECT series, CAST(candidate AS INTEGER) AS candidate, alpha, m, kind, round(mse, 5) AS mse
  FROM best JOIN cand_all USING (series, candidate)""")
def hw_grid_search(spark, sf):
    best = H.grid_search(S.e1(spark, sf), GRID)
    return rounded(best, 5, "mse").select("series", "candidate", "alpha", "m", "kind", "mse")


LONG_GRID = H.season_candidates("RH_AVG", alphas=(0.1, 0.3))


@query("hw_grid_search_long", grid_sql(S.L1, "l1", LONG_GRID) + """
  SELECT series, CAST(candidate AS INTEGER) AS candidate, alpha, m, kind, round(mse, 3) AS mse
  FROM best JOIN cand_all USING (series, candidate)""")
def hw_grid_search_long(spark, sf):
    best = H.grid_search(S.l1(spark, sf), LONG_GRID)
    return rounded(best, 3, "mse").select("series", "candidate", "alpha", "m", "kind", "mse")


def _uneven(spark, sf):
    """Days of users: some with a zero, which refuses the first model, some too short for any."""
    zero = (F.col("series").cast("bigint") % 2 == 0) & (F.dayofmonth("ds") == 3)
    return S.e2(spark, sf).withColumn("value", F.when(zero, 0.0).otherwise(F.col("value")))


UNEVEN = S.E2 + """, un AS (SELECT series, ds, CASE WHEN CAST(series AS BIGINT) % 2 = 0 AND day(ds) = 3 THEN 0
  ELSE value END AS value FROM e2), okr AS (SELECT series FROM un GROUP BY 1
  HAVING min(value) > 0 AND count(*) >= 14), oka AS (SELECT series FROM un GROUP BY 1 HAVING count(*) >= 14)"""
ADDITIVE = H.candidate(m=7)


@query("fallback_chain", f"""WITH RECURSIVE {UNEVEN}, {arr_sql('un', 'whole')},
arr AS (SELECT * FROM whole SEMI JOIN oka USING (series)),
{cand_sql('call', [RATIO, ADDITIVE], 'oka')}, cand AS (SELECT * FROM call WHERE kind = 'add'
  OR series IN (SELECT series FROM okr)), {smooth_sql('hw', 'arr', 'cand')},
fin AS (SELECT hw.*, c.phi, c.m, c.kind FROM hw JOIN arr USING (series) JOIN cand c
  USING (series, candidate) WHERE t = len(arr.v)),
hwf AS (SELECT series, candidate, CAST(h AS INTEGER) AS h, {season_value()} AS yhat
  FROM fin, range(1, 31) g(h)),
nv AS (SELECT series, month(ds) AS mo, avg(value) AS mean FROM un GROUP BY 1, 2),
ov AS (SELECT series, avg(value) AS mean, max(ds) AS e FROM un GROUP BY 1),
sp AS (SELECT series, CAST(h AS INTEGER) AS h, CAST(e + CAST(h AS INTEGER) AS DATE) AS ds, mean
  FROM ov, range(1, 31) g(h)),
j AS (SELECT sp.series, sp.ds, a.yhat AS a, b.yhat AS b, coalesce(nv.mean, sp.mean) AS c FROM sp
  LEFT JOIN hwf a ON a.series = sp.series AND a.h = sp.h AND a.candidate = 0
  LEFT JOIN hwf b ON b.series = sp.series AND b.h = sp.h AND b.candidate = 1
  LEFT JOIN nv ON nv.series = sp.series AND nv.mo = month(sp.ds))
SELECT series, ds, round(coalesce(a, b, c), 6) AS yhat,
  CAST(CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS source FROM j""")
def fallback_chain(spark, sf):
    rows = _uneven(spark, sf)
    best = H.forecast(H.holt_winters(rows, **RATIO), 30)
    default = H.forecast(H.holt_winters(rows, **ADDITIVE), 30)
    naive = P.seasonal_naive(rows, 30)
    return rounded(P.fallback_chain(best, default, naive), 6, "yhat")


@query("seasonal_naive", f"""WITH {S.O1}, m AS (SELECT series, month(ds) AS mo, avg(value) AS v FROM o1
  GROUP BY 1, 2), a AS (SELECT series, avg(value) AS v, max(ds) AS e FROM o1 GROUP BY 1),
s AS (SELECT series, CAST(h AS INTEGER) AS h, CAST(e + CAST(h AS INTEGER) AS DATE) AS ds, v AS al
  FROM a, range(1, 121) g(h)) SELECT series, h, ds, round(coalesce(v, al), 2) AS yhat
  FROM s LEFT JOIN m USING (series) WHERE mo = month(ds)""")
def seasonal_naive(spark, sf):
    return rounded(P.seasonal_naive(S.o1(spark, sf), 120), 2, "yhat")


@query("seasonal_naive_by_season", f"""WITH {S.E1}, q AS (SELECT series, {S.season_sql('ds', 'binned')} AS q,
  avg(value) AS v FROM e1 GROUP BY 1, 2), a AS (SELECT series, avg(value) AS v, max(ds) AS e FROM e1 GROUP BY 1),
s AS (SELECT series, CAST(h AS INTEGER) AS h, CAST(e + CAST(h AS INTEGER) AS DATE) AS ds, v AS al
  FROM a, range(1, 121) g(h)) SELECT s.series, h, ds, round(coalesce(q.v, al), 6) AS yhat
  FROM s LEFT JOIN q ON q.series = s.series AND q.q = {S.season_sql('s.ds', 'binned')}""")
def seasonal_naive_by_season(spark, sf):
    rows = P.seasonal_naive(S.e1(spark, sf), 120, ("season", "month"))
    return rounded(rows, 6, "yhat")


@query("interval", one_sql(S.E1, "e1", DAMPED) + f""", {last_sql(14)},
er AS (SELECT series, sqrt(avg(power(y - fitted, 2))) AS r_all,
  sqrt(avg(power(y - fitted, 2)) FILTER (t > 7)) AS r_skip,
  sqrt(avg(power(y - fitted, 2)) FILTER (t > 30 - 10)) AS r_last FROM hw WHERE t > 0 GROUP BY 1)
  SELECT series, h, ds, round(yhat, 6) AS yhat, round(yhat - 1.96 * r_all, 6) AS lo,
  round(yhat + 1.96 * r_all, 6) AS hi, round(greatest(yhat - 1.96 * r_skip, 0), 6) AS lo_skip,
  round(yhat + 1.96 * r_last, 6) AS hi_last FROM fc JOIN er USING (series)""")
def interval(spark, sf):
    fits = H.holt_winters(S.e1(spark, sf), **DAMPED)
    future, past = H.forecast(fits, 14), H.fitted_rows(fits)
    out = P.intervals(future, past, {"all": {}, "skip": {"skip": 7, "floor": 0.0}, "last": {"last": 10}})
    out = out.withColumnsRenamed({"lo_all": "lo", "hi_all": "hi"}).drop("hi_skip", "lo_last", "candidate")
    return rounded(out, 6, "yhat", "lo", "hi", "lo_skip", "hi_last")


def decompose_sql(base, source, m, mul=False):
    h = m // 2
    if m % 2:
        trend = f"""CASE WHEN count(value) OVER a = {m} THEN avg(value) OVER a END"""
        win = f"a AS (PARTITION BY series ORDER BY ds ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    else:
        trend = f"""CASE WHEN count(value) OVER a = {m} AND count(value) OVER b = {m}
    THEN (avg(value) OVER a + avg(value) OVER b) / 2 END"""
        win = f"""a AS (PARTITION BY series ORDER BY ds ROWS BETWEEN {h} PRECEDING AND {h - 1} FOLLOWING),
    b AS (PARTITION BY series ORDER BY ds ROWS BETWEEN {h - 1} PRECEDING AND {h} FOLLOWING)"""
    op, inv = ("/", "*") if mul else ("-", "+")
    return f"""{base}, dt AS (SELECT series, ds, value, {trend} AS trend,
  (row_number() OVER (PARTITION BY series ORDER BY ds) - 1) % {m} AS ph FROM {source} WINDOW {win}),
dp AS (SELECT series, ph, avg(value {op} trend) AS sm FROM dt GROUP BY 1, 2),
dc AS (SELECT *, sm {op} avg(sm) OVER (PARTITION BY series) AS seasonal FROM dp),
de AS (SELECT series, ds, value, trend, seasonal, value {op} (trend {inv} seasonal) AS resid
  FROM dt JOIN dc USING (series, ph))"""


DE_COLS = """SELECT series, ds, value, round(trend, 8) AS trend, round(seasonal, 8) AS seasonal,
  round(resid, 8) AS resid FROM de"""


@query("decompose_additive", f"WITH {decompose_sql(S.L1, 'l1', 7)} {DE_COLS}")
def decompose_additive(spark, sf):
    return rounded(P.decompose(S.l1(spark, sf)), 8, "trend", "seasonal", "resid")


@query("decompose_multiplicative", f"WITH {decompose_sql(S.E1, 'e1', 4, mul=True)} {DE_COLS}")
def decompose_multiplicative(spark, sf):
    rows = P.decompose(S.e1(spark, sf), 4, "mul")
    return rounded(rows, 8, "trend", "seasonal", "resid")


FILL = S.O1G + """, o0 AS (SELECT series, ds, value AS raw,
  count(value) OVER (PARTITION BY series) >= 0.5 * count(*) OVER (PARTITION BY series) AS use, coalesce(last_value(value IGNORE NULLS) OVER f,
  last_value(value IGNORE NULLS) OVER b) AS value FROM o1g
  WINDOW f AS (PARTITION BY series ORDER BY ds ROWS UNBOUNDED PRECEDING),
  b AS (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING))"""


@query("seasonal_trend_fill", f"""WITH {decompose_sql(FILL, 'o0', 7)}, j AS (SELECT de.series, de.ds, raw, use,
  de.value AS near, coalesce(raw, CASE WHEN use THEN trend + seasonal END) AS f
  FROM de JOIN o0 USING (series, ds))
  SELECT series, ds, raw AS value, round(coalesce(f, CASE WHEN NOT use THEN near END,
  last_value(f IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS UNBOUNDED PRECEDING),
  last_value(f IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING)), 3)
  AS filled FROM j""")
def seasonal_trend_fill(spark, sf):
    return rounded(P.seasonal_trend_fill(S.o1_grid(spark, sf), max_null=0.5), 3, "filled")


def _pairs(spark, sf):
    rows = W.sma(S.l1(spark, sf), 7, min_periods=1)
    return rows.select("series", (F.col("value") - 40).alias("actual"),
                       (F.col("sma") - 40).alias("forecast"))


@query("metrics", f"""WITH {S.L1}, p AS (SELECT series, value - 40 AS a, avg(value) OVER
  (PARTITION BY series ORDER BY ds ROWS 6 PRECEDING) - 40 AS f FROM l1)
  SELECT series, count(*) AS n, round(avg(abs(a - f)), 6) AS mae, round(avg(power(a - f, 2)), 5) AS mse,
  round(sqrt(avg(power(a - f, 2))), 6) AS rmse,
  round(100 * avg(abs((a - f) / a)) FILTER (a <> 0), 5) AS mape,
  round(100 * avg(abs(a - f) / (abs(a) + 0.01)), 4) AS mape_eps,
  round(1 - avg(power(a - f, 2)) / var_pop(a), 6) AS r2 FROM p GROUP BY 1""")
def metrics(spark, sf):
    out = rounded(P.metrics(_pairs(spark, sf)), 6, "mae", "rmse", "r2")
    return out.withColumns({"mse": F.round("mse", 5), "mape": F.round("mape", 5),
                            "mape_eps": F.round("mape_eps", 4)})


OFFSETS = [round(0.1 + i * (10 - 0.1) / 49, 6) for i in range(50)]
SHORT = H.candidate(alpha=0.3, beta=0.05, gamma=0.2, m=2)


def offset_sql(expr, root):
    err = "sqrt(mse)" if root else "mse"
    cs = ", ".join(f"({c}::DOUBLE)" for c in OFFSETS)
    return f"""WITH RECURSIVE {S.E1}, {arr_sql('e1', 'whole')},
fo AS (SELECT w.series || '/' || k || '/' || c AS series, w.series AS base, CAST(k AS INTEGER) AS k, c,
  [{expr} FOR x IN v] AS v, CAST(floor(len(v) / 6) AS BIGINT) AS bl, len(v) AS n
  FROM whole w, range(1, 6) f(k), (VALUES {cs}) o(c)),
arr AS (SELECT series, base, k, c, v[1 : n - (6 - k) * bl] AS v,
  v[n - (6 - k) * bl + 1 : n - (5 - k) * bl] AS test FROM fo),
{cand_sql('cand', [SHORT], 'arr')}, {smooth_sql('hw', 'arr', 'cand')},
fin AS (SELECT hw.*, x.phi, x.m, x.kind, arr.test, arr.base, arr.c FROM hw JOIN arr USING (series)
  JOIN cand x USING (series, candidate) WHERE t = len(arr.v)),
er AS (SELECT series, base, c, avg(power(test[h] - ({season_value()}), 2)) AS mse
  FROM (SELECT fin.*, unnest(range(1, len(test) + 1)) AS h FROM fin) GROUP BY 1, 2, 3),
ag AS (SELECT base, c, avg({err}) AS error FROM er GROUP BY 1, 2)
SELECT base AS series, c, round(error, 8) AS error FROM ag
QUALIFY row_number() OVER (PARTITION BY base ORDER BY error, c) = 1"""


@query("offset_search", offset_sql("ln(x + c)", False))
def offset_search(spark, sf):
    return rounded(H.offset_search(S.e1(spark, sf), SHORT, OFFSETS), 8, "error")


@query("offset_search_log1p", offset_sql("ln(1 + x + c)", True))
def offset_search_log1p(spark, sf):
    out = H.offset_search(S.e1(spark, sf), SHORT, OFFSETS, kind="log1p", root=True)
    return rounded(out, 8, "error")


@query("expanding_cv", f"""WITH {S.E1}, {arr_sql('e1', 'w')}, f AS (SELECT series, CAST(k AS INTEGER) AS fold,
  len(v) - (6 - k) * floor(len(v) / 6) AS a, floor(len(v) / 6) AS b FROM w, range(1, 6) g(k))
  SELECT series, fold, CAST(a AS INTEGER) AS train_rows, CAST(b AS INTEGER) AS test_rows FROM f""")
def expanding_cv(spark, sf):
    folds = H.expanding_folds(to_arrays(S.e1(spark, sf)))
    return folds.select("series", "fold", F.size("train").alias("train_rows"),
                        F.size("test").alias("test_rows"))


YW = S.L1 + """, {diff}c AS (SELECT series, ds, x - avg(x) OVER (PARTITION BY series) AS d,
  avg(x) OVER (PARTITION BY series) AS mu, row_number() OVER (PARTITION BY series ORDER BY ds) AS rn FROM src),
tt AS (SELECT series, sum(d * d) AS c0, count(*) AS n, any_value(mu) AS mu, list(d ORDER BY ds) AS x,
  max(ds) AS e FROM c GROUP BY 1),
ac AS (SELECT a.series, k.lag, sum(a.d * b.d) / any_value(tt.c0) AS r FROM range(0, 15) k(lag), c a
  JOIN c b ON a.series = b.series AND b.rn = a.rn + k.lag JOIN tt ON tt.series = a.series GROUP BY 1, 2),
rr AS (SELECT series, list(r ORDER BY lag) AS r FROM ac GROUP BY 1),
dl AS (SELECT series, r, 0 AS k, []::DOUBLE[] AS phi, 1.0::DOUBLE AS var FROM rr UNION ALL
  SELECT series, r, k + 1, list_append([phi[j] - t * phi[k + 1 - j] FOR j IN range(1, k + 1)], t),
    var * (1 - t * t) FROM (SELECT series, r, k, phi, var,
    (r[k + 2] - coalesce(list_sum([phi[j] * r[k + 2 - j] FOR j IN range(1, k + 1)]), 0)) / var AS t
    FROM dl WHERE k < 14)),
bo AS (SELECT series, k AS p, phi FROM dl JOIN tt USING (series)
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY n * ln(var) + 2 * k, k) = 1),
ro AS (SELECT series, 0 AS h, list_reverse(x[n - p + 1 : n]) AS w, NULL::DOUBLE AS y
  FROM bo JOIN tt USING (series) UNION ALL
  SELECT series, h + 1, list_prepend(y2, w)[1 : p], y2 FROM (SELECT ro.series, ro.h, ro.w, bo.p,
    coalesce(list_sum([bo.phi[j] * ro.w[j] FOR j IN range(1, bo.p + 1)]), 0) AS y2
    FROM ro JOIN bo USING (series) WHERE ro.h < {h}))"""


@query("lag_regression", "WITH RECURSIVE " + YW.replace(
    "{diff}", "src AS (SELECT series, ds, value AS x FROM l1), ").replace("{h}", "365") + """
  SELECT series, CAST(p AS INTEGER) AS p, CAST(h AS INTEGER) AS h, CAST(e + CAST(h AS INTEGER) AS DATE) AS ds,
  round(y + mu, 5) AS yhat FROM ro JOIN bo USING (series) JOIN tt USING (series) WHERE h > 0""")
def lag_regression(spark, sf):
    return rounded(P.lag_regression(S.l1(spark, sf), 14, 365), 5, "yhat")


@query("lag_regression_diff", "WITH RECURSIVE " + YW.replace(
    "{diff}", """src AS (SELECT * FROM (SELECT series, ds, value - lag(value) OVER
  (PARTITION BY series ORDER BY ds) AS x FROM l1) WHERE x IS NOT NULL), """).replace("{h}", "60") + """,
  la AS (SELECT series, arg_max(value, ds) AS last FROM l1 GROUP BY 1)
  SELECT series, CAST(p AS INTEGER) AS p, CAST(h AS INTEGER) AS h, CAST(e + CAST(h AS INTEGER) AS DATE) AS ds,
  round(last + sum(y + mu) OVER (PARTITION BY series ORDER BY h), 5) AS yhat
  FROM ro JOIN bo USING (series) JOIN tt USING (series) JOIN la USING (series) WHERE h > 0""")
def lag_regression_diff(spark, sf):
    return rounded(P.lag_regression(S.l1(spark, sf), 14, 60, d=1), 5, "yhat")


@query("lag_regression_diff2", "WITH RECURSIVE " + YW.replace(
    "{diff}", """d1 AS (SELECT series, ds, value, value - lag(value) OVER
  (PARTITION BY series ORDER BY ds) AS a FROM l1), src AS (SELECT * FROM (SELECT series, ds, a - lag(a) OVER
  (PARTITION BY series ORDER BY ds) AS x FROM d1) WHERE x IS NOT NULL), """).replace("{h}", "30") + """,
  la AS (SELECT series, arg_max(value, ds) AS l0, arg_max(a, ds) AS l1 FROM d1 GROUP BY 1),
  s1 AS (SELECT series, p, h, e, l0, l1 + sum(y + mu) OVER (PARTITION BY series ORDER BY h) AS a
  FROM ro JOIN bo USING (series) JOIN tt USING (series) JOIN la USING (series) WHERE h > 0)
  SELECT series, CAST(p AS INTEGER) AS p, CAST(h AS INTEGER) AS h, CAST(e + CAST(h AS INTEGER) AS DATE) AS ds,
  round(l0 + sum(a) OVER (PARTITION BY series ORDER BY h), 4) AS yhat FROM s1""")
def lag_regression_diff2(spark, sf):
    return rounded(P.lag_regression(S.l1(spark, sf), 14, 30, d=2), 4, "yhat")


WAVES = ["one", "trend", *[f"{n}{f}{k}" for n, m in (("w", 2), ("y", 3))
                           for k in range(1, m + 1) for f in "sc"]]


@query("fourier_regression_moments", f"""SELECT series, unnest(['{"', '".join(WAVES)}']) AS wave,
  0.0::DOUBLE AS moment FROM (SELECT DISTINCT l_returnflag AS series FROM lineitem)""")
def fourier_regression_moments(spark, sf):
    """The normal equations: mean product of each wave and the residual is 0 but for the ridge."""
    rows = S.l1(spark, sf)
    pairs = rows.join(P.fourier_regression(rows, 0), ["series", "ds"])
    t = F.datediff("ds", F.min("ds").over(whole_series())).cast("double")
    miss = F.log1p("value") - F.log1p("yhat")
    waves = pairs.select("series", miss.alias("_miss"), *[
        c.alias(n) for n, c in P.harmonics(t, 2, 3).items()])
    means = waves.groupBy("series").agg(*[F.avg(F.col(n) * F.col("_miss")).alias(n) for n in WAVES])
    long = means.unpivot(["series"], WAVES, "wave", "moment")
    return long.withColumn("moment", F.round("moment", 2) + 0.0)


DF = """SELECT series, {k} AS diff, count(x) AS n, regr_slope(v - x, x) / sqrt((regr_syy(v - x, x) -
  regr_slope(v - x, x) * regr_sxy(v - x, x)) / (count(x) - 2) / regr_sxx(v - x, x)) AS t FROM
  (SELECT series, v, lag(v) OVER (PARTITION BY series ORDER BY ds) AS x FROM ({src}) WHERE v IS NOT NULL)
  WHERE x IS NOT NULL GROUP BY 1"""
DF_SRC = {0: "SELECT series, ds, value AS v FROM l1"}
for _k in (1, 365):
    DF_SRC[_k] = (f"SELECT series, ds, value - lag(value, {_k}) OVER "
                  f"(PARTITION BY series ORDER BY ds) AS v FROM l1")


@query("stationarity_screen", f"""WITH {S.L1}, u AS (""" + " UNION ALL ".join(
    DF.format(k=k, src=src) for k, src in DF_SRC.items()) + """)
  SELECT series, CAST(diff AS INTEGER) AS diff, n, round(t, 5) AS t, t < -2.86 AS stationary FROM u""")
def stationarity_screen(spark, sf):
    return rounded(P.stationarity_screen(S.l1(spark, sf)), 5, "t")


def _flagged(spark, sf):
    return S.m1(spark, sf).select("series", "ds", "rr").withColumn(
        "rain_missing", (F.dayofmonth("ds") % 6 == 0).cast("int"))


FLAG = S.M1 + """, fl AS (SELECT series, ds, rr, CAST(day(ds) % 6 = 0 AS INTEGER) AS rain_missing,
  rr * CASE WHEN day(ds) % 6 = 0 THEN 0.1::DOUBLE ELSE 1 END AS adj FROM m1),
mn AS (SELECT series, avg(rr) FILTER (rain_missing = 0) AS m FROM fl GROUP BY 1)"""


@query("rain_flag_encoding", f"""WITH {FLAG} SELECT series, ds, round(adj, 6) AS rr_adjusted,
  CAST(adj < m * 0.2 AS INTEGER) AS rain_missing,
  round(CASE WHEN adj < m * 0.2 THEN adj / 0.1 ELSE adj END, 6) AS rr FROM fl JOIN mn USING (series)""")
def rain_flag_encoding(spark, sf):
    history = _flagged(spark, sf)
    coded = P.encode_rain_flag(history).select("series", "ds", "rr_adjusted")
    out = P.decode_rain_flag(coded, history, value="rr_adjusted")
    return rounded(out, 6, "rr", "rr_adjusted")


@query("rain_flag_dry", f"""WITH {FLAG} SELECT series, ds, rr, CAST(rr < 0.1 AS INTEGER) AS rain_missing FROM fl""")
def rain_flag_dry(spark, sf):
    return P.flag_dry(_flagged(spark, sf))


MODELS = {"ses": SES, "holt": HOLT, "winters": DAMPED}


def _models(spark, sf):
    rows = S.e1(spark, sf)
    return {"ses": H.ses(rows, 0.3), "holt": H.holt(rows, 0.3, 0.1),
            "winters": H.holt_winters(rows, **DAMPED)}


def models_sql() -> str:
    parts = [f"WITH RECURSIVE {S.E1}, {arr_sql('e1')}"]
    for n, c in MODELS.items():
        parts.append(cand_sql(f"c_{n}", [c], "e1"))
        parts.append(smooth_sql(f"hw_{n}", "arr", f"c_{n}", trend=n != "ses"))
    return ",\n".join(parts)


@query("model_comparison", models_sql() + ", r AS (" + " UNION ALL ".join(
    f"SELECT series, '{n}' AS model, sqrt(avg(power(y - fitted, 2))) AS rmse FROM hw_{n} WHERE t > 0 GROUP BY 1"
    for n in MODELS) + """) SELECT series, model, round(rmse, 6) AS rmse FROM r
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY rmse, model) = 1""")
def model_comparison(spark, sf):
    scores = None
    for name, fits in _models(spark, sf).items():
        pairs = H.fitted_rows(fits).select(
            "series", F.col("value").alias("actual"), F.col("fitted").alias("forecast"))
        part = P.metrics(pairs).select("series", F.lit(name).alias("model"), "rmse")
        scores = part if scores is None else scores.unionByName(part)
    return rounded(P.best_model(scores), 6, "rmse")


@query("model_side_by_side", models_sql() + ", " + ", ".join(
    f"""f_{n} AS (SELECT series, CAST(h AS INTEGER) AS h, CAST(d[-1] + CAST(h AS INTEGER) AS DATE) AS ds,
  {season_value()} AS yhat FROM (SELECT hw.*, c.phi, c.m, c.kind, arr.d FROM hw_{n} hw JOIN arr USING (series)
  JOIN c_{n} c USING (series, candidate) WHERE t = len(arr.v)), range(1, 31) g(h))""" for n in MODELS) + """
  SELECT series, ds, round(a.yhat, 6) AS ses, round(b.yhat, 6) AS holt, round(c.yhat, 6) AS winters
  FROM f_ses a JOIN f_holt b USING (series, ds) JOIN f_winters c USING (series, ds)""")
def model_side_by_side(spark, sf):
    future = {n: H.forecast(fits, 30) for n, fits in _models(spark, sf).items()}
    return rounded(P.side_by_side(future), 6, *MODELS)
