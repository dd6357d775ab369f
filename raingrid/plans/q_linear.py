"""Queries: regressions solved per series, and the probabilities of their statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from raingrid.operators import forecast as P
from raingrid.operators import linear as L
from raingrid.operators import stats as A
from raingrid.plans import series as S
from raingrid.plans.q_stats import HIDDEN, rounded
from raingrid.plans.registry import query


def wave_list(t: str, weekly=2, yearly=3) -> str:
    """The regressors of ``forecast.harmonics`` as an SQL list."""
    out = ["1.0::DOUBLE", f"{t} / 365.25"]
    for period, order in ((7.0, weekly), (365.25, yearly)):
        for k in range(1, order + 1):
            out += [f"{f}({t} * {2 * math.pi * k / period!r})" for f in ("sin", "cos")]
    return f"[{', '.join(out)}]"


def solved_sql(name: str, source: str, size: str) -> str:
    """CTE ``name``: ``source`` (key, m) with m of ``size`` rows eliminated row by row."""
    return f"""{name} AS (SELECT *, 0 AS j FROM {source} UNION ALL
  SELECT * REPLACE ([CASE WHEN i = j + 1 THEN [x / m[j + 1][j + 1] FOR x IN m[j + 1]]
    ELSE [m[i][c] - m[i][j + 1] * m[j + 1][c] / m[j + 1][j + 1] FOR c IN range(1, len(m[i]) + 1)] END
    FOR i IN range(1, len(m) + 1)] AS m, j + 1 AS j) FROM {name} WHERE j < {size})"""


FOURIER = f"""WITH RECURSIVE {S.L1},
st AS (SELECT series, min(ds) AS s, max(ds) AS e FROM l1 GROUP BY 1),
w AS (SELECT series, ln(1 + value) AS y, {wave_list('t')} AS z FROM
  (SELECT l1.*, CAST(date_diff('day', s, ds) AS DOUBLE) AS t FROM l1 JOIN st USING (series))),
g AS (SELECT series, i, j, sum(z[i] * z[j]) AS g FROM w, range(1, 13) a(i), range(1, 13) b(j) GROUP BY 1, 2, 3),
h AS (SELECT series, i, sum(z[i] * y) AS b, count(*) AS n FROM w, range(1, 13) a(i) GROUP BY 1, 2),
r AS (SELECT series, i, list_append(list(g + CASE WHEN i = j AND i > 1 THEN 0.001 * n ELSE 0 END ORDER BY j),
  any_value(b)) AS r FROM g JOIN h USING (series, i) GROUP BY 1, 2),
sy AS (SELECT series, list(r ORDER BY i) AS m FROM r GROUP BY 1), {solved_sql('so', 'sy', '12')},
co AS (SELECT series, [x[13] FOR x IN m] AS w FROM so WHERE j = 12),
gu AS (SELECT series, CAST(s + CAST(t AS INTEGER) AS DATE) AS ds, greatest(t - date_diff('day', s, e), 0) AS h,
  exp(list_sum([w[k] * z[k] FOR k IN range(1, 13)])) - 1 AS yhat FROM
  (SELECT *, {wave_list('CAST(t AS DOUBLE)')} AS z FROM
    (SELECT st.*, w, unnest(range(date_diff('day', s, e) + {{h}} + 1)) AS t FROM st JOIN co USING (series))))"""


@query("fourier_regression", FOURIER.replace("{h}", "120") + """
  SELECT series, ds, CAST(h AS INTEGER) AS h, round(yhat, 4) AS yhat FROM gu""")
def fourier_regression(spark, sf):
    return rounded(P.fourier_regression(S.l1(spark, sf), 120), 4, "yhat")


@query("fourier_regression_score", FOURIER.replace("{h}", "0") + """,
  p AS (SELECT series, value AS a, yhat AS f FROM l1 JOIN gu USING (series, ds))
  SELECT series, count(*) AS n, round(avg(abs(a - f)), 4) AS mae, round(avg(power(a - f, 2)), 2) AS mse,
  round(sqrt(avg(power(a - f, 2))), 4) AS rmse, round(100 * avg(abs((a - f) / a)) FILTER (a <> 0), 3) AS mape,
  round(100 * avg(abs(a - f) / (abs(a) + 0.01)), 3) AS mape_eps,
  round(1 - avg(power(a - f, 2)) / var_pop(a), 6) AS r2 FROM p GROUP BY 1""")
def fourier_regression_score(spark, sf):
    rows = S.l1(spark, sf)
    guess = P.fourier_regression(rows, 0)
    pairs = rows.join(guess, ["series", "ds"]).select(
        "series", F.col("value").alias("actual"), F.col("yhat").alias("forecast"))
    out = rounded(P.metrics(pairs), 4, "mae", "rmse")
    return out.withColumns({"mse": F.round("mse", 2), "mape": F.round("mape", 3),
                            "mape_eps": F.round("mape_eps", 3), "r2": F.round("r2", 6)})


def normal_sql(x: str) -> str:
    """The rational formula of ``linear.normal_share``."""
    k = f"(1 / (1 + {L.NORMAL[0]} * abs({x})))"
    poly = "0"
    for c in reversed(L.NORMAL[1:]):
        poly = f"({poly} + ({c})) * {k}"
    upper = f"({poly}) * exp(-power({x}, 2) / 2) / sqrt(2 * pi())"
    return f"CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END"


def poly_sql(coefs, t="t") -> str:
    return " + ".join(f"({c}) * power({t}, {i})" for i, c in enumerate(coefs))


def lagged_sql(name: str, lags: str, source: str, sides="") -> str:
    """CTE ``name`` (series, diff, m): products of constant, level, ``lags`` changes and change."""
    return f"""{name}z AS (SELECT series, diff, list_concat(list_concat([1.0::DOUBLE, v[t]],
    [d[t - i] FOR i IN range(1, {lags} + 1)]), [d[t]]) AS z
  FROM (SELECT *, unnest(range({lags} + 1, n)) AS t FROM {source})),
{name}g AS (SELECT series, diff, i, j, sum(z[i] * z[j]) AS g FROM (SELECT *, unnest(range(1, len(z) + 1)) AS j
  FROM (SELECT *, unnest(range(1, len(z) + 1)) AS i FROM {name}z)) GROUP BY ALL),
{name} AS (SELECT series, diff, list(r ORDER BY i) AS m FROM
  (SELECT series, diff, i, list(g ORDER BY j) AS r FROM {name}g GROUP BY ALL) GROUP BY ALL)"""


SCREENED = {0: "value", 1: "value - lag(value) OVER o", 365: "value - lag(value, 365) OVER o"}
UNIT = P.UNIT_ROOT


@query("augmented_screen", f"""WITH RECURSIVE {S.L1}, u AS (""" + " UNION ALL ".join(
    f"SELECT series, {k} AS diff, ds, {x} AS v FROM l1 WINDOW o AS (PARTITION BY series ORDER BY ds)"
    for k, x in SCREENED.items()) + f"""),
a0 AS (SELECT series, diff, list(v ORDER BY ds) AS v, count(*) AS n FROM u WHERE v IS NOT NULL GROUP BY 1, 2),
a AS (SELECT *, [v[i + 1] - v[i] FOR i IN range(1, n)] AS d, CAST(ceil(12 * power(n / 100, 0.25)) AS BIGINT) AS pm
  FROM a0), {lagged_sql('b', 'pm', 'a')},
el AS (SELECT *, 0 AS j, []::DOUBLE[] AS rss FROM b UNION ALL
  SELECT series, diff, m2, j + 1, list_append(rss, m2[len(m2)][len(m2)]) FROM (SELECT *,
    [CASE WHEN i <= j + 1 THEN m[i] ELSE [m[i][c] - m[j + 1][c] * m[i][j + 1] / m[j + 1][j + 1]
      FOR c IN range(1, len(m) + 1)] END FOR i IN range(1, len(m) + 1)] AS m2 FROM el WHERE j < len(m) - 1)),
ic AS (SELECT series, diff, k, (n - 1 - pm) * ln(rss[k + 2] / (n - 1 - pm)) + 2 * (k + 2) AS aic
  FROM (SELECT *, unnest(range(pm + 1)) AS k FROM el JOIN a USING (series, diff) WHERE j = len(m) - 1)),
bk AS (SELECT a.*, k FROM a JOIN ic USING (series, diff)
  QUALIFY row_number() OVER (PARTITION BY series, diff ORDER BY aic, k) = 1), {lagged_sql('e', 'k', 'bk')},
es AS (SELECT series, diff, m AS g, [list_append(m[i], CASE WHEN i = 2 THEN 1.0 ELSE 0 END)
  FOR i IN range(1, len(m))] AS m FROM e), {solved_sql('so', 'es', 'len(m)')},
ts AS (SELECT series, diff, n - 1 - k AS n, k, x[1] / sqrt(rest / (n - 1 - k - (k + 2)) * x[2]) AS t FROM
  (SELECT series, diff, n, k, m[2][k + 3 : k + 4] AS x,
    g[k + 3][k + 3] - list_sum([m[i][k + 3] * g[k + 3][i] FOR i IN range(1, k + 3)]) AS rest
  FROM so JOIN bk USING (series, diff) WHERE j = len(m))),
ps AS (SELECT *, CASE WHEN t <= {UNIT['least']} THEN 0 WHEN t >= {UNIT['most']} THEN 1
  WHEN t <= {UNIT['border']} THEN {normal_sql('x1')} ELSE {normal_sql('x2')} END AS p FROM (SELECT *,
  {poly_sql(UNIT['below'])} AS x1, {poly_sql(UNIT['above'])} AS x2 FROM ts))
SELECT series, CAST(diff AS INTEGER) AS diff, CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS lags,
  round(t, 5) AS t, round(p, 6) AS p, p <= 0.05 AS stationary FROM ps""")
def augmented_screen(spark, sf):
    out = P.augmented_screen(S.l1(spark, sf), SCREENED)
    return out.withColumns({"t": F.round("t", 5), "p": F.round("p", 6)})


#: Student's distribution for whole degrees of freedom f, by its finite sum of cosines.
STUDENT = """1 - CASE WHEN f % 2 = 1 THEN 2 / pi() * (th + CASE WHEN f > 1 THEN sin(th) * list_sum(
  [cos(th) ** (2 * j - 1) * coalesce(list_product([2.0 * i / (2 * i + 1) FOR i IN range(1, j)]), 1)
    FOR j IN range(1, (f - 1) // 2 + 1)]) ELSE 0 END)
  ELSE sin(th) * list_sum([cos(th) ** (2 * j) * coalesce(list_product([(2.0 * i - 1) / (2 * i)
    FOR i IN range(1, j + 1)]), 1) FOR j IN range(0, (f - 2) // 2 + 1)]) END"""


@query("linear_trend_p", f"""WITH {HIDDEN}, y AS (SELECT series, y,
  row_number() OVER (PARTITION BY series ORDER BY yr) - 1 AS x FROM yr SEMI JOIN en USING (series)
  WHERE y IS NOT NULL), r AS (SELECT series, count(*) AS n, count(*) - 2 AS f, regr_slope(y, x) / sqrt((regr_syy(y, x)
  - power(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t FROM y GROUP BY 1
  HAVING count(*) >= 3), a AS (SELECT *, atan(abs(t) / sqrt(f)) AS th FROM r)
  SELECT series, n, round(t, 6) AS t, round({STUDENT}, 8) AS p_value FROM a""")
def linear_trend_p(spark, sf):
    rows = S.o1(spark, sf).withColumn("value", F.when(F.year("ds") != 1994, F.col("value")))
    out = A.trend_significance(A.linear_trend(rows))
    return out.select("series", "n", F.round("t", 6).alias("t"), F.round("p_value", 8).alias("p_value"))
