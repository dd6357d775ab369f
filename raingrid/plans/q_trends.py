"""Queries: penalised trends, seasons by local lines, seasonal autoregression with moving averages."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from raingrid.operators import arima as R
from raingrid.operators import stats as A
from raingrid.operators import trends as T
from raingrid.plans import series as S
from raingrid.plans.q_forecast import arr_sql
from raingrid.plans.q_stats import rounded
from raingrid.plans.registry import query

WEIGHT = 250_000.0


def _share(test: str) -> str:
    return f"CASE WHEN {test} THEN {WEIGHT}::DOUBLE ELSE 0 END"


@query("hp_trend", f"""WITH RECURSIVE {S.L1}, {arr_sql('l1')},
fw AS (SELECT series, CAST(-1 AS BIGINT) AS i, 0::DOUBLE AS d1, 0::DOUBLE AS e1, 0::DOUBLE AS f1, 0::DOUBLE AS z1,
    0::DOUBLE AS d2, 0::DOUBLE AS f2, 0::DOUBLE AS z2 FROM arr
  UNION ALL
  SELECT series, i, d, (b - d1 * e1 * f1) / d, c / d, y - e1 * z1 - f2 * z2, d1, f1, z1 FROM
    (SELECT *, a - d1 * e1 * e1 - d2 * f2 * f2 AS d FROM (SELECT *,
      1 + {_share('i <= n - 3')} + 4 * {_share('i BETWEEN 1 AND n - 2')} + {_share('i >= 2')} AS a,
      -2 * {_share('i <= n - 3')} - 2 * {_share('i BETWEEN 1 AND n - 2')} AS b, {_share('i <= n - 3')} AS c
      FROM (SELECT fw.* REPLACE (i + 1 AS i), v[i + 2] AS y, len(v) AS n FROM fw JOIN arr USING (series)
        WHERE i < len(v) - 1)))),
li AS (SELECT series, list(z1 / d1 ORDER BY i) AS z, list(e1 ORDER BY i) AS e, list(f1 ORDER BY i) AS f
  FROM fw WHERE i >= 0 GROUP BY 1),
bw AS (SELECT series, CAST(len(z) AS BIGINT) AS i, 0::DOUBLE AS x1, 0::DOUBLE AS x2 FROM li
  UNION ALL
  SELECT series, i - 1, z[i] - e[i] * x1 - f[i] * x2, x1 FROM bw JOIN li USING (series) WHERE i > 0)
SELECT series, d[i + 1] AS ds, v[i + 1] AS value, round(x1, 6) AS trend, round(v[i + 1] - x1, 6) AS cycle
FROM bw JOIN arr USING (series) WHERE i < len(v)""")
def hp_trend(spark, sf):
    """Forward and backward folds; SQL does the same recursions row by row."""
    return rounded(T.hp_trend(S.l1(spark, sf), WEIGHT), 6, "trend", "cycle")


@query("hp_trend_moments", """SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS ds,
  0.0::DOUBLE AS rest FROM lineitem GROUP BY 1, 2""")
def hp_trend_moments(spark, sf):
    """The normal equations of each day: distance plus weighted fourth difference is 0."""
    rows = T.hp_trend(S.l1(spark, sf), WEIGHT)
    w = Window.partitionBy("series").orderBy("ds")
    second = F.lag("trend").over(w) - 2 * F.col("trend") + F.lead("trend").over(w)
    rows = rows.withColumn("bend", F.coalesce(second, F.lit(0.0)))
    fourth = (F.coalesce(F.lag("bend").over(w), F.lit(0.0)) - 2 * F.col("bend")
              + F.coalesce(F.lead("bend").over(w), F.lit(0.0)))
    return rows.select("series", "ds", (F.round(WEIGHT * fourth - F.col("cycle"), 4) + 0.0).alias("rest"))


def local_lines_sql(name: str, source: str, q: int, beyond=0) -> str:
    """CTE ``name`` (series, g, pos, x): local lines through ``source`` (series, g, i, n, v)."""
    return f"""{name}p AS (SELECT *, greatest(pos - low, low + width - 1 - pos) + CASE WHEN n < {q} THEN ({q} - n) // 2
  ELSE 0 END AS reach FROM (SELECT *, greatest(0, least(least(greatest(pos, 0), n - 1) - {(q - 1) // 2}, n - width))
    AS low FROM (SELECT series, g, n, least({q}, n) AS width, unnest(range({-beyond}, n + {beyond})) AS pos
      FROM (SELECT DISTINCT series, g, n FROM {source})))),
{name}s AS (SELECT p.series, p.g, p.pos, any_value(p.n) AS n, sum(u) AS s0, sum(u * x) AS s1, sum(u * x * x) AS s2,
  sum(u * v) AS t0, sum(u * x * v) AS t1 FROM (SELECT p.*, s.i - p.pos AS x, s.v, CASE
    WHEN abs(s.i - p.pos) <= 0.001 * reach THEN 1 WHEN abs(s.i - p.pos) <= 0.999 * reach
    THEN power(1 - power(abs(s.i - p.pos) / reach, 3), 3) ELSE 0 END AS u
    FROM {name}p p JOIN {source} s ON s.series = p.series AND s.g = p.g AND s.i BETWEEN low AND low + width - 1) p
  GROUP BY 1, 2, 3),
{name} AS (SELECT series, g, pos, CASE WHEN sqrt(greatest(s2 / s0 - power(s1 / s0, 2), 0)) <= 0.001 * (n - 1)
  THEN t0 / s0 ELSE (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) END AS x FROM {name}s)"""


def mean_sql(name: str, source: str, q: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT series, i, CASE WHEN count(*) OVER w = {q} THEN avg(x) OVER w END AS x
  FROM {source} WINDOW w AS (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND {q - 1} FOLLOWING))
  WHERE x IS NOT NULL)"""


def stl_sql(base: str, source: str, m=7, seasonal=7, width=15, low_pass=9) -> str:
    return f"""WITH {base}, b AS (SELECT series, ds, value AS v, row_number() OVER (PARTITION BY series ORDER BY ds) - 1
  AS k, count(*) OVER (PARTITION BY series) AS len FROM {source}),
ph AS (SELECT series, k % {m} AS g, k // {m} AS i, v, count(*) OVER (PARTITION BY series, k % {m}) AS n FROM b),
{local_lines_sql('cy', 'ph', seasonal, 1)}, c AS (SELECT series, (pos + 1) * {m} + g AS i, x FROM cy),
{mean_sql('m1', 'c', m)}, {mean_sql('m2', 'm1', m)}, {mean_sql('m3', 'm2', 3)},
lp AS (SELECT series, 0 AS g, i, x AS v, count(*) OVER (PARTITION BY series) AS n FROM m3),
{local_lines_sql('lo', 'lp', low_pass)},
se AS (SELECT b.*, c.x - lo.x AS s FROM b JOIN c ON c.series = b.series AND c.i = k + {m}
  JOIN lo ON lo.series = b.series AND lo.pos = k),
fr AS (SELECT series, 0 AS g, k AS i, v - s AS v, len AS n FROM se), {local_lines_sql('tr', 'fr', width)}
SELECT se.series, ds, v AS value, round(tr.x, 6) AS trend, round(s, 6) AS seasonal, round(v - tr.x - s, 6) AS resid
FROM se JOIN tr ON tr.series = se.series AND tr.pos = k"""


@query("stl_trend", stl_sql(S.L1, "l1"))
def stl_trend(spark, sf):
    """One inner round; the further rounds repeat it with the trend taken off first."""
    return rounded(T.stl(S.l1(spark, sf), inner=1), 6, "trend", "seasonal", "resid").drop("weight")


@query("stl_trend_short", stl_sql(S.E1, "e1"))
def stl_trend_short(spark, sf):
    return rounded(T.stl(S.e1(spark, sf), inner=1), 6, "trend", "seasonal", "resid").drop("weight")


@query("stl_robust", f"""WITH {S.L1} SELECT series, ds, value, true AS adds_up, true AS in_range FROM l1""")
def stl_robust(spark, sf):
    """All rounds: parts add up to the value, weights lie between 0 and 1."""
    rows = T.stl(S.l1(spark, sf), outer=2)
    total = F.col("trend") + F.col("seasonal") + F.col("resid")
    return rows.select("series", "ds", "value", (F.abs(total - F.col("value")) < 1e-6).alias("adds_up"),
                       F.col("weight").between(0, 1).alias("in_range"))


def _monthly(spark, sf):
    return A.resample(S.o1(spark, sf), "month").withColumnRenamed("period", "ds")


MONTHLY = S.O1 + """, mo AS (SELECT series, CAST(date_trunc('month', ds) AS DATE) AS ds, avg(value) AS value
  FROM o1 GROUP BY 1, 2)"""

#: The orders that are tried for a series with a yearly season.
ORDERS = [R.order(1, 1, 1, 1, 1, 1, 12), R.order(1, 1, 1, 0, 1, 1, 12), R.order(0, 1, 1, 0, 1, 1, 12),
          R.order(1, 1, 0, 1, 1, 0, 12)]
GIVEN = [(ORDERS[0], [0.3, -0.4, 0.2, -0.5]), (ORDERS[1], [0.3, -0.4, -0.5]), (ORDERS[2], [-0.4, -0.5]),
         (ORDERS[3], [0.3, 0.2])]


def _polynomials(o: dict, x: list[float]):
    """Coefficients of all lags, as plain numbers."""
    value = dict(zip(R.free_parameters(o), x))
    size = R.states(o)
    ar, ma = [0.0] * (size + 1), [0.0] * (size + 1)
    for poly, own, season, sign in ((ar, "ar", "sar", -1.0), (ma, "ma", "sma", 1.0)):
        short = [1.0, *(sign * value[f"{own}{i + 1}"] for i in range(o["p" if own == "ar" else "q"]))]
        for i, c in enumerate(short):
            poly[i] += c
            if season in value:
                poly[i + o["s"]] += c * sign * value[season]
    return [-c for c in ar[1:]], [1.0, *ma[1:size]]


def loglik_sql(base: str, source: str, models: list) -> str:
    """CTEs up to ``ll`` (series, model, n, loglik): a row per step of every series and model."""
    rows, diffs = [], []
    for i, (o, x) in enumerate(models):
        phi, theta = _polynomials(o, x)
        poly = [1.0]
        for k in [1] * o["d"] + [o["s"]] * o["D"]:
            longer = poly + [0.0] * k
            poly = [c - (longer[j - k] if j >= k else 0.0) for j, c in enumerate(longer)]
        rows.append(f"({i}, {phi}::DOUBLE[], {theta}::DOUBLE[], {poly}::DOUBLE[])")
    return f"""WITH RECURSIVE {base}, {arr_sql(source)},
mdl AS (SELECT * FROM (VALUES {', '.join(rows)}) t(model, phi, theta, poly)),
w AS (SELECT series, model, phi, theta, len(phi) AS r, [list_sum([poly[j] * v[t - j + 1] FOR j IN range(1, len(poly) + 1)])
  FOR t IN range(len(poly), len(v) + 1)] AS w FROM arr, mdl),
kf AS (SELECT series, model, 0 AS t, [0.0::DOUBLE FOR i IN range(r)] AS a,
    [[CASE WHEN i = j THEN 1e6::DOUBLE ELSE 0 END FOR j IN range(r)] FOR i IN range(r)] AS p,
    0::DOUBLE AS s, 0::DOUBLE AS l FROM w
  UNION ALL
  SELECT series, model, t + 1, [phi[i] * seen[1] + coalesce(seen[i + 1], 0) FOR i IN range(1, r + 1)],
    [[theta[i] * theta[j] + CASE WHEN i < r AND j < r THEN p[i + 1][j + 1] - p[i + 1][1] * p[1][j + 1] / p[1][1]
      ELSE 0 END FOR j IN range(1, r + 1)] FOR i IN range(1, r + 1)],
    s + CASE WHEN t >= r THEN e * e / p[1][1] ELSE 0 END, l + CASE WHEN t >= r THEN ln(p[1][1]) ELSE 0 END
  FROM (SELECT *, [a[i] + p[i][1] / p[1][1] * e FOR i IN range(1, r + 1)] AS seen FROM
    (SELECT kf.*, w.phi, w.theta, w.r, w.w[kf.t + 1] - kf.a[1] AS e FROM kf JOIN w USING (series, model)
     WHERE kf.t < len(w.w)))),
ll AS (SELECT series, CAST(model AS INTEGER) AS model, n, -n / 2 * (ln(2 * pi() * s / n) + 1) - l / 2 AS loglik
  FROM (SELECT kf.*, len(w) - r AS n FROM kf JOIN w USING (series, model) WHERE kf.t = len(w)))"""


@query("arma_loglik", loglik_sql(MONTHLY, "mo", GIVEN) + """
  SELECT series, model, CAST(n AS INTEGER) AS n, round(loglik, 4) AS loglik FROM ll""")
def arma_loglik(spark, sf):
    out = R.arma_loglik(_monthly(spark, sf), GIVEN)
    return rounded(out, 4, "loglik").select("series", "model", "n", "loglik")


DAILY = [(R.order(1, 1, 1), [0.3, -0.4]), (R.order(2, 0, 1), [0.3, 0.2, -0.4])]


@query("arma_loglik_daily", loglik_sql(S.L1, "l1", DAILY) + """
  SELECT series, model, CAST(n AS INTEGER) AS n, round(loglik, 3) AS loglik FROM ll""")
def arma_loglik_daily(spark, sf):
    out = R.arma_loglik(S.l1(spark, sf), DAILY)
    return rounded(out, 3, "loglik").select("series", "model", "n", "loglik")


CELLS = [(o, list(x)) for o in ORDERS for x in itertools.product((-0.4, 0.3), repeat=len(R.free_parameters(o)))]
OF_CELL = [ORDERS.index(o) for o, _ in CELLS]


@query("arma_orders", loglik_sql(MONTHLY, "mo", CELLS) + f""",
  al AS (SELECT series, {OF_CELL}[model + 1] AS model, max(loglik) AS loglik, any_value(n) AS n FROM ll GROUP BY 1, 2)
  SELECT series, CAST(model AS INTEGER) AS model, CAST(n AS INTEGER) AS n, round(loglik, 4) AS grid_loglik,
  true AS reached FROM al""")
def arma_orders(spark, sf):
    """Every order with its best parameters, which must reach the best of a grid of them."""
    rows = _monthly(spark, sf)
    place = F.array(*map(F.lit, OF_CELL))
    grid = R.arma_loglik(rows, CELLS).groupBy("series", F.get(place, F.col("model")).alias("model")).agg(
        F.max("loglik").alias("grid_loglik"))
    found = R.arma_fit(rows, ORDERS, tries=40).join(grid, ["series", "model"])
    return found.select("series", "model", "n", F.round("grid_loglik", 4).alias("grid_loglik"),
                        (F.col("loglik") >= F.col("grid_loglik") - 1e-6).alias("reached"))
