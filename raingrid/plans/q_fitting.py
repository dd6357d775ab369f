"""Queries: models whose parameters are found rather than given."""

from __future__ import annotations

from pyspark.sql import functions as F

from raingrid.operators import fitting as G
from raingrid.operators import smoothing as H
from raingrid.operators.common import to_arrays
from raingrid.plans import series as S
from raingrid.plans.q_forecast import arr_sql, cand_sql, smooth_sql
from raingrid.plans.q_stats import rounded
from raingrid.plans.registry import query


def ses_error(alpha: str) -> str:
    """Squared error of single smoothing over the list v."""
    return f"""list_reduce(list_transform(v, lambda y: {{'l': y, 'e': 0.0::DOUBLE, 'y': y}}), lambda a, x:
  {{'l': {alpha} * x.y + (1 - {alpha}) * a.l, 'e': a.e + power(x.y - a.l, 2), 'y': 0.0::DOUBLE}}).e / len(v)"""


def narrowing(levels: int, points=40) -> str:
    """CTEs s0, s1, ..: the best alpha of each series among points that draw closer together."""
    out = [f"""s0 AS (SELECT series, v, alpha, {ses_error('alpha')} AS mse
  FROM arr, (SELECT i / {points}::DOUBLE AS alpha FROM range({points + 1}) g(i))
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY mse, alpha) = 1)"""]
    width = 1 / points
    for k in range(1, levels):
        out.append(f"""s{k} AS (SELECT series, v, alpha, {ses_error('alpha')} AS mse FROM (SELECT series, v,
  least(1, greatest(0, alpha + (i - {points // 2}) * {2 * width / points!r})) AS alpha
  FROM s{k - 1}, range({points + 1}) g(i))
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY mse, alpha) = 1)""")
        width *= 2 / points
    return ",\n".join(out)


@query("ses_fitted", f"""WITH {S.L1}, {arr_sql('l1')}, {narrowing(4)}
  SELECT series, round(mse, 2) AS mse FROM s3""")
def ses_fitted(spark, sf):
    """The least error that single smoothing can reach; SQL finds it by narrowing grids."""
    found = G.fitted(S.l1(spark, sf), [G.model(trend=False)])
    return rounded(found, 2, "mse").select("series", "mse")


@query("ses_fitted_short", f"""WITH {S.E1}, {arr_sql('e1')}, {narrowing(4)}
  SELECT series, round(mse, 4) AS mse FROM s3""")
def ses_fitted_short(spark, sf):
    found = G.fitted(S.e1(spark, sf), [G.model(trend=False)])
    return rounded(found, 4, "mse").select("series", "mse")


def _beside_grid(df, model, grid):
    """The best error of a grid of parameters, and whether the search reached it or better."""
    cells = H.fit(H.with_candidates(to_arrays(df), grid))
    best = cells.groupBy("series").agg(F.min(F.col("fit.sse") / F.col("fit.n")).alias("grid_mse"))
    rows = G.fitted(df, [model]).join(best, "series")
    return rows.select("series", F.round("grid_mse", 4).alias("grid_mse"),
                       (F.col("mse") <= F.col("grid_mse") * (1 + 1e-9)).alias("reached"))


def grid_error_sql(base, source, grid) -> str:
    return f"""WITH RECURSIVE {base}, {arr_sql(source)}, {cand_sql('cand', grid, source)},
{smooth_sql('hw', 'arr', 'cand')},
er AS (SELECT series, candidate, avg(power(y - fitted, 2)) AS mse FROM hw WHERE t > 0 GROUP BY 1, 2)
SELECT series, round(min(mse), 4) AS grid_mse, true AS reached FROM er GROUP BY 1"""


HOLT_GRID = [H.candidate(alpha=a / 10, beta=b / 10, kind="none") for a in range(11) for b in range(11)]


@query("holt_fitted", grid_error_sql(S.L1, "l1", HOLT_GRID))
def holt_fitted(spark, sf):
    return _beside_grid(S.l1(spark, sf), G.model(), HOLT_GRID)


HW_GRID = [H.candidate(alpha=a, beta=b, gamma=g, phi=p, m=7) for a in (0.0, 0.1, 0.3, 0.6)
           for b in (0.0, 0.1, 0.5) for g in (0.0, 0.1, 0.3, 0.6) for p in (0.8, 0.95)]


@query("hw_fitted", grid_error_sql(S.L1, "l1", HW_GRID))
def hw_fitted(spark, sf):
    return _beside_grid(S.l1(spark, sf), G.model("add", 7, damped=True), HW_GRID)


def _temperature(spark, sf):
    return S.m1(spark, sf).select("series", "ds", F.col("tavg").alias("value"))


TAVG = S.M1 + ", tv AS (SELECT series, ds, tavg AS value FROM m1)"
RATIO_GRID = [H.candidate(alpha=a, beta=b, gamma=g, m=7, kind="mul") for a in (0.05, 0.2)
              for b in (0.01, 0.1) for g in (0.05, 0.3)]


@query("hw_fitted_stations", grid_error_sql(TAVG, "tv", RATIO_GRID))
def hw_fitted_stations(spark, sf):
    return _beside_grid(_temperature(spark, sf), G.model("mul", 7), RATIO_GRID)


RAIN_MODELS = [G.model(k, m) for m in (365, 183, 90) for k in ("add", "mul")]


@query("hw_search_fitted")
def hw_search_fitted(spark, sf):
    """The seasons usual for rain, each fitted to the training part and scored on the last days."""
    best = G.search(S.l1(spark, sf), RAIN_MODELS, tries=60)
    return rounded(best, 2, "mse").select("series", "candidate", "m", "kind", "mse")
