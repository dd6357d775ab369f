"""Queries: imputation and feature transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.functions import values as V
from raingrid.operators import impute as I
from raingrid.operators import quantiles
from raingrid.operators import transform as X
from raingrid.plans import series as S
from raingrid.plans.q_stats import rounded
from raingrid.plans.registry import query


def line_sql(name: str, source: str, col: str, out: str, both=True) -> str:
    """CTE adding ``out``: ``col`` interpolated in time over ``source``."""
    tail = "coalesce(_pv, _nv)" if both else "_pv"
    return f"""{name}_k AS (SELECT *, last_value(CASE WHEN {col} IS NOT NULL THEN ds END IGNORE NULLS)
  OVER f AS _pd, last_value({col} IGNORE NULLS) OVER f AS _pv,
  last_value(CASE WHEN {col} IS NOT NULL THEN ds END IGNORE NULLS) OVER b AS _nd,
  last_value({col} IGNORE NULLS) OVER b AS _nv FROM {source}
  WINDOW f AS (PARTITION BY series ORDER BY ds ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT * EXCLUDE (_pd, _pv, _nd, _nv), CASE WHEN {col} IS NOT NULL THEN {col}
  WHEN _pd IS NOT NULL AND _nd IS NOT NULL THEN _pv + (_nv - _pv) * date_diff('day', _pd, ds) /
  date_diff('day', _pd, _nd) ELSE {tail} END AS {out} FROM {name}_k)"""


def repair_sql(name: str, source: str, cols: dict[str, str]) -> str:
    """CTE with columns tx, tn, tavg computed by ``cols`` and tavg held between."""
    return f"""{name}_r AS (SELECT series, ds, {cols['tx']} AS tx, {cols['tn']} AS tn,
  {cols['tavg']} AS tavg FROM {source}), {name} AS (SELECT series, ds, tx, tn,
  CASE WHEN c < tn THEN tn ELSE c END AS tavg FROM (SELECT *, CASE WHEN tavg > tx THEN tx ELSE tavg END
  AS c FROM {name}_r))"""


M2_FILL = ",\n".join([
    S.M2,
    repair_sql("a0", "m2", {"tx": "coalesce(tx, 2 * tavg - tn)", "tn": "tn", "tavg": "tavg"}),
    line_sql("a1", "a0", "tx", "txf"),
    repair_sql("b0", "a1", {"tx": "txf", "tn": "coalesce(tn, 2 * tavg - txf)", "tavg": "tavg"}),
    line_sql("b1", "b0", "tn", "tnf"),
    repair_sql("c0", "b1", {"tx": "tx", "tn": "tnf", "tavg": "coalesce(tavg, (tx + tnf) / 2)"}),
    line_sql("c1", "c0", "tavg", "tf"),
])


@query("temperature_relation_fill", f"""WITH {M2_FILL} SELECT series, ds, round(tx, 6) AS tx,
  round(tn, 6) AS tn, round(tf, 6) AS tavg FROM c1""")
def temperature_relation_fill(spark, sf):
    return rounded(I.temperature_relation_fill(S.m2(spark, sf)), 6, "tx", "tn", "tavg")


def _dry_m1(spark, sf):
    return S.m1_grid(spark, sf).withColumn(
        "rh", F.when(F.dayofmonth("ds") % 4 != 0, F.col("rh")))


DEW = S.M1G + """, h AS (SELECT series, ds, tavg, CASE WHEN day(ds) % 4 <> 0 THEN rh END AS rh FROM m1g),
d AS (SELECT *, tavg - (100 - rh) / 5 AS dew FROM h),
""" + line_sql("e", "d", "dew", "dewf") + """,
g AS (SELECT *, least(greatest(coalesce(rh, 100 - 5 * (tavg - dewf)), 0), 100) AS g FROM e),
g2 AS (SELECT * REPLACE (CASE WHEN rh IS NULL AND tavg IS NULL THEN NULL ELSE g END AS g) FROM g),
""" + line_sql("z", "g2", "g", "gf")


@query("humidity_from_dewpoint", f"""WITH {DEW} SELECT series, ds, tavg, rh,
  round(gf, 6) AS rh_filled FROM z""")
def humidity_from_dewpoint(spark, sf):
    rows = I.humidity_from_dewpoint(_dry_m1(spark, sf).select("series", "ds", "tavg", "rh"))
    return rounded(rows, 6, "rh_filled")


SUN = S.M1G + """, h AS (SELECT series, ds, rr - 1 AS ss FROM m1g),
""" + line_sql("e", "h", "ss", "f")


@query("daylight_cap", f"""WITH {SUN}, dl AS (SELECT *, acos(greatest(least(
  -tan(radians(5.5::DOUBLE)) * tan(radians(23.45::DOUBLE *
  sin(radians(360.0::DOUBLE * (284 + dayofyear(ds)) / 365)))), 1), -1)) * 24 / pi() AS hours FROM e)
  SELECT series, ds, ss, round(greatest(least(f, hours), 0), 6) AS ss_filled FROM dl""")
def daylight_cap(spark, sf):
    rows = S.m1_grid(spark, sf).select("series", "ds", (F.col("rr") - 1).alias("ss"))
    return rounded(I.daylight_cap(rows, fixed.LATITUDES["Aceh"]), 6, "ss_filled")


@query("daylight_cap_fixed", f"""WITH {SUN} SELECT series, ds, ss,
  round(greatest(least(f, 12.5), 0), 6) AS ss_filled FROM e""")
def daylight_cap_fixed(spark, sf):
    rows = S.m1_grid(spark, sf).select("series", "ds", (F.col("rr") - 1).alias("ss"))
    return rounded(I.daylight_cap(rows, None), 6, "ss_filled")


def _directions(spark, sf):
    d = F.dayofmonth("ds")
    hide = (d % 5 == 0) | d.between(11, 19)
    return (
        S.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("ds"))
        .agg(F.round(F.max("value") % 360, 4).alias("direction"))
        .withColumn("direction", F.when(~hide, F.col("direction"))))


DIR = f"""dd AS (SELECT event_type AS series, CAST(ts AS DATE) AS ds, CASE WHEN NOT
  (day(CAST(ts AS DATE)) % 5 = 0 OR day(CAST(ts AS DATE)) BETWEEN 11 AND 19)
  THEN round(max(value) % 360, 4) END AS direction FROM events GROUP BY event_type, CAST(ts AS DATE)),
nr AS (SELECT series, ds, direction,
  date_diff('day', last_value(CASE WHEN direction IS NOT NULL THEN ds END IGNORE NULLS) OVER f, ds) AS pb,
  last_value(direction IGNORE NULLS) OVER f AS pv,
  date_diff('day', ds, last_value(CASE WHEN direction IS NOT NULL THEN ds END IGNORE NULLS) OVER b) AS nb,
  last_value(direction IGNORE NULLS) OVER b AS nv,
  {{m}} FROM dd WINDOW f AS (PARTITION BY series ORDER BY ds ROWS UNBOUNDED PRECEDING),
  b AS (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING)),
nn AS (SELECT *, CASE WHEN pb < 4 AND (nb IS NULL OR pb <= nb) THEN pv WHEN nb < 4 THEN nv END AS near
  FROM nr)"""


def _angles(*keys):
    out = []
    for name, part in keys:
        y = f"avg(sin(radians(direction))) OVER (PARTITION BY {part})"
        x = f"avg(cos(radians(direction))) OVER (PARTITION BY {part})"
        out.append(f"(degrees(atan2({y}, {x})) + 360) % 360 AS {name}, "
                   f"sqrt(power({y}, 2) + power({x}, 2)) AS {name}_r")
    return ", ".join(out)


DIR = DIR.replace("{m}", _angles(
    ("mo", "series, month(ds)"), ("se", f"series, {S.season_sql('ds', 'two_sep')}"),
    ("al", "series")))


@query("wind_direction_fill", f"""WITH {DIR} SELECT series, ds, direction,
  round(coalesce(direction, CASE WHEN mo_r > 0.5 THEN mo END, CASE WHEN se_r > 0.5 THEN se END,
  near, al), 5) AS filled FROM nn""")
def wind_direction_fill(spark, sf):
    return rounded(I.wind_direction_fill(_directions(spark, sf), days=4), 5, "filled")


@query("wind_direction_fill_strict", f"""WITH {DIR} SELECT series, ds, direction,
  round(coalesce(direction, CASE WHEN mo_r > 0.99 THEN mo END, CASE WHEN se_r > 0.99 THEN se END,
  near, al), 5) AS filled FROM nn""")
def wind_direction_fill_strict(spark, sf):
    return rounded(I.wind_direction_fill(_directions(spark, sf), 0.99, days=4), 5, "filled")


@query("wind_direction_fill_nearest_first", f"""WITH {DIR} SELECT series, ds, direction,
  round(coalesce(direction, CASE WHEN day(ds) % 4 <> 0 THEN near END, mo, se), 5) AS filled FROM nn""")
def wind_direction_fill_nearest_first(spark, sf):
    """The near date only on days with a known greatest speed."""
    rows = _directions(spark, sf).withColumn("speed", F.when(F.dayofmonth("ds") % 4 != 0, 3.0))
    out = I.wind_direction_fill(rows, nearest_first=True, days=4, speed="speed")
    return rounded(out.drop("speed"), 5, "filled")


def _wind_pairs(spark, sf):
    x = F.col("l_extendedprice") / 10000
    y = x * 0.6 + F.col("l_discount") * 5
    return S.r1(spark, sf).select(
        "l_orderkey", "l_partkey", "l_linenumber", F.col("l_returnflag").alias("series"),
        x.alias("x"), F.when(F.col("l_linenumber") != 3, y).alias("y"))


PAIRS = S.R1 + """, xy AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag AS series,
  l_extendedprice / 10000 AS x, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 10000 * 0.6::DOUBLE +
  l_discount * 5 END AS y, (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 5 < 4 AS tr FROM r1),
ft AS (SELECT series, corr(y, x) AS r, regr_slope(y, x) FILTER (tr) AS slope,
  regr_intercept(y, x) FILTER (tr) AS intercept FROM xy GROUP BY 1),
sc AS (SELECT series, sqrt(avg(power(y - slope * x - intercept, 2))) AS rmse,
  1 - sum(power(y - slope * x - intercept, 2)) / regr_syy(y, x) AS r2
  FROM xy JOIN ft USING (series) WHERE NOT tr AND y IS NOT NULL GROUP BY 1)"""


def _train():
    return (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % 5 < 4


@query("regression_fits", f"""WITH {PAIRS} SELECT series, round(r, 6) AS r, round(slope, 6) AS slope,
  round(intercept, 6) AS intercept, round(r2, 6) AS test_r2, round(rmse, 6) AS test_rmse
  FROM ft JOIN sc USING (series)""")
def regression_fits(spark, sf):
    return rounded(I.regression_fits(_wind_pairs(spark, sf), _train()), 6, "r", "slope",
                   "intercept", "test_r2", "test_rmse")


@query("regression_fill", f"""WITH {PAIRS} SELECT l_orderkey, l_partkey, l_linenumber, series,
  round(coalesce(y, CASE WHEN r > 0.7 AND r2 > 0.65 THEN slope * x + intercept END), 6) AS filled
  FROM xy JOIN ft USING (series) JOIN sc USING (series)""")
def regression_fill(spark, sf):
    pairs = _wind_pairs(spark, sf)
    fits = I.regression_fits(pairs, _train())
    return rounded(I.regression_fill(pairs, fits), 6, "filled").drop("x", "y")


def _rain(spark, sf):
    hide = (F.dayofmonth("ds") % 6 == 0) | F.dayofmonth("ds").between(10, 14)
    return S.m1_grid(spark, sf).select(
        "series", "ds", F.when(~hide, F.col("rr")).alias("rr"))


RAIN = S.M1G + """, rn AS (SELECT series, ds, CASE WHEN NOT (day(ds) % 6 = 0 OR day(ds) BETWEEN 10 AND 14)
  THEN rr END AS rr FROM m1g)"""


@query("dry_season_zero_then_mean", f"""WITH {RAIN}, s AS (SELECT *,
  {S.season_sql('ds', 'two_oct')} AS s FROM rn), m AS (SELECT *, avg(coalesce(rr, 0)) OVER
  (PARTITION BY series ORDER BY ds ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS m FROM s)
  SELECT series, ds, rr, round(coalesce(rr, CASE WHEN s = 'Dry' THEN 0 ELSE m END), 6) AS filled
  FROM m""")
def dry_season_zero_then_mean(spark, sf):
    return rounded(I.dry_season_zero_then_mean(_rain(spark, sf)), 6, "filled")


ADAPT = RAIN + f""", s AS (SELECT *, {S.season_sql('ds', 'two_sep')} AS s,
  CASE WHEN rr IS NULL AND month(ds) IN (4, 5, 6) THEN 0 ELSE rr END AS v FROM rn),
m AS (SELECT *, CASE s WHEN 'Wet' THEN CASE WHEN count(*) OVER w >= 3 THEN avg(coalesce(v, 0)) OVER w END
  ELSE CASE WHEN count(*) OVER d >= 3 THEN avg(coalesce(v, 0)) OVER d END END AS m FROM s
  WINDOW w AS (PARTITION BY series, s ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
    d AS (PARTITION BY series, s ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))"""


@query("adaptive_season_mean", f"""WITH {ADAPT} SELECT series, ds, rr,
  round(coalesce(v, m), 6) AS filled FROM m""")
def adaptive_season_mean(spark, sf):
    return rounded(I.adaptive_season_mean(_rain(spark, sf)), 6, "filled")


def _cardinals(spark, sf):
    d = F.dayofmonth("ds")
    names = F.array(*[F.lit(x) for x in ("N ", "SE", "C ", "bad", "WNW ", "E")])
    name = F.element_at(names, F.pmod(F.floor(F.col("rr")), F.lit(6)).cast("int") + 1)
    return S.m1_grid(spark, sf).select(
        "series", "ds", F.when((d % 3 != 0) & F.col("rr").isNotNull(), name).alias("cardinal"),
        F.when(d % 4 == 0, F.col("rr") * 14.4).alias("direction"))


CARD = S.M1G + """, cd AS (SELECT series, ds, CASE WHEN day(ds) % 3 <> 0 THEN
  (['N ', 'SE', 'C ', 'bad', 'WNW ', 'E'])[CAST(floor(rr) AS INTEGER) % 6 + 1] END AS cardinal,
  CASE WHEN day(ds) % 4 = 0 THEN rr * 14.4::DOUBLE END AS direction FROM m1g),
c0 AS (SELECT *, coalesce(CASE WHEN trim(cardinal) IN ('N','NNE','NE','ENE','E','ESE','SE','SSE','S',
  'SSW','SW','WSW','W','WNW','NW','NNW') THEN trim(cardinal) END,
  (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])
  [CAST(round_even(direction / 22.5, 0) AS INTEGER) % 16 + 1]) AS f0 FROM cd),
c1 AS (SELECT *, month(ds) AS m, {season} AS s FROM c0)"""
CARD = CARD.replace("{season}", S.season_sql("ds", "two_sep"))
CARD_STEPS = """WITH {card},
mm AS (SELECT series, m, f0 AS v FROM c1 WHERE f0 IS NOT NULL GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY series, m ORDER BY count(*) DESC, f0) = 1),
d1 AS (SELECT c1.*, coalesce(f0, v) AS f1 FROM c1 LEFT JOIN mm USING (series, m)),
ms AS (SELECT series, s, f1 AS v FROM d1 WHERE f1 IS NOT NULL GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY series, s ORDER BY count(*) DESC, f1) = 1),
d2 AS (SELECT d1.*, coalesce(f1, v) AS f2 FROM d1 LEFT JOIN ms USING (series, s)),
ma AS (SELECT series, f2 AS v FROM d2 WHERE f2 IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, f2) = 1)
SELECT d2.series, ds, cardinal, direction, coalesce(f2, v, 'N') AS filled FROM d2 LEFT JOIN ma USING (series)"""


@query("cardinal_clean", CARD_STEPS.replace("{card}", CARD))
def cardinal_clean(spark, sf):
    return I.cardinal_clean(_cardinals(spark, sf))


@query("mean_zero_fill", f"""WITH {S.E2G} SELECT series, ds, value,
  round(coalesce(value, avg(value) OVER (PARTITION BY series)), 8) AS with_mean,
  coalesce(value, 0) AS with_zero FROM e2g""")
def mean_zero_fill(spark, sf):
    rows = I.mean_fill(S.e2_grid(spark, sf), out="with_mean").withColumn(
        "with_zero", F.col("value"))
    return rounded(I.zero_fill(rows, ["with_zero"]), 8, "with_mean")


@query("sentinel_mean_fill", f"""WITH {S.E2G}, c AS (SELECT series, ds,
  CASE WHEN day(ds) % 7 = 0 THEN 8888 ELSE value END AS value FROM e2g),
  z AS (SELECT *, CASE WHEN value = 8888 THEN 0 ELSE value END AS v FROM c)
  SELECT series, ds, value, round(coalesce(v, avg(v) OVER (PARTITION BY series)), 8) AS filled FROM z""")
def sentinel_mean_fill(spark, sf):
    rows = S.e2_grid(spark, sf).withColumn(
        "value", F.when(F.dayofmonth("ds") % 7 == 0, 8888.0).otherwise(F.col("value")))
    return rounded(I.sentinel_mean_fill(rows), 8, "filled")


def _kinds_sql():
    from raingrid.plans.q_windows import RAGGED

    lines = """ln AS (SELECT *, CASE WHEN value IS NOT NULL OR rn - prn <= 2 THEN line END AS i2,
  CASE WHEN value IS NOT NULL OR rn - prn <= 3 THEN line END AS i3,
  CASE WHEN value IS NOT NULL OR rn - prn <= 2 OR nrn - rn <= 2 THEN line END AS b2,
  CASE WHEN value IS NOT NULL OR rn - prn <= 3 OR nrn - rn <= 3 THEN line END AS b3,
  last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS 2 PRECEDING) AS f2 FROM li)"""
    return f"""WITH {RAGGED}, {lines} SELECT series, ds, value, coalesce(value, 0) AS rainfall,
  round(i2, 6) AS rainfall_other, round(last_value(i3 IGNORE NULLS) OVER
  (PARTITION BY series ORDER BY ds ROWS 2 PRECEDING), 6) AS radiation,
  last_value(f2 IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds DESC ROWS 2 PRECEDING) AS humidity,
  round(b3, 6) AS sst, round(b2, 6) AS wind FROM ln"""


@query("typed_fill", _kinds_sql())
def typed_fill(spark, sf):
    from raingrid.plans.q_windows import _ragged

    rows = _ragged(spark, sf)
    kinds = ("rainfall", "rainfall_other", "radiation", "humidity", "sst", "wind")
    for kind in kinds:
        rows = I.typed_fill(rows, kind, out=kind)
    return rounded(rows, 6, "rainfall_other", "radiation", "sst", "wind")


RSF = RAIN + ",\n" + line_sql("f1", "rn", "rr", "f", both=False)


@query("rain_simple_fill", f"""WITH {RSF} SELECT series, ds, round(greatest(coalesce(f, last_value(f
  IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING)), 0.1), 6) AS rr
  FROM f1""")
def rain_simple_fill(spark, sf):
    return rounded(I.rain_simple_fill(_rain(spark, sf)), 6, "rr")


@query("log_sqrt", f"""WITH {S.E1} SELECT series, ds, round(ln(value + 0.5), 6) AS log_c,
  round(ln(1 + value + 0.5), 6) AS log1p_c, round(sqrt(value), 6) AS root,
  round(exp(ln(value + 0.5)) - 0.5, 6) AS back_log, round(value, 6) AS back_log1p,
  round(sqrt(value) * sqrt(value), 6) AS back_root FROM e1""")
def log_sqrt(spark, sf):
    v = F.col("value")
    rows = S.e1(spark, sf).select(
        "series", "ds", V.log_shift(v, 0.5).alias("log_c"),
        V.log_shift(v, 0.5, "log1p").alias("log1p_c"), F.sqrt(v).alias("root"))
    rows = rows.withColumns({
        "back_log": V.unlog_shift(F.col("log_c"), 0.5),
        "back_log1p": V.unlog_shift(F.col("log1p_c"), 0.5, "log1p"),
        "back_root": F.col("root") * F.col("root")})
    return rounded(rows, 6, "log_c", "log1p_c", "root", "back_log", "back_log1p", "back_root")


SCALES = {
    "standard": ("avg(value)", "stddev_pop(value)"),
    "minmax": ("min(value)", "max(value) - min(value)"),
    "robust": ("quantile_cont(value, 0.5)",
               "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"),
}


def _scale_query(kind):
    shift, width = SCALES[kind]

    @query(f"scale_{kind}", f"""WITH {S.E1}, s AS (SELECT series, {shift} AS a, {width} AS b FROM e1
  GROUP BY 1) SELECT series, ds, round((value - a) / b, 6) AS scaled, round(value, 6) AS back
  FROM e1 JOIN s USING (series)""")
    def run(spark, sf):
        rows = S.e1(spark, sf)
        stats = X.scale_stats(rows, kind)
        out = X.unscale(X.scale(rows, stats).drop("value"), stats, out="back")
        return rounded(out, 6, "scaled", "back")

    return run


for _kind in SCALES:
    _scale_query(_kind)


@query("winsorize", f"""WITH {S.E1}, q AS (SELECT series, quantile_cont(value, 0.05) AS a,
  quantile_cont(value, 0.95) AS b FROM e1 GROUP BY 1), r AS (SELECT *,
  row_number() OVER (PARTITION BY series ORDER BY value) AS rn, count(*) OVER (PARTITION BY series) AS n
  FROM e1), w AS (SELECT series, max(value) FILTER (rn = floor(n * 0.05) + 1) AS lo,
  max(value) FILTER (rn = n - floor(n * 0.05)) AS hi FROM r GROUP BY 1)
  SELECT series, ds, value, round(greatest(least(value, b), a), 6) AS by_quantile,
  greatest(least(value, hi), lo) AS by_rank FROM e1 JOIN q USING (series) JOIN w USING (series)""")
def winsorize(spark, sf):
    rows = X.winsorize(S.e1(spark, sf), out="by_quantile")
    return rounded(X.winsorize_ranks(rows, out="by_rank"), 6, "by_quantile")


YJ = S.E1 + """, lam AS (SELECT (k - 20) / 10.0::DOUBLE AS lam FROM range(0, 51) t(k)),
tr AS (SELECT series, lam, CASE WHEN abs(lam) < 1e-9 THEN ln(1 + value)
  ELSE (power(value + 1, lam) - 1) / lam END AS y, ln(1 + value) AS lg FROM e1, lam),
ll AS (SELECT series, lam, -count(*) / 2.0::DOUBLE * ln(var_pop(y)) + (lam - 1) * sum(lg) AS fit,
  avg(y) AS mu, stddev_pop(y) AS sd FROM tr GROUP BY 1, 2),
best AS (SELECT * FROM ll QUALIFY row_number() OVER (PARTITION BY series ORDER BY fit DESC, lam) = 1)"""


@query("yeo_johnson", f"""WITH {YJ} SELECT series, ds, value, round(lam, 6) AS lam,
  round(((CASE WHEN abs(lam) < 1e-9 THEN ln(1 + value) ELSE (power(value + 1, lam) - 1) / lam END) - mu)
  / sd, 6) AS power FROM e1 JOIN best USING (series)""")
def yeo_johnson(spark, sf):
    rows = S.e1(spark, sf)
    return rounded(X.yeo_johnson(rows, X.power_lambdas(rows)), 6, "lam", "power")


@query("exact_quantiles", """SELECT l_returnflag AS series,
  round(quantile_cont(l_extendedprice, 0.01), 6) AS q01, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99
  FROM lineitem GROUP BY 1""")
def exact_quantiles(spark, sf):
    rows = S.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series"), F.col("l_extendedprice").alias("value"))
    q = quantiles.exact_quantiles(rows, [0.01, 0.25, 0.5, 0.99])
    names = ("q01", "q25", "q50", "q99")
    return q.select("series", *[
        F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(names)])
