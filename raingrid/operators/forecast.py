"""Decomposition, intervals, scoring, naive and regression forecasts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.functions import values as V
from raingrid.operators import linear as L
from raingrid.operators import windows as W
from raingrid.operators.align import outer_merge
from raingrid.operators.common import BY, backward, dealt, forward, last_known, to_arrays, total, whole_series


def seasonal_naive(df: DataFrame, horizon: int, levels=("month",), scheme="binned", by=BY, ds="ds",
                   value="value", out="yhat") -> DataFrame:
    """Future days with the mean of their month or season, else the overall mean."""
    spine = W.future_spine(df, horizon, by, ds)
    keys = {"month": lambda d: F.month(d), "season": lambda d: V.season(F.col(d), scheme)}
    names = []
    for level in levels:
        key, name = f"_{level}", f"_{level}_mean"
        means = df.groupBy(*by, keys[level](ds).alias(key)).agg(F.avg(value).alias(name))
        spine = spine.withColumn(key, keys[level](ds)).join(means, [*by, key], "left")
        names.append(name)
    overall = df.groupBy(*by).agg(F.avg(value).alias("_all"))
    spine = spine.join(overall, list(by))
    return spine.select(*by, "h", ds, F.coalesce(*names, "_all").alias(out))


def fallback_chain(*forecasts: DataFrame, by=BY, ds="ds") -> DataFrame:
    """First forecast in the given order with a value, and its place in the order.

    Forecasts are stacked and folded by one aggregate rather than joined.
    """
    stacked = None
    for i, f in enumerate(forecasts):
        part = f.select(*by, ds, F.lit(i).alias("source"), "yhat")
        stacked = part if stacked is None else stacked.unionByName(part)
    first = F.min_by(F.struct("yhat", "source"), F.when(F.col("yhat").isNotNull(), F.col("source")))
    return stacked.groupBy(*by, ds).agg(first.alias("b")).select(*by, ds, "b.yhat", "b.source")


def decompose(df: DataFrame, m: int = 7, kind="add", by=BY, ds="ds", value="value") -> DataFrame:
    """Centred moving-average trend, centred (or normalised) phase means, residual.

    The trend is null where its window is not full.
    """
    order = forward(by, ds)
    v, half = F.col(value), m // 2
    n = F.count(v)
    if m % 2:
        full = order.rowsBetween(-half, half)
        trend = F.when(n.over(full) == m, F.avg(v).over(full))
    else:
        left, right = order.rowsBetween(-half, half - 1), order.rowsBetween(1 - half, half)
        trend = F.when((n.over(left) == m) & (n.over(right) == m),
                       (F.avg(v).over(left) + F.avg(v).over(right)) / 2)
    rows = df.withColumns({"trend": trend, "_rn": F.row_number().over(order)})
    free = F.try_divide(v, F.col("trend")) if kind == "mul" else v - F.col("trend")
    rows = rows.withColumns({"_free": free, "_phase": (F.col("_rn") - 1) % m})
    rows = rows.withColumn("_season", F.avg("_free").over(whole_series((*by, "_phase"))))
    centre = F.avg(F.when(F.col("_rn") <= m, F.col("_season"))).over(whole_series(by))
    rows = rows.withColumn("_centre", centre)
    if kind == "mul":
        rows = rows.withColumn("seasonal", F.try_divide("_season", "_centre"))
        rest = F.try_divide(v, F.col("trend") * F.col("seasonal"))
    else:
        rows = rows.withColumn("seasonal", F.col("_season") - F.col("_centre"))
        rest = v - F.col("trend") - F.col("seasonal")
    return rows.withColumn("resid", rest).drop("_rn", "_free", "_phase", "_season", "_centre")


def seasonal_trend_fill(df: DataFrame, m: int = 7, max_null=0.3, by=BY, ds="ds", value="value",
                        out="filled") -> DataFrame:
    """Nulls from trend plus season of a temporarily filled series.

    With under two periods, too many nulls, or no trend at the ends, the value is
    filled from its neighbours, else from the mean.
    """
    w = whole_series(by)
    n, known = F.count(F.lit(1)).over(w), F.count(value).over(w)
    rows = df.withColumns({"_use": (n >= 2 * m) & (1 - known / n <= max_null),
                           "_avg": F.avg(value).over(w)})
    rows = W.fill_both(rows, by, ds, value, "_near").withColumn(
        "_temp", F.coalesce("_near", "_avg"))
    rows = decompose(rows, m, "add", by, ds, "_temp")
    guess = F.when(F.col("_use"), F.col("trend") + F.col("seasonal"))
    rows = rows.withColumn("_f", F.coalesce(F.col(value), guess))
    rows = W.fill_both(rows, by, ds, "_f", "_f2")
    simple = F.when(F.col("_use"), F.col("_f2")).otherwise(F.col("_near"))
    return rows.withColumn(out, F.coalesce(F.col("_f"), simple, F.col("_avg"))).select(
        *df.columns, out)


def interval(forecasts: DataFrame, fitted: DataFrame, z=1.96, skip: int = 0,
             last: int | None = None, floor: float | None = None, by=BY, ds="ds") -> DataFrame:
    """Forecast plus and minus z times the in-sample error, as lo and hi: one of ``intervals``."""
    one = {"_": {"skip": skip, "last": last, "floor": floor}}
    return intervals(forecasts, fitted, one, z, by, ds).withColumnsRenamed({"lo__": "lo", "hi__": "hi"})


def intervals(forecasts: DataFrame, fitted: DataFrame, errors: dict[str, dict], z=1.96, by=BY,
              ds="ds") -> DataFrame:
    """Several bands at once: lo_<name> and hi_<name> for each of ``errors``.

    An error is over all fitted rows, those after the first ``skip``, the last ``last`` ones, or
    both; its lower band is held at ``floor`` if given. All errors share one pass and one join.
    """
    miss = F.col("value") - F.col("fitted")
    rows = fitted
    if any(e.get("skip") for e in errors.values()):
        rows = rows.withColumn("_r", F.row_number().over(forward(by, ds)))
    if any(e.get("last") for e in errors.values()):
        rows = rows.withColumn("_left", F.row_number().over(backward(by, ds)))
    aggs = []
    for name, e in errors.items():
        use = F.lit(True)
        if e.get("skip"):
            use = use & (F.col("_r") > e["skip"])
        if e.get("last"):
            use = use & (F.col("_left") <= e["last"])
        aggs.append(F.sqrt(F.avg(F.when(use, miss * miss))).alias(f"_rmse_{name}"))
    out = forecasts.join(rows.groupBy(*by).agg(*aggs), list(by))
    for name, e in errors.items():
        low = F.col("yhat") - z * F.col(f"_rmse_{name}")
        if e.get("floor") is not None:
            low = V.bound(low, e["floor"])
        out = out.withColumns({f"lo_{name}": low, f"hi_{name}": F.col("yhat") + z * F.col(f"_rmse_{name}")})
    return out.drop(*[f"_rmse_{name}" for name in errors])


def metrics(df: DataFrame, by=BY, actual="actual", forecast="forecast", eps=0.01) -> DataFrame:
    """MAE, MSE, RMSE, MAPE over non-zero actuals, R2, and MAPE with a small base.

    Pairs with a null are left out; one pass computes everything.
    """
    a, f = F.col(actual), F.col(forecast)
    known = a.isNotNull() & f.isNotNull()
    err = a - f
    rows = df.where(known).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        (100 * F.avg(F.when(a != 0, F.abs(F.try_divide(err, a))))).alias("mape"),
        (100 * F.avg(F.abs(err) / (F.abs(a) + eps))).alias("mape_eps"),
        F.var_pop(a).alias("_var"))
    return rows.withColumns({
        "rmse": F.sqrt("mse"), "r2": 1 - F.try_divide(F.col("mse"), F.col("_var"))}).drop("_var")


def lag_regression(df: DataFrame, max_lag: int, horizon: int, d: int = 0, by=BY, ds="ds",
                   value="value", out="yhat") -> DataFrame:
    """Forecast from a regression on the previous values, order chosen by AIC.

    The coefficients of every order come from the autocorrelations by the
    Durbin-Levinson recursion, so all orders are fitted in one fold per series.
    Predictions are fed back. The series is differenced ``d`` times first, and the
    forecast summed up again as often, each time from the last value of that level.
    """
    if d < 0:
        raise ValueError("d must be 0 or more")
    source, levels = df, [value]
    for k in range(1, d + 1):
        source = W.difference(source, 1, by, ds, levels[-1], f"_d{k}")
        levels.append(f"_d{k}")
    column = levels[-1]
    known = source.where(F.col(column).isNotNull())
    rows = W.acf_arrays(known, max_lag, by, ds, column, extra=(
        F.count(F.lit(1)).alias("_n"), F.max(ds).alias("_end"),
        *[F.max_by(c, ds).alias(f"_last{k}") for k, c in enumerate(levels[:-1])]))
    r = F.transform("acf", lambda v: F.coalesce(v, F.lit(0.0)))  # equal values tell nothing
    x, size = F.col("centred"), F.size("centred")
    none = F.array().cast("array<double>")
    aic = lambda var, k: F.col("_n") * F.log(var) + 2.0 * k
    start = F.struct(none.alias("phi"), F.lit(1.0).alias("var"),
                     F.lit(0.0).alias("aic"), none.alias("best"))

    def order(s, k):
        lags = F.slice(r, F.lit(2), k - 1)
        top = r[k] - total(F.zip_with(s["phi"], F.reverse(lags), lambda a, b: a * b))
        new = F.coalesce(F.try_divide(top, s["var"]), F.lit(0.0))
        phi = F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - new * b),
                       F.array(new))
        var = s["var"] * (1.0 - new * new)
        better = aic(var, k) < s["aic"]
        return F.struct(phi.alias("phi"), var.alias("var"),
                        F.when(better, aic(var, k)).otherwise(s["aic"]).alias("aic"),
                        F.when(better, phi).otherwise(s["best"]).alias("best"))

    rows = rows.withColumn(
        "_fit", F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), start, order)
    ).withColumn("phi", F.col("_fit.best")).withColumn("p", F.size("phi"))
    tail = F.reverse(F.slice(x, size - F.col("p") + 1, F.col("p")))
    begin = F.struct(F.when(F.col("p") > 0, tail).otherwise(none).alias("w"), none.alias("out"))

    def roll(s, _):
        nxt = total(F.zip_with(s["w"], F.col("phi"), lambda a, b: a * b))
        return F.struct(
            F.slice(F.concat(F.array(nxt), s["w"]), F.lit(1), F.col("p")).alias("w"),
            F.concat(s["out"], F.array(nxt)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), begin, roll)["out"]
    steps = rows.withColumn("_path", path).select(
        *by, "p", "mean", "_end", *[f"_last{k}" for k in range(d)],
        F.posexplode_outer("_path").alias("_i", "_y")
    ).withColumn("_step", F.col("_y") + F.col("mean"))
    run = forward(by, "_i").rowsBetween(-horizon, 0)
    for k in reversed(range(d)):
        steps = steps.withColumn("_step", F.col(f"_last{k}") + F.sum("_step").over(run))
    return steps.select(*by, "p", (F.col("_i") + 1).alias("h"),
                        F.date_add("_end", F.col("_i") + 1).alias(ds), F.col("_step").alias(out))


def harmonics(t, weekly, yearly):
    """Named regressors of a day number: constant, trend, weekly and yearly waves."""
    out = {"one": F.lit(1.0), "trend": t / 365.25}
    for name, period, order in (("w", 7.0, weekly), ("y", 365.25, yearly)):
        for k in range(1, order + 1):
            angle = t * (2 * math.pi * k / period)
            out[f"{name}s{k}"], out[f"{name}c{k}"] = F.sin(angle), F.cos(angle)
    return out


def fourier_regression(df: DataFrame, horizon: int, ridge=1e-3, weekly=2, yearly=3, by=BY, ds="ds",
                       value="value", out="yhat") -> DataFrame:
    """Trend and weekly and yearly waves on log1p values; fitted and future days.

    Each series becomes its normal equations in one aggregate, and those are solved as one
    column expression. The ridge is a share of the number of days and spares the constant.
    """
    start = df.groupBy(*by).agg(F.min(ds).alias("_start"), F.max(ds).alias("_end"))
    rows = df.where(F.col(value).isNotNull()).withColumn(
        "_start", F.min(ds).over(whole_series(by)))
    t = F.datediff(ds, "_start").cast("double")
    names = list(harmonics(F.lit(0.0), weekly, yearly))
    waves = rows.select(*by, F.log1p(value).alias("_y"),
                        *[c.alias(n) for n, c in harmonics(t, weekly, yearly).items()])
    size = len(names)
    place = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(size) for j in range(i, size))}
    sums = [F.sum(F.col(names[i]) * F.col(names[j])) for i, j in place]
    sides = [F.sum(F.col(n) * F.col("_y")) for n in names]
    system = waves.groupBy(*by).agg(F.array(*sums).alias("_g"), F.array(*sides).alias("_b"))
    penalty = ridge * F.get("_g", F.lit(0))
    entry = lambda i, j: F.get("_g", F.lit(place[min(i, j), max(i, j)]))
    matrix = F.array(*[F.array(
        *[entry(i, j) + penalty if i == j and i else entry(i, j) for j in range(size)],
        F.get("_b", F.lit(i))) for i in range(size)])
    solved = F.transform(L.solve(matrix, F.lit(size)), lambda row: F.get(row, F.lit(0)))

    coefs = system.select(*by, solved.alias("_w")).join(start, list(by))
    span = F.sequence(F.lit(0), F.datediff("_end", "_start") + horizon)
    steps = coefs.select(*by, "_w", "_start", "_end", F.explode(span).alias("_t"))
    waves = harmonics(F.col("_t").cast("double"), weekly, yearly)
    guess = sum((F.col("_w")[i] * c for i, c in enumerate(waves.values())), F.lit(0.0))
    when = F.date_add("_start", F.col("_t"))
    return steps.select(*by, when.alias(ds), F.greatest(F.datediff(when, F.col("_end")), F.lit(0))
                        .alias("h"), F.expm1(guess).alias(out))


def stationarity_screen(df: DataFrame, lags=(0, 1, 365), critical=-2.86, by=BY, ds="ds",
                        value="value") -> DataFrame:
    """Dickey-Fuller t statistic of the level (0) and of each difference.

    Regresses the change on the previous value; below ``critical`` is stationary. With two
    changes or fewer the statistic is null. One pass over the rows serves all differences.
    """
    order = forward(by, ds)
    rows = df.withColumns({
        f"_v{k}": F.col(value) - F.lag(value, k).over(order) if k else F.col(value) for k in lags})
    rows = rows.withColumns({
        f"_x{k}": last_known(F.col(f"_v{k}"), order, include_current=False) for k in lags})
    results = []
    for k in lags:
        x = F.when(F.col(f"_v{k}").isNotNull(), F.col(f"_x{k}"))
        dy = F.col(f"_v{k}") - x
        n = F.regr_count(dy, x)
        slope, xx = F.regr_slope(dy, x), F.regr_sxx(dy, x)
        rss = F.regr_syy(dy, x) - slope * F.regr_sxy(dy, x)
        stat = F.when(n > 2, F.try_divide(slope, F.sqrt(F.try_divide(rss, (n - 2) * xx))))
        results.append(F.struct(F.lit(k).alias("diff"), n.alias("n"), stat.alias("t")))
    wide = rows.groupBy(*by).agg(*[r.alias(f"_r{i}") for i, r in enumerate(results)])
    return wide.select(*by, F.explode(F.array(*[f"_r{i}" for i in range(len(results))])).alias("r")
                       ).select(*by, "r.*").withColumn("stationary", F.col("t") < critical)


#: Distribution of the statistic with a constant, below and above a border, and
#: where it is 0 or 1; polynomials in the statistic under the normal distribution.
UNIT_ROOT = {"border": -1.61, "least": -18.83, "most": 2.74,
             "below": (2.1659, 1.4412, 0.038269), "above": (1.7339, 0.93202, -0.12745, -0.010368)}


def unit_root_p(t):
    """Probability of a unit-root statistic as small as ``t`` if there is a unit root."""
    def share(coefs):
        poly = F.lit(0.0)
        for c in reversed(coefs):
            poly = poly * t + c
        return L.normal_share(poly)

    return (F.when(t <= UNIT_ROOT["least"], 0.0).when(t >= UNIT_ROOT["most"], 1.0)
            .when(t <= UNIT_ROOT["border"], share(UNIT_ROOT["below"])).otherwise(share(UNIT_ROOT["above"])))


def augmented_screen(df: DataFrame, diffs=(0, 1, 365), max_lag: int | None = None, level=0.05, by=BY,
                     ds="ds", value="value") -> DataFrame:
    """Augmented Dickey-Fuller test of the level (0) and of each difference.

    Columns: ``by``, diff, n (changes used), lags, t, p and stationary (p at most ``level``). The
    change is regressed on a constant, the previous value and the last ``lags`` changes. Their
    number has the least AIC of 0 to ``max_lag`` (12 * (n / 100) ** 0.25 if not given), all on the
    changes that the longest leaves; the statistic is then taken on all changes. Nulls are left
    out. A series too short for its longest regression gets null.
    """
    order = forward(by, ds)
    wide = df.withColumns({f"_v{k}": F.col(value) - F.lag(value, k).over(order) if k else
                           F.col(value) for k in diffs})
    parts = F.array(*[F.struct(F.lit(k).alias("diff"), F.col(f"_v{k}").cast("double").alias("v"))
                      for k in diffs])
    long = wide.select(*by, ds, F.explode(parts).alias("_z")).select(*by, ds, "_z.*").where("v IS NOT NULL")
    rows = to_arrays(long, (*by, "diff"), ds, "v").withColumn("n", F.size("vals"))
    if max_lag is None:
        most = F.ceil(12 * F.pow(F.col("n") / 100.0, 0.25)).cast("int")
    else:
        most = F.lit(max_lag)
    rows = dealt(rows.withColumn("most", most), *by, "diff")
    n, v = F.col("n"), F.col("vals")
    changes = F.zip_with(F.slice(v, F.lit(2), F.greatest(n - 1, F.lit(0))),
                         F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)

    def moments(p):
        """Products of constant, previous value, ``p`` earlier changes and the change."""
        size = n - 1 - p

        def columns(d):
            back = F.when(p > 0, F.transform(
                F.sequence(F.lit(1), F.greatest(p, F.lit(1))), lambda i: F.slice(d, p - i + 1, size))
            ).otherwise(F.array().cast("array<array<double>>"))
            return F.concat(F.array(F.array_repeat(F.lit(1.0), size), F.slice(v, p + 1, size)), back,
                            F.array(F.slice(d, p + 1, size)))

        return L.products(L.let(changes, columns))

    enough = F.col("n") - 1 - F.col("most") > F.col("most") + 3
    same = F.col("n") - 1 - F.col("most")
    rss = F.slice(L.residuals(moments(F.col("most"))), F.lit(2), F.col("most") + 1)
    aic = F.transform(rss, lambda r, k: F.struct(
        (same * F.log(r / same) + 2.0 * (k + 2)).alias("aic"), k.alias("k")))
    rows = rows.withColumn("lags", F.when(enough, F.array_min(aic)["k"]))
    k = F.col("lags")

    def statistic(m):
        size = k + 2
        sides = F.transform(F.slice(m, F.lit(1), size), lambda row, i: F.concat(
            row, F.array(F.when(i == 1, 1.0).otherwise(0.0))))
        used = n - 1 - k

        def of(x):
            explained = L.dot(F.transform(x, lambda r: F.get(r, F.lit(0))),
                              F.slice(F.get(m, size), F.lit(1), size))
            left = (F.get(F.get(m, size), size) - explained) / (used - size)
            own = F.get(x, F.lit(1))
            return F.get(own, F.lit(0)) / F.sqrt(left * F.get(own, F.lit(1)))

        return L.let(L.solve(sides, size), of)

    t = F.when(k.isNotNull(), L.let(moments(k), statistic))
    return rows.withColumn("t", t).select(
        *by, "diff", (F.col("n") - 1 - k).alias("n"), "lags", "t", unit_root_p(F.col("t")).alias("p")
    ).withColumn("stationary", F.col("p") <= level)


def encode_rain_flag(df: DataFrame, rr="rr", flag="rain_missing", out="rr_adjusted") -> DataFrame:
    return df.withColumn(out, F.when(F.col(flag) == 1, F.col(rr) * 0.1).otherwise(F.col(rr)))


def decode_rain_flag(forecast: DataFrame, history: DataFrame, by=BY, rr="rr", flag="rain_missing",
                     value="yhat") -> DataFrame:
    """Flag forecasts under a fifth of the known mean rain and scale them back."""
    mean = history.groupBy(*by).agg(
        F.avg(F.when(F.col(flag) == 0, F.col(rr))).alias("_mean"))
    low = F.coalesce(F.col(value) < F.col("_mean") * 0.2, F.lit(False))
    return forecast.join(mean, list(by)).withColumns({
        flag: low.cast("int"),
        rr: F.when(low, F.col(value) / 0.1).otherwise(F.col(value))}).drop("_mean")


def flag_dry(df: DataFrame, rr="rr", flag="rain_missing", limit=0.1) -> DataFrame:
    return df.withColumn(flag, F.coalesce(F.col(rr) < limit, F.lit(False)).cast("int"))


def best_model(scores: DataFrame, by=BY, model="model", error="rmse") -> DataFrame:
    """Model with the least error per series; the name breaks a tie."""
    return scores.groupBy(*by).agg(F.min_by(F.struct(model, error), F.struct(error, model))
                                   .alias("b")).select(*by, f"b.{model}", f"b.{error}")


def side_by_side(forecasts: dict[str, DataFrame], by=BY, ds="ds", value="yhat") -> DataFrame:
    return outer_merge(forecasts, (*by, ds), value)
