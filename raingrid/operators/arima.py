"""Seasonal autoregression with moving averages: likelihood by a state-space fold.

A series is one row. The fold over its days keeps the state and its covariance as small arrays;
once the covariance no longer changes, only the state moves on. Orders and series are rows, so
they spread over the tasks.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raingrid.operators.common import BY, dealt, scan, to_arrays, whole_series
from raingrid.operators.fitting import HOPELESS, simplex_search
from raingrid.operators.linear import dot, let

#: Variance of the first state, which is unknown.
DIFFUSE = 1e6
#: Relative change of the forecast variance that counts as none.
STEADY = 1e-13


def order(p=0, d=0, q=0, P=0, D=0, Q=0, s=1) -> dict:
    """Orders of a model; those in capitals reach back by seasons of ``s`` rows. p, q, P, Q and D
    are 0 or 1 here but p and q may be larger."""
    if max(P, Q, D) > 1 or d > 2 or min(p, d, q, P, D, Q) < 0:
        raise ValueError("seasonal orders are 0 or 1, and d is at most 2")
    return {"p": p, "d": d, "q": q, "P": P, "D": D, "Q": Q, "s": s}


def free_parameters(o: dict) -> list[str]:
    return [*(f"ar{i + 1}" for i in range(o["p"])), *(f"ma{i + 1}" for i in range(o["q"])),
            *(["sar"] if o["P"] else []), *(["sma"] if o["Q"] else [])]


def _lags(own: list, seasonal, s: int, sign: float, size: int) -> list:
    """Coefficients of lags 1..size of the product of the short and the seasonal polynomial."""
    out: list = [None] * size
    for i, c in enumerate(own, 1):
        out[i - 1] = c
    if seasonal is not None:
        for i, c in [(0, None), *enumerate(own, 1)]:
            term = seasonal if c is None else sign * c * seasonal
            at = s + i - 1
            out[at] = term if out[at] is None else out[at] + term
    return [F.lit(0.0) if c is None else c for c in out]


def coefficients(o: dict, x: Column):
    """Arrays of autoregressive and moving-average coefficients over all lags, from the free
    parameters ``x`` in the order of ``free_parameters``."""
    names = free_parameters(o)
    value = {n: F.get(x, F.lit(i)) for i, n in enumerate(names)}
    size = states(o)
    ar = _lags([value[f"ar{i + 1}"] for i in range(o["p"])], value.get("sar"), o["s"], -1.0, size)
    ma = _lags([value[f"ma{i + 1}"] for i in range(o["q"])], value.get("sma"), o["s"], 1.0, size)
    return F.array(*ar), F.array(F.lit(1.0), *ma[: size - 1])


def states(o: dict) -> int:
    return max(o["p"] + o["P"] * o["s"], o["q"] + o["Q"] * o["s"] + 1)


def differenced(vals: Column, o: dict) -> Column:
    """The series after ``d`` plain differences and ``D`` seasonal ones; null next to a null."""
    def once(v, k):
        return let(v, lambda v: F.zip_with(F.slice(v, F.lit(k + 1), F.greatest(F.size(v) - k, F.lit(0))),
                                           F.slice(v, F.lit(1), F.greatest(F.size(v) - k, F.lit(0))),
                                           lambda a, b: a - b))

    out = F.transform(vals, lambda x: x.cast("double"))
    for k in [1] * o["d"] + [o["s"]] * o["D"]:
        out = once(out, k)
    return out


def _filtered(w: Column, phi: Column, theta: Column, r: int) -> Column:
    """The state after the last of ``w``: a, s (squared errors over their variance), l (logs of
    the variances) and n (values counted; the first ``r`` settle the state and are not)."""
    unit = F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(r - 1)), lambda j: F.when(i == j, DIFFUSE).otherwise(0.0)))
    zero = F.array_repeat(F.lit(0.0), r)
    start = F.struct(
        zero.alias("a"), unit.alias("p"), F.lit(0.0).alias("f"), F.lit(0).alias("same"),
        F.lit(0.0).alias("s"), F.lit(0.0).alias("l"), F.lit(0).alias("n"), F.lit(0).alias("seen"))

    def moved(p, known, f):
        """Covariance of the next state."""
        gain = F.get(p, F.lit(0))  # the first row, equal to the first column

        def entry(i, j):
            both = F.coalesce(F.get(F.get(p, i), j), F.lit(0.0))
            return F.when(known, both - F.coalesce(F.get(gain, i), F.lit(0.0))
                          * F.coalesce(F.get(gain, j), F.lit(0.0)) / f).otherwise(both)

        # What is left after the value is known; its first row is 0 then.
        left = F.transform(F.sequence(F.lit(0), F.lit(r)), lambda i: F.transform(
            F.sequence(F.lit(0), F.lit(r)), lambda j: entry(i, j)))
        return let(left, lambda m: let(F.get(m, F.lit(0)), lambda top: F.transform(
            F.slice(m, 2, r), lambda row, i: let(F.struct(
                F.get(phi, i).alias("c"), F.get(row, F.lit(0)).alias("e"), F.get(theta, i).alias("t")),
                lambda own: F.transform(F.slice(row, 2, r), lambda x, j: (
                    own["c"] * F.get(phi, j) * F.get(top, F.lit(0)) + own["c"] * F.get(top, j + 1)
                    + F.get(phi, j) * own["e"] + x + own["t"] * F.get(theta, j)))))))

    def step(st, y):
        known = y.isNotNull()
        f, steady = F.get(F.get(st["p"], F.lit(0)), F.lit(0)), st["same"] > r
        v = F.when(known, y - F.get(st["a"], F.lit(0))).otherwise(0.0)
        counted = known & (st["seen"] >= r)
        seen = let(F.transform(F.get(st["p"], F.lit(0)), lambda g: g / f * v), lambda k: F.zip_with(
            st["a"], k, lambda a, b: a + b))
        ahead = let(seen, lambda a: let(F.get(a, F.lit(0)), lambda first: F.zip_with(
            phi, F.concat(F.slice(a, 2, r - 1), F.array(F.lit(0.0))), lambda c, x: c * first + x)))
        unchanged = known & (F.abs(f - st["f"]) <= STEADY * f)
        return F.struct(
            ahead.alias("a"),
            F.when(steady & known, st["p"]).otherwise(moved(st["p"], known, f)).alias("p"),
            F.when(known, f).otherwise(0.0).alias("f"),
            F.when(unchanged, st["same"] + 1).otherwise(0).alias("same"),
            F.when(counted, st["s"] + v * v / f).otherwise(st["s"]).alias("s"),
            F.when(counted, st["l"] + F.log(f)).otherwise(st["l"]).alias("l"),
            (st["n"] + counted.cast("int")).alias("n"), (st["seen"] + known.cast("int")).alias("seen"))

    return F.aggregate(w, start, step)


def _loglik(end: Column) -> Column:
    n = end["n"].cast("double")
    return -n / 2 * (F.log(2 * math.pi * end["s"] / n) + 1) - end["l"] / 2


def arma_loglik(df: DataFrame, orders: list[tuple[dict, list[float]]], by=BY, ds="ds",
                value="value") -> DataFrame:
    """Gaussian log-likelihood of every series under models with given parameters.

    ``orders`` holds (``order``, values of its free parameters). The series is differenced first;
    the variance is the best one; the first values, as many as the model has states, settle the
    state and are not counted. Columns: ``by``, model, n, sigma2, loglik, aic. Nulls are passed
    over. A series with no value left gets null.
    """
    rows = to_arrays(df, by, ds, value)
    numbered = F.array(*map(F.lit, range(len(orders))))
    rows = dealt(rows.withColumn("model", F.explode(numbered)), *by, "model")

    def of(o, x):
        given = F.array(*[F.lit(float(v)) for v in x]) if x else F.array().cast("array<double>")
        phi, theta = coefficients(o, given)
        own = let(differenced(F.col("vals"), o), lambda w: _filtered(w, phi, theta, states(o)))
        return let(own, lambda e: F.struct(e["n"].alias("n"), e["s"].alias("s"), e["l"].alias("l"),
                                           F.lit(len(x) + 1).alias("k")))

    end = F.coalesce(*[F.when(F.col("model") == i, of(o, x)) for i, (o, x) in enumerate(orders)])
    rows = rows.withColumn("_e", end).select(*by, "model", "_e.*").withColumn(
        "loglik", F.when(F.col("n") > 0, _loglik({c: F.col(c) for c in ("n", "s", "l")})))
    return rows.select(*by, "model", "n", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("sigma2"),
                       "loglik", (2.0 * F.col("k") - 2.0 * F.col("loglik")).alias("aic"))


def arma_fit(df: DataFrame, orders: list[dict], tries: int = 120, by=BY, ds="ds",
             value="value") -> DataFrame:
    """Best parameters of every series and order, by simplex search over the likelihood.

    Columns: ``by``, model (place in ``orders``), x (free parameters, each between -0.99 and
    0.99), n, sigma2, loglik, aic, and best: the least aic of the series, the first of equal ones.
    """
    arrays = to_arrays(df, by, ds, value)
    numbered = F.array(*map(F.lit, range(len(orders))))
    rows = dealt(arrays.withColumn("model", F.explode(numbered)), *by, "model")

    def of(o):
        k, r = len(free_parameters(o)), states(o)

        def end_of(w, x):
            phi, theta = coefficients(o, x)
            return let(F.struct(phi.alias("f"), theta.alias("t")),
                       lambda c: _filtered(w, c["f"], c["t"], r))

        def search(w):
            def error(x):
                return F.coalesce(let(end_of(w, x), lambda e: F.when(e["n"] > 0, -_loglik(e))),
                                  F.lit(HOPELESS))

            starts = [list(s) for s in itertools.product((-0.4, 0.3), repeat=k)]
            x = simplex_search(error, starts, [(-0.99, 0.99)] * k, tries)["x"] if k else \
                F.array().cast("array<double>")
            return let(x, lambda x: let(end_of(w, x), lambda e: F.struct(
                x.alias("x"), e["n"].alias("n"), F.when(e["n"] > 0, e["s"] / e["n"]).alias("sigma2"),
                F.when(e["n"] > 0, _loglik(e)).alias("loglik"), F.lit(k + 1).alias("k"))))

        return let(differenced(F.col("vals"), o), search)

    found = F.coalesce(*[F.when(F.col("model") == i, of(o)) for i, o in enumerate(orders)])
    rows = rows.withColumn("_f", found).select(*by, "model", "_f.*").withColumn(
        "aic", 2.0 * F.col("k") - 2.0 * F.col("loglik")).drop("k")
    # A window rather than a join of the rows with themselves, which would search twice.
    least = F.min(F.when(F.col("aic").isNotNull(), F.struct("aic", "model"))).over(whole_series(by))
    return rows.withColumn("best", F.coalesce(F.col("model") == least["model"], F.lit(False)))


def arma_forecast(df: DataFrame, o: dict, x: list[float], horizon: int, by=BY, ds="ds",
                  value="value", out="yhat") -> DataFrame:
    """Rows ``h`` = 1..horizon of one model with given parameters, differences summed up again.

    ``ds`` is the day ``h`` days after the last. The last values that the differences reach back
    to must be known, else the forecast is null.
    """
    rows = to_arrays(df, by, ds, value)
    phi, theta = coefficients(o, F.array(*[F.lit(float(v)) for v in x]))
    r = states(o)
    end = let(differenced(F.col("vals"), o), lambda w: _filtered(w, phi, theta, r))
    # Weights of the values before in (1 - B)^d (1 - B^s)^D, with their signs turned.
    poly = [1.0]
    for k in [1] * o["d"] + [o["s"]] * o["D"]:
        longer = poly + [0.0] * k
        poly = [c - (longer[i - k] if i >= k else 0.0) for i, c in enumerate(longer)]
    back = F.array(*[F.lit(-c) for c in poly[1:]]) if len(poly) > 1 else F.array().cast("array<double>")
    reach = len(poly) - 1
    tail = F.reverse(F.slice(F.transform("vals", lambda v: v.cast("double")),
                             F.greatest(F.size("vals") - reach + 1, F.lit(1)), F.lit(max(reach, 1))))

    def step(s, _):
        first = F.get(s["a"], F.lit(0))
        own = first + (dot(s["w"], back) if reach else F.lit(0.0))
        ahead = F.zip_with(phi, F.concat(F.slice(s["a"], 2, r - 1), F.array(F.lit(0.0))),
                           lambda c, v: c * first + v)
        window = F.slice(F.concat(F.array(own), s["w"]), 1, reach) if reach else s["w"]
        return {"a": ahead, "w": window}, own

    path = scan(F.sequence(F.lit(1), F.lit(horizon)), {"a": F.col("_e.a"), "w": F.col("_w")}, step, "double")
    rows = rows.withColumns({"_e": F.when(F.size("vals") > reach, end), "_w": tail,
                             "_end": F.element_at("days", -1)})
    rows = rows.withColumn("_path", path)
    return rows.select(*by, "_end", F.posexplode_outer("_path").alias("_i", out)).select(
        *by, (F.col("_i") + 1).alias("h"), F.date_add("_end", F.col("_i") + 1).alias(ds), out)
