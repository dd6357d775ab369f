"""Smooth trends: penalised differences, and seasons and trends by local lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raingrid.operators.common import BY, from_arrays, scan, to_arrays
from raingrid.operators.linear import let


def _nothing(v: Column) -> Column:
    """A null for every value, so that a series without parts keeps its rows."""
    return F.transform(v, lambda _: F.lit(None).cast("double"))


def _penalised(v: Column, weight: float) -> Column:
    """Solves (known + weight * D'D) x = v, with D the second differences, over five diagonals.

    Forward: factors of each day from those of the two days before it. Backward: each day's
    solution from the two after it.
    """
    n = F.size(v)
    share = lambda test: F.when(test, weight).otherwise(0.0)
    days = F.transform(v, lambda y, i: F.struct(
        F.coalesce(y, F.lit(0.0)).alias("y"),
        (F.when(y.isNull(), 0.0).otherwise(1.0) + share(i <= n - 3)
         + 4.0 * share((i >= 1) & (i <= n - 2)) + share(i >= 2)).alias("a"),
        (-2.0 * share(i <= n - 3) - 2.0 * share((i >= 1) & (i <= n - 2))).alias("b"),
        share(i <= n - 3).alias("c")))
    zero = F.lit(0.0)

    def forth(s, x):
        d = x["a"] - s["d1"] * s["e1"] * s["e1"] - s["d2"] * s["f2"] * s["f2"]
        e = F.try_divide(x["b"] - s["d1"] * s["e1"] * s["f1"], d)
        f = F.try_divide(x["c"], d)
        z = x["y"] - s["e1"] * s["z1"] - s["f2"] * s["z2"]
        state = {"d1": d, "e1": e, "f1": f, "z1": z, "d2": s["d1"], "f2": s["f1"], "z2": s["z1"]}
        return state, F.struct(F.try_divide(z, d).alias("z"), e.alias("e"), f.alias("f"))

    def back(s, x):
        own = x["z"] - x["e"] * s["x1"] - x["f"] * s["x2"]
        return {"x1": own, "x2": s["x1"]}, own

    factors = let(days, lambda d: F.reverse(scan(
        d, {k: zero for k in ("d1", "e1", "f1", "z1", "d2", "f2", "z2")}, forth,
        "struct<z:double,e:double,f:double>")))
    return let(factors, lambda f: F.reverse(scan(f, {"x1": zero, "x2": zero}, back, "double")))


def hp_trend(df: DataFrame, weight: float = 250_000.0, by=BY, ds="ds", value="value") -> DataFrame:
    """``trend`` that is near the values and bends little, and ``cycle``, what is left.

    The sum of squared distances and ``weight`` times the squared second differences is least.
    Nulls take no part, and the trend goes on through them; a series with fewer than three days
    is its own trend, and one with fewer than two values has none.
    """
    rows = to_arrays(df, by, ds, value)
    known = F.size(F.filter("vals", lambda x: x.isNotNull()))
    trend = F.when(F.size("vals") < 3, F.col("vals")).when(
        known >= 2, _penalised(F.col("vals"), weight)).otherwise(_nothing(F.col("vals")))
    out = from_arrays(rows.withColumn("_t", trend), by, ds, **{value: "vals", "trend": "_t"})
    return out.withColumn("cycle", F.col(value) - F.col("trend"))


def _line(points: Column, low: Column, width: Column, at: Column, reach: Column) -> Column:
    """Local line at place ``at`` through ``width`` points from place ``low`` on.

    ``points`` have a value v and a weight w; places count from 0. A point's weight falls as
    the cube of its distance over ``reach``. Null where all weights are 0.
    """
    start = F.struct(*[F.lit(0.0).alias(k) for k in ("s0", "s1", "s2", "t0", "t1")])
    window = F.transform(F.slice(points, low + 1, width), lambda p, k: F.struct(
        (low + k - at).cast("double").alias("x"), p["v"].alias("v"), p["w"].alias("w")))

    def add(s, p):
        r = F.abs(p["x"]) / reach
        near = F.when(r <= 0.001, 1.0).when(r <= 0.999, F.pow(1.0 - r * r * r, F.lit(3.0))).otherwise(0.0)
        return let(near * p["w"], lambda u: F.struct(
            (s["s0"] + u).alias("s0"), (s["s1"] + u * p["x"]).alias("s1"),
            (s["s2"] + u * p["x"] * p["x"]).alias("s2"), (s["t0"] + u * p["v"]).alias("t0"),
            (s["t1"] + u * p["x"] * p["v"]).alias("t1")))

    def value(s):
        spread = s["s2"] / s["s0"] - F.pow(s["s1"] / s["s0"], F.lit(2.0))
        flat = F.sqrt(F.greatest(spread, F.lit(0.0))) <= 0.001 * (F.size(points) - 1)
        return F.when(s["s0"] <= 0, None).when(flat, s["t0"] / s["s0"]).otherwise(
            (s["t0"] * s["s2"] - s["t1"] * s["s1"]) / (s["s0"] * s["s2"] - s["s1"] * s["s1"]))

    return F.aggregate(window, start, add, value)


def local_lines(points: Column, q: int, beyond: int = 0) -> Column:
    """Local lines through the ``q`` nearest points, at every place and ``beyond`` places before
    and after. Where no point has weight, the point's own value."""
    def smoothed(p):
        n = F.size(p)
        width = F.least(F.lit(q), n)

        def at(i):
            middle = F.least(F.greatest(i, F.lit(0)), n - 1)
            low = F.greatest(F.lit(0), F.least(middle - F.lit((q - 1) // 2), n - width))
            reach = F.greatest(i - low, low + width - 1 - i) + F.when(
                n < q, F.floor((q - n) / 2)).otherwise(0)
            return F.coalesce(_line(p, low, width, i, reach.cast("double")), F.get(p, middle)["v"])

        return F.transform(F.sequence(F.lit(-beyond), n - 1 + beyond), at)

    return let(points, smoothed)


def _weighted(values: Column, weights: Column) -> Column:
    return F.zip_with(values, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w")))


def _evenly(values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(1.0).alias("w")))


def _moving_mean(values: Column, q: int) -> Column:
    """Means of ``q`` neighbours, wherever there are as many."""
    def means(v):
        total = F.aggregate(F.slice(v, 1, q), F.lit(0.0), lambda a, x: a + x)
        steps = F.zip_with(F.slice(v, F.lit(q + 1), F.size(v) - q), F.slice(v, F.lit(1), F.size(v) - q),
                           lambda new, old: new - old)
        rolled = scan(steps, {"t": total}, lambda s, d: ({"t": s["t"] + d}, s["t"] + d), "double")
        return F.transform(F.concat(F.array(total), rolled), lambda t: t / q)

    return let(values, means)


def _odd_above(x: float) -> int:
    whole = int(x) + 1
    return whole if whole % 2 else whole + 1


def stl(df: DataFrame, m: int = 7, seasonal: int = 7, trend: int | None = None, inner: int = 2,
        outer: int = 0, by=BY, ds="ds", value="value") -> DataFrame:
    """Season and trend by local lines: columns trend, seasonal, resid and weight.

    Each of ``inner`` rounds smooths every phase of the season over ``seasonal`` periods, takes
    the slow part out of that by moving means and a local line, and smooths the rest over ``trend``
    days (the usual width if not given). Each of ``outer`` rounds weighs days down by their
    residual and repeats the inner ones, so that spikes move neither season nor trend. Values
    must be known (fill them before); a series of less than two periods, or with a null, gets
    null parts. One row per series is worked on by one task.
    """
    width = trend or _odd_above(1.5 * m / (1 - 1.5 / seasonal) - 1e-9)
    low_pass = _odd_above(m)
    v = F.col("vals")

    def phases(values):
        """Values by phase; the phase of a day is its place modulo ``m``."""
        return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: F.filter(
            values, lambda _, i: i % m == p))

    def one_round(s, rho):
        def cycle(free):
            smooth = F.transform(phases(_weighted(free, rho)), lambda p: local_lines(p, seasonal, 1))
            # Back into the order of days, with one period more at either end.
            return let(smooth, lambda c: F.transform(
                F.sequence(F.lit(0), F.size(v) + 2 * m - 1),
                lambda i: F.get(F.get(c, i % m), F.floor(i / m).cast("int"))))

        def parts(c):
            slow = local_lines(_evenly(_moving_mean(_moving_mean(_moving_mean(c, m), m), 3)), low_pass)
            season = F.zip_with(F.slice(c, F.lit(m + 1), F.size(v)), slow, lambda a, b: a - b)
            return let(season, lambda e: F.struct(
                local_lines(_weighted(F.zip_with(v, e, lambda y, x: y - x), rho), width).alias("t"),
                e.alias("s"), rho.alias("w")))

        return let(let(F.zip_with(v, s["t"], lambda y, t: y - t), cycle), parts)

    def weights(s):
        miss = F.zip_with(F.zip_with(v, s["t"], lambda y, t: y - t), s["s"], lambda a, b: F.abs(a - b))

        def bisquare(r):
            n = F.size(r)
            sorted_r = F.array_sort(r)
            middle = let(sorted_r, lambda a: (F.get(a, F.floor((n - 1) / 2).cast("int"))
                                              + F.get(a, F.floor(n / 2).cast("int"))) / 2)
            return let(6 * middle, lambda h: F.transform(r, lambda x: F.when(x <= 0.001 * h, 1.0).when(
                x <= 0.999 * h, F.pow(1.0 - x * x / h / h, F.lit(2.0))).otherwise(0.0)))

        return let(miss, bisquare)

    def step(s, r):
        if not outer:
            return one_round(s, s["w"])
        again = (r > 0) & (r % inner == 0)
        return let(F.when(again, weights(s)).otherwise(s["w"]), lambda w: one_round(s, w))

    even = lambda c: F.transform(v, lambda _: F.lit(c))
    begin = F.struct(even(0.0).alias("t"), even(0.0).alias("s"), even(1.0).alias("w"))
    rounds = F.aggregate(F.sequence(F.lit(0), F.lit(inner * (outer + 1) - 1)), begin, step)
    usable = (F.size(v) >= 2 * m) & ~F.exists(v, lambda x: x.isNull())
    fit = F.when(usable, rounds).otherwise(
        F.struct(*[_nothing(v).alias(k) for k in ("t", "s", "w")]))
    rows = to_arrays(df.withColumn(value, F.col(value).cast("double")), by, ds, value).withColumn("_f", fit)
    out = from_arrays(rows.withColumns({"_t": F.col("_f.t"), "_s": F.col("_f.s"), "_w": F.col("_f.w")}),
                      by, ds, **{value: "vals", "trend": "_t", "seasonal": "_s", "weight": "_w"})
    return out.withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
