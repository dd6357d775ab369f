"""Rolling, filling, gap, lag and ordering operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raingrid.functions import values as V
from raingrid.operators.common import (
    BY, backward, forward, from_arrays, last_known, next_known, scan, to_arrays, total, whole_series,
)


def sma(df: DataFrame, n: int, center=False, min_periods: int | None = None, by=BY, ds="ds",
        value="value", out="sma") -> DataFrame:
    """Rolling mean over ``n`` rows; null until ``min_periods`` values (default n).

    A centred window of even size reaches one row further back than ahead.
    """
    ahead = (n - 1) // 2 if center else 0
    frame = forward(by, ds).rowsBetween(ahead - n + 1, ahead)
    enough = F.count(value).over(frame) >= (n if min_periods is None else min_periods)
    return df.withColumn(out, F.when(enough, F.avg(value).over(frame)))


def ewma(df: DataFrame, span: int, by=BY, ds="ds", value="value", out="ewma") -> DataFrame:
    """Exponentially weighted mean with weights normalised from the start."""
    keep = 1.0 - 2.0 / (span + 1)

    def step(s, x):
        num = s["num"] * keep + F.coalesce(x, F.lit(0.0))
        den = s["den"] * keep + F.when(x.isNotNull(), 1.0).otherwise(0.0)
        return {"num": num, "den": den}, F.try_divide(num, den)

    arrays = to_arrays(df, by, ds, value)
    means = scan(F.col("vals"), {"num": F.lit(0.0), "den": F.lit(0.0)}, step, "double")
    return from_arrays(arrays.withColumn(out, means), by, ds, **{value: "vals", out: out})


def ffill(df: DataFrame, limit: int | None = None, by=BY, ds="ds", value="value",
          out="filled") -> DataFrame:
    first = Window.unboundedPreceding if limit is None else -limit
    frame = forward(by, ds).rowsBetween(first, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(frame))


def bfill(df: DataFrame, limit: int | None = None, by=BY, ds="ds", value="value",
          out="filled") -> DataFrame:
    first = Window.unboundedPreceding if limit is None else -limit
    frame = backward(by, ds).rowsBetween(first, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(frame))


def fill_both(df: DataFrame, by=BY, ds="ds", value="value", out="filled") -> DataFrame:
    """Forward fill, then backward fill what is left at the start."""
    before = last_known(F.col(value), forward(by, ds))
    after = last_known(F.col(value), backward(by, ds))
    return df.withColumn("_b", before).withColumn(out, F.coalesce("_b", after)).drop("_b")


def fill_both_all(df: DataFrame, values, by=BY, ds="ds") -> DataFrame:
    """``fill_both`` of several columns, in place: one pass forward and one back serve them all."""
    fwd, bwd = forward(by, ds), backward(by, ds)
    rows = df.withColumns({f"_b_{v}": last_known(F.col(v), fwd) for v in values})
    rows = rows.withColumns({f"_a_{v}": last_known(F.col(v), bwd) for v in values})
    return rows.withColumns({v: F.coalesce(f"_b_{v}", f"_a_{v}") for v in values}).drop(
        *[f"_{k}_{v}" for k in "ab" for v in values])


def _neighbours(df: DataFrame, by, ds, value, axis, number=True) -> DataFrame:
    """Adds row number, null unless asked for, and the known points around each row (two each way)."""
    place = F.row_number().over(forward(by, ds)) if number else F.lit(None).cast("int")
    rows = df.withColumn("_rn", place)
    x = F.unix_date(F.col(ds)) if axis == "time" else F.col("_rn")
    known = F.col(value).isNotNull()
    point = F.when(known, F.struct(F.col("_rn").alias("rn"), x.cast("double").alias("x"),
                                   F.col(value).cast("double").alias("v")))
    return rows.withColumn("_x", x.cast("double")).withColumn("_pt", point)


def interpolate(df: DataFrame, method="linear", limit: int | None = None, direction="forward",
                by=BY, ds="ds", value="value", out="filled", back_first=False,
                look_ahead=False) -> DataFrame:
    """Straight line between the known neighbours, by row or by time.

    Nulls after the last value take it; nulls before the first take it only with
    ``direction='both'``. ``limit`` counts rows from the left, and with ``both``
    also from the right. ``back_first`` goes back before it goes forward, with the same
    result: after a step that ended backward it shares its sort. ``look_ahead`` finds the next
    value without going back, so the forward sort serves all: for unique days, with the same result.
    """
    rows = _neighbours(df, by, ds, value, method, method != "time" or limit is not None)
    if look_ahead:
        rows = rows.withColumns({"_p": last_known(F.col("_pt"), forward(by, ds)),
                                 "_n": next_known("_pt", forward(by, ds))})
    else:
        sides = [("_p", forward(by, ds)), ("_n", backward(by, ds))]
        for name, order in reversed(sides) if back_first else sides:
            rows = rows.withColumn(name, last_known(F.col("_pt"), order))
    p, n = F.col("_p"), F.col("_n")
    line = p["v"] + (n["v"] - p["v"]) * (F.col("_x") - p["x"]) / (n["x"] - p["x"])
    both = direction == "both"
    guess = F.when(p.isNotNull() & n.isNotNull(), line).when(p.isNotNull(), p["v"])
    if both:
        guess = guess.otherwise(n["v"])
    near = F.lit(True)
    if limit is not None:
        near = F.coalesce(F.col("_rn") - p["rn"] <= limit, F.lit(False))
        if both:
            near = near | F.coalesce(n["rn"] - F.col("_rn") <= limit, F.lit(False))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(near, guess)
    return rows.withColumn(out, filled).drop("_rn", "_x", "_pt", "_p", "_n")


def interpolate_all(df: DataFrame, columns: dict[str, str], by=BY, ds="ds",
                    look_ahead=False) -> DataFrame:
    """``interpolate`` in time and both ways for several columns, given as value and name of the
    result: one pass forward and one back serve them all, or with ``look_ahead`` one forward."""
    x = F.unix_date(F.col(ds)).cast("double")
    points = {v: F.when(F.col(v).isNotNull(), F.struct(x.alias("x"), F.col(v).cast("double").alias("v")))
              for v in columns}
    if look_ahead:
        rows = df.withColumns({f"_at_{v}": e for v, e in points.items()})
        order = forward(by, ds)
        rows = rows.withColumns({f"_before_{v}": last_known(F.col(f"_at_{v}"), order) for v in columns}
                                | {f"_after_{v}": next_known(f"_at_{v}", order) for v in columns})
        rows = rows.drop(*[f"_at_{v}" for v in columns])
    else:
        rows = df
        for side, order in (("before", forward(by, ds)), ("after", backward(by, ds))):
            rows = rows.withColumns({f"_{side}_{v}": last_known(e, order) for v, e in points.items()})

    def filled(v):
        p, n = F.col(f"_before_{v}"), F.col(f"_after_{v}")
        line = p["v"] + (n["v"] - p["v"]) * (x - p["x"]) / (n["x"] - p["x"])
        return F.coalesce(F.col(v), F.when(p.isNotNull() & n.isNotNull(), line).when(
            p.isNotNull(), p["v"]).otherwise(n["v"]))

    return rows.withColumns({out: filled(v) for v, out in columns.items()}).drop(
        *[f"_{side}_{v}" for side in ("before", "after") for v in columns])


def gaps(df: DataFrame, by=BY, ds="ds", value="value") -> DataFrame:
    """Runs of nulls: first day, last day and length."""
    known_so_far = F.count(value).over(
        forward(by, ds).rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_k", known_so_far)
        .where(F.col(value).isNull())
        .groupBy(*by, "_k")
        .agg(F.min(ds).alias("gap_start"), F.max(ds).alias("gap_end"),
             F.count(F.lit(1)).alias("gap_length"))
        .drop("_k")
    )


def gap_routed_fill(df: DataFrame, limits=(None, None), short=3, by=BY, ds="ds", value="value",
                    out="filled") -> DataFrame:
    """Line across gaps up to ``short`` days, cubic through four points beyond.

    A gap without two known points on each side falls back to the line; nulls at
    the ends take the nearest value. At the end all values, known ones too, are held
    inside ``limits``.
    """
    low, high = limits
    fwd, bwd = forward(by, ds), backward(by, ds)
    rows = (
        _neighbours(df, by, ds, value, "linear")
        .withColumn("_pp", last_known(F.col("_pt"), fwd, include_current=False))
        .withColumn("_two", F.when(F.col("_pt").isNotNull(), F.struct(
            F.col("_pt").alias("a"), F.col("_pp").alias("b"))))
        .withColumn("_p", last_known(F.col("_two"), fwd))
        .withColumn("_nn", last_known(F.col("_pt"), bwd, include_current=False))
        .withColumn("_two", F.when(F.col("_pt").isNotNull(), F.struct(
            F.col("_pt").alias("a"), F.col("_nn").alias("b"))))
        .withColumn("_n", last_known(F.col("_two"), bwd))
    )
    points = [F.col("_p.b"), F.col("_p.a"), F.col("_n.a"), F.col("_n.b")]
    x = F.col("_x")
    cubic = None
    for i, pi in enumerate(points):
        term = pi["v"]
        for j, pj in enumerate(points):
            if i != j:
                term = term * (x - pj["x"]) / (pi["x"] - pj["x"])
        cubic = term if cubic is None else cubic + term
    prev, nxt = points[1], points[2]
    line = prev["v"] + (nxt["v"] - prev["v"]) * (x - prev["x"]) / (nxt["x"] - prev["x"])
    length = nxt["rn"] - prev["rn"] - 1
    inside = F.when(length <= short, line).otherwise(F.coalesce(cubic, line))
    guess = F.coalesce(F.col(value), inside, prev["v"], nxt["v"])
    return rows.withColumn(out, V.bound(guess, low, high)).drop(
        "_rn", "_x", "_pt", "_pp", "_nn", "_two", "_p", "_n")


def difference(df: DataFrame, k: int, by=BY, ds="ds", value="value", out="diff") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, k).over(forward(by, ds)))


def lag_windows(df: DataFrame, length: int, by=BY, ds="ds", value="value") -> DataFrame:
    """The ``length`` previous values as ``lags`` and the row's own as ``label``."""
    frame = forward(by, ds).rowsBetween(-length, -1)
    return (
        df.select(*by, ds, F.collect_list(value).over(frame).alias("lags"),
                  F.col(value).alias("label"))
        .where((F.size("lags") == length) & F.col("label").isNotNull())
    )


def acf_arrays(df: DataFrame, max_lag: int, by=BY, ds="ds", value="value", extra=()) -> DataFrame:
    """Series rows with the array ``acf`` of lags 0..max_lag, null past the length and where
    all values are equal.

    Also ``centred`` (values less the mean, in date order) and ``mean``.

    The mean comes from a window and the variance from the aggregate, so the
    array expression below only walks values that are already centred.
    """
    known = df.where(F.col(value).isNotNull()).withColumn(
        "_dev", F.col(value) - F.avg(value).over(whole_series(by)))
    rows = known.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(ds, "_dev"))).alias("_p"),
        F.sum(F.col("_dev") * F.col("_dev")).alias("_c0"), F.avg(value).alias("mean"), *extra)
    centred, size = F.col("_p._dev"), F.size("_p")

    def at(k):
        pairs = F.zip_with(F.slice(centred, F.lit(1), size - k),
                           F.slice(centred, k + 1, size - k), lambda a, b: a * b)
        return F.when(k < size, F.try_divide(total(pairs), F.col("_c0")))

    lags = F.transform(F.sequence(F.lit(0), F.lit(max_lag)), at)
    return rows.withColumns({"acf": lags, "centred": centred}).drop("_p", "_c0")


def acf(df: DataFrame, max_lag: int, by=BY, ds="ds", value="value") -> DataFrame:
    return acf_arrays(df, max_lag, by, ds, value).select(
        *by, F.posexplode_outer("acf").alias("lag", "acf"))


def pacf(df: DataFrame, max_lag: int, by=BY, ds="ds", value="value") -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion over the acf."""
    r = F.col("acf")
    start = F.struct(F.array().cast("array<double>").alias("phi"),
                     F.array(F.lit(1.0)).alias("out"))

    def step(s, k):
        phi = s["phi"]
        back = F.reverse(F.slice(r, F.lit(2), k - 1))
        top = r[k] - total(F.zip_with(phi, back, lambda a, b: a * b))
        base = 1.0 - total(F.zip_with(phi, F.slice(r, F.lit(2), k - 1), lambda a, b: a * b))
        new = F.try_divide(top, base)
        rest = F.zip_with(phi, F.reverse(phi), lambda a, b: a - new * b)
        return F.struct(F.concat(rest, F.array(new)).alias("phi"),
                        F.concat(s["out"], F.array(new)).alias("out"))

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), start, step)["out"]
    return acf_arrays(df, max_lag, by, ds, value).select(
        *by, F.posexplode_outer(fold).alias("lag", "pacf"))


def chrono_split(df: DataFrame, ratio: float | None = None, last: int | None = None, by=BY,
                 ds="ds", out="part") -> DataFrame:
    """``train`` or ``test`` by date order: a share, or the last rows as test.

    With ``last``, a series no longer than that falls back to an 0.8 share.
    """
    n = F.count(F.lit(1)).over(whole_series(by))
    cut = F.floor(n * ratio) if last is None else (
        F.when(n > last, n - last).otherwise(F.floor(n * 0.8)))
    row = F.row_number().over(forward(by, ds))
    return df.withColumn("_n", cut).withColumn(
        out, F.when(row <= F.col("_n"), "train").otherwise("test")).drop("_n")


def future_spine(df: DataFrame, horizon: int, by=BY, ds="ds") -> DataFrame:
    """The ``horizon`` days after the last date of each series."""
    end = df.groupBy(*by).agg(F.max(ds).alias("_end"))
    days = F.sequence(F.date_add("_end", 1), F.date_add("_end", horizon))
    return end.select(*by, F.posexplode(days).alias("h", ds)).withColumn("h", F.col("h") + 1)


def tail(df: DataFrame, n: int, by=BY, ds="ds") -> DataFrame:
    """Last ``n`` rows of each series."""
    return df.withColumn("_r", F.row_number().over(backward(by, ds))).where(
        F.col("_r") <= n).drop("_r")


def head(df: DataFrame, n: int, by=BY, ds="ds") -> DataFrame:
    return df.withColumn("_r", F.row_number().over(forward(by, ds))).where(
        F.col("_r") <= n).drop("_r")

