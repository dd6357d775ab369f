"""Filling rules for station and mooring variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.functions import values as V
from raingrid.operators import windows as W
from raingrid.operators.align import nearest_within
from raingrid.operators.common import BY, forward, whole_series
from raingrid.operators.quality import order_repair
from raingrid.session import written


#: Groups whose fits are sent to every task, and parts of each group beyond that.
MOST_FITS, SALTS = 10_000, 32


def _time_both(df, col, by, ds, back_first=False, look_ahead=False):
    return W.interpolate(df, "time", direction="both", by=by, ds=ds, value=col, out=col,
                         back_first=back_first, look_ahead=look_ahead)


def temperature_relation_fill(df: DataFrame, repair=True, by=BY, ds="ds",
                              look_ahead=False) -> DataFrame:
    """Missing maximum, minimum or mean temperature from the other two, then in time.

    Taken in the order maximum, minimum, mean; later ones see earlier fills. ``look_ahead``, here
    and in the fills below, is that of ``windows.interpolate``.
    """
    tx, tn, mid = F.col("tx"), F.col("tn"), F.col("tavg")
    rules = {"tx": 2 * mid - tn, "tn": 2 * mid - tx, "tavg": (tx + tn) / 2}
    for i, (name, rule) in enumerate(rules.items()):
        df = df.withColumn(name, F.coalesce(F.col(name), rule))
        if repair:
            df = order_repair(df)
        df = _time_both(df, name, by, ds, i % 2 == 1, look_ahead)
    return df


def humidity_from_dewpoint(df: DataFrame, min_rows=50, by=BY, ds="ds", temp="tavg",
                           rh="rh", out="rh_filled", look_ahead=False) -> DataFrame:
    """Humidity through an interpolated dew point, clipped to 0-100, then in time."""
    both = F.col(temp).isNotNull() & F.col(rh).isNotNull()
    dew = F.when(both, F.col(temp) - (100 - F.col(rh)) / 5)
    # Over all rows of a series, but in the order of the fills, so that they share one sort.
    series = forward(by, ds).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("_dew", dew).withColumn(
        "_enough", F.count("_dew").over(series) > min_rows)
    rows = _time_both(rows, "_dew", by, ds, look_ahead=look_ahead)
    guess = F.when(F.col("_enough"), 100 - 5 * (F.col(temp) - F.col("_dew")))
    rows = rows.withColumn(out, V.bound(F.coalesce(F.col(rh), guess), 0, 100))
    return _time_both(rows, out, by, ds, True, look_ahead).drop("_dew", "_enough")


def daylight_cap(df: DataFrame, latitude: float | None, by=BY, ds="ds", value="ss",
                 out="ss_filled", hours: float = 12.5, look_ahead=False) -> DataFrame:
    """Sunshine filled in time and held between 0 and the day's possible hours.

    Without a ``latitude`` the possible hours are ``hours`` on every day.
    """
    rows = W.interpolate(df, "time", direction="both", by=by, ds=ds, value=value, out=out,
                         look_ahead=look_ahead)
    most = F.lit(hours) if latitude is None else V.daylight_hours(F.col(ds), latitude)
    capped = F.least(F.col(out), most)
    return rows.withColumn(out, V.bound(F.when(F.col(out).isNotNull(), capped), 0))


def _angle_over(window, value):
    """Mean angle and consistency over ``window``."""
    rad = F.radians(value)
    y, x = F.avg(F.sin(rad)).over(window), F.avg(F.cos(rad)).over(window)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.hypot(x, y)


def wind_direction_fill(df: DataFrame, min_consistency=0.5, nearest_first=False, days=7,
                        scheme="two_sep", by=BY, ds="ds", value="direction",
                        out="filled", speed: str | None = None, look_ahead=False) -> DataFrame:
    """Direction from consistent month or season means, a near date, or overall.

    ``nearest_first`` tries the near date first and takes month and season means
    whatever their consistency; with ``speed``, the near date is only taken on days
    where that column is known.
    """
    rows = nearest_within(df, days, by, ds, value, "_near", look_ahead).withColumns(
        {"_m": F.month(ds), "_s": V.season(F.col(ds), scheme)})
    # A month lies in one season, so days in the order of season and month serve all three in one sort.
    keys, whole = (*by, "_s", "_m"), (Window.unboundedPreceding, Window.unboundedFollowing)
    for name, n in (("all", len(by)), ("season", len(by) + 1), ("month", len(by) + 2)):
        window = Window.partitionBy(*keys[:n])
        if n < len(keys):
            window = window.orderBy(*keys[n:]).rowsBetween(*whole)
        angle, strength = _angle_over(window, value)
        rows = rows.withColumns({f"_{name}": angle, f"_{name}_r": strength})
    if nearest_first:
        near = F.col("_near") if speed is None else F.when(F.col(speed).isNotNull(), F.col("_near"))
        steps = [near, F.col("_month"), F.col("_season")]
    else:
        trusted = [F.when(F.col(f"_{n}_r") > min_consistency, F.col(f"_{n}"))
                   for n in ("month", "season")]
        steps = [*trusted, F.col("_near"), F.col("_all")]
    return rows.withColumn(out, F.coalesce(F.col(value), *steps)).select(*df.columns, out)


def regression_fits(df: DataFrame, train: Column, x="x", y="y", by=BY) -> DataFrame:
    """Line of y on x from the training rows, scored on the others.

    Everything comes from one aggregate: the error of the line on the test rows
    follows from their moments, so no second pass is needed.
    """
    xc, yc = F.col(x), F.col(y)
    known = xc.isNotNull() & yc.isNotNull()
    pick = lambda test, c: F.when(known & test, c)
    tx, ty = pick(train, xc), pick(train, yc)
    vx, vy = pick(~train, xc), pick(~train, yc)
    m = df.groupBy(*by).agg(
        F.try_divide(F.regr_sxy(yc, xc), F.sqrt(F.regr_sxx(yc, xc) * F.regr_syy(yc, xc))).alias("r"),
        F.regr_slope(ty, tx).alias("slope"),
        F.regr_intercept(ty, tx).alias("intercept"), F.count(vy).alias("_n"),
        F.avg(vx).alias("_ax"), F.avg(vy).alias("_ay"), F.regr_sxx(vy, vx).alias("_xx"),
        F.regr_syy(vy, vx).alias("_yy"), F.regr_sxy(vy, vx).alias("_xy"))
    a = F.col("slope")
    miss = F.col("_ay") - a * F.col("_ax") - F.col("intercept")
    sse = (F.col("_yy") - 2 * a * F.col("_xy") + a * a * F.col("_xx")
           + F.col("_n") * miss * miss)
    return m.withColumns({"test_r2": 1 - F.try_divide(sse, F.col("_yy")),
                          "test_rmse": F.sqrt(F.try_divide(sse, F.col("_n")))}).select(
        *by, "r", "slope", "intercept", "test_r2", "test_rmse")


def regression_fill(df: DataFrame, fits: DataFrame, min_r=0.7, min_r2=0.65, x="x", y="y", by=BY,
                    out="filled") -> DataFrame:
    """Fill y from x where the fit is strong enough.

    One row of fits per group against raw rows: up to ``MOST_FITS`` groups are sent to
    every task, so that no row is shuffled and a group may hold most of them. With more
    groups the rows are joined by group, and each large group is split by salt.
    """
    columns = df.columns
    fits = written(fits, "fits")
    if fits.limit(MOST_FITS + 1).count() <= MOST_FITS:
        fits = F.broadcast(fits)
        keys = list(by)
    else:
        fits = fits.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(SALTS)))
        keys = [*by, "_salt"]
    line = F.col("slope") * F.col(x) + F.col("intercept")
    good = (F.col("r") > min_r) & (F.col("test_r2") > min_r2)
    return df.join(fits, keys, "left").withColumn(
        out, F.coalesce(F.col(y), F.when(good, line))).select(*columns, out)


def dry_season_zero_then_mean(df: DataFrame, scheme="two_oct", by=BY, ds="ds", value="rr",
                              out="filled") -> DataFrame:
    """Dry-season nulls become 0, others a centred 30-day mean with nulls as 0."""
    v = F.col(value)
    rows = df.withColumn("_s", V.season(F.col(ds), scheme)).withColumn(
        "_z", F.coalesce(F.when((F.col("_s") == "Dry") & v.isNull(), 0.0).otherwise(v),
                         F.lit(0.0)))
    rows = W.sma(rows, 30, center=True, min_periods=1, by=by, ds=ds, value="_z", out="_mean")
    guess = F.when(v.isNull(), F.when(F.col("_s") == "Dry", 0.0).otherwise(F.col("_mean")))
    rows = rows.withColumn("_f", F.coalesce(v, guess))
    return (W.fill_both(rows, by, ds, "_f", out).withColumn(out, V.bound(F.col(out), 0))
            .select(*df.columns, out))


def adaptive_season_mean(df: DataFrame, scheme="two_sep", peak=3, sizes=None, by=BY, ds="ds",
                         value="rr", out="filled") -> DataFrame:
    """Peak dry months to 0; then a centred mean inside the season (7 wet, 15 dry).

    The mean runs over the season's own days one after the other, nulls as 0; what
    it leaves is interpolated in time and floored at 0.
    """
    sizes = sizes or {"Wet": 7, "Dry": 15}
    v = F.col(value)
    first_dry = fixed.SEASONS[scheme]["Dry"][:peak]
    rows = df.withColumn("_s", V.season(F.col(ds), scheme)).withColumn(
        "_v", F.when(v.isNull() & F.month(ds).isin(*first_dry), 0.0).otherwise(v)).withColumn(
        "_z", F.coalesce("_v", F.lit(0.0)))
    within = forward((*by, "_s"), ds)
    guess = None
    for name, n in sizes.items():
        ahead = (n - 1) // 2
        frame = within.rowsBetween(ahead - n + 1, ahead)
        mean = F.when(F.count("_z").over(frame) >= 3, F.avg("_z").over(frame))
        test = F.col("_s") == name
        guess = F.when(test, mean) if guess is None else guess.when(test, mean)
    rows = rows.withColumn(out, F.coalesce(F.col("_v"), guess))
    rows = _time_both(rows, out, by, ds)
    return rows.withColumn(out, V.bound(F.col(out), 0)).select(*df.columns, out)


def cardinal_clean(df: DataFrame, scheme="two_sep", by=BY, ds="ds", name="cardinal",
                   degrees="direction", out="filled") -> DataFrame:
    """Valid compass names, else from degrees, else the month, season or overall mode.

    Each level counts what the previous one left; the last resort is ``N``. The fills of months
    that need one are written and counted; up to ``MOST_FITS`` of them are sent to every task.
    """
    trimmed = F.trim(name)
    start = F.coalesce(F.when(trimmed.isin(*fixed.COMPASS), trimmed),
                       V.compass_name(F.col(degrees)))
    rows = df.withColumns({out: start, "_m": F.month(ds), "_s": V.season(F.col(ds), scheme)})
    # A table of a few hundred counts per station holds all that the modes need, filled step by
    # step like the rows; its windows share one shuffle.
    table = rows.groupBy(*by, "_m", "_s", out).agg(F.count(F.lit(1)).alias("_n")).repartition(*by)
    name, steps = F.col(out), []
    for i, keys in enumerate(((*by, "_m"), (*by, "_s"), by)):
        table = table.withColumn(f"_v{i}", name).withColumn(
            "_c", F.sum("_n").over(Window.partitionBy(*keys, f"_v{i}")))
        best = F.min(F.when(F.col(f"_v{i}").isNotNull(), F.struct(
            (-F.col("_c")).alias("k"), F.col(f"_v{i}").alias("v"))))
        table = table.withColumn(f"_best{i}", best.over(Window.partitionBy(*keys))["v"])
        steps.append(F.col(f"_best{i}"))
        name = F.coalesce(F.col(f"_v{i}"), steps[-1])
    fills = written(table.where(F.col(out).isNull()).select(
        *by, "_m", F.coalesce(*steps, F.lit("N")).alias("_fill")), "compass-fills")
    if fills.limit(MOST_FITS + 1).count() <= MOST_FITS:
        fills = F.broadcast(fills)
    return rows.join(fills, [*by, "_m"], "left").withColumn(
        out, F.coalesce(out, "_fill")).select(*df.columns, out)


def mean_fill(df: DataFrame, by=BY, value="value", out="filled") -> DataFrame:
    return df.withColumn(out, F.coalesce(
        F.col(value), F.avg(value).over(whole_series(by))))


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0.0, subset=cols)


def sentinel_mean_fill(df: DataFrame, codes=fixed.SENTINELS, by=BY, value="value",
                       out="filled") -> DataFrame:
    """Sentinels count as 0 in the mean that then fills the true nulls."""
    v = F.when(F.col(value).isin(*codes), 0.0).otherwise(F.col(value))
    return mean_fill(df.withColumn("_v", v), by, "_v", out).drop("_v")


def typed_fill(df: DataFrame, kind: str, by=BY, ds="ds", value="value", out="filled") -> DataFrame:
    """Fill by kind of variable: rain is zero; other kinds take a line of limited reach, and
    radiation and humidity then hold the last value for up to two rows."""
    same = dict(by=by, ds=ds)
    if kind == "rainfall":
        return df.withColumn(out, F.coalesce(F.col(value), F.lit(0.0)))
    if kind == "rainfall_other":
        return W.interpolate(df, limit=2, value=value, out=out, **same)
    if kind == "radiation":
        rows = W.interpolate(df, "time", limit=3, value=value, out="_i", **same)
        return W.ffill(rows, 2, value="_i", out=out, **same).drop("_i")
    if kind == "humidity":
        rows = W.ffill(df, 2, value=value, out="_i", **same)
        return W.bfill(rows, 2, value="_i", out=out, **same).drop("_i")
    limit = {"sst": 3, "temperature": 3, "wind": 2}[kind]
    return W.interpolate(df, limit=limit, direction="both", value=value, out=out, **same)


def rain_simple_fill(df: DataFrame, others=(), floor=0.1, by=BY, ds="ds",
                     rain="rr") -> DataFrame:
    """Rain in time, then both ways, at least ``floor``; other columns both ways."""
    rows = W.interpolate(df, "time", by=by, ds=ds, value=rain, out=rain)
    rows = W.fill_both(rows, by, ds, rain, rain)
    rows = rows.withColumn(rain, V.bound(F.col(rain), floor))
    return reduce(lambda d, c: W.fill_both(d, by, ds, c, c), others, rows)
