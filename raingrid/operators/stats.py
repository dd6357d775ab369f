"""Aggregations and statistics over daily series."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.functions import values as V
from raingrid.operators import linear as L
from raingrid.operators.common import BY, forward, whole_series


def resample(df: DataFrame, unit: str, agg=F.avg, label="start", by=BY, ds="ds",
             value="value") -> DataFrame:
    """Aggregate to months or years, dated by the first or last day of the period."""
    start = F.trunc(ds, unit)
    shown = start if label == "start" else F.date_sub(
        F.add_months(start, {"month": 1, "year": 12}[unit]), 1)
    return df.groupBy(*by, shown.alias("period")).agg(agg(value).alias(value))


def month_climatology(df: DataFrame, two_step=False, by=BY, ds="ds", value="value") -> DataFrame:
    """Mean by calendar month: of days, or of the monthly means with ``two_step``."""
    rows, when = df, ds
    if two_step:
        rows, when = resample(df, "month", F.avg, "start", by, ds, value), "period"
    return rows.groupBy(*by, F.month(when).alias("month")).agg(F.avg(value).alias("mean"))


def season_stats(df: DataFrame, scheme="binned", by=BY, ds="ds", value="value") -> DataFrame:
    return df.groupBy(*by, V.season(F.col(ds), scheme).alias("season")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def sum_by_date(df: DataFrame, keys=("ds",), value="value") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def extent(df: DataFrame, key: str, ds="ds", by=()) -> DataFrame:
    """Distinct keys and first and last date, as one row or per ``by``."""
    return df.groupBy(*by).agg(
        F.countDistinct(key).alias("distinct"), F.min(ds).alias("first"), F.max(ds).alias("last"))


def circular_stats(df: DataFrame, by=BY, value="direction") -> DataFrame:
    """Mean angle and consistency of degrees; nulls are left out."""
    return df.groupBy(*by).agg(
        V.angle_mean(F.col(value)).alias("mean_direction"),
        V.angle_consistency(F.col(value)).alias("consistency"), F.count(value).alias("n"))


def mode_by(df: DataFrame, by, value: str, out="mode") -> DataFrame:
    """Most frequent value; the smallest wins a tie.

    Rows are counted per value first, so the ranking sees distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("b")
    return counts.groupBy(*by).agg(best).select(
        *by, F.col("b.v").alias(out), (-F.col("b.k")).alias("n"))


def correlation(df: DataFrame, cols: list[str], by=(), min_rows=10) -> DataFrame:
    """Pearson per pair of columns over rows where both are known.

    A pair needs more than ``min_rows`` rows. All pairs share one aggregate.
    """
    pairs = list(combinations(cols, 2))
    aggs = []
    for a, b in pairs:
        aggs += [F.corr(a, b).alias(f"r_{a}_{b}"),
                 F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n_{a}_{b}")]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                              F.col(f"r_{a}_{b}").alias("r"), F.col(f"n_{a}_{b}").alias("n"))
                     for a, b in pairs])
    return wide.select(*by, F.explode(rows).alias("x")).select(*by, "x.*").withColumn(
        "r", F.when(F.col("n") > min_rows, F.col("r")))


def _regression(y: Column, x: Column) -> list[Column]:
    n = F.regr_count(y, x)
    residual = F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.regr_sxx(y, x)
    return [
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.corr(y, x).alias("r"), F.regr_r2(y, x).alias("r2"),
        F.sqrt(F.greatest(residual, F.lit(0.0)) / (n - 2) / F.regr_sxx(y, x)).alias("stderr"),
        n.alias("n"),
    ]


def linear_trend(df: DataFrame, by=BY, ds="ds", value="value", min_days=365, min_years=3,
                 on_year=False) -> DataFrame:
    """Line through the means of the years with data, numbered 0, 1, 2 and so on.

    A series needs ``min_days`` rows, with or without a value, and ``min_years`` years
    with a value. ``on_year`` regresses on the calendar year instead of the number.
    """
    years = df.groupBy(*by, F.year(ds).alias("year")).agg(
        F.avg(value).alias("y"), F.count(F.lit(1)).alias("rows"))
    days = F.sum("rows").over(whole_series(by))
    number = F.count("y").over(forward(by, "year").rowsBetween(Window.unboundedPreceding, -1))
    x = F.col("year") if on_year else F.col("_i")
    fit = years.withColumns({"_days": days, "_i": number}).where(
        F.col("_days") >= min_days).groupBy(*by).agg(*_regression(F.col("y"), x))
    return fit.where(F.col("n") >= min_years)


def trend_significance(trend: DataFrame) -> DataFrame:
    """Adds ``t`` and ``p_value``: the two-sided probability of such a slope, under Student's
    distribution, if there is none. Null with two years or without spread around the line."""
    t = F.try_divide("slope", "stderr")
    return trend.withColumn("t", t).withColumn(
        "p_value", F.when(F.col("n") > 2, L.student_tails(F.col("t"), F.col("n") - 2)))


def yearly_sum_trend(df: DataFrame, by=BY, ds="ds", value="value") -> DataFrame:
    """Line through yearly sums, dated by year plus the day-of-year share of year end."""
    years = df.groupBy(*by, F.year(ds).alias("year")).agg(F.sum(value).alias("y"))
    end = F.dayofyear(F.make_date("year", F.lit(12), F.lit(31)))
    x = F.col("year") + end / 365.25
    return years.withColumn("x", x).groupBy(*by).agg(*_regression(F.col("y"), F.col("x")))


def vertical_profile(df: DataFrame, columns: list[str], by=()) -> DataFrame:
    depth = F.regexp_extract("column", r"_(\d+(?:\.\d+)?)m$", 1).cast("double")
    return (
        df.unpivot(list(by), columns, "column", "value")
        .groupBy(*by, depth.alias("depth")).agg(F.avg("value").alias("mean"))
        .orderBy(*by, "depth")
    )


def wind_rose_table(df: DataFrame, by=BY, speed="speed", direction="direction",
                    edges=fixed.ROSE_EDGES, sectors=16, min_rows=30) -> DataFrame:
    """Percent of readings per direction sector and speed bin (the last is open).

    Raw rows are counted per cell; the total is taken over those few cells.
    """
    width = 360.0 / sectors
    sector = F.pmod(F.floor(F.col(direction) / width + 0.5), F.lit(sectors)).cast("int")
    bins = None
    for i, edge in reversed(list(enumerate(edges))):
        test = F.col(speed) >= edge
        bins = F.when(test, i) if bins is None else bins.when(test, i)
    cells = (
        df.where(F.col(speed).isNotNull() & F.col(direction).isNotNull())
        .groupBy(*by, sector.alias("sector"), bins.alias("speed_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    all_rows = F.sum("n").over(whole_series(by))
    return cells.withColumn("total", all_rows).where(F.col("total") >= min_rows).withColumn(
        "percent", 100.0 * F.col("n") / F.col("total")).drop("total")


def box_stats(df: DataFrame, by, value="value") -> DataFrame:
    """Five-number summary."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("min", "q1", "median", "q3", "max")
    return df.groupBy(*by).agg(p.alias("p")).select(
        *by, *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def density_histogram(df: DataFrame, bins=50, by=BY, value="value", group=()) -> DataFrame:
    """Equal bins over each series' own range; density sums to one per ``group``."""
    w = whole_series(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    rows = df.where(F.col(value).isNotNull()).withColumns({"_lo": low, "_hi": high})
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    cells = rows.groupBy(*by, *group, "_lo", "_hi", index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    all_rows = F.sum("n").over(Window.partitionBy(*by, *group))
    return cells.withColumn("density", F.col("n") / (all_rows * width)).withColumn(
        "left", F.col("_lo") + F.col("bin") * width).drop("_lo", "_hi")


# Published coefficients of the rational normal quantile (|error| < 4.5e-4).
NORMAL_NUMERATOR = (2.515517, 0.802853, 0.010328)
NORMAL_DENOMINATOR = (1.0, 1.432788, 0.189269, 0.001308)


def normal_quantile(p: Column) -> Column:
    side = F.least(p, 1.0 - p)
    t = F.sqrt(-2.0 * F.log(side))
    poly = lambda cs: sum((F.lit(c) * F.pow(t, F.lit(float(i)))
                           for i, c in enumerate(cs)), F.lit(0.0))
    z = t - poly(NORMAL_NUMERATOR) / poly(NORMAL_DENOMINATOR)
    return F.when(p < 0.5, -z).otherwise(z)


def quantile_pairs(df: DataFrame, by=BY, value="residual") -> DataFrame:
    """Sorted residuals beside the normal quantile of their plotting position."""
    order = Window.partitionBy(*by).orderBy(value)
    share = (F.row_number().over(order) - 0.5) / F.count(F.lit(1)).over(whole_series(by))
    return df.where(F.col(value).isNotNull()).withColumn("theoretical", normal_quantile(share))


def residual_shape(df: DataFrame, by=BY, value="residual") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
