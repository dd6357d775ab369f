"""Joins, grids and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raingrid.functions import values as V
from raingrid.operators.common import (
    BY, backward, dealt, forward, last_known, next_known, whole_series,
)


def outer_merge(frames: dict[str, DataFrame], keys=("series", "ds"), value="value") -> DataFrame:
    """Full outer merge of one-value frames on ``keys``, one column per frame.

    Frames are stacked and folded by one aggregate: a single shuffle whatever the
    number of frames, instead of a chain of full outer joins. ``keys`` are unique
    in every frame.
    """
    stacked = reduce(DataFrame.unionByName, [
        f.select(*keys, F.lit(n).alias("_name"), F.col(value).alias("_v"))
        for n, f in frames.items()])
    return stacked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in frames])


def complete_grid(df: DataFrame, by=BY, ds="ds", values=("value",),
                  ranges: DataFrame | None = None) -> DataFrame:
    """A row for every day of each series, null where the day had no row.

    Each row expands over the days up to the next row, so the grid needs one
    shuffle on ``by`` and no join, and later windows reuse that partitioning. The rows are dealt to
    as many tasks as shuffles have: their few bytes before they expand would have tasks merged
    that hold many rows after.
    Rows of one day are folded first, in the same order of days: each column takes its
    greatest value. Many raw rows a day are better aggregated before.
    ``ranges`` (by, start, end) fixes the ends instead of the first and last row.
    """
    rows = df.select(*by, ds, *values)
    if ranges is not None:
        rows = rows.join(ranges, list(by)).where(F.col(ds).between(F.col("start"), F.col("end")))
        ends = ranges.select(*by, F.explode(F.array("start", "end")).alias(ds))
        rows = (rows.select(*by, ds, *values)
                .unionByName(ends, allowMissingColumns=True)
                .groupBy(*by, ds).agg(*[F.max(v).alias(v) for v in values]))
        rows = dealt(rows, *by)
    else:
        same_day = forward(by, ds).rangeBetween(Window.currentRow, Window.currentRow)
        rows = dealt(rows, *by).select(
            *by, ds, *[F.max(v).over(same_day).alias(v) for v in values],
            F.lag(ds).over(forward(by, ds)).alias("_before"),
        ).where(F.col("_before").isNull() | (F.col("_before") != F.col(ds))).drop("_before")
    following = F.lead(ds).over(forward(by, ds))
    days = F.sequence(F.col(ds), F.coalesce(F.date_sub(following, 1), F.col(ds)))
    return (
        rows.select(*by, F.col(ds).alias("_first"), *values, days.alias("_days"))
        .select(*by, "_first", *values, F.explode("_days").alias(ds))
        .select(*by, ds, *[F.when(F.col(ds) == F.col("_first"), F.col(v)).alias(v)
                           for v in values])
    )


def union_index_join(frames: dict[str, DataFrame], keys=("series", "ds"), ds="ds") -> DataFrame:
    """Every date seen in any frame, each variable beside it, and the date parts."""
    merged = outer_merge(frames, keys)
    return merged.select(*keys, F.year(ds).alias("year"), F.month(ds).alias("month"),
                         F.dayofmonth(ds).alias("day"), *frames)


def nearest_within(df: DataFrame, days: int = 7, by=BY, ds="ds", value="value",
                   out="filled", look_ahead=False) -> DataFrame:
    """Fill a null from the closest dated value less than ``days`` away.

    The earlier date wins a tie. Only original values are donors. ``look_ahead`` finds later
    donors without going back, so the forward sort serves both sides: for unique days.
    """
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(ds).alias("d"),
                                                      F.col(value).alias("v")))
    back = F.datediff(F.col(ds), F.col("_p.d"))
    ahead = F.datediff(F.col("_n.d"), F.col(ds))
    use_prev = (back < days) & (ahead.isNull() | (back <= ahead))
    if look_ahead:
        rows = df.withColumn("_at", point).withColumns({
            "_p": last_known(F.col("_at"), forward(by, ds)),
            "_n": next_known("_at", forward(by, ds))}).drop("_at")
    else:
        rows = df.withColumn("_p", last_known(point, forward(by, ds))).withColumn(
            "_n", last_known(point, backward(by, ds)))
    return (
        rows.withColumn(out, F.when(use_prev, F.col("_p.v")).when(ahead < days, F.col("_n.v")))
        .drop("_p", "_n")
    )


def location_cutoffs(df: DataFrame, limits: dict[str, tuple[str, str]], location="series",
                     ds="ds") -> DataFrame:
    """Keep rows inside their location's closed date range; unknown locations drop.

    An equi-join on the location with the range as a filter; Spark sizes the side.
    """
    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame(
        [(k, a, b) for k, (a, b) in limits.items()], f"{location} string, a string, b string")
    ranges = table.select(location, F.to_date("a").alias("_a"), F.to_date("b").alias("_b"))
    return (df.join(ranges, location)
            .where(F.col(ds).between(F.col("_a"), F.col("_b"))).drop("_a", "_b"))


def stat_lookup(df: DataFrame, levels=("month", "season", "overall"), agg=F.avg, by=BY, ds="ds",
                value="value", scheme="quarters", out="filled") -> DataFrame:
    """Fill nulls with the first non-null statistic among month, season, overall.

    The widest key comes first: its one shuffle also serves the narrower windows.
    """
    rows = df.withColumn("_overall", agg(F.col(value)).over(whole_series(by)))
    if "month" in levels:
        rows = rows.withColumn("_m", F.month(ds)).withColumn(
            "_month", agg(F.col(value)).over(whole_series((*by, "_m")))).drop("_m")
    if "season" in levels:
        rows = rows.withColumn("_s", V.season(F.col(ds), scheme)).withColumn(
            "_season", agg(F.col(value)).over(whole_series((*by, "_s")))).drop("_s")
    filled = F.coalesce(F.col(value), *[F.col(f"_{level}") for level in levels])
    return rows.withColumn(out, filled).drop("_overall", "_month", "_season")


def align_inner(actual: DataFrame, forecast: DataFrame, keys=("series", "ds"),
                actual_col="value", forecast_col="value") -> DataFrame:
    a = actual.select(*keys, F.col(actual_col).alias("actual"))
    f = forecast.select(*keys, F.col(forecast_col).alias("forecast"))
    return a.join(f, list(keys)).dropna(subset=["actual", "forecast"])


def window_member(df: DataFrame, dates: DataFrame, keys=("ds",)) -> DataFrame:
    return df.join(dates, list(keys), "left_semi")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def index_intersection(a: DataFrame, b: DataFrame, keys=("ds",)) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
