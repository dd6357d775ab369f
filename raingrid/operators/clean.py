"""Row and column cleaning on whole frames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raingrid.functions import values as V
from raingrid.operators.common import BY, whole_series


def date_from_parts(df: DataFrame, year="Year", month="Month", day="Day", out="ds") -> DataFrame:
    return df.withColumn(out, F.make_date(year, month, day))


def date_parts(df: DataFrame, ds="ds") -> DataFrame:
    return df.withColumns({
        "year": F.year(ds), "month": F.month(ds), "day": F.dayofmonth(ds),
        "day_of_year": F.dayofyear(ds), "quarter": F.quarter(ds),
        "month_name": F.date_format(ds, "MMMM"),
    })


def order_columns(df: DataFrame, ds="Date", location="Location") -> DataFrame:
    """Date and its parts, environment, depths ascending, wind, location."""
    depth = {c: float(m[1]) for c in df.columns if (m := re.fullmatch(r"TEMP_([\d.]+)m", c))}
    wind = [c for c in ("UWND", "VWND", "WSPD", "WDIR") if c in df.columns]
    fixed = {ds, location, "Year", "Month", "Day", *depth, *wind}
    rest = [c for c in df.columns if c not in fixed]
    parts = [F.year(ds).alias("Year"), F.month(ds).alias("Month"), F.dayofmonth(ds).alias("Day")]
    return df.select(ds, *parts, *rest, *sorted(depth, key=depth.get), *wind, location)


def filter_global_range(df: DataFrame, start: str, end: str, ds="ds") -> DataFrame:
    """Rows whose day lies in the closed range, written so that it reaches the scan."""
    after = F.date_add(F.to_date(F.lit(end)), 1)
    kind = df.schema[ds].dataType
    return df.where((F.col(ds) >= F.lit(start).cast(kind)) & (F.col(ds) < after.cast(kind)))


def drop_all_null(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(how="all", subset=subset)


def drop_thresh(df: DataFrame, n: int, subset: list[str]) -> DataFrame:
    return df.dropna(thresh=n, subset=subset)


def cap_with_mean(df: DataFrame, limit: float, by=BY, value="value", out="capped") -> DataFrame:
    """Values above ``limit`` become the mean, taken before capping."""
    v = F.col(value)
    return df.withColumn(out, F.when(v > limit, F.avg(v).over(whole_series(by))).otherwise(v))


def outliers_to_median(df: DataFrame, k: float = 1.5, by=BY, value="value",
                       out="capped") -> DataFrame:
    v, q = F.col(value), F.col("_q")
    width = (q[2] - q[0]) * k
    quartiles = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.withColumn("_q", quartiles.over(whole_series(by))).withColumn(
        out, F.when((v < q[0] - width) | (v > q[2] + width), q[1]).otherwise(v)).drop("_q")


def narrow_integral(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns whose known values are all whole become integers.

    The column types depend on the data, so this runs one aggregate over the named
    columns; only its one row of flags reaches the driver.
    """
    flags = df.agg(*[F.every(V.whole(F.col(c))).alias(c) for c in cols]).first()
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols if flags[c]})


def count_equal(col: Column, x) -> Column:
    return F.count_if(col == x)


def count_negative(col: Column) -> Column:
    return F.count_if(col < 0)
