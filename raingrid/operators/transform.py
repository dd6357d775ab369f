"""Scaling and shape transforms with their inverses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raingrid.functions import values as V
from raingrid.operators.common import BY, whole_series


def scale_stats(df: DataFrame, kind="standard", by=BY, value="value") -> DataFrame:
    """``shift`` and ``width`` per series; the inverse uses the same row."""
    v = F.col(value)
    if kind == "standard":
        shift, width = F.avg(v), F.stddev_pop(v)
    elif kind == "minmax":
        shift, width = F.min(v), F.max(v) - F.min(v)
    elif kind == "robust":
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        shift, width = q[1], q[2] - q[0]
    else:
        raise ValueError(kind)
    return df.groupBy(*by).agg(shift.alias("shift"), width.alias("width")).withColumn(
        "width", F.when(F.col("width") == 0, 1.0).otherwise(F.col("width")))


def scale(df: DataFrame, stats: DataFrame, by=BY, value="value", out="scaled") -> DataFrame:
    return df.join(stats, list(by)).withColumn(
        out, (F.col(value) - F.col("shift")) / F.col("width")).drop("shift", "width")


def unscale(df: DataFrame, stats: DataFrame, by=BY, value="scaled", out="value") -> DataFrame:
    return df.join(stats, list(by)).withColumn(
        out, F.col(value) * F.col("width") + F.col("shift")).drop("shift", "width")


def winsorize(df: DataFrame, low=0.05, high=0.05, by=BY, value="value",
              out="winsorized") -> DataFrame:
    """Clip at the interpolated quantiles."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(1.0 - high))).over(whole_series(by))
    v = F.col(value)
    return df.withColumn("_q", q).withColumn(
        out, F.when(v.isNotNull(), F.greatest(F.least(v, F.col("_q")[1]), F.col("_q")[0]))
    ).drop("_q")


def winsorize_ranks(df: DataFrame, low=0.05, high=0.05, by=BY, value="value",
                    out="winsorized") -> DataFrame:
    """The ``floor(share * n)`` lowest and highest values take their inner neighbour."""
    w = whole_series(by)
    up = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
    n = F.count(value).over(w)
    v = F.col(value)
    rows = df.withColumns({"_r": up, "_n": n})
    low_end = F.max(F.when(F.col("_r") == F.floor(F.col("_n") * low) + 1, v)).over(w)
    high_end = F.max(F.when(F.col("_r") == F.col("_n") - F.floor(F.col("_n") * high), v)).over(w)
    return rows.withColumns({"_a": low_end, "_b": high_end}).withColumn(
        out, F.when(v.isNotNull(), F.greatest(F.least(v, F.col("_b")), F.col("_a")))
    ).drop("_r", "_n", "_a", "_b")


def _power_sql(value: str, lam: float) -> str:
    """Yeo-Johnson transform for one parameter, as SQL text."""
    up = f"log1p({value})" if lam == 0 else f"(pow({value} + 1D, {lam}D) - 1D) / {lam}D"
    rest = round(2 - lam, 10)
    down = (f"-log1p(-({value}))" if rest == 0
            else f"-(pow(1D - {value}, {rest}D) - 1D) / {rest}D")
    return f"CASE WHEN {value} >= 0 THEN {up} ELSE {down} END"


def power_lambdas(df: DataFrame, low=-2.0, high=3.0, steps=51, by=BY, value="value") -> DataFrame:
    """Most likely Yeo-Johnson parameter per series, from a grid, with its moments.

    All candidates are aggregates of one pass; rows are not repeated per candidate.
    The smallest parameter wins a tie.
    """
    grid = [round(low + i * (high - low) / (steps - 1), 10) for i in range(steps)]
    moments = [F.expr(f"{fn}({_power_sql(f'`{value}`', lam)}) AS {name}{i}")
               for i, lam in enumerate(grid)
               for fn, name in (("avg", "m"), ("var_pop", "s"))]
    logs = F.expr(f"sum(signum(`{value}`) * log1p(abs(`{value}`))) AS logs")
    wide = df.groupBy(*by).agg(F.count(value).alias("n"), logs, *moments)
    options = ", ".join(
        f"struct(-n / 2D * ln(s{i}) + ({lam}D - 1D) * logs AS fit, {-lam}D AS neg, "
        f"m{i} AS mean, sqrt(s{i}) AS std)" for i, lam in enumerate(grid))
    return wide.select(*by, F.expr(f"array_max(array({options})) AS b")).select(
        *by, (-F.col("b.neg")).alias("lam"), F.col("b.mean").alias("mean"),
        F.col("b.std").alias("std"))


def yeo_johnson(df: DataFrame, lambdas: DataFrame, by=BY, value="value", out="power") -> DataFrame:
    shaped = V.power_transform(F.col(value), F.col("lam"))
    return df.join(lambdas, list(by)).withColumn(
        out, (shaped - F.col("mean")) / F.col("std")).drop("mean", "std")
