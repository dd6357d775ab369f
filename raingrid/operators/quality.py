"""Quality control and coverage reports."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.functions import values as V
from raingrid.operators.common import BY, whole_series


def _code_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def parse_value_codes(df: DataFrame, token="token") -> DataFrame:
    """``value_q_s`` or ``value q s`` tokens to value, q, s, valid and reason.

    A bare number gets the default codes q=2, s=1. Anything with a ``C`` (special
    adjustment), any missing marker and any number at or below -9 is rejected. The
    steps stay separate columns so that each is evaluated once per row.
    """
    text, number, coded = F.col("_text"), F.col("_number"), F.col("_coded")
    bare, reason = F.col("_bare"), F.col("reason")
    shape = r"^[^_\s]+(_|\s+)\d+(_|\s+)\d+([_\s].*)?$"
    why = (
        F.when(text.isNull() | (text == ""), "Empty/NaN")
        .when(text.isin("C", "c"), "Special adjustment indicator (C)")
        .when(text.isin(*fixed.TOKEN_MISSING), "Missing data indicator")
        .when(F.upper(text).contains("C"), "Contains special adjustment indicator (C)")
        .when(number <= -9, "Missing value")
        .when(~coded & bare.isNull(), "Unable to parse value")
    )
    missing = reason.isin("Missing data indicator", "Missing value")

    def code(position, default):
        return (F.when(missing, 0).when(reason.isNotNull(), None)
                .when(coded, F.col("_parts")[position].try_cast("int")).otherwise(default))

    return (
        df.withColumn("_text", F.trim(token))
        .withColumn("_parts", F.split("_text", r"_|\s+"))
        .withColumns({"_number": V.coerce_numeric(F.col("_parts")[0]),
                      "_bare": V.coerce_numeric(text)})
        .withColumn("_coded", text.rlike(shape) & number.isNotNull())
        .withColumn("reason", why)
        .withColumns({
            "value": F.when(reason.isNull(), F.when(coded, number).otherwise(bare)),
            "q": code(1, 2), "s": code(2, 1), "valid": reason.isNull()})
        .drop("_text", "_parts", "_number", "_bare", "_coded")
    )


def quality_filter(df: DataFrame, keep_q=fixed.KEEP_QUALITY, keep_s=fixed.KEEP_SOURCE,
                   value="value", q="q", s="s") -> DataFrame:
    """Values whose quality or source code is not accepted become null."""
    good = F.col(q).isin(*keep_q) & F.col(s).isin(*keep_s)
    return df.withColumn(value, F.when(good, F.col(value)))


def quality_rows(df: DataFrame, q="q", s="s") -> DataFrame:
    """Drops missing and failed readings, labels quality, ranks the source."""
    label = F.coalesce(F.try_element_at(_code_map(fixed.QUALITY_LABEL), F.col(q)), F.lit("high"))
    rank = F.coalesce(F.try_element_at(_code_map(fixed.SOURCE_RANK), F.col(s)), F.lit(1))
    return df.where((F.col(q) > 0) & (F.col(q) < 5)).withColumns(
        {"data_quality": label, "source_priority": rank})


def rejection_summary(parsed: DataFrame, column="variable") -> DataFrame:
    """Rejected tokens per column and reason, from ``parse_value_codes``."""
    return (parsed.where(F.col("reason").isNotNull())
            .groupBy(column, "reason")
            .agg(F.count(F.lit(1)).alias("rejected")))


def interpolated_share(df: DataFrame, by=BY, s="s") -> DataFrame:
    hits = F.count_if(F.col(s).isin(*fixed.INTERPOLATED_SOURCE))
    return df.groupBy(*by).agg(
        hits.alias("interpolated"), (100.0 * hits / F.count(F.lit(1))).alias("percent"))


def range_to_null(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    cols = [c for c in limits if c in df.columns]
    return df.withColumns(
        {c: F.when(F.col(c).between(*limits[c]), F.col(c)) for c in cols})


def range_violations(df: DataFrame, limits: dict[str, tuple[float, float]], by=BY) -> DataFrame:
    cols = [c for c in limits if c in df.columns]
    return df.groupBy(*by).agg(
        *[F.count_if(~F.col(c).between(*limits[c])).alias(f"{c}_outside") for c in cols])


def zscore_outliers(df: DataFrame, threshold: float = 3.0, by=BY, value="value") -> DataFrame:
    """Flag and null values more than ``threshold`` population deviations off.

    A series with more than half its values missing is left alone.
    """
    w = whole_series(by)
    v = F.col(value)
    z = F.abs(v - F.avg(v).over(w)) / F.stddev_pop(v).over(w)
    enough = F.count(v).over(w) * 2 >= F.count(F.lit(1)).over(w)
    return (
        df.withColumn("is_outlier", F.coalesce(enough & (z > threshold), F.lit(False)))
        .withColumn("cleaned", F.when(~F.col("is_outlier"), v))
    )


def iqr_outliers(df: DataFrame, k: float = 1.5, by=BY, value="value") -> DataFrame:
    """Rows outside the quartile fences, with the fences beside them."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(whole_series(by))
    width = (F.col("_q")[1] - F.col("_q")[0]) * k
    return (
        df.withColumn("_q", q)
        .withColumns({"low": F.col("_q")[0] - width, "high": F.col("_q")[1] + width})
        .drop("_q")
        .where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))
    )


def percentile_outlier_count(df: DataFrame, low=0.01, high=0.99, by=BY, value="value"):
    q = F.percentile(value, F.array(F.lit(low), F.lit(high))).over(whole_series(by))
    outside = (F.col(value) < F.col("_q")[0]) | (F.col(value) > F.col("_q")[1])
    return df.withColumn("_q", q).groupBy(*by).agg(F.count_if(outside).alias("outliers"))


def constraint_report(df: DataFrame, limits: dict[str, tuple[float, float]], by=BY) -> DataFrame:
    """One row per series and variable: extremes, violations and nulls.

    The wide frame becomes long by ``unpivot`` inside the scan stage, and one
    aggregate serves every variable.
    """
    low = _code_map({k: a for k, (a, _) in limits.items()})
    high = _code_map({k: b for k, (_, b) in limits.items()})
    v, name = F.col("value"), F.col("variable")
    return (
        df.unpivot(list(by), list(limits), "variable", "value")
        .groupBy(*by, "variable")
        .agg(F.min(v).alias("min"), F.max(v).alias("max"),
             F.count_if(v < F.element_at(low, name)).alias("below"),
             F.count_if(v > F.element_at(high, name)).alias("above"),
             F.count_if(v.isNull()).alias("nulls"))
    )


def suspicious_patterns(df: DataFrame, value="value", by=BY, floor_percent=0.1) -> DataFrame:
    """Counts of odd values; a pattern is reported above ``floor_percent`` of rows."""
    v = F.col(value)
    text = F.format_string("%.2f", v)
    tests = {"over_1000": v > 1000, "negative": v < 0, "five_digits": text.rlike(r"\d{5,}")}
    counts = df.groupBy(*by).agg(
        F.count(v).alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()])
    return (
        counts.unpivot([*by, "n"], list(tests), "pattern", "hits")
        .withColumn("percent", 100.0 * F.col("hits") / F.col("n"))
        .where(F.col("percent") > floor_percent)
    )


def band(percent: Column, edges: dict[str, float], lowest: str) -> Column:
    """Label of the first edge reached, from highest to lowest."""
    expr = None
    for name, edge in sorted(edges.items(), key=lambda e: -e[1]):
        expr = (F.when if expr is None else expr.when)(percent >= edge, name)
    return expr.otherwise(lowest)


def completeness(df: DataFrame, variables: list[str], by=BY) -> DataFrame:
    percent = 100.0 * F.col("valid") / F.col("total")
    return (
        df.unpivot(list(by), variables, "variable", "value")
        .groupBy(*by, "variable")
        .agg(F.count("value").alias("valid"), F.count(F.lit(1)).alias("total"))
        .withColumn("percent", percent)
        .withColumn("band", band(percent, {"excellent": 80, "good": 60, "fair": 40}, "poor"))
    )


def missing_percent(df: DataFrame, cols: list[str], by=BY) -> DataFrame:
    return df.groupBy(*by).agg(
        *[(100.0 * F.avg(V.missing_flag(F.col(c)))).alias(c) for c in cols])


def top_variables(coverage: DataFrame, n: int = 3, by=BY) -> DataFrame:
    """Best covered variables per location; the name breaks ties."""
    order = Window.partitionBy(*by).orderBy(F.col("percent").desc(), "variable")
    return coverage.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def depth_availability(df: DataFrame, columns: list[str], by=()) -> DataFrame:
    """Coverage per depth column, depth read from the column name."""
    depth = F.regexp_extract("column", r"_(\d+(?:\.\d+)?)m$", 1).cast("double")
    percent = 100.0 * F.count("value") / F.count(F.lit(1))
    rows = df.unpivot(list(by), columns, "column", "value").groupBy(*by, "column").agg(
        percent.alias("percent"))
    return rows.select(
        *by, depth.alias("depth"), "percent",
        band(F.col("percent"), {"good": 70, "fair": 50}, "poor").alias("band"),
    ).orderBy(*by, "depth")


def order_repair(df: DataFrame, low="tn", mid="tavg", high="tx") -> DataFrame:
    """Move the middle value so that low <= middle <= high where they are known."""
    capped = F.when(F.col(mid) > F.col(high), F.col(high)).otherwise(F.col(mid))
    return df.withColumn("_c", capped).withColumn(
        mid, F.when(F.col("_c") < F.col(low), F.col(low)).otherwise(F.col("_c"))).drop("_c")


def describe_by(df: DataFrame, by=BY, value="value") -> DataFrame:
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"),
        F.max(v).alias("max"), (100.0 * F.avg(V.missing_flag(v))).alias("missing_pct"))
