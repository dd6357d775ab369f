"""Fills of raw series of which one may hold a large part of all rows.

Rows are cut into blocks along their order. Inside a block a window finds the known values around
each row; across blocks only the first and last known value of each block travel, one small row per
block. So a task sorts blocks and never a whole series, and tasks grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raingrid.operators.common import BY


def known_around(df: DataFrame, axis: Column, width: float, value="value", ties=(), by=BY) -> DataFrame:
    """Adds ``_x`` (``axis`` as a number) and the structs (x, v) ``_p`` and ``_n``: the last known
    value up to each row and the first from it on. Blocks are ``width`` wide on the axis; rows at
    one place are in the order of ``ties``, which should tell them apart."""
    x = axis.cast("double")
    rows = df.withColumns({"_x": x, "_block": F.floor(x / width), "_pt": F.when(
        F.col(value).isNotNull(), F.struct(x.alias("x"), F.col(value).cast("double").alias("v")))})
    order = ["_x", *ties]
    up = Window.partitionBy(*by, "_block").orderBy(*order)
    down = Window.partitionBy(*by, "_block").orderBy(*[F.col(c).desc() for c in order])
    so_far = (Window.unboundedPreceding, 0)
    place = F.when(F.col("_pt").isNotNull(), F.struct(*order))
    ends = rows.groupBy(*by, "_block").agg(
        F.max_by("_pt", place).alias("_last"), F.min_by("_pt", place).alias("_first"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_block", F.last("_last", ignorenulls=True).over(before).alias("_bp"),
                       F.last("_first", ignorenulls=True).over(after).alias("_bn"))
    rows = rows.withColumn("_ip", F.last("_pt", ignorenulls=True).over(up.rowsBetween(*so_far))).withColumn(
        "_in", F.last("_pt", ignorenulls=True).over(down.rowsBetween(*so_far)))
    return rows.join(ends, [*by, "_block"]).withColumns({
        "_p": F.coalesce("_ip", "_bp"), "_n": F.coalesce("_in", "_bn")}).drop(
        "_pt", "_ip", "_in", "_bp", "_bn", "_block")


def _filled(df, rows, guess, value, out):
    return rows.withColumn(out, F.coalesce(F.col(value).cast("double"), guess)).select(*df.columns, out)


def ffill_long(df: DataFrame, axis: Column, width: float, value="value", ties=(), by=BY,
               out="filled") -> DataFrame:
    """Nulls take the last known value before them; those before the first stay null."""
    rows = known_around(df, axis, width, value, ties, by)
    return _filled(df, rows, F.col("_p.v"), value, out)


def nearest_within_long(df: DataFrame, axis: Column, width: float, within: float, value="value",
                        ties=(), by=BY, out="filled") -> DataFrame:
    """Nulls take the closest known value less than ``within`` away; the earlier one of a tie."""
    rows = known_around(df, axis, width, value, ties, by)
    back, ahead = F.col("_x") - F.col("_p.x"), F.col("_n.x") - F.col("_x")
    first = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    guess = F.when(first & (back < within), F.col("_p.v")).when(~first & (ahead < within), F.col("_n.v"))
    return _filled(df, rows, guess, value, out)


def interpolate_long(df: DataFrame, axis: Column, width: float, value="value", ties=(), by=BY,
                     both=False, out="filled") -> DataFrame:
    """Nulls lie on the line between the known values around them, along the axis. After the last
    they take it; before the first they take that only if ``both``. At the place of a known value
    that has the same axis, they take the earlier one."""
    rows = known_around(df, axis, width, value, ties, by)
    p, n, x = F.col("_p"), F.col("_n"), F.col("_x")
    share = F.coalesce(F.try_divide(x - p["x"], n["x"] - p["x"]), F.lit(0.0))
    guess = F.when(p.isNotNull() & n.isNotNull(), p["v"] + (n["v"] - p["v"]) * share).when(
        p.isNotNull(), p["v"])
    return _filled(df, rows, guess.otherwise(n["v"]) if both else guess, value, out)
