"""Shared helpers for ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("series",)


def whole_series(by=BY):
    return Window.partitionBy(*by)


def forward(by=BY, ds="ds"):
    return Window.partitionBy(*by).orderBy(ds)


def backward(by=BY, ds="ds"):
    return Window.partitionBy(*by).orderBy(F.col(ds).desc())


def last_known(col: Column, window, include_current=True) -> Column:
    """Latest non-null value up to the row in window order.

    Running it over ``backward`` gives the next value; that stays linear, whereas a
    frame ending at unbounded following is re-read for every row.
    """
    end = 0 if include_current else -1
    return F.last(col, ignorenulls=True).over(
        window.rowsBetween(Window.unboundedPreceding, end))


def next_known(name: str, window) -> Column:
    """Earliest non-null value of the column ``name`` from the row on, in window order.

    Looks ahead over the rows in their own order, so nothing is sorted backward.
    """
    later = F.expr(f"lead(`{name}`, 1) IGNORE NULLS").over(window)
    return F.coalesce(F.col(name), later)


def to_arrays(df: DataFrame, by=BY, ds="ds", value="value") -> DataFrame:
    """One row per series with ``days`` and ``vals`` arrays in date order."""
    points = F.sort_array(F.collect_list(F.struct(ds, value)))
    return (
        df.groupBy(*by)
        .agg(points.alias("p"))
        .select(*by, F.col(f"p.{ds}").alias("days"), F.col(f"p.{value}").alias("vals"))
    )


def from_arrays(df: DataFrame, by=BY, ds="ds", **columns: str) -> DataFrame:
    """Explode ``days`` and the named arrays back to rows.

    The outer form matters: for the plain one the optimizer adds a filter on the
    array and pushes it down, which would run the folds behind the arrays again.
    """
    zipped = F.arrays_zip(F.col("days").alias("days"),
                          *[F.col(src).alias(src) for src in columns.values()])
    return df.select(*by, F.explode_outer(zipped).alias("z")).select(
        *by, F.col("z.days").alias(ds),
        *[F.col(f"z.{src}").alias(name) for name, src in columns.items()])


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def mean(arr: Column) -> Column:
    return total(arr) / F.size(arr)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by key to as many tasks as shuffles have.

    For few rows that are much work each: their tasks are not merged again for having few bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def scan(values: Column, start: dict[str, Column], step, kind: str, block: int = 64) -> Column:
    """What ``step`` emits for each of ``values``, in order, as an array of type ``kind``.

    ``step`` takes the state (a struct of the fields of ``start``) and a value, and returns the
    next state as a dictionary and the emitted column. The fold goes through blocks and the values
    of each, so that only the block at hand grows: no step copies all that was emitted before.
    """
    names, none = list(start), F.array().cast(f"array<{kind}>")

    def one(s, x):
        state, emitted = step(s, x)
        return F.struct(*[state[n].alias(n) for n in names],
                        F.concat(s["_out"], F.array(emitted)).alias("_out"))

    def run(s, k):
        begin = F.struct(*[s[n].alias(n) for n in names], none.alias("_out"))
        return F.aggregate(
            F.slice(values, k * block + 1, F.lit(block)), begin, one,
            lambda e: F.struct(*[e[n].alias(n) for n in names],
                               F.concat(s["_out"], F.array(e["_out"])).alias("_out")))

    begin = F.struct(*[c.alias(n) for n, c in start.items()],
                     F.array().cast(f"array<array<{kind}>>").alias("_out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    return F.when(F.size(values) == 0, none).otherwise(
        F.flatten(F.aggregate(blocks, begin, run)["_out"]))
