"""Smoothing of series that are too long for one task.

Every step of these recursions is an affine map of a small state, and maps compose. A series is cut
into blocks of days; each block is folded on its own from a zero state, which gives its map; the
maps of a series, one small row each, are chained to the state that every block begins with; then
each block is run again from there. Blocks spread over the tasks, whatever their series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.operators.common import BY, from_arrays, scan


def _blocks(df: DataFrame, days: int, by, ds, value) -> DataFrame:
    """A row per series and block: days and vals in order."""
    block = F.floor(F.unix_date(F.col(ds)) / days).alias("_block")
    points = F.sort_array(F.collect_list(F.struct(ds, F.col(value).cast("double").alias(value))))
    return df.groupBy(*by, block).agg(points.alias("p")).select(
        *by, "_block", F.col(f"p.{ds}").alias("days"), F.col(f"p.{value}").alias("vals"))


def _chained(blocks: DataFrame, size: int, fresh, step, by) -> DataFrame:
    """Adds ``_in``, the state (array of ``size``) each block begins with.

    ``step`` maps a state and a value to the next state, affine in the state; ``fresh`` is the
    state before the first value of the series, as a column of its first two values.
    """
    zero = F.array(*[F.lit(0.0)] * size)
    units = [F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(size)]) for i in range(size)]
    run = lambda start: F.aggregate("vals", start, step)
    # Images of the unit states less that of zero are the columns of the block's matrix.
    maps = blocks.select(*by, "_block", run(zero).alias("b"), F.array(*map(run, units)).alias("u"),
                         F.slice("vals", 1, 2).alias("head"))
    maps = maps.groupBy(*by).agg(F.sort_array(F.collect_list(
        F.struct("_block", "b", "u", "head"))).alias("_m"))

    def through(s, m):
        """The state after a block: its image of zero plus its matrix times the state before."""
        out = F.zip_with(m["b"], F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.aggregate(
            F.zip_with(m["u"], s["x"], lambda u, x: (F.get(u, r) - F.get(m["b"], r)) * x),
            F.lit(0.0), lambda a, t: a + t)), lambda b, t: b + t)
        return {"x": out}, s["x"]

    first = fresh(F.flatten(F.transform(F.slice("_m", 1, 2), lambda m: m["head"])))
    starts = scan(F.col("_m"), {"x": first}, through, "array<double>")
    keyed = maps.select(*by, F.explode(F.arrays_zip(F.col("_m._block").alias("_block"), starts.alias("_in"))
                                       ).alias("z")).select(*by, "z.*")
    return blocks.join(keyed, [*by, "_block"])


def _replayed(chained: DataFrame, step, emit, kind: str, by, ds, value, out) -> DataFrame:
    """One row per day with what ``emit`` makes of the state before, the value, and the state after."""
    def one(s, y):
        after = step(s["x"], y)
        return {"x": after}, emit(s["x"], y, after)

    path = scan(F.col("vals"), {"x": F.col("_in")}, one, kind)
    return from_arrays(chained.withColumn("_path", path), by, ds, **{value: "vals", out: "_path"})


def ses_long(df: DataFrame, alpha: float, block_days: int = 4096, by=BY, ds="ds", value="value",
             out="fitted") -> DataFrame:
    """One-step-ahead values of single smoothing; those of ``smoothing.ses``, for any length."""
    def step(x, y):
        return F.array(alpha * y + (1.0 - alpha) * F.get(x, F.lit(0)))

    blocks = _blocks(df, block_days, by, ds, value)
    chained = _chained(blocks, 1, lambda v: F.array(F.get(v, F.lit(0))), step, by)
    return _replayed(chained, step, lambda x, y, after: F.get(x, F.lit(0)), "double", by, ds, value, out)


def holt_long(df: DataFrame, alpha: float, beta: float, block_days: int = 4096, by=BY, ds="ds",
              value="value", out="fitted") -> DataFrame:
    """One-step-ahead values of level and trend; those of ``smoothing.holt``, for any length. A
    series of one value has no trend, and null values."""
    def step(x, y):
        level, slope = F.get(x, F.lit(0)), F.get(x, F.lit(1))
        new = alpha * y + (1.0 - alpha) * (level + slope)
        return F.array(new, beta * (new - level) + (1.0 - beta) * slope)

    def fresh(v):
        return F.array(F.get(v, F.lit(0)), F.get(v, F.lit(1)) - F.get(v, F.lit(0)))

    chained = _chained(_blocks(df, block_days, by, ds, value), 2, fresh, step, by)
    return _replayed(chained, step, lambda x, y, after: F.get(x, F.lit(0)) + F.get(x, F.lit(1)),
                     "double", by, ds, value, out)


def ewma_long(df: DataFrame, span: int, block_days: int = 4096, by=BY, ds="ds", value="value",
              out="ewma") -> DataFrame:
    """Exponentially weighted means, as ``windows.ewma`` gives them, for any length."""
    keep = 1.0 - 2.0 / (span + 1)

    def step(x, y):
        return F.array(F.get(x, F.lit(0)) * keep + F.coalesce(y, F.lit(0.0)),
                       F.get(x, F.lit(1)) * keep + F.when(y.isNotNull(), 1.0).otherwise(0.0))

    chained = _chained(_blocks(df, block_days, by, ds, value), 2,
                       lambda v: F.array(F.lit(0.0), F.lit(0.0)), step, by)
    return _replayed(chained, step, lambda x, y, after: F.try_divide(
        F.get(after, F.lit(0)), F.get(after, F.lit(1))), "double", by, ds, value, out)
