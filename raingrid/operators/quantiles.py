"""Exact quantiles of groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raingrid.session import written

#: Ranges up to which a table of them is sent to every task.
SENT_RANGES = 100_000


def _within(counts: DataFrame, ranges: DataFrame, by) -> DataFrame:
    """Counted values that lie in a range (above lo, up to hi) of their group."""
    small = ranges.count() <= SENT_RANGES
    rows = counts.join(F.broadcast(ranges) if small else ranges, list(by))
    return rows.where((F.col("_lo").isNull() | (F.col("_v") > F.col("_lo")))
                      & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi"))))


def _narrowed(inside: DataFrame, wanted: DataFrame, cuts: int, by) -> DataFrame:
    """``wanted`` with the part of its range that holds its rank."""
    key = [*by, "_lo", "_hi", "_before"]
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    borders = inside.groupBy(*key).agg(F.percentile_approx("_v", shares, F.lit(10 * cuts)).alias("_cuts"))
    names = {c: f"{c}2" for c in key}
    borders = written(borders.withColumnsRenamed(names), "borders")
    same = None
    for c, other in names.items():
        test = F.col(c).eqNullSafe(F.col(other))
        same = test if same is None else same & test
    small = borders.count() <= SENT_RANGES
    placed = inside.join(F.broadcast(borders) if small else borders, same).withColumn(
        "_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    parts = placed.groupBy(*key, "_part").agg(F.sum("_n").alias("_rows"), F.max("_v").alias("_top"))
    order = Window.partitionBy(*key).orderBy("_part")
    parts = parts.withColumns({
        "_start": F.col("_before") + F.sum("_rows").over(order) - F.col("_rows"),
        "_under": F.coalesce(F.lag("_top").over(order), F.col("_lo"))})
    parts = parts.withColumnsRenamed(names)
    return wanted.join(parts, same).where(F.col("_rank").between(
        F.col("_start"), F.col("_start") + F.col("_rows") - 1)).select(
        *by, "_i", "_rank", "_share", F.col("_under").alias("_lo"), F.col("_top").alias("_hi"),
        F.col("_start").alias("_before"))


def counted(df: DataFrame, by=("series",), value="value", weight: str | None = None) -> DataFrame:
    """Written table of the distinct values ``_v`` of each group and their number ``_n``.

    ``weight`` names a column that says how often a row counts.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return written(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(
        n.alias("_n")), "counted")


def _wanted(probs: list[float]) -> Column:
    """Array of the ranks, and their shares, that make up the quantiles of ``_total`` values."""
    at, pairs = (F.col("_total") - 1) * F.lit(1.0), []
    for i, p in enumerate(probs):
        low, over = F.floor(at * p), at * p - F.floor(at * p)
        pairs += [F.struct(F.lit(i).alias("_i"), low.alias("_rank"), (1.0 - over).alias("_share")),
                  F.struct(F.lit(i).alias("_i"), F.ceil(at * p).alias("_rank"), over.alias("_share"))]
    return F.array(*pairs)


def _together(points: DataFrame, by) -> DataFrame:
    sums = points.groupBy(*by, "_i").agg(F.sum(F.col("_v") * F.col("_share")).alias("_q"))
    return sums.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"])
        .alias("quantiles"))


def _in_one_shuffle(counts: DataFrame, probs: list[float], by) -> DataFrame:
    """Quantiles of groups that are each sorted by one task."""
    order = Window.partitionBy(*by).orderBy("_v")
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    for b in by:
        counts = counts.where(F.col(b).isNotNull())
    ranked = counts.repartition(*by).withColumns({"_upto": upto, "_total": whole})
    hits = F.filter(_wanted(probs), lambda w: (w["_rank"] < F.col("_upto"))
                    & (w["_rank"] >= F.col("_upto") - F.col("_n")))
    return _together(ranked.select(*by, "_v", F.explode(hits).alias("_w")).select(*by, "_v", "_w.*"), by)


def exact_quantiles(df: DataFrame, probs: list[float], by=("series",), value="value",
                    most: int = 1_000_000, cuts: int = 256, weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles, one array ``quantiles`` per group; see ``quantiles_of``."""
    return quantiles_of(counted(df, by, value, weight), probs, by, most, cuts)


def quantiles_of(counts: DataFrame, probs: list[float], by=("series",), most: int = 1_000_000,
                 cuts: int = 256) -> DataFrame:
    """Linear-interpolated quantiles of a table of ``counted``, one array ``quantiles`` per group.

    ``percentile`` holds every distinct value of a group in one buffer. Here equal values are
    counted once and written; the range in which a wanted rank lies is narrowed, by a sketch of
    its values into about ``cuts`` parts, until no range has more than ``most`` distinct values;
    only those are sorted, each in its own task. The sketch only places borders, so the result is
    exact. Each round reads the counted values while the plan is built; groups of up to ``most``
    values need none. Nulls are left out, and a group without values has no row.
    """
    if (counts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= most:
        return _in_one_shuffle(counts, probs, by)
    kind = dict(counts.dtypes)["_v"]
    wanted = counts.groupBy(*by).agg(F.sum("_n").alias("_total")).select(
        *by, F.explode(_wanted(probs)).alias("_w")).select(
        *by, "_w.*", F.lit(None).cast(kind).alias("_lo"), F.lit(None).cast(kind).alias("_hi"),
        F.lit(0).cast("long").alias("_before"))
    while True:
        wanted = written(wanted, "wanted")
        inside = _within(counts, wanted.select(*by, "_lo", "_hi", "_before").distinct(), by)
        sizes = inside.groupBy(*by, "_lo", "_hi").count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= most:
            break
        wanted = _narrowed(inside, wanted, cuts, by)

    upto = Window.partitionBy(*by, "_lo", "_hi").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto)).select(
        *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_lo").alias("_lo2"),
        F.col("_hi").alias("_hi2"), "_v", (F.col("_upto") - F.col("_n")).alias("_from"), "_upto")
    own = F.col("_lo").eqNullSafe(F.col("_lo2")) & F.col("_hi").eqNullSafe(F.col("_hi2"))
    for i, b in enumerate(by):
        own = own & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    hit = ranked.join(wanted, own).where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto")))
    return _together(hit.select(*by, "_i", "_v", "_share"), by)
