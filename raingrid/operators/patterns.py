"""Fills that learn from other variables: clusters and a forest, in passes of numpy over the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raingrid.functions import values as V
from raingrid.operators import clusters, forest
from raingrid.operators import windows as W
from raingrid.operators.common import BY, forward
from raingrid.operators.quantiles import counted, exact_quantiles, quantiles_of
from raingrid.session import written


def _scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds the standardised columns ``_x0``, ``_x1``...; a null takes the column mean.

    Only the one row of moments reaches the driver.
    """
    m = df.agg(F.count(F.lit(1)).alias("n"), *[
        f(c).alias(f"{k}{i}") for i, c in enumerate(cols)
        for k, f in (("mean", F.avg), ("known", F.count), ("spread", F.var_pop))]).first()

    def scale(i):
        # Nulls at the mean count as rows without a deviation.
        spread = (m[f"spread{i}"] or 0.0) * m[f"known{i}"] / max(m["n"] - 1, 1)
        return spread ** -0.5 if spread else 0.0

    return df.withColumns({f"_x{i}": (F.coalesce(F.col(c), F.lit(m[f"mean{i}"])) - m[f"mean{i}"]) * scale(i)
                           for i, c in enumerate(cols)})


def _nearest(xs: list[str], centers) -> Column:
    """Number of the nearest of ``centers`` (the first of equal ones)."""
    far = [sum(((F.col(x) - float(v)) * (F.col(x) - float(v)) for x, v in zip(xs, c)), F.lit(0.0))
           for c in centers]
    least, which = F.least(*far) if len(far) > 1 else far[0], F.lit(len(far) - 1)
    for j in reversed(range(len(far) - 1)):
        which = F.when(far[j] == least, j).otherwise(which)
    return which


def _silhouettes(rows: DataFrame, xs: list[str], models: dict) -> dict:
    """Mean silhouette by squared distance of each of ``models`` (number to centers); models that
    leave a cluster of one row, or one cluster only, have none.

    A mean distance to a cluster follows from its size, sum and sum of squares, so two passes over
    the rows serve all models: one for these moments, one for the means.
    """
    square = sum((F.col(x) * F.col(x) for x in xs), F.lit(0.0))
    placed = rows.select(*xs, square.alias("_sq"), *[
        _nearest(xs, centers).alias(f"_c{k}") for k, centers in models.items()])
    each = placed.select(*xs, "_sq", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"_c{k}").alias("c")) for k in models])).alias("_in"))
    moments = {(r["k"], r["c"]): r for r in each.groupBy("_in.k", "_in.c").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_sq").alias("sq"),
        *[F.sum(x).alias(x) for x in xs]).collect()}  # a row for each cluster
    means = {}
    for k, centers in models.items():
        own = [moments.get((k, j)) for j in range(len(centers))]
        if len(own) < 2 or any(m is None or m["n"] < 2 for m in own):
            continue
        far = [F.col("_sq") + m["sq"] / m["n"] - 2.0 * sum(
            (F.col(x) * (m[x] / m["n"]) for x in xs), F.lit(0.0)) for m in own]
        inside, others = F.lit(None).cast("double"), []
        for j, m in enumerate(own):
            here = F.col(f"_c{k}") == j
            inside = F.when(here, far[j] * (m["n"] / (m["n"] - 1.0))).otherwise(inside)
            others.append(F.when(~here, far[j]))
        outside = F.least(*others)
        means[k] = F.avg(F.when(inside < outside, 1.0 - inside / outside)
                         .when(inside > outside, outside / inside - 1.0).otherwise(0.0)).alias(f"k{k}")
    scores = placed.agg(*means.values()).first() if means else {}
    return {k: scores[f"k{k}"] for k in means}


def weather_patterns(df: DataFrame, cols: list[str], sizes=(2, 3, 4, 5), seed=42) -> DataFrame:
    """Adds ``pattern``: clusters of the size with the best silhouette.

    The standardised columns alone are written once to shared storage: each fit reads them many
    times, and a lost executor then costs one read and not the whole lineage. ``df`` itself is
    read twice for them and again by whoever reads the result.
    Sizes that leave a cluster of one row are skipped; if none is left, two clusters
    are taken, and with fewer than two rows all are pattern 0.
    """
    xs = [f"_x{i}" for i in range(len(cols))]
    scaled = _scaled(df, cols)
    rows = written(scaled.select(*xs), "patterns")
    if rows.limit(2).count() < 2:
        return df.withColumn("pattern", F.lit(0))
    centers = clusters.centers_of(rows, list(dict.fromkeys((*sizes, 2))), seed)
    scores = _silhouettes(rows, xs, {k: centers[k] for k in sizes})
    best = max(scores, key=scores.get, default=2)  # the first of equal ones
    return scaled.withColumn("pattern", _nearest(xs, centers[best])).drop(*xs)


def pattern_median_fill(df: DataFrame, features: list[str], value: str, ds="ds", by=BY,
                        sizes=(2, 3, 4, 5), in_time=True, out="filled", look_ahead=False) -> DataFrame:
    """Nulls take the median of their weather pattern, what is left is interpolated.

    Patterns are found over all series together; the median is that of the series' own
    rows of the pattern, else that of the whole pattern. A pattern may hold most rows;
    its median comes from ranges of values sorted in separate tasks. A series meets its own
    medians as one row, in the shuffle that its interpolation needs.
    """
    rows = weather_patterns(df, features, sizes)
    counts = counted(rows, (*by, "pattern"), value)
    own = quantiles_of(counts, [0.5], (*by, "pattern")).groupBy(*by).agg(F.map_from_entries(
        F.collect_list(F.struct("pattern", F.col("quantiles")[0]))).alias("_own"))
    medians = exact_quantiles(counts, [0.5], ("pattern",), "_v", weight="_n").select(
        "pattern", F.col("quantiles")[0].alias("_median"))  # at most max(sizes) rows
    filled = rows.join(own, list(by), "left").join(
        F.broadcast(medians), "pattern", "left").withColumn(
        out, F.coalesce(F.col(value), F.try_element_at("_own", F.col("pattern")), F.col("_median"))).drop(
        "_own", "_median")
    if in_time:
        filled = W.interpolate(filled, "time", direction="both", by=by, ds=ds, value=out, out=out,
                               look_ahead=look_ahead)
    return filled


def _split(keys: Column) -> Column:
    """Repeatable 80 percent share, by the first 32 bits of an md5 sum."""
    return F.conv(F.substring(F.md5(keys), 1, 8), 16, 10).cast("bigint") % 5 < 4


def rain_model(df: DataFrame, predictors: list[str], rr="rr", ds="ds", by=BY, trees=100, seed=42,
               depth=8):
    """Forest for rain or no rain, fitted on 80 percent of the complete days.

    One forest serves all series. ``depth`` bounds its trees (30 is the most that can be).
    """
    known = df.dropna(subset=[rr, *predictors]).withColumn(
        "label", (F.col(rr) > 0).cast("double"))
    train = _split(F.concat_ws("|", *by, F.col(ds).cast("string")))
    model = forest.grown(known.where(train), predictors, F.col("label"), F.xxhash64(*by, ds), trees, depth, seed)
    return model, model.transform(known.where(~train)).select("label", "rain")


def model_scores(predicted: DataFrame) -> DataFrame:
    """Accuracy and F1 of the rainy class, and the share of rainy days, in one pass."""
    hit = lambda a, b: F.count_if((F.col("label") == a) & (F.col("rain") == b))
    tp, fp, fn, tn = hit(1, 1), hit(0, 1), hit(1, 0), hit(0, 0)
    return predicted.agg(
        F.count(F.lit(1)).alias("n"), ((tp + tn) / F.count(F.lit(1))).alias("accuracy"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.avg("label").alias("wet"))


def importances(model, predictors: list[str], spark) -> DataFrame:
    """Predictors by importance; one row per predictor."""
    weights = model.importances
    return spark.createDataFrame(list(zip(predictors, weights)), "predictor string, importance double") \
        .orderBy(F.col("importance").desc(), "predictor")


def _wet_days(rows: DataFrame, rr, ds, by) -> DataFrame:
    """A row per series: ``_pools``, the rain of its known wet days in order of days per month
    (m1..), season (s..) and over all (a), and their median ``_mid``."""
    month, season = F.concat(F.lit("m"), F.col("_month").cast("int")), F.concat(F.lit("s"), "_season")
    wet = rows.where(F.col(rr) > 0).select(*by, ds, rr, month.alias("_mp"), season.alias("_sp")).repartition(*by)
    parts = wet.select(*by, ds, F.col(rr).alias("_draw"), F.explode(
        F.array("_mp", "_sp", F.lit("a"))).alias("_part")).groupBy(*by, "_part").agg(
        F.sort_array(F.collect_list(F.struct(ds, "_draw")))["_draw"].alias("_draws"),
        F.percentile("_draw", F.lit(0.5)).alias("_half"))
    return parts.where(F.col("_part").isNotNull()).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_part", "_draws"))).alias("_pools"),
        F.max(F.when(F.col("_part") == "a", F.col("_half"))).alias("_mid"))  # 17 parts at most


def _drawn(ds, by, least=5) -> Column:
    """A known wet day's rain for a row beside the row of ``_wet_days`` of its series.

    The month serves if it has more than ``least`` wet days, else the season, else all days; the
    place is a hash of series and date. A series with fewer takes its median wet day.
    """
    month, season = F.concat(F.lit("m"), F.col("_month").cast("int")), F.concat(F.lit("s"), "_season")
    pool = F.lit(None).cast("array<double>")
    for part in (F.lit("a"), season, month):
        days = F.try_element_at("_pools", part)
        pool = F.when(F.size(days) > least, days).otherwise(pool)
    place = F.pmod(F.xxhash64(*by, ds), F.greatest(F.size(pool), F.lit(1))).cast("int")
    return F.coalesce(F.get(pool, place), F.col("_mid"))


def rain_occurrence_fill(df: DataFrame, predictors: list[str], scheme="two_sep", rr="rr", ds="ds",
                         by=BY, min_rows=100, trees=100, seed=42, depth=8,
                         out="filled", look_ahead=False, gap_free=False) -> DataFrame:
    """Predicted dry days become 0; wet days draw from known wet days of the series.

    Predictors are interpolated in time first; one that a series lacks altogether takes the
    median of all. Whether the forest is used is decided for each series: with fewer than
    ``min_rows`` complete days its rain is interpolated in time. Draws hang on series and
    date only, so they repeat. ``ds`` is unique within a series.

    Days are judged where they were read; a series meets its wet days as one row, in the shuffle
    that its interpolation needs. ``gap_free`` says that no predictor has a null, so that there is
    nothing to interpolate in them.
    """
    full = {c: c if gap_free else f"_p_{c}" for c in predictors}
    rows = df if gap_free else W.interpolate_all(df, full, by, ds, look_ahead)
    whole = F.col(rr).isNotNull()
    for c in predictors:
        whole = whole & F.col(c).isNotNull()
    # In the order of the fills, so that they share one sort.
    series = forward(by, ds).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = written(rows.withColumns({
        "_month": F.month(ds).cast("double"), "_season": V.season(F.col(ds), scheme),
        "_enough": F.count(F.when(whole, 1)).over(series) >= min_rows}), "rain-days")
    learned = rows.where("_enough")
    kept = [*df.columns, "_month", "_season"]
    if learned.limit(1).count():
        model, _ = rain_model(learned, [*predictors, "_month"], rr, ds, by, trees, seed, depth)
        missing, asks = F.col(rr).isNull(), F.col("_enough") & F.col(rr).isNull()
        lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in full.values()])
        middle = {}
        if learned.where(missing & lacks).limit(1).count():
            medians = exact_quantiles(
                rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(p).alias("v"))
                                                for c, p in full.items()])).alias("x")).select("x.*"),
                [0.5], ("c",), "v").select("c", F.col("quantiles")[0].alias("m"))
            middle = {r["c"]: r["m"] for r in medians.collect()}  # one row per predictor
        ready = rows.where(asks).select(*kept, *[F.coalesce(
            F.col(p), F.lit(middle.get(c, 0.0))).alias(f"_f_{c}") for c, p in full.items()],
            F.col("_month").alias("_f__month"))
        judged = model.transform(ready, [f"_f_{c}" for c in (*full, "_month")])
        judged = judged.select(*kept, "rain").unionByName(
            rows.where(~asks).select(*kept, F.lit(None).cast("double").alias("rain")))
        named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, ds)])
        rows = judged.join(_wet_days(learned, rr, ds, by), list(by), "left").withColumn(
            "_guess", F.when(named & (F.col("rain") == 0), 0.0).when(
                named & F.col("rain").isNotNull(), _drawn(ds, by))).drop("_pools", "_mid", "rain")
    else:
        rows = rows.withColumn("_guess", F.lit(None).cast("double"))
    filled = rows.withColumn("_f", F.coalesce(rr, "_guess"))
    filled = W.interpolate(filled, "time", direction="both", by=by, ds=ds, value="_f", out=out,
                           look_ahead=look_ahead)
    return filled.withColumn(out, V.bound(F.col(out), 0)).select(*df.columns, out)
