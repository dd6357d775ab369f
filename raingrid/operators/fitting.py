"""Smoothing parameters by derivative-free search, for all series at once.

Each series and model is one row, dealt over the tasks; a task searches its rows in Arrow batches
(``batchfit``), all series of a batch at a time. ``simplex_search`` is the same search as a fold of
column expressions, for errors that are columns: its state holds a simplex of parameter points and
the points to be tried next; every step tries those and moves the simplex. A series whose simplex
has become small enough asks for no more points. No row leaves its task between the steps.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raingrid.operators import batchfit
from raingrid.operators.common import BY, dealt, to_arrays
from raingrid.operators.linear import let
from raingrid.operators.smoothing import (
    SETTINGS, best_candidate, score_on, split_arrays, usable,
)

#: Least and greatest value of each parameter, and the values a search starts from.
BOUNDS = {"alpha": (0.0, 1.0), "beta": (0.0, 1.0), "gamma": (0.0, 1.0), "phi": (0.8, 0.98)}
STARTS = {"alpha": (0.05, 0.3, 0.8), "beta": (0.01, 0.2), "gamma": (0.05, 0.4), "phi": (0.9,)}
#: What stands for the error of a point that gives none (a division by zero).
HOPELESS = batchfit.HOPELESS


def simplex_search(error, starts: list[list[float]], bounds: list[tuple[float, float]],
                   tries: int = 160, tolerance: float = 1e-9, restarts: int = 1) -> Column:
    """Struct of the least error ``f`` found, where (``x``), and how many points were ``tried``.

    ``error`` maps an array of parameters to a number. The search goes from the best of
    ``starts`` by reflecting, stretching, contracting and shrinking a simplex inside ``bounds``,
    and again from where it ends, ``restarts`` times. ``tries`` bounds the steps.
    """
    k = len(bounds)
    box = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in bounds])
    point = "struct<f:double,x:array<double>>"
    no_points = F.array().cast(f"array<{point}>")
    no_asks = F.array().cast("array<array<double>>")
    #: What the points that were asked for are.
    start, simplex, reflected, stretched, outside, inside, shrunk = range(7)

    def held_in(x):
        return F.zip_with(x, box, lambda v, b: F.greatest(b["a"], F.least(b["b"], v)))

    def around(x, size):
        """``x`` and ``k`` points beside it, away from the nearer bound; ``size`` is a share of the
        bounds."""
        moves = [F.array(*[size * F.lit(b - a if i == j else 0.0) for j, (a, b) in enumerate(bounds)])
                 for i in range(k)]
        middle = [(a + b) / 2 for a, b in bounds]
        signs = F.zip_with(x, F.array(*map(F.lit, middle)),
                           lambda v, c: F.when(v > c, -1.0).otherwise(1.0))
        beside = [F.zip_with(x, F.zip_with(move, signs, lambda d, g: d * g), lambda v, d: v + d)
                  for move in moves]
        return F.array(x, *beside)

    def along(pts, t):
        """The point on the line from the worst point through the middle of the others."""
        zero = F.array(*[F.lit(0.0)] * k)
        total = F.aggregate(F.slice(pts, 1, k), zero,
                            lambda a, q: F.zip_with(a, q["x"], lambda u, w: u + w))
        return held_in(F.zip_with(total, F.element_at(pts, k + 1)["x"],
                                  lambda c, w: c / k + t * (c / k - w)))

    def state(pts, ask, mode, held, left, tried):
        return F.struct(pts.alias("pts"), ask.alias("ask"), mode.cast("int").alias("mode"),
                        held.cast(point).alias("held"), left.cast("int").alias("left"),
                        tried.cast("int").alias("tried"))

    def moved(s, got):
        """The state after the points asked for have been tried."""
        mode, pts, new = s["mode"], s["pts"], F.get(got, F.lit(0))
        best, second, worst = F.get(pts, F.lit(0)), F.get(pts, F.lit(k - 1)), F.get(pts, F.lit(k))
        swap = lambda p: F.array_sort(F.concat(F.slice(pts, 1, k), F.array(p)))
        settled = (
            F.when(mode == simplex, F.array_sort(got))
            .when(mode == shrunk, F.array_sort(F.concat(F.array(best), got)))
            .when(mode == reflected, F.when((new["f"] >= best["f"]) & (new["f"] < second["f"]), swap(new)))
            .when(mode == stretched, swap(F.when(new["f"] < s["held"]["f"], new).otherwise(s["held"])))
            .when(mode == outside, F.when(new["f"] <= s["held"]["f"], swap(new)))
            .when(mode == inside, F.when(new["f"] < worst["f"], swap(new))))
        tried = s["tried"] + F.size(got)

        def after(p):
            low, high = F.get(p, F.lit(0)), F.get(p, F.lit(k))
            spread = F.array_max(F.transform(p, lambda q: F.array_max(F.zip_with(
                q["x"], low["x"], lambda u, w: F.abs(u - w)))))
            small = (high["f"] - low["f"] <= tolerance * F.abs(low["f"])) & (spread < 1e-3)
            again = small & (s["left"] > 0)
            # Each time closer by, as a simplex that was held at a bound may have missed a bottom there.
            size = 0.1 * F.pow(F.lit(0.15), (restarts - s["left"]).cast("double"))
            ask = F.when(again, around(low["x"], size)).when(small, no_asks).otherwise(
                F.array(along(p, 1.0)))
            return state(p, ask, F.when(again, simplex).otherwise(reflected), s["held"],
                         s["left"] - again.cast("int"), tried)

        first = F.array_min(got)
        smaller = F.transform(F.slice(pts, 2, k), lambda q: F.zip_with(
            q["x"], best["x"], lambda v, b: (v + b) / 2))
        further = (
            F.when(mode != reflected, state(pts, smaller, F.lit(shrunk), s["held"], s["left"], tried))
            .when(new["f"] < best["f"],
                  state(pts, F.array(along(pts, 2.0)), F.lit(stretched), new, s["left"], tried))
            .when(new["f"] < worst["f"],
                  state(pts, F.array(along(pts, 0.5)), F.lit(outside), new, s["left"], tried))
            .otherwise(state(pts, F.array(along(pts, -0.5)), F.lit(inside), new, s["left"], tried)))
        return F.when(mode == start, state(no_points, around(first["x"], F.lit(0.15)), F.lit(simplex),
                                           F.lit(None), s["left"], tried)).otherwise(
            let(settled, lambda p: F.when(p.isNotNull(), after(p)).otherwise(further)))

    def step(s, _):
        tried = F.transform(s["ask"], lambda x: F.struct(error(x).alias("f"), x.alias("x")))
        return F.when(F.size(s["ask"]) == 0, s).otherwise(let(tried, lambda got: moved(s, got)))

    begin = state(no_points, F.array(*[F.array(*[F.lit(float(v)) for v in x]) for x in starts]),
                  F.lit(start), F.lit(None), F.lit(restarts), F.lit(0))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), begin, step)
    return let(end, lambda s: F.struct(F.get(s["pts"], F.lit(0))["f"].alias("f"),
                                       F.get(s["pts"], F.lit(0))["x"].alias("x"),
                                       s["tried"].alias("tried")))


def model(kind="none", m: int = 0, trend=True, damped=False) -> dict:
    """A kind of model whose parameters are to be found: none, add or mul seasons of ``m`` days;
    without ``trend`` beta is 0, without ``damped`` phi is 1."""
    return {"kind": kind, "m": 0 if kind == "none" else m, "trend": trend, "damped": damped}


def _searched(models: list[dict], tries: int):
    """Function of values, place of the model and whether it can be used: struct of the parameters,
    the least mean squared error and the number of tries, for a batch of series at a time."""
    plans = []
    for c in models:
        free = ["alpha", *(["beta"] if c["trend"] else []), *(["gamma"] if c["m"] else []),
                *(["phi"] if c["trend"] and c["damped"] else [])]
        # One parameter is looked for all over its range, as its error may have several bottoms.
        grid = [[i / 24] for i in range(25)] if free == ["alpha"] else [
            list(x) for x in itertools.product(*[STARTS[n] for n in free])]
        plans.append((c, free, grid, [BOUNDS[n] for n in free], 3 if len(free) == 1 else 1))

    @F.arrow_udf("alpha double, beta double, gamma double, phi double, mse double, tried int")
    def found(vals: pa.Array, place: pa.Array, use: pa.Array) -> pa.Array:
        place, use = place.to_numpy(zero_copy_only=False), use.to_numpy(zero_copy_only=False)
        out = np.full((len(place), 6), np.nan)
        for i, plan in enumerate(plans):
            rows = np.flatnonzero(use.astype(bool) & (place == i))
            if len(rows):
                taken = vals.take(pa.array(rows))
                flat = taken.flatten().to_numpy(zero_copy_only=False).astype(float)
                sizes = taken.value_lengths().to_numpy(zero_copy_only=False).astype(int)
                out[rows] = batchfit.searched(flat, sizes, *plan, tries)
        # A row that cannot be used is null as a whole, by its fields.
        none = ~use.astype(bool)
        fields = [pa.array(out[:, j], mask=none) for j in range(5)]
        fields.append(pa.array(np.where(none, 0, out[:, 5]).astype(np.int32), mask=none))
        return pa.StructArray.from_arrays(
            fields, names=["alpha", "beta", "gamma", "phi", "mse", "tried"])

    return found


def fit_rows(rows: DataFrame, models: list[dict], vals="vals", fair: Column | None = None,
             tries: int = 160, by=BY) -> DataFrame:
    """A row for each of ``rows`` and model, with candidate, m, kind and the found alpha, beta,
    gamma, phi, mse and tried. Null where the model cannot be used or ``fair`` (of m and kind) is
    false. Models are spread over the tasks."""
    kinds = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(c["m"]).alias("m"),
                               F.lit(c["kind"]).alias("kind")) for i, c in enumerate(models)])
    out = dealt(rows.withColumn("_c", F.explode(kinds)).select(*rows.columns, "_c.*"),
                *by, "candidate")
    use = usable(vals) if fair is None else usable(vals) & fair
    found = _searched(models, tries)(F.col(vals).cast("array<double>"), "candidate", "_use")
    return out.withColumn("_use", F.coalesce(use, F.lit(False))).withColumn("_f", found).select(
        *out.columns, "_f.*")


def fitted(df: DataFrame, models: list[dict], tries: int = 160, by=BY, ds="ds",
           value="value") -> DataFrame:
    """Parameters with the least squared one-step error for every series and model.

    Columns: ``by``, candidate (place in ``models``), m, kind, alpha, beta, gamma, phi, mse and
    tried (points whose error was worked out). The model starts from the first season as
    ``smoothing.fit`` does. A series that is too short or, with mul, has values at or below 0 gets
    the settings of ``smoothing.candidate`` and null mse. With one model, ready for
    ``smoothing.fit_best``.
    """
    rows = fit_rows(to_arrays(df, by, ds, value), models, tries=tries, by=by)
    names = ("alpha", "beta", "gamma", "phi")
    return rows.select(*by, "candidate", "m", "kind", *[
        F.coalesce(n, F.lit(float(SETTINGS[n]))).alias(n) for n in names], "mse", "tried")


def search(df: DataFrame, models: list[dict], last=60, remove_bias=True, tries: int = 160, by=BY,
           ds="ds", value="value", default: dict | None = None) -> DataFrame:
    """The model of each series that forecasts its held-out end best, with found parameters.

    As ``smoothing.grid_search``, but every model is fitted to the training part first: a season
    of at least half of it is skipped, and a multiplicative one on values at or below 0 anywhere.
    """
    arrays = split_arrays(to_arrays(df, by, ds, value), last)
    fair = (F.col("m") < F.size("train") / 2) & ((F.col("kind") != "mul") | (F.array_min("vals") > 0))
    # No filter on what was found: it would be pushed below the search and run it again.
    rows = fit_rows(arrays, models, "train", fair, tries, by).withColumnRenamed("mse", "train_mse")
    return best_candidate(df, score_on(rows, remove_bias), by, default)
