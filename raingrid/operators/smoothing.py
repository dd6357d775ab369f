"""Exponential smoothing: one row per series, or per series, candidate and fold.

The scale is many series times many candidates and folds. Each series is one row with a
sorted array no longer than the calendar; a task smooths its rows in Arrow batches
(``batchfit``), a day being one step for all rows of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.operators import batchfit
from raingrid.operators.common import BY, dealt, mean, to_arrays, total

SETTINGS = {"alpha": 0.2, "beta": 0.05, "gamma": 0.15, "phi": 1.0, "m": 7, "kind": "add"}


def candidate(**given) -> dict:
    """Settings of one model; ``kind`` is none, add or mul, and m is 0 for none."""
    out = {**SETTINGS, **given}
    if out["kind"] == "none":
        out["m"] = 0
    return out


#: Tasks that share the candidates of one series.
SPREAD = 4


def with_candidates(df: DataFrame, candidates: list[dict], by=BY, spread=True) -> DataFrame:
    """One row per series row and candidate, spread over the tasks.

    The candidates are dealt into at most ``SPREAD`` lots. Each series travels once per lot
    and is multiplied after the shuffle, so the network never carries it per candidate.
    """
    kinds = {"alpha": "double", "beta": "double", "gamma": "double", "phi": "double",
             "m": "int", "kind": "string"}
    rows = [F.struct(F.lit(i).alias("candidate"), *[
        F.lit(c[k]).cast(t).alias(k) for k, t in kinds.items()])
        for i, c in enumerate(candidates)]
    lots = min(SPREAD, len(rows)) if spread else 1
    if lots > 1:
        df = df.select("*", F.explode(F.array(*map(F.lit, range(lots)))).alias("_lot"))
        df = dealt(df, *by, "_lot")
        pick = F.lit(None)
        for lot in reversed(range(lots)):
            pick = F.when(F.col("_lot") == lot, F.array(*rows[lot::lots])).otherwise(pick)
    else:
        pick = F.array(*rows)
    out = df.withColumn("_c", F.explode(pick))
    return out.select(*[c for c in df.columns if c != "_lot"], "_c.*")


def usable(vals="vals") -> Column:
    """Two whole seasons, and no multiplicative season on values at or below 0."""
    long_enough = F.size(vals) >= F.greatest(F.col("m") * 2, F.lit(2))
    positive = (F.col("kind") != "mul") | (F.array_min(vals) > 0)
    return long_enough & positive


def _numbers(vals: pa.Array):
    """Values of all arrays laid end to end (not a number for null), where each begins, and sizes."""
    flat = vals.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = pc.fill_null(vals.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(int)
    return flat, np.cumsum(sizes) - sizes, sizes


def _arrays(parts) -> pa.Array:
    """An array for each of ``parts``; null for what is not a number."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([np.empty(0), *parts])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=np.isnan(flat)))


def _fitted(trend: bool, keep_fitted: bool):
    """Function of values and settings: the struct ``fit``, for a batch of series at a time."""
    @F.arrow_udf("l double, b double, s array<double>, sse double, sr double, n int, "
                 "fitted array<double>")
    def ends(vals: pa.Array, alpha: pa.Array, beta: pa.Array, gamma: pa.Array, phi: pa.Array,
             m: pa.Array, kind: pa.Array) -> pa.Array:
        flat, begins, sizes = _numbers(vals)
        number = lambda c: c.to_numpy(zero_copy_only=False).astype(float)
        p = {"alpha": number(alpha), "beta": number(beta), "gamma": number(gamma), "phi": number(phi)}
        m = pc.fill_null(m, -1).to_numpy(zero_copy_only=False)
        kind = np.array(kind.to_pylist(), dtype=object)
        none = ~vals.is_valid().to_numpy(zero_copy_only=False) | (m < 0) | (kind == None)  # noqa: E711
        out = {k: np.full(len(m), np.nan) for k in ("l", "b", "sse", "sr")}
        seasons, ahead = [np.empty(0)] * len(m), [np.empty(0)] * len(m)
        for k, length in sorted(set(zip(kind[~none], m[~none]))):
            rows = np.flatnonzero(~none & (kind == k) & (m == length))
            with np.errstate(all="ignore"):
                got = batchfit.fits(flat, begins[rows], sizes[rows], {n: v[rows] for n, v in p.items()},
                                    k, int(length), trend, keep_fitted)
            for name, v in out.items():
                v[rows] = got[name]
            for i, r in enumerate(rows):
                seasons[r] = got["s"][i]
                if keep_fitted:
                    ahead[r] = got["fitted"][begins[r]:begins[r] + sizes[r]]
        field = lambda v: pa.array(v, mask=np.isnan(v))
        fields = {"l": field(out["l"]), "b": field(out["b"]), "s": _arrays(seasons),
                  "sse": field(out["sse"]), "sr": field(out["sr"]),
                  "n": pa.array(sizes.astype(np.int32)), "fitted": _arrays(ahead)}
        return pa.StructArray.from_arrays(list(fields.values()), names=list(fields),
                                          mask=pa.array(none))

    # Not deterministic as far as Spark is told, so that no filter on a fit runs it again.
    return ends.asNondeterministic()


def fit(df: DataFrame, vals="vals", trend=True, keep_fitted=False) -> DataFrame:
    """Adds ``fit``: level, trend, season, squared error, residual sum and count.

    Start: level is the mean of the first season, trend the rise to the second
    season's mean per step, season the first season's offsets (or ratios). Without
    a season: the first value and the first step. Unusable rows get a null fit.
    ``season[0]`` is the one due next. With ``keep_fitted`` the one-step-ahead
    values are kept as ``fitted``.

    A task goes through the days of an Arrow batch of rows with the same season at once
    (``batchfit.run``).
    """
    settings = ("alpha", "beta", "gamma", "phi", "m", "kind")
    return df.withColumn("fit", _fitted(trend, keep_fitted)(
        F.when(usable(vals), F.col(vals).cast("array<double>")), *map(F.col, settings)))


def ahead(h: Column, remove_bias=False) -> Column:
    """Value ``h`` steps past the end of the fit; the bias is the mean residual."""
    phi, f, m = F.col("phi"), F.col("fit"), F.col("m")
    damped = phi * (1.0 - F.pow(phi, h.cast("double"))) / (1.0 - phi)
    run = f["l"] + F.when(F.abs(phi - 1.0) < 1e-12, h.cast("double")).otherwise(damped) * f["b"]
    due = F.get(f["s"], F.pmod(h - 1, F.greatest(m, F.lit(1))).cast("int"))
    value = F.when(m == 0, run).when(F.col("kind") == "mul", run * due).otherwise(run + due)
    return value + f["sr"] / f["n"] if remove_bias else value


def forecast(fits: DataFrame, horizon: int, by=BY, ds="ds", remove_bias=False,
             floor: float | None = None, out="yhat") -> DataFrame:
    """Rows ``h`` = 1..horizon dated after the last day of ``days``."""
    steps = fits.withColumn("_end", F.element_at("days", -1)).drop("days", "vals").withColumn(
        "h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = ahead(F.col("h"), remove_bias)
    if floor is not None:
        value = F.when(value.isNotNull(), F.greatest(value, F.lit(float(floor))))
    return steps.withColumn(out, value).select(
        *by, "candidate", "h", F.date_add("_end", F.col("h")).alias(ds), out)


def fitted_rows(fits: DataFrame, by=BY, ds="ds", remove_bias=False) -> DataFrame:
    """One row per day with the value and its one-step-ahead fit."""
    zipped = F.arrays_zip(F.col("days"), F.col("vals"), F.col("fit.fitted").alias("fitted"))
    bias = F.col("fit.sr") / F.col("fit.n") if remove_bias else F.lit(0.0)
    return fits.select(*by, "candidate", bias.alias("_bias"), F.explode_outer(zipped).alias("z")).select(
        *by, "candidate", F.col("z.days").alias(ds), F.col("z.vals").alias("value"),
        (F.col("z.fitted") + F.col("_bias")).alias("fitted"))


def smooth(df: DataFrame, settings: dict, trend=True, keep_fitted=True, by=BY, ds="ds",
           value="value") -> DataFrame:
    """Fit one setting to every series."""
    return fit(with_candidates(to_arrays(df, by, ds, value), [settings]), trend=trend,
               keep_fitted=keep_fitted)


def ses(df: DataFrame, alpha: float, **kw) -> DataFrame:
    return smooth(df, candidate(alpha=alpha, beta=0.0, kind="none"), trend=False, **kw)


def holt(df: DataFrame, alpha: float, beta: float, **kw) -> DataFrame:
    return smooth(df, candidate(alpha=alpha, beta=beta, kind="none"), **kw)


def holt_winters(df: DataFrame, **settings) -> DataFrame:
    return smooth(df, candidate(**settings))


def _squared_error(test: Column, guess: Column) -> Column:
    """Mean squared difference of two arrays of the same length."""
    pairs = F.zip_with(test, guess, lambda t, g: (t - g) * (t - g))
    return total(pairs) / F.size(test)


def score_on(df: DataFrame, remove_bias=False) -> DataFrame:
    """Fit on ``train`` and add ``mse`` on ``test``; null where unusable."""
    fits = fit(df, vals="train")
    guess = F.transform(F.sequence(F.lit(1), F.size("test")), lambda h: ahead(h, remove_bias))
    return fits.withColumn("mse", F.when(F.col("fit").isNotNull(),
                                         _squared_error(F.col("test"), guess)))


def _cut(vals="vals", last=60, share=0.8) -> Column:
    """Values before the held-out end: the last rows, or a share where the series is short."""
    n = F.size(vals)
    return F.when(n > last, n - last).otherwise(F.floor(n * share)).cast("int")


def split_arrays(arrays: DataFrame, last=60, share=0.8) -> DataFrame:
    """``train`` and ``test``: the last rows, or a share where the series is short."""
    return arrays.withColumn("_cut", _cut("vals", last, share)).withColumns({
        "train": F.slice("vals", F.lit(1), F.col("_cut")),
        "test": F.slice("vals", F.col("_cut") + 1, F.size("vals"))}).drop("_cut")


def _held_out_errors(candidates: list[dict], remove_bias: bool):
    """Function of values, size of the training part and least value: the error of each candidate."""
    m = np.array([c["m"] for c in candidates])
    mul = np.array([c["kind"] == "mul" for c in candidates])

    @F.arrow_udf("array<double>")
    def errors(vals: pa.Array, cut: pa.Array, least: pa.Array) -> pa.Array:
        flat, begins, sizes = _numbers(vals)
        cut = cut.to_numpy(zero_copy_only=False).astype(int)[:, None]
        above = least.to_numpy(zero_copy_only=False).astype(float)[:, None] > 0
        use = (cut >= 2) & (2 * m < cut) & (~mul | above)
        with np.errstate(all="ignore"):
            return _arrays(batchfit.held_out_errors(flat, begins, sizes, cut[:, 0], candidates, use,
                                                    remove_bias))

    return errors.asNondeterministic()


MODEL = ("candidate", "alpha", "beta", "gamma", "phi", "m", "kind", "mse")


def with_best(arrays: DataFrame, candidates: list[dict], last=60, remove_bias=True,
              default: dict | None = None) -> DataFrame:
    """Adds the best candidate of ``grid_search``, its settings and ``mse``, ready for ``fit``.

    All candidates are tried where the series is; neither rows nor errors travel.
    """
    kinds = {"alpha": "double", "beta": "double", "gamma": "double", "phi": "double",
             "m": "int", "kind": "string"}
    settings = F.array(*[F.struct(*[F.lit(c[k]).cast(t).alias(k) for k, t in kinds.items()])
                         for c in candidates])
    errors = _held_out_errors(candidates, remove_bias)(
        F.col("vals").cast("array<double>"), "_cut", F.array_min("vals").cast("double"))
    ranked = F.filter(F.transform("_errors", lambda x, i: F.struct(
        x.alias("mse"), i.alias("candidate"))), lambda b: b["mse"].isNotNull())
    rows = arrays.withColumn("_cut", _cut("vals", last)).withColumn("_errors", errors).withColumn(
        "_b", F.array_min(ranked)).withColumn("_s", F.get(settings, F.col("_b.candidate")))
    kept = {n: F.col(f"_s.{n}" if n in kinds else f"_b.{n}") for n in MODEL}
    given = {"candidate": -1, **default} if default else {}
    return rows.withColumns({n: F.coalesce(c, F.lit(given[n]).cast(kinds.get(n, "int")))
                             if n in given else c for n, c in kept.items()}).drop(
        "_cut", "_errors", "_b", "_s")


def grid_search(df: DataFrame, candidates: list[dict], last=60, by=BY, ds="ds", value="value",
                remove_bias=True, default: dict | None = None) -> DataFrame:
    """Best candidate per series by squared error on the held-out end.

    A season of at least half the training length is skipped, and so is a
    multiplicative one on values at or below 0 anywhere in the series. The first
    of equal candidates wins. A series without a usable candidate keeps null mse and takes
    the settings of ``default``, if given.
    """
    return with_best(to_arrays(df, by, ds, value), candidates, last, remove_bias, default).select(
        *by, *MODEL)


def best_candidate(df: DataFrame, scored: DataFrame, by=BY, default: dict | None = None) -> DataFrame:
    """Settings with the least ``mse`` for every series of ``df``; the first of equal ones wins."""
    rank = F.when(F.col("mse").isNotNull(), F.struct("mse", "candidate"))
    best = scored.groupBy(*by).agg(F.min_by(
        F.struct("candidate", "alpha", "beta", "gamma", "phi", "m", "kind", "mse"), rank)
        .alias("b"))
    names = ("candidate", "alpha", "beta", "gamma", "phi", "m", "kind", "mse")
    kinds = {f.name: f.dataType for f in best.schema["b"].dataType.fields}
    given = {"candidate": -1, **(default or {})}
    return df.select(*by).distinct().join(best, list(by), "left").select(*by, *[
        F.coalesce(F.col("b")[n], F.lit(given[n]).cast(kinds[n])).alias(n)
        if default and n in given else F.col("b")[n].alias(n) for n in names])


def default_model(variable: str) -> dict:
    """The model of a variable for which no candidate could be scored."""
    return candidate(m=fixed.DEFAULT_SEASON_LENGTH.get(variable, 365), kind="add", phi=0.98)


def season_candidates(variable: str, alphas=(0.2, 0.5), kinds=("add", "mul"), lengths=None):
    """Candidates over the season lengths usual for a variable."""
    return [candidate(m=m, kind=k, alpha=a)
            for m in (lengths or fixed.SEASON_LENGTHS[variable]) for k in kinds for a in alphas]


def fit_best(df: DataFrame, best: DataFrame, by=BY, ds="ds", value="value") -> DataFrame:
    """Refit each series on all its values with its own best settings."""
    return fit(to_arrays(df, by, ds, value).join(best, list(by)))


def expanding_folds(arrays: DataFrame, folds=5) -> DataFrame:
    """Rows ``fold`` with growing ``train`` and the next block as ``test``."""
    n = F.size("vals")
    block = F.floor(n / (folds + 1)).cast("int")
    rows = arrays.withColumn(
        "fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    cut = (n - (folds + 1 - F.col("fold")) * block).cast("int")
    return rows.withColumns({"train": F.slice("vals", F.lit(1), cut),
                             "test": F.slice("vals", cut + 1, block)})


def offset_search(df: DataFrame, settings: dict, offsets: list[float], kind="log", folds=5,
                  root=False, by=BY, ds="ds", value="value") -> DataFrame:
    """Offset c of log(x + c) with the least mean fold error; the first wins a tie.

    ``root`` averages the root of each fold's squared error instead.
    """
    shifted = (lambda x: F.log1p(x + F.col("c"))) if kind == "log1p" else (
        lambda x: F.log(x + F.col("c")))
    rows = expanding_folds(to_arrays(df, by, ds, value), folds).drop("vals", "days")
    rows = dealt(rows, *by, "fold").withColumn(
        "c", F.explode(F.array(*[F.lit(float(c)) for c in offsets])))
    rows = with_candidates(rows, [settings], spread=False)
    rows = rows.withColumns({"train": F.transform("train", shifted),
                             "test": F.transform("test", shifted)})
    error = F.sqrt("mse") if root else F.col("mse")
    scores = score_on(rows).groupBy(*by, "c").agg(F.avg(error).alias("error"))
    return scores.groupBy(*by).agg(F.min_by(F.struct("c", "error"), F.struct("error", "c"))
                                   .alias("b")).select(*by, "b.c", "b.error")
