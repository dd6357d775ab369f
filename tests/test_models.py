"""Small systems, distributions and parameter searches against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raingrid.operators import arima as R
from raingrid.operators import decide as D
from raingrid.operators import fitting as G
from raingrid.operators import forecast as P
from raingrid.operators import hotscan as K
from raingrid.operators import linear as L
from raingrid.operators import longscan as X
from raingrid.operators import smoothing as H
from raingrid.operators import stats as A
from raingrid.operators import trends as T
from raingrid.operators import windows as W

SERIES = "series string, ds date, value double"


def daily(spark, **series):
    import datetime

    day = datetime.date(2020, 1, 1)
    return spark.createDataFrame(
        [(k, day + datetime.timedelta(i), None if x is None else float(x))
         for k, v in series.items() for i, x in enumerate(v)], SERIES)


def one(spark, column, **given):
    rows = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return rows.select(column.alias("x")).first()[0]


def test_solutions_and_residuals_equal_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(40, 6))
    g, b = z.T @ z, z.T @ rng.normal(size=(40, 2))
    got = one(spark, L.solve(F.col("m"), F.lit(6)), m=np.hstack([g, b]).tolist())
    assert np.allclose(got, np.linalg.solve(g, b), atol=1e-9)
    got = one(spark, L.residuals(L.products(F.col("z"))), z=z.T.tolist())
    want = [np.linalg.lstsq(z[:, :k], z[:, 5], rcond=None)[1][0] for k in range(1, 6)]
    assert np.allclose(got, want)


def test_a_dependent_unknown_is_zero(spark):
    z = np.array([[1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0], [1.0, 1.0, 0.0, 0.0]]).T
    y = z @ [3.0, 0.0, 5.0]
    m = np.hstack([z.T @ z, (z.T @ y)[:, None]])
    assert np.allclose([x[0] for x in one(spark, L.solve(F.col("m"), F.lit(3)), m=m.tolist())], [3, 0, 5])


@pytest.mark.parametrize("t, nu, p", [
    (1.0, 5, 0.36321746), (2.570581836, 5, 0.05), (12.7062047, 1, 0.05), (-3.0, 30, 0.00538996),
    (0.0, 4, 1.0), (1.959963985, 10**7, 0.05)])
def test_student_tails(spark, t, nu, p):
    assert one(spark, L.student_tails(F.col("t"), F.col("nu")), t=t, nu=nu) == pytest.approx(p, rel=1e-4)


def test_normal_share(spark):
    for x in (-4.0, -1.0, 0.0, 0.3, 2.5):
        want = 0.5 * (1 + math.erf(x / math.sqrt(2)))
        assert one(spark, L.normal_share(F.col("x")), x=x) == pytest.approx(want, abs=1e-7)


def test_trend_without_spread_has_no_probability(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0, 5), ("b", 2.0, 0.5, 6)],
                                 "series string, slope double, stderr double, n long")
    got = {r.series: r.p_value for r in A.trend_significance(rows).collect()}
    assert got["a"] is None and 0 < got["b"] < 0.05


def test_simplex_finds_the_bottom_and_keeps_to_bounds(spark):
    def bowl(x):
        a, b = F.get(x, F.lit(0)), F.get(x, F.lit(1))
        return (a - F.col("c")) * (a - F.col("c")) + 10.0 * (b - a * a) * (b - a * a)

    found = G.simplex_search(bowl, [[0.2, 0.2], [0.9, 0.1]], [(0.0, 1.0), (0.0, 1.0)])
    for c, want in ((0.6, (0.6, 0.36)), (2.0, (1.0, 1.0)), (-1.0, (0.0, 0.0))):
        got = one(spark, found, c=c)
        assert np.allclose(got["x"], want, atol=2e-3)


def test_fitted_parameters_make_the_error_small(spark):
    rng = np.random.default_rng(4)
    n = 120
    walk = np.cumsum(rng.normal(size=n)) + 50
    wave = 20 + 0.1 * np.arange(n) + 5 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(size=n) / 4
    rows = daily(spark, walk=walk, wave=wave, short=[1.0, 2.0, 3.0])
    models = [G.model(trend=False), G.model("add", 7, damped=True), G.model("mul", 7)]
    got = {(r.series, r.candidate): r for r in G.fitted(rows, models).collect()}
    assert len(got) == 9
    assert got["walk", 0].alpha > 0.8 and got["wave", 1].mse < 0.2
    assert got["short", 1].mse is None and got["short", 1].alpha == H.SETTINGS["alpha"]
    # The error that is reported is that of the model with these parameters.
    best = G.fitted(rows.where("series = 'wave'"), [models[1]])
    fit = H.fit_best(rows, best).first()
    assert fit.fit.sse / fit.fit.n == pytest.approx(best.first().mse)
    found = {r.series: r for r in G.search(rows, models, last=20, default=H.candidate()).collect()}
    assert found["wave"].candidate in (1, 2) and found["short"].candidate == 0


def test_a_batch_of_series_is_searched_as_each_alone():
    from raingrid.operators import batchfit

    rng = np.random.default_rng(5)
    series = [20 + rng.normal(size=n) for n in (60, 14, 33, 60)]
    series[1][:7] = 0.0  # its seasons divide by 0
    plan = (G.model("mul", 7), ["alpha", "beta", "gamma"], [[0.3, 0.1, 0.2], [0.05, 0.2, 0.05]],
            [(0.0, 1.0)] * 3, 1, 80)
    sizes = np.array([len(v) for v in series])
    rows = batchfit.searched(np.concatenate(series), sizes, *plan)
    alone = [batchfit.searched(v, np.array([len(v)]), *plan)[0] for v in series]
    assert np.array_equal(rows, np.array(alone))
    assert rows[1, 4] == batchfit.HOPELESS / 14 and (rows[[0, 2, 3], 4] < 3).all()


def test_searches_run_on_batches(spark):
    """A fold over one series at a time took 0.8 seconds of a core for a series of 800 days."""
    plan = G.fitted(daily(spark, a=[1.0, 2.0, 3.0]), [G.model()])._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan


def test_fit_blocks_equal_a_plain_recursion(spark):
    rng = np.random.default_rng(8)
    v = 30 + rng.normal(size=151)
    c = H.candidate(alpha=0.3, beta=0.1, gamma=0.2, phi=0.9, m=9)
    fit = H.holt_winters(daily(spark, a=v), **c).first().fit
    level, slope = v[:9].mean(), (v[9:18].mean() - v[:9].mean()) / 9
    season, ahead = list(v[:9] - level), []
    for y in v:
        base, due = level + 0.9 * slope, season.pop(0)
        ahead.append(base + due)
        new = 0.3 * (y - due) + 0.7 * base
        level, slope = new, 0.1 * (new - level) + 0.9 * 0.9 * slope
        season.append(0.2 * (y - base) + 0.8 * due)
    assert np.allclose(fit.fitted, ahead) and np.allclose(fit.s, season)
    assert (fit.l, fit.b, fit.n) == (pytest.approx(level), pytest.approx(slope), 151)


def test_augmented_screen_tells_a_walk_from_noise(spark):
    rng = np.random.default_rng(2)
    noise, walk = rng.normal(size=300), np.cumsum(rng.normal(size=300))
    rows = daily(spark, noise=noise, walk=walk, holes=[None, 1.0, None, 2.0])
    got = {(r.series, r["diff"]): r for r in P.augmented_screen(rows, (0, 1), max_lag=4).collect()}
    assert got["noise", 0].stationary and not got["walk", 0].stationary and got["walk", 1].stationary
    assert got["holes", 0].t is None
    k = got["walk", 0].lags
    d = np.diff(walk)
    z = np.column_stack([np.ones(len(d) - k), walk[k:-1], *[d[k - i : len(d) - i] for i in range(1, k + 1)]])
    beta, rss = np.linalg.lstsq(z, d[k:], rcond=None)[:2]
    error = np.sqrt(rss[0] / (len(z) - k - 2) * np.linalg.inv(z.T @ z)[1, 1])
    assert got["walk", 0].t == pytest.approx(beta[1] / error)


def plain_kalman(w, ar, ma):
    """Dense filter: state after the last value, squared errors over variances, logs, count."""
    r = max(len(ar), len(ma) + 1)
    t = np.zeros((r, r))
    t[: len(ar), 0] = ar
    t[np.arange(r - 1), np.arange(1, r)] = 1
    g = np.zeros(r)
    g[: len(ma) + 1] = [1, *ma]
    a, p, s, logs, n, seen = np.zeros(r), np.eye(r) * 1e6, 0.0, 0.0, 0, 0
    for y in w:
        if np.isfinite(y):
            v, f = y - a[0], p[0, 0]
            if seen >= r:
                s, logs, n = s + v * v / f, logs + np.log(f), n + 1
            seen += 1
            a, p = a + p[:, 0] * v / f, p - np.outer(p[:, 0], p[0]) / f
        a, p = t @ a, t @ p @ t.T + np.outer(g, g)
    return a, t, -n / 2 * (np.log(2 * np.pi * s / n) + 1) - logs / 2, n


def test_likelihood_equals_a_dense_filter(spark):
    rng = np.random.default_rng(5)
    v = np.cumsum(rng.normal(size=80)) + 3 * np.sin(np.arange(80) * 2 * np.pi / 4)
    holes = [None if i in (20, 21, 40) else x for i, x in enumerate(v)]
    seasonal, plain = R.order(1, 1, 1, 1, 1, 1, 4), R.order(2, 0, 1)
    got = {(r.series, r.model): r for r in R.arma_loglik(
        daily(spark, a=v, holes=holes, tiny=[1.0, 2.0]),
        [(seasonal, [0.4, 0.3, 0.2, -0.5]), (plain, [0.5, 0.2, 0.3])]).collect()}
    w = np.diff(v)[4:] - np.diff(v)[:-4]
    ar, ma = [0.4, 0, 0, 0.2, -0.08], [0.3, 0, 0, -0.5, -0.15]
    for name, series in (("a", v), ("holes", np.array(holes, float))):
        diff = np.diff(series)[4:] - np.diff(series)[:-4]
        for model, (x, a, m) in enumerate(((diff, ar, ma), (series, [0.5, 0.2], [0.3]))):
            _, _, want, n = plain_kalman(x, a, m)
            assert got[name, model].n == n and got[name, model].loglik == pytest.approx(want, abs=1e-6)
    assert got["tiny", 0].loglik is None
    a, t, *_ = plain_kalman(w, ar, ma)
    path, back = [], list(v)
    for _ in range(9):
        path.append(a[0] + back[-1] + back[-4] - back[-5])
        back.append(path[-1])
        a = t @ a
    ahead = R.arma_forecast(daily(spark, a=v), seasonal, [0.4, 0.3, 0.2, -0.5], 9).orderBy("h").collect()
    assert np.allclose([r.yhat for r in ahead], path)


def test_fitted_orders(spark):
    rng = np.random.default_rng(6)
    e = rng.normal(size=260)
    v = np.zeros(260)
    for i in range(1, 260):
        v[i] = 0.7 * v[i - 1] + e[i]
    rows = R.arma_fit(daily(spark, a=v, tiny=[1.0]), [R.order(), R.order(1), R.order(0, 0, 1)]).collect()
    got = {(r.series, r.model): r for r in rows}
    assert got["a", 1].best and not got["a", 0].best and got["a", 1].x[0] == pytest.approx(0.7, abs=0.1)
    assert got["tiny", 1].aic is None and not any(got["tiny", m].best for m in range(3))
    with pytest.raises(ValueError):
        R.order(P=2, s=12)


def test_penalised_trend_solves_its_equations(spark):
    rng = np.random.default_rng(7)
    v = np.cumsum(rng.normal(size=150))
    holes = [None if 30 <= i < 40 else x for i, x in enumerate(v)]
    rows = T.hp_trend(daily(spark, a=v, holes=holes, two=[1.0, 5.0], one=[None, None, 3.0]), 1600.0)
    got = {}
    for r in rows.orderBy("ds").collect():
        got.setdefault(r.series, []).append(r.trend)
    d = np.diff(np.eye(150), 2, axis=0)
    for name, x in (("a", v), ("holes", np.array(holes, float))):
        known = np.isfinite(x)
        want = np.linalg.solve(np.diag(known * 1.0) + 1600 * d.T @ d, np.where(known, x, 0))
        assert np.allclose(got[name], want, atol=1e-6)
    assert got["two"] == [1.0, 5.0] and got["one"] == [None] * 3


def test_spikes_do_not_move_robust_parts(spark):
    i = np.arange(140)
    clean = 20 + 0.05 * i + 4 * np.sin(i * 2 * np.pi / 7) + np.random.default_rng(3).normal(size=140) / 2
    spiked = clean.copy()
    spiked[[33, 70, 101]] += 60
    rows = daily(spark, clean=clean, spiked=spiked, short=[1.0] * 13, holes=[1.0, None] * 10)
    plain = {(r.series, r.ds): r for r in T.stl(rows).collect()}
    robust = {(r.series, r.ds): r for r in T.stl(rows, outer=3).collect()}
    assert all(robust[k].trend is None for k in robust if k[0] in ("short", "holes"))

    def away(parts, name):
        return np.mean([abs(parts["spiked", d].trend - parts["clean", d].trend)
                        + abs(parts["spiked", d].seasonal - parts["clean", d].seasonal)
                        for s, d in parts if s == name])

    assert away(robust, "spiked") < 0.4 and away(plain, "spiked") > 3
    days = sorted(d for s, d in robust if s == "spiked")
    weights = [robust["spiked", d].weight for d in days]
    assert max(weights[i] for i in (33, 70, 101)) == 0 and sum(w < 0.01 for w in weights) < 10
    assert all(abs(r.trend + r.seasonal + r.resid - r.value) < 1e-9 for r in robust.values() if r.trend is not None)


@pytest.mark.parametrize("days", [1, 7, 64, 5000])
def test_blocks_equal_the_whole_series(spark, days):
    rng = np.random.default_rng(9)
    v = np.cumsum(rng.normal(size=150)) + 40
    holes = [None if i % 7 == 3 or i < 2 else x for i, x in enumerate(v)]
    rows = daily(spark, a=v, b=v[::-1][:60], one=[3.0])

    def values(df, name):
        return {(r.series, r.ds): r[name] for r in df.collect()}

    for whole, parts in ((H.ses(rows, 0.3), X.ses_long(rows, 0.3, days)),
                         (H.holt(rows, 0.3, 0.1), X.holt_long(rows, 0.3, 0.1, days))):
        want, got = values(H.fitted_rows(whole), "fitted"), values(parts, "fitted")
        assert all(got[k] == pytest.approx(x) for k, x in want.items() if k[0] != "one")
    rows = daily(spark, a=v, holes=holes)
    want, got = values(W.ewma(rows, 9), "ewma"), values(X.ewma_long(rows, 9, days), "ewma")
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (x is None) and (x is None or got[k] == pytest.approx(x))
               for k, x in want.items())


def test_plantings_one_by_one_equal_all_at_once(spark):
    import datetime as dt

    rng = np.random.default_rng(11)
    days = [dt.date(2021, 1, 1) + dt.timedelta(i) for i in range(300)]
    rows = spark.createDataFrame(
        [(s, d, float(rng.uniform(0, 14)), float(rng.uniform(50, 99)), "x") for s in "ab" for d in days],
        "series string, ds date, rr double, rh double, decision string")
    planted = {"a": [dt.date(2021, 1, 5), dt.date(2021, 6, 1), dt.date(2021, 12, 1)], "b": [dt.date(2021, 3, 30)]}
    frame = spark.createDataFrame([(s, d) for s, ds in planted.items() for d in ds] + [("a", planted["a"][0]), ("b", None)],
                                  "series string, planted date")
    want, watched = {}, set()
    for s, dates in planted.items():
        own = rows.where(F.col("series") == s)
        for d in dates:
            watched |= {(r.series, d, r.ds, r.recommendation) for r in D.harvest_window(own, d).collect()}
            own = D.harvest_override(own, d)
        want |= {(r.series, r.ds): r.decision for r in own.collect()}
    got = {(r.series, r.ds): r.decision for r in D.harvest_overrides(rows, frame).collect()}
    assert got == want
    assert {(r.series, r.planted, r.ds, r.recommendation)
            for r in D.harvest_windows(rows, frame).collect()} == watched


@pytest.mark.parametrize("width", [1.0, 10.0, 1000.0])
def test_fills_of_hot_series_equal_plain_ones(spark, width):
    import random

    rng = random.Random(5)
    rows = [(s, i, float(rng.randrange(120)) - 20, None if rng.random() < 0.8 else float(rng.randrange(50)))
            for s, n in (("hot", 300), ("few", 4), ("one", 1)) for i in range(n)] + [("none", 0, 1.0, None)]
    df = spark.createDataFrame(rows, "series string, id int, x double, value double")
    want = {}
    for s in {r[0] for r in rows}:
        own = sorted((x, i, v) for t, i, x, v in rows if t == s)
        for at, (x, i, v) in enumerate(own):
            p = next((o for o in reversed(own[: at + 1]) if o[2] is not None), None)
            n = next((o for o in own[at:] if o[2] is not None), None)
            near = None
            if p and (not n or x - p[0] <= n[0] - x):
                near = p[2] if x - p[0] < 5 else None
            elif n:
                near = n[2] if n[0] - x < 5 else None
            line = None
            if p and n:
                line = p[2] + (n[2] - p[2]) * ((x - p[0]) / (n[0] - p[0]) if n[0] > p[0] else 0)
            elif p or n:
                line = (p or n)[2]
            want[s, i] = (p and p[2], near if v is None else v, line if v is None else v)
    args = (df, F.col("x"), width)
    parts = [K.ffill_long(*args, ties=("id",)), K.nearest_within_long(*args, 5.0, ties=("id",)),
             K.interpolate_long(*args, ties=("id",), both=True)]
    for k, part in enumerate(parts):
        got = {(r.series, r.id): r.filled for r in part.collect()}
        assert got == {key: pytest.approx(w[k]) if w[k] is not None else None for key, w in want.items()}


def test_one_band_equals_that_of_several(spark):
    fits = H.ses(daily(spark, a=[3.0, 5.0, 4.0, 8.0, 1.0, 9.0]), 0.4)
    ahead, past = H.forecast(fits, 2), H.fitted_rows(fits)
    one = P.interval(ahead, past, skip=2, floor=3.0).orderBy("h").collect()
    both = P.intervals(ahead, past, {"a": {"skip": 2, "floor": 3.0}, "b": {"last": 3}}).orderBy("h").collect()
    assert [(r.lo, r.hi) for r in one] == [(r.lo_a, r.hi_a) for r in both]
    miss = [r.value - r.fitted for r in past.orderBy("ds").collect()]
    assert both[0].hi_b - both[0].yhat == pytest.approx(1.96 * np.sqrt(np.mean(np.square(miss[-3:]))))
    assert one[0].hi - one[0].yhat == pytest.approx(1.96 * np.sqrt(np.mean(np.square(miss[2:])))) and one[0].lo >= 3


def test_a_grid_is_searched_where_the_series_is(spark, capsys):
    rows = daily(spark, a=[float(i % 5) for i in range(40)])
    H.with_best(H.to_arrays(rows), H.season_candidates("RR", lengths=(5, 7))).explain()
    H.fit(H.with_best(H.to_arrays(rows), H.season_candidates("RR", lengths=(5, 7)))).explain()
    for plan in capsys.readouterr().out.split("== Physical Plan ==")[1:]:
        assert plan.count("Exchange") == 1 and "ArrowEvalPython" in plan and "Join" not in plan
    H.grid_search(rows, H.season_candidates("RR", lengths=(5, 7))).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_rows_of_one_batch_are_fitted_as_each_alone(spark):
    rng = np.random.default_rng(4)
    given = {"a": rng.uniform(1, 9, 40), "b": rng.uniform(1, 9, 23), "short": [4.0, 5.0, 6.0],
             "hole": [3.0, None, 5.0, 4.0] * 6, "zero": [0.0, 2.0, 1.0, 3.0] * 5, "one": [7.0]}
    models = [H.candidate(m=4, kind=k, phi=f) for k in ("add", "mul") for f in (1.0, 0.9)] + [
        H.candidate(m=5, alpha=0.4), H.candidate(kind="none")]
    fits = H.fit(H.with_candidates(H.to_arrays(daily(spark, **given)), models), keep_fitted=True)
    got = {(r.series, r.candidate): r.fit for r in fits.collect()}
    assert len(got) == len(given) * len(models)
    for (name, i), fit in got.items():
        v, c = list(given[name]), models[i]
        m, mul = c["m"], c["kind"] == "mul"
        if len(v) < max(2 * m, 2) or mul and min(x for x in v if x is not None) <= 0:
            assert fit is None
            continue
        if name == "hole":
            assert fit.l is None and fit.sse is None and fit.n == len(v)
            continue
        level, slope, season = v[0], v[1] - v[0], []
        if m:
            level = sum(v[:m]) / m
            slope = (sum(v[m:2 * m]) / m - level) / m
            season = [x / level if mul else x - level for x in v[:m]]
        ahead = []
        for y in v:
            base, before = level + c["phi"] * slope, level
            due = season.pop(0) if m else 0.0
            ahead.append(base * due if mul else base + due)
            level = c["alpha"] * (y / due if mul else y - due) + (1 - c["alpha"]) * base
            if m:
                season.append(c["gamma"] * (y / base if mul else y - base) + (1 - c["gamma"]) * due)
            slope = c["beta"] * (level - before) + (1 - c["beta"]) * c["phi"] * slope
        miss = np.array(v) - ahead
        assert (fit.l, fit.b, fit.s, fit.fitted, fit.n) == (
            pytest.approx(level), pytest.approx(slope), pytest.approx(season), pytest.approx(ahead), len(v))
        assert (fit.sse, fit.sr) == (pytest.approx(miss @ miss), pytest.approx(miss.sum()))


def test_a_batch_may_be_held_in_parts(monkeypatch):
    from raingrid.operators import batchfit

    rng = np.random.default_rng(5)
    sizes = np.array([30, 12, 50, 12])
    flat, begins = rng.uniform(1, 9, sizes.sum()), np.cumsum(sizes) - sizes
    p = {k: np.full(4, v) for k, v in (("alpha", 0.2), ("beta", 0.05), ("gamma", 0.1), ("phi", 0.9))}
    whole = batchfit.fits(flat, begins, sizes, p, "add", 5, keep=True)
    monkeypatch.setattr(batchfit, "MOST_CELLS", 60)
    parts = batchfit.fits(flat, begins, sizes, p, "add", 5, keep=True)
    assert all((whole[k] == parts[k]).all() for k in whole)


def test_columns_interpolated_together_equal_each_alone(spark, capsys):
    rows = daily(spark, a=[None, 1.0, None, None, 7.0, None], b=[None] * 3, c=[2.0, None, 5.5])
    rows = rows.withColumn("twin", F.when(F.dayofmonth("ds") % 2 == 0, F.col("value") * 3))
    want = rows
    for c in ("value", "twin"):
        want = W.interpolate(want, "time", direction="both", value=c, out=f"_{c}")
    back = W.interpolate(rows, "time", direction="both", out="_value", back_first=True)
    together = W.interpolate_all(rows, {"value": "_value", "twin": "_twin"})
    together.explain()
    assert capsys.readouterr().out.count("Sort [") == 2
    assert sorted(map(str, together.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, back.collect())) == sorted(map(str, want.drop("_twin").collect()))


def test_temperatures_share_sorts(spark, capsys):
    from raingrid.operators import impute as I

    rows = daily(spark, a=[1.0, None, 3.0]).withColumns(
        {c: F.col("value") + k for k, c in enumerate(("tn", "tavg", "tx"))}).drop("value")
    I.temperature_relation_fill(rows).explain()
    assert capsys.readouterr().out.count("Sort [") == 4
