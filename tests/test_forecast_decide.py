"""Smoothing, forecasts and decisions against plain loops and known rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raingrid.operators import decide, forecast, patterns, smoothing, windows
from test_series import DAY, N, column, series

VALUES = [20 + 5 * math.sin(i) + (i * 7) % 5 for i in range(40)]


def loop(values, a, b, g, phi, m, kind, horizon):
    level = sum(values[:m]) / m
    trend = (sum(values[m:2 * m]) / m - level) / m
    season = [v / level if kind == "mul" else v - level for v in values[:m]]
    for y in values:
        base, s = level + phi * trend, season.pop(0)
        new = a * (y / s if kind == "mul" else y - s) + (1 - a) * base
        season.append(g * (y / base if kind == "mul" else y - base) + (1 - g) * s)
        trend = b * (new - level) + (1 - b) * phi * trend
        level = new
    out = []
    for h in range(1, horizon + 1):
        run = level + sum(phi ** k for k in range(1, h + 1)) * trend
        s = season[(h - 1) % m]
        out.append(run * s if kind == "mul" else run + s)
    return out


@pytest.mark.parametrize("kind, phi", [("add", 1.0), ("add", 0.9), ("mul", 0.98)])
def test_holt_winters_matches_loop(spark, kind, phi):
    c = smoothing.candidate(alpha=0.4, beta=0.1, gamma=0.3, phi=phi, m=6, kind=kind)
    rows = smoothing.forecast(smoothing.holt_winters(series(spark, VALUES), **c), 15)
    assert [r["yhat"] for r in rows.orderBy("h").collect()] == pytest.approx(
        loop(VALUES, 0.4, 0.1, 0.3, phi, 6, kind, 15))


def test_unusable_series_have_null_forecasts(spark):
    short = smoothing.forecast(smoothing.holt_winters(series(spark, VALUES[:9]), m=7), 3)
    zero = smoothing.forecast(
        smoothing.holt_winters(series(spark, [0.0] + VALUES), m=7, kind="mul"), 3)
    for rows in (short, zero):
        assert [r["yhat"] for r in rows.collect()] == [N] * 3
    naive = forecast.seasonal_naive(series(spark, VALUES[:9]), 3)
    best = forecast.fallback_chain(short, naive)
    assert {(round(r["yhat"], 6), r["source"]) for r in best.collect()} == {
        (round(sum(VALUES[:9]) / 9, 6), 1)}


def test_grid_search_picks_the_least_error(spark):
    options = smoothing.season_candidates("RR", alphas=(0.1, 0.5), lengths=(5, 6, 30))
    rows = series(spark, VALUES)
    best = smoothing.grid_search(rows, options).first()
    cut = int(len(VALUES) * 0.8)
    errors = {}
    for i, c in enumerate(options):
        if c["m"] >= cut / 2:
            continue
        fits = smoothing.fit(smoothing.with_candidates(
            smoothing.to_arrays(series(spark, VALUES[:cut])), [c]))
        guess = [r["yhat"] for r in smoothing.forecast(fits, 8, remove_bias=True).orderBy("h").collect()]
        errors[i] = np.mean((np.array(VALUES[cut:]) - guess) ** 2)
    assert best["candidate"] == min(errors, key=errors.get)
    assert best["mse"] == pytest.approx(min(errors.values()))


def test_decompose_adds_up(spark):
    rows = forecast.decompose(series(spark, VALUES), 7).collect()
    inner = [r for r in rows if r["trend"] is not None]
    assert len(inner) == len(VALUES) - 6
    assert all(r["trend"] + r["seasonal"] + r["resid"] == pytest.approx(r["value"]) for r in inner)
    assert sum({round(r["seasonal"], 9) for r in rows}) == pytest.approx(0, abs=1e-6)


def test_seasonal_fill_keeps_known(spark):
    values = [v if i % 9 else N for i, v in enumerate(VALUES)]
    out = column(forecast.seasonal_trend_fill(series(spark, values), 7), "filled")
    assert all(o is not None for o in out)
    assert all(o == v for o, v in zip(out, values) if v is not None)


def test_lag_regression_follows_a_cycle(spark):
    values = [10 + 3 * math.sin(2 * math.pi * i / 8) for i in range(400)]
    rows = forecast.lag_regression(series(spark, values), 10, 16).orderBy("h").collect()
    want = [10 + 3 * math.sin(2 * math.pi * i / 8) for i in range(400, 416)]
    assert np.abs(np.array([r["yhat"] for r in rows]) - want).max() < 0.5
    assert 2 <= rows[0]["p"] <= 10


def test_fourier_regression_recovers_waves(spark):
    days = range(900)
    y = [math.expm1(1.5 + 0.3 * math.sin(2 * math.pi * t / 365.25) + 0.1 * math.cos(2 * math.pi * t / 7))
         for t in days]
    out = forecast.fourier_regression(series(spark, y[:800]), 100, ridge=1e-9)
    got = [r["yhat"] for r in out.orderBy("ds").collect()]
    assert np.allclose(got, y, rtol=1e-3)


def test_metrics_skip_nulls_and_zero(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0), ("a", N, 5.0)],
                                 "series string, actual double, forecast double")
    m = forecast.metrics(rows).first()
    assert (m["n"], m["mae"], m["mse"], m["mape"], m["r2"]) == (2, 1.0, 1.0, 50.0, 0.0)


def test_rain_flag_round_trip(spark):
    rows = spark.createDataFrame(
        [("a", DAY + dt.timedelta(days=i), 10.0, i % 2) for i in range(6)],
        "series string, ds date, rr double, rain_missing int")
    coded = forecast.encode_rain_flag(rows).select("series", "ds", F.col("rr_adjusted").alias("yhat"))
    back = forecast.decode_rain_flag(coded, rows).orderBy("ds").collect()
    assert [r["rr"] for r in back] == pytest.approx([10.0] * 6)
    assert [r["rain_missing"] for r in back] == [0, 1] * 3


def weather(spark, rows):
    return spark.createDataFrame(
        [("a", *r) for r in rows],
        "series string, ds date, rr double, tavg double, rh double, rain_missing int")


def test_monthly_rules(spark):
    d = dt.date
    rows = weather(spark, [
        (d(2025, 1, 5), 20.0, 27.0, 80.0, 0), (d(2025, 7, 5), 1.0, 27.0, 80.0, 0),
        (d(2025, 8, 5), 5.0, 27.0, 80.0, 0), (d(2025, 4, 5), 5.0, 27.0, 95.0, 0),
        (d(2025, 9, 5), 5.0, 27.0, 80.0, 1), (d(2025, 5, 5), 5.0, 36.0, 80.0, 0),
        (d(2025, 5, 6), N, 27.0, 80.0, 0)])
    out = decide.advise(rows).orderBy("ds").collect()
    assert [(r["score"], r["decision"]) for r in out] == [
        (45, "Bera (Risiko Banjir)"), (80, "Tanam (Periode Transisi Optimal)"),
        (60, "Bera (Risiko Suhu Tinggi)"), (0, "Bera (Data Tidak Lengkap)"),
        (45, "Bera (Musim Kering Risiko Tinggi)"), (100, "Tanam (Kondisi Kering Optimal)"),
        (35, "Bera (Data Hujan Tidak Tersedia di Musim Kering)")]


def test_harvest_override_only_when_due(spark):
    start = dt.date(2025, 4, 15)
    rows = decide.advise(weather(spark, [
        (start + dt.timedelta(days=i), 12.0 if i == 8 else 5.0, 27.0, 80.0, 0) for i in range(15)]))
    changed = decide.harvest_override(rows, dt.date(2025, 1, 11))
    days = [r["ds"] for r in changed.orderBy("ds").collect() if "Panen" in r["decision"]]
    assert days == [dt.date(2025, 4, 20) + dt.timedelta(days=i) for i in range(7)]
    early = decide.harvest_override(rows, dt.date(2025, 3, 11))
    assert not [r for r in early.collect() if "Panen" in r["decision"]]


def test_planting_calendar(spark):
    fit = [1, 0, 1, 1, 0, 1, 1, 0]
    rows = spark.createDataFrame(
        [("a", dt.date(2025, i + 1, 1), 0.8 if f else 0.2) for i, f in enumerate(fit)],
        "series string, period date, suitability double")
    text = decide.decision_string(decide.planting_calendar(rows)).first()["decisions"]
    assert text == "Tanam;Panen;Tanam;Tanam;Panen;Tidak Sesuai;Tidak Sesuai;Bera"


def test_pattern_fill_uses_cluster_medians(spark):
    low = [(f"s{i % 3}", DAY + dt.timedelta(days=i), 20.0 + i % 2, 60.0, 2.0 if i % 5 else N) for i in range(40)]
    high = [(f"s{i % 3}", DAY + dt.timedelta(days=i), 33.0 + i % 2, 95.0, 9.0 if i % 5 else N)
            for i in range(40, 80)]
    rows = spark.createDataFrame(low + high, "series string, ds date, tavg double, rh double, wind double")
    out = patterns.pattern_median_fill(rows, ["tavg", "rh"], "wind", sizes=(2,)).collect()
    assert {(r["tavg"] > 30, r["filled"]) for r in out} == {(False, 2.0), (True, 9.0)}


def test_rain_fill_draws_known_values_and_repeats(spark):
    rows = [("a", DAY + dt.timedelta(days=i), (N if i % 7 == 0 else (0.0 if i % 2 else 5.0 + i % 9)),
             25.0 + (0 if i % 2 else 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "series string, ds date, rr double, tavg double")
    one = column(patterns.rain_occurrence_fill(df, ["tavg"], trees=10), "filled")
    two = column(patterns.rain_occurrence_fill(df, ["tavg"], trees=10), "filled")
    known = {r[2] for r in rows}
    assert one == two and set(one) <= known
    assert [v == 0.0 for v in one[::7]] == [bool(i % 2) for i in range(0, 300, 7)]
    short = patterns.rain_occurrence_fill(df.limit(20), ["tavg"])
    assert short.where(F.col("filled").isNull()).count() == 0


def test_acf_of_a_cycle(spark):
    values = [math.sin(2 * math.pi * i / 10) for i in range(200)]
    out = {r["lag"]: r["acf"] for r in windows.acf(series(spark, values), 10).collect()}
    assert out[0] == pytest.approx(1) and out[5] < -0.9 and out[10] > 0.9


def test_differences_of_any_order_continue_a_polynomial(spark):
    rows = series(spark, [float(i * i) for i in range(60)])
    out = [r["yhat"] for r in forecast.lag_regression(rows, 2, 3, d=2).orderBy("h").collect()]
    assert out == pytest.approx([3600.0, 3721.0, 3844.0], rel=1e-6)
    with pytest.raises(ValueError):
        forecast.lag_regression(rows, 2, 3, d=-1)


def test_short_series_keep_a_row(spark):
    short = series(spark, [1.0, 2.0])
    assert forecast.stationarity_screen(short, lags=(0, 1)).where("t IS NULL").count() == 2
    best = smoothing.grid_search(short, smoothing.season_candidates("RR"),
                                 default=smoothing.default_model("RR")).first()
    assert (best["m"], best["kind"], best["mse"]) == (365, "add", None)
    assert smoothing.grid_search(short, smoothing.season_candidates("RR")).first()["m"] is None
    assert smoothing.default_model("TAVG")["m"] == 30


def test_rain_fill_decides_for_each_series(spark):
    from raingrid.operators import patterns

    start, rows = dt.date(2020, 1, 1), []
    for name, days in (("long", 240), ("short", 40)):
        for i in range(days):
            wet = i % 3 == 0
            rr = None if i % 10 == 7 else (5.0 + i % 7 if wet else 0.0)
            rows.append((name, start + dt.timedelta(days=i), rr, 30.0 - 8 * wet, 60.0 + 30 * wet))
    df = spark.createDataFrame(rows, "series string, ds date, rr double, tavg double, rh double")
    out = patterns.rain_occurrence_fill(df, ["tavg", "rh"], trees=10)
    assert out.count() == len(rows) and out.where("filled IS NULL").count() == 0
    assert out.where("rr IS NOT NULL AND rr <> filled").count() == 0
    wet = {r[2] for r in rows if r[0] == "long" and r[2]}
    for r in out.where("rr IS NULL").collect():
        if r["series"] == "long":  # dry days are 0, wet days are values of known wet days
            assert r["filled"] == 0 if r["tavg"] == 30.0 else r["filled"] in wet


@pytest.mark.parametrize("name", ["planting_advice", "cardinal_clean", "humidity_from_dewpoint",
                                  "rain_flag_encoding", "harvest_override", "regression_fill"])
def test_plans_have_no_nested_loop_and_no_single_partition_window(spark, name):
    from raingrid.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "Exchange SinglePartition" not in plan


# Three kept days of advice (rain, temperature, humidity, rain flag) and results.
KEPT = [(5.0, 26.0, 80.0, 0, 100, "Optimal / Optimal / Optimal"),
        (20.0, 26.0, 80.0, 0, 60, "Banjir (Risiko) / Optimal / Optimal"),
        (1.0, 26.0, 95.0, 0, 40, "Kering (Risiko) / Optimal / Lembab Ekstrem (Risiko)")]


def test_kept_days_of_advice(spark):
    day = dt.date(2024, 5, 1)
    df = spark.createDataFrame(
        [("a", day + dt.timedelta(days=i), *k[:4]) for i, k in enumerate(KEPT)],
        "series string, ds date, rr double, tavg double, rh double, rain_missing int")
    out = decide.advise(df).orderBy("ds").collect()
    assert [r["category"] for r in out] == [k[5] for k in KEPT]
    assert [r["score"] for r in out] == [k[4] for k in KEPT]
