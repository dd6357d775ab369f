"""Grid, fills, windows and statistics on small hand-made series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raingrid.operators import align, impute, quality, stats, transform, windows
from raingrid.operators.quantiles import exact_quantiles

DAY = dt.date(2024, 1, 1)


def series(spark, values, name="a", step=1):
    rows = [(name, DAY + dt.timedelta(days=i * step), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, ds date, value double")


def column(df, name):
    return [r[name] for r in df.orderBy("series", "ds").collect()]


N = None


@pytest.mark.parametrize("options, expected", [
    ({}, [N, 1, 2, 3, 4, 4, 4]),
    ({"limit": 1}, [N, 1, 2, N, 4, 4, N]),
    ({"direction": "both"}, [1, 1, 2, 3, 4, 4, 4]),
    ({"direction": "both", "limit": 1}, [1, 1, 2, 3, 4, 4, N]),
])
def test_interpolate(spark, options, expected):
    rows = series(spark, [N, 1.0, N, N, 4.0, N, N])
    assert column(windows.interpolate(rows, **options), "filled") == pytest.approx(expected)


def test_interpolate_by_time_uses_distance(spark):
    rows = spark.createDataFrame(
        [("a", DAY, 0.0), ("a", DAY + dt.timedelta(days=1), N), ("a", DAY + dt.timedelta(days=4), 8.0)],
        "series string, ds date, value double")
    assert column(windows.interpolate(rows, "time"), "filled") == [0.0, 2.0, 8.0]
    assert column(windows.interpolate(rows), "filled") == [0.0, 4.0, 8.0]


def test_all_null_and_single_row(spark):
    assert column(windows.interpolate(series(spark, [N, N]), direction="both"), "filled") == [N, N]
    assert column(windows.fill_both(series(spark, [3.0])), "filled") == [3.0]
    assert column(windows.gap_routed_fill(series(spark, [N, 3.0, N])), "filled") == [3.0] * 3


def test_cubic_gap_is_exact_on_a_cubic(spark):
    known = [float(x ** 3) for x in range(12)]
    values = [v if i < 3 or i > 7 else N for i, v in enumerate(known)]
    assert column(windows.gap_routed_fill(series(spark, values)), "filled") == pytest.approx(known)
    held = windows.gap_routed_fill(series(spark, values), (None, 100.0))
    assert max(column(held, "filled")) == 100.0


def test_grid_fills_every_day_once(spark):
    rows = spark.createDataFrame(
        [("a", DAY, 1.0), ("a", DAY + dt.timedelta(days=5), 2.0), ("b", DAY, 3.0)],
        "series string, ds date, value double")
    grid = align.complete_grid(rows)
    assert column(grid, "value") == [1.0, N, N, N, N, 2.0, 3.0]
    assert grid.select("series", "ds").distinct().count() == grid.count()


def test_grid_folds_rows_of_one_day(spark):
    day = lambda i: DAY + dt.timedelta(days=i)
    rows = spark.createDataFrame(
        [("a", day(0), 1.0), ("a", day(0), 4.0), ("a", day(3), N), ("a", day(3), N), ("b", day(1), N),
         ("c", day(2), 5.0), ("c", day(2), 5.0)], "series string, ds date, value double")
    got = [(r["series"], r["ds"], r["value"]) for r in
           align.complete_grid(rows).orderBy("series", "ds").collect()]
    assert got == [("a", day(0), 4.0), ("a", day(1), N), ("a", day(2), N), ("a", day(3), N),
                   ("b", day(1), N), ("c", day(2), 5.0)]


def test_trend_numbers_the_years_with_data(spark):
    rows = spark.createDataFrame(
        [("a", dt.date(y, 1, 1) + dt.timedelta(days=i), None if y == 2002 else float(v))
         for y, v in ((2000, 1), (2001, 2), (2002, 0), (2003, 3)) for i in range(100)],
        "series string, ds date, value double")
    row = stats.linear_trend(rows).first()
    assert (row["slope"], row["intercept"], row["n"]) == (pytest.approx(1.0), pytest.approx(1.0), 3)
    assert stats.linear_trend(rows, on_year=True).first()["slope"] < 0.7
    assert stats.linear_trend(rows, min_days=401).count() == 0
    assert stats.linear_trend(rows, min_days=400).count() == 1
    assert stats.linear_trend(rows, min_years=4).count() == 0


def test_nearest_first_direction_needs_a_speed(spark):
    rows = spark.createDataFrame(
        [("a", DAY, 90.0, 1.0), ("a", DAY + dt.timedelta(days=1), N, 2.0),
         ("a", DAY + dt.timedelta(days=2), N, N), ("a", DAY + dt.timedelta(days=5), 180.0, 1.0)],
        "series string, ds date, direction double, speed double")
    out = column(impute.wind_direction_fill(rows, nearest_first=True, speed="speed"), "filled")
    assert out == pytest.approx([90.0, 90.0, 135.0, 180.0])


def test_regression_fill_with_many_groups(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(g, float(i), N if i == 3 else 2.0 * i + g, i) for g in range(5) for i in range(20)],
        "series int, x double, y double, i int")
    fits = impute.regression_fits(rows, F.col("i") % 4 != 1)
    want = [(g, 6.0 + g) for g in range(5)]
    for most in (10, 2):  # fits sent to all tasks, and joined by group and salt
        monkeypatch.setattr(impute, "MOST_FITS", most)
        out = impute.regression_fill(rows, fits)
        assert out.columns == [*rows.columns, "filled"] and out.count() == 100
        assert sorted((r["series"], round(r["filled"], 6)) for r in out.where("i = 3").collect()) == want


def test_grid_with_ranges_cuts_and_extends(spark):
    ranges = spark.createDataFrame([("a", DAY, DAY + dt.timedelta(days=3))],
                                   "series string, start date, end date")
    rows = series(spark, [N, 5.0], step=1).unionByName(series(spark, [9.0], "z"))
    assert column(align.complete_grid(rows, ranges=ranges), "value") == [N, 5.0, N, N]


def test_nearest_prefers_earlier_and_is_strict(spark):
    rows = series(spark, [1.0, N, 2.0] + [N] * 7)
    filled = column(align.nearest_within(rows), "filled")
    assert filled == [1.0, 1.0] + [2.0] * 7 + [N]


def test_location_cutoffs_drop_unknown(spark):
    rows = series(spark, [1.0, 2.0, 3.0]).unionByName(series(spark, [9.0], "z"))
    kept = align.location_cutoffs(rows, {"a": ("2024-01-02", "2024-01-03")})
    assert column(kept, "value") == [2.0, 3.0]


def test_gaps(spark):
    rows = windows.gaps(series(spark, [N, 1.0, N, N, 2.0, N])).orderBy("gap_start").collect()
    assert [r["gap_length"] for r in rows] == [1, 2, 1]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-50, 50)), min_size=1, max_size=25))
def test_fill_invariants(spark, values):
    rows = series(spark, values)
    s = pd.Series(values, dtype=float)
    full = column(windows.fill_both(rows), "filled")
    wanted = s.ffill().bfill()
    assert [x is None for x in full] == list(wanted.isna())
    line = column(windows.interpolate(rows, direction="both"), "filled")
    assert all(a == b for a, b in zip(values, line) if a is not None)
    both = s.interpolate(limit_direction="both")
    assert np.allclose([np.nan if x is None else x for x in line], both, equal_nan=True)
    short = column(windows.interpolate(rows, limit=2), "filled")
    assert np.allclose([np.nan if x is None else x for x in short],
                       s.interpolate(limit=2), equal_nan=True)


def test_rolling_and_ewma_match_pandas(spark):
    values = [float((i * 37) % 11) for i in range(40)]
    values[5] = values[17] = N
    s, rows = pd.Series(values, dtype=float), series(spark, values)
    for n, center, least in ((5, False, None), (5, True, 1), (6, True, 3)):
        got = column(windows.sma(rows, n, center, least), "sma")
        want = s.rolling(n, center=center, min_periods=least).mean()
        assert np.allclose([np.nan if x is None else x for x in got], want, equal_nan=True)
    got = column(windows.ewma(rows, 10), "ewma")
    assert np.allclose(got, s.ewm(span=10).mean())


def test_quantiles_by_repeated_narrowing(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    groups = {"hot": [rng.randrange(-5000, 5000) / 8 for _ in range(4000)], "flat": [2.5] * 50,
              "few": [3.0, -1.0, 2.0], "one": [7.0], "none": [None]}
    groups["hot"] += [0.125] * 3000 + [None] * 10
    rows = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v],
                                 "series string, value double").repartition(5)
    probs = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    for most, cuts in ((20, 4), (1, 2), (10**6, 256)):
        got = {r.series: r.quantiles for r in exact_quantiles(rows, probs, most=most, cuts=cuts).collect()}
        assert got.keys() == groups.keys() - {"none"}
        for k, q in got.items():
            known = [x for x in groups[k] if x is not None]
            assert np.allclose(q, np.quantile(known, probs)), (k, most)


def test_exact_quantiles_on_a_hot_group(spark):
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.full(4000, 7.0), rng.normal(0, 50, 3000).round(1)])
    frames = {"hot": hot, "cold": rng.normal(0, 1, 11), "one": np.array([5.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in frames.items() for v in vs],
                                 "series string, value double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["series"]: r["quantiles"] for r in exact_quantiles(rows, probs).collect()}
    for name, vs in frames.items():
        assert np.allclose(got[name], np.quantile(vs, probs)), name


def test_value_codes(spark):
    tokens = ["25.3_2_5", "25.3 1 8", "12", "C", "1_2_C", "-9.99", "-12.5", "x", " ", N, "3_x_1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, token string")
    out = quality.parse_value_codes(rows).orderBy("i").collect()
    assert [r["value"] for r in out] == [25.3, 25.3, 12.0] + [N] * 8
    assert [(r["q"], r["s"]) for r in out[:3]] == [(2, 5), (1, 8), (2, 1)]
    assert [r["valid"] for r in out] == [True] * 3 + [False] * 8
    assert (out[5]["q"], out[5]["reason"]) == (0, "Missing data indicator")


def test_zscore_skips_sparse_series(spark):
    flat = [1.0] * 30 + [500.0]
    out = quality.zscore_outliers(series(spark, flat))
    assert column(out, "is_outlier") == [False] * 30 + [True]
    sparse = quality.zscore_outliers(series(spark, flat + [N] * 40))
    assert not any(column(sparse, "is_outlier"))


def test_order_repair(spark):
    rows = spark.createDataFrame([(1.0, 9.0, 5.0), (4.0, 2.0, 6.0), (4.0, N, 6.0)],
                                 "tn double, tavg double, tx double")
    assert [r["tavg"] for r in quality.order_repair(rows).collect()] == [5.0, 4.0, N]


def test_mode_breaks_ties_by_value(spark):
    rows = spark.createDataFrame([("a", "N"), ("a", "E"), ("a", N)], "k string, v string")
    assert stats.mode_by(rows, ("k",), "v").first()["mode"] == "E"


def test_circular_mean_crosses_north(spark):
    rows = spark.createDataFrame([("a", 350.0), ("a", 10.0), ("a", N)], "series string, direction double")
    out = stats.circular_stats(rows).first()
    assert min(out["mean_direction"], 360 - out["mean_direction"]) == pytest.approx(0, abs=1e-9)
    assert out["n"] == 2


def test_temperature_relation(spark):
    rows = spark.createDataFrame(
        [("a", DAY, N, 20.0, 25.0), ("a", DAY + dt.timedelta(days=1), 32.0, N, 27.0),
         ("a", DAY + dt.timedelta(days=2), 30.0, 22.0, N)],
        "series string, ds date, tx double, tn double, tavg double")
    out = impute.temperature_relation_fill(rows).orderBy("ds").collect()
    assert [(r["tx"], r["tn"], r["tavg"]) for r in out] == [(30, 20, 25), (32, 22, 27), (30, 22, 26)]


def test_cardinal_levels(spark):
    rows = spark.createDataFrame(
        [("a", dt.date(2024, 1, 1), "S ", N), ("a", dt.date(2024, 1, 2), "C", N),
         ("a", dt.date(2024, 2, 1), N, N), ("a", dt.date(2024, 5, 1), N, 359.0),
         ("b", DAY, N, N)], "series string, ds date, cardinal string, direction double")
    assert column(impute.cardinal_clean(rows), "filled") == ["S", "S", "S", "N", "N"]


def test_wind_direction_uses_near_date_when_scattered(spark):
    rows = series(spark, [0.0, 90.0, 180.0, 270.0, N]).withColumnRenamed("value", "direction")
    assert column(impute.wind_direction_fill(rows), "filled")[-1] == 270.0


@pytest.mark.parametrize("kind, values, expected", [
    ("rainfall", [N, 2.0], [0.0, 2.0]),
    ("humidity", [N, N, N, 5.0, N, N, N], [N, 5.0, 5.0, 5.0, 5.0, 5.0, N]),
    ("radiation", [0.0] + [N] * 7 + [8.0], [0, 1, 2, 3, 3, 3, N, N, 8]),
    ("wind", [0.0, N, N, N, N, N, 6.0], [0, 1, 2, N, 4, 5, 6]),
])
def test_typed_fill(spark, kind, values, expected):
    assert column(impute.typed_fill(series(spark, values), kind), "filled") == expected


def test_scale_round_trip_and_constant(spark):
    rows = series(spark, [2.0, 2.0, 2.0])
    for kind in ("standard", "minmax", "robust"):
        s = transform.scale_stats(rows, kind)
        assert column(transform.scale(rows, s), "scaled") == [0.0] * 3


def test_yeo_johnson_handles_negatives(spark):
    values = [-3.0, -1.0, 0.0, 2.0, 10.0, 30.0]
    rows = series(spark, values)
    out = column(transform.yeo_johnson(rows, transform.power_lambdas(rows)), "power")
    assert np.mean(out) == pytest.approx(0) and np.std(out) == pytest.approx(1)
    assert out == sorted(out)


def test_winsorize_ranks(spark):
    rows = series(spark, [float(i) for i in range(20)] + [N])
    out = column(transform.winsorize_ranks(rows), "winsorized")
    assert out == [1.0] + [float(i) for i in range(1, 19)] + [18.0, N]


def test_wide_correlation_needs_rows(spark):
    rows = spark.range(10).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    assert stats.correlation(rows, ["a", "b"]).first()["r"] is None
    more = spark.range(20).select(F.col("id").cast("double").alias("a"), (F.col("id") * -2.0).alias("b"))
    assert stats.correlation(more, ["a", "b"]).first()["r"] == pytest.approx(-1)


def test_grid_tasks_are_not_merged(spark):
    """A task's rows grow after the shuffle, so tasks are not merged for their few bytes before it."""
    rows = spark.range(40).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("series"),
        F.explode(F.array(F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 12, 31)))).alias("ds"),
        F.lit(1.0).alias("value"))
    grid = align.complete_grid(rows)
    assert grid.count() == 40 * 366
    assert grid.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
