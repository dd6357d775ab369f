"""Whole flows over stored files, composed from the operators."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.functions import values as V
from raingrid.operators import clean as C
from raingrid.operators import decide as D
from raingrid.operators import forecast as P
from raingrid.operators import impute as I
from raingrid.operators import patterns as L
from raingrid.operators import quality as Q
from raingrid.operators import smoothing as H
from raingrid.operators import stats as A
from raingrid.operators import windows as W
from raingrid.operators.align import complete_grid
from raingrid.operators.common import to_arrays
from raingrid.session import written
from raingrid.sources.mooring import read_mooring_text
from raingrid.sources.station import read_station_csv

# Mooring names and the merged table's columns.
MERGED_NAMES = {"SWRad": "RAD", "Prec": "RAIN", "RH": "RH", "SST": "SST", "UWND": "UWND",
                "VWND": "VWND", "WSPD": "WSPD", "WDIR": "WDIR"}


def merge_mooring(values: DataFrame, depths=fixed.TARGET_DEPTHS) -> DataFrame:
    """Long mooring values to one wide row per station and day, codes applied.

    One aggregate on (station, day) replaces a chain of outer joins per variable.
    """
    good = Q.quality_filter(values)
    temp = F.col("variable") == "temp"
    cells = {out: F.max(F.when((F.col("name") == src) & ~temp, F.col("value")))
             for src, out in MERGED_NAMES.items()}
    for d in depths:
        cells[f"TEMP_{d:g}m"] = F.max(F.when(temp & (F.col("depth") == d), F.col("value")))
    wide = good.groupBy(F.col("station").alias("Location"), F.col("ds").alias("Date")).agg(
        *[c.alias(n) for n, c in cells.items()])
    measures = [n for n in cells]
    return C.order_columns(C.drop_all_null(wide, measures))


def mooring_table(spark: SparkSession, path) -> DataFrame:
    return merge_mooring(read_mooring_text(spark, path))


RAIN_PREDICTORS = ("tavg", "rh", "ss", "tx", "tn")


def clean_station(rows: DataFrame, site="Aceh", by=("station",)) -> DataFrame:
    """Station rows to gap-free daily columns.

    Limits, one row per day, temperatures from each other, humidity through the dew point,
    sunshine under the day's length, wind direction, wind speed from the greatest speed and
    then from weather patterns, compass names, and rain by the occurrence model.
    """
    limited = Q.range_to_null(rows, fixed.STATION_LIMITS)
    kept = [c for c in limited.columns if c not in (*by, "ds")]
    grid = complete_grid(limited, by, "ds", kept)
    named = grid.withColumnsRenamed({"TX": "tx", "TN": "tn", "TAVG": "tavg", "RH_AVG": "rh",
                                     "RR": "rr"})
    named = named.withColumn("rain_missing", V.missing_flag(F.col("rr")))
    # The grid's days are unique, so all fills look ahead in one sort.
    once = dict(by=by, look_ahead=True)
    filled = I.temperature_relation_fill(named, **once)
    filled = I.humidity_from_dewpoint(filled, **once).drop("rh").withColumnRenamed("rh_filled", "rh")
    filled = I.daylight_cap(filled, fixed.LATITUDES[site], value="SS", out="ss", **once)
    filled = I.wind_direction_fill(filled, value="DDD_X", out="direction", **once)
    # The modes of the names, the fits of the wind and its patterns read their input several times,
    # so it is written before; what they add is small enough to be done again at each reading.
    filled = written(filled, "station-days")
    # Only a station without any value of a variable has gaps left in it.
    gaps = filled.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in RAIN_PREDICTORS]))
    gap_free = not gaps.limit(1).count()
    filled = I.cardinal_clean(filled, by=by, name="DDD_CAR", degrees="direction", out="cardinal")
    kept = (*by, "ds", "rain_missing", "rr", "tx", "tn", "tavg", "rh", "ss", "direction", "wind", "cardinal")
    filled = L.rain_occurrence_fill(fill_wind(filled, by).select(*kept), list(RAIN_PREDICTORS), out="rain",
                                    gap_free=gap_free, **once)
    return filled.withColumn("rr", F.col("rain")).select(*kept)


def fill_wind(rows: DataFrame, by=("station",)) -> DataFrame:
    """``wind``: mean speed, else from the greatest speed where the line is good, else from
    days of like temperature and humidity."""
    train = F.conv(F.substring(F.md5(F.concat_ws("|", *by, F.col("ds").cast("string"))), 1, 8),
                   16, 10).cast("bigint") % 5 < 4
    fits = I.regression_fits(rows, train, "FF_X", "FF_AVG", by)
    lined = I.regression_fill(rows, fits, x="FF_X", y="FF_AVG", by=by, out="_wind")
    return L.pattern_median_fill(lined, ["tavg", "rh"], "_wind", by=by, out="wind",
                                 look_ahead=True).drop("_wind")


FORECAST = {"rr": ("RR", "rr_adjusted"), "tavg": ("TAVG", "tavg"), "rh": ("RH_AVG", "rh")}


def station_outlook(cleaned: DataFrame, horizon=120, candidates=None, by=("station",),
                    planted: dt.date | None = None) -> DataFrame:
    """Forecast rain, temperature and humidity per station and turn them into advice.

    Every station takes the candidate with the least error on its last days, or the default
    model if none could be scored; where that cannot be fitted, the month means serve.
    """
    coded = P.encode_rain_flag(cleaned)
    parts = {}
    for name, (variable, source) in FORECAST.items():
        rows = coded.select(*by, "ds", F.col(source).alias("value"))
        tried = candidates[name] if candidates else H.season_candidates(variable)
        best = H.with_best(to_arrays(rows, by), tried, default=H.default_model(variable))
        main = H.forecast(H.fit(best), horizon, by, remove_bias=True)
        parts[name] = P.fallback_chain(main, P.seasonal_naive(rows, horizon, by=by), by=by)
    wide = P.side_by_side(parts, by).withColumnRenamed("rr", "yhat")
    rain = P.decode_rain_flag(wide, cleaned, by)
    advice = D.advise(rain)
    return advice if planted is None else D.harvest_override(advice, planted, by=by)


def station_table(spark: SparkSession, path) -> DataFrame:
    return clean_station(read_station_csv(spark, path))


def planting_months(sea: DataFrame, horizon=365, settings=None, by=("series",)) -> DataFrame:
    """Daily SST, SWRad and WSPD to a year ahead of months with planting decisions."""
    settings = settings or H.candidate(phi=0.98, m=365)
    parts = {}
    for name in fixed.SUITABILITY:
        rows = W.fill_both(complete_grid(sea.select(*by, "ds", F.col(name).alias("value")), by),
                           by, out="value")
        main = H.forecast(H.smooth(rows, settings, by=by, keep_fitted=False), horizon, by,
                          remove_bias=True)
        parts[name] = P.fallback_chain(main, P.seasonal_naive(rows, horizon, by=by), by=by)
    return D.planting_calendar(D.monthly_suitability(P.side_by_side(parts, by), by=by), by=by)


def coverage(values: DataFrame) -> DataFrame:
    """Share of a station's dates that each variable covers."""
    days = values.where(F.col("value").isNotNull()).groupBy("station", "name").agg(
        F.countDistinct("ds").alias("available"))
    every = values.groupBy("station").agg(F.countDistinct("ds").alias("total"))
    return days.join(every, "station").withColumn(
        "percent", 100.0 * F.col("available") / F.col("total"))


def climatology(values: DataFrame) -> DataFrame:
    rows = values.select(F.concat_ws("/", "station", "name").alias("series"), "ds", "value")
    return A.month_climatology(rows.where(F.col("value").isNotNull()))
