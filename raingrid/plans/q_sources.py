"""Queries: readers and writers, on files that Spark derives from the given tables.

Each query writes its files to a new folder below the shared checkpoint folder and
reads them back, so the work grows with the tables.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.functions import values as V
from raingrid.operators import smoothing as H
from raingrid.plans import flows
from raingrid.plans import q_decide as QD
from raingrid.plans import q_forecast as QF
from raingrid.plans import series as S
from raingrid.plans.q_stats import rounded
from raingrid.plans.registry import query
from raingrid.session import fresh_path, written
from raingrid.sources import lines as L
from raingrid.sources import mooring as M
from raingrid.sources import sink, station


_made: dict[tuple, str] = {}


def once(make):
    """Files that ``make(spark, sf)`` writes, written once for a session and folder of tables."""
    @functools.wraps(make)
    def path_of(spark, sf):
        key = (make.__name__, spark.sparkContext.applicationId, sf)
        if key not in _made:
            _made[key] = make(spark, sf)
        return _made[key]

    return path_of


@once
def station_files(spark, sf) -> str:
    """E1 as yearly-style station CSV files, one folder per station, with sentinels."""
    day, v = F.dayofmonth("ds"), F.col("value")
    rows = S.e1(spark, sf).select(
        F.col("series").alias("station"), F.date_format("ds", "yyyy-MM-dd").alias("Date"),
        F.year("ds").alias("Year"), F.month("ds").alias("Month"), day.alias("Day"),
        (v - 5).cast("string").alias("TN"), (v + 5).cast("string").alias("TX"),
        v.cast("string").alias("TAVG"), F.when(day % 4 == 0, "").otherwise("80").alias("RH_AVG"),
        F.when(day % 7 == 0, "8888").otherwise((v / 4).cast("string")).alias("RR"),
        F.when(day % 5 == 0, "-").otherwise("7.5").alias("SS"), F.lit("9999.0").alias("FF_X"),
        F.lit("270").alias("DDD_X"), F.lit("x").alias("FF_AVG"), F.lit("N ").alias("DDD_CAR"))
    twice = rows.unionByName(rows.where(F.col("Day") == 1))
    path = fresh_path(spark, "station")
    sink.write_series(twice, path, by=("station",))
    return path


@query("read_station_csv", f"""WITH {S.E1} SELECT series AS station, ds, round(value - 5, 6) AS "TN",
  round(value + 5, 6) AS "TX", value AS "TAVG", CASE WHEN day(ds) % 4 <> 0 THEN 80.0::DOUBLE END AS "RH_AVG",
  CASE WHEN day(ds) % 7 <> 0 THEN round(value / 4, 8) END AS "RR",
  CASE WHEN day(ds) % 5 <> 0 THEN 7.5::DOUBLE END AS "SS", NULL::DOUBLE AS "FF_X", 270.0::DOUBLE AS "DDD_X",
  NULL::DOUBLE AS "FF_AVG", 'N' AS "DDD_CAR" FROM e1""")
def read_station_csv(spark, sf):
    rows = station.read_station_csv(spark, station_files(spark, sf))
    return rounded(rows, 6, "TN", "TX").withColumn("RR", F.round("RR", 8))


FILES = {"click": "t8n90e_dy.ascii", "view": "t0n90e_dy.ascii", "error": "unnamed.txt",
         "purchase": "sst8n90e_dy.ascii", "signup": "w4n90e_dy.ascii"}


@once
def mooring_files(spark, sf) -> str:
    """E1 as mooring text: blocks with own headers, packed codes, missing marks.

    Three series become temperature files whose depths change on day 16, one a sea
    surface file, one a wind file with two code digits.
    """
    day, v = F.dayofmonth("ds"), F.col("value")
    date = F.date_format("ds", "yyyyMMdd")
    text = lambda x: F.format_string("%9.4f", x)
    q, s = (day % 6).cast("string"), (day % 9).cast("string")
    temp = F.concat_ws(
        " ", date, F.lit("1200"), text(v), F.when(day % 8 == 0, "-9.999").otherwise(text(v - 1)),
        text(v - 2), F.concat(q, F.lit("1"), q), F.concat(s, F.lit("5"), s))
    sst = F.concat_ws(" ", date, F.lit("1200"),
                      F.when(day % 8 == 0, "-9.99").otherwise(text(v)), q, s)
    wind = F.concat_ws(" ", date, F.lit("1200"), text(-v), text(v * 2), text(v * 4),
                       F.when(day % 8 == 0, "-99.9").otherwise(text(v + 90)),
                       F.concat(q, F.lit("4")), F.concat(s, F.lit("3")))
    is_temp = F.col("series").isin("click", "view", "error")
    body = F.when(is_temp, temp).when(F.col("series") == "purchase", sst).otherwise(wind)
    first = F.col("series").isin("click", "view", "error") & (day < 16)
    depth = (F.when(first, " Depth(M):           1     10     20 QUALITY SOURCE")
             .when(is_temp, " Depth(M):           1     20     40 QUALITY SOURCE")
             .when(F.col("series") == "purchase", " Depth (M):        1 QUALITY SOURCE")
             .otherwise(" Depth (M):       -4    -4    -4    -4 QUALITY and SOURCE"))
    names = (F.when(is_temp, " YYYYMMDD HHMM     SST   TEMP   TEMP QQQ SSS")
             .when(F.col("series") == "purchase", " YYYYMMDD HHMM   SST Q S")
             .otherwise(" YYYYMMDD HHMM  UWND  VWND  WSPD  WDIR SD SD"))
    start = F.lit(" Time: 1200 block")
    opens = (day == 1) | (day == 16)
    made = F.when(opens, F.array(start, depth, names, body)).otherwise(F.array(body))
    rows = S.e1(spark, sf).select(
        _file_names().alias("file"), "ds", F.posexplode(made).alias("k", "value"))
    path = fresh_path(spark, "mooring")
    rows.repartition("file").sortWithinPartitions("file", "ds", "k").select("file", "value") \
        .write.partitionBy("file").text(path)
    return path


def _file_names():
    expr = None
    for name, file in FILES.items():
        test = F.col("series") == name
        expr = F.when(test, file) if expr is None else expr.when(test, file)
    return expr


MOORING = S.E1 + """, mo AS (SELECT *, day(ds) AS dy, CAST(day(ds) % 6 AS INTEGER) AS q6,
  CAST(day(ds) % 9 AS INTEGER) AS s9 FROM e1),
tp AS (SELECT CASE series WHEN 'click' THEN '8N90E' WHEN 'view' THEN '0N90E' END AS station, ds, value, dy,
  q6, s9 FROM mo WHERE series IN ('click', 'view', 'error')),
mv AS (SELECT station, 'temp' AS variable, 'SST' AS name, 1.0::DOUBLE AS depth, ds, value, q6 AS q, s9 AS s
  FROM tp UNION ALL
  SELECT station, 'temp', 'TEMP', CASE WHEN dy < 16 THEN 10 ELSE 20 END, ds,
    CASE WHEN dy % 8 <> 0 THEN value - 1 END, 1, 5 FROM tp UNION ALL
  SELECT station, 'temp', 'TEMP', CASE WHEN dy < 16 THEN 20 ELSE 40 END, ds, value - 2, q6, s9 FROM tp
  UNION ALL SELECT '8N90E', 'sst', 'SST', 1, ds, CASE WHEN dy % 8 <> 0 THEN value END, q6, s9 FROM mo
    WHERE series = 'purchase' UNION ALL
  SELECT '4N90E', 'wind', 'UWND', -4, ds, -value, q6, s9 FROM mo WHERE series = 'signup' UNION ALL
  SELECT '4N90E', 'wind', 'VWND', -4, ds, value * 2, q6, s9 FROM mo WHERE series = 'signup' UNION ALL
  SELECT '4N90E', 'wind', 'WSPD', -4, ds, value * 4, q6, s9 FROM mo WHERE series = 'signup' UNION ALL
  SELECT '4N90E', 'wind', 'WDIR', -4, ds, CASE WHEN dy % 8 <> 0 THEN value + 90 END, 4, 3 FROM mo
    WHERE series = 'signup')"""


@query("read_mooring_text", f"""WITH {MOORING} SELECT station, variable, name, depth, ds,
  round(value, 4) AS value, q, s FROM mv""")
def read_mooring_text(spark, sf):
    rows = M.read_mooring_text(spark, mooring_files(spark, sf))
    return rounded(rows.drop("token"), 4, "value")


@query("route_by_file", f"""WITH {MOORING} SELECT station, variable, count(*) AS n FROM mv GROUP BY 1, 2""")
def route_by_file(spark, sf):
    rows = M.read_mooring_text(spark, mooring_files(spark, sf))
    return rows.groupBy("station", "variable").agg(F.count(F.lit(1)).alias("n"))


@query("depth_columns", f"""WITH {S.E1}, f AS (SELECT DISTINCT series, day(ds) >= 16 AS late FROM e1
  WHERE day(ds) IN (1, 16)), d AS (SELECT series, unnest(CASE WHEN series = 'purchase' THEN [1.0]
  WHEN series = 'signup' THEN [-4.0] WHEN late THEN [1.0, 20.0, 40.0] ELSE [1.0, 10.0, 20.0] END::DOUBLE[]) AS depth,
  unnest(range(0, CASE WHEN series IN ('purchase', 'signup') THEN 1 ELSE 3 END)) AS position FROM f)
  SELECT depth, CAST(position AS INTEGER) AS position, count(*) AS n FROM d GROUP BY 1, 2""")
def depth_columns(spark, sf):
    rows = L.read_lines(spark, mooring_files(spark, sf))
    heads = rows.where(F.col("line").rlike(r"^\s*Depth"))
    return heads.select(F.explode(M.depth_columns(F.col("line"))).alias("depth", "position")).groupBy(
        "depth", "position").agg(F.count(F.lit(1)).alias("n"))


@once
def sheet_files(spark, sf) -> str:
    """E1 as sheet exports: title rows, header, data, a blank row and remarks."""
    day, v = F.dayofmonth("ds"), F.col("value")
    body = F.concat_ws(",", F.date_format("ds", "dd-MM-yyyy"), v.cast("string"),
                       F.when(day % 4 == 0, "-").otherwise(day.cast("string")))
    made = (
        F.when(day == 1, F.array(F.lit("STASIUN,,"), F.lit(""), F.lit("TANGGAL,RR,SS"), body))
        .when(day == 28, F.array(body, F.when(F.col("series") == "view", F.lit("KETERANGAN :,,"))
                                 .otherwise(F.lit(",,")))).otherwise(F.array(body)))
    rows = S.e1(spark, sf).select("series", "ds", F.posexplode(made).alias("k", "value"))
    path = fresh_path(spark, "sheet")
    rows.repartition("series").sortWithinPartitions("series", "ds", "k").select("series", "value") \
        .write.partitionBy("series").text(path)
    return path


@query("clean_sheet_rows", f"""WITH {S.E1} SELECT series, ds, value AS rr,
  CASE WHEN day(ds) % 4 <> 0 THEN CAST(day(ds) AS DOUBLE) END AS ss FROM e1 WHERE day(ds) <= 28""")
def clean_sheet_rows(spark, sf):
    rows = station.read_sheet_text(spark, sheet_files(spark, sf), ("TANGGAL", "RR", "SS"))
    return rows.select(
        F.regexp_extract("path", "series=([a-z]+)", 1).alias("series"),
        V.parse_date_multi(F.col("TANGGAL"), ("dd-MM-yyyy",)).alias("ds"),
        V.coerce_numeric(F.col("RR")).alias("rr"), V.coerce_numeric(F.col("SS")).alias("ss"))


@query("write_series", f"""WITH {S.E1} SELECT 'csv' AS kind, series, ds, value FROM e1
  UNION ALL SELECT 'parquet', series, ds, value FROM e1""")
def write_series(spark, sf):
    rows, root = S.e1(spark, sf), fresh_path(spark, "out")
    paths = {k: f"{root}/{sink.dated(k, dt.date(2024, 1, 31))}" for k in ("csv", "parquet")}
    for kind, path in paths.items():
        sink.write_series(rows, path, by=("series",), kind=kind)
    text = spark.read.csv(paths["csv"], header=True, schema="ds date, value double")
    back = text.withColumn("kind", F.lit("csv")).unionByName(
        spark.read.parquet(paths["parquet"]).withColumn("kind", F.lit("parquet")))
    return back.select("kind", "series", "ds", "value")


@query("mooring_table", f"""WITH {MOORING}, g AS (SELECT * FROM mv WHERE q IN (1, 2, 3)
  AND s IN (1, 2, 3, 5, 6, 7, 8) AND value IS NOT NULL)
  SELECT coalesce(station, '?') AS "Location", ds AS "Date",
  round(max(value) FILTER (variable = 'sst'), 4) AS "SST",
  round(max(value) FILTER (variable = 'temp' AND depth = 20), 4) AS "TEMP_20m",
  round(max(value) FILTER (name = 'UWND'), 4) AS "UWND" FROM g
  GROUP BY station, ds HAVING count(*) FILTER (NOT (variable = 'temp' AND depth NOT IN (10, 20, 40))) > 0""")
def mooring_table(spark, sf):
    rows = flows.mooring_table(spark, mooring_files(spark, sf))
    return rounded(rows.select(F.coalesce("Location", F.lit("?")).alias("Location"), "Date", "SST",
                               "TEMP_20m", "UWND"), 4, "SST", "TEMP_20m", "UWND")


@once
def _whole_stations(spark, sf) -> str:
    """M1 as station CSV files with all variables, each with gaps of its own."""
    day = F.unix_date("ds")
    text = lambda c, k: F.when(F.pmod(day, F.lit(k)) != 0, c.cast("string")).otherwise("8888")
    t, rh, rr = F.col("tavg"), F.col("rh"), F.col("rr")
    names = F.array(*[F.lit(x) for x in ("N ", "SE", "C ", "WNW", "E")])
    speed = 2 + F.pmod(F.floor(rr * 4), F.lit(7))
    rows = S.m1(spark, sf).select(
        F.col("series").alias("station"), F.date_format("ds", "yyyy-MM-dd").alias("Date"),
        F.year("ds").alias("Year"), F.month("ds").alias("Month"), F.dayofmonth("ds").alias("Day"),
        text(t - 4, 11).alias("TN"), text(t + 4, 13).alias("TX"), text(t, 17).alias("TAVG"),
        text(rh, 7).alias("RH_AVG"), text(F.greatest(rr - 12, F.lit(0.0)), 9).alias("RR"),
        text(rr / 3, 5).alias("SS"), speed.cast("string").alias("FF_X"),
        text(F.floor(rr * 14), 6).alias("DDD_X"), text(speed * 0.5, 4).alias("FF_AVG"),
        F.element_at(names, F.pmod(F.floor(rr), F.lit(5)).cast("int") + 1).alias("DDD_CAR"))
    path = fresh_path(spark, "stations")
    sink.write_series(rows, path, by=("station",))
    return path


def _cleaned(spark, sf):
    return written(flows.station_table(spark, _whole_stations(spark, sf)), "station-table")


LENGTHS = S.M1 + """, sp AS (SELECT series AS station, min(ds) AS a, max(ds) AS b,
  date_diff('day', min(ds), max(ds)) + 1 AS n FROM m1 GROUP BY 1)"""


@query("station_table", f"""WITH {LENGTHS} SELECT station, n AS n_days, a AS first_day, b AS last_day,
  0::BIGINT AS n_null, 0::BIGINT AS n_outside FROM sp""")
def station_table(spark, sf):
    """Files to gap-free days: every day there, nothing null, nothing outside its limits."""
    rows = _cleaned(spark, sf)
    empty = F.lit(False)
    for c in ("rr", "tx", "tn", "tavg", "rh", "ss", "direction", "wind", "cardinal"):
        empty = empty | F.col(c).isNull()
    good = ((F.col("rr") >= 0) & F.col("rh").between(0, 100) & F.col("ss").between(0, 14)
            & F.col("direction").between(0, 360) & F.col("cardinal").isin(*fixed.COMPASS))
    return rows.groupBy("station").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"),
        F.count_if(empty).alias("n_null"), F.count_if(~good).alias("n_outside"))


@query("station_outlook", f"""WITH {LENGTHS} SELECT station, 120::BIGINT AS n_days,
  CAST(b + 1 AS DATE) AS first_day, CAST(b + 120 AS DATE) AS last_day, 0::BIGINT AS n_null,
  0::BIGINT AS n_outside FROM sp""")
def station_outlook(spark, sf):
    """Models searched over all seasons usual for a variable, to advice: each day after the last
    has a forecast, a score and a decision."""
    tried = {k: H.season_candidates(v, alphas=(0.2,)) for k, (v, _) in flows.FORECAST.items()}
    rows = flows.station_outlook(_cleaned(spark, sf), candidates=tried)
    empty = F.col("rr").isNull() | F.col("tavg").isNull() | F.col("rh").isNull() | F.col("decision").isNull()
    return rows.groupBy("station").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"),
        F.count_if(empty).alias("n_null"),
        F.count_if(~F.col("score").between(0, 100)).alias("n_outside"))


@query("coverage", f"""WITH {MOORING}, al AS (SELECT station, count(DISTINCT ds) AS total FROM mv GROUP BY 1)
  SELECT mv.station, name, count(DISTINCT ds) FILTER (value IS NOT NULL) AS available, any_value(total) AS total,
  round(100.0::DOUBLE * count(DISTINCT ds) FILTER (value IS NOT NULL) / any_value(total), 6) AS percent
  FROM mv JOIN al ON al.station = mv.station GROUP BY 1, 2""")
def coverage(spark, sf):
    rows = flows.coverage(M.read_mooring_text(spark, mooring_files(spark, sf)))
    return rounded(rows, 6, "percent")


YEAR_AHEAD = H.candidate(phi=0.98, m=365)


@query("planting_months", f"""WITH RECURSIVE {S.O1G}, f0 AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM o1g),
f1 AS (SELECT series, ds, unnest(['SST', 'SWRad', 'WSPD']) AS k,
  unnest([CAST(24 + v % 9 AS DOUBLE), CAST(100 + v % 113 AS DOUBLE), 1 + (v % 13) / 2]) AS x FROM f0),
lv AS (SELECT series || '/' || k AS series, ds, coalesce(last_value(x IGNORE NULLS) OVER f,
  last_value(x IGNORE NULLS) OVER b) AS value FROM f1
  WINDOW f AS (PARTITION BY series, k ORDER BY ds ROWS UNBOUNDED PRECEDING),
  b AS (PARTITION BY series, k ORDER BY ds DESC ROWS UNBOUNDED PRECEDING)),
{QF.arr_sql('lv')}, {QF.cand_sql('cand', [YEAR_AHEAD], 'lv')}, {QF.smooth_sql('hw', 'arr', 'cand')},
{QF.last_sql(365)}, mo AS (SELECT split_part(series, '/', 1) AS series, split_part(series, '/', 2) AS k,
  CAST(date_trunc('month', ds) AS DATE) AS period, avg(yhat + bias) AS x FROM fc JOIN bias USING (series) GROUP BY ALL),
suit AS (SELECT series, period, max(CASE WHEN x >= 27 THEN 0.5 ELSE 0 END + CASE WHEN x <= 30 THEN 0.5 ELSE 0 END)
    FILTER (k = 'SST') AS a, max(CASE WHEN x >= 150 THEN 0.5 ELSE 0 END) FILTER (k = 'SWRad') AS b,
  max(CASE WHEN x >= 1 THEN 0.5 ELSE 0 END + CASE WHEN x <= 6 THEN 0.5 ELSE 0 END) FILTER (k = 'WSPD') AS c
  FROM mo GROUP BY 1, 2){QD.CAL[len(QD.SEA):]}
  SELECT series, period, CAST(suitability AS DOUBLE) AS suitability, decision FROM cal""")
def planting_months(spark, sf):
    """A year ahead by month; SQL smooths each day, and takes the months and decisions from that."""
    v = F.round(F.col("value") * 100).cast("bigint")
    sea = S.o1(spark, sf).select(
        "series", "ds", (24 + F.pmod(v, F.lit(9))).cast("double").alias("SST"),
        (100 + F.pmod(v, F.lit(113))).cast("double").alias("SWRad"),
        (1 + F.pmod(v, F.lit(13)) / 2).alias("WSPD"))
    rows = flows.planting_months(sea)
    return rows.select("series", "period", F.round("suitability", 6).alias("suitability"), "decision")
