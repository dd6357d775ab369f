"""Queries: planting decisions and the flagship advice."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from raingrid.functions import values as V
from raingrid.operators import decide as D
from raingrid.operators import windows as W
from raingrid.plans import series as S
from raingrid.plans.q_stats import rounded
from raingrid.plans.registry import query


def _weather(spark, sf):
    """M1 on its grid, filled; some days flagged as unknown rain, some left null."""
    rows = S.m1_grid(spark, sf).withColumn("rain_missing", (
        F.col("rr").isNull() | (F.dayofmonth("ds") % 9 == 0)).cast("int"))
    rows = W.fill_both_all(rows, ("rr", "tavg", "rh"))
    gone = F.dayofmonth("ds") == 31
    return rows.withColumns({
        "tavg": F.when(~gone, F.col("tavg")),
        "rr": F.when(~(gone & (F.month("ds") % 2 == 1)), F.col("rr")),
        "rh": F.when(~(gone & (F.month("ds") % 3 == 1)), F.col("rh"))})


def _filled(c):
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER f, last_value({c} IGNORE NULLS) OVER b) AS {c}"""


WEATHER = S.M1G + f""", w0 AS (SELECT series, ds,
  CAST(rr IS NULL OR day(ds) % 9 = 0 AS INTEGER) AS rain_missing, {_filled('rr')}, {_filled('tavg')},
  {_filled('rh')} FROM m1g WINDOW f AS (PARTITION BY series ORDER BY ds ROWS UNBOUNDED PRECEDING),
  b AS (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING)),
w AS (SELECT series, ds, rain_missing,
  CASE WHEN NOT (day(ds) = 31 AND month(ds) % 2 = 1) THEN rr END AS rr,
  CASE WHEN day(ds) <> 31 THEN tavg END AS tavg,
  CASE WHEN NOT (day(ds) = 31 AND month(ds) % 3 = 1) THEN rh END AS rh FROM w0)"""


def status_sql(source: str, name: str, flag=True, no_data="Tidak Ada Data") -> str:
    mark = "WHEN rain_missing = 1 THEN 'Data Hujan Tidak Tersedia'" if flag else ""
    return f"""{name} AS (SELECT *, CASE WHEN rr IS NULL THEN '{no_data}' {mark}
  WHEN rr < 2 THEN 'Kering (Risiko)' WHEN rr <= 15 THEN 'Optimal' ELSE 'Banjir (Risiko)' END AS rr_status,
  CASE WHEN tavg IS NULL THEN '{no_data}' WHEN tavg < 20 THEN 'Dingin (Risiko)' WHEN tavg <= 35
  THEN 'Optimal' ELSE 'Panas (Risiko)' END AS tavg_status,
  CASE WHEN rh IS NULL THEN '{no_data}' WHEN rh < 60 THEN 'Kering (Risiko)' WHEN rh <= 90 THEN 'Optimal'
  ELSE 'Lembab Ekstrem (Risiko)' END AS rh_status,
  rr IS NULL OR tavg IS NULL OR rh IS NULL AS gap, month(ds) AS mo FROM {source})"""


POINTS = """(CASE WHEN rr_status = 'Optimal' THEN 40 ELSE 0 END +
  CASE WHEN tavg_status = 'Optimal' THEN 40 ELSE 0 END +
  CASE WHEN rh_status = 'Optimal' THEN 20 ELSE 0 END)"""
JOINED = "rr_status || ' / ' || tavg_status || ' / ' || rh_status"
PLANT = """WHEN score >= 70 THEN 'Tanam' WHEN score >= 50 THEN 'Tanam (Waspada)' ELSE 'Bera' END"""
BASIC = f"""{status_sql('w', 'st', flag=False)}, sc AS (SELECT *,
  CAST(CASE WHEN gap THEN 0 ELSE {POINTS} END AS INTEGER) AS score FROM st)"""
BASIC_DECISION = f"""CASE WHEN gap THEN 'Bera' WHEN rr > 15 OR tavg > 35 THEN 'Bera (Risiko Tinggi)'
  {PLANT}"""
GRADED = f"""{status_sql('w', 'st', flag=False, no_data='Tidak Ada Data (Risiko)')}, sc AS (SELECT *,
  CAST(CASE WHEN rr BETWEEN 2 AND 15 THEN 40 WHEN rr >= 1 AND rr < 2 THEN 20 ELSE 0 END +
  CASE WHEN tavg BETWEEN 20 AND 35 THEN 40 WHEN tavg >= 18 AND tavg <= 37 THEN 30 ELSE 0 END +
  CASE WHEN rh BETWEEN 60 AND 90 THEN 20 WHEN rh > 90 AND rh <= 95 THEN 10 ELSE 0 END AS INTEGER)
  AS score FROM st)"""
GRADED_DECISION = f"""CASE WHEN rr > 15 OR tavg > 35 OR (rh > 90 AND rr > 10) THEN 'Bera' {PLANT}"""
MONTHLY_SCORE = f"""CAST(CASE WHEN gap THEN 0 ELSE greatest(0, least(100, {POINTS}
  - CASE WHEN rain_missing = 1 THEN 25 ELSE 0 END
  + CASE WHEN mo IN (12, 1, 2, 3) AND rr_status = 'Banjir (Risiko)' THEN -15
         WHEN mo IN (7, 8, 9) AND rr_status = 'Kering (Risiko)' THEN -15
         WHEN mo IN (7, 8, 9) AND rr_status = 'Optimal' THEN 10 ELSE 0 END)) END AS INTEGER)"""
MONTHLY_DECISION = """CASE WHEN gap THEN 'Bera (Data Tidak Lengkap)'
  WHEN rr_status = 'Banjir (Risiko)' THEN 'Bera (Risiko Banjir)'
  WHEN tavg > 35 THEN 'Bera (Risiko Suhu Tinggi)'
  WHEN rain_missing = 1 AND mo IN (7, 8, 9) THEN 'Bera (Data Hujan Tidak Tersedia di Musim Kering)'
  WHEN rain_missing = 1 THEN 'Tanam Dengan Caution (Data Hujan Tidak Lengkap)'
  WHEN mo IN (12, 1, 2, 3) THEN CASE WHEN score >= 75 THEN 'Tanam (Kondisi Optimal)'
    WHEN score >= 60 THEN 'Tanam Dengan Caution' ELSE 'Bera (Kondisi Tidak Optimal)' END
  WHEN mo IN (7, 8, 9) THEN CASE WHEN score >= 85 THEN 'Tanam (Kondisi Kering Optimal)'
    WHEN score >= 70 THEN 'Tanam Terbatas' ELSE 'Bera (Musim Kering Risiko Tinggi)' END
  ELSE CASE WHEN score >= 80 THEN 'Tanam (Periode Transisi Optimal)'
    WHEN score >= 65 THEN 'Tanam Dengan Caution' ELSE 'Bera (Periode Transisi Risiko)' END END"""
MONTHLY = f"{status_sql('w', 'st')}, sc AS (SELECT *, {MONTHLY_SCORE} AS score FROM st)"
SEASONAL = f"""{status_sql('w', 'st')}, sc AS (SELECT *, CASE WHEN gap THEN 0.0::DOUBLE ELSE
  greatest(0, least(100, CASE WHEN mo <= 3 THEN {POINTS} * 0.95::DOUBLE
    WHEN mo BETWEEN 7 AND 9 AND rr_status = 'Optimal' THEN {POINTS} + 5
    WHEN mo BETWEEN 7 AND 9 AND rr_status = 'Kering (Risiko)' THEN {POINTS} - 10 ELSE {POINTS} END
  - CASE WHEN rain_missing = 1 THEN 15 ELSE 0 END)) END AS score FROM st)"""
SEASONAL_DECISION = """CASE WHEN gap THEN 'Bera (Data Tidak Lengkap)'
  WHEN rr_status = 'Banjir (Risiko)' THEN 'Bera (Risiko Banjir)'
  WHEN tavg > 35 THEN 'Bera (Risiko Suhu Tinggi)'
  WHEN rain_missing = 1 AND mo IN (7, 8, 9) THEN 'Bera (Data Hujan Tidak Tersedia)'
  WHEN rain_missing = 1 THEN 'Tanam Dengan Caution (Data Hujan Tidak Lengkap)'
  WHEN mo <= 3 THEN CASE WHEN score >= 75 THEN 'Tanam (Musim Hujan Optimal)'
    WHEN score >= 60 THEN 'Tanam Dengan Caution (Musim Hujan)' ELSE 'Bera (Kondisi Tidak Optimal)' END
  WHEN mo BETWEEN 7 AND 9 THEN CASE WHEN score >= 85 THEN 'Tanam (Musim Kering Optimal)'
    WHEN score >= 70 THEN 'Tanam Terbatas (Musim Kering)' ELSE 'Bera (Musim Kering Risiko Tinggi)' END
  ELSE CASE WHEN score >= 80 THEN 'Tanam (Periode Transisi Optimal)'
    WHEN score >= 65 THEN 'Tanam Dengan Caution (Periode Transisi)'
    ELSE 'Bera (Periode Transisi Risiko)' END END"""


@query("classify", f"""WITH {WEATHER}, {status_sql('w', 'st')} SELECT series, ds, rr, tavg, rh, rain_missing,
  rr_status, tavg_status, rh_status FROM st""")
def classify(spark, sf):
    return D.with_status(_weather(spark, sf), "rain_missing")


@query("category", f"""WITH {WEATHER}, {status_sql('w', 'st', False, 'Tidak Ada Data (Risiko)')}
  SELECT series, ds, {JOINED} AS joined, CASE WHEN rr IS NULL AND tavg IS NULL AND rh IS NULL THEN 'Tidak Ada Data'
  ELSE coalesce(nullif(concat_ws(', ', nullif(rr_status, 'Optimal'), nullif(tavg_status, 'Optimal'),
  nullif(rh_status, 'Optimal')), ''), 'Optimal') END AS listed FROM st""")
def category(spark, sf):
    from raingrid import fixed

    rows = D.with_status(_weather(spark, sf), no_data=fixed.NO_DATA_RISK)
    return rows.select("series", "ds", D.category_joined().alias("joined"), D.category_listed().alias("listed"))


def _scores(name, rules, ctes, expr="score"):
    @query(name, f"WITH {WEATHER}, {ctes} SELECT series, ds, {expr} AS score FROM sc")
    def run(spark, sf):
        out = D.advise(_weather(spark, sf), rules).select("series", "ds", "score")
        return rounded(out, 6, "score") if rules == "seasonal" else out

    return run


def _decisions(name, rules, ctes, decision):
    @query(name, f"WITH {WEATHER}, {ctes} SELECT series, ds, rr, tavg, rh, {decision} AS decision FROM sc")
    def run(spark, sf):
        return D.advise(_weather(spark, sf), rules).select("series", "ds", "rr", "tavg", "rh", "decision")

    return run


_scores("score_basic", "basic", BASIC)
_scores("score_graded", "graded", GRADED)
_scores("score_monthly", "monthly", MONTHLY)
_scores("score_seasonal", "seasonal", SEASONAL, "round(score, 6)")
_decisions("decide_basic", "basic", BASIC, BASIC_DECISION)
_decisions("decide_graded", "graded", GRADED, GRADED_DECISION)
_decisions("decide_monthly", "monthly", MONTHLY, MONTHLY_DECISION)
_decisions("decide_seasonal", "seasonal", SEASONAL, SEASONAL_DECISION)

PLANTED = dt.date(1996, 1, 11)


def _override_sql(ctes, decision, days, early, labels=None):
    due = PLANTED + dt.timedelta(days=days)
    inside = f"ds BETWEEN DATE '{due - dt.timedelta(days=6)}' AND DATE '{due}'"
    label = labels or f"CASE WHEN wet THEN '{early}' ELSE 'Panen Sesuai Jadwal' END"
    return f"""WITH {WEATHER}, {ctes}, dc AS (SELECT *, {decision} AS d0 FROM sc),
  fl AS (SELECT series, bool_or(ds = DATE '{due}') AS due, coalesce(bool_or({inside} AND rr > 10), false) AS wet,
  month(min(ds) FILTER ({inside})) AS fm FROM dc GROUP BY series)
  SELECT series, ds, rr, CASE WHEN due AND {inside} THEN {label} ELSE d0 END AS decision FROM dc JOIN fl USING (series)"""


@query("harvest_override", _override_sql(
    MONTHLY, MONTHLY_DECISION, 105, "Percepat Panen 1-2 Hari (Risiko Hujan)"))
def harvest_override(spark, sf):
    rows = D.advise(_weather(spark, sf), "monthly")
    return D.harvest_override(rows, PLANTED).select("series", "ds", "rr", "decision")


@query("harvest_override_seasonal", _override_sql(
    SEASONAL, SEASONAL_DECISION, 105, "", """CASE WHEN wet AND fm <= 3
    THEN 'Percepat Panen 3-5 Hari (Risiko Hujan Tinggi)' WHEN wet
    THEN 'Percepat Panen 1-2 Hari (Risiko Hujan)' WHEN fm BETWEEN 7 AND 9
    THEN 'Panen Sesuai Jadwal (Kondisi Kering Optimal)' ELSE 'Panen Sesuai Jadwal' END"""))
def harvest_override_seasonal(spark, sf):
    rows = D.advise(_weather(spark, sf), "seasonal")
    return D.harvest_override(rows, PLANTED, "seasonal", season_labels=True).select(
        "series", "ds", "rr", "decision")


@query("harvest_override_fixed", _override_sql(
    BASIC, BASIC_DECISION, 100, "Percepat Panen (Risiko Hujan)"))
def harvest_override_fixed(spark, sf):
    rows = D.advise(_weather(spark, sf), "basic")
    return D.harvest_override(rows, PLANTED, None).select("series", "ds", "rr", "decision")


CORE = f"ds BETWEEN DATE '{PLANTED + dt.timedelta(days=90)}' AND DATE '{PLANTED + dt.timedelta(days=100)}'"
AROUND = f"ds BETWEEN DATE '{PLANTED + dt.timedelta(days=83)}' AND DATE '{PLANTED + dt.timedelta(days=107)}'"
WINDOW_CASE = f"""CASE WHEN rr > 10 AND {CORE} THEN 'Percepat Panen (Risiko Hujan)'
  WHEN rr > 10 THEN 'Pantau Cuaca' WHEN rh > 90 AND {CORE} THEN 'Pertimbangkan Panen (Kelembaban Tinggi)'
  WHEN rh > 90 THEN 'Pantau Kelembaban' WHEN {CORE} THEN 'Panen Sesuai Jadwal'
  ELSE 'Belum Waktunya Panen' END"""


def _plantings(rows):
    """Three plantings a year for every station, some close enough for their harvests to overlap."""
    days = F.array(*[F.make_date(F.year("ds"), F.lit(m), F.lit(d)) for m, d in PLANTING_DAYS])
    return rows.select("series", F.explode(days).alias("planted")).distinct()


PLANTING_DAYS = ((1, 11), (3, 30), (4, 1), (6, 20), (10, 5))
PLANTINGS = f"""pl AS (SELECT DISTINCT series, make_date(year(ds), m, d) AS planted FROM w,
  (VALUES {', '.join(f'({m}, {d})' for m, d in PLANTING_DAYS)}) t(m, d))"""


@query("harvest_overrides", f"""WITH {WEATHER}, {MONTHLY}, dc AS (SELECT *, {MONTHLY_DECISION} AS d0 FROM sc),
  {PLANTINGS}, du AS (SELECT *, CAST(planted + CASE WHEN month(planted) IN (12, 1, 2, 3) THEN 105
    WHEN month(planted) IN (7, 8, 9) THEN 95 ELSE 100 END AS DATE) AS due FROM pl),
  hi AS (SELECT dc.series, planted, due, ds, rr FROM du JOIN dc ON dc.series = du.series AND ds BETWEEN due - 6 AND due),
  sn AS (SELECT series, planted, coalesce(bool_or(rr > 10), false) AS wet FROM hi GROUP BY 1, 2
    HAVING bool_or(ds = due)),
  la AS (SELECT series, ds, arg_max(CASE WHEN wet THEN 'Percepat Panen 1-2 Hari (Risiko Hujan)'
    ELSE 'Panen Sesuai Jadwal' END, planted) AS label FROM hi JOIN sn USING (series, planted) GROUP BY 1, 2)
  SELECT series, ds, rr, coalesce(label, d0) AS decision FROM dc LEFT JOIN la USING (series, ds)""")
def harvest_overrides(spark, sf):
    """Every station with plantings of its own in every year."""
    rows = D.advise(_weather(spark, sf), "monthly")
    return D.harvest_overrides(rows, _plantings(rows)).select("series", "ds", "rr", "decision")


@query("harvest_windows", f"""WITH {WEATHER}, {PLANTINGS}, x AS (SELECT w.*, planted, date_diff('day', planted, ds) AS n
  FROM w JOIN pl USING (series)) SELECT series, planted, ds, rr, rh, CASE
  WHEN rr > 10 AND n BETWEEN 90 AND 100 THEN 'Percepat Panen (Risiko Hujan)' WHEN rr > 10 THEN 'Pantau Cuaca'
  WHEN rh > 90 AND n BETWEEN 90 AND 100 THEN 'Pertimbangkan Panen (Kelembaban Tinggi)'
  WHEN rh > 90 THEN 'Pantau Kelembaban' WHEN n BETWEEN 90 AND 100 THEN 'Panen Sesuai Jadwal'
  ELSE 'Belum Waktunya Panen' END AS recommendation FROM x WHERE n BETWEEN 83 AND 107""")
def harvest_windows(spark, sf):
    rows = _weather(spark, sf)
    return D.harvest_windows(rows, _plantings(rows)).select(
        "series", "planted", "ds", "rr", "rh", "recommendation")


@query("harvest_window", f"""WITH {WEATHER} SELECT series, ds, rr, rh, {WINDOW_CASE} AS recommendation FROM w
  WHERE {AROUND}""")
def harvest_window(spark, sf):
    return D.harvest_window(_weather(spark, sf), PLANTED).select("series", "ds", "rr", "rh", "recommendation")


@query("apply_harvest_window", f"""WITH {WEATHER}, {GRADED}, dc AS (SELECT *, {GRADED_DECISION} AS d0,
  CASE WHEN {AROUND} THEN {WINDOW_CASE} END AS rec FROM sc)
  SELECT series, ds, CASE WHEN contains(rec, 'Panen') THEN rec ELSE d0 END AS decision FROM dc""")
def apply_harvest_window(spark, sf):
    rows = D.advise(_weather(spark, sf), "graded")
    return D.apply_harvest_window(rows, PLANTED).select("series", "ds", "decision")


def _sea(spark, sf):
    """Sea temperature, radiation and wind by day from the order series."""
    v = F.col("value")
    cents = F.round(v * 100).cast("bigint")
    return S.o1(spark, sf).select(
        "series", "ds", (24 + F.pmod(cents, F.lit(9))).cast("double").alias("SST"),
        (100 + F.pmod(cents, F.lit(113))).cast("double").alias("SWRad"),
        (F.pmod(cents, F.lit(13)) / 2).alias("WSPD"))


SEA = S.O1 + """, sea AS (SELECT series, ds, CAST(24 + c % 9 AS DOUBLE) AS "SST",
  CAST(100 + c % 113 AS DOUBLE) AS "SWRad", (c % 13) / 2 AS "WSPD" FROM
  (SELECT series, ds, CAST(round(value * 100) AS BIGINT) AS c FROM o1)),
mon AS (SELECT series, CAST(date_trunc('month', ds) AS DATE) AS period, avg("SST") AS "SST",
  avg("SWRad") AS "SWRad", avg("WSPD") AS "WSPD" FROM sea GROUP BY 1, 2),
suit AS (SELECT series, period, "SST", "SWRad", "WSPD",
  CASE WHEN "SST" >= 27 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN "SST" <= 30 THEN 0.5::DOUBLE ELSE 0 END AS a,
  CASE WHEN "SWRad" >= 150 THEN 0.5::DOUBLE ELSE 0 END AS b,
  CASE WHEN "WSPD" >= 1 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN "WSPD" <= 6 THEN 0.5::DOUBLE ELSE 0 END AS c
  FROM mon)"""


@query("monthly_suitability", f"""WITH {SEA} SELECT series, period, round("SST", 6) AS "SST",
  round("SWRad", 6) AS "SWRad", round("WSPD", 6) AS "WSPD", a AS "SST_suitable", b AS "SWRad_suitable",
  c AS "WSPD_suitable", round(a * 0.3 + b * 0.4 + c * 0.3, 6) AS suitability FROM suit""")
def monthly_suitability(spark, sf):
    return rounded(D.monthly_suitability(_sea(spark, sf)), 6, "SST", "SWRad", "WSPD", "suitability")


CAL = SEA + """, cf AS (SELECT series, period, round(a * 0.3 + b * 0.4 + c * 0.3, 6) AS suitability,
  round(a * 0.3 + b * 0.4 + c * 0.3, 6) >= 0.7 AS fit FROM suit),
cp AS (SELECT *, fit AND coalesce(lead(fit, 3) OVER (PARTITION BY series ORDER BY period), false) AS plant
  FROM cf), cal AS (SELECT series, period, suitability, CASE WHEN plant THEN 'Tanam'
  WHEN fit THEN 'Tidak Sesuai' WHEN coalesce(bool_or(plant) OVER (PARTITION BY series ORDER BY period
  ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) THEN 'Panen' ELSE 'Bera' END AS decision FROM cp)"""


def _calendar(spark, sf):
    scores = rounded(D.monthly_suitability(_sea(spark, sf)), 6, "suitability").select(
        "series", "period", "suitability")
    return D.planting_calendar(scores)


@query("planting_calendar", f"WITH {CAL} SELECT series, period, suitability, decision FROM cal")
def planting_calendar(spark, sf):
    return _calendar(spark, sf)


@query("decision_string", f"""WITH {CAL} SELECT series, string_agg(decision, ';' ORDER BY period)
  AS decisions FROM cal GROUP BY 1""")
def decision_string(spark, sf):
    return D.decision_string(_calendar(spark, sf))


@query("majority_decision", f"""WITH {WEATHER}, f AS (SELECT series, ds, rr, tavg, rh,
  coalesce(rr BETWEEN 5 AND 17, false) AS a, coalesce(tavg BETWEEN 20 AND 29, false) AS b,
  coalesce(rh BETWEEN 60 AND 88, false) AS c FROM w)
  SELECT series, ds, CASE WHEN a THEN 'Sesuai' ELSE 'Tidak Sesuai' END AS rr_fit,
  CASE WHEN b THEN 'Sesuai' ELSE 'Tidak Sesuai' END AS tavg_fit,
  CASE WHEN c THEN 'Sesuai' ELSE 'Tidak Sesuai' END AS rh_fit,
  CASE WHEN rr < 20 THEN 'Hujan Ringan' ELSE 'Hujan Sedang' END AS rain_class,
  CASE WHEN CAST(NOT a AS INT) + CAST(NOT b AS INT) + CAST(NOT c AS INT) >= 2 THEN 'Bera' ELSE 'Tanam' END
  AS decision FROM f""")
def majority_decision(spark, sf):
    limits = {"rr": (5.0, 17.0), "tavg": (20.0, 29.0), "rh": (60.0, 88.0)}
    return D.majority_decision(_weather(spark, sf), limits).select(
        "series", "ds", "rr_fit", "tavg_fit", "rh_fit", "rain_class", "decision")


@query("decision_code", f"""WITH {WEATHER}, {BASIC}, dc AS (SELECT series, ds, {BASIC_DECISION} AS decision FROM sc)
  SELECT series, ds, decision, CAST(CASE decision WHEN 'Tanam' THEN 3 WHEN 'Tanam (Waspada)' THEN 2 WHEN 'Bera' THEN 1
  WHEN 'Bera (Risiko Tinggi)' THEN 0 WHEN 'Percepat Panen (Risiko Hujan)' THEN 4 END AS INTEGER) AS code
  FROM dc""")
def decision_code(spark, sf):
    rows = D.advise(_weather(spark, sf), "basic").select("series", "ds", "decision")
    return rows.withColumn("code", D.decision_code(F.col("decision")))


ADVICE = S.M1G + f""", a0 AS (SELECT series, ds, CAST(rr IS NULL AS INTEGER) AS rain_missing, {_filled('rr')},
  {_filled('tavg')}, {_filled('rh')} FROM m1g
  WINDOW f AS (PARTITION BY series ORDER BY ds ROWS UNBOUNDED PRECEDING),
  b AS (PARTITION BY series ORDER BY ds DESC ROWS UNBOUNDED PRECEDING)),
w AS (SELECT series, ds, rain_missing, round(avg(rr) OVER s, 6) AS rr, round(avg(tavg) OVER s, 6) AS tavg,
  round(avg(rh) OVER s, 6) AS rh FROM a0
  WINDOW s AS (PARTITION BY series ORDER BY ds ROWS 6 PRECEDING))"""


@query("planting_advice", f"""WITH {ADVICE}, {MONTHLY} SELECT series, ds, rr, tavg, rh, score, {JOINED} AS category,
  {MONTHLY_DECISION} AS decision FROM sc""")
def planting_advice(spark, sf):
    """Daily grid, missing flag, fill, weekly mean, classes, score and decision."""
    rows = S.m1_grid(spark, sf).withColumn("rain_missing", V.missing_flag(F.col("rr")))
    rows = W.fill_both_all(rows, ("rr", "tavg", "rh"))
    for v in ("rr", "tavg", "rh"):
        rows = W.sma(rows, 7, min_periods=1, value=v, out=f"{v}_mean")
    means = {v: F.round(f"{v}_mean", 6) for v in ("rr", "tavg", "rh")}
    return D.advise(rows.withColumns(means)).select(
        "series", "ds", "rr", "tavg", "rh", "score", "category", "decision")
