"""Planting and harvest decisions.

The rules are tables in ``fixed``; the functions here turn them into ``when``
expressions over the columns ``rr``, ``tavg`` and ``rh``.
"""

from __future__ import annotations

import datetime as dt
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.functions import values as V
from raingrid.operators.common import BY, forward, whole_series

VARIABLES = ("rr", "tavg", "rh")


def classify(col: Column, variable: str, unavailable: Column | None = None,
             no_data: str = fixed.NO_DATA) -> Column:
    """Class label of one variable; ``unavailable`` marks rain known to be missing."""
    low, high, below, inside, above = fixed.CLASSES[variable]
    expr = F.when(col.isNull(), no_data)
    if unavailable is not None:
        expr = expr.when(unavailable == 1, fixed.RAIN_UNAVAILABLE)
    return expr.when(col < low, below).when(col <= high, inside).otherwise(above)


def with_status(df: DataFrame, flag: str | None = None, no_data=fixed.NO_DATA) -> DataFrame:
    """Adds ``rr_status``, ``tavg_status`` and ``rh_status``."""
    marks = {"rr": F.col(flag) if flag else None}
    return df.withColumns({
        f"{v}_status": classify(F.col(v), v, marks.get(v), no_data) for v in VARIABLES})


def _is(variable: str, position: int) -> Column:
    """Status equals the below (2), inside (3) or above (4) label of the variable."""
    return F.col(f"{variable}_status") == fixed.CLASSES[variable][position]


def _any_null() -> Column:
    return F.col("rr").isNull() | F.col("tavg").isNull() | F.col("rh").isNull()


def category_joined() -> Column:
    return F.concat_ws(" / ", *[F.col(f"{v}_status") for v in VARIABLES])


def category_listed() -> Column:
    """The statuses that are not optimal, or ``Optimal``."""
    every = F.array(*[F.col(f"{v}_status") for v in VARIABLES])
    text = F.array_join(F.filter(every, lambda s: s != "Optimal"), ", ")
    nothing = F.col("rr").isNull() & F.col("tavg").isNull() & F.col("rh").isNull()
    return F.when(nothing, fixed.NO_DATA).when(text == "", "Optimal").otherwise(text)


def _points() -> Column:
    return sum((F.when(_is(v, 3), w).otherwise(0) for v, w in fixed.WEIGHTS.items()), F.lit(0))


def score_basic() -> Column:
    return F.when(_any_null(), 0).otherwise(_points())


def score_graded() -> Column:
    """Full weight when optimal, part of it when close."""
    rr, tavg, rh = F.col("rr"), F.col("tavg"), F.col("rh")
    rain = F.when(_is("rr", 3), 40).when((rr < 2) & (rr >= 1), 20).otherwise(0)
    heat = (F.when(_is("tavg", 3), 40)
            .when(((tavg >= 18) & (tavg < 20)) | ((tavg > 35) & (tavg <= 37)), 30).otherwise(0))
    damp = F.when(_is("rh", 3), 20).when((rh > 90) & (rh <= 95), 10).otherwise(0)
    return rain + heat + damp


def season_class(ds: Column, kind: str) -> Column:
    """Wet, Dry or Transition of a date under the monthly or seasonal rules."""
    name = V.season(ds, {"monthly": "farm", "seasonal": "binned"}[kind])
    return F.when(name.startswith("Transition"), "Transition").otherwise(name)


def score_monthly(flag="rain_missing", ds="ds") -> Column:
    part = season_class(F.col(ds), "monthly")
    adjust = (
        F.when((part == "Wet") & _is("rr", 4), -15)
        .when((part == "Dry") & _is("rr", 2), -15)
        .when((part == "Dry") & _is("rr", 3), 10).otherwise(0))
    missing = F.when(F.col(flag) == 1, -25).otherwise(0)
    return F.when(_any_null(), 0).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), _points() + missing + adjust)))


def score_seasonal(flag="rain_missing", ds="ds") -> Column:
    part = season_class(F.col(ds), "seasonal")
    base = _points()
    adjusted = (
        F.when(part == "Wet", base * F.lit(0.95))
        .when((part == "Dry") & _is("rr", 3), base + 5.0)
        .when((part == "Dry") & _is("rr", 2), base - 10.0).otherwise(base.cast("double")))
    missing = F.when(F.col(flag) == 1, -15.0).otherwise(0.0)
    return F.when(_any_null(), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), adjusted + missing)))


def _plant_or_wait(score: Column) -> Column:
    return F.when(score >= 70, "Tanam").when(score >= 50, "Tanam (Waspada)").otherwise("Bera")


def decide_basic(score="score") -> Column:
    risky = _is("rr", 4) | _is("tavg", 4)
    return (F.when(_any_null(), "Bera").when(risky, "Bera (Risiko Tinggi)")
            .otherwise(_plant_or_wait(F.col(score))))


def decide_graded(score="score") -> Column:
    soaked = _is("rh", 4) & F.coalesce(F.col("rr") > 10, F.lit(False))
    return (F.when(_is("rr", 4) | _is("tavg", 4) | soaked, "Bera")
            .otherwise(_plant_or_wait(F.col(score))))


def decide_by_season(kind: str, score="score", flag="rain_missing", ds="ds") -> Column:
    """Decision by monthly or seasonal bands, after the overriding risks."""
    part = season_class(F.col(ds), kind)
    unknown = F.when(part == "Dry", fixed.UNKNOWN_RAIN_DRY[kind]).otherwise(
        fixed.UNKNOWN_RAIN_CAUTION)
    expr = (F.when(_any_null(), fixed.INCOMPLETE).when(_is("rr", 4), fixed.FLOOD)
            .when(_is("tavg", 4), fixed.HOT).when(F.col(flag) == 1, unknown))
    for name, (high, low, plant, careful, fallow) in fixed.DECISION_BANDS[kind].items():
        s = F.col(score)
        expr = expr.when(part == name, F.when(s >= high, plant).when(s >= low, careful)
                         .otherwise(fallow))
    return expr


def advise(df: DataFrame, rules="monthly", flag="rain_missing") -> DataFrame:
    """Status, category, score and decision under one named rule set."""
    if rules == "graded":
        rows = with_status(df, no_data=fixed.NO_DATA_RISK)
        rows = rows.withColumn("score", score_graded()).withColumn("category", category_listed())
        return rows.withColumn("decision", decide_graded())
    rows = with_status(df, None if rules == "basic" else flag)
    score = {"basic": score_basic, "monthly": score_monthly, "seasonal": score_seasonal}[rules]()
    decision = decide_basic() if rules == "basic" else decide_by_season(rules, flag=flag)
    return (rows.withColumn("score", score).withColumn("category", category_joined())
            .withColumn("decision", decision))


def _growth_days(planted: dt.date, kind: str | None) -> int:
    if kind is None:
        return fixed.GROWTH_DAYS["Transition"]
    scheme = fixed.SEASONS[{"monthly": "farm", "seasonal": "binned"}[kind]]
    name = next(n for n, months in scheme.items() if planted.month in months)
    return fixed.GROWTH_DAYS.get(name, fixed.GROWTH_DAYS["Transition"])


def harvest_override(df: DataFrame, planted: dt.date, kind: str | None = "monthly",
                     season_labels=False, days=7, by=BY, ds="ds") -> DataFrame:
    """Replace the decision in the last ``days`` before harvest.

    Nothing changes where the harvest day is not among the dates. With ``kind``
    None the growth is fixed and the rain label is the short one. The labels that
    depend on the season of harvest only apply with ``season_labels``.
    """
    due = planted + dt.timedelta(days=_growth_days(planted, kind))
    inside = F.col(ds).between(F.lit(due - dt.timedelta(days=days - 1)), F.lit(due))
    w = whole_series(by)
    rows = df.withColumns({
        "_due": F.bool_or(F.col(ds) == F.lit(due)).over(w),
        "_wet": F.coalesce(F.bool_or(inside & (F.col("rr") > 10)).over(w), F.lit(False)),
        "_first": F.min(F.when(inside, F.col(ds))).over(w)})
    early = fixed.HARVEST_EARLY if kind else fixed.WINDOW_LABELS["rain"][0]
    label = F.when(F.col("_wet"), early).otherwise(fixed.HARVEST_ON_TIME)
    if season_labels:
        part = season_class(F.col("_first"), kind)
        label = (F.when(F.col("_wet") & (part == "Wet"), fixed.HARVEST_EARLY_WET)
                 .when(F.col("_wet"), early).when(part == "Dry", fixed.HARVEST_ON_TIME_DRY)
                 .otherwise(fixed.HARVEST_ON_TIME))
    return rows.withColumn("decision", F.when(F.col("_due") & inside, label).otherwise(
        F.col("decision"))).drop("_due", "_wet", "_first")


def _window_advice(planted: dt.date, first, last, buffer, ds):
    """Whether a day lies in the watched window, and the recommendation for it."""
    start, end = planted + dt.timedelta(days=first), planted + dt.timedelta(days=last)
    core = F.col(ds).between(F.lit(start), F.lit(end))
    wide = F.col(ds).between(F.lit(start - dt.timedelta(days=buffer)),
                             F.lit(end + dt.timedelta(days=buffer)))
    pick = lambda name: F.when(core, fixed.WINDOW_LABELS[name][0]).otherwise(
        fixed.WINDOW_LABELS[name][1])
    advice = (F.when(F.col("rr") > 10, pick("rain")).when(F.col("rh") > 90, pick("humid"))
              .otherwise(pick("calm")))
    return wide, advice


def harvest_window(df: DataFrame, planted: dt.date, first=90, last=100, buffer=7,
                   ds="ds") -> DataFrame:
    """Recommendation per day around the harvest window; no rows outside it."""
    wide, advice = _window_advice(planted, first, last, buffer, ds)
    return df.where(wide).withColumn("recommendation", advice)


def apply_harvest_window(df: DataFrame, planted: dt.date, first=90, last=100, buffer=7,
                         ds="ds") -> DataFrame:
    """Decisions replaced by the window's recommendation where that speaks of harvest."""
    wide, advice = _window_advice(planted, first, last, buffer, ds)
    return df.withColumn("decision", F.when(wide & advice.contains("Panen"), advice).otherwise(
        F.col("decision")))


def growth_days(planted: Column, kind: str | None = "monthly") -> Column:
    """Days from planting to harvest by the season of the planting month."""
    rest = F.lit(fixed.GROWTH_DAYS["Transition"])
    if kind is None:
        return rest
    part, out = season_class(planted, kind), rest
    for name, days in fixed.GROWTH_DAYS.items():
        out = F.when(part == name, days).otherwise(out)
    return out


def harvest_overrides(df: DataFrame, plantings: DataFrame, kind: str | None = "monthly",
                      season_labels=False, days=7, by=BY, ds="ds") -> DataFrame:
    """``harvest_override`` for any number of plantings of any series.

    ``plantings`` has ``by`` and ``planted``; repeated rows count once, and rows without a date
    not at all. The last ``days`` before each harvest get its label, if the day of harvest is among
    the dates of the series; where two harvests cover a day, that planted later counts. The
    plantings are spread over their few days and meet the rows by series and day.
    """
    due = F.date_add("planted", growth_days(F.col("planted"), kind))
    covered = plantings.select(*by, "planted").where("planted IS NOT NULL").distinct().withColumn(
        "_due", due).withColumn("_day", F.explode(F.sequence(F.date_sub("_due", days - 1), F.col("_due"))))
    covered = covered.withColumnRenamed("_day", ds).join(df.select(*by, ds, "rr"), [*by, ds])
    season = Window.partitionBy(*by, "planted")
    covered = covered.withColumns({
        "_there": F.bool_or(F.col(ds) == F.col("_due")).over(season),
        "_wet": F.coalesce(F.bool_or(F.col("rr") > 10).over(season), F.lit(False)),
        "_first": F.min(ds).over(season)}).where("_there")
    early = fixed.HARVEST_EARLY if kind else fixed.WINDOW_LABELS["rain"][0]
    label = F.when(F.col("_wet"), early).otherwise(fixed.HARVEST_ON_TIME)
    if season_labels:
        part = season_class(F.col("_first"), kind)
        label = (F.when(F.col("_wet") & (part == "Wet"), fixed.HARVEST_EARLY_WET)
                 .when(F.col("_wet"), early).when(part == "Dry", fixed.HARVEST_ON_TIME_DRY)
                 .otherwise(fixed.HARVEST_ON_TIME))
    labels = covered.groupBy(*by, ds).agg(F.max_by(label, "planted").alias("_label"))
    return df.join(labels, [*by, ds], "left").withColumn(
        "decision", F.coalesce("_label", "decision")).select(*df.columns)


def harvest_windows(df: DataFrame, plantings: DataFrame, first=90, last=100, buffer=7, by=BY,
                    ds="ds") -> DataFrame:
    """``harvest_window`` for any number of plantings: a row for each planting and watched day,
    with ``planted`` and ``recommendation``. Repeated plantings count once."""
    watched = plantings.select(*by, "planted").where("planted IS NOT NULL").distinct().withColumn(
        "_n", F.explode(F.sequence(F.lit(first - buffer), F.lit(last + buffer))))
    watched = watched.withColumn(ds, F.date_add("planted", F.col("_n")))
    core = F.col("_n").between(first, last)
    pick = lambda name: F.when(core, fixed.WINDOW_LABELS[name][0]).otherwise(
        fixed.WINDOW_LABELS[name][1])
    advice = (F.when(F.col("rr") > 10, pick("rain")).when(F.col("rh") > 90, pick("humid"))
              .otherwise(pick("calm")))
    return df.join(watched, [*by, ds]).withColumn("recommendation", advice).select(
        *df.columns, "planted", "recommendation")


def monthly_suitability(df: DataFrame, rules=fixed.SUITABILITY, missing_limit_counts=False, by=BY,
                        ds="ds") -> DataFrame:
    """Month means, a half point per limit kept, and the weighted share.

    A variable without an upper limit can reach only half, unless
    ``missing_limit_counts``.
    """
    means = df.groupBy(*by, F.trunc(ds, "month").alias("period")).agg(
        *[F.avg(v).alias(v) for v in rules])
    half = lambda test: F.when(test, 0.5).otherwise(0.0)
    points = {}
    for v, (low, high, _) in rules.items():
        free = F.lit(0.5 if missing_limit_counts else 0.0)
        points[v] = ((free if low is None else half(F.col(v) >= low))
                     + (free if high is None else half(F.col(v) <= high)))
    rows = means.withColumns({f"{v}_suitable": p for v, p in points.items()})
    weights = sum(w for *_, w in rules.values())
    score = sum((F.col(f"{v}_suitable") * w for v, (_, _, w) in rules.items()), F.lit(0.0))
    return rows.withColumn("suitability", score / weights)


def planting_calendar(df: DataFrame, threshold=0.7, grow_days=95, by=BY, period="period",
                      out="decision") -> DataFrame:
    """Plant where this month and the harvest month are suitable, then harvest.

    Whether a month is planted depends on suitability alone, so two windows do it.
    """
    months = grow_days // 30
    order = forward(by, period)
    fit = F.coalesce(F.col("suitability") >= threshold, F.lit(False))
    rows = df.withColumn("_fit", fit).withColumn(
        "_plant", F.col("_fit") & F.coalesce(F.lead("_fit", months).over(order), F.lit(False)))
    grown = F.coalesce(F.bool_or("_plant").over(order.rowsBetween(-months, -1)), F.lit(False))
    names = fixed.CALENDAR_LABELS
    return rows.withColumn(out, F.when(F.col("_plant"), names["plant"])
                           .when(F.col("_fit"), names["unfit"])
                           .when(grown, names["harvest"]).otherwise(names["fallow"])
                           ).drop("_fit", "_plant")


def majority_decision(df: DataFrame, limits: dict[str, tuple[float, float]],
                      light_rain=20.0) -> DataFrame:
    """Yes or no per variable; plant unless two or more fail. Adds the rain class."""
    fits = {v: F.col(v).between(*limits[v]) for v in VARIABLES}
    names = {f"{v}_fit": F.when(t, "Sesuai").otherwise("Tidak Sesuai") for v, t in fits.items()}
    failed = sum((F.when(t, 0).otherwise(1) for t in fits.values()), F.lit(0))
    return df.withColumns({
        **names,
        "rain_class": F.when(F.col("rr") < light_rain, "Hujan Ringan").otherwise("Hujan Sedang"),
        "decision": F.when(failed >= 2, "Bera").otherwise("Tanam")})


def decision_code(col: Column, codes=fixed.DECISION_CODES) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])
    return F.try_element_at(table, col)


def decision_string(df: DataFrame, by=BY, period="period", decision="decision") -> DataFrame:
    """Decisions in date order joined by ``;``, one line per series."""
    pairs = F.sort_array(F.collect_list(F.struct(period, decision)))
    return df.groupBy(*by).agg(F.array_join(pairs[decision], ";").alias("decisions"))
