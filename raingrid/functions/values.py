"""Cleaning, dates and small numeric expressions on columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from raingrid import fixed


def sentinel_to_null(col: Column, codes: Iterable[float] = fixed.SENTINELS) -> Column:
    return F.when(~col.isin(*codes), col)


def text_missing_to_null(col: Column, tokens: Iterable[str] = fixed.SHEET_MISSING) -> Column:
    trimmed = F.trim(col)
    return F.when(~trimmed.isin(*tokens), trimmed)


def coerce_numeric(col: Column) -> Column:
    """Text to double; text that is no number becomes null, and so does NaN."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_date_multi(col: Column, formats: Iterable[str]) -> Column:
    """First format that reads the text wins; unreadable text gives null."""
    tries = [F.try_to_timestamp(col, F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("date")


def season(ds: Column, scheme: str) -> Column:
    month = F.month(ds)
    expr = None
    for name, months in fixed.SEASONS[scheme].items():
        test = month.isin(*months)
        expr = F.when(test, name) if expr is None else expr.when(test, name)
    return expr


def bound(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to limits; a null stays null (least and greatest alone skip nulls)."""
    out = col
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(col.isNotNull(), out)


def missing_flag(col: Column) -> Column:
    return col.isNull().cast("int")


def whole(col: Column) -> Column:
    return col == F.floor(col)


def angle_mean(col: Column) -> Column:
    """Aggregate: mean direction of degrees, in [0, 360)."""
    rad = F.radians(col)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))), F.lit(360.0))


def angle_consistency(col: Column) -> Column:
    """Aggregate: resultant length, 0 for scattered and 1 for aligned directions."""
    rad = F.radians(col)
    return F.hypot(F.avg(F.sin(rad)), F.avg(F.cos(rad)))


def compass_name(degrees: Column) -> Column:
    names = F.array(*[F.lit(n) for n in fixed.COMPASS])
    sector = F.pmod(F.rint(degrees / 22.5).cast("int"), F.lit(len(fixed.COMPASS)))
    return F.when(degrees.isNotNull(), F.element_at(names, sector + 1))


def daylight_hours(ds: Column, latitude: float) -> Column:
    """Longest possible sunshine for the day of year, from the solar declination."""
    tilt = F.radians(23.45 * F.sin(F.radians(360.0 * (284 + F.dayofyear(ds)) / 365)))
    cosine = -F.tan(F.radians(F.lit(float(latitude)))) * F.tan(tilt)
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))) * 24 / F.pi()


def wind_from_components(u: Column, v: Column, convention: str = "from"):
    """Speed and direction; ``towards`` reads the vector as where the wind goes."""
    turn = 270.0 if convention == "from" else 90.0
    direction = F.pmod(F.lit(turn) - F.degrees(F.atan2(v, u)), F.lit(360.0))
    return F.hypot(u, v), direction


def log_shift(col: Column, c: float, kind: str = "log") -> Column:
    return F.log1p(col + c) if kind == "log1p" else F.log(col + c)


def unlog_shift(col: Column, c: float, kind: str = "log") -> Column:
    return F.expm1(col) - c if kind == "log1p" else F.exp(col) - c


def power_transform(col: Column, lam: Column) -> Column:
    """Yeo-Johnson transform of ``col`` for the parameter ``lam``."""
    near = lambda x: F.abs(x) < 1e-9
    rest = 2.0 - lam
    return F.when(
        col >= 0,
        F.when(near(lam), F.log1p(col)).otherwise((F.pow(col + 1.0, lam) - 1.0) / lam),
    ).otherwise(
        F.when(near(rest), -F.log1p(-col)).otherwise(
            -(F.pow(1.0 - col, rest) - 1.0) / rest)
    )
