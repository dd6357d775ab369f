"""Mooring text: blocks with their own headers, values with quality and source codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.functions import values as V
from raingrid.sources.lines import carry_down, read_lines

DATA_LINE = r"^\s*\d{8}\s+\d{4}\s"
NAME_LINE = r"^\s*YYYYMMDD\s+HHMM"
DEPTH_LINE = r"^\s*Depth\s*\(M\):"
FILE_NAME = r"(rain|rad|rh|sst|t|w)(\d+[ns]\d+[ew])_dy"


def route_by_file(path: Column, header: Column | None = None):
    """Variable and station from the file name, else the variable from header words."""
    code = F.regexp_extract(path, FILE_NAME, 1)
    variable = (F.when(code == "t", "temp").when(code == "w", "wind")
                .when(code != "", code))
    if header is not None:
        text = F.upper(header)
        depths = F.size(F.filter(F.split(text, r"\s+"), lambda x: x.rlike(r"^\d+(\.\d+)?$")))
        guess = (F.when(text.rlike("UWND|VWND|WSPD|WDIR"), "wind")
                 .when(text.contains("DEPTH(M):") & (depths > 2), "temp")
                 .when(text.contains("DEPTH(M):"), "sst")
                 .when(text.contains("RAIN"), "rain").when(text.contains("RH"), "rh")
                 .when(text.contains("RAD"), "rad").otherwise("general"))
        variable = F.coalesce(variable, guess)
    return variable, F.upper(F.nullif(F.regexp_extract(path, FILE_NAME, 2), F.lit("")))


def depth_columns(header: Column) -> Column:
    """Map from depth in metres to position, from a ``Depth`` line.

    Words after the depths (quality, source) are left out; the first of equal
    depths keeps its position.
    """
    words = F.split(F.trim(F.regexp_replace(header, DEPTH_LINE, "")), r"\s+")
    depths = F.filter(F.transform(words, lambda w: w.try_cast("double")), lambda d: d.isNotNull())
    return F.map_from_arrays(F.array_distinct(depths), F.transform(
        F.array_distinct(depths), lambda d: F.array_position(depths, d).cast("int") - 1))


def depth_value(tokens: Column, depths: Column, depth: float) -> Column:
    """Token of one depth; null where the block has no such depth."""
    place = F.try_element_at(depths, F.lit(float(depth)))
    return F.when(place.isNotNull(), F.get(tokens, place))


def parse_mooring_lines(lines: DataFrame, depths: tuple | None = None) -> DataFrame:
    """One row per value: station, variable, name, depth, ds, token, value, q, s.

    Each data line is read with the column line and the depth line of its own
    block; those are taken apart once per header and carried down as arrays. One
    code digit serves all values, one digit per value is matched by position, and
    with two wind digits the second is the direction's. ``depths`` limits
    temperature to these depths.
    """
    text = F.col("line")
    words = lambda c: F.split(F.trim(c), r"\s+")
    values = F.filter(words(text), lambda w: ~w.rlike(r"^(YYYYMMDD|HHMM|Q+|S+|SD)$"))
    levels = F.filter(
        F.transform(words(F.regexp_replace(text, DEPTH_LINE, "")), lambda w: w.try_cast("double")),
        lambda d: d.isNotNull())
    # Other lines are dropped before the shuffle that carries headers down.
    lines = lines.where(text.rlike(DATA_LINE) | text.rlike(NAME_LINE) | text.rlike(DEPTH_LINE))
    rows = carry_down(lines, {
        "names": F.when(text.rlike(NAME_LINE), values),
        "level": F.when(text.rlike(DEPTH_LINE), levels)}, text.rlike(DATA_LINE))
    header = F.concat(F.lit("Depth(M): "), F.concat_ws(" ", F.col("level").cast("array<string>")),
                      F.lit(" "), F.concat_ws(" ", "names"))
    variable, station = route_by_file(F.col("path"), header)
    rows = rows.select(variable.alias("variable"), station.alias("station"), "names", "level",
                       F.size("names").alias("k"), words(text).alias("t"))
    long = rows.select(
        "station", "variable", F.to_date(F.try_to_timestamp(F.col("t")[0], F.lit("yyyyMMdd")))
        .alias("ds"), "k", F.get("t", F.col("k") + 2).alias("codes_q"),
        F.get("t", F.col("k") + 3).alias("codes_s"), "level",
        F.posexplode(F.arrays_zip(
            F.col("names").alias("name"), F.slice("t", F.lit(3), F.col("k")).alias("token")))
        .alias("i", "x"))

    def code(col):
        c, i = F.col(col), F.col("i")
        place = (F.when(F.length(c) == F.col("k"), i + 1)
                 .when((F.length(c) == 2) & (F.col("x.name") == "WDIR"), 2).otherwise(1))
        return F.substring(c, place, F.lit(1)).try_cast("int")

    value = V.coerce_numeric(F.col("x.token"))
    missing = None
    for name, mark in fixed.MOORING_MISSING.items():
        test = (F.col("variable") == name) & (value == mark)
        missing = test if missing is None else missing | test
    out = long.select(
        "station", "variable", F.col("x.name").alias("name"),
        F.get("level", F.col("i")).alias("depth"), "ds", F.col("x.token").alias("token"),
        F.when(~F.coalesce(missing, F.lit(False)), value).alias("value"),
        code("codes_q").alias("q"), code("codes_s").alias("s"))
    if depths is not None:
        out = out.where((F.col("variable") != "temp") | F.col("depth").isin(*depths))
    return out


def read_mooring_text(spark: SparkSession, path, depths: tuple | None = None) -> DataFrame:
    return parse_mooring_lines(read_lines(spark, path), depths)
