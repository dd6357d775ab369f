"""Station sheets: daily CSV files and text exports of monthly sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raingrid import fixed
from raingrid.functions import values as V
from raingrid.sources.lines import carry_down, read_lines

NUMBERS = ("TN", "TX", "TAVG", "RH_AVG", "RR", "SS", "FF_X", "DDD_X", "FF_AVG")
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "yyyyMMdd HHmm")


def read_station_csv(spark: SparkSession, path, sentinels=fixed.SENTINELS) -> DataFrame:
    """Daily station rows of all files, typed, without exact duplicates.

    Columns are found by the names in each file's own header line, so files may order them
    differently; a missing column is null. Cells are plain, without quoted commas. Read as
    text and cast, so a bad cell becomes null and not a lost row. A ``station=...`` folder
    becomes the column ``station``. Sort where an ordered output is wanted; the rows
    themselves stay unsorted to spare a shuffle.
    """
    plain = lambda c: F.trim(F.when(c.contains('"'), F.regexp_replace(c, '^"|"$', "")).otherwise(c))
    cells = F.split("line", ",")
    names = F.transform(cells, plain)
    # The word comes first, so that the cells of data lines are not all rewritten to look for it.
    is_header = F.col("line").contains("Date") & F.array_contains(names, "Date")
    # Where a header has the wanted columns (0 for nowhere), so that no data line looks for names.
    wanted = (*NUMBERS, "Date", "DDD_CAR")
    places = F.array(*[F.array_position(names, c).cast("int") for c in wanted])
    # What lies below a header takes the folder from it too; what does not has no date.
    folder = F.regexp_extract("path", "/station=([^/]+)/", 1)
    rows = carry_down(read_lines(spark, path), {
        "header": F.when(is_header, places),
        "station": F.when(is_header, F.url_decode(F.when(folder != "", folder)))}, ~is_header)
    # Arrays of cells, texts and numbers, so that each is worked out once and not at each mention.
    cells = F.transform(F.array(cells), lambda all_: F.transform(
        "header", lambda at: plain(F.get(all_, at - 1))))[0]
    raw = rows.select("station", cells.alias("cells"))
    numbers = F.transform(F.slice("cells", 1, len(NUMBERS)), lambda c: V.text_missing_to_null(c))
    numbers = F.transform(numbers, lambda c: c.try_cast("double"))
    numbers = F.transform(numbers, lambda c: V.sentinel_to_null(V.coerce_numeric(c), sentinels))
    date, name = F.get("cells", F.lit(len(NUMBERS))), F.get("cells", F.lit(len(NUMBERS) + 1))
    return raw.withColumn("numbers", numbers).select(
        "station", V.parse_date_multi(date, DATE_FORMATS).alias("ds"),
        *[F.get("numbers", F.lit(i)).alias(c) for i, c in enumerate(NUMBERS)],
        V.text_missing_to_null(name).alias("DDD_CAR")).where(F.col("ds").isNotNull()).dropDuplicates()


def clean_sheet_rows(lines: DataFrame, key="TANGGAL", stop="KETERANGAN", within=10,
                     separator=",") -> DataFrame:
    """Data rows of a sheet export: ``path``, ``header`` and ``cells`` arrays.

    The header is the first of the first ``within`` rows that has ``key``; the
    data end at the first blank row, blank first cell or ``stop`` row after it.
    Files without a header give no rows. Header and end are positions found by
    aggregates per file; no file is sorted in one task.
    """
    place = F.struct("block", "pos")
    cells = F.split("line", separator)
    rows = lines.withColumns({"cells": cells, "at": place})
    first = rows.where(F.col("block") == 0)
    top = Window.partitionBy("path").orderBy("pos")
    heads = (first.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= within)
             .where(F.array_contains(F.transform("cells", F.trim), key))
             .groupBy("path").agg(F.min_by("cells", "at").alias("header"),
                                  F.min("at").alias("head_at")))
    below = rows.join(heads, "path").where(F.col("at") > F.col("head_at"))
    first_cell = F.trim(F.col("cells")[0])
    empty = ~F.exists("cells", lambda c: V.text_missing_to_null(c).isNotNull())
    ends = below.where(empty | (first_cell == "") | first_cell.contains(stop)).groupBy(
        "path").agg(F.min("at").alias("end_at"))
    kept = below.join(ends, "path", "left").where(
        F.col("end_at").isNull() | (F.col("at") < F.col("end_at")))
    return kept.select("path", F.transform("header", F.trim).alias("header"), "cells")


def read_sheet_text(spark: SparkSession, path, columns: tuple[str, ...], **options) -> DataFrame:
    """Sheet exports as columns by header name; missing columns are null."""
    rows = clean_sheet_rows(read_lines(spark, path), **options)
    at = {c: F.array_position("header", F.lit(c)).cast("int") for c in columns}
    return rows.select("path", *[
        F.when(at[c] > 0, V.text_missing_to_null(F.get("cells", at[c] - 1))).alias(c)
        for c in columns])
