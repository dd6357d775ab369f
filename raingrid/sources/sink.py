"""Writers for finished series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame


def dated(name: str, day: dt.date) -> str:
    return f"{name}_{day:%Y%m%d}"


def write_series(df: DataFrame, path: str, by=(), kind="csv", mode="errorifexists") -> None:
    """Partitioned CSV with header, or Parquet, one folder per ``by`` value.

    Rows are brought together by ``by`` first, or every task would write a file of every value.
    The rebalance lets Spark split what one value has too much of, so a hot station is written by
    many tasks.
    """
    rows = df.hint("rebalance", *by) if by else df
    writer = rows.write.mode(mode).partitionBy(*by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
