"""Shared plumbing: Arrow batches in bounded slices, shared tables, stable remainders."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty string."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text) % modulus


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES):
    """Row slices of a batch with about ``limit`` bytes of text each, one row at least."""
    sizes = batch.column(batch.schema.get_field_index(text))
    lengths = pc.binary_length(sizes).fill_null(0).to_pylist()
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_slices(
    df: DataFrame,
    fn: Callable[[dict], dict],
    schema: str,
    text: str = "text",
) -> DataFrame:
    """Run ``fn`` over column lists of bounded slices; ``fn`` returns column lists.

    Nothing larger than one slice and its results is held by a task, whatever the size of
    the partition. Lists of the result may have another length than those of the input.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(T.StructType.fromDDL(schema))  # here, since tasks have no JVM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return map_batches(df, run, schema)


def filter_texts(df: DataFrame, wanted: Callable[[list], list]) -> DataFrame:
    """Rows whose text ``wanted`` accepts (a list of booleans for a list of texts), as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                mask = wanted(part.column(part.schema.names.index("text")).to_pylist())
                yield part.filter(pa.array(mask, pa.bool_()))

    return map_batches(df, run, df.schema)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` whose workers can import this package even where it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return df.mapInArrow(run, schema)


def documents(spark, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")
