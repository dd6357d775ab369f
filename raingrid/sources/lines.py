"""Text lines with a position, read in parallel whatever the file sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raingrid.session import written


#: Setting of Spark that gives each of up to 10,000 folders a task of its own for its listing.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession, path) -> DataFrame:
    """Text files below ``path``, whose folders are listed by a few tasks, many folders each."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, min(int(before), max(32, 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.text(path)
    finally:
        spark.conf.set(LISTING, before)


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Columns ``path``, ``block``, ``pos`` and ``line``; comparable within a file.

    A large file is split: ``block`` is the byte offset of the split and ``pos``
    rises with the line inside it, so (block, pos) orders the lines of a file
    without reading the file in one task.
    """
    return _listed(spark, path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"))


#: Header lines up to which their positions and contents are sent to every task.
SENT_HEADERS = 100_000


def _latest(at: Column, here: Column) -> Column:
    """The last entry of the sorted array ``at`` below ``here``, by binary search."""
    span = F.struct(F.lit(0).alias("lo"), F.size(at).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(at, mid) < here
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(at) + 1.0)).cast("int"))
    return F.aggregate(steps, span, halve, lambda s: F.get(at, s["lo"] - 1))


def carry_down(lines: DataFrame, carried: dict[str, Column], keep: Column,
               sent: int = SENT_HEADERS) -> DataFrame:
    """Latest value of each ``carried`` expression above every kept line of a file.

    Lines with such a value are read first, written and counted while the plan is built. Up to
    ``sent`` of them go to every task, where a kept line finds its own by position; the lines
    themselves stay where they were read. With more, values are carried by ``_carry_by_window``.
    """
    order = Window.partitionBy("path").orderBy("block", "pos").rowsBetween(
        Window.unboundedPreceding, 0)
    marked = None
    for e in carried.values():
        marked = e.isNotNull() if marked is None else marked | e.isNotNull()
    found = lines.where(marked).select("path", "block", "pos", *[e.alias(n) for n, e in carried.items()])
    heads = written(found.withColumns({
        n: F.last(n, ignorenulls=True).over(order) for n in carried}), "headers")
    if heads.count() > sent:
        return _carry_by_window(lines, carried, keep)
    places = heads.groupBy(F.col("path").alias("_path")).agg(
        F.sort_array(F.collect_list(F.struct("block", "pos"))).alias("_at"))
    here = F.struct("block", "pos")
    rows = lines.where(keep).join(F.broadcast(places), F.col("path") == F.col("_path"), "left")
    rows = rows.withColumn("_own", F.when(F.col("_at").isNotNull(), _latest(F.col("_at"), here)))
    own = heads.select(F.struct("path", "block", "pos").alias("_key"), *carried)
    key = F.struct("path", F.col("_own.block").alias("block"), F.col("_own.pos").alias("pos"))
    return rows.withColumn("_mine", key).join(F.broadcast(own), F.col("_mine") == F.col("_key"), "left").select(
        "path", "block", "pos", "line", *carried)


def _carry_by_window(lines: DataFrame, carried: dict[str, Column], keep: Column) -> DataFrame:
    """Latest value of each ``carried`` expression above every kept line of a file.

    Inside a split a window carries it. Across splits only the last value of each
    split travels: one small row per split, carried over the splits of the file.
    """
    order = Window.partitionBy("path", "block").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0)
    found = lines.withColumns({f"_f_{n}": e for n, e in carried.items()})
    ends = found.groupBy("path", "block").agg(*[
        F.max_by(f"_f_{n}", F.when(F.col(f"_f_{n}").isNotNull(), F.col("pos"))).alias(f"_e_{n}")
        for n in carried])
    above = Window.partitionBy("path").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    before = ends.select("path", "block", *[
        F.last(f"_e_{n}", ignorenulls=True).over(above).alias(f"_b_{n}") for n in carried])
    inside = found.withColumns({
        n: F.last(f"_f_{n}", ignorenulls=True).over(order) for n in carried}).where(keep)
    return inside.join(before, ["path", "block"]).withColumns({
        n: F.coalesce(F.col(n), F.col(f"_b_{n}")) for n in carried}).select(
        "path", "block", "pos", "line", *carried)
