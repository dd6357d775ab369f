"""Lines that many documents share, dropped everywhere but in one document.

Normalised lines are exploded and hashed, distinct documents are counted per hash, and what is
left of each document is put together again by position. Only hashes and positions are grouped by
line; the texts themselves cross the network once, to meet their dropped positions. All of it is
built from DataFrame functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raingrid.llm import frames
from raingrid.session import written

BLANKS = " \t\n\x0b\x0c\r"
#: Lines that make up at least one part in so many of all common lines are sent to every task; so
#: there are never more of them than this, and no other line is too frequent for a shuffled join.
HOT_PARTS = 4096


def _lines(text) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _fold(line: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    ascii_only = F.length(line) == F.octet_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(
        F.translate(line, string.ascii_uppercase, string.ascii_lowercase))


def _keyed(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, text_key, pos and a 128-bit hash (h1, h2) of every line that is long enough."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                       F.posexplode(_lines("text")).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    long_enough = rows.select("doc_id", "text_key", "pos", key.alias("key")).where(
        F.length("key") >= least_chars)
    key = _fold(F.col("key"))
    return long_enough.select("doc_id", "text_key", "pos", F.xxhash64(key).alias("h1"),
                              F.xxhash64(F.lit(1), key).alias("h2"))


def common_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """h1, h2, n and keeper of every line key that ``least_docs`` documents hold: how many do, and
    the largest doc_id of them. All rows without an id count as one document."""
    nameless = F.max(F.col("doc_id").isNull().cast("int"))
    return _keyed(docs, least_chars).groupBy("h1", "h2").agg(
        (F.count_distinct("doc_id") + nameless).alias("n"), F.max("doc_id").alias("keeper")
    ).where(F.col("n") >= least_docs)


def drop_common_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc_id, text, n_lines and n_dropped for every row of ``docs``.

    A text is split at line feeds; the key of a line is the line without blanks at both ends and
    with A-Z folded. Keys of ``least_chars`` code points or more that ``least_docs`` documents or
    more hold lose all their lines but in the largest doc_id that holds them; there every one
    stays, however often it repeats. The other lines stay as they are, in their order.

    Documents are told by doc_id: rows that repeat an id count once, keep or lose a line together
    and are all answered. Rows without an id count as one document and never are the keeper. A null
    or empty text is one empty line. A document that loses every line has an empty text. An empty
    table gives no rows; other columns of ``docs`` are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    common = written(common_lines(docs, least_chars, least_docs), "common-lines")
    total = common.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_PARTS >= total
    hot = common.where(is_hot).select("h1", "h2", F.col("keeper").alias("hot_keeper"),
                                      F.lit(True).alias("is_hot"))
    cold = common.where(~is_hot).select("h1", "h2", F.col("keeper").alias("cold_keeper"),
                                        F.lit(True).alias("is_cold"))
    # A line that has met its keeper in the sent table goes on under a key of its own, so frequent
    # lines spread over all tasks of the second join, where they match nothing.
    alone = F.xxhash64("doc_id", "text_key", "pos")
    lines = (
        _keyed(docs, least_chars).join(F.broadcast(hot), ["h1", "h2"], "left")
        .withColumn("h1", F.when(F.col("is_hot"), alone).otherwise(F.col("h1")))
        .join(cold, ["h1", "h2"], "left")
    )
    lost = ((F.col("is_hot") & ~F.col("doc_id").eqNullSafe(F.col("hot_keeper")))
            | (F.col("is_cold") & ~F.col("doc_id").eqNullSafe(F.col("cold_keeper"))))
    gone = lines.where(lost).groupBy(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")
    ).agg(F.collect_set("pos").alias("gone"))

    # The split text is a column of its own before the join, so it is split once a row.
    split = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _lines("text").alias("lines"))
    rows = split.join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")),
        "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(places, lambda i: F.get("lines", i)))
    return rows.select(
        "doc_id", F.array_join(left, "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op11_line_dedup(spark, sf: str) -> DataFrame:
    """All documents without the lines that many of them share."""
    return drop_common_lines(frames.documents(spark, sf)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP11_SQL = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM split),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
  '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM line),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS lost
  FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
