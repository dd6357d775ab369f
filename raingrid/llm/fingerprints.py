"""Document fingerprints: packed one-permutation MinHash of five-word shingles."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.llm import frames, oph, textscan

BINS, BITS, WIDTH = 256, 4, 5
#: Rows that one range of ids holds on average, and the most ranges that are ever cut.
RANGE_ROWS, MOST_RANGES = 4096, 20_000


def fingerprint(text: str | None, bins: int = BINS, bits: int = BITS) -> bytes:
    """Packed bins of the text's shingles after folding A-Z; a text without words has none."""
    members = textscan.shingle_set(textscan.word_hashes((text or "").encode().lower()), WIDTH)
    return oph.packed(oph.signature(members, bins), bits) if len(members) else b""


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text, role), sorted inside a part by falling doc_id.

    The ids are cut into ranges of about equal row counts by quantiles; each range is a part.
    ``role`` is 0 for rows of the part and 1 for copies of the row that follows its last one:
    the largest id below the range, or the largest of all after the smallest. Rows of equal id
    are ordered by a hash of their text and the text. Rows without an id go to a part by a hash
    of their text. Only the ids are read to find the ranges; the texts are shuffled once.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    parts = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.approxQuantile("doc_id", shares, 0.1 / parts))) if shares else []
    placed = docs.withColumn("at", F.col("doc_id").cast("double"))
    placed = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="range",
        handleInvalid="keep").transform(placed) if cuts else placed.withColumn("range", F.lit(0.0))
    placed = placed.withColumn("part", F.when(
        F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(parts)))
        .otherwise(F.col("range")).cast("long")).drop("at", "range")
    tops = placed.where("doc_id IS NOT NULL").groupBy("part").agg(
        F.max("doc_id").alias("doc_id")).orderBy("part").collect()  # one row per range
    above = [r.part for r in tops[1:] + tops[:1]]
    heads = docs.sparkSession.createDataFrame(
        [(r.doc_id, p) for r, p in zip(tops, above)], "doc_id long, above long")
    return (
        placed.join(F.broadcast(heads), "doc_id", "left")
        .select("doc_id", "text", F.explode(F.filter(
            F.array(F.struct("part", F.lit(0).alias("role")),
                    F.struct(F.col("above").alias("part"), F.lit(1).alias("role"))),
            lambda x: x.part.isNotNull())).alias("spot"))
        .select("spot.part", "doc_id", "text", "spot.role")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "role", F.desc("doc_id"), F.xxhash64("text"), "text")
    )


def fingerprint_documents(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprint of every text, of its edited text, and how alike they are.

    The edited text is the text with its second half replaced by the start of the next document
    in falling order of doc_id; after the last comes the first. Columns: doc_id, n_chars,
    edited_sha256, fingerprint and edited_fingerprint (hex, empty without words), near_edited,
    near_next. A null text is empty. Repeated rows are documents of their own, next to each
    other. A row without an id has the first document as its next and is nobody's next; without
    any id that next is empty. An empty table gives no rows; other columns are ignored.
    """
    ordered = with_next(docs)
    nameless = docs.where("doc_id IS NULL").limit(1).count()
    top = docs.agg(F.max("doc_id")).first()[0] if nameless else None
    same_top = docs.where(F.col("doc_id") == top).select(
        F.coalesce("text", F.lit("")).alias("text")) if top is not None else None
    first = same_top.orderBy(F.xxhash64("text"), "text").first()[0] if same_top else ""

    def run(batches):
        before = None  # part, id, text and fingerprint of the row still waiting for its next
        for batch in batches:
            for part in frames.slices(batch):
                rows = []
                cols = [part.column(i).to_pylist() for i in range(4)]
                for where, doc_id, text, role in zip(*cols):
                    mark = fingerprint(text, bins, bits)
                    if doc_id is None:
                        rows.append(line(doc_id, text, mark, first, fingerprint(first, bins, bits)))
                        continue
                    if before is not None and before[0] == where:
                        rows.append(line(*before[1:], text, mark))
                    before = (where, doc_id, text, mark) if not role else None
                yield batch_of(rows)

    def line(doc_id, text, mark, following, next_mark):
        other = edited(text, following)
        other_mark = fingerprint(other, bins, bits)
        return (doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), mark.hex(),
                other_mark.hex(), oph.likeness(mark, other_mark, bits),
                oph.likeness(mark, next_mark, bits))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
             pa.float64(), pa.float64()]

    def batch_of(rows):
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    return frames.map_batches(
        ordered, run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark, sf: str) -> DataFrame:
    return fingerprint_documents(frames.documents(spark, sf))
