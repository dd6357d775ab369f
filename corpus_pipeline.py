"""Training-data pipeline: language, quality, near copies, secrets, packing.

Every stage takes the documents that its predecessor kept, as a table it can read as often as it
likes, and all but the last return documents with the same columns. ``run`` writes each stage's
result to the shared folder, so a lost executor costs a stage at most part of its own work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raingrid import session
from raingrid.llm import (
    binary_packing, language_id, line_quality, near_duplicates, secret_formats,
)
from raingrid.llm.frames import documents, filter_texts

#: Below this score a text is like no language that is known.
LEAST_LANGUAGE = 0.1
#: Similarity of five-word shingles, in percent, from which documents are near copies.
NEAR_PERCENT = 80
#: Probability of good quality from which a document stays.
LEAST_QUALITY = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are near the profile of a language of the table.

    Null and empty texts, and texts without a letter, go. Repeated rows stay or go together; an
    empty table stays empty. All columns are passed on as they are, whatever their names.
    """
    profiles = language_id.learn_profiles(docs)
    made = []

    def wanted(texts):
        if not made:
            made.append(language_id.Classifier(profiles))
        return [lang != "und" and score >= LEAST_LANGUAGE
                for lang, score in made[0].classify(texts)]

    return filter_texts(docs, wanted)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, learned from the labels, does not reject.

    Null and empty texts get the score of a text without lines. Repeated rows stay or go together;
    an empty table stays empty, and without labels nothing is rejected. All columns are passed on.
    """
    model = line_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_texts(docs, lambda texts: [
        s >= LEAST_QUALITY for s in line_quality.scores(texts, model)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id.

    Rows that repeat an id and a text are one document; rows without an id stay only if no row
    of their class has one. The verdict is that of a row's id and text together. Null and empty
    texts are linked with nothing and stay. An empty table stays empty; other columns are passed
    on, whatever their names. Reads its input twice and the small table of verdicts once more
    while the plan is built.
    """
    kept = session.written(
        near_duplicates.verdicts(docs, NEAR_PERCENT).where("kept").groupBy("doc_id", "text_key").agg(
            F.count("*").alias("rows")), "kept")
    # Rows travel as one column, so that no name of theirs can meet one of the verdicts.
    rows = docs.select(F.struct("*").alias("row")).join(
        kept.select("doc_id", "text_key"),
        F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
        & (F.xxhash64("row.text") == F.col("text_key")), "left_semi")
    if kept.where("rows > 1").limit(1).count():
        rows = rows.groupBy("row.doc_id", F.xxhash64("row.text")).agg(F.min("row").alias("row"))
    return rows.select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials replaced.

    Null and empty texts and the other columns stay as they are; repeated rows are redacted alike;
    an empty table stays empty.
    """
    return secret_formats.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with the checksums of their ids.

    A null or empty text is the end id alone; repeated rows are packed again; an empty table gives
    no rows; other columns than doc_id and text are left behind.
    """
    return binary_packing.digest(binary_packing.pack_binary(docs))


STAGES = [
    ("language_id", keep_languages),
    ("line_quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("secret_formats", redact_secrets),
    ("pack_binary", pack),
]

#: Learned profiles, models and automata are not to be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = session.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
