"""The pipeline on odd rows, stage by stage."""

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from raingrid import session

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def _rows():
    import random

    rng = random.Random(9)
    words = ["the", "and", "of", "with", "rain", "wind", "station", "harvest", "early", "later",
             "river", "field", "north", "cloud", "daily"]
    prose = [" ".join(rng.choices(words, k=80)) + ".\n" + " ".join(rng.choices(words, k=60))
             for _ in range(60)]
    texts = [*prose, prose[0], prose[1].upper(), prose[2] + " more", None, "", "123 456"]
    texts += ["### the $$$ and &&& " * 40 + "\n" + "%%% *** ### " * 30 for _ in range(30)]
    texts += ['secret: "abcdef0123456789" ' + prose[3][:200], "a token = 0123456789abcdef stands here"]
    rows = [(i, t, "en", "s", len(t or ""), 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "a row that has no id but words of the river and the field", "en",
                             None, None, None)]


ROWS = _rows()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 0 if "###" in (r[1] or "") else 1, 0) for r in ROWS if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return path


def test_stages_keep_what_is_clean(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = session.written(stage(spark, docs, folder), "test-stage")
        counts[name] = docs.count()
        if name != "pack_binary":
            assert docs.columns == columns
    assert counts["language_id"] == sum(any(c.isalpha() for c in (r[1] or "")) for r in ROWS)
    assert counts["line_quality"] == counts["language_id"] - sum("###" in (r[1] or "") for r in ROWS)
    assert counts["near_duplicates"] == 63
    assert counts["secret_formats"] == 63


def test_near_copies_are_dropped_by_row(spark):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("rain", "wind", "cloud", "field")]
    rows = [(1, texts[0]), (None, texts[0].upper()), (None, texts[1]), (None, None), (2, texts[2]),
            (7, texts[2] + " more"), (7, texts[3]), (7, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0.5) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in kept} == {
        (1, texts[0]), (None, texts[1]), (None, None), (2, texts[2]), (7, texts[3])}
    assert len(kept) == 5


def test_stages_pass_on_columns_of_any_name(spark, folder):
    names = ["text_key", "kept_id", "kept", "row", "rows", "d", "digest", "node", "n_shingles", "part",
             "key", "ids", "component_id", "root", "spans", "value", "quality"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(
        "*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = session.written(stage(spark, docs, folder), "test-names")
        assert out.columns == docs.columns
        assert out.select(*names).distinct().collect() == [tuple(range(len(names)))]
        docs, sizes = out, [*sizes, out.count()]
    assert sizes[2:] == [63, 63]


def test_run_gives_packed_pieces(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert "sequence_id" in rows.columns and rows.count() > 20


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < -5")
    for _, stage in corpus_pipeline.STAGES:
        out = session.written(stage(spark, docs, folder), "test-empty")
        assert out.count() == 0

