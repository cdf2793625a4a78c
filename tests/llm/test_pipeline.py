"""The pipeline's stages on a small corpus with planted cases."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_filter(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    packed = corpus_pipeline.packed(spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == before


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (1, text + " end"), (1, text + " end"), (None, text), (None, "quite another text of its own here"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.without_copies(spark, docs, FOLDER)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "7", "8", "None"]
    assert left.columns == docs.columns


CLASHING = ["score", "predicted", "keep", "low", "high", "tongue", "text_id", "own_low", "grade_key", "_place", "_at", "_part", "_bits", "_bad", "_key", "_turn", "_salt", "gid", "n", "a.b"]


def test_clashing_columns_come_back(spark):
    words = "the river runs past old stone houses and under two narrow bridges before it meets the wide grey sea".split()
    texts = [" ".join(words[i:] + words[:i]) + f" number {i}" for i in range(9)] + [None, "", " "]
    rows = [(i, t, "en", "s", 0, *[f"{c} {i}" for c in CLASHING]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *CLASHING])
    whole = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert all(whole[r.doc_id] == tuple(r) for r in rows), name
        assert {9, 10} <= {r.doc_id for r in rows}, name


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns and got.count() == 0, name
    assert corpus_pipeline.packed(spark, docs, FOLDER).count() == 0
