"""Batch scoring, order by a registry, numbered stems and what sinks leave."""

import numpy as np

from scoreloom.functions import names
from scoreloom.operators import pairs, predictions
from scoreloom.sources import corpus, scratch


def test_failing_rows_keep_their_error(spark):
    def make():
        def model(x):
            if (x[:, 0] > 5).any():
                raise ValueError("too large")
            return np.stack([x.sum(axis=1), x[:, 1] - x[:, 0]], axis=1)

        return model

    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [9.0, 2.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [0.0, 4.0])], "i int, v array<float>")
    got = {r.i: (r.error, r.scores) for r in predictions.score_rows(rows.withColumn("scores_", rows.i), "v", 2, make, batch_size=4).collect()}
    assert got == {1: ("", [3.0, 1.0]), 2: ("too large", None), 3: ("no vector", None), 4: ("no vector", None), 5: ("no vector", None), 6: ("", [4.0, 4.0])}
    assert predictions.score_rows(rows.limit(0), "v", 2, make).count() == 0


def test_models_by_registry(spark):
    docs = spark.createDataFrame([("d", "ADR", m) for m in ("z", "b", "a", "b", None, "q")], "document_id string, doc_type string, model string")
    registry = spark.createDataFrame([("q", "Q", 1), ("b", "B", 2), ("none", "N", 0)], "token string, label string, position int")
    order = lambda w=None: [(r.model, r.label) for r in pairs.ordered_models(docs, registry, w).orderBy("place").collect()]
    assert order() == [("q", "Q"), ("b", "B"), ("a", "a"), ("z", "z")]
    assert order(["z", "none", "b", "z"]) == [("z", "z"), ("b", "B")]


def test_numbered_stems(spark):
    rows = spark.createDataFrame([("f", "a", 1), ("f", "A", 2), ("f", "a_2", 3), ("f", "b", 4), ("g", "a", 5), ("f", "b", 6), (None, "a", 7)], "folder string, stem string, i int")
    got = {r.i: r.unique for r in names.numbered_stems(rows, ["folder"], "stem", "i").collect()}
    assert got == {1: "a", 2: "A__2", 3: "a_2", 4: "b", 5: "a", 6: "b_2", 7: "a"}
    assert names.numbered_stems(rows.limit(0), ["folder"], "stem", "i").count() == 0


def test_one_reference_is_written_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d", 1.0), ("b", "d", 2.0)], "reference_model string, document_id string, v double")
    corpus.write_similarity(rows, f"{tmp_path}/s")
    corpus.write_similarity(rows.where("reference_model = 'b'").selectExpr("reference_model", "document_id", "v + 1 AS v"), f"{tmp_path}/s", again=True)
    assert {(r.reference_model, r.v) for r in spark.read.parquet(f"{tmp_path}/s").collect()} == {("a", 1.0), ("b", 3.0)}
    for r in ("a", "b"):
        corpus.write_evaluations(rows.where(f"reference_model = '{r}'").selectExpr("CAST(NULL AS string) AS reference_model", "document_id", "document_id AS comparison_model", "v"), f"{tmp_path}/e", r)
    back = corpus.read_evaluations(spark, f"{tmp_path}/e", "reference_model string, document_id string, comparison_model string, v double")
    assert {(r.reference_model, r.v) for r in back.collect()} == {("a", 1.0), ("b", 2.0)}


def test_texts_in_two_charsets_are_a_corpus(spark, tmp_path):
    rows = spark.createDataFrame([("PAT-1_gemma_ADR.md", "가나, \"x\"  다  "), ("PAT-2_qwen_ADR.md", " 라마 b;c")], "name string, text string")
    corpus.write_texts(rows.where("name like '%gemma%'"), f"{tmp_path}/c")
    corpus.write_texts(rows.where("name like '%qwen%'"), f"{tmp_path}/c", "cp949")
    got = {(r.document_id, r.model): r.text.rstrip("\n") for r in corpus.read_corpus(spark, f"{tmp_path}/c", in_folders=True).collect()}
    assert got == {("PAT-1", "gemma"): "가나, \"x\"  다", ("PAT-2", "qwen"): "라마 b;c"}


def test_written_is_in_the_shared_folder(spark):
    assert scratch.scratch_folder(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    assert sorted(r.id for r in scratch.written(spark.range(3)).collect()) == [0, 1, 2]
