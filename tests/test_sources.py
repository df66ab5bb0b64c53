"""Sources and sinks on small folders."""

from pyspark.sql import functions as F

from scoreloom.sources import corpus


def test_read_corpus(spark, tmp_path):
    (tmp_path / "PAT-01_gemma_ADR.md").write_bytes("﻿---\na: 1\n---\n본문".encode())
    (tmp_path / "PAT-01_qwen_ADR.md").write_bytes("한글 문서".encode("cp949"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "note.txt").write_text("plain")
    rows = {r.model: r for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert (rows["gemma"].text, rows["qwen"].text) == ("본문", "한글 문서")
    assert corpus.read_any_text(spark, str(tmp_path)).count() == 3


def test_evaluations(spark, tmp_path):
    (tmp_path / "similarity_claude_as_reference.csv").write_text("document_id,comparison_model,f1_score\nd,gemma,0.5\n,qwen,0.1\n")
    row = corpus.read_evaluations(spark, str(tmp_path), "document_id string, comparison_model string, f1_score double").collect()
    assert [(r.document_id, r.reference_model) for r in row] == [("d", "claude")]


def test_images_and_pending(spark, tmp_path):
    folder = tmp_path / "doc1" / "extracted_images" / "p"
    folder.mkdir(parents=True)
    (folder / "a.PNG").write_bytes(b"x")
    (folder / "b.txt").write_bytes(b"x")
    rows = corpus.list_images(spark, str(tmp_path)).collect()
    assert [(r.document_folder, r.image_relative_path) for r in rows] == [("doc1", "p/a.PNG")]
    work, done = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a", 3), ("b", 0)], "k string, length int")
    assert sorted(r.k for r in corpus.pending_work(work, done, "k").collect()) == ["b", "c"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r", "d", "m", 3, 0.5)], "reference_model string, document_id string, model string, output_words int, confidence double")
    corpus.write_similarity(rows, f"{tmp_path}/s")
    corpus.write_word_counts(rows, f"{tmp_path}/w")
    corpus.write_predictions(rows, f"{tmp_path}/p")
    corpus.write_report({"one": rows}, f"{tmp_path}/r")
    assert (tmp_path / "s" / "reference_model=r").is_dir() and spark.read.parquet(f"{tmp_path}/r/one").count() == 1
    assert spark.read.option("header", True).csv(f"{tmp_path}/p").first().confidence == "0.500000"
    clean = corpus.nan_to_null(spark.createDataFrame([(float("nan"),), (2.0,)], "x double"))
    assert clean.agg(F.avg("x")).first()[0] == 2.0
