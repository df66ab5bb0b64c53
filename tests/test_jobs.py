"""The workflows end to end on a small folder."""

import random

from pyspark.sql import functions as F

from scoreloom.functions import names
from scoreloom.plans import jobs
from scoreloom.sources import corpus


def test_workflows(spark, tmp_path):
    r = random.Random(3)
    words = "patent sensor water soil model data system farm".split()
    folder = tmp_path / "in"
    folder.mkdir()
    for d in range(6):
        for m in ("claude", "gemini", "gemma", "qwen", "ministral"):
            body = "\n\n".join(["# " + r.choice(words), " ".join(r.choice(words) for _ in range(r.randint(8, 40))), "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * r.randint(0, 3), "- " + r.choice(words)])
            (folder / f"{'PAT' if d % 2 else 'RPT'}-{d}_{m}_ADR.md").write_text(body)
    references, models = ["claude", "gemini"], ["gemma", "qwen", "ministral"]
    jobs.run_corpus_folder(spark, str(folder), f"{tmp_path}/out", references, models)
    table = spark.read.parquet(f"{tmp_path}/out")
    assert table.count() == 36 and table.where("overall_score between 0 and 1").count() == 36
    frame = jobs.evaluation_frame(table.withColumns({m: F.lit(0.5) for m in ("bertscore", "sts_score", "moverscore")})).persist()
    assert frame.where("same_family").select("Reference", "Model").distinct().count() == 1
    report = jobs.bias_report(frame, ["Claude", "Gemini"], ["Gemma", "Ministral", "Qwen"], [("Gemini", "Gemma", "Google")])
    assert {k: v.count() for k, v in report.items()} | {"residuals": 36} == {"metric_means": 6, "reference_by_model": 2, "leniency": 2, "anova": 4, "brown_forsythe": 1, "kruskal_wallis": 1, "friedman": 1, "paired": 3, "double_centered": 6, "residuals": 36, "residual_signs": 1, "variance": 1, "dataset": 9, "table_structure": 2, "normality": 1, "independent_pairs": 3, "sensitivity": 6, "sensitivity_ranking": 18, "lexical_semantic_gap": 3, "family_test": 1, "family_gaps": 1, "family_residuals": 1, "family_contrast": 1}
    counts = corpus.read_corpus(spark, str(folder)).select("document_id", "model", names.count_words(F.col("text")).alias("output_words"))
    found = jobs.document_regression(frame, counts)
    assert found["signals"].count() == 6 and found["ols_both"].first().n == 6
