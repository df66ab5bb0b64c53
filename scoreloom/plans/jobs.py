"""The three workflows: score a corpus, report the bias, regress documents on signals."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import names
from scoreloom.operators import factors, family, inference, lexical, mixed, pairs, ranks, scores, structure
from scoreloom.sources import corpus as sources


def score_corpus(corpus: DataFrame, references: list[str], candidates: list[str], vector_metrics: list[DataFrame] | None = None) -> DataFrame:
    """Corpus rows to the similarity table: parse, keep the first duplicate, pair, measure, score.

    ``vector_metrics`` are tables of metrics from caller-supplied embeddings, keyed by pair.
    """
    docs = pairs.keep_first(pairs.valid_documents(corpus), ["path"]).repartition("document_id", "doc_type")
    parts = [f(docs, references, candidates) for f in (lexical.vocab_overlap_f1, lexical.rouge, lexical.bleu, lexical.tfidf_similarity, structure.structure_similarity, lexical.rouge_l_pairs)]
    return scores.similarity_table([*parts, *(vector_metrics or [])])


def evaluation_frame(similarity: DataFrame, families: dict[tuple[str, str], str] = names.FAMILY_MAP) -> DataFrame:
    """Similarity rows with display names, document type, family flag and the fixed-weight score."""
    rows = sources.nan_to_null(similarity)
    known = F.create_map(*(F.lit(x) for r, m in families for x in (f"{r}/{m}", True))) if families else F.create_map().cast("map<string,boolean>")
    rows = rows.withColumns({"Reference": names.normalize_name(F.col("reference_model"), names.REFERENCE_NAMES), "Model": names.normalize_name(F.col("comparison_model"), names.MODEL_NAMES), "DocType": names.classify_doc_type(F.col("document_id"))})
    key = F.concat_ws("/", F.col("Reference"), F.lower("Model"))
    return rows.withColumns({"OverallScore": scores.weighted_score(rows.columns), "same_family": F.coalesce(F.try_element_at(known, key), F.lit(False))})


def bias_report(evaluations: DataFrame, references: list[str], models: list[str], families: list[tuple[str, str, str]] = ()) -> dict[str, DataFrame]:
    """The report's tables. ``evaluations`` is read many times: pass a persisted or written table.

    ``families`` lists (reference, model, family) as they stand in the table.
    """
    rows, model_pairs = evaluations, list(combinations(models, 2))
    residuals = ranks.centered_documents(rows, len(references), len(models))
    typed = residuals.join(rows.select("document_id", "DocType").distinct(), "document_id")
    paired = inference.with_signed_rank_p(inference.signed_rank(inference.paired_differences(rows, model_pairs), "d", ["comparison"])).drop("w_plus", "zeros")
    metrics = [m for m in scores.METRICS if m in rows.columns]
    cells = ["Reference", "Model"]
    report = {
        "metric_means": scores.stats(rows, cells, [*metrics, "OverallScore"]),
        "dataset": scores.stats_by_type(rows, "OverallScore"),
        "reference_by_model": scores.means_pivot(rows, "Reference", "Model", models, "OverallScore"),
        "table_structure": scores.means_pivot(rows, "Reference", "Model", models, "teds_table_structure_similarity"),
        "leniency": scores.leniency(rows),
        "anova": inference.with_p(factors.two_way_anova(rows, "Reference", "Model", "OverallScore"), "f", "f", "df", "df2"),
        "normality": inference.normality(rows, cells, "OverallScore"),
        "brown_forsythe": inference.with_p(inference.brown_forsythe(rows, cells, "OverallScore"), "f", "f", "df1", "df2"),
        "kruskal_wallis": inference.with_p(inference.kruskal_wallis(rows, "Reference", "OverallScore"), "chi2", "h", "df"),
        "friedman": inference.with_p(inference.friedman(rows, "document_id", "Model", "OverallScore", len(models)), "chi2", "chi2", "df"),
        "paired": ranks.holm_adjust(paired, "p"),
        "independent_pairs": family.independent_pairs(rows, model_pairs),
        "double_centered": ranks.centered_cells(rows),
        "residuals": residuals,
        "residual_signs": inference.sign_crosstab(typed, "DocType", ("patent", "report"), "residual"),
        "variance": mixed.random_intercept(rows, "document_id", cells, "OverallScore"),
        "sensitivity": inference.spearman(scores.scenario_scores(rows), "OverallScore", "score", ["scenario"]),
        "sensitivity_ranking": scores.top_models(rows),
        "lexical_semantic_gap": rows.groupBy("Model").agg(F.avg("rougeL").alias("lexical"), F.avg("bertscore").alias("semantic"), (F.avg("bertscore") - F.avg("rougeL")).alias("gap")),
    }
    if families:
        report |= {
            "family_test": family.same_against_cross(rows),
            "family_gaps": family.family_gaps(rows, families),
            "family_residuals": family.residual_signs(residuals, families),
            "family_contrast": inference.with_p(mixed.family_contrast(rows, "document_id", "Reference", "Model", "same_family", "OverallScore"), "normal", "z"),
        }
    return report


def document_regression(evaluations: DataFrame, words: DataFrame, agreement: DataFrame | None = None) -> dict[str, DataFrame]:
    """Documents on their signals: table-score spread and length, with agreement of local models if it is given.

    ``words`` holds ``(document_id, model, output_words)``, ``agreement`` one row a document.
    """
    rows = evaluations.join(words.withColumnRenamed("model", "comparison_model"), ["document_id", "comparison_model"], "left")
    if agreement is not None:
        rows = rows.join(agreement, "document_id", "left")
    # The caller may persist the table: each fit reads it three times.
    signals = scores.document_signals(rows)
    sets = {"spread": ["teds_std"], "words": ["output_words"], "both": ["teds_std", "output_words"]}
    if agreement is not None:
        sets |= {"agreement": ["local_agreement_mean"], "three": ["teds_std", "output_words", "local_agreement_mean"]}
    fits = {f"ols_{name}": inference.with_p(inference.ols_with_loocv(signals, "mean_overall", xs), "f", "f", "df1", "df2") for name, xs in sets.items()}
    ranked = [("output_words", "mean_overall"), ("teds_std", "mean_overall"), *([("local_agreement_mean", "teds_std")] if agreement is not None else [])]
    return {"signals": signals, **{f"spearman_{a}_{b}": inference.spearman(signals, a, b) for a, b in ranked}, **fits}


def run_corpus_folder(spark: SparkSession, path: str, out: str, references: list[str], candidates: list[str]) -> None:
    """Reads a folder of Markdown files and writes the similarity table, one folder a reference."""
    sources.write_similarity(score_corpus(sources.read_corpus(spark, path), references, candidates), out)
