"""Weighted scores, similarity tables and their aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.operators.lexical import PAIR

# Metric groups, their weights, and the six weight scenarios.
LEXICAL = ("f1_score", "rouge1", "rouge2", "rougeL", "bleu_score", "tfidf_similarity")
SEMANTIC = ("bertscore", "sts_score", "moverscore")
STRUCTURE = ("markdown_awareness_similarity", "teds_document_structure_similarity", "teds_table_structure_similarity")
METRICS = (*LEXICAL, *SEMANTIC, *STRUCTURE)
GROUPS = {"lexical": (0.20, LEXICAL), "semantic": (0.45, SEMANTIC), "structure": (0.35, STRUCTURE)}
SCENARIOS = [
    ("baseline", 0.20, 0.45, 0.35), ("lex_heavy", 0.40, 0.30, 0.30), ("sem_heavy", 0.20, 0.50, 0.30),
    ("struct_heavy", 0.20, 0.20, 0.60), ("equal", 1 / 3, 1 / 3, 1 / 3), ("sem_struct", 0.0, 0.50, 0.50),
]


def group_mean(columns: tuple[str, ...], present: list[str]) -> Column:
    """Mean of the columns that exist and have a value; null if none has."""
    there = [F.col(c) for c in columns if c in present]
    if not there:
        return F.lit(None).cast("double")
    n = sum(c.isNotNull().cast("int") for c in there)
    return F.try_divide(sum(F.coalesce(c, F.lit(0.0)) for c in there), n)


def pair_score(present: list[str], groups: dict = GROUPS) -> Column:
    """Weighted group means over the groups that have a value; 0 if none has."""
    means = [(w, group_mean(cols, present)) for w, cols in groups.values()]
    weight = sum(F.when(m.isNotNull(), w).otherwise(0.0) for w, m in means)
    return F.coalesce(F.try_divide(sum(F.coalesce(m, F.lit(0.0)) * w for w, m in means), weight), F.lit(0.0))


def weighted_score(present: list[str], weights: tuple = (0.20, 0.45, 0.35), existing: str | None = None) -> Column:
    """Fixed weights without renormalising: a group without any value makes the score null."""
    own = sum(group_mean(cols, present) * w for (_, cols), w in zip(GROUPS.values(), weights, strict=True))
    return F.coalesce(F.col(existing), own) if existing and existing in present else own


def similarity_table(parts: list[DataFrame]) -> DataFrame:
    """All metrics of each pair in one row, with the status of the vector metrics and the overall score."""
    rows = reduce(lambda a, b: a.join(b, PAIR), parts)
    missing = [m for m in METRICS if m not in rows.columns]
    rows = rows.withColumns({m: F.lit(None).cast("double") for m in missing})
    status = {m.removesuffix("_score") + "_status": F.when(F.col(m).isNull(), "failed").otherwise("ok") for m in SEMANTIC}
    return rows.withColumns(status).withColumn("overall_score", pair_score(list(METRICS)))


def stats(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample deviation of each column by group."""
    return rows.groupBy(*group).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_samp))))


def stats_by_type(rows: DataFrame, column: str) -> DataFrame:
    """The same by model, and by type and model, in one pass; the type is null in totals."""
    both = rows.groupingSets([["Model"], ["DocType", "Model"]], "DocType", "Model")
    return both.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))


def means_pivot(rows: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).agg(F.avg(value))


def leniency(rows: DataFrame) -> DataFrame:
    """Per reference: level, spread, and how much it tells models apart."""
    cells = rows.groupBy("Reference", "Model").agg(F.avg("OverallScore").alias("m"))
    between = cells.groupBy("Reference").agg(F.count("*").alias("k"), (F.max("m") - F.min("m")).alias("span"), F.collect_list("m").alias("ms"))
    total = rows.groupBy("Reference").agg(F.count("*").alias("n"), F.avg("OverallScore").alias("mean"), F.stddev_samp("OverallScore").alias("std"), (F.var_pop("OverallScore") * F.count("OverallScore")).alias("ss"))
    squares = F.aggregate("ms", F.lit(0.0), lambda s, m: s + (m - F.col("mean")) * (m - F.col("mean")))
    return total.join(between, "Reference").select("Reference", "mean", "std", (F.col("std") / F.col("mean") * 100).alias("cv"), "span", F.try_divide(F.col("n") / F.col("k") * squares, F.col("ss")).alias("share"))


def scenario_scores(rows: DataFrame) -> DataFrame:
    """Every row under each weight scenario: a broadcast of six rows."""
    scenarios = rows.sparkSession.createDataFrame(SCENARIOS, "scenario string, w_lex double, w_sem double, w_str double")
    crossed = rows.crossJoin(F.broadcast(scenarios))
    return crossed.withColumn("score", weighted_score(rows.columns, (F.col("w_lex"), F.col("w_sem"), F.col("w_str")))).drop("w_lex", "w_sem", "w_str")


def top_models(rows: DataFrame, k: int = 3) -> DataFrame:
    """``(scenario, k, Model, mean)``: the ``k`` best models of each weighting, of equal ones the first name."""
    means = scenario_scores(rows).groupBy("scenario", "Model").agg(F.avg("score").alias("mean"))
    return means.withColumn("k", F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("mean"), "Model"))).where(F.col("k") <= k).select("scenario", "k", "Model", "mean")


def document_signals(rows: DataFrame) -> DataFrame:
    """Per document: the response, structural spread, lexical-semantic level and mean of optional signals; complete rows only."""
    optional = [c for c in ("output_words", "local_agreement_mean", "local_agreement_std") if c in rows.columns]
    level = (group_mean(LEXICAL, rows.columns) * 0.20 + group_mean(SEMANTIC, rows.columns) * 0.45) / 0.65
    made = rows.withColumn("lexsem", level).groupBy("document_id").agg(F.avg("OverallScore").alias("mean_overall"), F.stddev_samp("teds_table_structure_similarity").alias("teds_std"), F.avg("lexsem").alias("lexsem"), *(F.avg(c).alias(c) for c in optional))
    return made.dropna()


def metric_coverage(rows: DataFrame, group: list[str]) -> DataFrame:
    """How many values each known metric has, per group."""
    return rows.groupBy(*group).agg(*(F.count(m).alias(m) for m in METRICS if m in rows.columns))


def reconcile(rows: DataFrame, stored: str, recomputed: str) -> DataFrame:
    return rows.agg(F.avg(recomputed).alias("mean"), F.stddev_samp(recomputed).alias("std"), F.avg(stored).alias("stored_mean"), F.max(F.abs(F.col(stored) - F.col(recomputed))).alias("max_difference"))


def local_agreement(pairs: DataFrame, score: str) -> DataFrame:
    """Mean and sample deviation per document of the scores of pairs of local models."""
    return pairs.groupBy("document_id").agg(F.avg(score).alias("local_agreement_mean"), F.stddev_samp(score).alias("local_agreement_std"))
