"""Does a reference favour models of its own family? Gaps, residuals, tests and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators import inference
from scoreloom.operators.bootstrap import bootstrap_mean_ci, bootstrap_rank_biserial_ci
from scoreloom.operators.ranks import centered_cells, holm_adjust

SCORE = "OverallScore"


def same_against_cross(rows: DataFrame) -> DataFrame:
    """Scores of pairs of one family against all others: Mann-Whitney with p, r with its interval, d, and both means."""
    kind = F.when(F.col("same_family"), "same").otherwise("cross")
    tested = inference.with_rank_sum_p(inference.mann_whitney(rows.withColumn("kind", kind), "kind", SCORE, [("same", "cross")])).drop("ties")
    means = rows.agg(F.avg(F.when(F.col("same_family"), F.col(SCORE))).alias("own"), F.avg(F.when(~F.col("same_family"), F.col(SCORE))).alias("other"))
    # One row each.
    return tested.crossJoin(F.broadcast(means)).crossJoin(F.broadcast(bootstrap_rank_biserial_ci(rows, "same_family", SCORE)))


def independent_pairs(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """All pairs of models as independent samples: Mann-Whitney, p with Holm's adjustment, r with its interval, d."""
    tested = holm_adjust(inference.with_rank_sum_p(inference.mann_whitney(rows, "Model", SCORE, pairs)).drop("ties"), "p")
    both = inference.both_sides(rows, "Model", SCORE, pairs)
    return tested.join(F.broadcast(bootstrap_rank_biserial_ci(both, "first", "v", ["comparison"])), "comparison")


def family_gaps(rows: DataFrame, families: list[tuple[str, str, str]]) -> DataFrame:
    """For each (reference, model, family): the model's mean with its own reference, with others, the gap, and the cell's residual."""
    listed = F.broadcast(rows.sparkSession.createDataFrame(families, "own_reference string, Model string, family string"))
    own = F.col("Reference") == F.col("own_reference")
    gaps = rows.join(listed, "Model").groupBy("family", "own_reference", "Model").agg(F.avg(F.when(own, F.col(SCORE))).alias("own"), F.avg(F.when(~own, F.col(SCORE))).alias("other"))
    cells = centered_cells(rows).select(F.col("Reference").alias("own_reference"), "Model", F.col("residual").alias("cell_residual"))
    return gaps.join(cells, ["own_reference", "Model"], "left").select("family", "own_reference", "Model", "own", "other", (F.col("own") - F.col("other")).alias("gap"), "cell_residual")


def residual_signs(residuals: DataFrame, families: list[tuple[str, str, str]]) -> DataFrame:
    """Residuals of the documents in each family's cell: mean, Wilcoxon (from six documents on), interval, and how many are positive."""
    listed = F.broadcast(residuals.sparkSession.createDataFrame(families, "Reference string, Model string, family string"))
    own = residuals.where("residual is not null").join(listed, ["Reference", "Model"])
    tested = inference.with_signed_rank_p(inference.signed_rank(own, "residual", ["family"])).withColumn("p", F.when(F.col("n") > 5, F.col("p")))
    found = tested.select("family", "n", F.col("mean").alias("mean_residual"), "w", "z", "p", F.col("wins").alias("positive"), F.try_divide("wins", "n").alias("share_positive"))
    return found.join(F.broadcast(bootstrap_mean_ci(own, "residual", ["family"])), "family")
