"""Vector pair metrics over caller-supplied chunk and token embeddings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.lexical import PAIR
from scoreloom.operators.pairs import KEY


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sts_score(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mean of both directions' length-weighted best chunk cosines.

    Both sides hold ``(*KEY, model, chunk, chunk_len, vec)``. Chunks meet only within a document.
    """
    r = references.select(*KEY, F.col("model").alias("reference_model"), F.col("chunk").alias("rk"), F.col("chunk_len").alias("rl"), F.col("vec").alias("rv"))
    c = candidates.select(*KEY, F.col("model").alias("comparison_model"), F.col("chunk").alias("ck"), F.col("chunk_len").alias("cl"), F.col("vec").alias("cv"))
    cells = r.join(c, KEY).where("reference_model <> comparison_model").withColumn("cos", F.coalesce(cosine(F.col("rv"), F.col("cv")), F.lit(0.0)))

    def side(k, length):
        best = cells.groupBy(*PAIR, k, length).agg(F.max("cos").alias("best"))
        return best.groupBy(*PAIR).agg((F.sum(F.col("best") * F.greatest(length, F.lit(1))) / F.sum(F.greatest(length, F.lit(1)))).alias(f"score_{k}"))

    return side("rk", "rl").join(side("ck", "cl"), PAIR).select(*PAIR, ((F.col("score_rk") + F.col("score_ck")) / 2).alias("sts_score"))


def assignment_cost(cost: np.ndarray) -> float:
    """Least total cost of matching every row of the shorter side, by shortest augmenting paths."""
    cost = cost if cost.shape[0] <= cost.shape[1] else cost.T
    n, m = cost.shape
    row_dual, col_dual, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        least, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, spent = start, -1, 0.0
        while True:
            slack = cost[row] - row_dual[row] - col_dual + spent
            better = ~done & (slack < least)
            least[better], via[better] = slack[better], at
            at = int(np.where(done, np.inf, least).argmin())
            spent = least[at]
            done[at] = True
            if match[at] < 0:
                break
            row = match[at]
        for j in np.flatnonzero(done):
            if match[j] >= 0:
                row_dual[match[j]] += spent - least[j]
            col_dual[j] -= spent - least[j]
        row_dual[start] += spent
        while at >= 0:
            previous = via[at]
            match[at] = match[previous] if previous >= 0 else start
            at = previous
    return float(cost[match[match >= 0], np.flatnonzero(match >= 0)].sum())


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def emd(a, b) -> float:
    """Similarity of two sets of vectors: 1 − mean matched cosine distance / 2, within 0 and 1."""
    if not len(a) or not len(b):
        return 0.0
    distance = np.nan_to_num(1 - _unit(a) @ _unit(b).T, nan=1.0, posinf=1.0, neginf=0.0)
    return float(min(1.0, max(0.0, 1 - assignment_cost(distance) / min(len(a), len(b)) / 2)))


def greedy_f1(a, b) -> float:
    """F1 of greedy token matching on the largest cosines."""
    sims = np.nan_to_num(_unit(a) @ _unit(b).T)
    recall, precision = sims.max(axis=1).mean(), sims.max(axis=0).mean()
    return float(2 * precision * recall / (precision + recall)) if precision + recall else 0.0


def _vector_lists(rows: DataFrame, group: list[str]) -> DataFrame:
    """The vectors of a document or chunk, in order; bounded by the chunk limit of one text."""
    return rows.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "vec"))), lambda s: s["vec"]).alias("vecs"))


def _score_pairs(pairs: DataFrame, name: str, score: Callable, extra: list[str]) -> DataFrame:
    def run(frames):
        for pdf in frames:
            pdf[name] = [score(a, b) for a, b in zip(pdf.pop("ref_vecs"), pdf.pop("cand_vecs"), strict=True)]
            yield pdf

    kept = [*PAIR, *extra]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*kept).schema), f"{name} double"])
    return pairs.select(*kept, "ref_vecs", "cand_vecs").mapInPandas(run, schema)


def emd_similarity(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Optimal one-to-one matching of the sentence vectors of a pair. Sides hold ``(*KEY, model, at, vec)``."""
    r = _vector_lists(references.withColumnRenamed("model", "reference_model"), [*KEY, "reference_model"]).withColumnRenamed("vecs", "ref_vecs")
    c = _vector_lists(candidates.withColumnRenamed("model", "comparison_model"), [*KEY, "comparison_model"]).withColumnRenamed("vecs", "cand_vecs")
    return _score_pairs(r.join(c, KEY).where("reference_model <> comparison_model"), "moverscore", emd, [])


def bertscore(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Greedy-match F1 of aligned chunks, weighted by chunk length.

    Sides hold ``(*KEY, model, chunk, n_chunks, chunk_len, at, vec)``, a row per token vector.
    """
    own = ["chunk", "n_chunks", "chunk_len"]
    r = _vector_lists(references.withColumnRenamed("model", "reference_model"), [*KEY, "reference_model", *own])
    c = _vector_lists(candidates.withColumnRenamed("model", "comparison_model"), [*KEY, "comparison_model", *own])
    r = r.select(*KEY, "reference_model", F.col("chunk").alias("rk"), F.col("n_chunks").alias("rn"), F.col("chunk_len").alias("rl"), F.col("vecs").alias("ref_vecs"))
    c = c.select(*KEY, "comparison_model", F.col("chunk").alias("ck"), F.col("n_chunks").alias("cn"), F.col("chunk_len").alias("cl"), F.col("vecs").alias("cand_vecs"))
    n = F.greatest("rn", "cn")
    steps = r.join(c, KEY).where("reference_model <> comparison_model").withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    met = steps.where((F.col("rk") == F.floor(F.col("k") * F.col("rn") / n)) & (F.col("ck") == F.floor(F.col("k") * F.col("cn") / n)))
    met = met.withColumn("weight", F.greatest(F.lit(1.0), (F.col("rl") + F.col("cl")) / 2))
    scored = _score_pairs(met, "f1", greedy_f1, ["weight"])
    return scored.groupBy(*PAIR).agg((F.sum(F.col("f1") * F.col("weight")) / F.sum("weight")).alias("bertscore"))
