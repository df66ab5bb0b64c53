"""Bootstrap intervals that draw exactly n of n, at any size and under any ties.

Rows of equal value are alike, so a sample is its distinct values with their
counts, and a resample is one multinomial draw of n over them. Distinct values
are cut into buckets in order. A bucket learns how many of a replicate's n draws
fall into it by a tree: from the root, binomials divide the draws between halves
of the buckets, each from its own seeded generator, so all buckets agree without
asking each other. Inside a bucket, draws are hashed to its places, or, where
values repeat so often that draws outnumber them, divided by binomials again; so
a value of any frequency is one row and one number a replicate. There is no table
of rows x replicates, and a resample of one bucket can be repeated in SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.sources.scratch import written

PRIME = (1 << 31) - 1
#: Draws, replicates, buckets, sides and seeds lie so far apart before their fifth power is taken, which permutes the numbers below ``PRIME``.
STEPS = {"draw": 1_000_003, "rep": 48_271, "bucket": 69_621, "side": 950_706_376, "seed": 742_938_285}
#: Distinct values of a bucket, values drawn to a bucket up to which places are hashed, and numbers that a task holds at once.
BUCKET_VALUES, HASHED, CELLS = 20_000, 20_000, 1 << 21


def places(reps: np.ndarray, draws: int, total: int, bucket: int, side: int, seed: int) -> np.ndarray:
    """Where draws 0 to ``draws`` - 1 of each replicate fall among ``total`` places."""
    x = (np.arange(draws, dtype=np.int64) * STEPS["draw"] + reps[:, None] * STEPS["rep"] + (bucket * STEPS["bucket"] + side * STEPS["side"] + seed * STEPS["seed"]) % PRIME) % PRIME
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME * total // PRIME


def shares(replicates: int, before: list[int], bucket: int, side: int, seed: int) -> np.ndarray:
    """How many of the n draws of each replicate fall into ``bucket``; ``before`` has the rows before each bucket, and n last."""
    draws, low, high = np.full(replicates, before[-1], dtype=np.int64), 0, len(before) - 1
    while high - low > 1:
        middle = (low + high) // 2
        whole, left = before[high] - before[low], before[middle] - before[low]
        lower = np.random.default_rng([seed, side, low, high]).binomial(draws, left / whole if whole else 0.0)
        draws, low, high = (lower, low, middle) if bucket < middle else (draws - lower, middle, high)
    return draws


def drawn_counts(reps: np.ndarray, draws: np.ndarray, counts: np.ndarray, bucket: int, side: int, seed: int) -> np.ndarray:
    """How often each value is drawn in each of ``reps``; ``draws`` has the draws of a replicate."""
    n, total = len(counts), int(counts.sum())
    if not total:
        return np.zeros((len(reps), n), dtype=np.int64)
    if total > HASHED:
        # A generator for each replicate, so the draws do not hang on how replicates are dealt.
        return np.stack([np.random.default_rng([seed, side, bucket, int(r), 1]).multinomial(int(k), counts / total) for r, k in zip(reps, draws, strict=True)])
    at = places(reps, int(draws.max(initial=0)), total, bucket, side, seed)
    value = np.searchsorted(np.cumsum(counts), at, side="right")
    own = np.arange(at.shape[1]) < draws[:, None]
    flat = (value + np.arange(len(reps))[:, None] * n)[own]
    return np.bincount(flat, minlength=len(reps) * n).reshape(len(reps), n)


def _bucketed(rows: DataFrame, group: list[str], sides: list) -> tuple[DataFrame, DataFrame]:
    """Distinct values ``(*group, __v, __t0.., __bucket)`` with their counts on each side, and for each bucket the numbers and counts of all buckets of its group."""
    counts = [f"__t{i}" for i in range(len(sides))]
    values = rows.groupBy(*group, "__v").agg(*(F.sum(F.when(s, 1).otherwise(0)).alias(c) for s, c in zip(sides, counts, strict=True)))
    most = values.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # A bucket is as long as there are buckets at least, so the totals that it is given are no more than its own values.
    buckets = max(1, min(most // BUCKET_VALUES, int(most**0.5)))
    cuts = F.percentile_approx("__v", [i / buckets for i in range(1, buckets)] or [0.5], max(10_000, 10 * buckets)).alias("__cuts")
    bounds = values.groupBy(*group).agg(cuts if buckets > 1 else F.array().cast("array<double>").alias("__cuts"))
    placed = values.join(bounds, group) if group else values.crossJoin(F.broadcast(bounds))
    # Read twice, for the values and for the totals.
    placed = written(placed.withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts"), "values")
    totals = placed.groupBy(*group, "__bucket").agg(*(F.sum(c).alias(c) for c in counts))
    listed = totals.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("__bucket", *counts))).alias("__all"))
    listed = listed.select(*group, F.col("__all.__bucket").alias("__numbers"), *(F.col(f"__all.{c}").alias(f"__totals{i}") for i, c in enumerate(counts)))
    heads = totals.select(*group, "__bucket").join(listed, group) if group else totals.select("__bucket").crossJoin(F.broadcast(listed))
    return placed, heads.select(*(F.col(c).alias(c) for c in heads.columns))


def _grouped(rows: DataFrame, group: list[str], sides: list, sums, fields: str) -> DataFrame:
    placed, heads = _bucketed(rows, group, sides)
    keys = [*group, "__bucket"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.select(*keys).schema)
    return placed.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInPandas(sums, f"{kinds}, rep long, {fields}")


def _per_bucket(replicates: int, seed: int, keys: list[str], columns: list[str], summed):
    """Runs ``summed(values, counts by side)`` over tiles of replicates of a bucket."""

    def run(key, pdf: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__v", kind="stable")
        values, sides = pdf["__v"].to_numpy(float), [c for c in pdf if c.startswith("__t") and c[3:].isdigit()]
        bucket = list(head["__numbers"].iloc[0]).index(key[-1])
        draws = [shares(replicates, np.cumsum([0, *head[f"__totals{i}"].iloc[0]]).tolist(), bucket, i, seed) for i in range(len(sides))]
        width, parts = max(1, CELLS // max(1, max(int(d.max(initial=0)) for d in draws), len(values))), []
        for at in range(0, replicates, width):
            reps = np.arange(at, min(replicates, at + width))
            drawn = [drawn_counts(reps, d[reps], pdf[c].to_numpy(np.int64), bucket, i, seed) for i, (c, d) in enumerate(zip(sides, draws, strict=True))]
            parts.append(pd.DataFrame({"rep": reps} | dict(zip(columns, summed(values, *drawn), strict=True))))
        out = pd.concat(parts)
        for name, value in zip(keys, key, strict=True):
            out[name] = value
        return out[[*keys, "rep", *columns]]

    return run


def bootstrap_mean_ci(rows: DataFrame, value: str, group: list[str], replicates: int = 5000, seed: int = 42) -> DataFrame:
    """2.5 and 97.5 percentiles of the means of resamples of each group."""
    keep = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    run = _per_bucket(replicates, seed, [*group, "__bucket"], ["k", "s"], lambda v, one: (one.sum(axis=1), one @ v))
    sums = _grouped(keep, group, [F.lit(True)], run, "k long, s double")
    means = sums.groupBy(*group, "rep").agg(F.try_divide(F.sum("s"), F.sum("k")).alias("m"))
    return means.groupBy(*group).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def _wins(values: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple:
    below = np.cumsum(two, axis=1) - two
    return one.sum(axis=1), two.sum(axis=1), (one * (below + two / 2)).sum(axis=1)


def bootstrap_rank_biserial_ci(rows: DataFrame, first: str, value: str, group: list[str] | None = None, replicates: int = 3000, seed: int = 42) -> DataFrame:
    """Percentile interval of r between the rows with and without the flag ``first``, both resampled.

    A bucket returns, for each replicate, both sides' counts and the wins inside;
    prefix sums over buckets add the rest.
    """
    group = group or []
    keep = rows.where(F.col(value).isNotNull() & F.col(first).isNotNull()).select(*group, F.col(first).alias("__first"), F.col(value).cast("double").alias("__v"))
    run = _per_bucket(replicates, seed, [*group, "__bucket"], ["k1", "k2", "won"], _wins)
    sums = _grouped(keep, group, [F.col("__first"), ~F.col("__first")], run, "k1 long, k2 long, won double")
    below = F.coalesce(F.sum("k2").over(Window.partitionBy(*group, "rep").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = sums.withColumn("won", F.col("won") + F.col("k1") * below).groupBy(*group, "rep").agg(F.sum("won").alias("u"), F.sum("k1").alias("n1"), F.sum("k2").alias("n2"))
    r = u.select(*group, (2 * F.try_divide(F.col("u"), F.col("n1") * F.col("n2")) - 1).alias("r"))
    return r.groupBy(*group).agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))
