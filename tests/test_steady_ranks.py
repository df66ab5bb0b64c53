"""Ranks of values that come out a little otherwise at every reading, as sums do on a cluster, where parts meet in any order."""

import random

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.operators import inference, ranks


@F.arrow_udf(T.DoubleType())
def unsteady(values: pa.Array) -> pa.Array:
    noise = random.SystemRandom()
    return pa.array([v + noise.random() * 1e-9 for v in values.to_pylist()], pa.float64())


def test_rank_sums_of_sums(spark):
    rows = spark.range(40).select((F.col("id") % 4).alias("comparison"), (F.col("id") % 8 < 4).alias("first"), unsteady(F.col("id")).alias("v"))
    found = inference.with_rank_sum_p(inference.rank_sums(rows)).collect()
    # Of each four, first values take turns with the others: 1 + 3 + 5 + 7 + 9 less 1 + 2 + 3 + 4 + 5.
    assert [(r.n1, r.n2, r.u, r.ties) for r in found] == [(5, 5, 10.0, 0.0)] * 4


def test_signed_ranks_of_differences(spark):
    # Per group 1 to 10, the even ones less than nothing: 1 + 3 + 5 + 7 + 9.
    rows = spark.range(40).select((F.col("id") % 4).alias("g"), F.floor(F.col("id") / 4 + 1).alias("n")).select("g", unsteady(F.when(F.col("n") % 2 == 0, -F.col("n")).otherwise(F.col("n"))).alias("d"))
    found = inference.signed_rank(rows, "d", ["g"]).collect()
    assert [(r.n, r.w_plus, r.w, r.zeros, r.wins) for r in found] == [(10, 25.0, 25.0, 0, 5)] * 4


def test_places_and_totals_speak_of_the_same_buckets(spark):
    key = "spark.sql.exchange.reuse"
    spark.conf.set(key, "false")
    try:
        rows = spark.range(3000).select((F.col("id") % 2).alias("g"), unsteady(F.col("id")).alias("v"))
        for group, sizes in (([], [3000]), (["g"], [1500, 1500])):
            found = ranks.ranked_values(rows, "v", group).select("rank").collect()
            assert sorted(r["rank"] for r in found) == sorted(float(k) for n in sizes for k in range(1, n + 1))
    finally:
        spark.conf.unset(key)


def test_mann_whitney_over_many_buckets(spark):
    key = "spark.sql.exchange.reuse"
    spark.conf.set(key, "false")
    try:
        side = F.when(F.col("id") % 3 == 0, "x").otherwise("y")
        rows = spark.range(3000).select(side.alias("m"), unsteady(F.col("id")).alias("v"))
        found = inference.mann_whitney(rows, "m", "v", [("x", "y")]).first()
    finally:
        spark.conf.unset(key)
    # The k-th x has 2 (k - 1) of the y below it.
    assert (found.n1, found.n2, found.u, found.ties) == (1000, 2000, 999_000.0, 0.0)
