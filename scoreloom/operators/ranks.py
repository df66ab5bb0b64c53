"""Ranks with averaged ties at any size, tie sums, Holm's adjustment and double centring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.sources.scratch import written

BUCKETS = 64


def ranked_values(rows: DataFrame, value: str, group: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``(*group, __v, __t, rank)``: the distinct values of a group, how often each occurs, and its rank, ties averaged.

    Distinct values are counted first and cut into buckets at quantiles. Only a
    bucket is ordered by a window; prefix sums over the bucket totals, a few rows
    a group, place it. No partition holds a whole group. Approximate quantiles, and
    values that are sums, depend on the order in which tasks deliver, so the values
    are written with their buckets: totals and places then speak of the same buckets.
    """
    group = group or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count("*").alias("__t"))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = counts.groupBy(*group).agg(F.percentile_approx("__v", cuts, 1000).alias("__cuts"))
    placed = counts.join(bounds, group) if group else counts.crossJoin(F.broadcast(bounds))
    placed = written(placed.withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts"), "buckets")
    totals = placed.groupBy(*group, "__b").agg(F.sum("__t").alias("__total"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "__b", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("__in", F.coalesce(F.sum("__t").over(inside), F.lit(0))).join(totals, [*group, "__b"])
    return ranked.select(*group, "__v", "__t", (F.col("__before") + F.col("__in") + (F.col("__t") + 1) / 2).alias("rank"))


def average_rank(rows: DataFrame, value: str, group: list[str] | None = None, name: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with the rank of ``value``, ties averaged, within ``group`` or over all rows. Nulls have no rank.

    ``rows`` is read twice and must hold equal values both times: sums are ``written`` before.
    """
    group = group or []
    ranked = ranked_values(rows, value, group, buckets).select(*group, F.col("__v").alias(value), F.col("rank").alias(name))
    return rows.join(ranked, [*group, value], "left").select(*rows.columns, name)


def exact_median(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """``median`` of each group, read off the ranks: of the values that hold the middle places."""
    ranked = ranked_values(rows, value, group)
    sizes = ranked.groupBy(*group).agg(F.sum("__t").alias("__n"))
    last = F.col("rank") + (F.col("__t") - 1) / 2
    first = F.col("rank") - (F.col("__t") - 1) / 2
    holds = lambda place: (first <= place) & (place <= last)
    lower, upper = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    middle = ranked.join(sizes, group).where(holds(lower) | holds(upper))
    return middle.groupBy(*group).agg(((F.min("__v") + F.max("__v")) / 2).alias("median"))


def block_rank(value: str, block: list[str]) -> Column:
    """The same inside small blocks, as a window expression."""
    return F.rank().over(Window.partitionBy(*block).orderBy(value)) + (F.count("*").over(Window.partitionBy(*block, value)) - 1) / 2


def tie_sum(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Σ(t³ − t) over the sizes of ties."""
    group = group or []
    t = F.col("t").cast("double")
    return rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("t")).groupBy(*group).agg(F.sum(t * t * t - t).alias("ties"))


def holm_adjust(rows: DataFrame, p: str, group: list[str] | None = None) -> DataFrame:
    """``p_holm``: step-down adjusted p-values, for result tables of a few rows a group."""
    own = Window.partitionBy(*(group or [F.lit(0)]))
    order = own.orderBy(p)
    stepped = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(own) - F.row_number().over(order) + 1))
    return rows.withColumn("__step", stepped).withColumn("p_holm", F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def centered_cells(rows: DataFrame, score: str = "OverallScore") -> DataFrame:
    """Cell mean − row mean − column mean + grand mean over all rows."""
    keep = rows.where(F.col(score).isNotNull())
    cells = keep.groupBy("Reference", "Model").agg(F.avg(score).alias("cell"))
    r = keep.groupBy("Reference").agg(F.avg(score).alias("row_mean"))
    c = keep.groupBy("Model").agg(F.avg(score).alias("column_mean"))
    g = keep.agg(F.avg(score).alias("grand"))
    joined = cells.join(F.broadcast(r), "Reference").join(F.broadcast(c), "Model").crossJoin(F.broadcast(g))
    return joined.select("Reference", "Model", "cell", (F.col("cell") - F.col("row_mean") - F.col("column_mean") + F.col("grand")).alias("residual"))


def centered_documents(rows: DataFrame, references: int, models: int, score: str = "OverallScore") -> DataFrame:
    """The same inside each document; null where the document's grid has a hole."""
    cells = rows.groupBy("document_id", "Reference", "Model").agg(F.avg(score).alias("cell"))
    w = lambda *keys: Window.partitionBy("document_id", *keys)
    residual = F.col("cell") - F.avg("cell").over(w("Reference")) - F.avg("cell").over(w("Model")) + F.avg("cell").over(w())
    full = F.count("cell").over(w()) == references * models
    return cells.repartition("document_id").select("document_id", "Reference", "Model", F.when(full, residual).alias("residual"))
