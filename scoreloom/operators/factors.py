"""Least squares on two factors of any number of levels, on cell sums in Spark.

Rows become cells (a, b, n, mean). The additive model's normal equations are
solved without dummy columns: one factor is eliminated, and conjugate gradients
run on the levels of the other, a table of one row a level. A step is two joins
of the cells with a vector and two sums; only dot products reach the driver.
Up to ``SMALL_LEVELS`` levels of the shorter factor the same reduced matrix is
solved at once by numpy, which saves the rounds and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.sources.scratch import written

#: Levels of the shorter factor whose matrix the driver may hold.
SMALL_LEVELS = 200
#: Conjugate gradients end when the residual has shrunk so far.
TOLERANCE, MAX_STEPS = 1e-12, 500


def cell_sums(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """``(a, b, n, m, w)`` of the rows with a value: number, mean, and squares within. Null is a level."""
    level = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)
    keep = rows.where(F.col(value).isNotNull()).select(level(a), level(b), F.col(value).cast("double").alias("v"))
    return keep.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("w"))


def components(cells: DataFrame) -> int:
    """How many parts the cells fall into, of which no two share a level: the design's rank is levels - parts."""
    labels, before = cells.groupBy("b").agg(F.min("a").alias("label")), None
    while True:
        labels = written(labels)
        found = tuple(labels.agg(F.countDistinct("label"), F.sum(F.xxhash64("b", "label") % 1_000_000_007)).first())
        if found == before:
            return found[0]
        before = found
        # The least label goes to the levels of the one factor, and from them to those of the other.
        over_a = cells.join(labels, "b").groupBy("a").agg(F.min("label").alias("label"))
        labels = cells.join(over_a, "a").groupBy("b").agg(F.min("label").alias("label"))


def _reduced(cells: DataFrame) -> float:
    """The additive model's residual between the cells, solved on the driver: a matrix of the levels of ``b``, however many ``a`` has."""
    by_a = cells.groupBy("a").agg(F.sum("n").alias("na"), F.sum(F.col("n") * F.col("m")).alias("sa"))
    own = cells.join(by_a, "a").select("a", "b", "n", "m", "na", "sa")
    pairs = own.alias("x").join(own.alias("y"), "a").groupBy(F.col("x.b").alias("p"), F.col("y.b").alias("q")).agg(F.sum(F.col("x.n") * F.col("y.n") / F.col("x.na")).alias("c"))
    sums = own.groupBy("b").agg(F.sum("n").alias("nb"), F.sum(F.col("n") * F.col("m")).alias("sb"), F.sum(F.col("n") * F.col("sa") / F.col("na")).alias("ab"))
    rows = sums.orderBy("b").collect()
    at = {r["b"]: i for i, r in enumerate(rows)}
    matrix = np.diag([float(r["nb"]) for r in rows])
    for r in pairs.collect():
        matrix[at[r["p"]], at[r["q"]]] -= r["c"]
    right = np.array([r["sb"] - r["ab"] for r in rows])
    beta = np.linalg.lstsq(matrix, right, rcond=None)[0]
    # Σ n m² − Σ sa² / na − β'r: what is left when both factors are fitted.
    squares = cells.agg(F.sum(F.col("n") * F.col("m") * F.col("m"))).first()[0]
    fitted = by_a.agg(F.sum(F.col("sa") * F.col("sa") / F.col("na"))).first()[0]
    return max(0.0, float(squares - fitted - beta @ right))


def _conjugate(cells: DataFrame) -> float:
    """The same by conjugate gradients, preconditioned by the levels' sizes; no level's vector leaves Spark."""
    cells = written(cells)
    by_a = cells.groupBy("a").agg(F.sum("n").alias("na"), F.sum(F.col("n") * F.col("m")).alias("sa"))
    weighted = written(cells.join(by_a, "a").select("a", "b", "n", "m", "na", (F.col("sa") / F.col("na")).alias("ma")))
    # Of each level: size, residual r, direction d and what is to be added to r'β.
    state = weighted.groupBy("b").agg(F.sum("n").cast("double").alias("nb"), F.sum(F.col("n") * (F.col("m") - F.col("ma"))).alias("right"))
    state = written(state.select("b", "nb", "right", F.col("right").alias("r"), (F.col("right") / F.col("nb")).alias("d"), F.lit(0.0).alias("x")))
    dot = state.agg(F.sum(F.col("r") * F.col("r") / F.col("nb"))).first()[0] or 0.0
    first = dot
    for _ in range(MAX_STEPS):
        if dot <= TOLERANCE * TOLERANCE * max(first, 1e-300):
            break
        inner = weighted.join(state.select("b", "d"), "b").groupBy("a").agg((F.sum(F.col("n") * F.col("d")) / F.first("na")).alias("g"))
        pulled = weighted.join(inner, "a").groupBy("b").agg(F.sum(F.col("n") * F.col("g")).alias("pull"))
        moved = written(state.join(pulled, "b").withColumn("q", F.col("nb") * F.col("d") - F.col("pull")))
        size = moved.agg(F.sum(F.col("d") * F.col("q"))).first()[0]
        if not size or size <= 0:
            break
        step = dot / size
        moved = moved.select("b", "nb", "right", (F.col("r") - step * F.col("q")).alias("r"), "d", (F.col("x") + step * F.col("d")).alias("x"))
        after = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("nb"))).first()[0]
        state = written(moved.withColumn("d", F.col("r") / F.col("nb") + after / dot * F.col("d")))
        dot = after
    explained = state.agg(F.sum(F.col("x") * F.col("right"))).first()[0] or 0.0
    sums = weighted.agg(F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("ma")).alias("f")).first()
    return max(0.0, float(sums["s"] - sums["f"] - explained))


def additive_residual(cells: DataFrame) -> tuple[float, int]:
    """Squares between the cells that the two factors' sum leaves, and the rank of the design."""
    sizes = cells.agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b"), F.count("*").alias("cells")).first()
    if not sizes["cells"]:
        return 0.0, 0
    if sizes["b"] > sizes["a"]:
        cells = cells.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "m")
    small = min(sizes["a"], sizes["b"]) <= SMALL_LEVELS
    rank = sizes["a"] + sizes["b"] - components(cells)
    return (_reduced(cells) if small else _conjugate(cells)), rank


def two_way_anova(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Type-II sums of squares of two factors and their interaction, of any number of levels and with empty cells: ``(term, ss, df, f, eta2, df2)``.

    A factor's squares are what the other one alone leaves beyond both.
    """
    cells = cell_sums(rows, a, b, value)
    # Means are centred, so squares do not drown in a large common mean.
    middle = float(rows.agg(F.avg(F.col(value).cast("double"))).first()[0] or 0.0)
    cells = written(cells.withColumn("m", F.col("m") - middle))
    both, rank = additive_residual(cells.select("a", "b", "n", "m"))

    def alone(factor: str) -> tuple[float, int]:
        levels = cells.groupBy(factor).agg((F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("left"))
        found = levels.agg(F.sum("left").alias("left"), F.count("*").alias("k")).first()
        return float(found["left"] or 0.0), found["k"]

    whole = cells.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("cells")).first()
    (of_a, ka), (of_b, kb) = alone("a"), alone("b")
    within, count, n = float(whole["w"] or 0.0), whole["cells"], whole["n"] or 0
    df2 = n - count
    found = [(a, max(0.0, of_b - both), rank - kb), (b, max(0.0, of_a - both), rank - ka), (f"{a}:{b}", both, count - rank), ("Residual", within, df2)]
    total = sum(x[1] for x in found)
    f = lambda ss, df: float(ss / df / (within / df2)) if within > 0 and df and df2 else None
    out = [(name, float(ss), int(df), None if name == "Residual" else f(ss, df), float(ss / total) if total else None) for name, ss, df in found]
    return rows.sparkSession.createDataFrame(out, "term string, ss double, df long, f double, eta2 double").withColumn("df2", F.lit(df2))
