"""Mixed models with a random intercept per unit, for data with holes.

The likelihood needs, beside the moments of all rows, the products of the units'
sums by unit size alone. Spark reduces the rows to those, a row for each size;
numpy finds the ratio of the two variances.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of fixed effects, whose products are columns and whose matrix the driver holds.
MAX_EFFECTS = 120


def levels(rows: DataFrame, columns: list[str]) -> list[tuple]:
    """The different values of the columns, in order; an error above ``MAX_EFFECTS``."""
    found = rows.select(*columns).distinct().limit(MAX_EFFECTS + 1).collect()
    if len(found) > MAX_EFFECTS:
        raise ValueError(f"over {MAX_EFFECTS} levels of {', '.join(columns)}")
    return sorted(map(tuple, found), key=lambda r: tuple((x is not None, x) for x in r))


def fit_random_intercept(rows: DataFrame, unit: str, value: str, effects: list[Column], reml: bool) -> dict:
    """``beta``, its covariance, both variances and the numbers of rows and units."""
    y, keep = F.col("y"), F.col(value).isNotNull() & F.col(unit).isNotNull()
    names = [f"x{i}" for i in range(len(effects))]
    data = rows.where(keep).select(F.col(unit).alias("unit"), F.col(value).cast("double").alias("y"), *(e.cast("double").alias(n) for e, n in zip(effects, names, strict=True)))
    middle = float(data.agg(F.avg("y")).first()[0] or 0.0)
    data = data.withColumn("y", y - middle)
    columns = [*names, "y"]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    p = len(names)

    def matrix(row) -> np.ndarray:
        return np.array([[row[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p + 1)] for i in range(p + 1)])

    whole = data.agg(F.count("*").alias("n"), *products).first()
    by_size = data.groupBy("unit").agg(F.count("*").alias("size"), *(F.sum(c).alias(c) for c in columns)).groupBy("size").agg(F.count("*").alias("units"), *products).collect()
    total, n = matrix(whole), whole["n"]
    parts = [(r["size"], r["units"], matrix(r)) for r in by_size]
    rank = int(np.linalg.matrix_rank(total[:p, :p])) if n else 0

    def profile(ratio: float):
        m = total - sum((ratio / (1 + k * ratio) * s for k, _, s in parts), np.zeros_like(total))
        inverse = np.linalg.pinv(m[:p, :p], hermitian=True)
        beta = inverse @ m[:p, p]
        rss = max(0.0, float(m[p, p] - m[:p, p] @ beta))
        df = n - rank if reml else n
        if df <= 0 or rss <= 0:
            return math.inf, beta, inverse, 0.0
        spread = np.linalg.eigvalsh(m[:p, :p])
        loss = df * math.log(rss / df) + sum(u * math.log1p(k * ratio) for k, u, _ in parts) + (float(np.log(spread[-rank:]).sum()) if reml else 0.0)
        return loss, beta, inverse, rss / df

    grid = [0.0, *np.exp(np.linspace(-12, 9, 85))]
    best = min(range(len(grid)), key=lambda i: profile(grid[i])[0])
    low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if profile(a)[0] <= profile(b)[0] else (a, high)
    ratio = min((grid[best], (low + high) / 2), key=lambda r: profile(r)[0])
    _, beta, inverse, sigma = profile(ratio)
    return {"beta": beta, "covariance": sigma * inverse, "var_unit": float(ratio * sigma), "var_residual": float(sigma), "rows": n, "units": sum(u for _, u, _ in parts)}


def random_intercept(rows: DataFrame, unit: str, cells: list[str], value: str) -> DataFrame:
    """Variance of the intercept per ``unit`` beside fixed cells, and its share (ICC), by REML over all rows."""
    known = rows.where(F.col(value).isNotNull())
    effects = [sum((F.col(c).eqNullSafe(F.lit(v)).cast("int") for c, v in zip(cells, level, strict=True)), F.lit(0)) == len(cells) for level in levels(known, cells)]
    fit = fit_random_intercept(known, unit, value, effects, reml=True)
    both = fit["var_unit"] + fit["var_residual"]
    return rows.sparkSession.createDataFrame([(fit["units"], fit["rows"], fit["var_unit"], fit["var_residual"], fit["var_unit"] / both if both else None)], "units long, rows long, var_unit double, var_residual double, icc double")


def family_contrast(rows: DataFrame, unit: str, row: str, column: str, flag: str, value: str) -> DataFrame:
    """Effect of a flag beside row, column and a random intercept per unit, by maximum likelihood over all rows."""
    known = rows.where(F.col(value).isNotNull())
    dummies = [F.col(c).eqNullSafe(F.lit(v)) for c in (row, column) for (v,) in levels(known, [c])[1:]]
    fit = fit_random_intercept(known, unit, value, [F.lit(1), *dummies, F.col(flag)], reml=False)
    beta, se = float(fit["beta"][-1]), math.sqrt(max(0.0, float(fit["covariance"][-1, -1])))
    return rows.sparkSession.createDataFrame([(beta, se, beta / se if se else None)], "beta double, se double, z double")
