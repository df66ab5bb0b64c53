"""Tests, effect sizes, regressions and bootstraps on evaluation tables.

Spark reduces every test to a few rows of sums; p-values are read off the
result rows by ``with_p``.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions import tails
from scoreloom.operators.ranks import average_rank, block_rank, exact_median, ranked_values, tie_sum
from scoreloom.sources.scratch import written


def _tail(function, *columns) -> Column:
    @F.arrow_udf(T.DoubleType())
    def apply(*arrays: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in arrays), strict=True)
        return pa.array([None if None in r or any(math.isnan(x) for x in r) else function(*r) for r in rows], pa.float64())

    return apply(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns))


#: Pairs up to which signed ranks have an exact p, the size of the smaller sample up to which U has one, and the products of sizes up to which it is counted.
EXACT_PAIRS, EXACT_SAMPLE, EXACT_CELLS = 50, 8, 10_000_000


def with_signed_rank_p(rows: DataFrame) -> DataFrame:
    """Adds ``p`` to what ``signed_rank`` returns: exact for up to ``EXACT_PAIRS`` pairs without a zero, by the normal approximation else."""
    exact = (F.col("n") <= EXACT_PAIRS) & (F.col("zeros") == 0)
    small = _tail(tails.signed_rank_exact, F.when(exact, F.col("n")), "w_plus")
    return rows.withColumn("p", F.when(exact, small).otherwise(_tail(tails.normal_two_sided, "z")))


def with_rank_sum_p(rows: DataFrame) -> DataFrame:
    """Adds ``p`` to what ``mann_whitney`` returns: exact without ties if a sample has up to ``EXACT_SAMPLE`` values, by the normal approximation else."""
    n1, n2 = F.col("n1"), F.col("n2")
    exact = (F.least(n1, n2) <= EXACT_SAMPLE) & (F.least(n1, n2) > 0) & (F.col("ties") == 0) & (n1 * n2 <= EXACT_CELLS)
    small = _tail(tails.rank_sum_exact, F.when(exact, n1), "n2", "u")
    # The correction for continuity may take z below the middle.
    return rows.withColumn("p", F.when(exact, small).otherwise(_tail(lambda z: tails.normal_two_sided(max(z, 0.0)), "z")))


def with_p(rows: DataFrame, kind: str, *columns) -> DataFrame:
    """Adds ``p`` of a statistic: ``normal(z)``, ``chi2(x, df)`` or ``f(f, df1, df2)``."""
    return rows.withColumn("p", _tail({"normal": tails.normal_two_sided, "chi2": tails.chi2_tail, "f": tails.f_tail}[kind], *columns))


def one_way_f(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """``(f, df1, df2)`` from the sums of each group."""
    cells = rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("w"))
    total = cells.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum("w").alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("N")
    df1, df2 = F.col("k") - 1, F.col("N") - F.col("k")
    return total.select(F.try_divide(F.try_divide(between, df1), F.try_divide("within", df2)).alias("f"), df1.alias("df1"), df2.alias("df2"))


def brown_forsythe(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """One-way F of the distances to each cell's median."""
    middle = exact_median(rows, value, group).withColumnRenamed("median", "__median")
    return one_way_f(rows.join(middle, group).withColumn("__d", F.abs(F.col(value) - F.col("__median"))), group, "__d")


def kruskal_wallis(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``(h, df)``, corrected for ties."""
    ranked = average_rank(rows.where(F.col(value).isNotNull()).select(group, value), value)
    sums = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    total = sums.agg(F.sum("n").cast("double").alias("N"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")).crossJoin(F.broadcast(tie_sum(rows, value)))
    n = F.col("N")
    h = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return total.select(F.try_divide(h, 1 - F.try_divide("ties", n * n * n - n)).alias("h"), (F.col("k") - 1).alias("df"))


def friedman(rows: DataFrame, block: str, treatment: str, value: str, treatments: int) -> DataFrame:
    """``(chi2, df, w, blocks)`` of block-wise ranks of treatment means; incomplete blocks do not count."""
    cells = rows.groupBy(block, treatment).agg(F.avg(value).alias("v")).where(F.col("v").isNotNull())
    full = cells.join(cells.groupBy(block).agg(F.count("*").alias("c")).where(F.col("c") == treatments).select(block), block)
    ranked = full.withColumn("rank", block_rank("v", [block]))
    sums = ranked.groupBy(treatment).agg(F.sum("rank").alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("q"))
    size = full.agg(F.countDistinct(block).alias("blocks")).crossJoin(F.broadcast(tie_sum(full, "v", [block]).agg(F.sum("ties").alias("ties"))))
    n, k = F.col("blocks"), F.lit(treatments)
    raw = 12 / (n * k * (k + 1)) * F.col("q") - 3 * n * (k + 1)
    chi2 = F.try_divide(raw, 1 - F.col("ties") / (n * k * (k * k - 1)))
    return sums.crossJoin(F.broadcast(size)).select(chi2.alias("chi2"), (k - 1).alias("df"), F.try_divide(chi2, n * (k - 1)).alias("w"), n.alias("blocks"))


def signed_rank(diffs: DataFrame, d: str, group: list[str]) -> DataFrame:
    """Wilcoxon's signed ranks per group: ``n``, mean, ``w`` without zeros, paired r over all, dz, wins, z, and what ``with_signed_rank_p`` reads.

    z is the normal approximation with tie correction, at every size.
    """
    # Differences of means may come out otherwise at every reading, and would not find their ranks.
    rows = written(diffs.where(F.col(d).isNotNull()).select(*group, d), "differences").withColumn("__a", F.abs(d))
    ranked = average_rank(rows, "__a", group, "rank_all")
    nonzero = average_rank(rows.where(F.col(d) != 0), "__a", group, "rank_nz")
    plus = lambda c: F.sum(F.when(F.col(d) > 0, F.col(c)).otherwise(0.0))
    minus = lambda c: F.sum(F.when(F.col(d) < 0, F.col(c)).otherwise(0.0))
    total = ranked.groupBy(*group).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.sum(F.when(F.col(d) > 0, 1).otherwise(0)).alias("wins"), plus("rank_all").alias("rp"), minus("rank_all").alias("rm"))
    zero_free = nonzero.groupBy(*group).agg(F.count("*").alias("m"), plus("rank_nz").alias("wp"), minus("rank_nz").alias("wm")).join(tie_sum(rows.where(F.col(d) != 0), "__a", group), group)
    m = F.col("m")
    z = F.try_divide(F.least("wp", "wm") - m * (m + 1) / 4, F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48))
    return total.join(zero_free, group, "left").select(*group, "n", "mean", F.least("wp", "wm").alias("w"), F.try_divide(F.col("rp") - F.col("rm"), F.col("rp") + F.col("rm")).alias("r"), F.try_divide("mean", "std").alias("dz"), "wins", z.alias("z"), F.col("wp").alias("w_plus"), (F.col("n") - F.coalesce(m, F.lit(0))).alias("zeros"))


def paired_differences(rows: DataFrame, pairs: list[tuple[str, str]], block: str = "document_id", treatment: str = "Model", value: str = "OverallScore") -> DataFrame:
    """``(comparison, block, d)`` for each listed pair, from one pivot of block means."""
    names = sorted({m for p in pairs for m in p})
    wide = rows.groupBy(block).pivot(treatment, names).agg(F.avg(value))
    each = F.array(*(F.struct(F.lit(f"{a} vs {b}").alias("comparison"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("d")) for a, b in pairs))
    return wide.select(block, F.explode(each).alias("e")).select("e.comparison", block, "e.d").where("d is not null")


def both_sides(rows: DataFrame, column: str, value: str, pairs: list[tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """Each row once for every listed pair that it is in, with its side."""
    own = F.filter(F.array(*(F.struct(F.lit(f"{a} vs {b}").alias("comparison"), F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs)), lambda p: (p["x"] == F.col(column)) | (p["y"] == F.col(column)))
    return rows.where(F.col(value).isNotNull()).select(F.explode(own).alias("p"), F.col(column).alias("__g"), F.col(value).alias("v"), *(keep or [])).select("p.comparison", (F.col("p.x") == F.col("__g")).alias("first"), "v", *(keep or []))


def mann_whitney(rows: DataFrame, column: str, value: str, pairs: list[tuple[str, str]] | None = None, levels: list[str] | None = None) -> DataFrame:
    """U, rank-biserial r, z with tie and continuity correction, Cohen's d, the mean difference and the tie sum of each pair."""
    return rank_sums(both_sides(rows, column, value, pairs or list(combinations(sorted(levels), 2))))


def rank_sums(both: DataFrame) -> DataFrame:
    """The same for rows of ``(comparison, first, v)``, which are read several times and so written first."""
    both = written(both.select("comparison", "first", "v"), "sides")
    ranked = average_rank(both, "v", ["comparison"])
    one, two = F.when(F.col("first"), F.col("v")), F.when(~F.col("first"), F.col("v"))
    sums = ranked.groupBy("comparison").agg(
        F.count(one).alias("n1"), F.count(two).alias("n2"), F.sum(F.when(F.col("first"), F.col("rank"))).alias("r1"),
        F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"),
    ).join(tie_sum(both, "v", ["comparison"]), "comparison")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide("ties", n * (n - 1))))
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), n - 2))
    d = F.when(pooled == 0, 0.0).otherwise(F.try_divide(F.col("m1") - F.col("m2"), pooled))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, spread)
    return sums.select("comparison", "n1", "n2", (F.col("m1") - F.col("m2")).alias("delta"), u.alias("u"), (2 * F.try_divide(u, n1 * n2) - 1).alias("r"), d.alias("d"), z.alias("z"), "ties")


def two_type_rank_sum(rows: DataFrame, kind: str, unit: str, value: str) -> DataFrame:
    """Mann-Whitney with p on the means of units of two kinds, in the order of their names; no row unless there are exactly two kinds."""
    means = rows.groupBy(unit, kind).agg(F.avg(value).alias("v")).where(F.col(kind).isNotNull() & F.col("v").isNotNull())
    ends = means.agg(F.min(kind).alias("one"), F.max(kind).alias("two"), F.countDistinct(kind).alias("kinds")).where("kinds = 2")
    sides = means.crossJoin(F.broadcast(ends)).select(F.concat_ws(" vs ", "one", "two").alias("comparison"), (F.col(kind) == F.col("one")).alias("first"), "v")
    return with_rank_sum_p(rank_sums(sides))


def spearman(rows: DataFrame, a: str, b: str, group: list[str] | None = None) -> DataFrame:
    group = group or []
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, a, b)
    ranked = average_rank(average_rank(both, a, group, "__ra"), b, group, "__rb")
    return ranked.groupBy(*group).agg(F.corr("__ra", "__rb").alias("rho"), F.count("*").alias("n"))


def trend(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def ols_with_loocv(rows: DataFrame, response: str, regressors: list[str]) -> DataFrame:
    """R², adjusted R², F and leave-one-out R². The moments are one row; leverage is a column expression."""
    names = ["__one", *regressors]
    data = rows.select(F.col(response).cast("double").alias("__y"), *(F.col(c).cast("double").alias(c) for c in regressors)).dropna().withColumn("__one", F.lit(1.0))
    centre = data.agg(*(F.avg(c).alias(c) for c in regressors)).first()
    # Centred regressors keep the moments well conditioned.
    data = data.select("__y", "__one", *((F.col(c) - float(centre[c] or 0.0)).alias(c) for c in regressors))
    moments = data.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j), *(F.sum(F.col(a) * F.col("__y")).alias(f"y{i}") for i, a in enumerate(names)), F.count("*").alias("n"), F.avg("__y").alias("mean")).first()
    k, n = len(names), moments["n"]
    xtx = np.array([[moments[f"x{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ np.array([moments[f"y{i}"] or 0.0 for i in range(k)])
    fit = sum(F.col(c) * float(w) for c, w in zip(names, beta, strict=True))
    leverage = sum(F.col(a) * F.col(b) * float(inverse[i, j]) for i, a in enumerate(names) for j, b in enumerate(names))
    error = F.col("__y") - fit
    sums = data.agg(F.sum(error * error).alias("rss"), F.sum(F.pow(F.try_divide(error, 1 - leverage), 2)).alias("press"), F.sum(F.pow(F.col("__y") - F.lit(moments["mean"]), 2)).alias("sst"))
    df1, df2 = k - 1, n - k
    r2 = 1 - F.try_divide("rss", "sst")
    return sums.select(F.lit(n).alias("n"), r2.alias("r2"), (1 - (1 - r2) * (n - 1) / max(1, df2)).alias("adj_r2"), F.try_divide(F.try_divide(r2, F.lit(df1)), F.try_divide(1 - r2, F.lit(df2))).alias("f"), F.lit(df1).alias("df1"), F.lit(df2).alias("df2"), (1 - F.try_divide("press", "sst")).alias("loocv_r2"))


def yates_chi2(a, b, c, d) -> Column:
    n = a + b + c + d
    gap = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    return F.try_divide(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))


def sign_crosstab(rows: DataFrame, group: str, levels: tuple[str, str], value: str) -> DataFrame:
    """2×2 table of a two-level group by the sign of a value, Yates' χ² and the share of positives."""
    hit = lambda g, s: F.sum(F.when((F.col(group) == g) & s, 1).otherwise(0)).cast("double")
    positive = F.col(value) > 0
    table = rows.where(F.col(value).isNotNull()).agg(*(hit(g, s).alias(n) for g, s, n in ((levels[0], positive, "a"), (levels[0], ~positive, "b"), (levels[1], positive, "c"), (levels[1], ~positive, "d"))))
    a, b, c, d = (F.col(x) for x in "abcd")
    return table.select("a", "b", "c", "d", yates_chi2(a, b, c, d).alias("chi2"), F.try_divide(a + c, a + b + c + d).alias("share_positive"))


def balanced_intercept(rows: DataFrame, unit: str, cells: list[str], value: str) -> DataFrame:
    """Variance of a random intercept per ``unit`` beside fixed cells, and its share (ICC).

    Closed form for balanced data, where it equals REML when it is not negative:
    σ²_unit = (MS_unit − MS_residual) / k. Units with a missing cell do not count;
    ``mixed.random_intercept`` takes them in.
    """
    cell = rows.groupBy(unit, *cells).agg(F.avg(value).alias("v")).where(F.col("v").isNotNull())
    size = cell.groupBy(unit).agg(F.count("*").alias("k"))
    most = size.agg(F.max("k").alias("k"))
    full = cell.join(size.join(F.broadcast(most), "k").select(unit), unit)
    all_ = full.agg(F.count("*").alias("n"), F.avg("v").alias("g"), (F.var_pop("v") * F.count("*")).alias("total"))
    by_unit = full.groupBy(unit).agg(F.avg("v").alias("m"), F.count("*").alias("k"))
    units = by_unit.agg(F.count("*").alias("u"), F.max("k").alias("k"), (F.var_pop("m") * F.count("*")).alias("s"))
    treatments = full.groupBy(*cells).agg(F.avg("v").alias("m")).agg(F.count("*").alias("c"), (F.var_pop("m") * F.count("*")).alias("t"))
    j = all_.crossJoin(F.broadcast(units)).crossJoin(F.broadcast(treatments))
    ss_unit, ss_cell = F.col("s") * F.col("k"), F.col("t") * F.col("u")
    ms_res = F.try_divide(F.col("total") - ss_unit - ss_cell, (F.col("u") - 1) * (F.col("c") - 1))
    var_unit = F.greatest(F.lit(0.0), F.try_divide(F.try_divide(ss_unit, F.col("u") - 1) - ms_res, "k"))
    return j.select(F.col("u").alias("units"), var_unit.alias("var_unit"), ms_res.alias("var_residual"), F.try_divide(var_unit, var_unit + ms_res).alias("icc"))


def shapiro_w(n: int, squares: float, weighted: float, spread: float, low: float, second: float, before: float, high: float) -> float:
    """W by Royston's approximation of the weights, from sums over a sorted sample.

    ``squares`` is Σm² and ``weighted`` Σm·x of the expected normal order statistics m,
    ``spread`` the sum of squared deviations, the rest the two smallest and largest values.
    """
    if n < 3 or not spread > 0:
        return float("nan")
    if n == 3:
        return 0.5 * (high - low) ** 2 / spread
    m1, m2, u = _score(n, n), _score(n - 1, n), 1 / math.sqrt(n)
    # The published polynomials for the two largest weights.
    last = m1 / math.sqrt(squares) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    if n <= 5:
        phi = (squares - 2 * m1**2) / (1 - 2 * last**2)
        total = (weighted - m1 * (high - low)) / math.sqrt(phi) + last * (high - low)
    else:
        next_ = m2 / math.sqrt(squares) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        phi = (squares - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * next_**2)
        total = (weighted - m1 * (high - low) - m2 * (before - second)) / math.sqrt(phi) + last * (high - low) + next_ * (before - second)
    return float(min(1.0, total**2 / spread))


def _score(at: int, n: int) -> float:
    return _probit((at - 0.375) / (n + 0.25))


def _probit(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def shapiro_p(w: float, n: int) -> float:
    """Royston's normal approximation for 3 or more values."""
    if w >= 1:
        return 1.0
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-math.log(g - math.log(1 - w)) - mu) / sigma
    else:
        y = math.log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], y), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], y))
        z = (math.log(1 - w) - mu) / sigma
    return 0.5 * math.erfc(z / math.sqrt(2))


#: Up to so many values the published approximation of p was fitted.
SHAPIRO_LIMIT = 5000
#: Places of equal values that one row spells out.
BLOCK = 10_000


@F.arrow_udf(T.DoubleType())
def _scores(at: pa.Array, n: pa.Array) -> pa.Array:
    from statistics import NormalDist

    inverse = NormalDist().inv_cdf
    return pa.array([inverse((a - 0.375) / (k + 0.25)) for a, k in zip(at.to_pylist(), n.to_pylist(), strict=True)], pa.float64())


def shapiro_wilk(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """``(n, w, p, fitted_range)`` per group, over all its values whatever their number.

    Distinct values are ranked in buckets, so no task holds a group; each place of
    a tie has its own weight. ``fitted_range`` tells whether p is inside the range
    for which the approximation was published.
    """
    ranked = ranked_values(rows, value, group)
    sizes = ranked.groupBy(*group).agg(F.sum("__t").alias("n"))
    placed = (ranked.join(sizes, group) if group else ranked.crossJoin(F.broadcast(sizes))).withColumn("first", (F.col("rank") - (F.col("__t") - 1) / 2).cast("long"))
    blocks = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__t") - 1, F.lit(BLOCK).cast("long"))))
    places = blocks.withColumn("at", F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + F.least(F.col("from") + BLOCK, F.col("__t")) - 1)))
    places = places.withColumn("m", _scores("at", "n")).withColumn("__v", F.col("__v").cast("double"))
    pick = lambda k: F.max(F.when(F.col("at") == k, F.col("__v")))
    n = F.col("n")
    sums = places.groupBy(*group, "n").agg(F.sum(F.col("m") * F.col("m")).alias("squares"), F.sum(F.col("m") * F.col("__v")).alias("weighted"), (F.var_pop("__v") * F.count("*")).alias("spread"), pick(1).alias("low"), pick(F.least(F.lit(2), n)).alias("second"), pick(F.greatest(n - 1, F.lit(1))).alias("before"), pick(n).alias("high"))
    whole = lambda f: lambda n, *x: f(int(n), *x)
    tested = sums.withColumn("w", F.nanvl(_tail(whole(shapiro_w), "n", "squares", "weighted", "spread", "low", "second", "before", "high"), F.lit(None).cast("double")))
    return tested.withColumn("p", _tail(whole(lambda n, w: shapiro_p(w, n)), "n", "w")).select(*group, "n", "w", "p", (n <= SHAPIRO_LIMIT).alias("fitted_range"))


def normality(rows: DataFrame, group: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """The residuals of the cell means as one sample, and how many cells are not normal."""
    means = rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.avg(value).alias("__m"))
    residuals = rows.join(means, group).withColumn("__r", F.col(value) - F.col("__m"))
    cells = shapiro_wilk(rows, group, value).agg(F.count("*").alias("cells"), F.sum((F.coalesce("p", F.lit(1.0)) < alpha).cast("long")).alias("violating_cells"))
    return shapiro_wilk(residuals, [], "__r").crossJoin(F.broadcast(cells))
