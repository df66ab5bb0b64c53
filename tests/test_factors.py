"""Two-factor fits against numpy on dummy columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import factors


def brute_anova(data):
    """Residual squares of dummy designs by numpy."""
    a, b = (np.array([str(d[k]) for d in data]) for k in (0, 1))
    y = np.array([d[2] for d in data], float)
    dummies = lambda x: (x[:, None] == np.unique(x)[None, :]).astype(float)

    def left(*parts):
        design = np.column_stack(parts)
        fit = design @ np.linalg.lstsq(design, y, rcond=None)[0]
        return float(((y - fit) ** 2).sum()), int(np.linalg.matrix_rank(design))

    (both, rank), (of_a, ka), (of_b, kb), (within, cells) = left(dummies(a), dummies(b)), left(dummies(a)), left(dummies(b)), left(dummies(np.char.add(np.char.add(a, "|"), b)))
    return {"a": (of_b - both, rank - kb), "b": (of_a - both, rank - ka), "a:b": (both - within, cells - rank), "Residual": (within, len(y) - cells)}


@pytest.mark.parametrize("small", [200, 0])
def test_anova_equals_numpy(spark, monkeypatch, small):
    monkeypatch.setattr(factors, "SMALL_LEVELS", small)
    rng = np.random.default_rng(3)
    # Unbalanced, with empty cells; the levels 8 and 9 share nothing with the others; null is a level.
    data = [(a, b, float(1e4 + a + 2 * b + rng.normal())) for a in range(8) for b in range(6) for _ in range(int(rng.integers(0, 4)))]
    data += [(a, b, float(rng.normal())) for a in (8, 9) for b in (6, 7) for _ in range(2)]
    rows = spark.createDataFrame([(None if a == 3 else a, b, v) for a, b, v in data] + [(1, 1, None)], "a int, b int, v double")
    got = {r.term: r for r in factors.two_way_anova(rows, "a", "b", "v").collect()}
    for term, (ss, df) in brute_anova(data).items():
        assert got[term].ss == pytest.approx(ss, rel=1e-6, abs=1e-6) and got[term].df == df
    assert sum(r.eta2 for r in got.values()) == pytest.approx(1)


def test_twenty_thousand_levels(spark):
    """20,000 levels against 300: no dummy columns, no vector on the driver, and the additive part is found exactly."""
    rows = spark.range(200_000).select((F.xxhash64("id", F.lit(1)) % 20_000).alias("a"), (F.xxhash64("id", F.lit(2)) % 300).alias("b"))
    rows = rows.withColumn("v", F.sin(F.col("a")) * 10 + F.cos(F.col("b")) * 5)
    got = {r.term: r for r in factors.two_way_anova(rows, "a", "b", "v").collect()}
    assert got["a"].df > 30_000 and got["a:b"].ss == pytest.approx(0, abs=1e-3) and got["b"].ss > 1e5
    levels = rows.agg(F.countDistinct("a"), F.countDistinct("b")).first()
    assert (got["a"].df, got["b"].df) == (levels[0] - 1, levels[1] - 1)
