"""Golden cases and invariants of names, tokens, Markdown structure, tails and ranks."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.functions import markdown, names, tails, tokens
from scoreloom.operators import bootstrap, factors, inference, lexical, mixed, predictions, ranks, scores, structure, vectors
from scoreloom.operators.pairs import grid_corpus, make_pairs

D1 = "# T\n\np1\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n- y"
D2 = "T\n===\n\np1\n\n- x"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_names(spark):
    cases = {
        "PAT-01_qwen3_6_ADR.md": ("PAT-01", "qwen3_6", "ADR"),
        "a_b_gpt_testplan.md": ("a_b", "chatgpt", "TestPlan"),
        "gemma_ADR.md": (None, "gemma", "ADR"),
        "PAT-01_qwen3_6plus_ADR.md": (None, None, None),
        "PAT-01_claude.md": ("PAT-01", "claude", None),
    }
    rows = spark.createDataFrame([(n,) for n in cases], "name string").select("name", names.parse_document_name(F.col("name")).alias("k")).collect()
    assert {r.name: tuple(r.k) for r in rows} == cases
    keys = spark.createDataFrame([("d_gemma_ADR.md",), ("d_qwen3_6_ADR.md",)], "n string").select(names.word_count_keys(F.col("n")).alias("k")).collect()
    assert [tuple(r.k) for r in keys] == [("d", "gemma"), (None, None)]


def test_text_rules(spark):
    assert one(spark, names.count_words(F.col("t")), t="가나 b_1 x-y") == 4
    assert one(spark, names.strip_front_matter(F.col("t")), t="---\na: 1\n---\n body \n") == "body"
    assert one(spark, names.sanitize_name(F.col("t")), t="a (old)  b--c") == "a_b_c"
    assert [one(spark, names.classify_doc_type(F.col("t")), t=x) for x in ("PAT-1", "rpt-2", "10-2", "z")] == ["patent", "report", "patent", "report"]
    text = "\n\n".join("x" * n for n in (1000, 600, 2000, 10))
    assert list(map(len, one(spark, tokens.chunk_text(F.col("t")), t=text))) == [1000, 600, 1500, 500, 10]
    a, b = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "xy"))
    assert [(p.a, p.b) for p in one(spark, tokens.align_chunks(a, b), t="")] == [("a", "x"), ("b", "x"), ("c", "y")]


def test_markdown_golden():
    assert len(markdown.awareness_tags(D1)) == 21 and len(markdown.awareness_tags(D2)) == 8
    t1, t2 = markdown.document_tree(D1), markdown.document_tree(D2)
    assert (t1.sizes[0], t2.sizes[0], markdown.tree_distance(t1, t2)) == (13, 5, 8)
    assert markdown.tree_distance(markdown.table_tree([2, 2]), markdown.table_tree([3, 3])) == 2
    tag = markdown.TAGS
    assert markdown.awareness_tags("* * *") == tag["ul"] + tag["li"] + tag["/li"] + tag["/ul"]
    assert markdown.document_tree("a\n\n---\n").labels == ["doc", "p", "p"] and markdown.document_tree("a\n---\n").labels == ["doc", "h2"]
    assert markdown.awareness_tags("a | b") != markdown.awareness_tags("a b") and markdown.document_tree("a | b").labels == ["doc", "p"]
    assert markdown.extract_tables("| a | b |\n|---|---|\n| 1 | 2 |") == [[["a", "b"], ["1", "2"]]]


def test_structure_golden(spark):
    docs = spark.createDataFrame([("d", "ADR", "r", D1), ("d", "ADR", "c", D2), ("e", "ADR", "r", D2), ("e", "ADR", "c", D2)], "document_id string, doc_type string, model string, text string")
    found = {r.document_id: r for r in structure.structure_similarity(docs, ["r"], ["c"]).collect()}
    assert found["d"].markdown_awareness_similarity == pytest.approx(0.380952, abs=1e-6)
    assert found["d"].teds_document_structure_similarity == pytest.approx(0.384615, abs=1e-6)
    assert found["d"].teds_table_structure_similarity == 0.0
    assert found["d"].overall_document_structure_similarity == pytest.approx(0.306227, abs=1e-6)
    assert found["e"].teds_table_structure_similarity is None and found["e"].overall_document_structure_similarity == 1.0


def brute_tree(a, b, i=0, j=0):
    left, right = ([k for k, p in enumerate(t.parents) if p == x] for t, x in ((a, i), (b, j)))
    d = {(0, 0): 0}
    for x in range(len(left) + 1):
        for y in range(len(right) + 1):
            options = [] if not x else [d[x - 1, y] + a.sizes[left[x - 1]]]
            if y:
                options.append(d[x, y - 1] + b.sizes[right[y - 1]])
            if x and y:
                options.append(d[x - 1, y - 1] + brute_tree(a, b, left[x - 1], right[y - 1]))
            if options:
                d[x, y] = min(options)
    return d[len(left), len(right)] + (a.labels[i] != b.labels[j])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# a", "## b", "p", "- x", "1. y", "| a | b |", "|---|---|", "", "```\nq\n```", "T\n---"]), max_size=12), st.lists(st.sampled_from(["# a", "### b", "p", "- x", "| a | b | c |", "", "T\n==="]), max_size=12))
def test_tree_distance(x, y):
    a, b = (markdown.document_tree("\n".join(t)) for t in (x, y))
    d = markdown.tree_distance(a, b)
    assert d == brute_tree(a, b) == markdown.tree_distance(b, a) and (d == 0) == (a == b)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    assert all(lexical.lcs_length(a, b, width) == row[-1] for width in (lexical.LCS_BITS, 3, 1))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment(n, m, seed):
    cost = np.random.default_rng(seed).random((n, m))
    small = cost if n <= m else cost.T
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
    assert vectors.assignment_cost(cost) == pytest.approx(best)


def test_lexical_golden(spark):
    docs = spark.createDataFrame([("d", "ADR", "r", "the cat sat"), ("d", "ADR", "c", "the cat ran home"), ("e", "ADR", "r", "alpha beta gamma"), ("e", "ADR", "c", "beta gamma delta"), ("f", "ADR", "r", "aa bb cc"), ("f", "ADR", "c", "aa bb cc dd ee")], "document_id string, doc_type string, model string, text string")
    rouge = {r.document_id: r for r in lexical.rouge(docs, ["r"], ["c"]).collect()}
    assert rouge["d"].rouge1 == pytest.approx(0.571429, abs=1e-6) and rouge["d"].rouge2 == pytest.approx(0.4)
    f1 = {r.document_id: r.f1_score for r in lexical.vocab_overlap_f1(docs, ["r"], ["c"]).collect()}
    assert f1["e"] == pytest.approx(2 / 3) and f1["f"] == 0.0
    both = make_pairs(docs.where("model = 'r'"), docs.where("model = 'c'")).select("document_id", lexical.rouge_l(F.col("ref_text"), F.col("cand_text")).alias("l"))
    assert {r.document_id: r.l for r in both.collect()}["d"] == pytest.approx(0.571429, abs=1e-6)
    same = lexical.bleu(docs.withColumn("text", F.lit("some words here")), ["r"], ["c"]).first().bleu_score
    # The third score keeps weights that sum to .99 of log 1 = 0.
    assert same == pytest.approx(1.0)


def test_scores(spark):
    row = {m: 0.5 for m in scores.LEXICAL} | {m: None for m in scores.SEMANTIC} | {m: 0.8 for m in scores.STRUCTURE}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{m} double" for m in row))
    got = df.select(scores.pair_score(list(row)).alias("a"), scores.weighted_score(list(row)).alias("b")).first()
    assert got.a == pytest.approx(0.690909, abs=1e-6) and got.b is None


def test_ranks_and_tests(spark):
    random.seed(4)
    values = [(g, random.choice([1, 2, 2, 3, 5, 8, None])) for g in "ab" for _ in range(200)]
    rows = spark.createDataFrame(values, "g string, v int")
    for group in ([], ["g"]):
        for r in ranks.average_rank(rows, "v", group, buckets=5).collect():
            own = [v for g, v in values if v is not None and (not group or g == r.g)]
            expected = None if r.v is None else sum(x < r.v for x in own) + (own.count(r.v) + 1) / 2
            assert r["rank"] == expected
    holm = ranks.holm_adjust(spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double"), "p")
    assert sorted((round(r.p_holm, 6)) for r in holm.collect()) == [0.03, 0.06, 0.06]
    mw = inference.mann_whitney(spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 4.0), ("y", 3.0), ("y", 5.0)], "g string, v double"), "g", "v", [("x", "y")]).first()
    assert mw.u == 1 and mw.r == pytest.approx(-2 / 3)
    fr = inference.friedman(spark.createDataFrame([(str(b), t, float(i)) for b in range(3) for i, t in enumerate("abc")], "b string, t string, v double"), "b", "t", "v", 3).first()
    assert fr.chi2 == pytest.approx(6) and fr.w == pytest.approx(1)
    grid = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), ("b", "y", 6.0)], "Reference string, Model string, OverallScore double")
    assert {(r.Reference, r.Model): r.residual for r in ranks.centered_cells(grid).collect()} == {("a", "x"): 0.5, ("a", "y"): -0.5, ("b", "x"): -0.5, ("b", "y"): 0.5}
    assert spark.range(1).select(inference.yates_chi2(*map(F.lit, (10.0, 20.0, 20.0, 10.0))).alias("x")).first().x == pytest.approx(5.4)


def test_no_single_partition_rank(spark):
    plan = ranks.average_rank(spark.range(1000).withColumnRenamed("id", "v"), "v")._jdf.queryExecution().toString()
    assert "Window" in plan and "AllTuples" not in plan


def test_ols_and_anova(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=80), rng.normal(size=80)
    y = 1 + 2 * x - z + rng.normal(size=80)
    got = inference.ols_with_loocv(spark.createDataFrame([tuple(map(float, r)) for r in zip(y, x, z)], "y double, x double, z double"), "y", ["x", "z"]).first()
    d = np.column_stack([np.ones(80), x, z])
    h = d @ np.linalg.inv(d.T @ d) @ d.T
    e = y - h @ y
    sst = ((y - y.mean()) ** 2).sum()
    assert got.r2 == pytest.approx(1 - (e**2).sum() / sst) and got.loocv_r2 == pytest.approx(1 - ((e / (1 - np.diag(h))) ** 2).sum() / sst)
    cells = [("a" if i % 2 else "b", "u" if i % 3 else "w", float(v)) for i, v in enumerate(rng.normal(size=60))]
    table = {r.term: r for r in factors.two_way_anova(spark.createDataFrame(cells, "a string, b string, v double"), "a", "b", "v").collect()}
    assert sum(r.eta2 for r in table.values()) == pytest.approx(1) and table["Residual"].df == 56


def test_tails():
    assert tails.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_tail(3.098391, 3, 20) == pytest.approx(0.05, abs=1e-5)
    assert tails.t_two_sided(2.085963, 20) == pytest.approx(0.05, abs=1e-6)


def test_predictions(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "i int, a double, b double")
    first, second = predictions.predict_from_scores(rows, ["a", "b"]).orderBy("i").collect()
    assert (first.predicted_class_idx, first.prob_diagram, first.error) == (0, 0.5, "") and second.error == "no score" and second.confidence is None
    images = spark.createDataFrame([("d", "b.png", 0.9), ("d", "a.png", 0.9), ("d", "c.png", 0.8), ("d", "0.png", None)], "d string, i string, p double")
    assert predictions.best_image(images, "d", "i", "p").first().i == "a.png"
    parts = predictions.split_80_20(spark.range(101), "id").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 80, "validation": 21}


def test_bootstrap_is_reproducible(spark):
    rows = spark.createDataFrame([("g", float(i)) for i in range(30)], "g string, v double")
    a, b = (bootstrap.bootstrap_mean_ci(rows.repartition(n), "v", ["g"], 200).first() for n in (1, 5))
    assert tuple(a) == tuple(b) and a.low < 14.5 < a.high and math.isfinite(a.low)


def test_grid(spark):
    docs = spark.createDataFrame([(9, "t", "src1"), (10, None, "src2"), (10, "u", "src2")], "doc_id long, text string, source string")
    assert [(r.document_id, r.model, r.text) for r in grid_corpus(docs).orderBy("doc_id", "text").collect()] == [("RPT-1", "src1", "t"), ("RPT-1", "src2", ""), ("RPT-1#2", "src2", "u")]


def brute_shapiro(x):
    """W with the weights spelled out for the whole sorted sample."""
    from statistics import NormalDist

    x, n = np.sort(x), len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, c = 1 / math.sqrt(n), m / math.sqrt(m @ m)
    last = c[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    second = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
    a = m / math.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
    a[[-1, -2, 0, 1]] = last, second, -last, -second
    return float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())


def test_shapiro_over_all_values(spark):
    rng = np.random.default_rng(5)
    groups = {"ten": np.arange(1.0, 11), "ties": np.repeat(rng.normal(size=30), rng.integers(1, 9, size=30)), "many": rng.normal(size=7000), "one": np.ones(5), "two": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("ten", None)], "g string, v double")
    got = {r.g: r for r in inference.shapiro_wilk(rows, ["g"], "v").collect()}
    for g in ("ten", "ties", "many"):
        assert got[g].w == pytest.approx(brute_shapiro(groups[g]), abs=1e-9) and got[g].n == len(groups[g]) and 0 <= got[g].p <= 1
    assert got["ten"].w == pytest.approx(0.9702, abs=1e-3) and not got["many"].fitted_range
    assert got["one"].w is None and got["two"].w is None
    whole = inference.normality(rows.where("g in ('ten', 'many')"), ["g"], "v").first()
    assert (whole.n, whole.cells) == (7010, 2)


def test_exact_median(spark):
    rng = np.random.default_rng(2)
    groups = {k: rng.integers(0, 6, size=n).astype(float) for k, n in enumerate((1, 2, 7, 40, 41))}
    rows = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [(0, None)], "g int, v double")
    assert {r.g: r.median for r in ranks.exact_median(rows, "v", ["g"]).collect()} == {k: float(np.median(x)) for k, x in groups.items()}


def brute_places(reps, n, side):
    """Draws of a sample of one bucket, spelled out with Python's integers."""
    p, step = bootstrap.PRIME, bootstrap.STEPS
    return [[pow((j * step["draw"] + r * step["rep"] + side * step["side"] + 42 * step["seed"]) % p, 5, p) * n // p for j in range(n)] for r in range(reps)]


def test_bootstrap_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    data = [(bool(i % 3), float(rng.integers(0, 9))) for i in range(90)]
    rows = spark.createDataFrame(data + [(True, None), (None, 1.0)], "first boolean, v double").repartition(3)
    v = np.sort([x for _, x in data] + [1.0])
    means = v[np.array(brute_places(300, 91, 0))].mean(axis=1)
    got = bootstrap.bootstrap_mean_ci(rows, "v", [], 300).first()
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    one, two = (np.sort([x for f, x in data if f == side]) for side in (True, False))
    drawn = [x[np.array(brute_places(300, len(x), i))] for i, x in enumerate((one, two))]
    r = np.sign(drawn[0][:, :, None] - drawn[1][:, None, :]).mean(axis=(1, 2))
    got = bootstrap.bootstrap_rank_biserial_ci(rows, "first", "v", replicates=300).first()
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(r, [2.5, 97.5])))
    # Draws are like those of a generator: as often each place, and as far apart the means.
    places = np.array(brute_places(2000, 50, 1))
    counts = np.bincount(places.ravel(), minlength=50)
    assert ((counts - 2000) ** 2 / 2000).sum() < 90
    weights = np.stack([np.bincount(p, minlength=50) for p in places])
    assert weights.var(axis=0).mean() == pytest.approx(1 - 1 / 50, abs=0.03) and np.corrcoef(weights[:-1].ravel(), weights[1:].ravel())[0, 1] == pytest.approx(0, abs=0.02)


@pytest.mark.parametrize("hashed", [20_000, 0])
def test_bootstrap_draws_n_of_n_over_buckets(spark, monkeypatch, hashed):
    monkeypatch.setattr(bootstrap, "BUCKET_VALUES", 7)
    monkeypatch.setattr(bootstrap, "HASHED", hashed)
    rng = np.random.default_rng(7)
    # Two groups of different size; one value is most of the second.
    x = [("a", float(v), bool(v > 40)) for v in rng.integers(0, 80, size=400)] + [("b", 5.0 if i % 10 else float(i), bool(i % 2)) for i in range(600)]
    rows = spark.createDataFrame(x, "g string, v double, first boolean")
    placed, heads = bootstrap._bucketed(rows.select("g", F.col("v").alias("__v")), ["g"], [F.lit(True)])
    assert placed.select("g", "__bucket").distinct().count() > 8
    sums = bootstrap._grouped(rows.select("g", F.col("v").alias("__v")), ["g"], [F.lit(True)], bootstrap._per_bucket(500, 42, ["g", "__bucket"], ["k", "s"], lambda v, one: (one.sum(axis=1), one @ v)), "k long, s double")
    assert {(r.g, r.n) for r in sums.groupBy("g", "rep").agg(F.sum("k").alias("n")).distinct().collect()} == {("a", 400), ("b", 600)}
    got = {r.g: r for r in bootstrap.bootstrap_mean_ci(rows, "v", ["g"], 2000).collect()}
    for g in "ab":
        v = np.array([y for k, y, _ in x if k == g])
        want = np.percentile(v[rng.integers(0, len(v), size=(4000, len(v)))].mean(axis=1), [2.5, 97.5])
        assert (got[g].low, got[g].high) == pytest.approx(tuple(want), abs=0.12 * (want[1] - want[0]))
    one, two = (np.array([y for k, y, f in x if k == "b" and f == side]) for side in (True, False))
    drawn = [z[rng.integers(0, len(z), size=(1500, len(z)))] for z in (one, two)]
    wins = [np.searchsorted(np.sort(b), a, "left").mean() + np.searchsorted(np.sort(b), a, "right").mean() - len(b) for a, b in zip(*drawn)]
    want = np.percentile(np.array(wins) / len(two), [2.5, 97.5])
    r = bootstrap.bootstrap_rank_biserial_ci(rows.where("g = 'b'"), "first", "v", replicates=1500).first()
    assert (r.low, r.high) == pytest.approx(tuple(want), abs=0.12 * (want[1] - want[0]))


def test_one_value_of_millions_is_one_row(spark):
    """Nine tenths of five million rows are equal: they are one value, whatever their number."""
    rows = spark.range(5_000_000).select((F.col("id") % 3 == 0).alias("first"), F.when(F.col("id") % 10 > 0, 1.0).otherwise(F.col("id") % 1000 / 100.0).alias("v"))
    placed, _ = bootstrap._bucketed(rows.select(F.col("v").alias("__v"), "first"), [], [F.col("first"), ~F.col("first")])
    assert placed.count() <= 101
    got = bootstrap.bootstrap_rank_biserial_ci(rows, "first", "v", replicates=200).first()
    assert -0.01 < got.low < got.high < 0.01


def test_exact_tails_equal_enumeration():
    from collections import Counter
    from itertools import combinations, product

    for n in range(1, 11):
        sums = Counter(sum(r for r, up in enumerate(signs, 1) if up) for signs in product((0, 1), repeat=n))
        assert tails.signed_rank_counts(n) == tuple(sums[w] for w in range(n * (n + 1) // 2 + 1))
        for w in range(n * (n + 1) // 2 + 1):
            both = 2 * min(sum(c for s, c in sums.items() if s <= w), sum(c for s, c in sums.items() if s >= w)) / 2**n
            assert tails.signed_rank_exact(n, w) == pytest.approx(min(1, both))
    for a in range(1, 7):
        for b in range(1, 7):
            us = Counter(sum(x) - a * (a - 1) // 2 for x in combinations(range(a + b), a))
            for u in range(a * b + 1):
                least = min(u, a * b - u)
                assert tails.rank_sum_exact(a, b, u) == pytest.approx(min(1, 2 * sum(c for s, c in us.items() if s <= least) / sum(us.values())))
    # Published critical value: n = 50, W = 434, just under 5 %.
    assert tails.signed_rank_exact(50, 434) < 0.05 < tails.signed_rank_exact(50, 435)
    assert tails.rank_sum_shares(8, 200_000).sum() == pytest.approx(0.5, abs=1e-5)


def test_p_is_exact_for_small_samples(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (3, -1, 2, 7, 5, -4)] + [("zero", float(x)) for x in (0, 1, 2, 3)] + [("many", float(i - 8)) for i in range(60) if i != 8] + [("none", 0.0)], "g string, d double")
    got = {r.g: r for r in inference.with_signed_rank_p(inference.signed_rank(rows, "d", ["g"])).collect()}
    assert got["a"].p == pytest.approx(tails.signed_rank_exact(6, 16)) and got["a"].w == 5
    for g in ("zero", "many"):
        assert got[g].p == pytest.approx(tails.normal_two_sided(got[g].z))
    assert got["none"].p is None
    pairs = spark.createDataFrame([("d1", "p", 1.0), ("d2", "p", 2.0), ("d3", "p", 4.0), ("d4", "r", 3.0), ("d5", "r", 5.0), ("d5", "r", 7.0), ("d6", "r", None)], "doc string, kind string, v double")
    found = inference.two_type_rank_sum(pairs, "kind", "doc", "v").collect()
    assert [(r.comparison, r.n1, r.n2, r.u) for r in found] == [("p vs r", 3, 2, 1.0)] and found[0].p == pytest.approx(0.4)
    for other in (pairs.where("kind = 'p'"), pairs.unionByName(spark.createDataFrame([("d9", "x", 1.0)], pairs.schema)), pairs.limit(0)):
        assert inference.two_type_rank_sum(other, "kind", "doc", "v").count() == 0
    tied = inference.with_rank_sum_p(inference.rank_sums(spark.createDataFrame([("c", i < 3, float(i // 2)) for i in range(6)], "comparison string, first boolean, v double"))).first()
    assert tied.p == pytest.approx(tails.normal_two_sided(max(tied.z, 0)))


def brute_mixed(y, x, unit, reml):
    """-2 log likelihood by whole matrices, over a grid of variance ratios; the best one's estimates."""
    best = None
    z = (unit[:, None] == np.unique(unit)[None, :]).astype(float)
    for ratio in np.exp(np.linspace(-6, 4, 1500)):
        v = np.eye(len(y)) + ratio * z @ z.T
        w = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ w @ x, x.T @ w @ y)
        e = y - x @ beta
        df = len(y) - (x.shape[1] if reml else 0)
        loss = df * np.log(e @ w @ e / df) + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(x.T @ w @ x)[1] if reml else 0)
        if best is None or loss < best[0]:
            sigma = e @ w @ e / df
            best = loss, beta, np.sqrt(sigma * np.linalg.inv(x.T @ w @ x)[-1, -1]), ratio * sigma, sigma
    return best


def test_unbalanced_mixed_models(spark):
    rng = np.random.default_rng(9)
    data = [(f"d{d}", r, m, float(u + 0.3 * (r == "b") - 0.2 * (m == "y") + 0.4 * (r + m == "ax") + rng.normal() * 0.5)) for d, u in enumerate(rng.normal(size=14)) for r in "ab" for m in "xyz" if rng.random() < 0.75]
    rows = spark.createDataFrame([(*d, d[1] + d[2] == "ax") for d in data] + [("d0", "a", "x", None, True)], "document_id string, Reference string, Model string, OverallScore double, same_family boolean")
    unit, y = np.array([d[0] for d in data]), np.array([d[3] for d in data])
    cells = sorted({d[1:3] for d in data})
    x = np.array([[float(d[1:3] == c) for c in cells] for d in data])
    _, _, _, var_unit, var_residual = brute_mixed(y, x, unit, True)
    got = mixed.random_intercept(rows, "document_id", ["Reference", "Model"], "OverallScore").first()
    assert (got.units, got.rows) == (len(set(unit)), len(data))
    assert got.var_unit == pytest.approx(var_unit, rel=0.01) and got.var_residual == pytest.approx(var_residual, rel=0.01)
    x = np.array([[1.0, d[1] == "b", d[2] == "y", d[2] == "z", d[1] + d[2] == "ax"] for d in data], float)
    _, beta, se, _, _ = brute_mixed(y, x, unit, False)
    got = mixed.family_contrast(rows, "document_id", "Reference", "Model", "same_family", "OverallScore").first()
    assert got.beta == pytest.approx(beta[-1], rel=0.01) and got.se == pytest.approx(se, rel=0.01)
    full = rows.where("OverallScore is not null").join(rows.where("OverallScore is not null").groupBy("document_id").count().where("count = 6").select("document_id"), "document_id")
    one, two = inference.balanced_intercept(full, "document_id", ["Reference", "Model"], "OverallScore").first(), mixed.random_intercept(full, "document_id", ["Reference", "Model"], "OverallScore").first()
    assert two.icc == pytest.approx(one.icc, abs=1e-4)


def test_statistics_of_nothing_and_of_one_level(spark):
    kind = "document_id string, Reference string, Model string, OverallScore double, same_family boolean"
    for data in ([], [("d", "a", "x", 0.5, False)], [("d", "a", "x", None, None)]):
        rows = spark.createDataFrame(data, kind)
        for found in (
            inference.one_way_f(rows, ["Reference"], "OverallScore"), inference.brown_forsythe(rows, ["Reference", "Model"], "OverallScore"), factors.two_way_anova(rows, "Reference", "Model", "OverallScore"),
            inference.kruskal_wallis(rows, "Reference", "OverallScore"), inference.friedman(rows, "document_id", "Model", "OverallScore", 3), inference.mann_whitney(rows, "Model", "OverallScore", [("x", "y")]),
            inference.shapiro_wilk(rows, ["Reference"], "OverallScore"), inference.normality(rows, ["Reference"], "OverallScore"), inference.spearman(rows.withColumn("b", F.col("OverallScore")), "OverallScore", "b"),
            bootstrap.bootstrap_mean_ci(rows, "OverallScore", ["Model"], 20), bootstrap.bootstrap_rank_biserial_ci(rows, "same_family", "OverallScore", replicates=20),
            mixed.random_intercept(rows, "document_id", ["Reference"], "OverallScore"), mixed.family_contrast(rows, "document_id", "Reference", "Model", "same_family", "OverallScore"),
        ):
            assert found.count() <= 4


def test_lcs_of_long_texts_needs_little_memory():
    import tracemalloc

    r = random.Random(4)
    a, b = ([r.randrange(50_000) for _ in range(60_000)] for _ in range(2))
    tracemalloc.start()
    found = lexical.lcs_length(a, a[:30_000] + b[30_000:])
    assert found >= 30_000 and tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_equal_structures_are_compared_once(spark, monkeypatch):
    """Six documents of three models in two structures, so one comparison of trees and one of tables in all."""
    bodies = ["# a\n\ntext\n\n| x | y |\n|---|---|\n| 1 | 2 |", "# b\n\ntext\n\n| x |\n|---|\n| 1 |"]
    docs = spark.createDataFrame([(f"d{d}", "ADR", m, bodies[(d + k) % 2]) for d in range(6) for k, m in enumerate("rcs")], "document_id string, doc_type string, model string, text string")
    got = structure.structure_similarity(docs, ["r"], ["c", "s"]).collect()
    a, b = (markdown.document_tree(x) for x in bodies)
    want = 1 - markdown.tree_distance(a, b) / max(a.sizes[0], b.sizes[0])
    assert {(r.comparison_model, round(r.teds_document_structure_similarity, 9)) for r in got} == {("c", round(want, 9)), ("s", 1.0)} and len(got) == 12
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x"), ("x", "y")], "l string, r string")
    forms = spark.createDataFrame([("x", 1), ("y", 5)], "key string, form int")
    counted = spark.sparkContext.accumulator(0)

    @F.arrow_udf("int")
    def gap(p, q):
        counted.add(len(p))
        import pyarrow.compute as pc

        return pc.abs(pc.subtract(p, q))

    assert sorted(r.distance for r in structure.with_distance(pairs, "l", "r", forms, gap).collect()) == [0, 4, 4, 4] and counted.value == 1


def test_large_flat_trees():
    import time

    a, b = (markdown.document_tree("\n\n".join(["# t", *(f"- x\n- y" if i % k == 0 else "p" for i in range(20_000))])) for k in (5, 7))
    began = time.time()
    assert markdown.tree_distance(a, b) > 0 and time.time() - began < 20


def test_gram_overlaps_equal_counters(spark):
    from collections import Counter

    r = random.Random(8)
    texts = ["".join(r.choice("abc d") for _ in range(r.randint(0, 60))) for _ in range(12)] + [""]
    docs = spark.createDataFrame([(f"d{i}", "ADR", m, texts[(i + k) % 13]) for i in range(13) for k, m in enumerate("rc")], "document_id string, doc_type string, model string, text string")
    from scoreloom.functions.tokens import tokenize_chars

    rows = lexical._ngram_pairs(docs, ["r"], ["c"], tokenize_chars(F.col("text")), (1, 2, 3, 4)).collect()
    assert len(rows) == 13 * 4
    for x in rows:
        i = int(x.document_id[1:])
        a, b = ([t[k : k + x.n] for k in range(len(t) - x.n + 1)] for t in (texts[i], texts[(i + 1) % 13]))
        assert x.overlap == sum((Counter(a) & Counter(b)).values())
