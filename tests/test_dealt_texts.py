"""Pair metrics deal the texts of a corpus once, by document, and nothing that is made of them."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import lexical, scores
from scoreloom.operators.pairs import grid_corpus
from scoreloom.plans import catalog


def corpus(spark, n=12):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [(f"d{d}", "ADR", m, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 40])))) for d in range(n) for m in ("r", "s", "c", "e")]
    # A short text with a term that no longer text has, and one with a term of a single longer text.
    texts += [("x", "ADR", "r", "zz w1"), ("x", "ADR", "c", "zz yy w1"), ("x", "ADR", "e", "yy and some more words"), ("one", "ADR", "r", "alone in its document")]
    return spark.createDataFrame(texts, "document_id string, doc_type string, model string, text string"), texts


def exchanges(df) -> list[str]:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(ReusedExchange|Exchange hashpartitioning)", plan)


def test_grams_are_not_shuffled(spark):
    docs, _ = corpus(spark)
    for f in (lexical.bleu, lexical.rouge, lexical.vocab_overlap_f1, lexical.rouge_l_pairs):
        assert exchanges(f(docs, ["r", "s"], ["c", "e"])) == ["Exchange hashpartitioning"]


def test_texts_are_shuffled_only_if_ids_repeat(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    assert "Window" not in grid_corpus(docs)._jdf.queryExecution().toString()
    assert "Window" in grid_corpus(docs.union(docs.limit(1)))._jdf.queryExecution().toString()


def test_metrics_share_the_texts_exchange(spark):
    docs, _ = corpus(spark)
    parts = [f(docs, ["r", "s"], ["c", "e"]) for f in (lexical.vocab_overlap_f1, lexical.rouge, lexical.bleu, lexical.tfidf_similarity, lexical.rouge_l_pairs)]
    table = scores.similarity_table(parts)
    found = table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # One is made, and four read it again.
    assert plan.count("REPARTITION_BY_COL") == 5 and plan.count("ReusedExchange") == 4
    # Twelve documents of two by two, and one of one by two.
    assert len(found) == 12 * 4 + 2


@pytest.mark.parametrize("held", [0, 1000])
def test_tfidf_of_held_and_of_many_terms(spark, monkeypatch, held):
    monkeypatch.setattr(lexical, "HELD_TERMS", held)
    docs, texts = corpus(spark)
    counts = {(d, m): Counter(re.findall(r"\w{2,}", t.lower())) for d, _, m, t in texts}
    fitted = [counts[d, m] for d, _, m, t in texts if len(t.strip()) >= 10]
    df = Counter(w for c in fitted for w in c)

    def vector(c):
        own = {w: n * (math.log((1 + len(fitted)) / (1 + df[w])) + 1) for w, n in c.items() if df[w]}
        size = math.sqrt(sum(x * x for x in own.values())) or 1.0
        return {w: x / size for w, x in own.items()}

    vectors = {k: vector(c) for k, c in counts.items()}
    found = lexical.tfidf_similarity(docs, ["r", "s"], ["c", "e"]).collect()
    assert len(found) == 12 * 4 + 2
    for x in found:
        a, b = vectors[x.document_id, x.reference_model], vectors[x.document_id, x.comparison_model]
        assert x.tfidf_similarity == pytest.approx(sum(v * b.get(w, 0.0) for w, v in a.items()))


def documents(spark, path) -> str:
    words = "patent sensor water soil model data system farm".split()
    texts = [(i, ". ".join(words[(i * k) % 8] + ", " + words[k] for k in range(2 + i % 5))) for i in range(24)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_study_leniency_reads_its_scores_once(spark, tmp_path):
    found = catalog.study_leniency(spark, documents(spark, tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and {r.Reference for r in found.collect()} == {f"src{i}" for i in range(5)}


def test_study_of_families_deals_texts_once(spark, tmp_path):
    folder = documents(spark, tmp_path)
    rows = catalog.study(spark, folder).select("document_id", "Reference", "Model", "OverallScore")
    assert len(rows.collect()) == 3 * 15
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 5 and plan.count("ReusedExchange") >= 4
    assert catalog.study_family_gaps(spark, folder).count() == 3
