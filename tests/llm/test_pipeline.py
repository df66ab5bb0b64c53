"""The pipeline's stages against brute force, and the registration of queries."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from scoreloom.llm import bpe_stream, pii, queries, shingle_dedup, token_files

from .test_operators import brute_components, brute_simhash, prose


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    rows = []
    for i in range(160):
        lines = [prose(i * 11 + k, 14) + "." for k in range(4)]
        if i % 8 == 0:
            lines[1:3] = ["BUY!! NOW!! " * 6, "spam " * 20]
        rows.append([i, "\n".join(lines)])
    for i in range(20):
        rows.append([500 + i, rows[1 + 8 * i % 100][1] if i % 2 else rows[3][1]])
    item = prose(9999, 25)
    rows[5][1] += "\n" + item
    rows[6][1] += "\nwrite to some.one@mail.org"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    encoded = corpus_pipeline.run(spark, str(tmp_path)).persist()
    got = {r.doc_id: r for r in encoded.collect()}
    good = [(i, t) for i, t in rows if "BUY!!" not in t]
    prints = sorted((i, brute_simhash(t, 5)) for i, t in good)
    alone = {c for _, c in brute_components(prints, 5)}
    want = {i: t for i, t in good if i in alone and i != 5}
    assert set(got) == set(want)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    for i in r.sample(sorted(want), 10) + [6]:
        assert got[i].n_tokens == len(library.encode(pii.redact(want[i], pii.find_spans(want[i])), add_special_tokens=False).ids)
    manifest = corpus_pipeline.publish(encoded, f"{tmp_path}/tokens").persist()
    files = token_files.read_token_files(spark, f"{tmp_path}/tokens", manifest).orderBy("id").collect()
    assert [f.id for f in files] == list(range(len(got))) and sum(f.n_tokens for f in files) == sum(r.n_tokens + 1 for r in got.values())
    end = (49407).to_bytes(4, "little")
    assert sorted(f.ids_crc32 for f in files) == sorted(zlib.crc32(bytes(r.ids) + end) for r in got.values())


def test_near_dedup_equals_brute_force_jaccard(spark):
    r = random.Random(5)
    rows = [(1000, ""), (1001, None), (1002, "two words"), (1003, "Two  WORDS"), (1004, "two words more")]
    for i in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(80 + 20 * (i % 4))]
        for k in range(9):
            words = list(base)
            for at in r.sample(range(len(words)), k % 5):
                words[at] = "changed"
            rows.append((i * 9 + k, "a common line that all of them have " * (i % 3) + " ".join(words)))
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    for _ in sets:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, node string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(root.values()))


def test_prefixes_alone_find_every_similar_pair(spark):
    r = random.Random(7)
    rows = []
    for i in range(8):
        base = [f"w{r.randrange(300)}" for _ in range(60 + 15 * i)]
        for k in range(8):
            words = list(base)
            for at in r.sample(range(len(words)), k % 4):
                words[at] = f"x{k}"
            rows.append((i * 8 + k, "words that stand before all of these texts " * (i % 3) + " ".join(words)))
    sets = {i: shingle_dedup.shingle_set(t) for i, t in rows}
    docs = spark.createDataFrame(rows, "id long, text string")
    prints = spark.createDataFrame([(i, len(x), shingle_dedup.sketch(x)) for i, x in sets.items()], "node long, n long, sketch array<long>")
    blocks = shingle_dedup.shared_prefixes(docs, "id", "text", 5)
    got = {(x.a, x.b) for x in shingle_dedup.candidates_by_prefix(blocks, prints.select("node", F.col("node").alias("root")), prints).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and shingle_dedup.similar(sets[a], sets[b])}
    assert len(want) > 50 and want <= got


def rows_of_top_join(df):
    """Rows that left the topmost join of the plan that ``df.collect()`` ran."""
    plans = [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop(0)
        if "Join" in plan.nodeName():
            return plan.metrics().apply("numOutputRows").value()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plans.append(plan.executedPlan())
        elif "QueryStage" in plan.nodeName():
            plans.append(plan.plan())
        else:
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    raise AssertionError("no join")


def test_pairs_speak_about_once(spark):
    # Long texts, whose sketches are full: 16 below a similarity of 0.8 with each other, and a closer one to each fourth.
    r = random.Random(11)
    base = [f"w{r.randrange(2000)}" for _ in range(3000)]

    def changed(words, n, mark):
        words = list(words)
        for at in r.sample(range(len(words)), n):
            words[at] = f"{mark}x{at}"
        return words

    texts = [changed(base, 90, k) for k in range(16)]
    texts += [changed(texts[k], 40, f"n{k}") for k in range(0, 16, 4)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: shingle_dedup.shingle_set(t) for i, t in rows}
    docs = spark.createDataFrame(rows, "id long, text string")
    prints = spark.createDataFrame([(i, len(x), shingle_dedup.sketch(x)) for i, x in sets.items()], "node long, n long, sketch array<long>")
    blocks = shingle_dedup.shared_prefixes(docs, "id", "text", 5)
    df = shingle_dedup.candidates_by_prefix(blocks, prints.select("node", F.col("node").alias("root")), prints)
    got = {(x.a, x.b) for x in df.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and shingle_dedup.similar(sets[a], sets[b])}
    assert len(want) >= 4 and want <= got
    # Two that are not of the main root meet from both sides.
    assert rows_of_top_join(df) <= 4 * len(sets) * (len(sets) - 1) / 2


def test_sketches_rule_out_no_similar_pair(spark):
    r = np.random.default_rng(3)
    rows = []
    for n in (1, 5, 9, 60, 500, 3000):
        for share in (0.75, 0.8, 0.85, 1.0):
            a = r.integers(0, 1 << 63, n, np.uint64)
            b = np.concatenate([a[: int(np.ceil(share * n))], r.integers(0, 1 << 63, n - int(np.ceil(share * n)), np.uint64)])
            for x, y in ((a, b), (a, a[: int(np.ceil(share * n))])):
                x, y = np.unique(x), np.unique(y)
                rows.append((shingle_dedup.similar(x, y), len(x), shingle_dedup.sketch(x), len(y), shingle_dedup.sketch(y)))
    df = spark.createDataFrame(rows, "similar boolean, n long, s array<long>, m long, t array<long>")
    got = df.select("similar", shingle_dedup.may_be_close(F.col("n"), F.col("s"), F.col("m"), F.col("t")).alias("close")).collect()
    assert all(x.close for x in got if x.similar) and not all(x.close for x in got if not x.similar)


def test_hashes_are_counted_packed(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(60)) + " and an end that they all have in common" * (i % 2)) for i in range(40)]
    counts = Counter(x for _, t in rows for x in shingle_dedup.shingle_set(t, 3).tolist())
    want = {x: n for x, n in counts.items() if n > 1}
    hashes, n = shingle_dedup.frequent_shingles(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text", 3)
    assert dict(zip(hashes.tolist(), n.tolist(), strict=True)) == want and hashes.tolist() == sorted(want)
    # A range is one row, however many hashes it has: not a row for each.
    many = np.random.default_rng(1).integers(0, 1 << 64, 50_000, np.uint64)
    batch = shingle_dedup.packed_ranges(np.r_[many, many[:10]])
    assert batch.num_rows == shingle_dedup.RANGES and sum(map(len, batch.column("hashes").to_pylist())) == 8 * len(np.unique(many))
    assert shingle_dedup.packed_ranges(many[:0]).num_rows == 0


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    written = shingle_dedup.materialize
    monkeypatch.setattr(shingle_dedup, "materialize", lambda df, name: seen.append(int(spark.conf.get(key))) or written(df, name))
    docs = spark.createDataFrame([(i, f"text {i // 2} of a few words that make shingles") for i in range(6)], "doc_id long, text string")
    assert sorted(x.doc_id for x in shingle_dedup.one_of_each(docs).collect()) == [0, 2, 4]
    assert seen and max(seen) <= 1_000 and spark.conf.get(key) == before


def test_encode_remembers_few_words(spark, monkeypatch):
    text = " ".join(f"word{i} x{i}" for i in range(3_000))
    few, many = bpe_stream.WordTokenizer(corpus_pipeline.WORD_BPE, 100), bpe_stream.tokenizer_at(corpus_pipeline.WORD_BPE)
    assert few.encode(text) == many.encode(text)
    assert all(len(x) <= 100 and len(x.older) <= 100 for x in (few.word, few.packed))
    asked = []
    monkeypatch.setattr(bpe_stream, "round_trip_digest", lambda docs, path, **how: asked.append(how) or docs)
    corpus_pipeline.encode(spark, spark.range(1).withColumnRenamed("id", "doc_id"), "")
    assert asked[0]["words"] == corpus_pipeline.WORDS < bpe_stream.CACHE_WORDS


def test_stages_keep_columns(spark, tmp_path):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "redact", "encode"]


def test_registered():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", ["op1_chat_format"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert sorted(map(tuple, got[sorted(got)].values.tolist())) == sorted(map(tuple, want[sorted(want)].values.tolist()))
