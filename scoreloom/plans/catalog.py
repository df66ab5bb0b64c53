"""Registered queries of the evaluation library, each beside its SQL where SQL can express it.

Document tables stand for a corpus: eight consecutive ids are one source document,
and an id's place among them names the model that wrote the text. So every row is
the text of a model, and five models are references of the other three. ``evaluations`` gives every
ordered pair of a reference and a local model twelve metric columns, ratios of
counts in the two texts, so that the statistics run on tables of any size
without recomputing the text metrics; missing values occur as in real tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import names, tokens
from scoreloom.operators import bootstrap, factors, family, inference, lexical, mixed, pairs, predictions, ranks, scores, structure, vectors
from scoreloom.plans import jobs
from scoreloom.sources import corpus as sources
from scoreloom.sources.scratch import scratch_folder

REFERENCES = [f"src{i}" for i in range(5)]
LOCALS = ["src5", "src6", "src7"]
FAMILIES = [("src1", "src5", "A"), ("src4", "src7", "B"), ("src3", "src6", "C")]
MODEL_PAIRS = [("src5", "src6"), ("src5", "src7"), ("src6", "src7")]
#: What each stand-in metric counts in the two texts of a pair.
COUNTED = dict(zip(scores.METRICS, [" ", "e", "t", "n", "i", "r", "o", "a", "s", "d", ".", ","], strict=True))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.grid_corpus(table(spark, sf_dir, "documents"))


def evaluations(spark: SparkSession, sf_dir: str, references: list[str] = REFERENCES, candidates: list[str] = LOCALS) -> DataFrame:
    count = {m: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).alias(m) for m, c in COUNTED.items()}
    docs = pairs.select_models(grid(spark, sf_dir), sorted({*references, *candidates})).select(*lexical.DOC, F.length("text").alias("chars"), *count.values())
    both = pairs.make_pairs(pairs.select_models(docs, references), pairs.select_models(docs, candidates))
    short = F.least("ref_chars", "cand_chars") < 10
    made = {}
    for m in scores.METRICS:
        r, c = F.col(f"ref_{m}"), F.col(f"cand_{m}")
        ratio = (F.least(r, c) + 1) / (F.greatest(r, c) + 1)
        if m in scores.SEMANTIC:
            ratio = F.when(~short, ratio)
        if m == "teds_table_structure_similarity":
            ratio = F.when((r > 0) & (c > 0), ratio).when((r > 0) | (c > 0), 0.0)
        made[m] = ratio
    family = F.create_map(*(F.lit(x) for r, c, _ in FAMILIES for x in (f"{r}/{c}", True)))
    rows = both.select("document_id", names.classify_doc_type(F.col("document_id")).alias("DocType"), F.col("reference_model").alias("Reference"), F.col("comparison_model").alias("Model"), *(v.alias(k) for k, v in made.items()))
    return rows.withColumn("OverallScore", scores.weighted_score(list(scores.METRICS))).withColumn("same_family", F.coalesce(F.try_element_at(family, F.concat_ws("/", "Reference", "Model")), F.lit(False)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations for the rank statistics, which read their rows several times."""
    return kept(evaluations(spark, sf_dir).select("document_id", "DocType", "Reference", "Model", *scores.METRICS, "OverallScore", "same_family"))


_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """``df`` persisted until the next query persists its own: at most ``KEPT`` tables are held."""
    while len(_KEPT) >= KEPT:
        _KEPT.pop(0).unpersist()
    _KEPT.append(df.persist())
    return df


#: Two, as one query reads up to two such tables.
KEPT = 2


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


GRID = f"""g AS (SELECT doc_id, CASE WHEN (doc_id // {pairs.GRID_MODELS}) % 2 = 0 THEN 'PAT-' ELSE 'RPT-' END || (doc_id // {pairs.GRID_MODELS}) || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS document_id,
    'src' || (doc_id % {pairs.GRID_MODELS}) AS model, 'ADR' AS doc_type, coalesce(text, '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(text, '')) AS n FROM documents))"""


def _mean(columns) -> str:
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in columns)
    return f"(({' + '.join(f'coalesce({c}, 0)' for c in columns)}) / nullif({n}, 0))"


def ev_sql(references=REFERENCES, candidates=LOCALS) -> str:
    counts = ", ".join(f"length(text) - length(replace(text, '{c}', '')) AS {m}" for m, c in COUNTED.items())
    cols = []
    for m in scores.METRICS:
        ratio = f"(least(r.{m}, c.{m}) + 1)::DOUBLE / (greatest(r.{m}, c.{m}) + 1)"
        if m in scores.SEMANTIC:
            ratio = f"CASE WHEN least(r.chars, c.chars) >= 10 THEN {ratio} END"
        if m == "teds_table_structure_similarity":
            ratio = f"CASE WHEN r.{m} > 0 AND c.{m} > 0 THEN {ratio} WHEN r.{m} > 0 OR c.{m} > 0 THEN 0.0 END"
        cols.append(f"{ratio} AS {m}")
    family = " OR ".join(f"(Reference = '{r}' AND Model = '{c}')" for r, c, _ in FAMILIES)
    groups = [_mean(c) for _, c in scores.GROUPS.values()]
    return f"""{GRID},
f AS (SELECT *, length(text) AS chars, {counts} FROM g),
e0 AS (SELECT r.document_id, CASE WHEN r.document_id LIKE 'PAT%' THEN 'patent' ELSE 'report' END AS DocType, r.model AS Reference, c.model AS Model, {', '.join(cols)}
  FROM f r JOIN f c ON r.document_id = c.document_id AND r.model <> c.model WHERE r.model IN ({_quoted(references)}) AND c.model IN ({_quoted(candidates)})),
ev AS (SELECT *, {groups[0]} * 0.20 + {groups[1]} * 0.45 + {groups[2]} * 0.35 AS OverallScore, ({family}) AS same_family FROM e0)"""


EV = "WITH " + ev_sql()
_R = "round({}, 6)".format


# Corpus -----------------------------------------------------------------------------------------

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')".format


@register(rf"""WITH {GRID}, l AS (SELECT *, length({_STRIP('text')}) AS n FROM g)
SELECT document_id, model, doc_type, document_id || '_' || model || '_ADR.md' AS path, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))::INT AS output_words,
CASE WHEN n = 0 THEN 'empty' WHEN n < 50 THEN 'too_short' WHEN n < 100 THEN 'very_short' WHEN n < 200 THEN 'short' ELSE 'ok' END AS flag, n >= 10 AS valid FROM l WHERE n > 0""")
def corpus_parse(spark, sf_dir):
    rows = grid(spark, sf_dir).select("path", "text", names.parse_document_name(F.col("path"), [f"src{i}" for i in range(20)], aliases={}).alias("k"))
    docs = pairs.valid_documents(rows.select("k.*", "path", "text"))
    return docs.select("document_id", "model", "doc_type", "path", names.count_words(F.col("text")).alias("output_words"), names.length_flag(F.col("text")).alias("flag"), names.is_valid(F.col("text")).alias("valid"))


_VARIANTS = ["_gemini_ADR.md", "_qwen3_6_ADR.md", "_gpt_testplan.md", "_qwen3_6plus_ADR.md", "_claude.md", "_other_PRD.md"]


@register("""SELECT doc_id, CASE WHEN doc_id % 6 IN (3, 5) THEN NULL ELSE 'a_' || doc_id END AS document_id,
CASE doc_id % 6 WHEN 0 THEN 'gemini' WHEN 1 THEN 'qwen3_6' WHEN 2 THEN 'chatgpt' WHEN 4 THEN 'claude' END AS model,
CASE doc_id % 6 WHEN 0 THEN 'ADR' WHEN 1 THEN 'ADR' WHEN 2 THEN 'TestPlan' END AS doc_type,
CASE doc_id % 6 WHEN 0 THEN 'Gemini' WHEN 1 THEN 'Qwen3.6' WHEN 2 THEN 'ChatGPT' WHEN 4 THEN 'Claude' END AS label FROM documents""")
def parse_document_name(spark, sf_dir):
    file = F.concat(F.lit("a_"), F.col("doc_id"), F.element_at(F.array(*map(F.lit, _VARIANTS)), (F.col("doc_id") % 6 + 1).cast("int")))
    rows = table(spark, sf_dir, "documents").select("doc_id", names.parse_document_name(file).alias("k")).select("doc_id", "k.*")
    return rows.withColumn("label", F.when(F.col("model").isNotNull(), names.display_name(F.col("model"))))


@register(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '\([^)]*\)', '', 'g'), '[^\p{L}\p{N}_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS safe,
CASE WHEN lower(url) LIKE 'https://m.%' THEN 'mobile' WHEN lower(url) LIKE 'https%' THEN 'secure' ELSE translate(lower(url), '\/:*?"<>| ', '__________') END AS tag FROM pages""")
def sanitize_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.sanitize_name(F.col("url")).alias("safe"), names.model_tag(F.col("url"), {"https": "secure", "https://m.": "mobile"}).alias("tag"))


@register("""SELECT doc_id, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1 AS kept FROM documents""")
def keep_first_duplicate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("document_id"), F.lit("ADR").alias("doc_type"), F.lit("any").alias("model"))
    return pairs.mark_duplicates(rows, ["doc_id"]).select("doc_id", "kept")


@register(rf"""SELECT doc_id, length(coalesce(text, ''))::INT AS chars, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'))::INT AS terms,
len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::INT AS rouge_tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')))::INT AS distinct_tokens FROM documents""")
def tokenizers(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens.tokenize_chars(text)).alias("chars"), F.size(tokens.tokenize_terms(text)).alias("terms"), F.size(tokens.tokenize_rouge(text)).alias("rouge_tokens"), F.size(F.array_distinct(tokens.tokenize_rouge(text))).alias("distinct_tokens"))


@register("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS gram FROM t), b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t),
c AS (SELECT doc_id, 1 AS n, gram, count(*) AS k FROM u GROUP BY ALL UNION ALL SELECT doc_id, 2, gram, count(*) FROM b GROUP BY ALL)
SELECT doc_id, n, count(*) AS grams, max(k) AS most FROM c GROUP BY doc_id, n""")
def ngram_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens.tokenize_rouge(F.coalesce("text", F.lit(""))).alias("t"))
    return tokens.ngram_counts(rows, ["doc_id"], "t", (1, 2)).groupBy("doc_id", "n").agg(F.count("*").alias("grams"), F.max("count").alias("most"))


@register()
def chunks_and_sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens.chunk_text(F.coalesce("text", F.lit("")), 600).alias("c"), tokens.split_sentences(F.coalesce("text", F.lit(""))).alias("s"))
    pair = tokens.align_chunks(F.col("c"), F.col("s"))
    return rows.select("doc_id", F.size("c").alias("chunks"), F.transform("c", F.length).alias("lengths"), F.size("s").alias("sentences"), F.coalesce(F.aggregate(pair, F.lit(0.0), lambda a, p: a + p["weight"]), F.lit(0.0)).alias("weight"))


# Lexical metrics --------------------------------------------------------------------------------

_PAIRS = f"""p AS (SELECT r.document_id, r.doc_type, r.model AS reference_model, c.model AS comparison_model, r.text AS rt, c.text AS ct FROM g r JOIN g c ON r.document_id = c.document_id AND r.model <> c.model
WHERE r.model IN ({_quoted(REFERENCES)}) AND c.model IN ({_quoted(LOCALS)}))"""
_KEYS = "document_id, doc_type, reference_model, comparison_model"
_TERMS = r"""tc AS (SELECT document_id, model, term, count(*) AS k FROM (SELECT document_id, model, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM g {}) GROUP BY ALL)"""
_VALID = f"WHERE length({_STRIP('text')}) >= 10"
_TFIDF = f"""WITH {GRID}, {_PAIRS}, {_TERMS.format('')}, ok AS (SELECT document_id, model FROM g {_VALID}),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM ok)) / (1 + count(*))) + 1 AS idf FROM tc JOIN ok USING (document_id, model) GROUP BY term),
w AS (SELECT document_id, model, term, k * idf AS w FROM tc JOIN idf USING (term)),
u AS (SELECT document_id, model, term, w / sqrt(sum(w * w) OVER (PARTITION BY document_id, model)) AS w FROM w),
d AS (SELECT a.document_id, a.model AS reference_model, b.model AS comparison_model, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.document_id = b.document_id AND a.term = b.term AND a.model <> b.model
WHERE a.model IN ({_quoted(REFERENCES)}) AND b.model IN ({_quoted(LOCALS)}) GROUP BY ALL)"""


@register(f"{_TFIDF} SELECT {_KEYS}, round(coalesce(s, 0), 6) AS tfidf_similarity FROM p LEFT JOIN d USING (document_id, reference_model, comparison_model)")
def tfidf_similarity(spark, sf_dir):
    return lexical.tfidf_similarity(grid(spark, sf_dir), REFERENCES, LOCALS)


@register(f"{_TFIDF} SELECT reference_model, {', '.join(f'round(avg(coalesce(s, 0)) FILTER (comparison_model = {m!r}), 6) AS {m}' for m in LOCALS)} FROM p LEFT JOIN d USING (document_id, reference_model, comparison_model) GROUP BY 1")
def reference_by_model_similarity(spark, sf_dir):
    """The flagship: corpus, pairs, TF-IDF, and mean similarity of references and models."""
    return scores.means_pivot(lexical.tfidf_similarity(grid(spark, sf_dir), REFERENCES, LOCALS), "reference_model", "comparison_model", LOCALS, "tfidf_similarity")


@register(f"""WITH {GRID}, {_PAIRS}, {_TERMS.format(_VALID)}, z AS (SELECT document_id, model, count(*) AS n FROM tc GROUP BY ALL),
d AS (SELECT a.document_id, a.model AS reference_model, b.model AS comparison_model, count(*) AS o FROM tc a JOIN tc b ON a.document_id = b.document_id AND a.term = b.term AND a.model <> b.model GROUP BY ALL)
SELECT {_KEYS}, round(coalesce(2.0 * o / (x.n + y.n), 0), 6)::DOUBLE AS f1_score FROM p LEFT JOIN d USING (document_id, reference_model, comparison_model)
LEFT JOIN z x ON x.document_id = p.document_id AND x.model = reference_model LEFT JOIN z y ON y.document_id = p.document_id AND y.model = comparison_model""")
def vocab_overlap_f1(spark, sf_dir):
    return lexical.vocab_overlap_f1(grid(spark, sf_dir), REFERENCES, LOCALS)


def _gram_sql(source: str, orders: tuple[int, ...], glue: str) -> str:
    parts = []
    for n in orders:
        gram = f" || '{glue}' || ".join(f"w[i + {k}]" for k in range(n))
        parts.append(f"SELECT document_id, model, {n} AS n, gram, count(*) AS k FROM (SELECT document_id, model, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: {gram})) AS gram FROM t) GROUP BY ALL")
    return f"""t AS (SELECT document_id, model, {source} AS w FROM g WHERE model IN ({_quoted([*REFERENCES, *LOCALS])})), c AS ({' UNION ALL '.join(parts)}),
o AS (SELECT a.document_id, a.model AS reference_model, b.model AS comparison_model, a.n, sum(least(a.k, b.k))::DOUBLE AS o FROM c a JOIN c b ON a.document_id = b.document_id AND a.n = b.n AND a.gram = b.gram AND a.model <> b.model GROUP BY ALL),
q AS (SELECT p.document_id, p.doc_type, p.reference_model, p.comparison_model, z.n, len(x.w) AS rn, len(y.w) AS cn, coalesce(o.o, 0) AS o FROM p CROSS JOIN (SELECT unnest({list(orders)}) AS n) z
JOIN t x ON x.document_id = p.document_id AND x.model = p.reference_model JOIN t y ON y.document_id = p.document_id AND y.model = p.comparison_model LEFT JOIN o ON o.document_id = p.document_id AND o.reference_model = p.reference_model AND o.comparison_model = p.comparison_model AND o.n = z.n)"""


_ROUGE_TOKENS = f"CASE WHEN length({_STRIP('text')}) >= 10 THEN regexp_extract_all(lower(text), '[a-z0-9]+') ELSE []::VARCHAR[] END"


@register(f"""WITH {GRID}, {_PAIRS}, {_gram_sql(_ROUGE_TOKENS, (1, 2), ' ')}, s AS (SELECT *, coalesce(2.0 * o / nullif(greatest(rn - n + 1, 0) + greatest(cn - n + 1, 0), 0), 0) AS f FROM q)
SELECT {_KEYS}, round(max(f) FILTER (n = 1), 6) AS rouge1, round(max(f) FILTER (n = 2), 6) AS rouge2 FROM s GROUP BY {_KEYS}""")
def rouge(spark, sf_dir):
    return lexical.rouge(grid(spark, sf_dir), REFERENCES, LOCALS)


@register()
def rouge_l(spark, sf_dir):
    return lexical.rouge_l_pairs(grid(spark, sf_dir), REFERENCES, LOCALS)


_BLEU_SUM = " + ".join("exp(" + " + ".join(f"{w} * l{i}" for i, w in enumerate(ws, 1)) + ")" for ws in lexical.BLEU_WEIGHTS)


@register(f"""WITH {GRID}, {_PAIRS}, {_gram_sql("CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(text, '') END", (1, 2, 3, 4), '')},
v AS (SELECT {_KEYS}, rn, cn, {', '.join(f'max(ln(CASE WHEN o = 0 THEN 0.1 ELSE o END / greatest(cn - n + 1, 1))) FILTER (n = {n}) AS l{n}' for n in range(1, 5))}, max(o) FILTER (n = 1) AS hits FROM q GROUP BY ALL)
SELECT {_KEYS}, round(CASE WHEN hits > 0 AND cn > 0 THEN CASE WHEN cn > rn THEN 1 ELSE exp(1 - rn / cn) END * ({_BLEU_SUM}) / 4 ELSE 0 END, 6) AS bleu_score FROM v""")
def bleu(spark, sf_dir):
    return lexical.bleu(grid(spark, sf_dir), REFERENCES, LOCALS)


def markdown_corpus(spark, sf_dir):
    """The corpus with sentences as list items and comma lists as table rows, to give the plain texts a structure."""
    text = F.regexp_replace(F.regexp_replace(F.concat(F.lit("# "), F.col("text")), r"\. ", ".\n- "), ", ", " | ")
    return grid(spark, sf_dir).withColumn("text", text)


@register()
def structure_similarity(spark, sf_dir):
    return structure.structure_similarity(markdown_corpus(spark, sf_dir), REFERENCES, LOCALS)


@register()
def heading_dialects(spark, sf_dir):
    return structure.heading_dialects(markdown_corpus(spark, sf_dir))


@register()
def zero_structure_share(spark, sf_dir):
    return structure.zero_share(structure.structure_similarity(markdown_corpus(spark, sf_dir), REFERENCES, LOCALS), ["reference_model", "comparison_model"])


@register()
def similarity_table(spark, sf_dir):
    docs, refs, locs = grid(spark, sf_dir), REFERENCES, LOCALS
    lex = [f(docs, refs, locs) for f in (lexical.vocab_overlap_f1, lexical.rouge, lexical.bleu, lexical.tfidf_similarity, lexical.rouge_l_pairs)]
    return scores.similarity_table([*lex, structure.structure_similarity(markdown_corpus(spark, sf_dir), refs, locs)])


# Vector metrics ---------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.floor(v / 40).cast("string").alias("document_id"), F.lit("ADR").alias("doc_type"), F.concat(F.lit("m"), F.floor(v / 10) % 4).alias("model"), (v % 10).alias("chunk"), F.lit(10).alias("n_chunks"), (100 + v % 7 * 50).alias("chunk_len"), F.col("embedding").alias("vec"))


def _sides(rows):
    return rows.where("model in ('m0', 'm1')"), rows.where("model in ('m2', 'm3')")


@register("""WITH e AS (SELECT (vec_id // 40)::VARCHAR AS document_id, 'm' || ((vec_id // 10) % 4) AS model, vec_id % 10 AS chunk, 100 + vec_id % 7 * 50 AS l, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT r.document_id, r.model AS reference_model, c.model AS comparison_model, r.chunk AS rk, c.chunk AS ck, r.l AS rl, c.l AS cl, coalesce(list_cosine_similarity(r.v, c.v), 0) AS s FROM e r JOIN e c USING (document_id) WHERE r.model IN ('m0', 'm1') AND c.model IN ('m2', 'm3')),
a AS (SELECT document_id, reference_model, comparison_model, sum(b * l) / sum(l) AS s FROM (SELECT document_id, reference_model, comparison_model, rk, rl AS l, max(s) AS b FROM c GROUP BY ALL) GROUP BY ALL),
b AS (SELECT document_id, reference_model, comparison_model, sum(b * l) / sum(l) AS s FROM (SELECT document_id, reference_model, comparison_model, ck, cl AS l, max(s) AS b FROM c GROUP BY ALL) GROUP BY ALL)
SELECT document_id, 'ADR' AS doc_type, reference_model, comparison_model, round((a.s + b.s) / 2, 6) AS sts_score FROM a JOIN b USING (document_id, reference_model, comparison_model)""")
def sts_score(spark, sf_dir):
    return vectors.sts_score(*_sides(_vectors(spark, sf_dir)))


@register()
def emd_similarity(spark, sf_dir):
    return vectors.emd_similarity(*_sides(_vectors(spark, sf_dir).select(*lexical.DOC, F.col("chunk").alias("at"), "vec")))


@register("""WITH e AS (SELECT (vec_id // 40)::VARCHAR AS document_id, 'm' || ((vec_id // 10) % 4) AS model, vec_id % 10 AS at, vec_id % 10 // 5 AS chunk, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT r.document_id, r.model AS reference_model, c.model AS comparison_model, r.chunk, r.at AS ra, c.at AS ca, coalesce(list_cosine_similarity(r.v, c.v), 0) AS s FROM e r JOIN e c ON r.document_id = c.document_id AND r.chunk = c.chunk WHERE r.model IN ('m0', 'm1') AND c.model IN ('m2', 'm3')),
a AS (SELECT document_id, reference_model, comparison_model, chunk, avg(b) AS s FROM (SELECT document_id, reference_model, comparison_model, chunk, ra, max(s) AS b FROM c GROUP BY ALL) GROUP BY ALL),
b AS (SELECT document_id, reference_model, comparison_model, chunk, avg(b) AS s FROM (SELECT document_id, reference_model, comparison_model, chunk, ca, max(s) AS b FROM c GROUP BY ALL) GROUP BY ALL)
SELECT document_id, 'ADR' AS doc_type, reference_model, comparison_model, round(avg(CASE WHEN a.s + b.s = 0 THEN 0 ELSE 2 * a.s * b.s / (a.s + b.s) END), 6) AS bertscore FROM a JOIN b USING (document_id, reference_model, comparison_model, chunk) GROUP BY ALL""")
def bertscore(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumns({"at": F.col("chunk") % 5, "chunk": F.floor(F.col("chunk") / 5).cast("int"), "n_chunks": F.lit(2), "chunk_len": F.lit(500)})
    return vectors.bertscore(*_sides(rows))


# Scores and aggregates --------------------------------------------------------------------------

_SCORE = ["document_id", "Reference", "Model"]
_PAIR_SCORE = f"coalesce((coalesce({_mean(scores.LEXICAL)}, 0) * 0.20 + coalesce({_mean(scores.SEMANTIC)}, 0) * 0.45 + coalesce({_mean(scores.STRUCTURE)}, 0) * 0.35) / nullif(CASE WHEN {_mean(scores.LEXICAL)} IS NULL THEN 0 ELSE 0.20 END + CASE WHEN {_mean(scores.SEMANTIC)} IS NULL THEN 0 ELSE 0.45 END + CASE WHEN {_mean(scores.STRUCTURE)} IS NULL THEN 0 ELSE 0.35 END, 0), 0)"


@register(f"{EV} SELECT document_id, Reference, Model, round({_PAIR_SCORE}, 6)::DOUBLE AS overall_score, round(OverallScore, 6)::DOUBLE AS weighted_score, CASE WHEN bertscore IS NULL THEN 'failed' ELSE 'ok' END AS bertscore_status, same_family FROM ev")
def overall_scores(spark, sf_dir):
    rows = evaluations(spark, sf_dir)
    return rows.select(*_SCORE, scores.pair_score(list(scores.METRICS)).alias("overall_score"), F.col("OverallScore").alias("weighted_score"), names.metric_status(F.col("bertscore")).alias("bertscore_status"), "same_family")


def _agg_sql(columns) -> str:
    return ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in columns)


@register(f"{EV} SELECT Model, count(*) AS n, {_agg_sql([*scores.METRICS, 'OverallScore'])} FROM ev GROUP BY Model")
def model_metric_stats(spark, sf_dir):
    return scores.stats(evaluations(spark, sf_dir), ["Model"], [*scores.METRICS, "OverallScore"])


@register(f"{EV} SELECT DocType, Model, count(*) AS n, round(avg(OverallScore), 6) AS mean, round(stddev_samp(OverallScore), 6) AS std FROM ev GROUP BY GROUPING SETS ((Model), (DocType, Model))")
def model_by_type_stats(spark, sf_dir):
    return scores.stats_by_type(evaluations(spark, sf_dir), "OverallScore").select("DocType", "Model", "n", "mean", "std")


@register(f"{EV} SELECT count(DISTINCT document_id) AS documents, count(DISTINCT DocType) AS types, count(DISTINCT Reference) AS refs, count(DISTINCT Model) AS models FROM ev")
def distinct_counts(spark, sf_dir):
    return evaluations(spark, sf_dir).agg(*(F.countDistinct(c).alias(a) for c, a in (("document_id", "documents"), ("DocType", "types"), ("Reference", "refs"), ("Model", "models"))))


def _pivot_sql(value: str) -> str:
    return f"{EV} SELECT Reference, {', '.join(f'round(avg({value}) FILTER (Model = {m!r}), 6) AS {m}' for m in LOCALS)} FROM ev GROUP BY Reference"


@register(_pivot_sql("OverallScore"))
def reference_by_model_pivot(spark, sf_dir):
    return scores.means_pivot(evaluations(spark, sf_dir), "Reference", "Model", LOCALS, "OverallScore")


@register(_pivot_sql("teds_table_structure_similarity"))
def teds_pivot(spark, sf_dir):
    return scores.means_pivot(evaluations(spark, sf_dir), "Reference", "Model", LOCALS, "teds_table_structure_similarity")


@register(f"{EV} SELECT Model, {', '.join(f'round(avg({c}), 6) AS {c}' for c in scores.STRUCTURE)} FROM ev GROUP BY Model")
def structure_by_model(spark, sf_dir):
    return evaluations(spark, sf_dir).groupBy("Model").agg(*(F.avg(c).alias(c) for c in scores.STRUCTURE))


@register(f"{EV} SELECT Reference, Model, {', '.join(f'round(avg({c}), 6) AS {c}' for c in [*scores.METRICS, 'OverallScore'])} FROM ev GROUP BY Reference, Model")
def metric_table(spark, sf_dir):
    return evaluations(spark, sf_dir).groupBy("Reference", "Model").agg(*(F.avg(c).alias(c) for c in [*scores.METRICS, "OverallScore"]))


@register(f"{EV} SELECT Reference, Model, count(*) AS n, {_agg_sql(['OverallScore'])} FROM ev GROUP BY Reference, Model")
def score_mean_std(spark, sf_dir):
    return scores.stats(evaluations(spark, sf_dir), ["Reference", "Model"], ["OverallScore"])


@register(f"""{EV}, c AS (SELECT Reference, Model, avg(OverallScore) AS m FROM ev GROUP BY ALL), t AS (SELECT Reference, count(*) AS n, avg(OverallScore) AS mean, stddev_samp(OverallScore) AS std, var_pop(OverallScore) * count(OverallScore) AS ss FROM ev GROUP BY ALL)
SELECT Reference, round(mean, 6) AS mean, round(std, 6) AS std, round(std / mean * 100, 6) AS cv, round(max(m) - min(m), 6) AS span, round(n / count(*) * sum((m - mean) ** 2) / ss, 6) AS share FROM t JOIN c USING (Reference) GROUP BY Reference, n, mean, std, ss""")
def leniency(spark, sf_dir):
    return scores.leniency(evaluations(spark, sf_dir))


@register(f"{EV} SELECT round(avg(m), 6) AS mean, round(stddev_samp(m) / avg(m) * 100, 6) AS cv FROM (SELECT avg(OverallScore) AS m FROM ev GROUP BY Model)")
def model_mean_cv(spark, sf_dir):
    return evaluations(spark, sf_dir).groupBy("Model").agg(F.avg("OverallScore").alias("m")).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.avg("m") * 100).alias("cv"))


@register(f"{EV} SELECT Model, round(avg(rougeL), 6) AS lexical, round(avg(bertscore), 6) AS semantic, round(avg(moverscore), 6) AS mover, round(avg(bertscore) - avg(rougeL), 6) AS gap, round(avg(bertscore) / avg(rougeL), 6) AS ratio FROM ev GROUP BY Model")
def lexical_semantic_gap(spark, sf_dir):
    rows = evaluations(spark, sf_dir).groupBy("Model").agg(F.avg("rougeL").alias("lexical"), F.avg("bertscore").alias("semantic"), F.avg("moverscore").alias("mover"))
    return rows.withColumns({"gap": F.col("semantic") - F.col("lexical"), "ratio": F.try_divide("semantic", "lexical")})


@register(f"{EV} SELECT DocType, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM (SELECT document_id, DocType, avg(OverallScore) AS m FROM ev GROUP BY ALL) GROUP BY ROLLUP (DocType)")
def dataset_profile(spark, sf_dir):
    docs = evaluations(spark, sf_dir).groupBy("document_id", "DocType").agg(F.avg("OverallScore").alias("m"))
    return docs.rollup("DocType").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))


def _words(spark, sf_dir):
    return grid(spark, sf_dir).select("document_id", F.col("model").alias("Model"), names.count_words(F.col("text")).cast("double").alias("output_words"))


def signals(spark, sf_dir):
    rows = evaluations(spark, sf_dir).join(_words(spark, sf_dir), ["document_id", "Model"], "left")
    return kept(scores.document_signals(rows))


_SIGNALS = rf"""{EV}, w AS (SELECT document_id, model AS Model, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))::DOUBLE AS output_words FROM g),
s0 AS (SELECT document_id, avg(OverallScore) AS mean_overall, stddev_samp(teds_table_structure_similarity) AS teds_std, avg(({_mean(scores.LEXICAL)} * 0.20 + {_mean(scores.SEMANTIC)} * 0.45) / 0.65) AS lexsem, avg(output_words) AS output_words FROM ev LEFT JOIN w USING (document_id, Model) GROUP BY document_id),
s AS (SELECT * FROM s0 WHERE mean_overall IS NOT NULL AND teds_std IS NOT NULL AND lexsem IS NOT NULL AND output_words IS NOT NULL)"""


@register(f"{_SIGNALS} SELECT document_id, round(mean_overall, 6) AS mean_overall, round(teds_std, 6) AS teds_std, round(lexsem, 6)::DOUBLE AS lexsem, round(output_words, 6) AS output_words FROM s")
def document_signals(spark, sf_dir):
    return signals(spark, sf_dir)


@register(f"{EV} SELECT document_id, round(stddev_samp(teds_table_structure_similarity), 6) AS teds_std, round(avg(markdown_awareness_similarity), 6) AS structure, round(avg(bertscore), 6) AS bert, round(stddev_samp(rougeL), 6) AS rouge_std FROM ev GROUP BY document_id")
def document_panel(spark, sf_dir):
    return evaluations(spark, sf_dir).groupBy("document_id").agg(F.stddev_samp("teds_table_structure_similarity").alias("teds_std"), F.avg("markdown_awareness_similarity").alias("structure"), F.avg("bertscore").alias("bert"), F.stddev_samp("rougeL").alias("rouge_std"))


def _bias(key: str):
    sql = f"{EV} SELECT {key}, round(avg(OverallScore) FILTER (same_family), 6) AS own, round(avg(OverallScore) FILTER (NOT same_family), 6) AS other, round(avg(OverallScore) FILTER (same_family) - avg(OverallScore) FILTER (NOT same_family), 6) AS delta FROM ev GROUP BY {key} HAVING bool_or(same_family)"

    def run(spark, sf_dir):
        rows = evaluations(spark, sf_dir).groupBy(key).agg(F.avg(F.when(F.col("same_family"), F.col("OverallScore"))).alias("own"), F.avg(F.when(~F.col("same_family"), F.col("OverallScore"))).alias("other"), F.max("same_family").alias("f"))
        return rows.where("f").select(key, "own", "other", (F.col("own") - F.col("other")).alias("delta"))

    run.__name__ = f"family_bias_by_{key.lower()}"
    register(sql)(run)


_bias("Model")
_bias("Reference")


def _scenario_sql() -> str:
    groups = [_mean(c) for _, c in scores.GROUPS.values()]
    parts = [f"SELECT *, '{n}' AS scenario, {groups[0]} * {a} + {groups[1]} * {b} + {groups[2]} * {c} AS score FROM ev" for n, a, b, c in scores.SCENARIOS]
    return f"sc AS ({' UNION ALL '.join(parts)})"


@register(f"{EV}, {_scenario_sql()}, r0 AS (SELECT scenario, Model, avg(score) AS m FROM sc GROUP BY scenario, Model), r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY m DESC, Model) AS k FROM r0) SELECT scenario, k::INT AS k, Model, round(m, 6)::DOUBLE AS mean FROM r WHERE k <= 3")
def top_models(spark, sf_dir):
    return scores.top_models(evaluations(spark, sf_dir))


_AVG_RANK = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0".format


@register(f"{EV}, {_scenario_sql()}, b AS (SELECT document_id, Reference, Model, score AS base FROM sc WHERE scenario = 'baseline'), j AS (SELECT sc.scenario, base, score FROM sc JOIN b USING (document_id, Reference, Model) WHERE base IS NOT NULL AND score IS NOT NULL), k AS (SELECT scenario, {_AVG_RANK('scenario', 'base')} AS a, {_AVG_RANK('scenario', 'score')} AS c FROM j) SELECT scenario, round(corr(a, c), 6) AS rho, count(*) AS n FROM k GROUP BY scenario")
def weight_sensitivity(spark, sf_dir):
    crossed = scores.scenario_scores(scored(spark, sf_dir))
    # Ties of equal scores must not hang on the last bits of a sum.
    return inference.spearman(crossed.withColumn("base", F.col("OverallScore")), "base", "score", ["scenario"])


@register(f"{EV} SELECT DocType, {', '.join(f'count({m}) AS {m}' for m in scores.METRICS)} FROM ev GROUP BY DocType")
def metric_coverage(spark, sf_dir):
    return scores.metric_coverage(evaluations(spark, sf_dir), ["DocType"])


@register(f"{EV}, z AS (SELECT OverallScore AS a, {_PAIR_SCORE} AS b FROM ev) SELECT round(avg(a), 6)::DOUBLE AS mean, round(stddev_samp(a), 6) AS std, round(avg(b), 6)::DOUBLE AS stored_mean, round(max(abs(a - b)), 6)::DOUBLE AS max_difference FROM z")
def score_reconciliation(spark, sf_dir):
    rows = evaluations(spark, sf_dir).withColumn("stored", scores.pair_score(list(scores.METRICS)))
    return scores.reconcile(rows, "stored", "OverallScore")


_LOCAL = "WITH " + ev_sql(LOCALS, LOCALS)


@register(f"{_LOCAL} SELECT document_id, round(avg(OverallScore), 6)::DOUBLE AS local_agreement_mean, round(stddev_samp(OverallScore), 6) AS local_agreement_std FROM ev GROUP BY document_id")
def local_agreement(spark, sf_dir):
    return scores.local_agreement(evaluations(spark, sf_dir, LOCALS, LOCALS), "OverallScore")


@register("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def run_status_tally(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


# Ranks and set operations -----------------------------------------------------------------------


@register(f"SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, round({_AVG_RANK('l_returnflag', 'l_quantity')}, 6)::DOUBLE AS rank_in_flag, round(rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0, 6)::DOUBLE AS rank_of_price FROM lineitem")
def average_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    ranked = ranks.average_rank(ranks.average_rank(rows, "l_quantity", ["l_returnflag"], "rank_in_flag"), "l_extendedprice", None, "rank_of_price")
    return ranked.drop("l_extendedprice")


@register("SELECT l_returnflag, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT l_returnflag, l_quantity, count(*)::DOUBLE AS t FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def tie_counts(spark, sf_dir):
    return ranks.tie_sum(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@register("""WITH p AS (SELECT l_returnflag, l_suppkey, avg(l_discount) * avg(l_tax) AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY p, l_returnflag) AS i, count(*) OVER (PARTITION BY l_suppkey) AS m FROM p)
SELECT l_returnflag, l_suppkey, round(p, 6) AS p, round(max(least(1.0, p * (m - i + 1))) OVER (PARTITION BY l_suppkey ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""")
def holm_adjust(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg((F.avg("l_discount") * F.avg("l_tax")).alias("p"))
    return ranks.holm_adjust(rows, "p", ["l_suppkey"])


@register(f"{EV}, v AS (SELECT * FROM ev WHERE OverallScore IS NOT NULL) SELECT Reference, Model, round(avg(OverallScore), 6)::DOUBLE AS cell, round(avg(OverallScore) - (SELECT avg(OverallScore) FROM v x WHERE x.Reference = v.Reference) - (SELECT avg(OverallScore) FROM v x WHERE x.Model = v.Model) + (SELECT avg(OverallScore) FROM v), 6)::DOUBLE AS residual FROM v GROUP BY Reference, Model")
def double_centered_cells(spark, sf_dir):
    return ranks.centered_cells(evaluations(spark, sf_dir))


_CENTERED = f"{EV}, c AS (SELECT document_id, Reference, Model, avg(OverallScore) AS cell FROM ev GROUP BY ALL), dc AS (SELECT document_id, Reference, Model, CASE WHEN count(cell) OVER (PARTITION BY document_id) = 15 THEN cell - avg(cell) OVER (PARTITION BY document_id, Reference) - avg(cell) OVER (PARTITION BY document_id, Model) + avg(cell) OVER (PARTITION BY document_id) END AS residual FROM c)"


def centered(spark, sf_dir):
    return kept(ranks.centered_documents(evaluations(spark, sf_dir), len(REFERENCES), len(LOCALS)))


@register(f"{_CENTERED} SELECT document_id, Reference, Model, round(residual, 6)::DOUBLE AS residual FROM dc")
def double_centered_documents(spark, sf_dir):
    return centered(spark, sf_dir)


@register(f"{EV}, d AS (SELECT document_id, DocType, avg(OverallScore) AS mean, stddev_samp(OverallScore) AS std FROM ev GROUP BY ALL) SELECT document_id, DocType, round(mean, 6)::DOUBLE AS mean, round(std, 6) AS std, (rank() OVER (ORDER BY mean) + (count(*) OVER (PARTITION BY mean) - 1) / 2.0)::DOUBLE AS rank FROM d WHERE mean IS NOT NULL")
def document_difficulty(spark, sf_dir):
    docs = scored(spark, sf_dir).groupBy("document_id", "DocType").agg(F.avg("OverallScore").alias("mean"), F.stddev_samp("OverallScore").alias("std")).where("mean is not null")
    return ranks.average_rank(docs, "mean")


@register("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def limit_rows(spark, sf_dir):
    """A top-k listing: the limit is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@register("SELECT 'quality' AS kind, doc_id, quality AS value FROM labels UNION ALL SELECT 'toxic', doc_id, toxic FROM labels")
def union_references(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.select(F.lit("quality").alias("kind"), "doc_id", F.col("quality").alias("value")).unionByName(rows.select("doc_id", F.col("toxic").alias("value"), F.lit("toxic").alias("kind")), allowMissingColumns=True)


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)")
def pending_work(spark, sf_dir):
    return sources.pending_work(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("length")), "doc_id")


# Statistics -------------------------------------------------------------------------------------


def _anova_sql(source: str) -> str:
    """Type-II squares of ``source(a, b, v)`` where b has two levels, so the reduced normal equation has one unknown."""
    return f"""c AS (SELECT a, b, count(*) AS n, avg(v) - (SELECT avg(v) FROM {source}) AS m, var_pop(v) * count(*) AS w FROM {source} WHERE v IS NOT NULL GROUP BY a, b),
ra AS (SELECT a, sum(n) AS n, sum(n * m) AS s, sum(n) FILTER (b = (SELECT min(b) FROM c)) AS n1, sum(n * m) FILTER (b = (SELECT min(b) FROM c)) AS s1 FROM c GROUP BY a),
rb AS (SELECT b, sum(n) AS n, sum(n * m) AS s FROM c GROUP BY b),
z AS (SELECT (SELECT sum(n * m * m) FROM c) AS q, (SELECT sum(s * s / n) FROM ra) AS fa, (SELECT sum(s * s / n) FROM rb) AS fb, sum(coalesce(s1, 0) - coalesce(n1, 0) * s / n) AS r, sum(coalesce(n1, 0) - coalesce(n1, 0) * coalesce(n1, 0) / n) AS d,
    count(*) AS ka, (SELECT count(*) FROM rb) AS kb, (SELECT count(*) FROM c) AS cells, (SELECT sum(w) FROM c) AS w, (SELECT sum(n) FROM c) AS n FROM ra),
y AS (SELECT *, greatest(0, q - fa - r * r / d) AS rest FROM z),
t AS (SELECT unnest([{{'t': 'a', 'ss': q - fb - rest, 'df': ka - 1}}, {{'t': 'b', 'ss': q - fa - rest, 'df': kb - 1}}, {{'t': 'a:b', 'ss': rest, 'df': cells - ka - kb + 1}}, {{'t': 'Residual', 'ss': w, 'df': n - cells}}], recursive := true), w / (n - cells) AS ms, (n - cells)::BIGINT AS df2 FROM y)"""


@register(f"""WITH src AS (SELECT l_returnflag AS a, l_linestatus AS b, l_extendedprice AS v FROM lineitem), {_anova_sql('src')}
SELECT CASE t WHEN 'a' THEN 'l_returnflag' WHEN 'b' THEN 'l_linestatus' WHEN 'a:b' THEN 'l_returnflag:l_linestatus' ELSE t END AS term, round(ss, 6) AS ss, df::BIGINT AS df, CASE WHEN t <> 'Residual' AND df > 0 THEN round(ss / df / ms, 6) END AS f, round(ss / sum(ss) OVER (), 6) AS eta2, df2 FROM t""")
def two_way_anova_f(spark, sf_dir):
    return factors.two_way_anova(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice")


@register()
def two_way_anova(spark, sf_dir):
    return inference.with_p(factors.two_way_anova(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice"), "f", "f", "df", "df2")


@register()
def two_way_anova_of_many_levels(spark, sf_dir):
    """Parts and suppliers: as many levels as the tables hold, most cells empty."""
    return factors.two_way_anova(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice")


_FORSYTHE = "WITH d AS (SELECT l_returnflag, l_linestatus, abs(l_extendedprice - median(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus)) AS d FROM lineitem), c AS (SELECT count(*) AS n, avg(d) AS m, var_pop(d) * count(*) AS w FROM d GROUP BY l_returnflag, l_linestatus)"


@register(f"{_FORSYTHE} SELECT round(((sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS f, count(*) - 1 AS df1, (sum(n) - count(*))::BIGINT AS df2 FROM c")
def brown_forsythe(spark, sf_dir):
    return inference.brown_forsythe(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@register()
def shapiro_wilk(spark, sf_dir):
    return inference.shapiro_wilk(evaluations(spark, sf_dir).select("document_id", "Reference", "Model", "OverallScore"), ["Reference", "Model"], "OverallScore")


@register()
def normality(spark, sf_dir):
    """The residuals of the cell means as one sample, and the number of cells that are not normal."""
    return inference.normality(evaluations(spark, sf_dir).select("document_id", "Reference", "Model", "OverallScore"), ["Reference", "Model"], "OverallScore")


@register("""WITH r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events WHERE value IS NOT NULL), s AS (SELECT count(*)::DOUBLE AS n, sum(r)::DOUBLE AS r FROM r GROUP BY event_type),
t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM events WHERE value IS NOT NULL GROUP BY value)), z AS (SELECT sum(n) AS n, count(*) AS k, sum(r * r / n) AS q FROM s)
SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, k - 1 AS df FROM z, t""")
def kruskal_wallis(spark, sf_dir):
    return inference.kruskal_wallis(table(spark, sf_dir, "events"), "event_type", "value")


@register(f"""{EV}, c AS (SELECT document_id, Model, avg(OverallScore) AS v FROM ev GROUP BY ALL HAVING avg(OverallScore) IS NOT NULL), f2 AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY document_id) = 3),
r AS (SELECT document_id, Model, {_AVG_RANK('document_id', 'v')} AS r FROM f2), q AS (SELECT sum(s * s)::DOUBLE AS q FROM (SELECT sum(r)::DOUBLE AS s FROM r GROUP BY Model)), b AS (SELECT count(DISTINCT document_id) AS n FROM f2),
t AS (SELECT coalesce(sum(t * t * t - t), 0)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS t FROM f2 GROUP BY document_id, v)), z AS (SELECT n, (12.0 / (n * 12) * q - 3 * n * 4) / (1 - ties / (n * 24)) AS chi2 FROM q, b, t)
SELECT round(chi2, 6)::DOUBLE AS chi2, 2 AS df, round(chi2 / (n * 2), 6)::DOUBLE AS w, n AS blocks FROM z""")
def friedman(spark, sf_dir):
    return inference.friedman(scored(spark, sf_dir), "document_id", "Model", "OverallScore", len(LOCALS))


_WIDE = ", ".join(f"avg(OverallScore) FILTER (Model = '{m}') AS {m}" for m in LOCALS)
_DIFFS = " UNION ALL ".join(f"SELECT '{a} vs {b}' AS comparison, {a} - {b} AS d FROM wide" for a, b in MODEL_PAIRS)


_PAIRED = f"""{EV.replace('WITH', 'WITH RECURSIVE', 1)}, wide AS (SELECT document_id, {_WIDE} FROM ev GROUP BY document_id), dd AS (SELECT * FROM ({_DIFFS}) WHERE d IS NOT NULL),
a AS (SELECT comparison, d, {_AVG_RANK('comparison', 'abs(d)')} AS r FROM dd), z AS (SELECT comparison, d, {_AVG_RANK('comparison', 'abs(d)')} AS r FROM dd WHERE d <> 0),
t AS (SELECT comparison, sum(t * t * t - t) AS ties FROM (SELECT comparison, count(*)::DOUBLE AS t FROM z GROUP BY comparison, abs(d)) GROUP BY comparison),
x AS (SELECT comparison, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS std, sum((d > 0)::INT)::BIGINT AS wins, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS rp, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS rm FROM a GROUP BY comparison),
y AS (SELECT comparison, count(*)::DOUBLE AS m, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS wp, least(wp, coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w FROM z GROUP BY comparison),
tested AS (SELECT comparison, n, mean, w, wp, n - m AS zeros, (rp - rm) / (rp + rm) AS r, mean / std AS dz, wins, (w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) AS z FROM x LEFT JOIN y USING (comparison) LEFT JOIN t USING (comparison))"""
_PAIRED_COLUMNS = "comparison, n, round(mean, 6)::DOUBLE AS mean, w, round(r, 6) AS r, round(dz, 6)::DOUBLE AS dz, wins, round(z, 6) AS z"


@register(f"{_PAIRED} SELECT {_PAIRED_COLUMNS} FROM tested")
def paired_wilcoxon(spark, sf_dir):
    return inference.signed_rank(inference.paired_differences(scored(spark, sf_dir), MODEL_PAIRS), "d", ["comparison"]).drop("w_plus", "zeros")


def _normal_p(z: str) -> str:
    """Two-sided p of ``z`` by the error function's series of positive terms."""
    x = f"(abs({z}) / sqrt(2))"
    return f"CASE WHEN abs({z}) > 7 THEN 0.0 WHEN {z} = 0 THEN 1.0 ELSE 1 - exp(-{x} * {x}) * list_sum([exp((2 * i + 1) * ln({x}) - lgamma(i + 1.5)) for i in range(160)]) END"


# Ways to sign the ranks 1 to n by their sum, a rank at a time.
_SIGNED = """ways AS (SELECT 0 AS n, 0 AS w, 1::DOUBLE AS c UNION ALL SELECT n + 1, x, sum(c) FROM ways, unnest([w, w + n + 1]) u(x) WHERE n < 50 GROUP BY n, x),
exact AS (SELECT comparison, CASE WHEN floor(wp)::INT = any_value(ways.n) * (any_value(ways.n) + 1) // 2 // 2 THEN 1.0 ELSE least(1.0, 2 * least(sum(c) FILTER (ways.w <= floor(wp)), sum(c) FILTER (ways.w >= floor(wp))) / sum(c)) END AS p FROM tested JOIN ways ON ways.n = tested.n WHERE zeros = 0 GROUP BY comparison, wp)"""


@register(f"""{_PAIRED}, {_SIGNED}, ps AS (SELECT tested.*, coalesce(p, {_normal_p('z')}) AS p FROM tested LEFT JOIN exact USING (comparison)), o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS k FROM ps)
SELECT {_PAIRED_COLUMNS}, round(p, 6)::DOUBLE AS p, round(max(least(1.0, p * (k - i + 1))) OVER (ORDER BY i), 6)::DOUBLE AS p_holm FROM o""")
def paired_wilcoxon_holm(spark, sf_dir):
    tested = inference.with_signed_rank_p(inference.signed_rank(inference.paired_differences(scored(spark, sf_dir), MODEL_PAIRS), "d", ["comparison"])).drop("w_plus", "zeros")
    return ranks.holm_adjust(tested, "p")


# Signs of the differences of small samples: each supplier's months against all its others.


@register(f"""WITH RECURSIVE q AS (SELECT l_suppkey, month(l_shipdate) AS m, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), dd AS (SELECT l_suppkey AS comparison, v - avg(v) OVER (PARTITION BY l_suppkey) AS d FROM q),
z AS (SELECT comparison, d, {_AVG_RANK('comparison', 'abs(d)')} AS r FROM dd WHERE d <> 0), y AS (SELECT comparison, count(*) AS m, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS wp FROM z GROUP BY comparison),
tested AS (SELECT comparison, count(*) AS n, count(*) - coalesce(any_value(m), 0) AS zeros, any_value(wp) AS wp FROM dd LEFT JOIN y USING (comparison) GROUP BY comparison), {_SIGNED}
SELECT comparison AS l_suppkey, n, round(p, 6)::DOUBLE AS p FROM tested JOIN exact USING (comparison)""")
def small_sample_signed_ranks(spark, sf_dir):
    """Months of each supplier, at most twelve differences a group."""
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.month("l_shipdate").alias("m")).agg(F.avg("l_quantity").alias("v"))
    middle = means.groupBy("l_suppkey").agg(F.avg("v").alias("middle"))
    tested = inference.with_signed_rank_p(inference.signed_rank(means.join(middle, "l_suppkey").withColumn("d", F.col("v") - F.col("middle")), "d", ["l_suppkey"]))
    return tested.where("zeros = 0").select("l_suppkey", "n", "p")


def _mw_sql(source: str, comparison: str) -> str:
    """``source`` gives comparison, first, v."""
    return f"""k AS (SELECT *, {_AVG_RANK('comparison', 'v')} AS r FROM {source} WHERE v IS NOT NULL), t AS (SELECT comparison, sum(t * t * t - t) AS ties FROM (SELECT comparison, count(*)::DOUBLE AS t FROM k GROUP BY comparison, v) GROUP BY comparison),
s AS (SELECT comparison, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, sum(r) FILTER (first)::DOUBLE AS r1, avg(v) FILTER (first) AS m1, avg(v) FILTER (NOT first) AS m2, var_samp(v) FILTER (first) AS v1, var_samp(v) FILTER (NOT first) AS v2 FROM k GROUP BY comparison),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sp, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sd FROM s JOIN t USING (comparison))
SELECT comparison, n1, n2, round(m1 - m2, 6)::DOUBLE AS delta, u::DOUBLE AS u, round(2 * u / (n1 * n2) - 1, 6)::DOUBLE AS r, round(CASE WHEN sp = 0 THEN 0 ELSE (m1 - m2) / sp END, 6)::DOUBLE AS d, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sd, 6)::DOUBLE AS z FROM u"""


_MW_ROWS = " UNION ALL ".join(f"SELECT '{a} vs {b}' AS comparison, Model = '{a}' AS first, OverallScore AS v FROM ev WHERE Model IN ('{a}', '{b}')" for a, b in MODEL_PAIRS)


@register(f"{EV}, rows AS ({_MW_ROWS}), {_mw_sql('rows', '')}")
def mann_whitney(spark, sf_dir):
    return inference.mann_whitney(scored(spark, sf_dir), "Model", "OverallScore", MODEL_PAIRS).drop("ties")


@register(f"{EV}, rows AS (SELECT 'same vs cross' AS comparison, same_family AS first, OverallScore AS v FROM ev), {_mw_sql('rows', '')}")
def family_test(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("kind", F.when(F.col("same_family"), "same").otherwise("cross"))
    return inference.mann_whitney(rows, "kind", "OverallScore", [("same", "cross")]).drop("ties")


_TYPES = f"{EV}, rows AS (SELECT 'patent vs report' AS comparison, DocType = 'patent' AS first, avg(OverallScore) AS v FROM ev GROUP BY document_id, DocType), {_mw_sql('rows', '')}"
_BY_TYPE = _TYPES.rpartition("SELECT comparison")


@register(f"{_BY_TYPE[0]}, by_type AS ({_BY_TYPE[1]}{_BY_TYPE[2]}), tested AS (SELECT *, greatest(z, 0) AS zp FROM by_type) SELECT * EXCLUDE (zp), round({_normal_p('zp')}, 6)::DOUBLE AS p FROM tested")
def doc_type_mann_whitney(spark, sf_dir):
    """Of document means, only if there are exactly two types."""
    return inference.two_type_rank_sum(scored(spark, sf_dir), "DocType", "document_id", "OverallScore").drop("ties")


# Ways to deal ranks to a sample of n1 and one of n2, by U: the last rank goes to the one or the other.
_DEALT = """deals AS (SELECT n1, n2, u, c FROM (SELECT 0 AS n1, 0 AS n2, 0 AS u, 1::DOUBLE AS c)
UNION ALL SELECT n1 + x, n2 + 1 - x, u + x * n2, sum(c) FROM deals, unnest([0, 1]) t(x) WHERE n1 + n2 < 14 GROUP BY ALL)"""


@register(f"""WITH RECURSIVE k AS (SELECT l_suppkey AS comparison, month(l_shipdate) < 7 AS first, avg(l_extendedprice) AS v FROM lineitem GROUP BY l_suppkey, month(l_shipdate)),
r AS (SELECT *, rank() OVER (PARTITION BY comparison ORDER BY v) AS r, count(*) OVER (PARTITION BY comparison, v) AS t FROM k),
s AS (SELECT comparison, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, sum(r) FILTER (first) AS r1 FROM r GROUP BY comparison HAVING max(t) = 1 AND n1 > 0 AND n2 > 0), m AS (SELECT comparison, n1, n2, (r1 - n1 * (n1 + 1) / 2)::BIGINT AS u FROM s), {_DEALT}
SELECT comparison AS l_suppkey, m.n1, m.n2, m.u::DOUBLE AS u, round(least(1.0, 2 * sum(c) FILTER (d.u <= least(m.u, m.n1 * m.n2 - m.u)) / sum(c)), 6)::DOUBLE AS p FROM m JOIN deals d ON d.n1 = m.n1 AND d.n2 = m.n2 GROUP BY ALL""")
def small_sample_rank_sums(spark, sf_dir):
    """Each supplier's first half-year months against the others."""
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("comparison"), F.month("l_shipdate").alias("m")).agg(F.avg("l_extendedprice").alias("v"))
    tested = inference.with_rank_sum_p(inference.rank_sums(means.select("comparison", (F.col("m") < 7).alias("first"), "v")))
    return tested.where("ties = 0 and n1 > 0 and n2 > 0").select(F.col("comparison").alias("l_suppkey"), "n1", "n2", "u", "p")


_FAMILY_RESIDUALS = " OR ".join(f"(Reference = '{r}' AND Model = '{c}')" for r, c, _ in FAMILIES)


def _draws_sql(keys: str, side: str, replicates: int) -> str:
    """Of ``sized(keys, n)``: the places that fall to each draw of each replicate."""
    p, step = bootstrap.PRIME, bootstrap.STEPS
    return f"""SELECT {keys}, rep, ((y * y % {p}) * x % {p}) * n // {p} AS place FROM (SELECT *, x * x % {p} AS y FROM (
SELECT {keys}, rep, n, (draw * {step['draw']} + rep * {step['rep']} + (({side}) * {step['side']} + {42 * step['seed'] % p}) % {p}) % {p} AS x FROM (SELECT *, unnest(range(n)) AS draw FROM sized), (SELECT unnest(range({replicates})) AS rep)))"""


def _mean_ci_sql(group: str, source: str) -> str:
    """Percentiles of resampled means of ``source(group, v)``, as the tables ``m`` and ``ci``."""
    return f"""w0 AS (SELECT {group}, v, row_number() OVER (PARTITION BY {group} ORDER BY v) - 1 AS place FROM ({source})), sized AS (SELECT {group}, count(*) AS n FROM w0 GROUP BY {group}),
m AS (SELECT {group}, rep, avg(v) AS m FROM ({_draws_sql(group, '0', 5000)}) JOIN w0 USING ({group}, place) GROUP BY {group}, rep), ci AS (SELECT {group}, round(quantile_cont(m, 0.025), 6)::DOUBLE AS low, round(quantile_cont(m, 0.975), 6)::DOUBLE AS high FROM m GROUP BY {group})"""


@register(f"{_CENTERED}, {_mean_ci_sql('Reference', f'SELECT Reference, residual AS v FROM dc WHERE residual IS NOT NULL AND ({_FAMILY_RESIDUALS})')} SELECT * FROM ci")
def bootstrap_mean_ci(spark, sf_dir):
    rows = centered(spark, sf_dir).where(_FAMILY_RESIDUALS)
    return bootstrap.bootstrap_mean_ci(rows, "residual", ["Reference"])


def _biserial_ci_sql(source: str) -> str:
    """Percentiles of resampled rank-biserial r of ``source(comparison, first, v)``, as the table ``rci``."""
    return f"""b0 AS (SELECT comparison, first, v, row_number() OVER (PARTITION BY comparison, first ORDER BY v) - 1 AS place FROM ({source}) WHERE v IS NOT NULL), sized AS (SELECT comparison, first, count(*) AS n FROM b0 GROUP BY ALL),
b1 AS (SELECT comparison, rep, v, first FROM ({_draws_sql('comparison, first', 'CASE WHEN first THEN 0 ELSE 1 END', 3000)}) JOIN b0 USING (comparison, first, place)),
b2 AS (SELECT comparison, rep, v, count(*) FILTER (first) AS k1, count(*) FILTER (NOT first) AS k2 FROM b1 GROUP BY ALL), b3 AS (SELECT *, coalesce(sum(k2) OVER (PARTITION BY comparison, rep ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b2),
b4 AS (SELECT comparison, rep, 2 * sum(k1 * (below + k2 / 2.0::DOUBLE)) / (sum(k1) * sum(k2))::DOUBLE - 1 AS r FROM b3 GROUP BY ALL), rci AS (SELECT comparison, round(quantile_cont(r, 0.025), 6)::DOUBLE AS low, round(quantile_cont(r, 0.975), 6)::DOUBLE AS high FROM b4 GROUP BY comparison)"""


@register(f"{EV}, {_biserial_ci_sql('SELECT 1 AS comparison, same_family AS first, OverallScore AS v FROM ev')} SELECT low, high FROM rci")
def bootstrap_rank_biserial_ci(spark, sf_dir):
    return bootstrap.bootstrap_rank_biserial_ci(evaluations(spark, sf_dir), "same_family", "OverallScore")


@register(f"{EV}, {_biserial_ci_sql(_MW_ROWS)} SELECT comparison, low, high FROM rci")
def independent_pairs_ci(spark, sf_dir):
    return family.independent_pairs(scored(spark, sf_dir), MODEL_PAIRS).select("comparison", "low", "high")


def _rank_sums_with_p(rows: str) -> str:
    """Mann-Whitney of ``rows(comparison, first, v)`` in full digits with p, as the table ``tested``, for samples of more than eight values."""
    tables, _, columns = _mw_sql("rows", "").rpartition("SELECT comparison")
    exact = columns.replace("round(", "(").replace(", 6)", ")")
    return f"rows AS ({rows}), {tables}raw AS (SELECT comparison{exact}), tested AS (SELECT *, {_normal_p('greatest(z, 0)')} AS p FROM raw)".replace("\nraw AS", ",\nraw AS")


_TESTED_COLUMNS = "comparison, n1, n2, round(delta, 6)::DOUBLE AS delta, u, round(r, 6)::DOUBLE AS r, round(d, 6)::DOUBLE AS d, round(z, 6)::DOUBLE AS z, round(p, 6)::DOUBLE AS p"


@register(f"""{EV}, {_rank_sums_with_p(_MW_ROWS)}, o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS tests FROM tested), h AS (SELECT *, max(least(1.0, p * (tests - i + 1))) OVER (ORDER BY i) AS p_holm FROM o), {_biserial_ci_sql(_MW_ROWS)}
SELECT {_TESTED_COLUMNS}, round(p_holm, 6)::DOUBLE AS p_holm, low, high FROM h JOIN rci USING (comparison)""")
def independent_pairs(spark, sf_dir):
    """All models against each other as independent samples, with p, Holm's p and the interval of r."""
    return family.independent_pairs(scored(spark, sf_dir), MODEL_PAIRS)


_SAME_ROWS = "SELECT 'same vs cross' AS comparison, same_family AS first, OverallScore AS v FROM ev"


@register(f"""{EV}, {_rank_sums_with_p(_SAME_ROWS)}, {_biserial_ci_sql(_SAME_ROWS)}
SELECT {_TESTED_COLUMNS}, (SELECT round(avg(v) FILTER (first), 6) FROM rows)::DOUBLE AS own, (SELECT round(avg(v) FILTER (NOT first), 6) FROM rows)::DOUBLE AS other, low, high FROM tested JOIN rci USING (comparison)""")
def same_against_cross(spark, sf_dir):
    """The family test whole: means, U, p, r with its interval, d."""
    return family.same_against_cross(scored(spark, sf_dir))


_FAMILY_LIST = " UNION ALL ".join(f"SELECT '{r}' AS own_reference, '{c}' AS Model, '{f}' AS family" for r, c, f in FAMILIES)


@register(f"""{EV}, l AS ({_FAMILY_LIST}), v AS (SELECT * FROM ev WHERE OverallScore IS NOT NULL), gaps AS (SELECT family, own_reference, l.Model, avg(OverallScore) FILTER (Reference = own_reference) AS own, avg(OverallScore) FILTER (Reference <> own_reference) AS other,
(SELECT avg(OverallScore) FROM v WHERE v.Model = l.Model) AS column_mean, (SELECT avg(OverallScore) FROM v WHERE v.Reference = own_reference) AS row_mean, (SELECT avg(OverallScore) FROM v) AS grand FROM v JOIN l USING (Model) GROUP BY ALL)
SELECT family, own_reference, Model, round(own, 6)::DOUBLE AS own, round(other, 6)::DOUBLE AS other, round(own - other, 6)::DOUBLE AS gap, round(own - row_mean - column_mean + grand, 6)::DOUBLE AS cell_residual FROM gaps""")
def family_gaps(spark, sf_dir):
    return family.family_gaps(scored(spark, sf_dir), FAMILIES)


_OWN_RESIDUALS = f"own AS (SELECT dc.*, l.family FROM dc JOIN ({_FAMILY_LIST}) l ON dc.Reference = l.own_reference AND dc.Model = l.Model WHERE residual IS NOT NULL)"


@register(f"{_CENTERED}, {_OWN_RESIDUALS}, {_mean_ci_sql('family', 'SELECT family, residual AS v FROM own')} SELECT family, count(*) AS n, round(avg(residual), 6)::DOUBLE AS mean_residual, sum((residual > 0)::INT)::BIGINT AS positive, round(avg((residual > 0)::INT), 6)::DOUBLE AS share_positive, any_value(low) AS low, any_value(high) AS high FROM own JOIN ci USING (family) GROUP BY family")
def family_residuals(spark, sf_dir):
    return family.residual_signs(centered(spark, sf_dir), FAMILIES).drop("w", "z", "p")


@register(f"""{_CENTERED.replace('WITH', 'WITH RECURSIVE', 1)}, {_OWN_RESIDUALS}, z AS (SELECT family AS comparison, residual AS d, {_AVG_RANK('family', 'abs(residual)')} AS r FROM own WHERE residual <> 0),
t AS (SELECT comparison, sum(t * t * t - t) AS ties FROM (SELECT comparison, count(*)::DOUBLE AS t FROM z GROUP BY comparison, abs(d)) GROUP BY comparison),
y AS (SELECT comparison, count(*)::DOUBLE AS m, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS wp, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS wm FROM z GROUP BY comparison),
sums AS (SELECT family AS comparison, count(*) AS n, avg(residual) AS mean, sum((residual > 0)::INT)::BIGINT AS positive FROM own GROUP BY family),
tested AS (SELECT *, n - m AS zeros, least(wp, wm) AS w, (least(wp, wm) - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) AS z FROM sums LEFT JOIN y USING (comparison) LEFT JOIN t USING (comparison)), {_SIGNED}, {_mean_ci_sql('family', 'SELECT family, residual AS v FROM own')}
SELECT comparison AS family, n, round(mean, 6)::DOUBLE AS mean_residual, w, round(z, 6)::DOUBLE AS z, CASE WHEN n > 5 THEN round(coalesce(p, {_normal_p('z')}), 6)::DOUBLE END AS p, positive, round(positive / n, 6)::DOUBLE AS share_positive, low, high
FROM tested LEFT JOIN exact USING (comparison) JOIN ci ON ci.family = tested.comparison""")
def family_residual_tests(spark, sf_dir):
    """The same with Wilcoxon's statistic and p."""
    return family.residual_signs(centered(spark, sf_dir), FAMILIES)


@register(f"""{_CENTERED}, dd AS (SELECT Reference, Model, Reference || Model AS c, residual AS d FROM dc WHERE residual IS NOT NULL AND ({_FAMILY_RESIDUALS})),
a AS (SELECT *, {_AVG_RANK('c', 'abs(d)')} AS r FROM dd), z AS (SELECT *, {_AVG_RANK('c', 'abs(d)')} AS r FROM dd WHERE d <> 0),
t AS (SELECT Reference, Model, sum(t * t * t - t) AS ties FROM (SELECT Reference, Model, count(*)::DOUBLE AS t FROM z GROUP BY Reference, Model, abs(d)) GROUP BY ALL),
x AS (SELECT Reference, Model, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS std, sum((d > 0)::INT)::BIGINT AS wins, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS rp, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS rm FROM a GROUP BY ALL),
y AS (SELECT Reference, Model, count(*)::DOUBLE AS m, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w FROM z GROUP BY ALL)
SELECT Reference, Model, n, round(mean, 6)::DOUBLE AS mean, w, round((rp - rm) / (rp + rm), 6) AS r, round(mean / std, 6)::DOUBLE AS dz, wins, round((w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 6) AS z FROM x LEFT JOIN y USING (Reference, Model) LEFT JOIN t USING (Reference, Model)""")
def residual_sign_test(spark, sf_dir):
    rows = centered(spark, sf_dir).where(_FAMILY_RESIDUALS).where("residual is not null")
    return inference.signed_rank(rows, "residual", ["Reference", "Model"]).drop("w_plus", "zeros")


_CHI = f"""{_CENTERED}, x AS (SELECT CASE WHEN document_id LIKE 'PAT%' THEN 'patent' ELSE 'report' END AS DocType, residual > 0 AS up FROM dc WHERE residual IS NOT NULL AND ({_FAMILY_RESIDUALS})),
t AS (SELECT count(*) FILTER (DocType = 'patent' AND up)::DOUBLE AS a, count(*) FILTER (DocType = 'patent' AND NOT up)::DOUBLE AS b, count(*) FILTER (DocType = 'report' AND up)::DOUBLE AS c, count(*) FILTER (DocType = 'report' AND NOT up)::DOUBLE AS d FROM x),
chi AS (SELECT a, b, c, d, ((a + b + c + d) * greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))) AS chi2, round((a + c) / (a + b + c + d), 6) AS share_positive FROM t)"""


@register(f"{_CHI} SELECT * REPLACE (round(chi2, 6) AS chi2) FROM chi")
def chi_square_2x2(spark, sf_dir):
    rows = centered(spark, sf_dir).where(_FAMILY_RESIDUALS).withColumn("DocType", names.classify_doc_type(F.col("document_id")))
    return inference.sign_crosstab(rows, "DocType", ("patent", "report"), "residual")


@register(f"{_CHI} SELECT * REPLACE (round(chi2, 6) AS chi2), round({_normal_p('sqrt(chi2)')}, 6)::DOUBLE AS p FROM chi")
def chi_square_p(spark, sf_dir):
    return inference.with_p(chi_square_2x2(spark, sf_dir), "chi2", "chi2", F.lit(1.0))


@register(f"{_SIGNALS}, r AS (SELECT rank() OVER (ORDER BY output_words) + (count(*) OVER (PARTITION BY output_words) - 1) / 2.0 AS a, rank() OVER (ORDER BY teds_std) + (count(*) OVER (PARTITION BY teds_std) - 1) / 2.0 AS b FROM s) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, sf_dir):
    return inference.spearman(signals(spark, sf_dir), "output_words", "teds_std")


@register(f"{_SIGNALS} SELECT round(corr(output_words, mean_overall), 6) AS r, round(regr_slope(mean_overall, output_words), 6) AS slope, round(regr_intercept(mean_overall, output_words), 6) AS intercept, regr_count(mean_overall, output_words)::BIGINT AS n FROM s")
def pearson_trend(spark, sf_dir):
    return inference.trend(signals(spark, sf_dir), "output_words", "mean_overall")


@register("""WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n, avg(l_extendedprice) AS my, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem),
p AS (SELECT sum(((l_extendedprice - i - s * l_quantity) / (1 - 1.0::DOUBLE / n - (l_quantity - mx) ** 2 / sxx)) ** 2) AS press, sum((l_extendedprice - my) ** 2) AS sst FROM lineitem, b)
SELECT n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2, round(1 - press / sst, 6) AS loocv_r2 FROM b, p""")
def ols_single(spark, sf_dir):
    found = inference.ols_with_loocv(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return found.select(F.col("n").cast("long").alias("n"), "r2", "adj_r2", "loocv_r2")


_TWO = f"""{_SIGNALS}, c AS (SELECT count(*)::DOUBLE AS n, avg(mean_overall) AS my, avg(teds_std) AS m1, avg(output_words) AS m2 FROM s), d AS (SELECT mean_overall - my AS y, teds_std - m1 AS x, output_words - m2 AS z, n FROM s, c),
q AS (SELECT any_value(n) AS n, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM d), b AS (SELECT *, xx * zz - xz * xz AS det, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM q),
e AS (SELECT sum((y - b1 * x - b2 * z) ** 2) AS rss, sum(((y - b1 * x - b2 * z) / (1 - 1 / d.n - (x * x * zz - 2 * x * z * xz + z * z * xx) / det)) ** 2) AS press FROM d, b)
SELECT n::BIGINT AS n, round(1 - rss / yy, 6) AS r2, round(1 - (rss / yy) * (n - 1) / (n - 3), 6) AS adj_r2, round(((yy - rss) / 2) / (rss / (n - 3)), 6) AS f, round(1 - press / yy, 6) AS loocv_r2 FROM b, e"""


@register(_TWO)
def ols_two_signals(spark, sf_dir):
    found = inference.ols_with_loocv(signals(spark, sf_dir), "mean_overall", ["teds_std", "output_words"])
    return found.select(F.col("n").cast("long").alias("n"), "r2", "adj_r2", "f", "loocv_r2")


@register()
def ols_with_loocv(spark, sf_dir):
    found = inference.ols_with_loocv(signals(spark, sf_dir), "mean_overall", ["teds_std", "output_words"])
    return inference.with_p(found, "f", "f", "df1", "df2")


@register(f"""{EV}, c AS (SELECT document_id, Reference, Model, avg(OverallScore) AS v FROM ev GROUP BY ALL HAVING avg(OverallScore) IS NOT NULL), f2 AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY document_id) = 15),
z AS (SELECT (SELECT var_pop(v) * count(*) FROM f2) AS total, (SELECT var_pop(m) * count(*) FROM (SELECT avg(v) AS m FROM f2 GROUP BY document_id)) AS su, (SELECT count(DISTINCT document_id) FROM f2) AS u, (SELECT var_pop(m) * count(*) FROM (SELECT avg(v) AS m FROM f2 GROUP BY Reference, Model)) AS st),
y AS (SELECT u, (total - su * 15 - st * u) / ((u - 1) * 14) AS res, su * 15 / (u - 1) AS msu FROM z), x AS (SELECT u, res, greatest(0, (msu - res) / 15) AS vu FROM y)
SELECT u AS units, round(vu, 6)::DOUBLE AS var_unit, round(res, 6)::DOUBLE AS var_residual, round(vu / (vu + res), 6)::DOUBLE AS icc FROM x""")
def random_intercept_icc(spark, sf_dir):
    return inference.balanced_intercept(evaluations(spark, sf_dir), "document_id", ["Reference", "Model"], "OverallScore")


@register()
def random_intercept_unbalanced(spark, sf_dir):
    """The same by REML over all rows, documents with holes among them."""
    return mixed.random_intercept(evaluations(spark, sf_dir), "document_id", ["Reference", "Model"], "OverallScore")


@register()
def family_contrast_mixed(spark, sf_dir):
    found = mixed.family_contrast(evaluations(spark, sf_dir), "document_id", "Reference", "Model", "same_family", "OverallScore")
    return inference.with_p(found, "normal", "z")


# Predictions ------------------------------------------------------------------------------------

_SOFTMAX = "WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), p AS (SELECT *, 1 / (1 + exp(b - a)) AS pd, CASE WHEN a >= b THEN 0 ELSE 1 END AS idx FROM e)"


def predicted(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"))
    return predictions.predict_from_scores(rows, ["a", "b"])


@register(f"{_SOFTMAX} SELECT vec_id, idx::INT AS predicted_class_idx, CASE idx WHEN 0 THEN 'diagram' ELSE 'general' END AS predicted_class_en, CASE idx WHEN 0 THEN '설계도' ELSE '일반' END AS predicted_class_ko, round(greatest(pd, 1 - pd), 6) AS confidence, round(pd, 6) AS prob_diagram, round(1 - pd, 6) AS prob_general, '' AS error FROM p")
def predict_from_scores(spark, sf_dir):
    return predicted(spark, sf_dir).select("vec_id", "predicted_class_idx", "predicted_class_en", "predicted_class_ko", "confidence", "prob_diagram", "prob_general", "error")


@register(f"{_SOFTMAX} SELECT label % 2 AS actual, count(*) FILTER (idx = 0) AS \"0\", count(*) FILTER (idx = 1) AS \"1\" FROM p GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return predictions.confusion_matrix(predicted(spark, sf_dir).withColumn("actual", F.col("label") % 2), "actual", "predicted_class_idx", [0, 1])


@register(f"""{_SOFTMAX}, c AS (SELECT label % 2 AS a, idx AS p, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT x.c AS class, coalesce(sum(n) FILTER (a = x.c), 0) AS support, coalesce(sum(n) FILTER (p = x.c), 0) AS chosen, coalesce(sum(n) FILTER (a = x.c AND p = x.c), 0) AS hit FROM c, (SELECT unnest([0, 1]) AS c) x GROUP BY x.c),
q AS (SELECT class, support, hit, coalesce(hit / nullif(chosen, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM k), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q)
SELECT class::VARCHAR AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f""")
def classification_report(spark, sf_dir):
    return predictions.classification_report(predicted(spark, sf_dir).withColumn("actual", F.col("label") % 2), "actual", "predicted_class_idx")


@register("SELECT label AS document, min_by(vec_id, (-embedding[1], vec_id)) AS image, round(max(embedding[1])::DOUBLE, 6) AS probability FROM embeddings GROUP BY label")
def best_image_per_document(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("document"), F.col("vec_id").alias("image"), F.get("embedding", F.lit(0)).cast("double").alias("probability"))
    return predictions.best_image(rows, "document", "image", "probability")


_FOLDER = "CASE doc_id % 4 WHEN 0 THEN '1_block/' WHEN 1 THEN '2_flow/' WHEN 2 THEN '3_photo/' ELSE 'misc/' END"


@register("SELECT CASE WHEN doc_id % 4 IN (0, 1) THEN 0 WHEN doc_id % 4 = 2 THEN 1 END AS label, count(*) AS n FROM documents GROUP BY 1")
def labelled_listing(spark, sf_dir):
    path = F.concat(F.expr(_FOLDER), F.col("doc_id"), F.lit(".png"))
    return table(spark, sf_dir, "documents").select(predictions.label_from_folder(path).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@register("SELECT doc_id, 'doc' || (doc_id // 20) AS document_folder, doc_id || '.PNG' AS image_relative_path FROM documents WHERE doc_id % 4 <> 3")
def image_listing(spark, sf_dir):
    name = F.concat(F.lit("/data/doc"), F.floor(F.col("doc_id") / 20), F.lit("/extracted_images/"), F.col("doc_id"), F.when(F.col("doc_id") % 4 == 3, ".txt").otherwise(".PNG"))
    return sources.image_keys(table(spark, sf_dir, "documents").select("doc_id", name.alias("path"))).drop("path")


@register("""SELECT doc_id, quality, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id || '-42'), 1, 15))::BIGINT) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'validation' END AS part FROM labels""")
def split_80_20(spark, sf_dir):
    return predictions.split_80_20(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


# The study end to end ---------------------------------------------------------------------------


def study(spark, sf_dir):
    """The similarity table of the real metrics, with names, types and scores; the vector metrics are the caller's and absent."""
    table_ = similarity_table(spark, sf_dir).withColumns({m: F.lit(0.5) for m in scores.SEMANTIC})
    return jobs.evaluation_frame(table_.withColumn("overall_score", scores.pair_score(list(scores.METRICS))), {(r, c): f for r, c, f in FAMILIES})


@register()
def study_leniency(spark, sf_dir):
    """Real metrics of all pairs into the statistics: how lenient each reference is, and how it tells models apart."""
    return scores.leniency(kept(study(spark, sf_dir).select("Reference", "Model", "OverallScore")))


@register()
def study_family_gaps(spark, sf_dir):
    """Real metrics of all pairs into the gaps of the families."""
    return family.family_gaps(kept(study(spark, sf_dir).select("document_id", "Reference", "Model", "OverallScore")), FAMILIES)


# Batch scoring, order and names --------------------------------------------------------------------

#: A linear model of two classes that refuses vectors whose first component is large.
WEIGHTS = [[((7 * i + 3 * c) % 11 - 5) / 10 for c in range(2)] for i in range(64)]
LARGEST = 0.25


def linear_model(spark: SparkSession):
    """Makes the model in each worker from weights that are broadcast once."""
    held = spark.sparkContext.broadcast(WEIGHTS)

    def make():
        weights = np.array(held.value)

        def model(x):
            if (x[:, 0] > LARGEST).any():
                raise ValueError("out of range")
            return x.astype(np.float64) @ weights

        return model

    return make


def _linear(c: int) -> str:
    return f"list_dot_product(v, {[w[c] for w in WEIGHTS]}::DOUBLE[])"


@register(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN embedding IS NULL OR len(embedding) <> 64 OR vec_id % 50 = 7 THEN 'no vector' WHEN embedding[1] > {LARGEST} THEN 'out of range' ELSE '' END AS error FROM embeddings),
s AS (SELECT vec_id, error, CASE WHEN error = '' THEN {_linear(0)} END AS a, CASE WHEN error = '' THEN {_linear(1)} END AS b FROM e)
SELECT vec_id, error, round(a, 6) AS a, round(b, 6) AS b, CASE WHEN a >= b THEN 0 WHEN a < b THEN 1 END AS predicted_class_idx, round(1 / (1 + exp(b - a)), 6) AS prob_diagram, round(1 - 1 / (1 + exp(b - a)), 6) AS prob_general FROM s""")
def batch_scores(spark, sf_dir):
    """Every vector through a model in batches; vectors that are missing or that the model refuses keep their error."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 50 != 7, F.col("embedding")).alias("embedding"))
    scored_rows = predictions.score_rows(rows, "embedding", 64, linear_model(spark))
    both = scored_rows.select("vec_id", F.col("error").alias("why"), F.get("scores", F.lit(0)).alias("a"), F.get("scores", F.lit(1)).alias("b"))
    return predictions.predict_from_scores(both, ["a", "b"]).select("vec_id", F.col("why").alias("error"), "a", "b", "predicted_class_idx", "prob_diagram", "prob_general")


#: Registered models, in order; a corpus holds others as well.
REGISTRY = [("src6", "Six", 1), ("src2", "Two", 2), ("src7", "Seven", 3), ("src0", "Zero", 4), ("src99", "None", 5)]
WANTED = ["src3", "src2", "src3", "src99", "src6"]


@register(f"""WITH {GRID}, r(model, label, position) AS (VALUES {', '.join(map(str, REGISTRY))}), w(model, position) AS (VALUES {', '.join(f"('{m}', {i})" for i, m in enumerate(dict.fromkeys(WANTED)))}), m AS (SELECT model, count(*) AS texts FROM g GROUP BY model)
SELECT 'all' AS listing, m.model, coalesce(r.label, m.model) AS label, row_number() OVER (ORDER BY r.position NULLS LAST, m.model)::INT AS place, texts FROM m LEFT JOIN r ON r.model = m.model
UNION ALL SELECT 'wanted', m.model, coalesce(r.label, m.model), row_number() OVER (ORDER BY w.position)::INT, texts FROM m JOIN w ON w.model = m.model LEFT JOIN r ON r.model = m.model""")
def ordered_models(spark, sf_dir):
    """The models of the corpus by the registry, unknown ones last, and those of a request in its order."""
    docs = grid(spark, sf_dir)
    registry = spark.createDataFrame(REGISTRY, "token string, label string, position int")
    texts = docs.groupBy("model").agg(F.count("*").alias("texts"))
    listings = [pairs.ordered_models(docs, registry, w).select(F.lit(n).alias("listing"), "model", "label", "place") for n, w in (("all", None), ("wanted", WANTED))]
    return listings[0].union(listings[1]).join(texts, "model")


@register(r"""WITH s AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/.]*)(\.[^/]*)?$', 1) AS image FROM pages),
t AS (SELECT page_id, host, CASE WHEN starts_with(image, host) THEN image ELSE host || '_' || image END AS stem FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY host, lower(stem) ORDER BY page_id) AS n FROM t),
u AS (SELECT page_id, host, stem, n, CASE WHEN n = 1 THEN stem ELSE stem || '_' || n END AS u FROM n)
SELECT page_id, stem, CASE WHEN n > 1 AND EXISTS (SELECT 1 FROM t WHERE t.host = u.host AND lower(t.stem) = lower(u.u)) THEN stem || '__' || n ELSE u END AS "unique" FROM u""")
def numbered_stems(spark, sf_dir):
    """Page names joined with their hosts', and numbered where they repeat."""
    image = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"([^/.]*)(\.[^/]*)?$", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), image.alias("image"))
    stems = rows.select("page_id", "host", names.unique_stem(F.col("host"), F.col("image")).alias("stem"))
    return names.numbered_stems(stems, ["host"], "stem", "page_id").select("page_id", "stem", "unique")


# Readers and writers: what was written is read back -------------------------------------------------

_HANGUL = "translate(regexp_replace(regexp_replace({}, '[^\\x20-\\x7E]', ' ', 'g'), '[|\\\\\"]', '', 'g'), 'aeiou', '가나다라마')"


@register(rf"""WITH {GRID} SELECT 'PAT-' || first AS document_id, CASE WHEN first // {pairs.GRID_MODELS} % 2 = 0 THEN 'gemma' ELSE 'qwen' END AS model, 'ADR' AS doc_type,
length(rtrim(t))::INT AS chars, md5(rtrim(t)) AS digest FROM (SELECT min(doc_id) AS first, '글 ' || string_agg({_HANGUL.format('text')}, ' ' ORDER BY doc_id) AS t FROM g GROUP BY document_id)""")
def corpus_round_trip(spark, sf_dir):
    """A file for each source document, each model's text in it, every other file in the Korean code page, read as a corpus."""
    hangul = F.translate(F.regexp_replace(F.regexp_replace("text", "[^\x20-\x7E]", " "), '[|\\"]', ""), "aeiou", "가나다라마")
    texts = F.array_sort(F.collect_list(F.struct("doc_id", hangul.alias("t"))))
    files = grid(spark, sf_dir).groupBy("document_id").agg(F.min("doc_id").alias("first"), F.concat_ws(" ", F.lit("글"), F.transform(texts, lambda x: x["t"])).alias("text"))
    even = F.floor(F.col("first") / pairs.GRID_MODELS) % 2 == 0
    named = files.select(F.concat(F.lit("PAT-"), "first", F.when(even, "_gemma").otherwise("_qwen"), F.lit("_ADR.md")).alias("name"), "text", even.alias("even"))
    path = scratch_folder(spark, "corpus")
    sources.write_texts(named.where("even"), path)
    sources.write_texts(named.where("not even"), path, "cp949")
    back = sources.read_corpus(spark, path, in_folders=True)
    text = F.regexp_replace("text", "\n$", "")
    return back.select("document_id", "model", "doc_type", F.length(text).alias("chars"), F.md5(F.encode(text, "UTF-8")).alias("digest"))


@register(f"""{EV} SELECT document_id, Reference AS reference_model, Model AS comparison_model, round(rougeL, 6) AS "rougeL", round(CASE WHEN Reference = 'src1' THEN 1 - f1_score ELSE f1_score END, 6) AS f1_score FROM ev""")
def similarity_sink(spark, sf_dir):
    """Written by reference; one reference is written again, and the others stay."""
    rows = evaluations(spark, sf_dir).select("document_id", F.col("Reference").alias("reference_model"), F.col("Model").alias("comparison_model"), "rougeL", "f1_score")
    path = scratch_folder(spark, "similarity")
    sources.write_similarity(rows, path)
    sources.write_similarity(rows.where("reference_model = 'src1'").withColumn("f1_score", 1 - F.col("f1_score")), path, again=True)
    return spark.read.parquet(path).select(rows.columns)


@register(f"""{EV} SELECT document_id, Reference AS reference_model, Model AS comparison_model, round(f1_score, 6) AS f1_score, round(bertscore, 6) AS bertscore FROM ev""")
def evaluation_tables(spark, sf_dir):
    """A CSV table for each reference, of which one does not name its reference, read as one."""
    rows = evaluations(spark, sf_dir).select("document_id", F.col("Reference").alias("reference_model"), F.col("Model").alias("comparison_model"), F.round("f1_score", 6).alias("f1_score"), F.round("bertscore", 6).alias("bertscore"))
    path = scratch_folder(spark, "evaluations")
    for r in REFERENCES:
        own = rows.where(F.col("reference_model") == r)
        sources.write_evaluations(own.withColumn("reference_model", F.lit(None).cast("string")) if r == "src2" else own, path, r)
    return sources.read_evaluations(spark, path, rows.schema)


@register(rf"WITH {GRID} SELECT document_id, model, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))::INT AS output_words FROM g")
def word_count_sink(spark, sf_dir):
    rows = grid(spark, sf_dir).select("document_id", "model", names.count_words(F.col("text")).cast("int").alias("output_words"))
    sources.write_word_counts(rows, path := scratch_folder(spark, "words"))
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@register(f"{_SOFTMAX} SELECT vec_id, idx::INT AS predicted_class_idx, CASE idx WHEN 0 THEN '설계도' ELSE '일반' END AS predicted_class_ko, round(greatest(pd, 1 - pd), 6)::DECIMAL(10, 6)::VARCHAR AS confidence, round(pd, 6)::DECIMAL(10, 6)::VARCHAR AS prob_diagram FROM p")
def prediction_sink(spark, sf_dir):
    sources.write_predictions(predicted(spark, sf_dir).select("vec_id", "predicted_class_idx", "predicted_class_ko", "confidence", "prob_diagram"), path := scratch_folder(spark, "predictions"))
    return spark.read.option("header", True).schema("vec_id long, predicted_class_idx int, predicted_class_ko string, confidence string, prob_diagram string").csv(path)


@register(f"{EV} SELECT 'means' AS part, Model AS name, round(avg(OverallScore), 6)::DOUBLE AS value FROM ev GROUP BY Model UNION ALL SELECT 'references', Reference, round(avg(OverallScore), 6)::DOUBLE FROM ev GROUP BY Reference")
def report_sink(spark, sf_dir):
    """Two tables of a report, each in its folder, read back together."""
    rows = scored(spark, sf_dir)
    tables = {"means": rows.groupBy(F.col("Model").alias("name")).agg(F.avg("OverallScore").alias("value")), "references": rows.groupBy(F.col("Reference").alias("name")).agg(F.avg("OverallScore").alias("value"))}
    sources.write_report(tables, path := scratch_folder(spark, "report"))
    return spark.read.parquet(f"{path}/means").select(F.lit("means").alias("part"), "name", "value").union(spark.read.parquet(f"{path}/references").select(F.lit("references").alias("part"), "name", "value"))
