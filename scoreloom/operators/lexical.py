"""Lexical pair metrics: TF-IDF cosine, vocabulary F1, ROUGE and BLEU."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scoreloom.functions.names import is_valid
from scoreloom.functions.tokens import tokenize_chars, tokenize_rouge, tokenize_terms
from scoreloom.operators.pairs import KEY, select_models
from scoreloom.sources.scratch import written

PAIR = [*KEY, "reference_model", "comparison_model"]
DOC = [*KEY, "model"]
#: Fixed: the weights of the four sentence scores, the third as published.
BLEU_WEIGHTS = ((1.0,), (0.5, 0.5), (0.33, 0.33, 0.33), (0.25, 0.25, 0.25, 0.25))
BLEU_EPSILON = 0.1
#: Columns of a strip of the table of common subsequences.
LCS_BITS = 16_384
#: Terms whose hashes and counts, 12 bytes a term, each worker may hold.
HELD_TERMS = 8_000_000


def by_document(corpus: DataFrame, references: list[str], candidates: list[str], made: dict[str, Column | Callable[[Column], Column]], prepare, compare, result: list[T.StructField]) -> DataFrame:
    """``(*PAIR, *result)``: ``compare`` of what ``prepare`` makes of the two texts of every ordered pair of different models.

    Texts are dealt by document, and only there turned into the columns ``made``: a
    function is given the text, a plain column is dealt as it is. Tokens and grams take
    many times a text's room and are never shuffled, and metrics of one corpus share
    one exchange of texts.
    """
    wanted = select_models(corpus, sorted({*references, *candidates})).dropna(subset=KEY)
    given = {n: c for n, c in made.items() if isinstance(c, Column)}
    dealt = wanted.select(*DOC, *(["text"] if len(given) < len(made) else []), *(c.alias(n) for n, c in given.items())).repartition(*KEY)
    # Ordered while they are texts.
    rows = dealt.sortWithinPartitions(*KEY).select(*DOC, *(F.col(n) if n in given else c(F.col("text")).alias(n) for n, c in made.items()))
    kinds = T.StructType([*(rows.schema[c] for c in KEY), T.StructField("reference_model", T.StringType()), T.StructField("comparison_model", T.StringType()), *result])
    arrow = to_arrow_schema(kinds)
    left, right, names = frozenset(references), frozenset(candidates), list(made)

    def pairs_of(texts: pa.Table) -> pa.Table:
        models = texts["model"].to_pylist()
        own = [prepare(*x) for x in zip(*(texts[n] for n in names), strict=True)]
        at = [(i, j) for i, r in enumerate(models) if r in left for j, c in enumerate(models) if c in right and r != c]
        values = [(models[i], models[j], *compare(own[i], own[j])) for i, j in at]
        keys = [[texts[c][0].as_py()] * len(at) for c in KEY]
        columns = [*keys, *(zip(*values, strict=True) if values else [[]] * (len(arrow) - len(KEY)))]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.groupBy(*KEY).applyInArrow(pairs_of, kinds)


def _numbers(x: pa.ListScalar) -> np.ndarray | None:
    return x.values.to_numpy() if x.is_valid else None


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _term_hashes(text: Column) -> Column:
    return _hashes(tokenize_terms(text))


def tfidf_fit(corpus: DataFrame) -> tuple[DataFrame, int]:
    """``(key, df)`` by term hash, and the number of documents of enough text, over which ``df`` counts.

    A term that is missing has one such document, or is in short documents only; terms
    of short documents are listed whenever they are counted at all.
    """
    fits = is_valid(F.col("text"))
    # Made before they are exploded, or each term's row would ask its text again.
    own = corpus.select(fits.alias("fits"), F.array_distinct(_term_hashes(F.col("text"))).alias("keys"))
    each = own.select("fits", F.explode("keys").alias("key"))
    counted = each.groupBy("key").agg(F.sum(F.col("fits").cast("int")).alias("df"), F.min("fits").alias("fits")).where(F.col("df") > F.col("fits").cast("int")).select("key", F.col("df").cast("int").alias("df"))
    return written(counted, "terms"), corpus.where(fits).count()


def _idf(df, documents: int):
    return np.log((1 + documents) / (1 + df)) + 1


def _vector(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys, weights / (np.sqrt(weights @ weights) or 1.0)


def _dot(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray] | None) -> tuple[float]:
    """Dot product of sparse vectors, whose keys are sorted; 0 where one is missing."""
    if a is None or b is None:
        return (0.0,)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return (float(a[1][i] @ b[1][j]),)


_SIMILARITY = [T.StructField("tfidf_similarity", T.DoubleType())]


def tfidf_similarity(corpus: DataFrame, references: list[str], candidates: list[str]) -> DataFrame:
    """Cosine of every ordered pair; 0 without a common term. Documents too short to fit still take part.

    Each worker holds the counts of the terms of more than one document, while they are
    at most ``HELD_TERMS``; beyond that the terms of all texts are shuffled to them.
    """
    counted, documents = tfidf_fit(corpus)
    if counted.count() > HELD_TERMS:
        return _tfidf_of_many_terms(corpus, references, candidates, counted, documents)
    table = counted.toArrow()
    keys, df = table["key"].to_numpy(), table["df"].to_numpy()
    order = np.argsort(keys)
    held = corpus.sparkSession.sparkContext.broadcast((keys[order], df[order].astype(np.int32)))

    def prepare(terms: pa.ListScalar, fits: pa.BooleanScalar):
        if not terms.is_valid:
            return None
        own, n = np.unique(_numbers(terms), return_counts=True)
        known, counts = held.value
        at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        found = known[at] == own if len(known) else np.zeros(len(own), bool)
        own_df = np.where(found, counts[at] if len(known) else 1, 1)
        if not fits.as_py():
            own, n, own_df = own[found], n[found], own_df[found]
        return _vector(own, n * _idf(own_df, documents))

    return by_document(corpus, references, candidates, {"terms": _term_hashes, "fits": is_valid}, prepare, _dot, _SIMILARITY)


def _tfidf_of_many_terms(corpus: DataFrame, references: list[str], candidates: list[str], counted: DataFrame, documents: int) -> DataFrame:
    """The same by a shuffled join of terms and counts."""
    text = F.col("text")
    wanted = select_models(corpus, sorted({*references, *candidates})).dropna(subset=KEY).select(*DOC, F.monotonically_increasing_id().alias("id"), "text")
    wanted = written(wanted, "texts")
    each = wanted.select("id", is_valid(text).alias("fits"), _term_hashes(text).alias("keys")).select("id", "fits", F.explode("keys").alias("key")).groupBy("id", "fits", "key").agg(F.count("*").alias("n"))
    known = each.join(counted, "key", "left").where("fits or df is not null").select("id", "key", F.col("n") * (F.log((1 + F.lit(documents)) / (1 + F.coalesce("df", F.lit(1)))) + 1))
    weighted = known.toDF("id", "key", "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("key", "w"))).alias("v")).select("id", F.col("v.key").alias("keys"), F.col("v.w").alias("weights"))
    rows = wanted.select(*DOC, "id").join(weighted, "id", "left")
    prepare = lambda keys, weights: _vector(_numbers(keys), _numbers(weights)) if keys.is_valid else None
    return by_document(rows, references, candidates, {c: F.col(c) for c in ("keys", "weights")}, prepare, _dot, _SIMILARITY)


def vocab_overlap_f1(corpus: DataFrame, references: list[str], candidates: list[str]) -> DataFrame:
    """2·|A∩B| / (|A|+|B|) over distinct terms; 0 if a text is too short or nothing is shared."""
    terms = lambda text: F.when(is_valid(text), F.array_distinct(_term_hashes(text)))
    prepare = lambda terms: np.sort(_numbers(terms)) if terms.is_valid else np.zeros(0, np.int64)

    def compare(a: np.ndarray, b: np.ndarray) -> tuple[float]:
        return (2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b)) if len(a) and len(b) else 0.0,)

    return by_document(corpus, references, candidates, {"terms": terms}, prepare, compare, [T.StructField("f1_score", T.DoubleType())])


#: Odd factors that tell the places of the tokens of a gram apart.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _gram_counts(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the grams of ``n`` tokens, and how often each occurs."""
    size = max(0, len(codes) - n + 1)
    mixed = np.zeros(size, np.uint64)
    for k in range(n if size else 0):
        mixed = (mixed ^ codes[k : k + size]) * _FACTORS[k]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed, return_counts=True)


def _overlaps(corpus: DataFrame, references: list[str], candidates: list[str], tokens: Column | Callable[[Column], Column], orders: tuple[int, ...]) -> DataFrame:
    """A row per ordered pair: both sides' token counts and ``shared``, the clipped overlap of each order.

    Grams are counted once a text; a document's texts meet as sorted hashes.
    """

    def prepare(codes: pa.ListScalar):
        own = _numbers(codes)
        return None if own is None else len(own), [_gram_counts((np.zeros(0, np.int64) if own is None else own).view(np.uint64), n) for n in orders]

    def compare(a, b):
        counts = []
        for (x, n), (y, m) in zip(a[1], b[1], strict=True):
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            counts.append(int(np.minimum(n[i], m[j]).sum()))
        return a[0], b[0], counts

    codes = _hashes(tokens) if isinstance(tokens, Column) else lambda text: _hashes(tokens(text))
    return by_document(corpus, references, candidates, {"codes": codes}, prepare, compare, [T.StructField("ref_size", T.IntegerType()), T.StructField("cand_size", T.IntegerType()), T.StructField("shared", T.ArrayType(T.LongType()))])


def _ngram_pairs(corpus: DataFrame, references: list[str], candidates: list[str], tokens: Column | Callable[[Column], Column], orders: tuple[int, ...]) -> DataFrame:
    """A row per ordered pair and order: ``overlap`` and both sides' token counts."""
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, orders)).alias("n"), F.col("shared").alias("overlap")))
    return _overlaps(corpus, references, candidates, tokens, orders).select(*PAIR, "ref_size", "cand_size", each.alias("o")).select(*PAIR, "ref_size", "cand_size", F.col("o.n").alias("n"), F.col("o.overlap").alias("overlap"))


def rouge(corpus: DataFrame, references: list[str], candidates: list[str]) -> DataFrame:
    """``rouge1`` and ``rouge2``: F of clipped n-gram recall and precision; 0 if a text is too short."""
    tokens = lambda text: F.when(is_valid(text), tokenize_rouge(text)).otherwise(F.array().cast("array<string>"))
    rows = _overlaps(corpus, references, candidates, tokens, (1, 2))
    grams = lambda side, n: F.greatest(F.col(f"{side}_size") - (n - 1), F.lit(0))
    f = lambda n: F.coalesce(F.try_divide(2.0 * F.col("shared")[n - 1], grams("ref", n) + grams("cand", n)), F.lit(0.0))
    return rows.select(*PAIR, *(f(n).alias(f"rouge{n}") for n in (1, 2)))


_ROUGE_WORD = re.compile("[a-z0-9]+")


def lcs_length(a: list, b: list, width: int = LCS_BITS) -> int:
    """Longest common subsequence, ``width`` columns of the table at a time in the bits of one integer.

    A strip of columns hands the carry of each row to the next strip, so memory is
    the strip's masks and a byte a row, however long the texts.
    """
    carries, unmatched = bytearray(len(b)), 0
    for low in range(0, len(a), width):
        strip = a[low : low + width]
        places: dict = {}
        for i, x in enumerate(strip):
            places[x] = places.get(x, 0) | 1 << i
        size = len(strip)
        full = row = (1 << size) - 1
        for j, y in enumerate(b):
            mask = places.get(y, 0)
            if mask or carries[j]:
                both = row & mask
                total = row + both + carries[j]
                carries[j] = total >> size
                row = (total | row - both) & full
        unmatched += row.bit_count()
    return len(a) - unmatched


def _rouge_words(text: str | None) -> list[str]:
    """None in a text that is too short."""
    return _ROUGE_WORD.findall(text.lower()) if len((text or "").strip()) >= 10 else []


def _rouge_l(a: list[str], b: list[str]) -> float:
    return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


@F.arrow_udf(T.DoubleType())
def rouge_l(references: pa.Array, candidates: pa.Array) -> pa.Array:
    """F of the longest common word subsequence of two texts; 0 if one is too short."""
    return pa.array([_rouge_l(_rouge_words(r), _rouge_words(c)) for r, c in zip(references.to_pylist(), candidates.to_pylist(), strict=True)], pa.float64())


def rouge_l_pairs(corpus: DataFrame, references: list[str], candidates: list[str]) -> DataFrame:
    """``rougeL``: the same of every ordered pair."""
    return by_document(corpus, references, candidates, {"text": lambda text: text}, lambda text: _rouge_words(text.as_py()), lambda a, b: (_rouge_l(a, b),), [T.StructField("rougeL", T.DoubleType())])


def bleu(corpus: DataFrame, references: list[str], candidates: list[str], tokens: Column | None = None) -> DataFrame:
    """Mean of four smoothed sentence scores over characters, or over a token column that the caller supplies."""
    rows = _overlaps(corpus, references, candidates, tokens if tokens is not None else tokenize_chars, (1, 2, 3, 4))
    shared = lambda n: F.col("shared")[n - 1]
    total = lambda n: F.greatest(F.col("cand_size") - (n - 1), F.lit(1))
    precision = lambda n: F.log(F.when(shared(n) == 0, F.lit(BLEU_EPSILON)).otherwise(shared(n)) / total(n))
    penalty = F.when(F.col("cand_size") > F.col("ref_size"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ref_size") / F.col("cand_size")))
    mean = sum(F.exp(sum(w * precision(n) for n, w in enumerate(ws, 1))) for ws in BLEU_WEIGHTS) / len(BLEU_WEIGHTS)
    return rows.select(*PAIR, F.when((shared(1) > 0) & (F.col("cand_size") > 0), penalty * mean).otherwise(0.0).alias("bleu_score"))
