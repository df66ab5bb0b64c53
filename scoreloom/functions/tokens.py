"""Tokens, n-grams and chunks of a text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.names import WORD, strip

CHUNK_CHARS = 1500
_SENTENCE_END = r"[.!?。]\s+|(?<=다\.)\s+|\n+"


def tokenize_chars(text: Column) -> Column:
    """Every character, white space included."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def tokenize_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{2,}}"), F.lit(0))


def tokenize_rouge(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(tokens: Column, n: int, glue: str = " ") -> Column:
    """All runs of ``n`` tokens, joined; none if there are fewer."""
    size = F.size(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.concat_ws(glue, *(F.get(tokens, i + (k - 1)) for k in range(n))))
    return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))


def ngram_counts(docs: DataFrame, keys: list[str], tokens: str, orders: tuple[int, ...], glue: str = " ") -> DataFrame:
    """``(*keys, n, gram, count)``; grams are hashed, so a row stays small whatever the tokens are."""
    each = F.array(*(F.struct(F.lit(n).alias("n"), ngrams(F.col(tokens), n, glue).alias("grams")) for n in orders))
    rows = docs.select(*keys, F.explode(each).alias("o")).select(*keys, "o.n", F.explode("o.grams").alias("g"))
    return rows.groupBy(*keys, "n", F.xxhash64("g").alias("gram")).agg(F.count("*").alias("count"))


def chunk_text(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Paragraphs packed into chunks of up to ``limit`` characters; longer ones are cut and stand alone.

    A fold over the paragraphs: the state holds the finished chunks and the open one.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n+"), strip), lambda p: p != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s, p):
        closed = F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / limit).cast("int") - 1, F.lit(0))), lambda i: F.substring(p, i * limit + 1, F.lit(limit)))
        packed = F.concat(s["open"], F.lit("\n\n"), p)
        return (
            F.when(F.length(p) > limit, F.struct(F.concat(closed, cuts).alias("done"), F.lit("").alias("open")))
            .when(s["open"] == "", F.struct(s["done"].alias("done"), p.alias("open")))
            .when(F.length(packed) > limit, F.struct(closed.alias("done"), p.alias("open")))
            .otherwise(F.struct(s["done"].alias("done"), packed.alias("open")))
        )

    return F.aggregate(paragraphs, state, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def split_sentences(text: Column) -> Column:
    """Sentences, or chunks where a text has none."""
    found = F.filter(F.transform(F.split(text, _SENTENCE_END), strip), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(chunk_text(text))


def align_chunks(a: Column, b: Column) -> Column:
    """Chunks paired by relative position: ``array<struct<a, b, weight>>`` as long as the longer side."""
    n = F.greatest(F.size(a), F.size(b))

    def pair(k):
        left, right = (F.element_at(x, (F.floor(k * F.size(x) / n) + 1).cast("int")) for x in (a, b))
        return F.struct(left.alias("a"), right.alias("b"), F.greatest(F.lit(1.0), (F.length(left) + F.length(right)) / 2).alias("weight"))

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.transform(F.sequence(F.lit(0), n - 1), pair))
