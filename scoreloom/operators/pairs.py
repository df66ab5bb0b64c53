"""Corpus rows, duplicates and evaluation pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["document_id", "doc_type"]


#: Consecutive ids of a document table that stand for one source document.
GRID_MODELS = 8


def grid_corpus(docs: DataFrame) -> DataFrame:
    """A document table as a corpus, every row of it: ``GRID_MODELS`` consecutive ids are one source document, and an id's place among them is the model.

    Rows of equal id are numbered, and the second one belongs to a document of its own.
    Only then are texts shuffled; ids are counted first, to see whether one repeats.
    """
    group, place = F.floor(F.col("doc_id") / GRID_MODELS), F.pmod("doc_id", F.lit(GRID_MODELS))
    text = F.coalesce("text", F.lit(""))
    repeats = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy(text)) if repeats else F.lit(1)
    document = F.concat(F.when(group % 2 == 0, "PAT-").otherwise("RPT-"), group, F.when(F.col("__n") > 1, F.concat(F.lit("#"), "__n")).otherwise(""))
    rows = docs.withColumn("__n", again).select("doc_id", document.alias("document_id"), F.concat(F.lit("src"), place).alias("model"), F.lit("ADR").alias("doc_type"), text.alias("text"))
    return rows.withColumn("path", F.concat_ws("_", "document_id", "model", F.lit("ADR.md"))).select("doc_id", "document_id", "model", "doc_type", "path", "text")


def valid_documents(corpus: DataFrame) -> DataFrame:
    """Rows with all keys and some text."""
    return corpus.where("document_id is not null and model is not null and doc_type is not null").where(F.length(F.regexp_replace("text", r"\s+", "")) > 0)


def mark_duplicates(corpus: DataFrame, order: list[str]) -> DataFrame:
    """``kept`` marks the first row of each document, type and model."""
    w = Window.partitionBy(*KEY, "model").orderBy(*order)
    return corpus.withColumn("kept", F.row_number().over(w) == 1)


def keep_first(corpus: DataFrame, order: list[str]) -> DataFrame:
    return mark_duplicates(corpus, order).where("kept").drop("kept")


def make_pairs(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ordered pairs of different models of a document. Columns other than keys get ``ref_`` and ``cand_``."""
    r = references.select(*KEY, F.col("model").alias("reference_model"), *(F.col(c).alias(f"ref_{c}") for c in references.columns if c not in (*KEY, "model")))
    c = candidates.select(*KEY, F.col("model").alias("comparison_model"), *(F.col(x).alias(f"cand_{x}") for x in candidates.columns if x not in (*KEY, "model")))
    return r.join(c, KEY).where("reference_model <> comparison_model")


def select_models(corpus: DataFrame, models: list[str]) -> DataFrame:
    return corpus.where(F.col("model").isin(models))


def ordered_models(corpus: DataFrame, registry: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``(model, label, place)`` of the models of a corpus: those wanted, in that order and once each, or all, by their position in the registry.

    ``registry`` has ``token, label, position``. Models that it does not know come
    last, by name, and are their own label. A wanted model without a text has no row.
    """
    found = corpus.select("model").where(F.col("model").isNotNull()).distinct()
    known = found.join(registry.select(F.col("token").alias("model"), "label", "position"), "model", "left")
    if wanted is not None:
        order = list(dict.fromkeys(wanted))
        known = select_models(known, order).withColumn("position", F.array_position(F.array(*map(F.lit, order)), F.col("model")))
    # A row a model from here on.
    listed = Window.partitionBy(F.lit(0)).orderBy(F.col("position").asc_nulls_last(), "model")
    return known.select("model", F.coalesce("label", "model").alias("label"), F.row_number().over(listed).alias("place"))
