"""Structural pair metrics of Markdown texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.markdown import awareness, table_distance, tables, tree, tree_edit_distance
from scoreloom.functions.names import strip_code_fences
from scoreloom.operators.lexical import DOC, PAIR
from scoreloom.operators.pairs import make_pairs, select_models
from scoreloom.sources.scratch import written


def features(corpus: DataFrame) -> DataFrame:
    """Tags, tree and the row widths of all tables, once per document."""
    widths = F.transform(tables(F.col("text")), lambda t: F.transform(t, lambda r: F.size(r)))
    return corpus.select(*DOC, awareness(F.col("text")).alias("tags"), tree(F.col("text")).alias("tree"), widths.alias("tables"))


def with_distance(pairs: DataFrame, left: str, right: str, forms: DataFrame, distance) -> DataFrame:
    """``pairs`` with ``distance`` of what the keys ``left`` and ``right`` stand for; ``forms`` is ``(key, form)``.

    Each two different forms are compared once in the whole cluster, whatever the number
    of pairs that have them and in whichever order; equal ones not at all.
    """
    low, high = F.least(left, right), F.greatest(left, right)
    keyed = pairs.withColumns({"__low": low, "__high": high})
    needed = keyed.where(F.col("__low") != F.col("__high")).select("__low", "__high").distinct()
    one, two = (forms.select(F.col("key").alias(k), F.col("form").alias(f)) for k, f in (("__low", "__one"), ("__high", "__two")))
    compared = needed.join(one, "__low").join(two, "__high").select("__low", "__high", distance(F.col("__one"), F.col("__two")).alias("__d"))
    return keyed.join(compared, ["__low", "__high"], "left").withColumn("distance", F.when(F.col("__low") == F.col("__high"), 0).otherwise(F.col("__d"))).drop("__low", "__high", "__d")


def form_key(form: Column) -> Column:
    return F.md5(F.to_json(F.struct(form.alias("f"))).cast("binary"))


def awareness_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def table_similarity(pairs: DataFrame) -> DataFrame:
    """``(*PAIR, teds_table_structure_similarity)``: best match of every table in both directions.

    Table pairs are rows of their own, so many tables in a document spread out.
    Null without any table, 0 with tables on one side only.
    """
    both = pairs.where((F.size("ref_tables") > 0) & (F.size("cand_tables") > 0))
    cells = both.select(*PAIR, "cand_tables", F.posexplode("ref_tables").alias("i", "x")).select(*PAIR, "i", "x", F.posexplode("cand_tables").alias("j", "y"))
    size = lambda t: F.aggregate(t, F.lit(1), lambda s, w: s + w + 1)
    sized = cells.select(*PAIR, "i", "j", form_key(F.col("x")).alias("x"), form_key(F.col("y")).alias("y"), F.greatest(size(F.col("x")), size(F.col("y"))).alias("size"))
    shown = [both.select(F.explode(c).alias("form")).distinct() for c in ("ref_tables", "cand_tables")]
    forms = shown[0].union(shown[1]).distinct().select(form_key(F.col("form")).alias("key"), "form")
    cells = with_distance(sized, "x", "y", forms, table_distance).withColumn("sim", F.greatest(F.lit(0.0), 1 - F.col("distance") / F.col("size")))
    best = cells.groupBy(*PAIR, "i").agg(F.max("sim").alias("best")).select(*PAIR, "best").union(cells.groupBy(*PAIR, "j").agg(F.max("sim").alias("best")).select(*PAIR, "best"))
    means = best.groupBy(*PAIR).agg(F.avg("best").alias("mean"))
    some = F.size("ref_tables") + F.size("cand_tables")
    return pairs.join(means, PAIR, "left").select(*PAIR, F.when(some == 0, F.lit(None).cast("double")).otherwise(F.coalesce("mean", F.lit(0.0))).alias("teds_table_structure_similarity"))


def overall_structure(awareness_score: Column, document: Column, table: Column) -> Column:
    """40/40/20 of the three, over those that have a value."""
    parts = [(0.40, awareness_score), (0.40, document), (0.20, table)]
    total = sum(F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts)
    return F.try_divide(sum(F.coalesce(c, F.lit(0.0)) * w for w, c in parts), total)


def structure_similarity(corpus: DataFrame, references: list[str], candidates: list[str]) -> DataFrame:
    wanted = written(features(select_models(corpus, sorted({*references, *candidates}))).withColumn("shape", form_key(F.struct("tree.labels", "tree.parents"))), "features")
    light = wanted.select(*DOC, "tags", "shape", F.col("tree.sizes")[0].alias("size"), "tables")
    pairs = make_pairs(select_models(light, references), select_models(light, candidates))
    shapes = wanted.groupBy(F.col("shape").alias("key")).agg(F.any_value("tree").alias("form"))
    trees = with_distance(pairs.select(*PAIR, "ref_shape", "cand_shape", F.greatest("ref_size", "cand_size").alias("size")), "ref_shape", "cand_shape", shapes, tree_edit_distance)
    scored = pairs.select(*PAIR, awareness_similarity(F.col("ref_tags"), F.col("cand_tags")).alias("markdown_awareness_similarity"))
    documents = trees.select(*PAIR, F.greatest(F.lit(0.0), 1 - F.col("distance") / F.col("size")).alias("teds_document_structure_similarity"))
    found = scored.join(documents, PAIR).join(table_similarity(pairs), PAIR)
    return found.withColumn("overall_document_structure_similarity", overall_structure(F.col("markdown_awareness_similarity"), F.col("teds_document_structure_similarity"), F.col("teds_table_structure_similarity")))


def heading_dialects(corpus: DataFrame) -> DataFrame:
    """Per model: documents with hash titles, with underlined titles, and with neither."""
    body = strip_code_fences(F.col("text"))
    atx = F.regexp_count(body, F.lit(r"(?m)^\s*#{1,6}\s+.+$"))
    setext = F.regexp_count(body, F.lit(r"(?m)^(?!\s*(?:#|[-*+]\s|\d+[.)]\s))[^|\n]*[^|\s][^|\n]*\n\s*(?:=+|-{3,})\s*$"))
    flags = corpus.select("model", (atx > 0).cast("int").alias("atx"), (setext > 0).cast("int").alias("setext"))
    return flags.groupBy("model").agg(F.count("*").alias("documents"), F.sum("atx").alias("with_atx"), F.sum("setext").alias("with_setext"), F.sum(F.when((F.col("atx") == 0) & (F.col("setext") == 0), 1).otherwise(0)).alias("with_neither"))


def zero_share(structure: DataFrame, group: list[str]) -> DataFrame:
    """Share of pairs whose document structure score is exactly zero."""
    score = F.col("teds_document_structure_similarity")
    return structure.groupBy(*group).agg(F.avg(F.when(score == 0, 1.0).otherwise(0.0)).alias("zero_share"), F.avg(score).alias("mean_score"))
