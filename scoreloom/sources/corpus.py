"""Sources and sinks: Markdown corpora, evaluation tables, image listings, reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.names import parse_document_name, strip_front_matter

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff")


@F.arrow_udf(T.StringType())
def _decode_cp949(contents: pa.Array) -> pa.Array:
    return pa.array([None if b is None else b.decode("cp949", "replace") for b in contents.to_pylist()], pa.string())


def decode_text(content: Column) -> Column:
    """UTF-8 without its byte order mark; rows that are not UTF-8 are read as cp949."""
    raw = content.cast("string")
    valid = F.is_valid_utf8(raw)
    utf8 = F.regexp_replace(F.when(valid, raw), "^﻿", "")
    return F.when(valid, utf8).otherwise(_decode_cp949(F.when(~valid, content)))


def read_files(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(path)


def read_corpus(spark: SparkSession, path: str, recursive: bool = False, in_folders: bool = False, **names) -> DataFrame:
    """``(document_id, model, doc_type, path, text)`` of all Markdown files; ``in_folders``: as Spark writes them, a folder ``name=FILE.md`` for each."""
    files = read_files(spark, path, "part-*" if in_folders else "*.md", recursive or in_folders)
    name = F.regexp_extract("path", "/name=([^/]+)/[^/]*$", 1) if in_folders else F.element_at(F.split("path", "/"), -1)
    keys = parse_document_name(name, **names)
    return files.select(keys.alias("k"), "path", strip_front_matter(decode_text(F.col("content"))).alias("text")).select("k.*", "path", "text")


def read_any_text(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of Markdown and plain text files at any depth."""
    return read_files(spark, path, "*.{md,txt,markdown}", True).select("path", decode_text(F.col("content")).alias("text"))


def read_evaluations(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All ``similarity_*_as_reference*`` CSV tables in ``path``, files or folders of parts; the name tells a missing reference."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", "true")
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(f"{path}/similarity_*_as_reference*")
    named = F.regexp_extract(F.col("_metadata.file_path"), "similarity_([^/]+?)_as_reference", 1)
    own = F.col("reference_model") if "reference_model" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("reference_model", F.coalesce(own, named)).dropna(subset=["document_id", "comparison_model"])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, once and at ingest."""
    return df.select(*(F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def image_keys(paths: DataFrame, path_col: str = "path", folder: str = "extracted_images") -> DataFrame:
    """Paths of images below ``folder`` with their document folder and relative path."""
    shape = rf"^(.*/)?([^/]+)/{folder}/(.+)$"
    good = F.lower(path_col).rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$") & F.col(path_col).rlike(shape)
    return paths.where(good).withColumns({"document_folder": F.regexp_extract(path_col, shape, 2), "image_relative_path": F.regexp_extract(path_col, shape, 3)})


def list_images(spark: SparkSession, path: str) -> DataFrame:
    return image_keys(read_files(spark, path, "*", True).select("path"))


def write_similarity(rows: DataFrame, path: str, again: bool = False) -> None:
    """A folder for each reference; ``again`` replaces those of the references in ``rows`` and leaves the others."""
    out = rows.write.partitionBy("reference_model")
    (out.mode("overwrite").option("partitionOverwriteMode", "dynamic") if again else out).parquet(path)


def write_evaluations(rows: DataFrame, path: str, reference: str) -> None:
    """The CSV table of one reference, by the name that ``read_evaluations`` looks for."""
    rows.write.option("header", True).csv(f"{path}/similarity_{reference}_as_reference.csv")


def _one_byte_a_character(charset: str):
    """An Arrow function to the bytes of a text in ``charset``, each as the character of that number."""

    @F.arrow_udf(T.StringType())
    def bytes_of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.encode(charset, "replace").decode("latin-1") for t in texts.to_pylist()], pa.string())

    return bytes_of


def write_texts(rows: DataFrame, path: str, charset: str | None = None) -> None:
    """``(name, text)`` of one line each, a folder for each name; UTF-8, or any charset that Python knows."""
    text = _one_byte_a_character(charset)(F.col("text")) if charset else F.col("text")
    out = rows.select("name", text.alias("text")).write.partitionBy("name").mode("append").option("encoding", "ISO-8859-1" if charset else "UTF-8")
    # One column, written as it is.
    plain = {"quote": "", "emptyValue": "", "escape": "\u0000", "sep": "\u0001", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    out.options(**plain).csv(path)


def write_word_counts(rows: DataFrame, path: str) -> None:
    rows.select("document_id", "model", "output_words").write.option("header", True).csv(path)


def prediction_text(rows: DataFrame) -> DataFrame:
    """Predictions with probabilities as text of six decimals."""
    return rows.withColumns({c: F.format_string("%.6f", c) for c in ("confidence", "prob_diagram", "prob_general") if c in rows.columns})


def write_predictions(rows: DataFrame, path: str) -> None:
    prediction_text(rows).write.option("header", True).option("encoding", "UTF-8").csv(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")


def pending_work(work: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Work without an output, or with an empty one. ``outputs`` has ``key`` and ``length``."""
    return work.join(outputs.where("length > 0"), key, "left_anti")
