"""Prediction tables: class probabilities, labelled listings, splits and reports."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.operators.ranks import average_rank

# The two classes.
CLASSES_EN = ("diagram", "general")
CLASSES_KO = ("설계도", "일반")


def predict_from_scores(rows: DataFrame, scores: list[str]) -> DataFrame:
    """Softmax of class scores, the first largest class, its confidence and labels; rows without scores keep an error."""
    values = F.array(*(F.col(c).cast("double") for c in scores))
    top = F.array_max(values)
    raw = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v))
    out = rows.withColumn("__p", F.when(~bad, F.transform(raw, lambda v: v / total)))
    index = (F.array_position("__p", F.array_max("__p")) - 1).cast("int")
    out = out.withColumn("predicted_class_idx", index)
    label = lambda names: F.get(F.array(*map(F.lit, names)), F.col("predicted_class_idx"))
    return out.withColumns({
        "predicted_class_ko": label(CLASSES_KO), "predicted_class_en": label(CLASSES_EN), "confidence": F.array_max("__p"),
        "prob_diagram": F.get("__p", F.lit(0)), "prob_general": F.get("__p", F.lit(1)), "error": F.when(F.col("__p").isNull(), "no score").otherwise(""),
    }).drop("__p")


def score_rows(rows: DataFrame, vector: str, width: int, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], classes: int = 2, batch_size: int = 1024) -> DataFrame:
    """``rows`` with ``scores array<double>`` and ``error``: a caller's model applied to batches of vectors.

    ``make_model`` is called once in each worker and returns a function from
    ``(n, width)`` to ``(n, classes)``; weights belong in a broadcast that it reads.
    Vectors that are null, of another width or hold nulls never reach the model. If a
    batch fails, its rows are tried one by one, and only those that fail keep an error.
    """

    def make() -> Callable:
        model = make_model()

        def predict(vectors: np.ndarray) -> dict[str, np.ndarray]:
            errors = np.full(len(vectors), "", dtype=object)
            try:
                return {"scores": np.asarray(model(vectors), dtype=np.float64), "error": errors}
            except Exception:
                scores = np.zeros((len(vectors), classes))
                for i in range(len(vectors)):
                    try:
                        scores[i] = np.asarray(model(vectors[i : i + 1]), dtype=np.float64)[0]
                    except Exception as e:
                        errors[i] = str(e) or type(e).__name__
                return {"scores": scores, "error": errors}

        return predict

    run = predict_batch_udf(make, return_type=T.StructType([T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())]), batch_size=batch_size, input_tensor_shapes=[[width]])
    values = F.col(vector).cast("array<double>")
    whole = F.coalesce((F.size(values) == width) & ~F.exists(values, lambda x: x.isNull()), F.lit(False))
    done = rows.withColumn("__s", run(F.when(whole, values).otherwise(F.array_repeat(F.lit(0.0), width))))
    error = F.when(~whole, "no vector").otherwise(F.col("__s.error"))
    return done.withColumns({"error": error, "scores": F.when(error == "", F.col("__s.scores"))}).drop("__s")


def label_from_folder(path: Column) -> Column:
    """Class 0 for folders named ``1_…`` or ``2_…``, 1 for ``3_…``, else null."""
    folder = F.regexp_extract(path, r"(?:^|/)([123])_[^/]*/[^/]*$", 1)
    return F.when(folder.isin("1", "2"), 0).when(folder == "3", 1)


def split_80_20(rows: DataFrame, key: str, seed: int = 42, share: float = 0.8) -> DataFrame:
    """``part``: the first ⌊0.8 n⌋ rows in the order of a seeded digest of the key train, the rest validate."""
    hashed = rows.withColumn("__h", F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long"))
    ranked = average_rank(hashed, "__h", name="__r").crossJoin(F.broadcast(rows.agg(F.count("*").alias("__n"))))
    return ranked.withColumn("part", F.when(F.col("__r") <= F.floor(F.col("__n") * share), "train").otherwise("validation")).drop("__h", "__r", "__n")


def confusion_matrix(rows: DataFrame, actual: str, predicted: str, classes: list[int]) -> DataFrame:
    return rows.groupBy(actual).pivot(predicted, classes).count().na.fill(0)


def classification_report(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means."""
    counts = rows.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    # A few rows from here on: one for each pair of classes.
    each = counts.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen"), F.lit(0).cast("long").alias("hit")))).alias("e"))
    per = each.select("e.*").groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "chosen", "hit")))
    precision, recall = F.coalesce(F.try_divide("hit", "chosen"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    per = per.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    scores = ["precision", "recall", "f1"]
    rows_ = per.select(F.col("class").cast("string").alias("label"), *scores, "support")
    macro = per.agg(F.lit("macro avg").alias("label"), *(F.avg(s).alias(s) for s in scores), F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"), *((F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores), F.sum("support").alias("support"))
    accuracy = per.agg(F.lit("accuracy").alias("label"), *((F.sum("hit") / F.sum("support")).alias(s) for s in scores), F.sum("support").alias("support"))
    return rows_.union(accuracy).union(macro).union(weighted)


def best_image(rows: DataFrame, document: str, image: str, probability: str) -> DataFrame:
    """Per document the image of highest probability, of equal ones the smallest name; rows without a probability do not count."""
    good = rows.where(F.col(probability).isNotNull() & ~F.isnan(probability))
    return good.groupBy(document).agg(F.min(F.struct((-F.col(probability)).alias("m"), F.col(image).alias("image"))).alias("b")).select(document, F.col("b.image").alias(image), (-F.col("b.m")).alias(probability))
