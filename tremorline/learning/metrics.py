"""Class weights and evaluation from label and prediction counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: n / (classes * n_class)."""
    everything = Window.partitionBy(F.lit(0))  # one row per class
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.select(label, weight.alias("weight"))


def with_weights(df: DataFrame, label: str = "label", weights: DataFrame | None = None) -> DataFrame:
    """Add ``weight``; a class without one in ``weights`` counts as it is."""
    given = class_weights(df, label) if weights is None else weights
    return df.join(given, label, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def confusion_counts(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    predictions: DataFrame, classes: list[int], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    counts = confusion_counts(predictions, label, prediction)
    wide = counts.groupBy(F.col("label").alias("actual")).agg(
        *[F.sum(F.when(F.col("prediction") == k, F.col("n")).otherwise(0)).alias(f"predicted_{k}") for k in classes]
    )
    return wide


def classification_report(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted averages: (name, precision, recall,
    f1, support). All of it follows from the confusion counts."""
    counts = confusion_counts(predictions, label, prediction)
    actual, guessed, n = F.col("label"), F.col("prediction"), F.col("n")
    sides = F.array(
        F.struct(actual.alias("k"), n.alias("support"), F.lit(0).cast("bigint").alias("guesses"),
                 F.when(actual == guessed, n).otherwise(0).alias("hits")),
        F.struct(guessed.alias("k"), F.lit(0).cast("bigint").alias("support"), n.alias("guesses"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    per_class = counts.select(F.inline(sides)).groupBy("k").agg(
        F.sum("support").alias("support"), F.sum("guesses").alias("guesses"), F.sum("hits").alias("hits")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("hits", "guesses"), zero)
    recall = F.coalesce(F.try_divide("hits", "support"), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("guesses") + F.col("support")), zero)
    rows = per_class.select(
        F.col("k").cast("string").alias("name"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        "support", "hits",
    )
    weight = F.col("support") / F.sum("support").over(Window.partitionBy(F.lit(0)))  # one row per class
    weighted = rows.withColumn("_w", weight)
    scores = ("precision", "recall", "f1")
    summary = weighted.agg(
        F.sum("support").alias("support"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[F.sum(F.col(s) * F.col("_w")).alias(f"weighted_{s}") for s in scores],
    )
    blocks = F.array(
        F.struct(F.lit("accuracy").alias("name"), *[F.col("accuracy").alias(s) for s in scores]),
        *[F.struct(F.lit(f"{a} avg").alias("name"), *[F.col(f"{a}_{s}").alias(s) for s in scores]) for a in ("macro", "weighted")],
    )
    totals = summary.select("support", F.inline(blocks)).select("name", *scores, "support")
    return rows.select("name", *scores, "support").unionByName(totals)


def accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)
    return predictions.agg(F.avg(hit).alias("accuracy"))
