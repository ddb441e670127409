"""Class-weighted random forests: fitting, grid search, domain adaptation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.learning.metrics import class_weights, with_weights
from tremorline.operators.indexing import index_series, quoted

# The searched ranges of the forest's parameters.
DEPTHS = tuple(range(5, 9))
FEATURE_SHARES = ("sqrt", "log2")
LEAF_ROWS = tuple(range(8, 13))
TREES = tuple(range(140, 734))
FOLDS = 5


def as_vectors(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``features``: the columns as one vector. A missing value is an error."""
    missing = F.raise_error(F.lit("missing feature value")).cast("double")
    cells = [F.coalesce(quoted(c).cast("double"), missing) for c in columns]
    return matrix.withColumn("features", array_to_vector(F.array(*cells)))


def forest(trees: int = 100, depth: int = 5, features: str = "sqrt", leaf_rows: int = 1, seed: int = 9, bootstrap: bool = False) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol="_label",
        featuresCol="features",
        predictionCol="_prediction",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy=features,
        minInstancesPerNode=leaf_rows,
        bootstrap=bootstrap,
        seed=seed,
    )


def _ready(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Classes 1, 2, ... as the zero-based labels the learner expects, with class weights."""
    return with_weights(df, weights=weights).withColumn("_label", (F.col("label") - 1).cast("double"))


def fit(df: DataFrame, learner: RandomForestClassifier | None = None, weights: DataFrame | None = None) -> Model:
    """Fit on (features, label); classes start at 1. ``weights`` (label, weight) default to
    the balanced weights of ``df``."""
    return (learner or forest()).fit(_ready(df, weights))


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Add ``prediction`` in the original classes."""
    scored = model.transform(df)
    extra = [c for c in ("rawPrediction", "probability", "_prediction") if c in scored.columns]
    return scored.withColumn("prediction", (F.col("_prediction") + 1).cast("int")).drop(*extra)


def with_folds(df: DataFrame, key: str, folds: int = FOLDS) -> DataFrame:
    """``fold``: rows of each class dealt out in turn by key, so folds have equal class shares."""
    numbered = index_series(df, ("label",), key, ())
    return numbered.rows.select(*map(quoted, df.columns), (F.col("pos") % folds).cast("int").alias("fold"))


def grid(
    learner: RandomForestClassifier,
    depths: Iterable[int],
    feature_shares: Iterable[str],
    leaf_rows: Iterable[int],
    trees: Iterable[int],
) -> list:
    """All combinations of the given ranges, each of which is fitted once a fold: the full
    ranges above make 23,760 settings. The minimum rows to split has no counterpart in the
    learner."""
    return (
        ParamGridBuilder()
        .addGrid(learner.maxDepth, list(depths))
        .addGrid(learner.featureSubsetStrategy, list(feature_shares))
        .addGrid(learner.minInstancesPerNode, list(leaf_rows))
        .addGrid(learner.numTrees, list(trees))
        .build()
    )


def search(df: DataFrame, key: str, params: list, learner: RandomForestClassifier, folds: int = FOLDS, parallelism: int = 4) -> CrossValidatorModel:
    """Cross-validated grid search on weighted F1; the best setting is refitted on all rows."""
    weighted = _ready(df)
    ready = with_folds(weighted, key, folds)
    validator = CrossValidator(
        estimator=learner,
        estimatorParamMaps=params,
        evaluator=MulticlassClassificationEvaluator(labelCol="_label", predictionCol="_prediction", metricName="f1"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    return validator.fit(ready)


def best_params(model: CrossValidatorModel) -> dict[str, object]:
    """Setting with the highest mean score, and the score itself."""
    best = max(range(len(model.avgMetrics)), key=lambda i: model.avgMetrics[i])
    chosen = {param.name: value for param, value in model.getEstimatorParamMaps()[best].items()}
    return {**chosen, "score": model.avgMetrics[best]}


def augment(df: DataFrame, columns: list[str], domain: str) -> DataFrame:
    """Source rows become (x, 0, x), target rows (0, x, x), as ``<column>__source``,
    ``__target`` and ``__shared``."""
    if domain not in ("source", "target"):
        raise ValueError("domain is 'source' or 'target'")

    def part(name: str) -> list[Column]:
        kept = name in (domain, "shared")
        return [(quoted(c) if kept else F.lit(0.0)).cast("double").alias(f"{c}__{name}") for c in columns]

    others = [quoted(c) for c in df.columns if c not in columns]
    return df.select(*others, *part("source"), *part("target"), *part("shared"))


def augmented_columns(columns: list[str]) -> list[str]:
    return [f"{c}__{part}" for part in ("source", "target", "shared") for c in columns]


def fit_adapted(
    source: DataFrame, target: DataFrame, columns: list[str], learner: RandomForestClassifier | None = None
) -> Model:
    """Fit on source and target rows in the augmented layout, with the class weights of the
    source."""
    both = augment(source, columns, "source").unionByName(augment(target, columns, "target"))
    return fit(as_vectors(both, augmented_columns(columns)), learner, class_weights(source))


def predict_adapted(model: Model, target: DataFrame, columns: list[str]) -> DataFrame:
    rows = as_vectors(augment(target, columns, "target"), augmented_columns(columns))
    return predict(model, rows).drop("features")
