"""Forest on the source splits, its evaluation, and its adaptation to the target."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.features.registry import align_columns
from tremorline.learning.forest import as_vectors, fit, fit_adapted, forest, predict, predict_adapted
from tremorline.learning.metrics import accuracy, classification_report, confusion_matrix
from tremorline.learning.nodes import best_setting, nested_search
from tremorline.operators.sampling import subsample
from tremorline.plans.feature_selection import load_matrix
from tremorline.plans.preprocessing import KEYS
from tremorline.session import staging_scope
from tremorline.sources.tables import write_stage

CLASSES = [1, 2, 3]
INDEX = [*KEYS, "end", "time_end", "label"]


def run(
    spark: SparkSession,
    out: str,
    grid_options: dict,
    target_share: float = 1.0,
    learner: RandomForestClassifier | None = None,
) -> dict[str, object]:
    """Grid search on source windows, adaptation with a share of the target windows.

    Writes predictions, confusion matrices and reports; returns the best setting and the
    target accuracies.
    """
    with staging_scope(spark):
        learner = learner or forest()
        train = load_matrix(spark, out, "s_train")
        columns = [c for c in train.columns if c not in INDEX]
        tables = {"s_train": train}
        for split in ("s_test", "t_train", "t_test"):
            tables[split] = align_columns(load_matrix(spark, out, split), train)
        key = F.struct(*[F.col(k) for k in (*KEYS, "end")])
        vectors = as_vectors(train, columns).select(key.alias("_key"), "label", "features")
        best = best_setting(nested_search(vectors, "_key", learner, **grid_options))
        chosen = {"maxDepth": "depth", "featureSubsetStrategy": "feature_share", "minInstancesPerNode": "leaf_rows", "numTrees": "trees"}
        best = {name: best[key] for name, key in chosen.items()} | {"score": best["score"]}
        tuned = learner.copy({learner.getParam(name): value for name, value in best.items() if name != "score"})
        model = fit(vectors, tuned)
        for split in ("s_train", "s_test"):
            _report(predict(model, as_vectors(tables[split], columns)).drop("features"), f"{out}/{split}")
        sample = subsample(tables["t_train"], "id", ("split", "id", "end"), target_share)
        adapted = fit_adapted(train, sample, columns, tuned)
        scores = {}
        for split in ("t_train", "t_test"):
            predictions = predict_adapted(adapted, tables[split], columns).select(*INDEX, "prediction")
            _report(predictions, f"{out}/{split}")
            scores[split] = accuracy(predictions).first()["accuracy"]
        return {"best": best, "accuracy": scores}


def _report(predictions: DataFrame, path: str) -> None:
    write_stage(predictions.select(*INDEX, "prediction"), f"{path}_predictions", ())
    write_stage(confusion_matrix(predictions, CLASSES), f"{path}_confusion", ())
    write_stage(classification_report(predictions), f"{path}_report", ())
