"""Relevant features found on a sample of the training windows, then computed for all splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.features.registry import (
    efficient,
    extract_features,
    from_columns,
    impute,
    matrix_columns,
    to_matrix,
)
from tremorline.operators.indexing import index_series
from tremorline.operators.relevance import best_per_class, relevance_table
from tremorline.operators.rolling import Frames, whole_series
from tremorline.operators.sampling import every_nth_rolled
from tremorline.plans.preprocessing import KEYS, MIN_TIMESHIFT, STEP, load_frames, load_labels
from tremorline.session import stage, staging_scope
from tremorline.sources.tables import read_stage, write_stage

# One row in ten is sampled; twenty features per class are kept.
SAMPLE_STEP = 10
PER_CLASS = 20
TRAIN_SPLIT = "s_train"
MODEL_SPLITS = ("s_train", "s_test", "t_train", "t_test")

WINDOW = [*KEYS, "window_rows"]


def sampled_windows(frames: Frames, step: int = SAMPLE_STEP) -> Frames:
    """Every n-th row of the rolled table; each window becomes a series of its own."""
    sample = every_nth_rolled(frames, step).withColumnRenamed("end", "window_rows").drop("pos", "time_end")
    return whole_series(index_series(sample, tuple(WINDOW), frames.series.order, frames.series.values))


def all_features(frames: Frames, names: list[str] | None = None) -> DataFrame:
    """Imputed features of sampled windows: window key, ``feature`` named by axis, ``value``."""
    long = extract_features(frames, names or efficient())
    filled = impute(long, WINDOW)
    return filled.select(*WINDOW, F.concat_ws("__", "kind", "feature").alias("feature"), "value")


def relevance(spark: SparkSession, out: str, features: DataFrame) -> DataFrame:
    labels = load_labels(spark, out, TRAIN_SPLIT).withColumnRenamed("end", "window_rows")
    return relevance_table(features, labels, WINDOW)


def run(
    spark: SparkSession,
    out: str,
    min_timeshift: int = MIN_TIMESHIFT,
    step: int = STEP,
    sample_step: int = SAMPLE_STEP,
    names: list[str] | None = None,
) -> dict[str, list[str]]:
    """Writes ``relevance`` and one matrix of selected features per split; returns the
    selected features per axis."""
    with staging_scope(spark):
        train = load_frames(spark, out, TRAIN_SPLIT, min_timeshift, step)
        features = stage(all_features(sampled_windows(train, sample_step), names), "all-features")
        table = stage(relevance(spark, out, features), "relevance")
        write_stage(table, f"{out}/relevance", ())
        # at most PER_CLASS names per class
        chosen = sorted(r["feature"] for r in best_per_class(table, PER_CLASS).collect())
        spec = from_columns(chosen)
        columns = matrix_columns(spec)
        for split in MODEL_SPLITS:
            frames = load_frames(spark, out, split, min_timeshift, step)
            matrix = to_matrix(extract_features(frames, spec), [*KEYS, "end"], columns)
            labelled = matrix.join(load_labels(spark, out, split), [*KEYS, "end"])
            write_stage(labelled, f"{out}/matrix_{split}", ())
        return spec


def load_matrix(spark: SparkSession, out: str, split: str) -> DataFrame:
    return read_stage(spark, f"{out}/matrix_{split}")
