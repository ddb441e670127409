"""Raw snapshot files to the scaled sensor table and the window labels of every split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.operators.filling import fill_series
from tremorline.operators.indexing import IndexedSeries, index_series, series_from_table
from tremorline.operators.rolling import Frames, expanding, window_labels
from tremorline.operators.scaling import robust_scale
from tremorline.session import staging_scope
from tremorline.sources.splits import SPLITS, scan_splits
from tremorline.sources.tables import read_stage, write_stage

# 20 minutes of rows at least, growing by 15 minutes of rows.
MIN_TIMESHIFT = 153_600
STEP = 115_200

KEYS = ("split", "id")


def prepare(sensor: DataFrame) -> IndexedSeries:
    """Order, fill and scale a sensor table (split, id, time, x, y). Series are filled and
    scaled on their own; windows are anchored on the longest series of a split."""
    indexed = index_series(sensor, KEYS, "time", ("x", "y"), scope=("split",))
    return robust_scale(fill_series(indexed))


def run(
    spark: SparkSession,
    root: str,
    out: str,
    splits: dict = SPLITS,
    min_timeshift: int = MIN_TIMESHIFT,
    step: int = STEP,
) -> None:
    """Writes ``<out>/sensor`` and ``<out>/labels``, partitioned by split."""
    with staging_scope(spark):
        write_stage(prepare(scan_splits(spark, root, splits)).rows, f"{out}/sensor")
        frames = load_frames(spark, out, min_timeshift=min_timeshift, step=step)
        labels = window_labels(frames)
        write_stage(labels, f"{out}/labels")


def load_frames(
    spark: SparkSession,
    out: str,
    split: str | None = None,
    min_timeshift: int = MIN_TIMESHIFT,
    step: int = STEP,
) -> Frames:
    """Expanding windows over the stored sensor table, of all splits or of one."""
    series = series_from_table(read_stage(spark, f"{out}/sensor", split), KEYS, "time", ("x", "y"))
    return expanding(series, min_timeshift, step)


def load_labels(spark: SparkSession, out: str, split: str | None = None) -> DataFrame:
    labels = read_stage(spark, f"{out}/labels", split)
    return labels.select(*KEYS, "end", "time_end", F.col("RUL_rolled_class").alias("label"))
