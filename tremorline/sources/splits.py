"""The five data splits and the experiment folders each one is made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.sources.acceleration import scan_acceleration, with_time

# Split name to domain and experiment folders, in id order.
SPLITS: dict[str, tuple[str, tuple[str, ...]]] = {
    "s_validate": ("source", ("validate/Bearing1_3",)),
    "s_train": (
        "source",
        (
            "train/Bearing1_1",
            "train/Bearing1_2",
            "test/Bearing1_5",
            "test/Bearing1_6",
            "test/Bearing1_7",
            "train/Bearing2_1",
            "train/Bearing2_2",
            "test/Bearing2_5",
            "test/Bearing2_6",
            "test/Bearing2_7",
        ),
    ),
    "s_test": ("source", ("test/Bearing1_3", "test/Bearing1_4", "test/Bearing2_3", "test/Bearing2_4")),
    "t_train": ("target", ("train/Bearing3_1", "train/Bearing3_2")),
    "t_test": ("target", ("test/Bearing3_3",)),
}


def split_catalogue(spark: SparkSession, splits: dict = SPLITS) -> DataFrame:
    """(split, domain, position, folder)."""
    rows = [
        (split, domain, position, folder)
        for split, (domain, folders) in splits.items()
        for position, folder in enumerate(folders, start=1)
    ]
    return spark.createDataFrame(rows, "split string, domain string, position int, folder string")


def scan_splits(spark: SparkSession, root: str, splits: dict = SPLITS) -> DataFrame:
    """All splits as one table (split, id, time, x, y); ids count within their split."""
    tables = [
        with_time(scan_acceleration(spark, root, list(folders))).withColumn("split", F.lit(split))
        for split, (_, folders) in splits.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), tables).select("split", "id", "time", "x", "y")
