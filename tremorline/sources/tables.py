"""Tables kept between stages: parquet, one partition folder per data split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("split",)) -> None:
    """Overwrite a stage table; readers of one split touch only its folder."""
    present = [c for c in partition_by if c in df.columns]
    df.write.mode("overwrite").partitionBy(*present).parquet(path)


def read_stage(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if split is None else table.filter(F.col("split") == split)
