"""Per-series scaling of value columns and of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.functions.scalars import micros
from tremorline.operators.indexing import IndexedSeries
from tremorline.operators.quantiles import group_quantiles
from tremorline.session import stage

_NEAR_ZERO = 10 * 2.220446049250313e-16


def unpivot(rows: DataFrame, keep: list[str], values: tuple[str, ...], kind: str = "kind") -> DataFrame:
    """One row per value column: ``keep``, ``kind``, ``v``."""
    pairs = F.array(*[F.struct(F.lit(v).alias(kind), F.col(v).cast("double").alias("v")) for v in values])
    return rows.select(*keep, F.inline(pairs))


def robust_scale(series: IndexedSeries) -> IndexedSeries:
    """(value - median) / IQR within each series; an IQR of about zero counts as one."""
    keys = list(series.keys)
    long = unpivot(series.rows, keys, series.values)
    quartiles = group_quantiles(long, [*keys, "kind"], "v", [0.25, 0.5, 0.75])
    spread = F.col("q")[2] - F.col("q")[0]
    scale = F.when(spread < _NEAR_ZERO, F.lit(1.0)).otherwise(spread)
    params = quartiles.groupBy(*keys).agg(
        *[
            piece
            for v in series.values
            for piece in (
                F.max(F.when(F.col("kind") == v, F.col("q")[1])).alias(f"_mid_{v}"),
                F.max(F.when(F.col("kind") == v, scale)).alias(f"_scale_{v}"),
            )
        ]
    )
    return _apply(series, stage(params, "scale"))


def minmax_scale(series: IndexedSeries) -> IndexedSeries:
    """(value - min) / (max - min) within each series; a constant column becomes zero."""
    aggregates = []
    for v in series.values:
        spread = F.max(v) - F.min(v)
        aggregates += [
            F.min(v).alias(f"_mid_{v}"),
            F.when(spread < _NEAR_ZERO, F.lit(1.0)).otherwise(spread).alias(f"_scale_{v}"),
        ]
    return _apply(series, stage(series.rows.groupBy(*series.keys).agg(*aggregates), "scale"))


def _apply(series: IndexedSeries, params: DataFrame) -> IndexedSeries:
    scaled = {
        name: (F.col(name) - F.col(f"_mid_{v}")) / F.col(f"_scale_{v}")
        for v in series.values
        for name in (v, f"center_{v}")
    }
    columns = series.rows.columns
    return series.with_rows(series.rows.join(params, list(series.keys)).withColumns(scaled).select(*columns))


def normalize_time(df: DataFrame, keys: tuple[str, ...], time: str = "time", into: str = "norm_axis") -> DataFrame:
    """Time scaled to [0, 1] within each series; NULL where a series has no duration."""
    span = stage(df.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1")), "span")
    first, last, now = micros(F.col("_t0")), micros(F.col("_t1")), micros(F.col(time))
    scaled = F.try_divide((now - first).cast("double"), (last - first).cast("double"))
    return df.join(span, list(keys)).withColumn(into, scaled).drop("_t0", "_t1")
