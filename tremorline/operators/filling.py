"""Forward fill of missing values along an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline.operators.indexing import BLOCK_ROWS, IndexedSeries, block_of, index_series, series_from_table
from tremorline.operators.scans import running
from tremorline.session import stage


def forward_fill(series: IndexedSeries, block_rows: int | None = None) -> DataFrame:
    """Rows with each missing value replaced by the last known one of its series.

    A block fills itself and takes what it lacks from the last known values of the blocks
    before it, a table of one row per block that is scanned in levels.
    """
    keys = list(series.keys)
    block_rows = block_rows or BLOCK_ROWS
    rows = series.rows.withColumn("_part_no", block_of(F.col("pos"), block_rows))
    latest = rows.groupBy(*keys, "_part_no").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("pos"))).alias(f"_last_{v}") for v in series.values]
    )
    folds = {f"_carry_{v}": (F.col(f"_last_{v}"), "last") for v in series.values}
    count = series.longest // block_rows + 1
    carried = running(latest, keys, ["_part_no"], F.col("_part_no"), count, folds, exclusive=True)
    carried = carried.select(*keys, "_part_no", *folds)
    inside = Window.partitionBy(*keys, "_part_no").orderBy("pos")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {
        v: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_carry_{v}")) for v in series.values
    }
    return rows.join(carried, [*keys, "_part_no"]).withColumns(filled).select(*series.rows.columns)


def fill_series(series: IndexedSeries) -> IndexedSeries:
    """The same series without gaps; values before the first known one stay missing."""
    if not series.nulls:
        return series
    rows = stage(forward_fill(series), "filled")
    return series_from_table(rows, series.keys, series.order, series.values)


def fill_gaps(
    df: DataFrame,
    keys: tuple[str, ...] = ("id",),
    order: str = "time",
    values: tuple[str, ...] = ("x", "y"),
    scope: str = "series",
) -> DataFrame:
    """``scope='series'`` fills within each series; ``'global'`` follows the order over all
    series, so that a gap can be filled from another one."""
    if scope not in ("series", "global"):
        raise ValueError("scope is 'series' or 'global'")
    series = index_series(df, keys if scope == "series" else (), order, values)
    return forward_fill(series).select(*df.columns)
