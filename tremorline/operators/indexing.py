"""Row positions inside ordered series, without one task per series.

``index_series`` range-partitions the rows by (series, order), sorts each partition and
stages the result together with a partition-local row id. Each partition holds one
contiguous run of a series, so a small table of runs turns the local id into the exact
position. A series that holds a third of all rows is spread over a third of the
partitions. Everything downstream works on ``pos`` arithmetic and on blocks of it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.session import stage

BLOCK_ROWS = 32_768
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def quoted(name: str) -> Column:
    """A column whose name may contain dots."""
    return F.col(f"`{name}`")


def required(df: DataFrame, name: str) -> Column:
    """The column of that name; a missing value fails."""
    missing = F.raise_error(F.lit(f"missing value in column {name}")).cast(df.schema[name].dataType)
    return F.coalesce(quoted(name), missing)


@dataclass(frozen=True)
class IndexedSeries:
    """Rows with ``pos`` (0-based), ``n_rows`` and first time of the series, ``max_rows``
    of its scope and, per value column, ``center_<value>`` (the series mean, used as a numeric origin)."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: str
    values: tuple[str, ...]
    longest: int
    nulls: int
    total: int

    def with_rows(self, rows: DataFrame) -> "IndexedSeries":
        return replace(self, rows=rows)


def index_series(
    df: DataFrame,
    keys: tuple[str, ...] = ("id",),
    order: str = "time",
    values: tuple[str, ...] = ("x", "y"),
    scope: tuple[str, ...] = (),
) -> IndexedSeries:
    """Number the rows of every series by ``order``; ties follow the other columns. A row
    without a key or without its place in the order is an error.

    ``scope`` names the leading keys within which the longest series is looked up (the
    rolling windows of one data split are anchored on its longest series).
    """
    unordered = (T.MapType, T.UserDefinedType, T.VariantType)
    ties = [f.name for f in df.schema if f.name not in (*keys, order) and not isinstance(f.dataType, unordered)]
    ordering = [quoted(c) for c in (*keys, order, *ties)]
    sorted_rows = stage(
        df.withColumns({name: required(df, name) for name in (*keys, order)})
        .repartitionByRange(*ordering)
        .sortWithinPartitions(*ordering)
        .withColumn("_rid", F.monotonically_increasing_id()),
        "series",
    )
    part = F.shiftright("_rid", _LOCAL_BITS)
    totals = [
        piece
        for v in values
        for piece in (F.sum(v).alias(f"_sum_{v}"), F.count(v).alias(f"_cnt_{v}"))
    ]
    runs = sorted_rows.groupBy(part.alias("_part"), *keys).agg(
        F.min("_rid").alias("_first"),
        F.count(F.lit(1)).alias("_len"),
        F.min(order).alias("_t0"),
        *totals,
    )
    series = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = series.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_part",
        *keys,
        "_first",
        "_len",
        F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_offset"),
        F.sum("_len").over(series).alias("n_rows"),
        F.min("_t0").over(series).alias("t_first"),
        *[
            F.try_divide(F.sum(f"_sum_{v}").over(series), F.sum(f"_cnt_{v}").over(series)).alias(f"center_{v}")
            for v in values
        ],
        *[(F.sum("_len").over(series) - F.sum(f"_cnt_{v}").over(series)).alias(f"_null_{v}") for v in values],
    )
    longest_by = Window.partitionBy(*scope) if scope else None
    if longest_by is not None:
        runs = runs.withColumn("max_rows", F.max("n_rows").over(longest_by))
    runs = stage(runs, "runs")
    nulls = [F.col(f"_null_{v}") for v in values]
    total_nulls = F.coalesce(F.sum(sum(nulls, F.lit(0))), F.lit(0))
    summary = runs.agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("longest"),
        total_nulls.alias("nulls"),
        F.coalesce(F.sum("_len"), F.lit(0)).alias("total"),
    ).first()
    if longest_by is None:
        runs = runs.withColumn("max_rows", F.lit(summary["longest"]).cast("bigint"))
    rows = (
        sorted_rows.withColumn("_part", part)
        .join(runs.drop("_len"), ["_part", *keys])
        .withColumn("pos", F.col("_rid") - F.col("_first") + F.col("_offset"))
        .select(
            *map(quoted, df.columns), "pos", "n_rows", "max_rows", "t_first", *[f"center_{v}" for v in values]
        )
    )
    return IndexedSeries(rows, tuple(keys), order, tuple(values), summary["longest"], summary["nulls"], summary["total"])


def series_from_table(
    rows: DataFrame, keys: tuple[str, ...], order: str, values: tuple[str, ...]
) -> IndexedSeries:
    """An indexed series read back from a stored table of its rows."""
    missing = sum((F.when(F.col(v).isNull(), 1).otherwise(0) for v in values), F.lit(0))
    summary = rows.agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("longest"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("nulls"),
        F.count(F.lit(1)).alias("total"),
    ).first()
    return IndexedSeries(rows, tuple(keys), order, tuple(values), summary["longest"], summary["nulls"], summary["total"])


def block_of(pos: Column, size: int = BLOCK_ROWS) -> Column:
    return F.floor(pos / size)


def with_halo(rows: DataFrame, reach: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Assign rows to blocks of ``size`` positions; the last ``reach`` rows of a block are
    repeated in front of the next one (``_halo`` true), so that a window over one block
    sees every predecessor up to ``reach`` rows back."""
    if reach > size:
        raise ValueError("a block must be at least as long as its halo")
    own = F.floor(F.col("pos") / size)
    if reach == 0:
        return rows.withColumn("_block", own).withColumn("_halo", F.lit(False))
    near_end = F.pmod(F.col("pos"), F.lit(size)) >= size - reach
    copies = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_block", F.explode(copies)).withColumn("_halo", F.col("_block") != own)


def running_sum(df: DataFrame, keys: tuple[str, ...], order: str, values: tuple[str, ...]) -> DataFrame:
    """Add ``before_<value>``: the sum of ``value`` over the earlier rows of the same key.

    Rows are range-partitioned and staged; sums inside a partition are completed by the
    totals of the partitions before it.
    """
    ordering = [*keys, order]
    ranged = stage(
        df.repartitionByRange(*ordering)
        .sortWithinPartitions(*ordering)
        .withColumn("_rid", F.monotonically_increasing_id()),
        "ranged",
    ).withColumn("_part", F.shiftright("_rid", _LOCAL_BITS))
    totals = ranged.groupBy("_part", *keys).agg(*[F.sum(v).alias(f"_total_{v}") for v in values])
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_part", *keys, *[F.coalesce(F.sum(f"_total_{v}").over(earlier), F.lit(0)).alias(f"_base_{v}") for v in values]
    )
    inside = Window.partitionBy("_part", *keys).orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    sums = {
        f"before_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_base_{v}") for v in values
    }
    return ranged.join(stage(bases, "bases"), ["_part", *keys]).withColumns(sums).select(*map(quoted, df.columns), *sums)
