"""Systematic and per-series samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline.operators.indexing import index_series, quoted, running_sum
from tremorline.operators.rolling import Frames, window_rows
from tremorline.operators.scans import running
from tremorline.session import stage


def every_nth(df: DataFrame, order: tuple[str, ...], step: int) -> DataFrame:
    """Rows 0, step, 2 step, ... of a table in the given order."""
    first, *rest = order
    ordered = index_series(df.withColumn("_order", F.struct(first, *rest)), (), "_order", ())
    return ordered.rows.filter(F.col("pos") % step == 0).select(*map(quoted, df.columns))


def every_nth_rolled(frames: Frames, step: int) -> DataFrame:
    """Every n-th row of the rolled table ordered by (window, time), without sorting it.

    A row's place is the number of rows in the windows before its own plus its position
    in the series, so only the window table is put in order.
    """
    windows = stage(window_rows(frames, frames.series.order), "windows")
    lengths = windows.groupBy(*frames.keys).agg(F.sum("end").alias("_rows"))
    first, *rest = frames.keys
    ordered = lengths.withColumn("_order", F.struct(first, *rest))
    ahead = stage(running_sum(ordered, (), "_order", ("_rows",)).drop("_order", "_rows"), "ahead")
    length = frames.step or 1
    summed = running(
        windows, frames.keys, ["end"], F.floor(F.col("end") / length), frames.series.longest // length + 1,
        {"_inner": (F.col("end"), "sum")}, exclusive=True,
    )
    offsets = summed.join(ahead, frames.keys).select(
        *frames.window_keys,
        "time_end",
        (F.col("before__rows") + F.coalesce("_inner", F.lit(0))).alias("_offset"),
    )
    # A row is kept in a window whose offset has the residue its position asks for, so rows
    # meet just those windows; what comes out of the join is the sample.
    ends = stage(offsets.withColumn("_residue", F.pmod("_offset", F.lit(step))), "offsets")
    order, values = frames.series.order, frames.series.values
    rows = frames.rows.select(
        *frames.keys,
        F.pmod(-F.col("pos"), F.lit(step)).alias("_residue"),
        F.col("end").alias("_from"),
        F.col("last_end").alias("_to"),
        order,
        *values,
        "pos",
    )
    met = rows.join(ends, [*frames.keys, "_residue"]).filter(F.col("end").between(F.col("_from"), F.col("_to")))
    return met.select(*frames.window_keys, order, *values, "pos", "time_end")


def subsample(df: DataFrame, group: str, key: tuple[str, ...], share: float, seed: int = 42) -> DataFrame:
    """floor(n * share) rows of every group, in the order of a seeded digest of the row key.

    Digests are hexadecimal and evenly spread. A prefix histogram per group finds the
    prefix holding the last sampled row; only rows with that prefix are ranked.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    hashed = df.withColumn("_digest", F.md5(text)).withColumn("_prefix", F.substring("_digest", 1, 3))
    counts = hashed.groupBy(group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = F.floor(F.sum("_n").over(Window.partitionBy(group)) * F.lit(share))
    cuts = stage(
        counts.select(
            group,
            "_prefix",
            quota.alias("_quota"),
            (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
            F.sum("_n").over(upto).alias("_upto"),
        ).filter(F.col("_before") < F.col("_quota")),
        "cuts",
    )
    kept = hashed.join(cuts, [group, "_prefix"])
    ranked = Window.partitionBy(group, "_prefix").orderBy("_digest", *key)
    certain = kept.filter(F.col("_upto") <= F.col("_quota"))
    border = (
        kept.filter(F.col("_upto") > F.col("_quota"))
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_before") + F.col("_rank") <= F.col("_quota"))
    )
    columns = [quoted(c) for c in df.columns]
    return certain.select(*columns).unionByName(border.select(*columns))
