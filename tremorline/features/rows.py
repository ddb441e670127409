"""Long rows the feature families start from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.functions.scalars import micros
from tremorline.operators.indexing import with_halo
from tremorline.operators.rolling import Frames


def long_rows(frames: Frames, kinds: list[str] | None = None) -> DataFrame:
    """One row per sample and axis: ``v`` the value, ``d`` its distance from the series
    mean (keeps sums of powers well conditioned), ``hours`` since the series began."""
    series = frames.series
    axes = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("v"), F.col(f"center_{k}").alias("c"))
            for k in (kinds or series.values)
        ]
    )
    elapsed = (micros(F.col(series.order)) - micros(F.col("t_first"))) / 3.6e9
    return frames.rows.select(
        *frames.keys, "pos", "end", "last_end", elapsed.alias("hours"), F.inline(axes)
    ).withColumn("d", F.col("v") - F.col("c"))


def lagged_rows(rows: DataFrame, keys: list[str], lags: list[int], peaks: list[int] | None = None) -> DataFrame:
    """Add ``lag_<k>`` and ``peak_<n>`` columns, computed block by block.

    ``peak_<n>`` is 1 at the row n places after a sample that exceeds its n neighbours on
    both sides, i.e. as soon as a growing window can see the whole peak.
    """
    peaks = peaks or []
    if not lags and not peaks:
        return rows
    reach = max([0, *lags, *[2 * n for n in peaks]])
    block = f"PARTITION BY {', '.join(keys)}, kind, _block ORDER BY pos"
    added = [f"lag(v, {k}) OVER ({block}) AS lag_{k}" for k in lags]
    spread = with_halo(rows, reach)
    # The largest of the last n values comes from those of half as many, n doubling.
    doubled = [1 << i for i in range(max(peaks, default=1).bit_length())]
    for n in doubled[1:]:
        half = "v" if n == 2 else f"_top_{n // 2}"
        spread = spread.selectExpr("*", f"greatest({half}, lag({half}, {n // 2}) OVER ({block})) AS _top_{n}")
    for n in peaks:
        held = max(size for size in doubled if size <= n)
        top = "v" if held == 1 else f"_top_{held}"
        if held < n:
            spread = spread.selectExpr("*", f"greatest({top}, lag({top}, {n - held}) OVER ({block})) AS _last_{n}")
            top = f"_last_{n}"
        middle = f"lag(v, {n}) OVER ({block})"
        seen = f"pos >= {2 * n} AND {middle} > lag({top}, {n + 1}) OVER ({block}) AND {middle} > {top}"
        added.append(f"CASE WHEN {seen} THEN 1 ELSE 0 END AS peak_{n}")
    made = [name for name in spread.columns if name.startswith(("_top_", "_last_"))]
    return spread.selectExpr("*", *added).filter("NOT _halo").drop("_block", "_halo", *made)


def as_long(table: DataFrame, window_keys: list[str], features: dict[str, Column | str]) -> DataFrame:
    """Window keys, ``kind``, ``feature``, ``value`` from one expression per feature."""
    pairs = [
        f"struct('{name}' AS feature, CAST(({value}) AS double) AS value)"
        if isinstance(value, str)
        else F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value"))
        for name, value in features.items()
    ]
    if all(isinstance(p, str) for p in pairs):
        return table.selectExpr(*window_keys, "kind", f"inline(array({', '.join(pairs)}))")
    return table.select(*window_keys, "kind", F.inline(F.array(*pairs)))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)
