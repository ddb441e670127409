"""Change points by two half windows sliding over a series.

At a candidate k the gain is cost(k - h, k + h) - cost(k - h, k) - cost(k, k + h) with
half width h. Costs follow from sums over row ranges, so rows are first reduced to the
cells between the positions k - h, k and k + h, and prefix sums are taken over cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorline.operators.indexing import IndexedSeries, index_series, running_sum
from tremorline.session import stage

# Settings of the per-series and of the merged segmentation.
SERIES_SETTINGS = {"width": 15_360, "jump": 1_560, "min_size": 153_600, "breakpoints": 10, "cost": "l2"}
MERGED_SETTINGS = {"width": 5_000, "jump": 5, "min_size": 2, "breakpoints": 3, "cost": "normal"}
_SMALL_DIAGONAL = 1e-6


@dataclass(frozen=True)
class _Moments:
    """Row count and sums of a row range (differences of prefix sums)."""

    high: str
    low: str

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.high}.{name}") - F.col(f"{self.low}.{name}")


def _l2(m: _Moments) -> Column:
    """Sum of squared distances from the mean, over both axes."""
    spread = m["xx"] - m["x"] * m["x"] / m["n"] + m["yy"] - m["y"] * m["y"] / m["n"]
    return F.greatest(spread, F.lit(0.0))


def _normal(m: _Moments) -> Column:
    """Length times the log determinant of the sample covariance."""
    free = m["n"] - 1
    xx = (m["xx"] - m["x"] * m["x"] / m["n"]) / free + _SMALL_DIAGONAL
    yy = (m["yy"] - m["y"] * m["y"] / m["n"]) / free + _SMALL_DIAGONAL
    xy = (m["xy"] - m["x"] * m["y"] / m["n"]) / free
    return m["n"] * F.ln(xx * yy - xy * xy)


COSTS = {"l2": _l2, "normal": _normal}


def gains(series: IndexedSeries, width: int, jump: int, cost: str) -> DataFrame:
    """Keys, ``n_rows``, candidate position ``k``, its ordinal ``j`` and ``gain``."""
    if width < 4 or jump < 1:
        raise ValueError("width must be at least 4 and jump at least 1")
    keys, half = list(series.keys), width // 2
    before, after = half % jump, (jump - half % jump) % jump
    cuts = sorted({0, before, after})
    residue = F.col("pos") % jump
    cell = sum((F.when(residue >= c, 1).otherwise(0) for c in cuts[1:]), F.lit(0))
    starts = F.array(*[F.lit(c) for c in cuts])
    x, y = F.col("x") - F.col("center_x"), F.col("y") - F.col("center_y")
    sums = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
    cells = (
        series.rows.withColumn("_at", F.col("pos") - residue + F.get(starts, cell))
        .groupBy(*keys, "n_rows", "_at")
        .agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    )
    # a closing cell, so that the sum over all rows is available at position n_rows
    closing = cells.groupBy(*keys, "n_rows").agg(F.max("n_rows").alias("_at")).select(
        *keys, "n_rows", "_at", *[F.lit(0.0).alias(name) for name in sums]
    )
    prefix = running_sum(cells.unionByName(closing), series.keys, "_at", tuple(sums))
    state = F.struct(*[F.col(f"before_{name}").alias(name) for name in sums])
    at = F.col("_at")
    roles = F.array(
        F.struct(F.lit("left").alias("role"), (at + half).alias("k")),
        F.struct(F.lit("mid").alias("role"), at.alias("k")),
        F.struct(F.lit("right").alias("role"), (at - half).alias("k")),
    )
    k = F.col("k")
    ends = (
        prefix.select(*keys, "n_rows", state.alias("state"), F.inline(roles))
        .filter((k % jump == 0) & (k >= half) & (k < F.col("n_rows") - half))
        .groupBy(*keys, "n_rows", "k")
        .agg(*[F.max(F.when(F.col("role") == r, F.col("state"))).alias(r) for r in ("left", "mid", "right")])
    )
    price = COSTS[cost]
    whole, first, second = _Moments("right", "left"), _Moments("mid", "left"), _Moments("right", "mid")
    first_candidate = -(-half // jump)
    return ends.select(
        *keys,
        "n_rows",
        "k",
        (k / jump - first_candidate).cast("bigint").alias("j"),
        (price(whole) - price(first) - price(second)).alias("gain"),
    )


def _peaks(candidates: DataFrame, keys: list[str], half: int, jump: int, order: int) -> DataFrame:
    """Candidates above all others within ``order`` ordinals on either side, cyclically.

    A window of ``order`` ordinals is a suffix of one stretch of that length plus a prefix
    of the next, so running maxima per stretch give every window maximum.
    """
    first = -(-half // jump)
    count = F.ceil((F.col("n_rows") - half) / jump) - first
    sized = candidates.withColumn("_m", count).filter(F.col("_m") > order)
    j, m = F.col("j"), F.col("_m")
    around = F.filter(F.array(j - m, j, j + m), lambda i: (i >= -order) & (i < m + order))
    unrolled = sized.select(*keys, "gain", F.explode(around).alias("i"))
    stretch = Window.partitionBy(*keys, F.floor(F.col("i") / order)).orderBy("i")
    prefix = F.max("gain").over(stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    suffix = F.max("gain").over(stretch.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    i = F.col("i")
    reaches = F.array(
        F.struct((i - order).alias("j"), F.col("p").alias("near")),
        F.struct((i + 1).alias("j"), F.col("p").alias("near")),
        F.struct((i - 1).alias("j"), F.col("s").alias("near")),
        F.struct((i + order).alias("j"), F.col("s").alias("near")),
    )
    highest = (
        unrolled.select(*keys, "i", prefix.alias("p"), suffix.alias("s"))
        .select(*keys, F.inline(reaches))
        .groupBy(*keys, "j")
        .agg(F.max("near").alias("_near"))
    )
    return sized.join(highest, [*keys, "j"]).filter(F.col("gain") > F.col("_near")).drop("_near", "_m")


def change_points(
    series: IndexedSeries, width: int, jump: int, min_size: int, breakpoints: int, cost: str
) -> DataFrame:
    """Keys, ``breakpoint`` and ``position`` in (0, 1]: the best ``breakpoints`` peaks of the
    gain and the end of the series."""
    keys, half = list(series.keys), width // 2
    order = max(max(width, 2 * min_size) // (2 * jump), 1)
    candidates = stage(gains(series, width, jump, cost), "gains")
    by_gain = Window.partitionBy(*keys).orderBy(F.desc("gain"), F.desc("k"))
    best = _peaks(candidates, keys, half, jump, order).withColumn("_r", F.row_number().over(by_gain))
    found = best.filter(F.col("_r") <= breakpoints).select(*keys, "n_rows", F.col("k").alias("breakpoint"))
    ends = series.rows.groupBy(*keys).agg(F.max("n_rows").alias("n_rows")).withColumn("breakpoint", F.col("n_rows"))
    return found.unionByName(ends).select(
        *keys, "breakpoint", (F.col("breakpoint") / F.col("n_rows")).alias("position")
    )


def segment_series(series: IndexedSeries, **settings) -> DataFrame:
    """Breakpoints of every series on the squared-distance cost."""
    return change_points(series, **{**SERIES_SETTINGS, **settings})


def merge_series(df: DataFrame, series_order: str = "series", order: str = "input") -> IndexedSeries:
    """All series behind one another as a single one, each in time order.

    ``order='reversed'`` puts the last series first. The single key is a constant.
    """
    if order not in ("input", "reversed"):
        raise ValueError("order is 'input' or 'reversed'")
    rank = F.col(series_order) if order == "input" else -F.col(series_order)
    merged = df.withColumn("merged", F.lit(1)).withColumn("_place", F.struct(rank.alias("rank"), "time"))
    return index_series(merged, ("merged",), "_place", ("x", "y"))


def segment_merged(series: IndexedSeries, **settings) -> DataFrame:
    """Breakpoints of a merged table on the Gaussian cost."""
    return change_points(series, **{**MERGED_SETTINGS, **settings})


def label_segments(series: IndexedSeries, breakpoints: DataFrame, most: int = 4) -> DataFrame:
    """Rows with ``cats``: 1 + number of breakpoints at or before the row, at most ``most``."""
    keys = list(series.keys)
    # at most one array per series, as long as the number of breakpoints asked for
    lists = stage(breakpoints.groupBy(*keys).agg(F.collect_list("breakpoint").alias("_cuts")), "cuts")
    passed = F.size(F.filter("_cuts", lambda b: b <= F.col("pos")))
    cats = F.least(passed + 1, F.lit(most))
    return series.rows.join(lists, keys, "left").withColumn("cats", F.coalesce(cats, F.lit(1))).drop("_cuts")
