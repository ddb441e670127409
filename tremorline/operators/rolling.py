"""Expanding windows over ordered series, their labels and remaining useful life.

Windows are prefixes of a series. Their ends are anchored on the longest series of the
scope: max_rows, max_rows - step, ... A window of ``end`` rows is emitted where the series
has that many rows and ``end > min_timeshift``. Ends are arithmetic on ``pos``: each row
knows the first window that contains it, so window statistics are built from disjoint
segments and the overlapping table is produced only when it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.functions.scalars import micros, remaining_share, rul_class
from tremorline.operators.indexing import IndexedSeries
from tremorline.operators.scans import running
from tremorline.session import stage


@dataclass(frozen=True)
class Frames:
    """Indexed rows plus ``end`` (rows in the first window holding the row), ``last_end``
    (rows in the last window of the series) and the distance between ends."""

    series: IndexedSeries
    rows: DataFrame
    step: int | None
    # tables that several feature families of one call read, by what they hold
    shared: dict = field(default_factory=dict, compare=False)

    @property
    def keys(self) -> list[str]:
        return list(self.series.keys)

    @property
    def window_keys(self) -> list[str]:
        return [*self.series.keys, "end"]

    def with_rows(self, rows: DataFrame) -> "Frames":
        return replace(self, rows=rows, shared={})

    def once(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """The staged table of that name, made when it is first asked for."""
        if key not in self.shared:
            self.shared[key] = stage(make(), str(key[0]), self.shared.get("folder"))
        return self.shared[key]

    def upto(
        self, df: DataFrame, folds: dict[str, tuple[Column, str]], extra: tuple[str, ...] = (), exclusive: bool = False
    ) -> DataFrame:
        """``df`` (one row per axis, ``extra`` keys and window end) with values folded over the
        window ends of a series, those before the row's own if ``exclusive``."""
        step = self.step or 1
        keys, count = [*self.keys, "kind", *extra], self.series.longest // step + 1 if self.step else 1
        return running(df, keys, ["end"], F.floor(F.col("end") / step), count, folds, exclusive)

    def exploded(self, rows: DataFrame | None = None) -> DataFrame:
        """Every row once per window that holds it: ``end`` becomes the window's own."""
        rows = self.rows if rows is None else rows
        if self.step is None:
            return rows
        ends = F.sequence(F.col("end"), F.col("last_end"), F.lit(self.step).cast("bigint"))
        return rows.withColumn("end", F.explode(ends))


def whole_series(series: IndexedSeries) -> Frames:
    """One window per series: the series itself."""
    rows = series.rows.withColumn("end", F.col("n_rows")).withColumn("last_end", F.col("n_rows"))
    return Frames(series, rows, None)


def expanding(series: IndexedSeries, min_timeshift: int, step: int) -> Frames:
    """Windows growing by ``step`` rows, of at least ``min_timeshift`` + 1 rows."""
    if step <= 0:
        raise ValueError("the step of expanding windows must be positive")
    longest = F.col("max_rows")

    def next_end(at_least: Column) -> Column:
        return at_least + F.pmod(longest - at_least, F.lit(step))

    shortest = F.lit(min_timeshift + 1).cast("bigint")
    end = next_end(F.greatest(F.col("pos") + 1, shortest))
    last_end = F.col("n_rows") - F.pmod(F.col("n_rows") - longest, F.lit(step))
    rows = (
        series.rows.withColumn("end", end)
        .withColumn("last_end", last_end)
        .filter(F.col("end") <= F.col("last_end"))
    )
    return Frames(series, rows, step)


def window_rows(frames: Frames, order: str = "time") -> DataFrame:
    """One row per window: keys, ``end`` and ``time_end``; read off its last row, no grouping."""
    last = frames.rows.filter(F.col("pos") == F.col("end") - 1)
    return last.select(*frames.keys, "end", F.col(order).alias("time_end"), "last_end")


def life_span(frames: Frames, end: str = "rolled") -> DataFrame:
    """First and last time per series; ``end`` selects the last window end ('rolled')
    or the last sample ('series')."""
    order = F.col(frames.series.order)
    if end == "rolled":
        rows = frames.rows
    elif end == "series":
        rows = frames.series.rows
    else:
        raise ValueError("end is 'rolled' or 'series'")
    return rows.groupBy(*frames.keys).agg(F.min(order).alias("t_min"), F.max(order).alias("t_max"))


def _with_span(rows: DataFrame, span: DataFrame, span_of: int | None, keys: list[str]) -> DataFrame:
    """Attach the span of the row's own series, or that of one series of its split."""
    if span_of is None:
        return rows.join(span, keys)
    outer = keys[:-1]
    reference = span.filter(F.col(keys[-1]) == span_of)
    if outer:
        return rows.join(reference.drop(keys[-1]), outer)
    bounds = reference.first()  # one row: the key is unique
    if bounds is None:
        raise ValueError(f"no series {span_of}")
    return rows.withColumn("t_min", F.lit(bounds["t_min"])).withColumn("t_max", F.lit(bounds["t_max"]))


def window_labels(
    frames: Frames, end: str = "rolled", span_of: int | None = None
) -> DataFrame:
    """RUL and RUL class at the end of every window.

    The smallest RUL in a window is that of its last row, and the class order puts the
    class of the smallest RUL first, so both are evaluated at ``time_end``.
    """
    span = stage(life_span(frames, end), "life")
    joined = _with_span(window_rows(frames, frames.series.order), span, span_of, frames.keys)
    rul = remaining_share(micros(F.col("t_max")), micros(F.col("t_min")), micros(F.col("time_end")))
    return (
        joined.withColumn("RUL_rolled", rul)
        .withColumn("RUL_rolled_class", rul_class(F.col("RUL_rolled")))
        .drop("t_min", "t_max", "last_end")
    )


def add_rul(
    rows: DataFrame,
    keys: tuple[str, ...] = ("id",),
    time: str = "time",
    span_of: int | None = None,
) -> DataFrame:
    """RUL in [0, 1] and its class for every row of a table."""
    span = stage(rows.groupBy(*keys).agg(F.min(time).alias("t_min"), F.max(time).alias("t_max")), "life")
    joined = _with_span(rows, span, span_of, list(keys))
    rul = remaining_share(micros(F.col("t_max")), micros(F.col("t_min")), micros(F.col(time)))
    return joined.withColumn("RUL", rul).withColumn("RUL_class", rul_class(F.col("RUL"))).drop("t_min", "t_max")


def rolled_table(frames: Frames, labels: DataFrame) -> DataFrame:
    """The overlapping long table: every row once per window, with the window's label."""
    columns = [*frames.keys, "end", frames.series.order, *frames.series.values]
    return frames.exploded().select(*columns, "pos").join(stage(labels, "labels"), frames.window_keys)


def trailing(series: IndexedSeries, min_timeshift: int, step: int) -> DataFrame:
    """Windows whose left edge moves (negative direction): suffixes starting at 0, step, ...,
    named by the time of their first row."""
    if step <= 0:
        raise ValueError("the step of trailing windows must be positive")
    last_start = F.least(F.col("pos"), F.col("n_rows") - (min_timeshift + 1))
    starts = F.sequence(F.lit(0).cast("bigint"), last_start, F.lit(step).cast("bigint"))
    rows = series.rows.filter(F.col("n_rows") > min_timeshift).withColumn("start", F.explode(starts))
    first = series.rows.filter(F.pmod(F.col("pos"), F.lit(step)) == 0).select(
        *series.keys, F.col("pos").alias("start"), F.col(series.order).alias("time_start")
    )
    return rows.join(first, [*series.keys, "start"])
