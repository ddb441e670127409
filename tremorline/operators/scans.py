"""Running values along an order, without one task per key.

Rows are numbered by the caller (window ends, blocks of positions). Up to ``BLOCK``
consecutive numbers of a key are scanned together; what a block adds up to is scanned in
turn, a level higher, and carried into the blocks behind it. A key with any number of rows
so takes as many levels as its numbers have digits in base ``BLOCK``, and no task ever holds
more than ``BLOCK`` numbers of a key. Keys with fewer numbers take one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorline.session import stage

BLOCK = 4096

# How a running value comes from rows, and from what came before the block.
# last: the last value that is not missing; gather: concatenation of short lists
FOLDS = ("sum", "min", "max", "last", "gather")


def _over(value: Column, how: str, window) -> Column:
    if how == "last":
        return F.last(value, ignorenulls=True).over(window)
    if how == "gather":
        return F.flatten(F.collect_list(F.when(F.size(value) > 0, value)).over(window))
    return {"sum": F.sum, "min": F.min, "max": F.max}[how](value).over(window)


def _total(value: Column, how: str, order: list[str]) -> Column:
    if how == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    if how == "gather":
        return F.flatten(F.collect_list(F.when(F.size(value) > 0, value)))
    return {"sum": F.sum, "min": F.min, "max": F.max}[how](value)


def _joined(before: Column, own: Column, how: str) -> Column:
    if how == "sum":
        return F.coalesce(before + own, before, own)
    if how == "last":
        return F.coalesce(own, before)
    if how == "gather":
        return F.coalesce(F.concat(before, own), before, own)
    return {"min": F.least, "max": F.greatest}[how](before, own)


def _level(df: DataFrame) -> str:
    """A name for the block numbers of ``df``, which may be numbered by those of a level below."""
    return "_span_1" if "_span_0" in df.columns else "_span_0"


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    number: Column,
    count: int,
    folds: dict[str, tuple[Column, str]],
    exclusive: bool = False,
    block: int | None = None,
) -> DataFrame:
    """``df`` with a running value per entry of ``folds`` (name: value and how to fold it).

    Rows of a key are folded by ``order``, the row itself included unless ``exclusive``.
    ``number`` (a whole number from 0, below ``count``) must not fall along the order.
    """
    block = block or BLOCK
    last = -1 if exclusive else Window.currentRow

    def along(by: list[str]):
        return Window.partitionBy(*by or [F.lit(0)]).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)

    if count <= block:
        return df.withColumns({name: _over(value, how, along(keys)) for name, (value, how) in folds.items()})
    level = _level(df)
    span = [*keys, level]
    spanned = stage(df.withColumn(level, F.floor(number / block)), "spans")
    totals = spanned.groupBy(*span).agg(*[_total(v, how, order).alias(f"_{n}") for n, (v, how) in folds.items()])
    higher = {f"_before_{n}": (F.col(f"_{n}"), how) for n, (_, how) in folds.items()}
    carried = running(totals, keys, [level], F.col(level), count // block + 1, higher, True, block)
    own = {f"_own_{name}": _over(value, how, along(span)) for name, (value, how) in folds.items()}
    # a key may be missing a part, as it may in a window
    named = carried.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(span)], *higher)
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(span)]
    joined = spanned.withColumns(own).join(named, same)
    values = {n: _joined(F.col(f"_before_{n}"), F.col(f"_own_{n}"), how) for n, (_, how) in folds.items()}
    kept = [f"`{name}`" for name in df.columns if name not in values]
    return joined.withColumns(values).select(*kept, *[f"`{n}`" for n in values])


def running_largest(
    df: DataFrame, keys: list[str], number: str, count: int, value: str, k: int, block: int | None = None
) -> DataFrame:
    """Keys, ``number`` and ``m1`` to ``mk``: the k largest values of the rows up to there.

    Over the stream of a key the running maximum is the largest value; what each new value
    displaces from it feeds the running maximum of the next level, and so on. Blocks begin
    with the k largest values of those before them.
    """
    block = block or BLOCK
    rows = df.select(*keys, F.col(number).alias("_n"), F.col(value).alias("_a"))
    if count <= block:
        return _chain(rows, keys, k).withColumnRenamed("_n", number)
    span = [*keys, "_span"]
    spanned = stage(rows.withColumn("_span", F.floor(F.col("_n") / block)), "spans")
    ranked = Window.partitionBy(*span).orderBy(F.desc("_a"))
    tops = spanned.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= k)
    higher = running_largest(tops, keys, "_span", count // block + 1, "_a", k, block)
    # what is carried into a block comes before its first number
    carried = higher.select(
        *keys,
        ((F.col("_span") + 1) * block - 1).alias("_n"),
        F.explode(F.array(*[f"m{i}" for i in range(1, k + 1)])).alias("_a"),
        (F.col("_span") + 1).alias("_span"),
    ).filter(F.col("_a").isNotNull())
    found = _chain(spanned.unionByName(carried), span, k)
    return found.filter(F.col("_n") >= F.col("_span") * block).drop("_span").withColumnRenamed("_n", number)


def _chain(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    stream = Window.partitionBy(*keys).orderBy("_n", F.desc("_a"))
    now = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = stream.rowsBetween(Window.unboundedPreceding, -1)
    spilled = F.col("_a")
    for level in range(1, k + 1):
        rows = rows.withColumn(f"_top{level}", F.max(spilled).over(now))
        held = F.max(spilled).over(past)
        rows = rows.withColumn(f"_spill{level}", F.when(held.isNotNull() & spilled.isNotNull(), F.least(held, spilled)))
        spilled = F.col(f"_spill{level}")
    return rows.groupBy(*keys, "_n").agg(*[F.max(f"_top{i}").alias(f"m{i}") for i in range(1, k + 1)])
