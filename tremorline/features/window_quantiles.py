"""Exact quantiles of growing windows, selected level by level.

The values of a series form a tree: leaves of up to ``LEAF`` rows that are next to each
other in value order, ``FAN`` nodes under each node above them. All windows of a series
start at the root with the ranks they want and descend together: a node's rows, counted by
child and by the first window that holds them, tell which child each rank lies in and the
rank inside it. At a leaf the rows themselves take the place of the counts. Inside a node
the search is a dyadic one over the children (a wavelet tree over the rows in window
order), for all windows and ranks at once.

So a node costs its counts and the ranks that reach it: counts have one row per child and
segment between window ends in which it occurs, and leaves that no rank reaches are never
gathered. A series of up to ``LEAF`` rows is one leaf. A node meets all windows of its
series at once, i.e. up to ``FAN`` counts and two ranks a probability for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.features.blocks import spread
from tremorline.operators.indexing import index_series
from tremorline.operators.rolling import Frames
from tremorline.session import stage

LEAF = 16_384
FAN_BITS = 8
FAN = 1 << FAN_BITS

c = F.col


def select(
    order: np.ndarray, since: np.ndarray, weight: np.ndarray, ends: np.ndarray, ranks: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Which entry each wanted rank falls on, and the rank inside it.

    Entries have a number in value order, the first window that holds them and a weight.
    The r-th unit of weight, in value order, of the entries held by window ``end`` is asked
    for, once per pair of ``ends`` and ``ranks``.
    """
    by = np.argsort(since, kind="stable")
    order, weight = order[by], weight[by]
    left, right = np.zeros(len(ends), np.int64), np.searchsorted(since[by], ends, side="right")
    found, rest = np.zeros(len(ends), np.int64), ranks.copy()
    for bit in range(int(order.max(initial=0)).bit_length() - 1, -1, -1):
        upper = (order >> bit & 1).astype(bool)
        lower_before = np.concatenate([[0], np.cumsum(~upper)])
        weight_before = np.concatenate([[0], np.cumsum(np.where(upper, 0, weight))])
        low_left, low_right = lower_before[left], lower_before[right]
        below = weight_before[right] - weight_before[left]
        up = rest >= below
        rest = np.where(up, rest - below, rest)
        found |= up.astype(np.int64) << bit
        left = np.where(up, lower_before[-1] + left - low_left, low_left)
        right = np.where(up, lower_before[-1] + right - low_right, low_right)
        order, weight = (np.concatenate([x[~upper], x[upper]]) for x in (order, weight))
    return found, rest


def wanted(since: np.ndarray, weight: np.ndarray, probabilities: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ends of the windows and, per window and probability, lower rank, upper rank, share."""
    ends, at = np.unique(since, return_inverse=True)
    size = np.cumsum(np.bincount(at, weight)).astype(np.int64)
    place = probabilities * (size[:, None] - 1)
    low = np.floor(place)
    return ends, low.astype(np.int64), np.ceil(place).astype(np.int64), place - low


def _leaf_values(v: np.ndarray, since: np.ndarray, ends: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    ordered = np.argsort(v, kind="stable")
    order = np.empty(len(v), np.int64)
    order[ordered] = np.arange(len(v))
    found, _ = select(order, since, np.ones(len(v), np.int64), ends, ranks)
    return v[ordered[found]]


def _depth(longest: int) -> int:
    """Levels of nodes above the leaves of a series of that many rows."""
    depth, leaves = 0, -(-longest // LEAF)
    while leaves > 1:
        depth, leaves = depth + 1, -(-leaves // FAN)
    return depth


def window_quantiles(frames: Frames, rows: DataFrame, value: str, probabilities: list[float]) -> DataFrame:
    """Window keys, ``kind`` and ``q``, the interpolated quantiles of ``value`` in each window."""
    rows = rows.select(*frames.keys, "kind", "pos", "end", c(value).alias("v"))
    depth = _depth(frames.series.longest)
    if depth == 0:
        return _of_leaves(frames, rows, np.array(probabilities))
    return _of_trees(frames, rows, np.array(probabilities), depth)


def _schema(df: DataFrame, names: list[str], **more: T.DataType) -> T.StructType:
    """Fields of ``df`` by name, and more of the given types."""
    return T.StructType(
        [*(T.StructField(n, df.schema[n].dataType) for n in names), *(T.StructField(n, k) for n, k in more.items())]
    )


def _of_leaves(frames: Frames, rows: DataFrame, probabilities: np.ndarray) -> DataFrame:
    keys = [*frames.keys, "kind"]
    gathered = spread(frames, rows, keys).groupBy(*keys).agg(
        F.collect_list("v").alias("v"), F.collect_list("end").alias("since")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for record in batch.to_dict("records"):
                v, since = np.asarray(record.pop("v")), np.asarray(record.pop("since"))
                ends, low, high, share = wanted(since, np.ones(len(v)), probabilities)
                ranks = np.concatenate([low, high], axis=1)
                found = _leaf_values(v, since, np.repeat(ends, ranks.shape[1]), ranks.ravel()).reshape(ranks.shape)
                lower, upper = found[:, : len(probabilities)], found[:, len(probabilities) :]
                parts.append(pd.DataFrame({**record, "end": ends, "q": list(lower + share * (upper - lower))}))
            if parts:
                yield pd.concat(parts)

    schema = _schema(rows, keys, end=T.LongType(), q=T.ArrayType(T.DoubleType()))
    return gathered.mapInPandas(run, schema).select(*frames.window_keys, "kind", "q")


def _of_trees(frames: Frames, rows: DataFrame, probabilities: np.ndarray, depth: int) -> DataFrame:
    keys = [*frames.keys, "kind"]
    by_value = index_series(rows.withColumnRenamed("pos", "place"), tuple(keys), "v", values=()).rows
    placed = by_value.select(*keys, "end", "v", F.floor(c("pos") / LEAF).alias("leaf"))
    counts = stage(placed.groupBy(*keys, "leaf", "end").agg(F.count(F.lit(1)).alias("n")), "leaf_counts")
    long = T.LongType()
    target = _schema(rows, keys, node=long, end=long, slot=long, rank=long, share=T.DoubleType())

    def descend(entries: DataFrame, targets: DataFrame | None) -> DataFrame:
        """Wanted ranks of every node, moved to its children."""
        root = targets is None
        met = entries if root else entries.join(grouped(targets), [*keys, "node"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for record in batch.to_dict("records"):
                    order, since, weight = (np.asarray(record[k], np.int64) for k in ("order", "since", "n"))
                    if root:
                        ends, low, high, share = wanted(since, weight, probabilities)
                        ranks = np.stack([low, high], axis=2).reshape(len(ends), -1)
                        slot = np.tile(np.arange(ranks.shape[1]), len(ends))
                        end, rank, share = np.repeat(ends, ranks.shape[1]), ranks.ravel(), np.repeat(share.ravel(), 2)
                    else:
                        end, slot, rank, share = (np.asarray(record[f"t_{k}"]) for k in ("end", "slot", "rank", "share"))
                    child, rest = select(order, since, weight, end, rank)
                    known = {k: record[k] for k in keys}
                    node = record["node"] * FAN + child
                    for part in range(0, len(end), 100_000):
                        cut = slice(part, part + 100_000)
                        yield pd.DataFrame(
                            {**known, "node": node[cut], "end": end[cut], "slot": slot[cut], "rank": rest[cut], "share": share[cut]}
                        )

        return stage(met.mapInPandas(run, target), "targets")

    def grouped(targets: DataFrame) -> DataFrame:
        lists = [F.collect_list(name).alias(f"t_{name}") for name in ("end", "slot", "rank", "share")]
        return targets.groupBy(*keys, "node").agg(*lists)

    targets = None
    for level in range(depth - 1, -1, -1):
        child = F.shiftright("leaf", FAN_BITS * level)
        summed = counts.groupBy(*keys, child.alias("child"), "end").agg(F.sum("n").alias("n"))
        node = F.shiftright("child", FAN_BITS).alias("node")
        entries = summed.groupBy(*keys, node).agg(
            F.collect_list(c("child") % FAN).alias("order"), F.collect_list("end").alias("since"), F.collect_list("n").alias("n")
        )
        targets = descend(entries, targets)
    reached = targets.select(*keys, "node").distinct()
    leaves = (
        placed.withColumnRenamed("leaf", "node")
        .join(reached, [*keys, "node"])
        .groupBy(*keys, "node")
        .agg(F.collect_list("v").alias("v"), F.collect_list("end").alias("since"))
        .join(grouped(targets), [*keys, "node"])
    )

    def at_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for record in batch.to_dict("records"):
                end, slot, rank, share = (np.asarray(record[f"t_{k}"]) for k in ("end", "slot", "rank", "share"))
                found = _leaf_values(np.asarray(record["v"]), np.asarray(record["since"]), end, rank)
                known = {k: record[k] for k in keys}
                yield pd.DataFrame({**known, "end": end, "slot": slot, "share": share, "v": found})

    schema = _schema(rows, keys, end=long, slot=long, share=T.DoubleType(), v=T.DoubleType())
    values = leaves.mapInPandas(at_leaves, schema)
    size = len(probabilities)
    table = values.groupBy(*frames.window_keys, "kind").agg(
        *[F.max(F.when(c("slot") == i, c("v"))).alias(f"v{i}") for i in range(2 * size)],
        *[F.max(F.when(c("slot") == 2 * i, c("share"))).alias(f"s{i}") for i in range(size)],
    )
    between = [f"v{2 * i} + s{i} * (v{2 * i + 1} - v{2 * i})" for i in range(size)]
    return table.select(*frames.window_keys, "kind", F.expr(f"array({', '.join(between)})").alias("q"))
