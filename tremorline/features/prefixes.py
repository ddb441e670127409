"""Windows as whole blocks of several sizes and a rest.

A window is a prefix of its series. It is put together from blocks of the largest size, at
most ``FAN`` blocks of each smaller size behind them, and the rows of the last block of the
smallest size up to the window's end. A block is met once by all the windows that hold it
whole and share its larger block, so what it says is computed for all of them at once, from
its rows in order of value. A window of n rows has n / ``SIZES[-1]`` pieces and a bounded
number besides, instead of one per small block, and no row is compared with every window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.features.blocks import lists_of, spread, struct_fields
from tremorline.operators.indexing import with_halo
from tremorline.operators.rolling import Frames
from tremorline.session import stage

FAN = 16
SIZES = (2048, 2048 * FAN, 2048 * FAN * FAN)
PART = 1 << 15  # windows that meet a block at a time

c = F.col

Compute = Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]


def small_blocks(frames: Frames, rows: DataFrame, size: int) -> DataFrame:
    """Keys, ``kind``, ``_block``, ``_to`` (the last window's end), ``_before`` (the value before the
    block's first, missing at the start of a series) and ``_v``, the values in order; staged."""
    keys = [*frames.keys, "kind"]
    blocks = (
        spread(frames, with_halo(rows.select(*keys, "pos", "last_end", "v"), 1, size), [*keys, "_block"])
        .groupBy(*keys, "_block")
        .agg(
            F.max("last_end").alias("_to"),
            F.max(F.when(c("_halo"), c("v"))).alias("_before"),
            F.sort_array(F.collect_list(F.when(~c("_halo"), F.struct("pos", "v")))).alias("_s"),
        )
        .filter(F.size("_s") > 0)
    )
    return stage(blocks.select(*keys, "_block", "_to", "_before", c("_s.v").alias("_v")), "prefix_blocks")


def _met(frames: Frames, blocks: DataFrame, windows: DataFrame, columns: tuple[str, ...], sizes: tuple[int, ...], level: int) -> DataFrame:
    """Blocks of one size with the windows that hold them whole or, at the smallest size, end in them."""
    keys, size = [*frames.keys, "kind"], sizes[level]
    span = frames.step * PART if frames.step else max(1, 2 * frames.series.longest)  # a whole series is one window
    last = f"(end - 1) div {size}" if level == 0 else f"(end - 1) div {size} - 1"
    parent = sizes[level + 1] if level + 1 < len(sizes) else None
    first = f"(end - 1) div {parent} * {parent // size}" if parent else "0L"
    reached = windows.withColumn("_last", F.expr(last)).withColumn("_from", F.expr(first)).filter("_from <= _last")
    asked = (
        reached.withColumn("_block", F.explode(F.sequence("_from", "_last")))
        .groupBy(*keys, "_block", F.floor(c("end") / span).alias("_part"))
        .agg(F.collect_list(F.struct("end", *columns)).alias("_w"))
    )
    ratio = size // sizes[0]
    grouped = spread(frames, blocks.withColumn("_at", F.floor(c("_block") / ratio)), [*keys, "_at"]).groupBy(*keys, "_at").agg(
        F.max("_to").alias("_to"), F.sort_array(F.collect_list(F.struct("_block", "_before", "_v"))).alias("_s")
    )
    start = c("_at") * size
    until = F.least(c("_to"), (F.floor(start / parent) + 1) * parent) if parent else c("_to")
    parts = F.sequence(F.floor(start / span), F.greatest(F.floor(until / span), F.floor(start / span)))
    placed = grouped.select(*keys, c("_at").alias("_block"), "_s", F.explode(parts).alias("_part"))
    return placed.join(asked, [*keys, "_block", "_part"]).select(*keys, "_block", "_s", "_w")


def per_prefix(
    frames: Frames,
    rows: DataFrame,
    windows: DataFrame,
    columns: tuple[str, ...],
    whole: Compute,
    cut: Compute,
    outputs: dict[str, T.DataType],
    sizes: tuple[int, ...] | None = None,
) -> DataFrame:
    """What the pieces of every window contribute to it: keys, ``kind``, ``_block`` (the number of
    the piece's first small block), ``end`` and ``outputs``.

    Both functions receive the values before each row and the values themselves, and the
    window ``columns``: ``whole`` those of a block (of many rows, in order) for all windows that
    hold it, ``cut`` one line of values for the window that ends there.
    """
    sizes = sizes or SIZES
    sizes = (sizes[0], *[s for s in sizes[1:] if s < frames.series.longest])
    keys = [*frames.keys, "kind"]
    blocks = small_blocks(frames, rows, sizes[0])
    wanted = windows.select(*frames.window_keys, "kind", *columns)

    def pieces_at(level: int) -> DataFrame:
        size = sizes[level]

        def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            number = batch.column("_block").to_numpy()
            ends_at, stats = struct_fields(batch.column("_w"))
            packs = batch.column("_s")
            offsets, inner = packs.offsets.to_numpy(), packs.values
            before = inner.field("_before").to_numpy(zero_copy_only=False)
            lists = inner.field("_v")
            starts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, block in enumerate(number.tolist()):
                v = np.asarray(values[starts[offsets[i]] : starts[offsets[i + 1]]], float)
                lag = np.concatenate([[before[offsets[i]]], v[:-1]]).astype(float)
                at = slice(ends_at[i], ends_at[i + 1])
                ends, mine = stats["end"][at], [stats[k][at] for k in columns]
                inside = ends <= (block + 1) * size if level == 0 else np.zeros(len(ends), bool)
                found: list[tuple[np.ndarray, list[np.ndarray]]] = []
                if not inside.all():
                    found.append((ends[~inside], whole([lag, v], [x[~inside] for x in mine])))
                for k in np.flatnonzero(inside):
                    n = int(ends[k]) - block * size
                    found.append((ends[k : k + 1], cut([lag[None, :n], v[None, :n]], [x[k : k + 1] for x in mine])))
                ends = np.concatenate([x for x, _ in found])
                taken = pa.array(np.full(len(ends), i))
                arrays = [batch.column(k).take(taken) for k in keys]
                arrays += [pa.array(np.full(len(ends), block * (size // sizes[0]), np.int64)), pa.array(ends)]
                for j, kind in enumerate(outputs.values()):
                    x = np.concatenate([y[j] for _, y in found])
                    arrays.append(lists_of(x) if isinstance(kind, T.ArrayType) else pa.array(np.asarray(x, np.int64)))
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "_block", "end", *outputs])

        def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from pieces(batch)

        met = _met(frames, blocks, wanted, columns, sizes, level)
        schema = T.StructType([T.StructField(k, met.schema[k].dataType) for k in keys])
        schema = schema.add("_block", T.LongType()).add("end", T.LongType())
        for name, kind in outputs.items():
            schema = schema.add(name, kind)
        return met.mapInArrow(contribute, schema)

    found = pieces_at(0)
    for level in range(1, len(sizes)):
        found = found.unionByName(pieces_at(level))
    return found


def longest_runs(rank: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For every wanted number k, the longest run of places whose rank is at least k.

    A run ends at the nearest lower rank on either side of its lowest place; places that are
    below every wanted number are walls, and only those between the wanted numbers are walked.
    """
    low, high = int(wanted.min()), int(wanted.max())
    walls = np.concatenate([[-1], np.flatnonzero(rank < low), [len(rank)]])
    some = np.flatnonzero((rank >= low) & (rank < high))
    best = np.zeros(high - low + 1, np.int64)
    best[-1] = np.diff(np.sort(np.concatenate([walls, some]))).max() - 1
    gap = np.searchsorted(walls, some)
    left, right = walls[gap - 1].tolist(), walls[gap].tolist()
    place, at, gap = some.tolist(), rank[some].tolist(), gap.tolist()
    stack: list[int] = []
    for i, r in enumerate(at):
        if stack and gap[stack[-1]] != gap[i]:
            stack.clear()
        while stack and at[stack[-1]] > r:
            right[stack.pop()] = place[i]
        if stack:
            left[i] = place[stack[-1]]
        stack.append(i)
    best[rank[some] - low] = np.array(right, np.int64) - np.array(left, np.int64) - 1
    return np.maximum.accumulate(best[::-1])[::-1][wanted - low]


def sums_within(
    low: np.ndarray, high: np.ndarray, terms: np.ndarray, lowest: np.ndarray, highest: np.ndarray
) -> np.ndarray:
    """Sums of ``terms`` (one row per term) over the places with ``low`` >= ``lowest`` and
    ``high`` <= ``highest``, one row per pair of these bounds.

    The places are put in order of ``low`` and split, level by level, by the bits of their rank
    in ``high``. Ranks below a bound fill one node for every bit set in it; in a node the places
    that qualify are a suffix. Only what qualifies is ever added up, nothing is subtracted.
    """
    n = len(low)
    bits = max(n - 1, 0).bit_length()
    size = 1 << bits
    by_low = np.argsort(low, kind="stable")
    rank = np.empty(n, np.int64)
    by_high = np.argsort(high, kind="stable")
    rank[by_high] = np.arange(n)
    order = np.concatenate([rank[by_low], np.arange(n, size)])
    weights = np.zeros((len(terms), size))
    weights[:, :n] = terms[:, by_low]
    since = np.searchsorted(low[by_low], lowest, side="left")
    below = np.searchsorted(high[by_high], highest, side="right")
    out = np.zeros((len(terms), len(lowest)))
    every = below >= size
    if every.any():
        suffix = np.concatenate([np.cumsum(weights[:, ::-1], axis=1)[:, ::-1], np.zeros((len(terms), 1))], axis=1)
        out[:, every] = suffix[:, since[every]]
    some = np.flatnonzero(~every & (below > 0) & (since < n))
    since, below, node = since[some], below[some], np.zeros(len(some), np.int64)
    place = np.arange(size)
    for bit in range(bits - 1, -1, -1):
        half = 1 << bit
        upper = (order >> bit & 1).astype(bool)
        lower_before = np.concatenate([[0], np.cumsum(~upper)])
        start = place & ~(2 * half - 1)
        lower_inside = lower_before[:-1] - (start >> 1)
        to = start + np.where(upper, half + (place - start) - lower_inside, lower_inside)
        moved, order_moved = np.empty_like(weights), np.empty_like(order)
        moved[:, to], order_moved[to] = weights, order
        weights, order = moved, order_moved
        lower = weights.reshape(len(terms), -1, 2, half)[:, :, 0, ::-1]
        suffix = np.cumsum(lower, axis=2)[:, :, ::-1]
        in_lower = lower_before[node * 2 * half + since] - node * half
        up = (below >> bit & 1).astype(bool)
        add = np.flatnonzero(up & (in_lower < half))
        out[:, some[add]] += suffix[:, node[add], in_lower[add]]
        since = np.where(up, since - in_lower, in_lower)
        node = 2 * node + up
    return out.T
