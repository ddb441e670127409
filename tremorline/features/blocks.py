"""Rows as bounded blocks that meet the windows reaching into them.

Statistics that depend on a property of the window (its mean, its quantiles) cannot be
merged from segments. Repeating every row for every window would multiply the data, so
rows are packed into blocks instead, and each block is joined with groups of windows of
its series; what a block contributes to a window is computed in numpy and summed up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.operators.indexing import block_of
from tremorline.operators.rolling import Frames

BLOCK = 16_384
WINDOW_GROUP = 256  # windows that meet a block at a time
SHORT = 512  # rows up to which pieces of many blocks are computed together
CELLS = 1 << 18  # rows of such pieces at a time

c = F.col


def spread(frames: Frames, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by ``keys`` into as many partitions as there are tasks to run at once,
    or as the rows fill blocks, four to a partition, if that is more.

    The grouping that follows reuses the partitioning. The number follows the rows, so a
    partition stays of one size as data grows; adaptive execution, which sees bytes only,
    would merge partitions that are small but carry numpy work.
    """
    blocks = frames.series.total * len(frames.series.values) // (4 * BLOCK)
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, blocks), *keys)


def packed(frames: Frames, rows: DataFrame, columns: tuple[str, ...], size: int = BLOCK) -> DataFrame:
    """Blocks of long rows: keys, ``kind``, ``_first`` position, ends reached, the rows ``_s`` (in any order)."""
    keys = [*frames.keys, "kind"]
    return (
        spread(frames, rows.withColumn("_block", block_of(c("pos"), size)), [*keys, "_block"])
        .groupBy(*keys, "_block")
        .agg(
            F.min("pos").alias("_first"),
            F.min("end").alias("_from"),
            F.max("last_end").alias("_to"),
            F.collect_list(F.struct("pos", *columns)).alias("_s"),
        )
    )


def struct_fields(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets of the lists of structs, and their fields end to end; lists of one length become rows."""
    offsets = lists.offsets.to_numpy()
    inner, out = lists.flatten(), {}
    for field, values in zip(inner.type, inner.flatten()):
        if pa.types.is_list(field.type):
            out[field.name] = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        else:
            out[field.name] = values.to_numpy(zero_copy_only=False)
    return offsets - offsets[0], out


def lists_of(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """One list a row of ``values``, missing where ``mask`` holds."""
    flat = pa.array(np.ascontiguousarray(values, float).ravel(), mask=None if mask is None else mask.ravel())
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], flat)


def per_window(
    frames: Frames,
    blocks: DataFrame,
    windows: DataFrame,
    row_columns: tuple[str, ...],
    window_columns: tuple[str, ...],
    compute: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]],
    outputs: dict[str, T.DataType],
) -> DataFrame:
    """What every block contributes to every window that reaches into it.

    ``compute`` receives arrays of rows, cut at the windows' ends, and the window columns of
    windows that are cut at the same row of a block with the same first position. Short
    pieces come for many series at once, one line a window; of a long piece there is one
    line for all its windows. It returns one array per output, with an entry per window.
    ``windows`` has the window keys, ``kind`` and ``window_columns``.
    """
    keys = [*frames.keys, "kind"]
    span = (frames.step or 1) * WINDOW_GROUP
    groups = windows.groupBy(*keys, F.floor(c("end") / span).alias("_group")).agg(
        F.collect_list(F.struct("end", *window_columns)).alias("_w")
    )
    reached = F.sequence(F.floor(c("_from") / span), F.floor(c("_to") / span))
    fixed = [*keys, "_block"]
    met = (
        blocks.withColumn("_group", F.explode(reached))
        .join(groups, [*keys, "_group"])
        .select(*fixed, "_first", "_s", "_w")
    )

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first = batch.column("_first").to_numpy()
        offsets, rows = struct_fields(batch.column("_s"))
        ends_at, stats = struct_fields(batch.column("_w"))
        record = np.repeat(np.arange(len(first)), np.diff(offsets))
        order = np.lexsort((rows["pos"], record))
        rows = [np.asarray(rows[k], float)[order] for k in row_columns]
        owner = np.repeat(np.arange(len(first)), np.diff(ends_at))
        size = np.minimum(stats["end"] - first[owner], np.diff(offsets)[owner])
        # pieces that may be taken together follow each other, long ones block by block
        apart = np.where(size > SHORT, owner, -1)
        ranked = np.lexsort((apart, size, first[owner]))
        ranked = ranked[size[ranked] > 0]
        marks = np.stack([apart[ranked], size[ranked], first[owner][ranked]])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for group in np.split(ranked, cuts) if len(ranked) else ():
            length = int(size[group[0]])
            most = max(1, CELLS // length) if length <= SHORT else WINDOW_GROUP
            for at in range(0, len(group), most):
                some = group[at : at + most]
                lines = owner[some] if length <= SHORT else owner[some[:1]]
                cells = offsets[lines][:, None] + np.arange(length)
                found = compute([values[cells] for values in rows], [stats[k][some] for k in window_columns])
                taken = pa.array(owner[some])
                arrays = [batch.column(k).take(taken) for k in fixed] + [pa.array(stats["end"][some])]
                arrays += [
                    lists_of(x) if isinstance(kind, T.ArrayType) else pa.array(np.asarray(x, np.int64))
                    for x, kind in zip(found, outputs.values())
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*fixed, "end", *outputs])

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pieces(batch)

    fields = {f.name: f.dataType for f in met.schema}
    schema = T.StructType([T.StructField(k, fields[k]) for k in fixed]).add("end", T.LongType())
    for name, kind in outputs.items():
        schema = schema.add(name, kind)
    return met.mapInArrow(contribute, schema)


def window_totals(frames: Frames, found: DataFrame, width: int, size: int = BLOCK) -> DataFrame:
    """Window keys, ``kind`` and ``t``, the contributions ``t`` of all blocks of a window added up.
    Where no series is longer than a block, every window has one contribution."""
    keys = [*frames.window_keys, "kind"]
    if frames.series.longest <= size:
        return found.select(*keys, "t")
    return found.groupBy(*keys).agg(F.array(*[F.expr(f"sum(t[{i}])") for i in range(width)]).alias("t"))


def finished(
    table: DataFrame,
    window_keys: list[str],
    column: str,
    names: list[str],
    finish: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]],
) -> DataFrame:
    """Long features from a list column: ``finish`` gets lists of one length as rows of an array
    and the window ends; it returns one column per name and where values are missing. A missing
    list counts as one of length zero."""
    keys = [*window_keys, "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, ends = batch.column(column), batch.column("end").to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                found, missing = finish(flat[starts[some][:, None] + np.arange(size)], ends[some])
                taken = pa.array(some)
                arrays = [*(batch.column(k).take(taken) for k in keys), lists_of(found, missing)]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "_v"])

    fields = {f.name: f.dataType for f in table.schema}
    schema = T.StructType([T.StructField(k, fields[k]) for k in keys]).add("_v", T.ArrayType(T.DoubleType()))
    values = table.select(*keys, column).mapInArrow(run, schema).select(*keys, F.posexplode("_v").alias("_i", "value"))
    feature = F.get(F.array(*[F.lit(name) for name in names]), c("_i"))
    return values.select(*keys, feature.alias("feature"), "value")
