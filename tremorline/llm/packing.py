"""Packing of token sequences into windows by minimum bin slack.

1. Each document's ids are cut into pieces of at most ``capacity``: full ones and a rest.
   A task numbers its pieces of each length as it writes them.
2. The number of pieces of each length, at most ``capacity`` rows, goes to the driver.
   ``plan`` fills windows from these counts: the longest piece left opens a window, a
   bitset of reachable sums finds the multiset of remaining lengths that comes closest to
   the room left, the counts are traced back through the bitsets, and the pattern found is
   used as often as the counts allow. So the work depends on the lengths, not on the
   number of documents.
3. A piece's number among all pieces of its length (its own number and what the tasks
   before it have) says which window of which pattern it goes to.

No step gathers pieces in one place, and the plan that tasks receive is bounded: patterns
end a length each time, and hold at most 90 different lengths.

Defined cases: a missing or empty text is a document with the end id alone; rows without
an id and repeated rows are documents of their own; a very long text is cut into as many
pieces as it takes; an empty table has no windows; other columns are ignored. Strings of
the vocabulary's control tokens in a text are those tokens, as in the library's plain call.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline.llm import tokens
from tremorline.session import stage

CAPACITY = 4096
END_ID = 2
_OUT_BYTES = 8 << 20  # ids that a task hands on at once
_OUT_ROWS = 512
RUN = 32  # pieces of one length and task that look up their first number together


def _is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def slack(total: int, capacity: int) -> int:
    """Padding of a window; one that holds a power of two stands without any."""
    return 0 if _is_power_of_two(total) else capacity - total


def best_fill(counts: dict[int, int], opened: int, capacity: int) -> Counter:
    """Multiset of ``counts`` that fills a window holding ``opened`` with least slack.

    Bit s of ``reach`` says that a sum of s is possible with the lengths so far. Lengths
    come in descending order, their counts in binary parts; the search ends early when
    the window can be filled.
    """
    room = capacity - opened
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    full = 1 << room
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0 and not reach & full:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left, part = left - part, part * 2
        if reach & full:
            break
    sums = [room] if reach & full else [room - k for k in range(room + 1) if reach >> (room - k) & 1]
    want = min(sums, key=lambda s: (slack(opened + s, capacity), -s))
    used: Counter = Counter()
    for length, part, before in reversed(steps):
        if not before >> want & 1:  # only reachable with this part
            used[length] += part
            want -= length * part
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Patterns (lengths with counts, number of windows) that use up ``counts``."""
    counts = {n: c for n, c in counts.items() if c > 0}
    patterns = []
    while counts:
        longest = max(counts)
        rest = {**counts, longest: counts[longest] - 1}
        pattern = best_fill({n: c for n, c in rest.items() if c}, longest, capacity)
        pattern[longest] += 1
        times = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        patterns.append((pattern, times))
    return patterns


def _narrow(ids: bytes) -> bytes:
    """32-bit ids as 16-bit ones if all fit."""
    values = np.frombuffer(ids, "<u4")
    return values.astype("<u2").tobytes() if values.max(initial=0) < 1 << 16 else ids


def _wide(ids: bytes | None, length: int) -> bytes | None:
    """``length`` ids as 32-bit integers."""
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if ids and len(ids) == 2 * length else ids


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """Pieces of every document: id, start, length, ids_crc32, doc_tokens, ``part`` (the
    task that cut it), ``nth`` (its number there among pieces of its length) and ``ids``
    (little-endian unsigned integers, of 16 bits where all fit), null without ``with_ids``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.library_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for i, ids in enumerate(encoder.encode(tokens.texts_of(batch.column(1)))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    kept = _narrow(piece) if with_ids else None
                    out.append((i, start, length, zlib.crc32(piece), total, part, seen[length], kept))
                    seen[length] += 1
                    size += len(piece)
                    if size >= _OUT_BYTES:
                        yield written(batch.column(0), out)
                        out, size = [], 0
            yield written(batch.column(0), out)

    def written(row_ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*out) if out else ([],) * 8
        numbers = [pa.array(c, pa.int64()) for c in columns[:-1]]
        row_ids = row_ids.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([row_ids, *numbers, pa.array(columns[-1], pa.binary())], names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "ids"]
    kinds = [rows.schema["id"].dataType.simpleString(), *["long"] * 6, "binary"]
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _slots(patterns: list[tuple[Counter, int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, its patterns: number of the first piece that goes there, pieces a
    window, first window, and offset in it."""
    taken: Counter = Counter()
    first_window = 0
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            each = pattern[length]
            slots.setdefault(length, []).append((taken[length], each, first_window, offset))
            taken[length] += each * times
            offset += each * length
        first_window += times
    keys = ("first", "each", "window", "offset")
    return {n: dict(zip(keys, np.array(rows, np.int64).T)) for n, rows in slots.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a written table of ``pieces``) with sequence_id and offset."""
    per_task = stage(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # Full pieces share one length and may be most of a task's, so they ask in runs.
    firsts = firsts.select("length", "part", F.explode(F.expr(f"sequence(0, (n - 1) div {RUN})")).alias("run"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, _OUT_ROWS) for b in batches for k in range(0, len(b), _OUT_ROWS)):
            lengths = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(lengths[order])) + 1).tolist(), len(order)]
            for a, b in zip(cuts, cuts[1:]):
                at = order[a:b]
                if not len(at):
                    continue
                slot = slots[int(lengths[at[0]])]
                k = np.searchsorted(slot["first"], number[at], side="right") - 1
                inside = number[at] - slot["first"][k]
                sequence[at] = slot["window"][k] + inside // slot["each"][k]
                offset[at] = slot["offset"][k] + inside % slot["each"][k] * lengths[at]
            wide = [_wide(i, n) for i, n in zip(batch.column("ids").to_pylist(), lengths.tolist())]
            columns = [pa.array(wide, pa.binary()) if c == "ids" else batch.column(c) for c in kept]
            columns += [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    kept = [c for c in cut.columns if c not in ("part", "nth")]
    # A merge join at every size: this table grows with the number of tasks.
    runs = cut.withColumn("run", F.expr(f"nth div {RUN}"))
    numbered = runs.join(firsts.hint("merge"), ["length", "part", "run"]).select(*kept, (F.col("first") + F.col("nth")).alias("number"))
    schema = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in kept)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset."""
    cut = stage(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack(cut, capacity).withColumnRenamed("id", id_col)
