"""Hard negatives of anchor vectors by angular triangle filtering.

1. *Angles*: components become whole numbers (floor of ``scale`` times them). Every row
   keeps its norm and its angles to a few reference directions, chosen farthest first from
   a sample of at most ``SAMPLE_ROWS`` rows (those with the smallest hashes of their ids).
2. *Windows*: rows sorted by label, nearest reference and angle to it are packed into
   windows of up to ``WINDOW_ROWS``, with the range of their angles and norms. Sorting goes
   by ranges that end with the id, so no label and no repeated vector is one task.
3. *Bounds*: the angle between two vectors is at least the difference and at most the sum
   of their angles to any reference. For an anchor and a window that gives an interval of
   cosines; multiplied by the norms, and widened by more than rounding can take, it bounds
   every score in the window.
4. *Scoring*: anchors go to the tasks in chunks of at most ``CHUNK_ANCHORS``. A task keeps
   the best rows of each anchor it has seen, and scores a window, in whole numbers, only
   for anchors whose bounds overlap the scores still wanted: those above the last of the
   best, and for negatives those between the two shares of the positive's score. What the
   tasks found is merged by anchor.

The work grows with anchors times rows, as asked; tasks hold windows one at a time and hand
on at most (rows wanted) per anchor and task. Of rows with equal label and vector that come
next to each other a window keeps the anchors and the few smallest ids: no other can be
among the first of any anchor.

Defined cases: rows without id, label or vector, or with a component that is missing or not
finite, take no part; shorter vectors are zero beyond their end; equal rows are one row;
rows that share an id but differ are rows of their own, and none is compared with another
of the same id; an anchor without positives, or a positive without negatives, has no rows;
an empty table gives none; other columns are ignored. Numbers beyond 31 bits are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorline.session import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
SHARES = (50, 95)  # a negative's score in hundredths of the positive's
REFERENCES = 8
SAMPLE_ROWS = 2048
WINDOW_ROWS = 256
CHUNK_ANCHORS = 1 << 16
_ANCHORS_AT_ONCE = 1024
_ANGLE_ERROR = 1e-6  # of an angle: arccos turns rounding of 1e-15 into some 1e-7 at its ends
_FAR = np.iinfo(np.int64).max

RESULT = (
    "anchor_id {0}, positive_id {0}, rank int, negative_id {0}, positive_score long, negative_score long"
)


def usable(rows: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, is_anchor and vector (whole numbers) of the rows that take part. Ids and
    labels are whole numbers."""
    vector = F.col(vector_col)
    real = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    )


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of an Arrow column of lists as rows of ``dim`` whole numbers."""
    lengths = np.asarray(vectors.value_lengths(), np.int64)
    out = np.zeros((len(vectors), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = np.asarray(vectors.flatten(), np.int64)
    if len(out) and dim and max(out.max(), -out.min()) >= 1 << 31:
        raise OverflowError("a vector's component times the scale needs more than 31 bits")
    return out


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and vectors of length one (zero for zero vectors)."""
    vectors = vectors.astype(np.float64)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return norms, vectors / np.where(norms > 0, norms, 1)[:, None]


def references(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions of ``sample``, each the farthest in angle from those before it."""
    norms, units = unit(sample)
    units = units[norms > 0]
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen = [units[0]]
    nearest = units @ units[0]
    while len(chosen) < count and nearest.min() < 1 - 1e-9:
        chosen.append(units[int(nearest.argmin())])
        nearest = np.maximum(nearest, units @ chosen[-1])
    return np.stack(chosen)


def measured(rows: DataFrame, dim: int, directions: np.ndarray) -> DataFrame:
    """id, label, is_anchor, cell (nearest reference), angle (to it), norm, angles, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(3), dim)
            norms, units = unit(vectors)
            angles = np.arccos(np.clip(units @ directions.T, -1, 1))
            cell = angles.argmin(axis=1)
            columns = [
                *(batch.column(k) for k in range(3)),
                pa.array(cell, pa.int32()),
                pa.array(angles[np.arange(len(cell)), cell]),
                pa.array(norms),
                pa.array([a.tobytes() for a in angles], pa.binary()),
                pa.array([v.tobytes() for v in vectors.astype("<i4")], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "label", "is_anchor", "cell", "angle", "norm", "angles", "vector"]
    schema = "id long, label long, is_anchor boolean, cell int, angle double, norm double, angles binary, vector binary"
    return rows.select("id", "label", "is_anchor", "vector").mapInArrow(run, schema)


WINDOW = "label long, ids binary, is_anchor binary, vectors binary, norms binary, angles binary"


def windows(rows: DataFrame, keep: int, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``rows`` (as ``measured`` gives them) packed in order of label, cell and angle."""
    order = ["label", "cell", "angle", "id", "vector", "is_anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        before, equal = None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if before and row["label"] == before["label"] and row["vector"] == before["vector"]:
                    if row["id"] == before["id"]:
                        continue
                    equal += 1
                else:
                    equal = 0
                before = row
                if equal >= keep and not row["is_anchor"]:
                    continue
                if held and (len(held) >= window_rows or (row["label"], row["cell"]) != (held[0]["label"], held[0]["cell"])):
                    out.append(held)
                    held = []
                held.append(row)
            yield written(out)
        yield written([held] if held else [])

    def written(groups: list[list[dict]]) -> pa.RecordBatch:
        packed = lambda key, kind: [np.array([r[key] for r in g], kind).tobytes() for g in groups]
        joined = lambda key: [b"".join(r[key] for r in g) for g in groups]
        columns = [
            packed("id", "<i8"), packed("is_anchor", "?"), joined("vector"), packed("norm", "<f8"), joined("angles"),
        ]
        labels = pa.array([g[0]["label"] for g in groups], pa.int64())
        return pa.RecordBatch.from_arrays(
            [labels, *(pa.array(c, pa.binary()) for c in columns)],
            ["label", "ids", "is_anchor", "vectors", "norms", "angles"],
        )

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, WINDOW)


class PackedWindow:
    """A window's arrays and the ranges of its angles and norms."""

    def __init__(self, row: dict, dim: int) -> None:
        self.label = row["label"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        n = len(self.ids)
        self.is_anchor = np.frombuffer(row["is_anchor"], "?")
        self.vectors = np.frombuffer(row["vectors"], "<i4").reshape(n, dim)
        self.norms = np.frombuffer(row["norms"], "<f8")
        self.angles = np.frombuffer(row["angles"], "<f8").reshape(n, -1)
        self.low, self.high = self.angles.min(axis=0), self.angles.max(axis=0)


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    size = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if size < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if size >= 1 << 63:
        raise OverflowError("a score may need more than 63 bits")
    return left.astype(np.int64) @ right.astype(np.int64).T


def bounds(norms: np.ndarray, angles: np.ndarray, window: PackedWindow) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest score each vector can have with a row of the window."""
    nearest = np.maximum(angles - window.high, window.low - angles).max(axis=1, initial=0)
    farthest = np.minimum(angles + window.high, 2 * np.pi - angles - window.low).min(axis=1, initial=np.pi)
    top = np.cos(np.maximum(nearest - _ANGLE_ERROR, 0))
    bottom = np.cos(np.minimum(farthest + _ANGLE_ERROR, np.pi))
    small, large = window.norms.min(), window.norms.max()
    slack = 1 + 1e-9 * norms * large
    lowest = norms * np.where(bottom > 0, small, large) * bottom - slack
    highest = norms * np.where(top > 0, large, small) * top + slack
    return lowest, highest


class Best:
    """The first ``count`` rows of every slot by score, larger first, then by id."""

    def __init__(self, low: np.ndarray, count: int) -> None:
        self.count = count
        # a row must beat the score, or equal it with a smaller id
        self.score, self.id = low.copy(), np.full(len(low), _FAR)
        self.found = np.zeros((0, 3), np.int64)  # slot, -score, id

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        touched = np.isin(self.found[:, 0], slot)
        rows = np.concatenate([self.found[touched], np.stack([slot, -score, row], 1)])
        rows = rows[np.lexsort(rows.T[::-1])]
        begins = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        nth = np.arange(len(rows)) - np.repeat(begins, np.diff(np.r_[begins, len(rows)]))
        rows, nth = rows[nth < self.count], nth[nth < self.count]
        last = rows[nth == self.count - 1]
        self.score[last[:, 0]], self.id[last[:, 0]] = -last[:, 1], last[:, 2]
        self.found = np.concatenate([self.found[~touched], rows])


def first_rows(packed: DataFrame, dim: int, anchors: dict[str, np.ndarray], count: int, same: bool) -> DataFrame:
    """key, nth, score and id of the first ``count`` rows that a task has for each slot.

    A slot is an anchor with the smallest and largest score it wants; ``same`` says whether
    its rows have the anchor's label or another one. ``anchors`` has ``key``, ``label``,
    ``id``, ``vector``, ``norm`` and ``angles`` of each anchor, and ``of`` (its anchor),
    ``nth`` (its number there), ``low`` and ``high`` of each slot, sorted by ``of``.
    """
    shared = packed.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        best = Best(a["low"], count)
        begins = np.searchsorted(a["of"], np.arange(len(a["id"]) + 1))
        for batch in batches:
            for row in batch.to_pylist():
                window = PackedWindow(row, dim)
                fits = np.flatnonzero((a["label"] == window.label) == same)
                for k in range(0, len(fits), _ANCHORS_AT_ONCE):
                    _score(window, a, fits[k : k + _ANCHORS_AT_ONCE], begins, best)
        slot, score, row = best.found.T
        columns = [a["key"][a["of"][slot]], a["nth"][slot], -score, row]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "nth", "score", "id"])

    return packed.mapInArrow(run, "key long, nth long, score long, id long")


def _score(window: PackedWindow, a: dict, chosen: np.ndarray, begins: np.ndarray, best: Best) -> None:
    """Add the rows of a window that the slots of the chosen anchors want."""
    each = begins[chosen + 1] - begins[chosen]
    place = np.repeat(np.arange(len(chosen)), each)  # in ``chosen``, for every slot
    slot = np.arange(len(place)) - np.repeat(np.cumsum(each) - each, each) + begins[chosen][place]
    lowest, highest = bounds(a["norm"][chosen], a["angles"][chosen], window)
    overlaps = (highest[place] >= best.score[slot]) & (lowest[place] <= a["high"][slot])
    place, slot = place[overlaps], slot[overlaps]
    if not len(slot):
        return
    used, place = np.unique(place, return_inverse=True)
    anchors = chosen[used]
    product = scores(a["vector"][anchors], window.vectors)
    product = product[place]
    least, most = best.score[slot][:, None], a["high"][slot][:, None]
    wanted = (product >= least) & (product <= most) & (window.ids != a["id"][anchors][place][:, None])
    wanted &= (product > least) | (window.ids < best.id[slot][:, None])
    at, row = np.nonzero(wanted)
    if len(at):
        best.add(slot[at], product[at, row], window.ids[row])


def anchors_of(packed: DataFrame, dim: int, count: int) -> DataFrame:
    """key, label, id, vector, norm, angles of every anchor, and ``floor``,
    the score of its ``count``-th row among the others of its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                window = PackedWindow(row, dim)
                at = np.flatnonzero(window.is_anchor)
                product = scores(window.vectors[at], window.vectors)
                others = window.ids != window.ids[at][:, None]
                for k, i in enumerate(at):
                    rest = np.sort(product[k][others[k]])
                    floor = int(rest[-count]) if len(rest) >= count else None
                    out.append((window.label, int(window.ids[i]), window.vectors[i].tobytes(), float(window.norms[i]), window.angles[i].tobytes(), floor))
            columns = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.int64()]
    names = ["label", "id", "vector", "norm", "angles", "floor"]
    found = packed.mapInArrow(run, "label long, id long, vector binary, norm double, angles binary, floor long")
    return found.withColumn("key", F.monotonically_increasing_id())


def _arrays(rows: list, dim: int, n_references: int) -> dict[str, np.ndarray]:
    return {
        "key": np.array([r.key for r in rows], np.int64),
        "label": np.array([r.label for r in rows], np.int64),
        "id": np.array([r.id for r in rows], np.int64),
        "norm": np.array([r.norm for r in rows], np.float64),
        "vector": np.frombuffer(b"".join(r.vector for r in rows), "<i4").reshape(len(rows), dim),
        "angles": np.frombuffer(b"".join(r.angles for r in rows), "<f8").reshape(len(rows), n_references),
    }


def _merged(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first ``count`` rows of every slot, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES,
    window_rows: int = WINDOW_ROWS, chunk_anchors: int = CHUNK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product with the anchor. Positives are the first ``positives``
    other rows of the anchor's label; for each of them the first ``negatives`` rows of other
    labels follow whose score is at least and at most the given hundredths of the positive's.
    """
    spark = rows.sparkSession
    whole = usable(rows, anchor, id_col, vector_col, label_col, scale)
    dim = whole.agg(F.max(F.size("vector"))).first()[0]
    schema = RESULT.format(rows.schema[id_col].dataType.simpleString())
    if not dim:
        return spark.createDataFrame([], schema)
    sample = whole.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow().column(0)
    directions = references(matrix(sample.combine_chunks(), dim), REFERENCES)
    keep = max(positives + 1, negatives)
    packed = stage(windows(measured(whole, dim, directions), keep, window_rows), "windows")
    anchors = stage(anchors_of(packed, dim, positives), "anchors")
    chunks = -(-anchors.count() // chunk_anchors)
    chunk = F.pmod(F.xxhash64("key"), F.lit(max(chunks, 1)))

    def searched(table: DataFrame, k: int, count: int, same: bool) -> DataFrame:
        """Slots of the k-th chunk of ``table``, anchors with their ``wanted`` scores."""
        some = table.filter(chunk == k).collect()  # about ``chunk_anchors`` rows
        arrays = _arrays(some, dim, len(directions))
        each = [len(r.wanted) for r in some]
        arrays["of"] = np.repeat(np.arange(len(some)), each)
        wanted = np.array([(w.low, w.high) for r in some for w in r.wanted], np.int64).reshape(-1, 2)
        arrays["low"], arrays["high"] = wanted[:, 0].copy(), wanted[:, 1].copy()
        nth = np.arange(len(arrays["of"])) - np.repeat(np.cumsum(each, dtype=np.int64) - each, each)
        arrays["nth"] = nth
        return stage(first_rows(packed, dim, arrays, count, same), "found")

    def all_chunks(table: DataFrame, count: int, same: bool) -> DataFrame:
        found = searched(table, 0, count, same)
        for k in range(1, chunks):
            found = found.unionByName(searched(table, k, count, same))
        return found

    least = F.lit(-(1 << 62)).cast("long")
    one = F.struct(F.coalesce("floor", least).alias("low"), (-least).alias("high"))
    near = all_chunks(anchors.withColumn("wanted", F.array(one)), positives, True)
    near = stage(_merged(near, ["key"], positives), "positives")
    low, high = shares
    limits = F.struct(
        (F.col("rank") - 1).alias("nth"),
        F.expr(f"(score * {low} + pmod(-score * {low}, 100)) div 100").alias("low"),
        F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100").alias("high"),
    )
    per_anchor = near.groupBy("key").agg(F.array_sort(F.collect_list(limits)).alias("wanted"))
    asked = stage(anchors.join(per_anchor, "key"), "anchors_with_positives")
    far = _merged(all_chunks(asked, negatives, False), ["key", "nth"], negatives)
    pairs = near.select(
        "key", (F.col("rank") - 1).cast("long").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    out = far.join(pairs, ["key", "nth"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    ids = rows.schema[id_col].dataType
    return out.select(
        F.col("anchor_id").cast(ids).alias("anchor_id"),
        F.col("positive_id").cast(ids).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").cast(ids).alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
