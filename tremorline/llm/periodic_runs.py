"""Runs of words that repeat with a period, found in tiles per octave of the period.

A run is a stretch of words with smallest period q, at least ``min_length`` and
``min_exponent`` * q words long, that no neighbouring word extends.

1. *Tiles*: for every octave of periods, step <= q < 2 step with step = 1, 2, 4, ..., a
   document has boundaries every 2 step words. A run of four periods or more reaches from
   its first boundary far enough that the ``step`` words there recur q words later, so a
   boundary without such a recurrence (of hashes, built up from octave to octave), or where
   the words around it agree with those q later for less than a run takes, needs no
   tile. The others get the words from 2 step before to 5 step behind them; neighbouring
   tiles overlap and travel in one row. A boundary whose 2 step words also recur within
   fewer than ``step`` words, compared word by word, lies in a run of a lower octave, and
   then in no other run of this one (two periods on p + q words have a common divisor).
2. *Solving*: tiles are dealt out to tasks, whatever document they are from, and solved by
   two Z-functions at the boundary, one of the words behind it and one backwards: they give,
   for every q of the octave, how far the stretch with period q around the boundary reaches
   in the tile. A q whose first q words repeat a shorter word is not the smallest period.
3. *Stitching*: what is found in a tile may go on in the next, where the two share at least
   one period. Fragments of one document and period meet (after adjoining ones of a tile
   row have been joined up in the task) and are stitched.

Hashes only pick boundaries: equal words have equal hashes, so none is missed, and lengths
come from comparing words.

Scale: the text is read once and written once with its tiles; tiles are rare in ordinary
text, and their rows are dealt by document, octave and place, so that a long document is
not one task. Only documents with tiles go through the shuffles, keyed by a number that no
other row has, so copies of a document do not meet.

Defined cases: a missing or empty text has no words and no runs; rows without an id and
repeated rows are documents of their own; a very long text is cut into tiles of its own;
runs may overlap and hold one another; an empty table gives no rows; other columns come
back in ``row``, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline.session import stage

MIN_LENGTH = 6
MIN_EXPONENT = 4  # the distance of the boundaries rests on four periods at least
_AT_ONCE = 1000  # documents whose words and tiles a task holds at a time
TILE_WORDS = 4096  # neighbouring tiles share a row up to this many words

TILE = "struct<step long, offset long, boundaries binary, codes binary>"
RUN = "struct<start long, length long, period long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _agreement(left: np.ndarray, right: np.ndarray) -> int:
    """How many elements agree from the start."""
    differs = np.flatnonzero(left != right)
    return int(differs[0]) if len(differs) else len(left)


def _long_enough(codes: np.ndarray, at: int, q: int, need: int) -> bool:
    """Whether ``need`` words in a row around ``at`` are those q words later."""
    ahead = codes[at + q : at + q + need]
    ahead_too = _agreement(codes[at : at + len(ahead)], ahead)
    if ahead_too >= need:
        return True
    low = max(0, at - need + ahead_too)
    behind = _agreement(codes[low:at][::-1], codes[low + q : at + q][::-1])
    return ahead_too + behind >= need


def boundaries(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> Iterator[tuple[int, list[int]]]:
    """(step, boundaries that need a tile) for every octave of periods."""
    n, step = len(codes), 1
    grams = _mix(codes.astype(np.uint64) + np.uint64(1))  # of ``step`` words, by first word
    while 4 * step <= n:
        longer = _mix(grams[:-step] * np.uint64(3) + grams[step:]) if len(grams) > step else grams[:0]
        rows = -(-len(grams) // (2 * step))
        square = np.arange(rows * 2 * step, dtype=np.uint64)  # no hash where no gram starts
        square[: len(grams)] = grams
        square = square.reshape(rows, 2 * step)
        recurs = (square[:, step:] == square[:, :1]).any(axis=1)
        found = []
        for at in (np.flatnonzero(recurs) * (2 * step)).tolist():
            if step > 1 and at < len(longer):
                shorter = np.flatnonzero(longer[at + 1 : at + step] == longer[at])
                if len(shorter):
                    other = at + 1 + int(shorter[0])
                    if np.array_equal(codes[at : at + 2 * step], codes[other : other + 2 * step]):
                        continue
            row = square[at // (2 * step)]
            periods = (step + np.flatnonzero(row[step:] == row[0])).tolist()
            if any(_long_enough(codes, at, q, max(min_length, min_exponent * q) - q) for q in periods):
                found.append(at)
        yield step, found
        grams, step = longer, 2 * step


def tiles(
    codes: np.ndarray, tile_words: int = TILE_WORDS, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[dict]:
    """Rows of overlapping tiles: step, offset in the document, boundaries from there, codes."""
    out, n = [], len(codes)
    for step, found in boundaries(codes, min_length, min_exponent):
        group: list[int] = []
        for at in [*found, None]:
            if group and (at is None or at - 2 * step > group[-1] + 5 * step or at + 5 * step - group[0] > tile_words):
                start, stop = max(0, group[0] - 2 * step), min(n, group[-1] + 5 * step)
                out.append(
                    {
                        "step": step,
                        "offset": start,
                        "boundaries": (np.array(group) - start).astype("<i4").tobytes(),
                        "codes": codes[start:stop].astype("<i4").tobytes(),
                    }
                )
                group = []
            if at is not None:
                group.append(at)
    return out


def z_function(s: list[int]) -> list[int]:
    """For every place, how many elements from there on agree with the beginning."""
    n, z, left, right = len(s), [0] * len(s), 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _primitive(z: list[int], q: int) -> bool:
    """Whether the first q elements are no repetition of fewer; ``z`` is their Z-function."""
    return not any(q % d == 0 and z[d] >= q - d for d in range(1, q // 2 + 1))


def solve(
    step: int, offset: int, places: list[int], codes: list[int], n: int,
    min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
) -> list[tuple[int, int, int]]:
    """(period, start, end) of the fragments around the boundaries of a tile row.

    Fragments that end at the edge of their tile are returned whatever their length.
    """
    open_: dict[int, tuple[int, int, bool, bool]] = {}
    done = []
    for at in places:
        low, high = max(0, at - 2 * step), min(len(codes), at + 5 * step)
        ahead = z_function(codes[at:high])
        periods = [q for q in range(step, min(2 * step, len(ahead))) if ahead[q] >= step and _primitive(ahead, q)]
        if not periods:
            continue
        before, top = codes[low:at][::-1], min(len(codes), at + 2 * step)
        back = z_function([*before, -1, *codes[low:top][::-1]])
        for q in periods:
            behind = min(back[len(before) + 1 + top - at - q], len(before))
            start, end = at - behind, at + q + ahead[q]
            cut_left, cut_right = start == low and offset + low > 0, end == high and offset + high < n
            if q in open_:
                old_start, old_end, old_left, old_right = open_[q]
                if start <= old_end - q:
                    # one stretch, seen from two boundaries: the farther ends are the true ones
                    if end <= old_end:
                        end, cut_right = old_end, old_right
                    if old_start <= start:
                        start, cut_left = old_start, old_left
                else:
                    done.append((q, *open_[q]))
            open_[q] = start, end, cut_left, cut_right
    done += [(q, *fragment) for q, fragment in open_.items()]
    return [
        (q, offset + start, offset + end)
        for q, start, end, cut_left, cut_right in done
        if cut_left or cut_right or end - start >= max(min_length, min_exponent * q)
    ]


def _tiled(rows: DataFrame, tile_words: int, min_length: int, min_exponent: int) -> DataFrame:
    """row, part and nth (together the row's number), n_words, words and tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in (b.slice(k, _AT_ONCE) for b in batches for k in range(0, len(b), _AT_ONCE)):
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            lengths, texts, found = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                # bytes split at exactly the six white space characters of ASCII
                words = (text or b"").split()
                codes = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                lengths.append(len(words))
                texts.append(b" ".join(words))
                found.append(tiles(codes, tile_words, min_length, min_exponent))
            columns = [
                batch.column(0),
                pa.array([part] * len(texts), pa.int64()),
                pa.array(range(nth, nth + len(texts)), pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string()),
                pa.array(found, _TILES),
            ]
            nth += len(texts)
            yield pa.RecordBatch.from_arrays(columns, ["row", "part", "nth", "n_words", "words", "tiles"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"row {kind}, part long, nth long, n_words long, words string, tiles array<{TILE}>"
    )


_TILES = pa.list_(
    pa.struct([("step", pa.int64()), ("offset", pa.int64()), ("boundaries", pa.binary()), ("codes", pa.binary())])
)


def _solved(dealt: DataFrame, min_length: int, min_exponent: int) -> DataFrame:
    """part, nth, period, start and end of every fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tile in batch.to_pylist():
                places, codes = (np.frombuffer(tile[k], "<i4").tolist() for k in ("boundaries", "codes"))
                fragments = solve(
                    tile["step"], tile["offset"], places, codes, tile["n_words"], min_length, min_exponent
                )
                out += [(tile["part"], tile["nth"], *fragment) for fragment in fragments]
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = ["part", "nth", "period", "start", "end"]
    return dealt.mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


def stitch(fragments: DataFrame) -> DataFrame:
    """Fragments of one document and period that share a period or more, as one each."""
    by_period = Window.partitionBy("part", "nth", "period").orderBy("start", "end")
    reached = F.max("end").over(by_period.rowsBetween(Window.unboundedPreceding, -1))
    begins = reached.isNull() | (F.col("start") > reached - F.col("period"))
    marked = fragments.withColumn("begins", begins.cast("int"))
    numbered = marked.withColumn("stretch", F.sum("begins").over(by_period.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("part", "nth", "period", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _collapsed(found: DataFrame) -> DataFrame:
    """``found`` with ``text``: its words without those that repeat a first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist()):
                words, kept, at = text.split(" "), [], 0
                for start, end in sorted((r["start"] + r["period"], r["start"] + r["length"]) for r in runs):
                    kept += words[at:start]
                    at = max(at, end)
                texts.append(" ".join(kept + words[at:]))
            columns = [batch.column(c) for c in ("row", "n_words", "runs")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["row", "n_words", "runs", "text"])

    kind = found.schema["row"].dataType.simpleString()
    return found.mapInArrow(run, f"row {kind}, n_words long, runs array<{RUN}>, text string")


def find_runs(
    docs: DataFrame, text_col: str = "text", carry: list[str] | None = None,
    min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, tile_words: int = TILE_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (the columns of ``carry``, all by default, as a
    struct), ``n_words``, ``runs`` (start, length and period in words, in that order) and
    ``text``, the words joined by one space without those that a run holds after its first
    period."""
    if min_exponent < MIN_EXPONENT:
        raise ValueError(f"min_exponent must be {MIN_EXPONENT} at least")
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col(text_col).alias("text"))
    tiled = stage(_tiled(rows, tile_words, min_length, min_exponent), "tiled")
    each = tiled.select("part", "nth", "n_words", F.explode("tiles").alias("tile"))
    dealt = each.select("part", "nth", "n_words", "tile.*").repartition("part", "nth", "step", "offset")
    runs = (
        stitch(_solved(dealt, min_length, min_exponent))
        .select("part", "nth", "start", (F.col("end") - F.col("start")).alias("length"), "period")
        .filter(F.col("length") >= F.greatest(F.lit(min_length), min_exponent * F.col("period")))
        .groupBy("part", "nth")
        .agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    )
    none = F.array().cast(f"array<{RUN}>")
    has_tiles = F.size("tiles") > 0
    # A merge join at every size: both sides follow the number of documents with tiles.
    joined = (
        tiled.filter(has_tiles)
        .select("part", "nth", "row", "n_words", "words")
        .join(runs.hint("merge"), ["part", "nth"], "left")
        .select("row", "n_words", "words", F.coalesce("runs", none).alias("runs"))
    )
    plain = tiled.filter(~has_tiles).select("row", "n_words", none.alias("runs"), F.col("words").alias("text"))
    return _collapsed(joined).unionByName(plain)
