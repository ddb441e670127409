"""Benchmark passages in training documents, by an FM-index per shard of the documents.

1. *Phrases*: every run of ``window`` consecutive words of a benchmark item is a window; an
   item of fewer words is one window. Benchmarks are read in blocks of about
   ``BLOCK_BYTES`` of text, and every block is searched for in all documents.
2. *Shards*: a task writes its documents, some ``SHARD_WORDS`` words at a time, over the
   alphabet of the block's words. Any other word, and the end of a document, is a separator
   that equals nothing, so a stretch between separators that is shorter than the shortest
   window is left out. A longer document is cut where its parts share all but one word of
   a window.
3. *FM-index*: suffixes are sorted by prefix doubling; the Burrows-Wheeler transform is
   kept in a wavelet tree (level by level, with counts of zeros), whose ranks carry the
   backward search of all windows at once, last word first.
4. *Places*: suffix positions are stored for every ``SAMPLE``-th place and behind every
   separator; a found row walks back to one of those. Occurrences are added up over the
   shard and merged into spans of words to remove.

A document's result is complete in the task that reads it: nothing is shuffled, and no hot
passage meets anywhere. With several blocks the documents are written down between them.

Defined cases: a missing or empty text has no words and no spans; a missing or empty item
has no window; rows without an id and repeated rows are documents of their own; an item
without an id marks words but is not listed, and rows of one item id are one item; a window
that several items share counts for each of them; an empty table of documents gives no
rows, an empty benchmark no spans; other columns come back in ``row``, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat
from string import ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.llm.tokens import worker_memory
from tremorline.session import stage

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 1 << 20
SAMPLE = 8

SPAN = "struct<first_word long, end_word long, start long, end long>"
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "start", "end")]))

# Words are runs of digits, letters and whatever lies beyond ASCII, with A-Z in lower case.
_KEPT = {*(digits + ascii_lowercase).encode(), *range(0x80, 0x100)}
_FOLD = bytes(c + 32 if c in ascii_uppercase.encode() else c if c in _KEPT else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8."""
    return (text or b"").translate(_FOLD).split()


class Phrases:
    """Distinct windows of benchmark items, over the numbers of their words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number, codes, starts, lengths, owners = self.vocabulary, [], [], [], []
        self.names = sorted({name for name, _ in items if name is not None})
        place = {name: k for k, name in enumerate(self.names)}
        for name, text in items:
            own = [number.setdefault(w, len(number) + 1) for w in words((text or "").encode())]
            length = min(window, len(own))
            count = len(own) - length + 1 if own else 0
            starts += range(len(codes), len(codes) + count)
            lengths += [length] * count
            owners += [place.get(name, -1)] * count
            codes += own
        flat = np.array([*codes, *[0] * window], np.int32)
        starts, lengths, owners = (np.array(x, np.int64) for x in (starts, lengths, owners))
        table = flat[starts[:, None] + np.arange(window)]
        table[np.arange(window) >= lengths[:, None]] = 0
        self.windows, of = np.unique(table, axis=0, return_inverse=True)
        self.lengths = np.count_nonzero(self.windows, axis=1)
        self.shortest = int(self.lengths.min(initial=window))
        # items of each window: owners[first[k] : first[k + 1]]
        pairs = np.unique(np.stack([of.reshape(-1), owners], 1)[owners >= 0], axis=0)
        self.owners = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in sorted order; zeros are separators, smaller than anything
    else and each smaller than the next one. The last element is one."""
    n, zeros = len(text), np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    key, open_, step = rank[order], np.arange(n), 1
    while len(open_):
        # ``open_`` are the places in ``order`` whose suffixes are not told apart yet
        begins = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
        rank[order[open_]] = open_[group]
        open_ = open_[~(begins & np.r_[begins[1:], True])]
        places = order[open_]
        key = rank[places] * n + rank[places + step]
        by = np.argsort(key, kind="stable")
        order[open_], key = places[by], key[by]
        step *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence, a level for each bit from the highest down."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.shifts = range(max(1, (size - 1).bit_length()) - 1, -1, -1)
        self.zeros, self.total = [], []
        for shift in self.shifts:
            ones = (symbols >> shift & 1).astype(bool)
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(~ones, out=before[1:])
            self.zeros.append(before)
            self.total.append(int(before[-1]))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        # where each symbol's part of the last level begins
        self.begin = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, zeros, total in zip(self.shifts, self.zeros, self.total):
            before = zeros[at]
            at = np.where(symbol >> shift & 1, total + at - before, before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._down(symbol, at) - self.begin[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for shift, zeros, total in zip(self.shifts, self.zeros, self.total):
            before = zeros[at]
            one = zeros[at + 1] == before
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, total + at - before, before)
        return symbol, at - self.begin[symbol]


class FMIndex:
    """Backward search in a sequence of word numbers whose separators are zeros."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        order = suffix_order(text)
        used, compact = np.unique(text, return_inverse=True)
        self.used = used
        last = compact[order - 1]  # the transform: the element before each suffix
        self.tree = WaveletTree(last, len(used))
        self.first = np.r_[0, np.cumsum(np.bincount(compact, minlength=len(used)))]
        stored = (order % sample == 0) | (last == 0)
        self.stored = np.r_[0, np.cumsum(stored)]
        self.places = order[stored]
        self.size = len(text)

    def symbols(self, numbers: np.ndarray) -> np.ndarray:
        """Symbols of word numbers, -1 for words that the text does not hold."""
        at = np.minimum(np.searchsorted(self.used, numbers), len(self.used) - 1)
        return np.where(self.used[at] == numbers, at, -1)

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and row behind the last of the suffixes that begin with each window."""
        symbols = self.symbols(windows)
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.size)
        live = np.arange(len(windows))
        for step in range(windows.shape[1]):
            live = live[lengths[live] > step]
            symbol = symbols[live, lengths[live] - 1 - step]
            high[live[symbol < 0]] = 0
            live, symbol = live[symbol >= 0], symbol[symbol >= 0]
            for ends in (low, high):
                ends[live] = self.first[symbol] + self.tree.rank(symbol, ends[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in the given rows."""
        found, open_, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            known = self.stored[at + 1] > self.stored[at]
            found[open_[known]] = self.places[self.stored[at[known]]] + steps
            open_, at = open_[~known], at[~known]
            symbol, rank = self.tree.access(at)
            at = self.first[symbol] + rank
            steps += 1
        return found


def search_shard(parts: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of documents (or parts of them), searched for all windows.

    Returns spans as rows of (part, first word, word behind the last) and pairs of (part,
    item) as rows, both sorted and distinct.
    """
    none = np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    whole = np.zeros(begins[-1], np.int32)
    for begin, part in zip(begins, parts):
        whole[begin : begin + len(part)] = part
    # stretches of benchmark words that may hold a window, each with the separator behind it
    edges = np.flatnonzero(np.diff(np.r_[False, whole != 0, False]))
    starts, stops = edges[::2], edges[1::2]
    long_enough = stops - starts >= phrases.shortest
    starts, stops = starts[long_enough], stops[long_enough]
    if not len(starts) or not len(phrases.windows):
        return none
    marks = np.zeros(len(whole) + 2, np.int8)
    marks[starts] += 1
    marks[stops + 1] -= 1
    origin = np.flatnonzero(np.cumsum(marks[:-2]))
    text = whole[origin]
    index = FMIndex(text)
    low, high = index.search(phrases.windows, phrases.lengths)
    counts = high - low
    window = np.repeat(np.arange(len(counts)), counts)
    if not len(window):
        return none
    rows = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts) + low[window]
    places = origin[index.locate(rows)]
    covered = np.zeros(len(whole) + 1, np.int64)
    np.add.at(covered, places, 1)
    np.subtract.at(covered, places + phrases.lengths[window], 1)
    edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(covered) > 0, False]))
    owner = np.searchsorted(begins, edges[::2], side="right") - 1
    spans = np.stack([owner, edges[::2] - begins[owner], edges[1::2] - begins[owner]], 1)
    hits = np.unique(np.stack([np.searchsorted(begins, places, side="right") - 1, window], 1), axis=0)
    each = phrases.first[hits[:, 1] + 1] - phrases.first[hits[:, 1]]
    of = np.repeat(np.arange(len(hits)), each)
    item = phrases.owners[np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + phrases.first[hits[of, 1]]]
    return spans, np.unique(np.stack([hits[of, 0], item], 1), axis=0)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def with_places(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words with the code points where they begin and end."""
    out, each, at = [], _WORD.finditer(text), -1
    for first, end in spans:
        while at < first:
            word, at = next(each), at + 1
        start = word.start()
        while at < end - 1:
            word, at = next(each), at + 1
        out.append({"first_word": first, "end_word": end, "start": start, "end": word.end()})
    return out


def _search_block(
    rows: DataFrame, items: list[tuple[str | None, str | None]], window: int, shard_words: int, last: bool
) -> DataFrame:
    """``rows`` (row, text, n_words, spans, items) with what one block of items adds."""
    key = uuid.uuid4().hex

    def phrases_of_block() -> Phrases:
        memory = worker_memory()
        if memory.get("phrases", ("",))[0] != key:
            memory["phrases"] = key, Phrases(items, window)
        return memory["phrases"][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrases_of_block()
        number = phrases.vocabulary.get
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            lengths: list[int] = []
            spans = [[(s["first_word"], s["end_word"]) for s in old] for old in column["spans"].to_pylist()]
            found = [set(old) for old in column["items"].to_pylist()]
            changed: set[int] = set()
            parts: list[np.ndarray] = []
            whose: list[tuple[int, int]] = []

            def finish() -> None:
                new_spans, new_items = search_shard(parts, phrases)
                for part, first, end in new_spans.tolist():
                    doc, before = whose[part]
                    spans[doc].append((before + first, before + end))
                    changed.add(doc)
                for part, item in new_items.tolist():
                    found[whose[part][0]].add(phrases.names[item])
                parts.clear()
                whose.clear()

            waiting = 0
            for doc, text in enumerate(column["text"].cast(pa.binary()).to_pylist()):
                own = words(text)
                lengths.append(len(own))
                codes = np.fromiter(map(number, own, repeat(0)), np.int32, len(own))
                for before in range(0, len(codes), shard_words):
                    part = codes[before : before + shard_words + window - 1]
                    parts.append(part)
                    whose.append((doc, before))
                    waiting += len(part)
                    if waiting >= shard_words:
                        finish()
                        waiting = 0
            finish()
            old = column["spans"].to_pylist()
            texts = column["text"]
            placed = [
                with_places(texts[doc].as_py(), merged(own)) if doc in changed else old[doc] for doc, own in enumerate(spans)
            ]
            columns = [
                column["row"],
                *([] if last else [texts]),
                pa.array(lengths, pa.int64()),
                pa.array(placed, _SPANS),
                pa.array([sorted(names) for names in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names_out)

    names_out = ["row", *([] if last else ["text"]), "n_words", "spans", "items"]
    kind = rows.schema["row"].dataType.simpleString()
    text = "" if last else "text string, "
    return rows.mapInArrow(run, f"row {kind}, {text}n_words long, spans array<{SPAN}>, items array<string>")


def find(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    carry: list[str] | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (the columns of ``carry``, all by default, as a
    struct), ``n_words``, ``spans`` (words and code points that windows cover, merged) and
    ``items``, the ids of the items that have a window there, sorted as strings."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    bench = bench.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    found = docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(f"array<{SPAN}>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        # whole items, some ``block_bytes`` of text
        items = [(r.id, r.text) for r in bench.filter(F.col("block") == block).select("id", "text").collect()]
        last = block == blocks - 1
        found = _search_block(found, items, window, shard_words, last)
        if not last:
            found = stage(found, "searched")
    return found


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without its spans."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(text.isNotNull(), F.array_join(kept, ""))
