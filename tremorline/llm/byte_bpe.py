"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of bytes exactly one token can be the last of its encoding: a
token that ends there, whose predecessor (the last token of the prefix before it) and it
are encoded as themselves when put together. ``PrefixTable`` stores that token for every
prefix. The encoding is read off backwards; bytes appended only add entries; an edit
redoes entries from its place on until they agree with the old ones again.

Texts are first cut by the vocabulary's pattern, and each match is encoded by itself.
``EncodedText`` keeps the matches, so that an edit of a text redoes the matches near it.

Encoding is work on single rows, spread over the tasks that read them; nothing is shuffled.
Workers keep the ids of the chunks they have seen, in bounded memory (see ``tokens``).

Defined cases: a missing or empty text has no tokens; a very long match is one table of its
bytes, and memory in proportion to it; rows without an id and repeated rows are encoded
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.llm import tokens

MEMORY_BYTES = 256 << 20  # what a worker keeps of chunks: a new one takes the table of its prefixes
PAIR_LIMIT = 300_000  # pairs a worker keeps, some 30 MB


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens by bytes, and which of them may follow each other."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        # length of the longest token that ends with the given bytes
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            self.reach[token[-3:]] = max(self.reach.get(token[-3:], 0), len(token))
        for end, length in list(self.reach.items()):
            for part in (end[1:], end[2:]):
                self.reach[part] = max(self.reach.get(part, 0), length)
        self.cut = regex.compile(pattern).findall
        self.known: dict[int, bool] = {}
        self.known_before: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: the pair of lowest rank is merged first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(a + b, len(self.ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
            )
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the two tokens, put together, are encoded as themselves. ``left`` is -1
        at the start of a piece, where ``right`` alone has to be."""
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            known = self.known_before.get(key)
            if known is None:
                if left < 0:
                    known = self.merged(self.tokens[right]) == [right]
                else:
                    known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            if 2 * len(self.known) >= PAIR_LIMIT:
                self.known, self.known_before = {}, self.known
            self.known[key] = known
        return known

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """A piece of bytes and, for each of its prefixes, the last token of its encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self, stop: int) -> None:
        vocabulary, data, last = self.vocabulary, self.data, self.last
        rank_of, reach_of, known = vocabulary.ranks.get, vocabulary.reach.get, vocabulary.known
        for end in range(len(last), stop + 1):
            longest = reach_of(data[end - 3 : end], 2) if end > 2 else end
            for start in range(end - longest if end > longest else 0, end):
                token = rank_of(data[start:end])
                if token is not None:
                    fits = known.get(last[start] << 32 | token)
                    if fits is None:
                        fits = vocabulary.adjacent(last[start], token)
                        known = vocabulary.known
                    if fits:
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def append(self, data: bytes) -> None:
        """Add bytes at the end; entries made before stay as they are."""
        self.data += data
        self._extend(len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put ``new`` in place of bytes ``start`` to ``stop``."""
        old_last, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old_last[: start + 1]
        # An entry depends on the ``longest`` bytes and entries before it: once as many
        # entries in a row agree with the old ones, all later ones do.
        agreed, longest = 0, self.vocabulary.longest
        for end in range(start + 1, len(self.data) + 1):
            self._extend(end)
            behind = end - start - len(new)
            agreed = agreed + 1 if behind > 0 and self.last[end] == old_last[end - shift] else 0
            if agreed >= longest:
                self.last += old_last[end - shift + 1 :]
                return

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            token = self.last[end]
            found.append(token)
            end -= len(self.vocabulary.tokens[token])
        return found[::-1]


def encode_piece(vocabulary: Vocabulary, data: bytes) -> list[int]:
    """Encoding of one match of the pattern."""
    whole = vocabulary.ranks.get(data)
    if whole is not None:
        return [whole]
    return PrefixTable(vocabulary, data).ids()


def encode(vocabulary: Vocabulary, text: str) -> list[int]:
    return [i for piece in vocabulary.cut(text) for i in encode_piece(vocabulary, piece.encode())]


class EncodedText:
    """A text with the ids of its pieces, open to edits."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary = vocabulary
        self.pieces: list[str] = vocabulary.cut(text)
        self.piece_ids = [encode_piece(vocabulary, p.encode()) for p in self.pieces]

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        return [i for ids in self.piece_ids for i in ids]

    def append(self, text: str) -> None:
        self.replace(sum(map(len, self.pieces)), None, text)

    def replace(self, start: int, stop: int | None, new: str) -> None:
        """Put ``new`` in place of characters ``start`` to ``stop``.

        A piece may look at what follows it, so cutting starts again before the piece in
        front of the edit, and a piece that still ends where an old one did is kept from
        there on: what is cut after a place depends on the text after it only.
        """
        ends = np.cumsum([len(p) for p in self.pieces]).tolist()
        size = ends[-1] if ends else 0
        stop = size if stop is None else stop
        first = max(0, int(np.searchsorted(ends, start, side="left")) - 1)
        begin = ends[first - 1] if first else 0
        after = int(np.searchsorted(ends, stop, side="left"))
        while True:
            after = min(after + 8, len(self.pieces))
            old = "".join(self.pieces[first:after])
            changed = old[: start - begin] + new + old[stop - begin :]
            cut = self.vocabulary.cut(changed)
            if after == len(self.pieces):
                keep = len(cut)
                break
            # the last pieces of ``changed`` would see more text; one before them that ends
            # on an old border behind the edit settles the rest
            borders = {e for e in ends[first:after] if e > stop}
            shift, at, keep = len(new) - (stop - start), begin, 0
            for k, piece in enumerate(cut[:-2]):
                at += len(piece)
                if at - shift in borders and at > start + len(new):
                    keep, after = k + 1, int(np.searchsorted(ends, at - shift)) + 1
                    break
            if keep:
                break
        fresh = cut[:keep]
        self.pieces[first:after] = fresh
        self.piece_ids[first:after] = [encode_piece(self.vocabulary, p.encode()) for p in fresh]


def vocabulary_of(path: str, pattern: str) -> tuple[Vocabulary, tokens.ChunkEncoder]:
    """Vocabulary and encoder of a rank file, one of each per worker process."""
    memory, key = tokens.worker_memory(), f"ranks:{path}:{pattern}"
    if key not in memory:
        vocabulary = Vocabulary(load_ranks(path), pattern)

        def encode_one(chunk: str) -> bytes:
            if tokens.WORD.fullmatch(chunk):
                return array("I", encode_piece(vocabulary, chunk.encode())).tobytes()
            return array("I", encode(vocabulary, chunk)).tobytes()

        memory[key] = vocabulary, tokens.ChunkEncoder(tokens.SPACED.findall, encode_one, MEMORY_BYTES)
    return memory[key]


Batches = Iterator[pa.RecordBatch]


def _encoding(path: str, pattern: str) -> Callable[[Batches], Batches]:
    """Batches of (id, text) to batches of (id, ids)."""

    def run(batches: Batches) -> Batches:
        _, encoder = vocabulary_of(path, pattern)
        for batch in batches:
            ids = pa.array(list(encoder.encode(tokens.texts_of(batch.column(1)))), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return run


def _decoding(path: str, pattern: str, kept: list[str]) -> Callable[[Batches], Batches]:
    """Batches with ids to batches of ``kept`` columns, n_tokens, ids_sha256 and decoded_sha256."""

    def run(batches: Batches) -> Batches:
        vocabulary, _ = vocabulary_of(path, pattern)
        for batch in batches:
            all_ids = batch.column("ids").to_pylist()
            decoded = [vocabulary.decode(np.frombuffer(ids, "<u4").tolist()) for ids in all_ids]
            columns = [
                *(batch.column(c) for c in kept),
                pa.array([len(ids) // 4 for ids in all_ids], pa.int64()),
                pa.array([sha256(ids).hexdigest() for ids in all_ids], pa.string()),
                pa.array([sha256(text).hexdigest() for text in decoded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


_DECODED = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows, f"id {rows.schema['id'].dataType.simpleString()}"


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id and ``ids``, the tokens as little-endian unsigned 32-bit integers."""
    rows, id_field = _rows(docs, id_col, text_col)
    return rows.mapInArrow(_encoding(path, pattern), f"{id_field}, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with n_tokens, ids_sha256 and decoded_sha256 (of the decoded bytes)."""
    kept = [c for c in encoded.columns if c != "ids"]
    schema = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return encoded.mapInArrow(_decoding(path, pattern, kept), f"{schema}, {_DECODED}")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded and decoded again: id, n_tokens, ids_sha256, decoded_sha256. The two steps
    share a worker and its memory; ids do not leave it."""
    rows, id_field = _rows(docs, id_col, text_col)
    encode_batches, decode_batches = _encoding(path, pattern), _decoding(path, pattern, ["id"])
    out = rows.mapInArrow(lambda batches: decode_batches(encode_batches(batches)), f"{id_field}, {_DECODED}")
    return out.withColumnRenamed("id", id_col)
