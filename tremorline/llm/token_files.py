"""Token streams in Arrow files of equal-length sequences.

A folder holds pairs of Arrow IPC files (the random-access layout, with a footer), each
pair written by one task:

- ``*.tokens.arrow``: ``ids``, a fixed-size list of ``sequence_length`` ids, and ``mask``,
  a fixed-size list of bits that are set where ``ids`` holds a token and clear where it is
  padding. Every record batch but the last has ``BATCH`` sequences, so sequence i is row
  i % BATCH of batch i // BATCH, read without copying from a memory-mapped file. The stream of a file
  runs on from sequence to sequence; only its last one is padded.
- ``*.documents.arrow``: id, offset in the file's stream, and number of tokens of each
  document in it.

Rows are range-partitioned by id, so files follow each other in ascending id order and each
is written from one sorted stream in bounded memory; a new pair begins when one is full.
File names are unique to the attempt that wrote them, and the manifest, written by Spark
when a task commits, names the files that count: a task that runs again leaves stray files
and nothing else. The manifest has one row per pair; the starts of pairs are running sums
over it.

Defined cases: a missing text is an empty one, a document with the end id alone; rows
without an id come first; repeated ids stay together, ordered by their text's hash; a very
long text goes on over as many sequences and files as it takes; an empty table has no
files; other columns are ignored. Strings of the vocabulary's control tokens in a text are
those tokens, as in the library's plain call.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.llm import tokens
from tremorline.session import qualified, stage

SEQUENCE_LENGTH = 2048
BATCH = 256
MEMORY_BYTES = 384 << 20  # what a worker keeps of chunks of text and their ids
FILE_TOKENS = 1 << 25
END_ID = 2


class PairWriter:
    """Writes the stream of one pair of files."""

    def __init__(self, folder: str, name: str, id_type: pa.DataType, sequence_length: int, dtype: str) -> None:
        self.length, self.dtype = sequence_length, np.dtype(dtype)
        self.tokens_path, self.documents_path = (f"{folder}/{name}.{k}.arrow" for k in ("tokens", "documents"))
        value = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema(
            [("ids", pa.list_(value, sequence_length)), ("mask", pa.list_(pa.bool_(), sequence_length))]
        )
        self.sink = open_output(self.tokens_path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.id_type = id_type
        self.documents: list[tuple] = []
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_tokens = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.documents.append((doc_id, self.n_tokens, len(ids)))
        self.n_tokens += len(ids)
        self.pending.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        full = self.length * BATCH
        if self.waiting >= full:
            stream = np.concatenate(self.pending)
            whole = len(stream) // full * full
            for at in range(0, whole, full):
                self._write(stream[at : at + full], full)
            self.pending, self.waiting = [stream[whole:]], len(stream) - whole

    def _write(self, stream: np.ndarray, size: int) -> None:
        mask = np.arange(size) < len(stream)
        ids = np.zeros(size, self.dtype)
        ids[: len(stream)] = stream
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> tuple[str, str, int, int]:
        if self.waiting:
            stream = np.concatenate(self.pending)
            self._write(stream, -(-len(stream) // self.length) * self.length)
        self.writer.close()
        self.sink.close()
        ids, offsets, sizes = zip(*self.documents)
        table = pa.table(
            {"id": pa.array(ids, self.id_type), "offset": pa.array(offsets, pa.int64()), "tokens": pa.array(sizes, pa.int64())}
        )
        with open_output(self.documents_path) as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        return self.tokens_path, self.documents_path, len(self.documents), self.n_tokens


def _located(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def open_output(path: str) -> pa.NativeFile:
    system, inner = _located(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def open_input(path: str) -> pa.NativeFile:
    """A memory map where the file is local to the reader, else a random-access stream."""
    system, inner = _located(path)
    if isinstance(system, pa.fs.LocalFileSystem):
        return pa.memory_map(inner)
    return system.open_input_file(inner)


class TokenFile:
    """Random access to the sequences of one token file."""

    def __init__(self, path: str) -> None:
        self.reader = pa.ipc.open_file(open_input(path))
        self.length = self.reader.schema.field("ids").type.list_size
        sizes = self.reader.num_record_batches
        self.last_rows = self.reader.get_batch(sizes - 1).num_rows if sizes else 0
        self._at, self._batch = -1, None

    def __len__(self) -> int:
        batches = self.reader.num_record_batches
        return (batches - 1) * BATCH + self.last_rows if batches else 0

    def _values(self, batch: int, column: str) -> pa.Array:
        if batch != self._at:
            self._at, self._batch = batch, self.reader.get_batch(batch)
        return self._batch.column(column).values

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``: views of the file."""
        batch, row = divmod(i, BATCH)
        ids, mask = (self._values(batch, c).slice(row * self.length, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def stream(self, start: int, n: int) -> Iterator[np.ndarray]:
        """``n`` tokens from position ``start`` of the file's stream, as views by batch."""
        while n > 0:
            batch, at = divmod(start, self.length * BATCH)
            mask = self._values(batch, "mask").slice(at, n)
            if mask.true_count != len(mask):
                raise ValueError("a document runs into padding")
            yield self._values(batch, "ids").slice(at, n).to_numpy(zero_copy_only=True)
            start, n = start + len(mask), n - len(mask)


def write(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    sequence_length: int = SEQUENCE_LENGTH, end_id: int = END_ID, dtype: str = "uint16", file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Write the token files of ``docs`` and return their manifest, in order of ``start``:
    tokens, documents (paths), n_documents, n_tokens and start (tokens in the pairs before)."""
    if ":" not in folder.split("/")[0]:
        # pyarrow would take it for a folder of the machine that a task runs on, Spark takes it
        # for one of its default file system, which also holds the manifest
        folder = qualified(docs.sparkSession, folder)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    end, most = np.array([end_id], "<u4").tobytes(), np.iinfo(dtype).max
    run_name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.library_encoder(tokenizer, MEMORY_BYTES)
        part, pair, done = TaskContext.get().partitionId(), None, []
        attempt = uuid.uuid4().hex[:12]
        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encoder.encode(tokens.texts_of(batch.column(1)))):
                ids = np.frombuffer(encoded + end, "<u4")
                if ids.max() > most:
                    raise ValueError(f"token {ids.max()} does not fit {dtype}")
                if pair is None:
                    name = f"{part:06d}-{len(done):04d}-{attempt}"
                    pair = PairWriter(f"{folder}/{run_name}", name, batch.schema.field(0).type, sequence_length, dtype)
                pair.add(doc_id, ids)
                if pair.n_tokens >= file_tokens:
                    done.append((part, len(done), *pair.close()))
                    pair = None
        if pair is not None:
            done.append((part, len(done), *pair.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)

    names = ["part", "nth", "tokens", "documents", "n_documents", "n_tokens"]
    written = ordered.mapInArrow(run, "part long, nth long, tokens string, documents string, n_documents long, n_tokens long")
    manifest = stage(written, "token_manifest")
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    return stage(starts.drop("part", "nth"), "token_manifest")


def read_documents(spark: SparkSession, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Per document, from the files alone: id, start (tokens of all documents before it),
    n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                stream = TokenFile(pair["tokens"])
                with open_input(pair["documents"]) as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        found = reader.get_batch(k)
                        offsets, sizes = (found.column(c).to_numpy() for c in ("offset", "tokens"))
                        sums = []
                        for offset, size in zip(offsets.tolist(), sizes.tolist()):
                            crc = 0
                            for view in stream.stream(offset, size):
                                crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        columns = [found.column("id"), pa.array(offsets + pair["start"]), pa.array(sizes), pa.array(sums, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32"])

    # One task reads few pairs; the number of tasks follows the number of files.
    files = manifest.repartition(max(1, manifest.count()), "tokens")
    return files.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long")
