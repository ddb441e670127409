"""Token files: exact round trips against the library."""

import os
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tremorline import session
from tremorline.llm import queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(docs):
    library = Tokenizer.from_file(PATH)
    rows, start = {}, 0
    for doc_id in sorted(docs):
        ids = np.array(library.encode(docs[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        rows[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return rows


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_files(spark, sf_dir).collect()}
    assert got == expected(docs)


def test_files_hold_equal_sequences_and_masks(spark, tmp_path):
    docs = {i: "word " * (i % 37) for i in range(-40, 160)} | {500: "long text. " * 60_000, 501: None, 502: ""}
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, start int").repartition(4)
    manifest = token_files.write(frame, str(tmp_path / "out"), PATH, sequence_length=16, file_tokens=500)
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(spark, manifest).collect()}
    assert got == expected(docs)
    rows = sorted(manifest.collect(), key=lambda r: r.start)
    assert len(rows) > 3
    for row in rows:
        file = token_files.TokenFile(row.tokens)
        masks = [file.sequence(i)[1] for i in range(len(file))]
        assert all(len(m) == 16 for m in masks) and all(m.true_count == 16 for m in masks[:-1])
        assert sum(m.true_count for m in masks) == row.n_tokens
        ids, _ = file.sequence(len(file) - 1)
        assert not ids.flags.owndata and not ids.flags.writeable


def test_ties_missing_ids_and_an_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([(None, "z"), (3, "b"), (3, "a"), (3, "a"), (1, "x")], "doc_id long, text string")
    manifest = token_files.write(frame, str(tmp_path / "a"), PATH)
    got = sorted(map(tuple, token_files.read_documents(spark, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 3, 3, 3]
    assert [r[1] for r in got] == [0, 2, 4, 6, 8]
    empty = token_files.write(frame.limit(0), str(tmp_path / "b"), PATH)
    assert token_files.read_documents(spark, empty).count() == 0


def test_a_plain_folder_on_a_cluster_is_the_one_that_spark_takes_it_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    monkeypatch.setattr(session, "_open_scopes", [str(tmp_path / "staged")])
    frame = spark.createDataFrame([(1, "x"), (2, "a b")], "doc_id long, text string")
    manifest = token_files.write(frame, str(tmp_path / "out"), PATH)
    assert {r.id for r in token_files.read_documents(spark, manifest).collect()} == {1, 2}
    assert all(r.tokens.startswith(str(tmp_path / "out")) for r in manifest.collect())
    assert session.qualified(spark, "s") == f"{os.getcwd()}/s"
