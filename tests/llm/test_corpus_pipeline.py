"""The pipeline against a plain Python version of its stages, one by one."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_dedup import brute_lines
from test_secret_scan import brute as brute_secrets
from test_simhash import brute_components, brute_fingerprint
from tremorline.llm import packing, secret_scan
from tremorline.session import stage


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], sf_dir), "pipeline_test"))
        if name != "packing":
            assert out[-1].schema.names == docs.schema.names
    return [t.collect() for t in out]


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "secret scans", "packing"]


def test_quality_keeps_labelled_good_and_drops_junk(spark, sf_dir, tables):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in tables[1]}
    judged = [r for r in tables[0] if r.doc_id in quality and len(r.text.split()) >= 20]
    good = [r for r in judged if quality[r.doc_id]]
    assert sum(r.doc_id in kept for r in good) >= 0.95 * len(good)
    assert not any(r.doc_id in kept for r in judged if len(re.findall("[#*$%&|<>]", r.text)) > 0.1 * len(r.text.split()))


def test_lines(tables):
    want = {k[0]: k[1] for k in brute_lines([(r.doc_id, r.source, r.text) for r in tables[1]], 0.02, 5)}
    assert {r.doc_id: r.text for r in tables[2]} == want
    assert all(r.n_chars == len(r.text) for r in tables[2])


def test_near_duplicates(tables):
    prints = {r.doc_id: brute_fingerprint(r.text) for r in tables[2]}
    roots = brute_components(prints.values())
    groups = defaultdict(list)
    for doc_id, p in prints.items():
        groups[roots[p]].append(doc_id)
    assert {r.doc_id for r in tables[3]} == {min(g) for g in groups.values()}


def test_secrets(tables):
    old = {r.doc_id: r.text for r in tables[3]}
    assert {r.doc_id for r in tables[4]} == set(old)
    for r in tables[4]:
        assert brute_secrets(r.text) == []
        if not brute_secrets(old[r.doc_id]):
            assert r.text == old[r.doc_id] or secret_scan.MASK in r.text


def test_packing(tables):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    windows, streams = defaultdict(int), defaultdict(dict)
    for r in tables[5]:
        windows[r.sequence_id] += r.length
        streams[r.doc_id][r.start] = bytes(r.ids)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    assert max(windows.values()) <= 4096
    # the last window may be nearly empty
    assert sum(packing.slack(n, 4096) for n in windows.values()) < 4096 + 0.01 * sum(windows.values())
    for r in tables[4]:
        ids = library.encode(r.text, add_special_tokens=False).ids + [2]
        assert b"".join(b for _, b in sorted(streams.pop(r.doc_id).items())) == np.array(ids, "<u4").tobytes()
    assert not streams


def test_awkward_documents(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    prose = "the cat and the dog of this house were in that garden with a lot of people and it was all for nothing at all"
    rows = [(1, prose, "en", "s", 1, 0), (None, prose, None, None, None, None), (2, None, "en", "s", None, 1), (3, "", None, "s", 0, 2), (1, prose, "en", "s", 1, 0), (4, prose + " token = abcdefabcdefabcdef", "en", "s", 9, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int"
    spark.createDataFrame(rows, schema).write.parquet(path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 4}
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
