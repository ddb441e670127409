"""Packed windows: tokens against the library, plans against brute force."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tremorline.llm import packing, queries, tokens

AWKWARD = [
    "", " ", "a", "A b  c", "It's  the dog's\n\n\tbone. ", "ſoft ĳ İstanbul ΣΑΣ ς", "x\x1cy \x1d z", "é ́ äb", "№½²Ⅷ 12 3",
    "<|endoftext|> <|startoftext|>", "…?!.,;:! a.b,c", "  x　", "日本語 テスト", "\U0001f600\U0001f600", "don't I'LL we've", "0" * 300, "$.5 a$.b é.è",
    "İ. aİ, İ ", "Σ. aΣ, ſ.",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_those_of_the_library(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rng = random.Random(1)
    texts = AWKWARD + ["".join(rng.choices([*AWKWARD, " ", "\n", "  ", "'s", ".", "é", "\x85"], k=rng.randint(2, 9))) for _ in range(400)]
    encoder = tokens.library_encoder(path, memory_bytes=20_000, control=False)
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("name", "end"), [("word_bpe_49k.json", 49407), ("byte_bpe_50k.json", 50256)])
def test_added_tokens_in_a_text(name, end):
    path = public_tokenizers.path(name)
    plain, characters = Tokenizer.from_file(path), Tokenizer.from_file(path)
    characters.encode_special_tokens = True
    texts = ["a <|endoftext|> b", "a <|endoftext b|>", "<|ENDOFTEXT|> <|endoftext|>İ x\x1cy", "<|startoftext|>It's<|endoftext|>"]
    for control, library in ((True, plain), (False, characters)):
        got = [np.frombuffer(b, "<u4").tolist() for b in tokens.library_encoder(path, control=control).encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert (end in got[0]) == control


def test_memory_is_bounded_in_bytes():
    asked = []
    encoder = tokens.ChunkEncoder(str.split, lambda c: asked.append(c) or b"1234", memory_bytes=6_000)
    texts = ["hot", *(w for i in range(200) for w in ("hot", f"cold{i}")), "x" * 1000, "x" * 1000]
    assert list(encoder.encode(texts)) == [b"1234"] * len(texts)
    assert asked.count("hot") == 1 and asked.count("x" * 1000) == 2
    assert encoder.known.size + encoder.known.before.size <= 6_000 + 2 * 300
    assert "cold0" not in encoder.known and "cold0" not in encoder.known.before


def test_best_fill_is_best():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([16, 23, 32])
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, capacity), rng.randint(0, 5))}
        opened = rng.randint(1, capacity)
        used = packing.best_fill(counts, opened, capacity)
        assert all(counts[n] >= k for n, k in used.items())
        sums = {
            opened + sum(n * k for n, k in zip(counts, ks))
            for ks in itertools.product(*(range(c + 1) for c in counts.values()))
        }
        best = min(packing.slack(s, capacity) for s in sums if s <= capacity)
        assert packing.slack(opened + sum(n * k for n, k in used.items()), capacity) == best


def test_plan_uses_every_piece_once():
    rng = random.Random(4)
    counts = {n: rng.randint(1, 2000) for n in rng.sample(range(1, 4097), 1500)}
    patterns = packing.plan(counts)
    used = Counter()
    for pattern, times in patterns:
        assert sum(n * k for n, k in pattern.items()) <= 4096
        for n, k in pattern.items():
            used[n] += k * times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    padding = sum(packing.slack(sum(n * k for n, k in p.items()), 4096) * t for p, t in patterns)
    assert padding < 0.02 * total


def check(rows, docs, capacity=4096):
    """Whole documents, gapless windows; padding as a share of all tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    of_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(of_doc) == set(docs)
    for doc_id, text in docs.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(of_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for members in windows.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += packing.slack(at, capacity)
    return padding / sum(r.length for r in rows)


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    assert check(queries.op7_packing(spark, sf_dir).collect(), docs) < 0.02


def test_awkward_rows(spark):
    texts = [None, "", "the " * 20_000, *AWKWARD]
    rows = [(i, t, 1, "s") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, offset int, part string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path).collect()
    check(got, dict((r[0], r[1]) for r in rows))
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    repeated = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "x", 0, "")], schema))
    got = packing.pack_documents(repeated, path, with_ids=False).collect()
    assert len([r for r in got if r.start == 0]) == 2 * len(rows) + 1
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_query_describes_the_packed_ids(spark, sf_dir, monkeypatch):
    other = bytes(range(12))
    pack = packing.pack
    monkeypatch.setattr(packing, "pack", lambda cut, capacity: pack(cut, capacity).withColumn("ids", F.when(F.col("ids").isNotNull(), F.lit(other))))
    got = queries.op7_packing(spark, sf_dir).select("length", "ids_crc32").distinct().collect()
    assert [tuple(r) for r in got] == [(3, zlib.crc32(other))]
