"""Byte-level BPE against the public library and against itself after edits."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tremorline.llm import byte_bpe, queries, tokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={}
    )


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


BITS = ["the", " the", "The ", "\n\n", "  ", " ", "é", "ß", "日本", "\U0001f600", "'s", "'", "don't", ".", "...", "1234", "\x1c", "\x85", "<|endoftext|>", "aaaa", "zq", "____", "\t", "$", "²"]


def random_text(rng, n):
    return "".join(rng.choices(BITS, k=rng.randint(0, n)))


def test_encoding_equals_the_library(library, vocabulary):
    rng = random.Random(1)
    for text in [*BITS, *(random_text(rng, 25) for _ in range(500)), "ab" * 700, "#" * 500, " " * 300 + "x"]:
        assert byte_bpe.encode(vocabulary, text) == library.encode_ordinary(text), text
        assert vocabulary.decode(byte_bpe.encode(vocabulary, text)) == text.encode()


def test_chunks_are_exact(library, vocabulary):
    rng = random.Random(2)
    texts = [random_text(rng, 30) for _ in range(500)]
    make = lambda t: np.array(byte_bpe.encode(vocabulary, t), "<u4").tobytes()
    encoder = tokens.ChunkEncoder(tokens.SPACED.findall, make, memory_bytes=20_000)
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_every_prefix_has_one_valid_last_token(vocabulary):
    data = "unbelievably internationalisation zzqx".encode()
    table = byte_bpe.PrefixTable(vocabulary, data)
    for end in range(1, len(data) + 1):
        assert vocabulary.merged(data[:end])[-1] == table.last[end]
        valid = [
            s for s in range(end)
            if data[s:end] in vocabulary.ranks and vocabulary.adjacent(table.last[s], vocabulary.ranks[data[s:end]])
        ]
        assert len(valid) == 1


def test_appends_and_edits_of_bytes(vocabulary):
    rng = random.Random(3)
    for _ in range(60):
        data = bytes(rng.choices(b"abcdeingthr ", k=rng.randint(0, 400)))
        table = byte_bpe.PrefixTable(vocabulary, data)
        for _ in range(4):
            a, b = sorted(rng.randint(0, len(data)) for _ in range(2))
            b = min(b, a + 6)
            new = bytes(rng.choices(b"abcing", k=rng.randint(0, 5)))
            table.replace(a, b, new)
            data = data[:a] + new + data[b:]
            assert (table.data, table.last) == (data, byte_bpe.PrefixTable(vocabulary, data).last)
        table.append(b"ing the")
        assert table.ids() == vocabulary.merged(data + b"ing the")


def test_appends_and_edits_of_texts(library, vocabulary):
    rng = random.Random(4)
    for _ in range(150):
        text = random_text(rng, 60)
        encoded = byte_bpe.EncodedText(vocabulary, text)
        for _ in range(5):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 5))
            new = random_text(rng, 3)
            encoded.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert encoded.text == text and encoded.ids() == library.encode_ordinary(text)
        encoded.append(" end")
        assert encoded.ids() == library.encode_ordinary(text + " end")


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((text or "").encode()).hexdigest()


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_byte_bpe(spark, sf_dir).collect()}
    assert got == {i: expected(library, t) for i, t in docs.items()}


def test_awkward_rows(spark, library):
    rows = [(None, "a", 1), (1, None, 2), (1, None, 2), (2, "", 0), (3, "word, " * 50_000, 0), (4, "x" * 3000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *expected(library, t)) for i, t, _ in rows), key=key)
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
