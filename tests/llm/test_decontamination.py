"""The FM-index and the spans it finds, against plain searches."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.llm import decontamination

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, items, window):
    """Per document: words, hit places, items."""
    words = lambda t: WORD.findall(ascii_lower(t or ""))
    phrases = []
    for name, text in items:
        own = words(text)
        k = min(window, len(own))
        phrases += [(name, own[i : i + k]) for i in range(len(own) - k + 1) if own]
    out = []
    for text in docs:
        own, hit, names = words(text), set(), set()
        for name, phrase in phrases:
            for i in range(len(own) - len(phrase) + 1):
                if own[i : i + len(phrase)] == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    names |= {name} - {None}
        out.append((len(own), sorted(hit), sorted(names)))
    return out


def random_text(rng):
    return "".join(rng.choice(["a", "B", "c", "é", "É", "4x", "zz"]) + rng.choice([" ", ", ", "\n", "_", "-"]) for _ in range(rng.randint(0, 30)))


def random_sequence(rng):
    text = []
    for _ in range(rng.randint(1, 8)):
        text += [*(rng.randint(1, 3) for _ in range(rng.randint(0, 12))), 0]
    return np.array(text * rng.randint(1, 2), np.int32)


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(200):
        text = random_sequence(rng).tolist()
        zero = {p: k for k, p in enumerate(i for i, x in enumerate(text) if x == 0)}
        key = lambda i: [(0, zero[j]) if text[j] == 0 else (1, text[j]) for j in range(i, len(text))]
        assert decontamination.suffix_order(np.array(text, np.int32)).tolist() == sorted(range(len(text)), key=key)


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 64):
        symbols = rng.integers(0, size, 300)
        tree = decontamination.WaveletTree(symbols, size)
        at, asked = rng.integers(0, 301, 500), rng.integers(0, size, 500)
        assert tree.rank(asked, at).tolist() == [(symbols[:i] == c).sum() for i, c in zip(at, asked)]
        got, rank = tree.access(np.arange(300))
        assert got.tolist() == symbols.tolist()
        assert rank.tolist() == [(symbols[:i] == c).sum() for i, c in enumerate(symbols)]


@pytest.mark.parametrize("sample", [1, 3, 8])
def test_backward_search_finds_every_occurrence(sample):
    rng = random.Random(3)
    for _ in range(100):
        text = random_sequence(rng)
        phrases = [[rng.randint(1, 4) for _ in range(rng.randint(1, 5))] for _ in range(20)]
        table = np.zeros((20, 5), np.int32)
        for row, phrase in zip(table, phrases):
            row[: len(phrase)] = phrase
        index = decontamination.FMIndex(text, sample)
        for phrase, low, high in zip(phrases, *index.search(table, np.array([len(p) for p in phrases]))):
            want = [i for i in range(len(text)) if text[i : i + len(phrase)].tolist() == phrase]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == want


@pytest.mark.parametrize(("shard_words", "block_bytes"), [(1 << 20, 1 << 20), (7, 60)])
def test_spans_equal_brute_force(spark, shard_words, block_bytes):
    rng = random.Random(4)
    texts = [random_text(rng) for _ in range(150)]
    items = [(str(i), random_text(rng)[: rng.choice([6, 20, 40])]) for i in range(25)]
    items += [("7", items[3][1]), (None, "zz zz B"), ("x", None), ("y", "?!")]
    texts += [t + " " + i[1] for t, i in zip(texts[:20], items)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = decontamination.find(docs, benchmark, window=4, shard_words=shard_words, block_bytes=block_bytes)
    rows = found.select("*", decontamination.without_spans(F.col("row.text"), F.col("spans")).alias("rest")).collect()
    assert len(rows) == len(texts)
    want = brute(texts, items, 4)
    assert sum(bool(w[1]) for w in want) > 30
    for r in rows:
        text, (n_words, hit, names) = texts[r.row.doc_id], want[r.row.doc_id]
        assert (r.n_words, r["items"]) == (n_words, names)
        assert [w for s in r.spans for w in range(s.first_word, s.end_word)] == hit
        places = [(m.start(), m.end()) for m in WORD.finditer(text)]
        assert all((s.start, s.end) == (places[s.first_word][0], places[s.end_word - 1][1]) for s in r.spans)
        rest = text
        for s in reversed(r.spans):
            rest = rest[: s.start] + rest[s.end :]
        assert r.rest == rest


def test_long_documents_and_hot_passages(spark):
    passage = "this very passage is in the benchmark and in many many documents too"
    free = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [free(30_000, 0) + " " + passage + " " + free(10, 1), *[passage.upper()] * 3000, free(500, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    for shard_words in (1000, 29_995, 1 << 20):
        got = {r.row.doc_id: r for r in decontamination.find(docs, benchmark, shard_words=shard_words).collect()}
        assert [tuple(s)[:2] for s in got[0].spans] == [(30_000, 30_013)] and not got[3001].spans
        assert all([tuple(s)[:2] for s in got[i].spans] == [(0, 13)] for i in range(1, 3001))


def test_awkward_tables(spark):
    schema = "doc_id long, text string, items int, spans string, n_words int"
    docs = spark.createDataFrame([(1, None, 1, "s", 1), (None, "", 1, "s", 1), (2, "a b", 1, "s", 1), (2, "a b", 1, "s", 1)], schema)
    benchmark = spark.createDataFrame([(3, "A-b"), (4, None)], "item_id long, text string")
    got = sorted((r.row.doc_id or 0, r.n_words, len(r.spans), r["items"]) for r in decontamination.find(docs, benchmark).collect())
    assert got == [(0, 0, 0, []), (1, 0, 0, []), (2, 2, 1, ["3"]), (2, 2, 1, ["3"])]
    assert decontamination.find(docs.limit(0), benchmark).count() == 0
    assert all(not r.spans for r in decontamination.find(docs, benchmark.limit(0)).collect())
    assert {r.row.asDict()["items"] for r in decontamination.find(docs, benchmark).collect()} == {1}
