"""Periodic runs against a search of all stretches."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.llm import periodic_runs, queries


def brute_runs(words, min_length=6, min_exponent=4):
    """(start, length, period) of every run, by comparing words q apart for every q."""
    found, n = [], len(words)
    for q in range(1, n // min_exponent + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                length = i + q - start
                stretch = words[start : start + length]
                if length >= max(min_length, min_exponent * q) and not any(
                    stretch[d:] == stretch[:-d] for d in range(1, q)
                ):
                    found.append((start, length, q))
                start = None
    return sorted(found)


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def random_words(rng):
    k, words = rng.choice([1, 2, 3, 5, 50]), []
    for _ in range(rng.randint(0, 8)):
        if rng.random() < 0.6:
            pattern = [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 12))]
            words += (pattern * rng.randint(1, 9))[: rng.randint(1, 80)]
        else:
            words += [f"w{rng.randrange(k)}" for _ in range(rng.randint(0, 30))]
    return words


def test_z_function():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 25))]
        z = periodic_runs.z_function(s)
        assert z == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


@pytest.mark.parametrize("tile_words", [1, 40, 4096])
def test_runs_equal_brute_force(spark, tile_words):
    rng = random.Random(2)
    texts = {i: random_words(rng) for i in range(600)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = periodic_runs.find_runs(docs, tile_words=tile_words).collect()
    assert len(got) == len(texts) and sum(len(r.runs) for r in got) > 500
    for r in got:
        words = texts[r.row.doc_id]
        assert [(x.start, x.length, x.period) for x in r.runs] == brute_runs(words)
        assert r.text == brute_collapsed(words, brute_runs(words)) and r.n_words == len(words)


def test_long_documents(spark):
    rng = random.Random(3)
    free = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    texts = {
        0: free(5000) + free(3000) * 5 + free(100),
        1: ["a"] * 50_000,
        2: (free(700) * 9)[:6200] + ["b", "c"] * 4000,
        3: free(60_000),
        4: (["a"] * 5 + ["b"]) * 3000,
    }
    want = {0: [(5000, 15_000, 3000)], 1: [(0, 50_000, 1)], 2: [(0, 6200, 700), (6200, 8000, 2)], 3: [], 4: [(0, 18_000, 6)]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.row.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert {i: [(x.start, x.length, x.period) for x in r.runs] for i, r in got.items()} == want
    assert got[1].text == "a" and len(got[0].text.split()) == 8100


def test_awkward_rows(spark):
    schema = "doc_id long, text string, runs int, words string, part int"
    rows = [
        (1, None, 1, "w", 0), (2, "", 1, "w", 0), (3, " \t\n\x0b\f\r ", 1, "w", 0), (4, "a\xa0b " * 6, 1, "w", 0),
        (None, "x " * 7, 2, "v", 0), (5, "y y\ny\ty y y", 1, "w", 0), (5, "y y\ny\ty y y", 1, "w", 0), (6, "z z z z z", 1, "w", 0),
    ]
    docs = spark.createDataFrame(rows, schema).repartition(2)
    got = periodic_runs.find_runs(docs).collect()
    seen = sorted((r.row.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got)
    assert seen == [
        (0, 7, [(0, 7, 1)], "x"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "a\xa0b"),
        (5, 6, [(0, 6, 1)], "y"), (5, 6, [(0, 6, 1)], "y"), (6, 5, [], "z z z z z"),
    ]
    assert all(r.row.runs in (1, 2) and r.row.part == 0 for r in got)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, min_exponent=2)


def test_tiles_of_free_text_are_rare():
    rng = np.random.default_rng(4)
    assert len(periodic_runs.tiles(rng.integers(0, 10**6, 50_000).astype(np.int32))) < 5


def test_query(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words, h = split(text), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 3000:
            continue  # brute force takes time with the square of the words
        runs, r = brute_runs(words), got[doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        planted += bool(runs)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(brute_collapsed(words, runs).encode()).hexdigest()
    assert planted > 5


def test_tail_of_missing_ids_and_texts(spark):
    rows = [(None, "a b"), (1, None), (44, None), (44, ""), (44, "a b c d e f g h i j k l m n o p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = docs.select(queries._with_periodic_tail(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert [r.t for r in out][:3] == ["a b", None, None]
