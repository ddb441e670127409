"""SimHash near-deduplication against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tremorline.llm import queries, simhash


def brute_fingerprint(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=2):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def planted(rng, n=400):
    """Random fingerprints, chains two bits apart, and a dense ball around one of them."""
    values = [rng.getrandbits(64) for _ in range(n)]
    for start in values[:20]:
        v = start
        for _ in range(12):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.append(v)
    centre = values[0]
    values += [centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)]
    return values + [0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2]


@pytest.mark.parametrize("shard_size", [2000, 10])
def test_components_of_planted_fingerprints(spark, shard_size):
    values = list(dict.fromkeys(planted(random.Random(7))))
    want = brute_components(values)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    found = simhash.components(simhash.links(frame, 2, shard_size)).collect()
    roots = {v: v for v in map(signed, values)} | {r.node: r.root for r in found}
    assert len({(want[v], roots[signed(v)]) for v in values}) == len(set(want.values())) == len(set(roots.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_tree_finds_every_neighbour():
    rng = random.Random(11)
    values = list(dict.fromkeys(planted(rng, 200)))
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for probe in values[::7] + [rng.getrandbits(64)]:
        for radius in (0, 2, 9):
            assert sorted(tree.near(probe, radius)) == [i for i, v in enumerate(values) if (v ^ probe).bit_count() <= radius]


def test_awkward_rows(spark):
    texts = [None, "", " \n", "a", "A", "a b", "É x y z", "x y\vz \x1c w", "w " * 100_000, "w " * 100_001]
    rows = [(i, t, "f", 0) for i, t in enumerate(texts)] + [(None, "a b", "", 1), (None, "only me here", "", 1), (3, "a", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {brute_fingerprint(t) for _, t, *_ in rows}
    assert {r.fingerprint for r in got} == {signed(p) for p in prints}
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by_id == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}
    assert {r.component_id for r in got if r.doc_id is None} == {5, None}
    assert sorted(simhash.keep_one(docs).toPandas()["doc_id"].dropna()) == [0, 3, 3, 5, 6, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: brute_fingerprint(r.text) for r in queries.table(spark, sf_dir, "documents").collect()}
    root = brute_components(docs.values())
    lows = {}
    for i, p in docs.items():
        lows[root[p]] = min(lows.get(root[p], i), i)
    got = queries.op1_simhash_near_dedup(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", lows[root[p]]) for i, p in docs.items()}
