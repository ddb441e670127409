"""Hard negatives against all scores; bounds against the scores they bound."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, angle int, slot string"


def brute(rows, scale=256, positives=5, negatives=3, shares=(50, 95), every=50):
    """All scores of all anchors, sorted."""
    known = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known[i, tuple(math.floor(scale * float(np.float32(x))) for x in v), label] = None
    out = []
    for i, v, label in known:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in known if j != i)
        for score, j, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and shares[0] * -score <= -100 * s[0] <= shares[1] * -score]
            out += [(i, j, k, n, -score, -s) for k, (s, n, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, hn.mine(table, F.col("vec_id") % 50 == 0, **options).collect()))


def clustered(rng, n, dim=16, centres=12):
    means = rng.normal(size=(centres, dim))
    points = means[rng.integers(0, centres, n)] + 0.2 * rng.normal(size=(n, dim))
    points *= rng.uniform(0.2, 2, (n, 1))
    return [(i, [float(x) for x in p.astype(np.float32)], int(rng.integers(0, 4))) for i, p in enumerate(points)]


@pytest.mark.parametrize("options", [{}, {"window_rows": 7, "chunk_anchors": 9}, {"scale": 2}])
def test_equals_all_scores(spark, options):
    rows = clustered(np.random.default_rng(1), 1200)
    want = brute(rows, scale=options.get("scale", 256))
    assert len(want) > 100 and mined(spark, rows, **options) == want


def test_hot_vectors_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 600, dim=3, centres=3)
    rows = [(i, rows[1][1] if i % 3 else v, label) for i, v, label in rows]
    rows = [(i, [round(x) * 1.0 for x in v], label) for i, v, label in rows]
    assert mined(spark, rows, window_rows=16) == brute(rows)


def test_awkward_rows(spark):
    rows = clustered(np.random.default_rng(3), 300, dim=4)
    rows += rows[:60]  # repeated rows
    rows += [(None, [1.0] * 4, 1), (1000, None, 1), (1050, [], 1), (1100, [1.0, 2.0], 2), (1150, [0.0] * 4, 3), (1200, [1.0] * 4, None)]
    rows += [(1250, [1.0, None, 1.0, 1.0], 1), (1300, [math.inf, 1.0, 1.0, 1.0], 1), (1350, [math.nan] * 4, 1)]
    want = brute([(i, v + [0.0] * (4 - len(v)) if v is not None else None, label) for i, v, label in rows])
    assert mined(spark, rows, window_rows=32) == want
    assert mined(spark, []) == [] and mined(spark, [(1, None, 2)]) == [] and mined(spark, rows[1:40]) == []
    with pytest.raises(Exception, match="31 bits"):
        mined(spark, [(0, [1e12], 1), (1, [1e12], 1)])


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for _ in range(50):
        dim = int(rng.integers(1, 9))
        rows = rng.integers(-300, 300, (40, dim)) * rng.integers(0, 2, (40, 1))
        rows[:20] = rows[0] + rng.integers(-2, 3, (20, dim))
        directions = hn.references(rows, 4)
        norms, units = hn.unit(rows)
        angles = np.arccos(np.clip(units @ directions.T, -1, 1))
        for part in (slice(0, 20), slice(20, 40), slice(3, 4)):
            n = len(norms[part])
            window = hn.PackedWindow(
                {
                    "label": 1, "ids": np.arange(n).tobytes(), "is_anchor": np.zeros(n, bool).tobytes(),
                    "vectors": rows[part].astype("<i4").tobytes(), "norms": norms[part].tobytes(), "angles": angles[part].tobytes(),
                },
                dim,
            )
            low, high = hn.bounds(norms, angles, window)
            exact = rows @ rows[part].T
            assert (low <= exact.min(axis=1)).all() and (exact.max(axis=1) <= high).all()


def test_windows_of_clusters_are_skipped(monkeypatch):
    rng = np.random.default_rng(5)
    centres = np.eye(8) * 1000
    rows = (centres[np.arange(800) // 100] + rng.normal(size=(800, 8)) * 5).astype(np.int64)
    directions = hn.references(rows, 8)
    norms, units = hn.unit(rows)
    angles = np.arccos(np.clip(units @ directions.T, -1, 1))
    a = {"label": np.zeros(800), "id": np.arange(800), "vector": rows, "norm": norms, "angles": angles, "of": np.arange(800)}
    a |= {"low": np.full(800, 500_000), "high": np.full(800, 10**12)}
    scored = []
    product = hn.scores
    monkeypatch.setattr(hn, "scores", lambda x, y: scored.append(len(x) * len(y)) or product(x, y))
    best = hn.Best(a["low"], 5)
    for k in range(0, 800, 100):
        part = slice(k, k + 100)
        window = hn.PackedWindow(
            {
                "label": 0, "ids": np.arange(k, k + 100).tobytes(), "is_anchor": np.zeros(100, bool).tobytes(),
                "vectors": rows[part].astype("<i4").tobytes(), "norms": norms[part].tobytes(), "angles": angles[part].tobytes(),
            },
            8,
        )
        hn._score(window, a, np.arange(800), np.arange(801), best)
    assert sum(scored) == 8 * 100 * 100


def test_scores_beyond_doubles_are_exact():
    x = np.array([[(1 << 30) + 1, 3], [-(1 << 30), 1 << 30]])
    assert hn.scores(x, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in x] for p in x]
