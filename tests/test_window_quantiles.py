"""Quantiles of growing windows by levels, against numpy on every window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.features import window_quantiles as wq
from tremorline.features.rows import long_rows
from tremorline.operators.indexing import index_series
from tremorline.operators.rolling import expanding

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_select_equals_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        order, since, weight = rng.integers(0, 9, n), rng.integers(1, 6, n), rng.integers(1, 4, n)
        for end in np.unique(since):
            held = since <= end
            units = np.sort(np.repeat(order[held], weight[held]))
            ranks = np.arange(len(units))
            found, rest = wq.select(order, since, weight, np.full(len(ranks), end), ranks)
            assert found.tolist() == units.tolist()
            assert rest.tolist() == [int(r - (units < u).sum()) for r, u in zip(ranks, units)]


@pytest.mark.parametrize(("leaf", "bits"), [(1 << 14, 8), (64, 8), (4, 1), (5, 2)])
def test_quantiles_equal_numpy(spark, make_series, monkeypatch, leaf, bits):
    monkeypatch.setattr(wq, "LEAF", leaf)
    monkeypatch.setattr(wq, "FAN_BITS", bits)
    monkeypatch.setattr(wq, "FAN", 1 << bits)
    rng = np.random.default_rng(2)
    # ties, runs of one value, sorted values, a series of one row
    data = {
        1: (rng.normal(size=130), np.round(rng.normal(size=130), 0)),
        2: (np.arange(77.0), np.zeros(77)),
        3: (-np.arange(50.0), rng.integers(0, 3, 50)),
        4: ([7.0], [8.0]),
    }
    frames = expanding(index_series(make_series(data)), 0, 7)
    got = wq.window_quantiles(frames, long_rows(frames), "v", PROBABILITIES).collect()
    want = {
        (key, end, kind): np.quantile(np.asarray(values, float)[:end], PROBABILITIES)
        for key, pair in data.items()
        for kind, values in zip("xy", pair)
        for end in range(130 % 7, len(pair[0]) + 1, 7)
        if end > 0
    }
    assert len(want) > 50 and {(r["id"], r["end"], r["kind"]) for r in got} == set(want)
    for r in got:
        assert r["q"] == pytest.approx(want[r["id"], r["end"], r["kind"]], rel=1e-12, abs=1e-12)


def test_windows_count_their_own_rows(make_series, monkeypatch):
    monkeypatch.setattr(wq, "LEAF", 10)
    values = np.random.default_rng(3).normal(size=60)
    frames = expanding(index_series(make_series({1: (values, values)})), 0, 25)
    rows = long_rows(frames, ["x"]).filter(F.col("pos") % 3 == 0)
    got = {r["end"]: r["q"][0] for r in wq.window_quantiles(frames, rows, "v", [0.5]).collect()}
    assert got == {end: pytest.approx(np.median(values[:end:3])) for end in (10, 35, 60)}


def test_levels():
    assert [wq._depth(n) for n in (0, 1, wq.LEAF, wq.LEAF + 1, wq.LEAF * wq.FAN, wq.LEAF * wq.FAN + 1)] == [0, 0, 0, 1, 1, 2]
