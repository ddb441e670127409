"""Blocks that answer all their windows at once, against the windows one by one."""

import brute
import numpy as np
import pytest

from tremorline.features import prefixes, windowed
from tremorline.features.prefixes import longest_runs, sums_within
from tremorline.features.registry import extract_features
from tremorline.operators.indexing import index_series
from tremorline.operators.rolling import expanding, whole_series
from tremorline.session import stage


@pytest.mark.parametrize("size", [1, 2, 7, 64, 300])
def test_runs_and_sums_of_a_block(size):
    rng = np.random.default_rng(size)
    rank = rng.permutation(size)
    wanted = rng.integers(0, size + 1, 20)
    assert longest_runs(rank, wanted).tolist() == [brute.longest_run(rank >= k) for k in wanted]
    low = np.round(rng.normal(0, 1, size), 1)
    high = low + np.round(rng.exponential(1, size), 1)
    terms = rng.normal(0, 1, (3, size)) * np.where(rng.random(size) < 0.1, 1e15, 1.0)
    for lowest, highest in zip(np.round(rng.normal(-1, 1, 40), 1), np.round(rng.normal(1, 2, 40), 1)):
        got = sums_within(low, high, terms, np.array([lowest]), np.array([highest]))[0]
        held = terms[:, (low >= lowest) & (high <= highest)]
        np.testing.assert_allclose(got, held.sum(axis=1), rtol=1e-12, atol=1e-12 * (1 + np.abs(held).sum()))


def test_a_spike_does_not_spoil_other_sums():
    low, terms = np.array([1.0, 2.0, 3.0, 9e15]), np.array([[0.1, 0.2, 0.3, 1e30]])
    got = sums_within(low, low, terms, np.array([2.0, 1.0]), np.array([3.0, 9e15]))
    assert got[0, 0] == 0.5 and got[1, 0] == 1e30


NAMES = [*windowed.strike_names(), 'change_quantiles__f_agg_"var"__isabs_True__qh_0.8__ql_0.2', 'change_quantiles__f_agg_"mean"__isabs_False__qh_0.6__ql_0.0']


def values(frames):
    return {(r["id"], r["end"], r["kind"], r["feature"]): r["value"] for r in extract_features(frames, NAMES).collect()}


@pytest.mark.parametrize("step", [7, 100, None])
def test_long_series_in_blocks_of_all_sizes(spark, make_series, monkeypatch, step):
    rng = np.random.default_rng(5)
    drift = np.round(np.cumsum(rng.normal(0, 1, 700)), 1)
    noise = rng.normal(0, 1, 700)
    noise[40:90] = 5.0
    data = {1: (drift, noise), 2: (np.zeros(300), np.sign(noise[:300])), 3: (drift[:30], noise[:30])}
    series = index_series(make_series(data))
    series = series.with_rows(stage(series.rows, "long"))
    some = expanding(series, 9, step) if step else whole_series(series)
    want = values(some)
    monkeypatch.setattr(windowed, "BLOCK", 16)
    monkeypatch.setattr(windowed.longest_strikes, "__defaults__", (None, 16))
    monkeypatch.setattr(prefixes, "SIZES", (4, 32, 128))
    monkeypatch.setattr(prefixes, "PART", 3)
    got = values(some)
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9, abs=1e-12), key


def test_pieces_of_a_window_are_few(spark, make_series):
    """Blocks of one size would give a window of 700 rows as many pieces as it has blocks."""
    series = index_series(make_series({1: (np.arange(700.0), np.ones(700))}))
    some = expanding(series.with_rows(stage(series.rows, "few")), 699, 700)
    size = lambda rows, stats: [np.full(len(stats[0]), rows[1].shape[-1])]
    from tremorline.features.rows import long_rows

    ends = windowed.window_stats(some)
    outputs = {"rows": windowed.T.LongType()}
    found = prefixes.per_prefix(some, long_rows(some, ["x"]), ends, ("mean",), size, size, outputs, (4, 32, 256))
    assert sorted((r["_block"] * 4, r["rows"]) for r in found.collect()) == [
        (0, 256), (256, 256), *[(512 + 32 * i, 32) for i in range(5)], *[(672 + 4 * i, 4) for i in range(7)]
    ]
