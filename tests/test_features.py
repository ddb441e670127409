"""Features against numpy, on series longer than one block and with several windows."""

import math

import numpy as np
import pytest

from pyspark.sql import types as T

import brute
from tremorline.features import blocks, segments, windowed
from tremorline.features.blocks import packed, per_window
from tremorline.features.finishing import incomplete_beta, unit_root_p_value
from tremorline.features.registry import (
    efficient,
    extract_features,
    families,
    from_columns,
    impute,
    matrix_columns,
    minimal,
    to_matrix,
)
from tremorline.features.rows import long_rows
from tremorline.operators.indexing import BLOCK_ROWS, index_series
from tremorline.operators.rolling import expanding, whole_series
from tremorline.session import stage

LONG = BLOCK_ROWS + 1200
STEP, SHORTEST = 11_000, 9_000


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    noise = rng.normal(0, 1, LONG)
    ar = np.zeros(LONG)
    for i in range(1, LONG):
        ar[i] = 0.7 * ar[i - 1] + noise[i]
    wave = np.round(np.sin(np.arange(LONG) / 9) * 3 + rng.normal(5, 1, LONG), 2)
    wave[BLOCK_ROWS - 30 : BLOCK_ROWS + 40] = 30 + np.arange(70)  # a run across the block edge
    short = rng.normal(0, 1, 9_500)
    return {1: (ar, wave), 2: (short, np.round(short, 1))}


@pytest.fixture(scope="module")
def frames(spark, data):
    import datetime

    import pandas as pd

    start = np.datetime64(datetime.datetime(2023, 1, 1), "us")
    pdf = pd.concat(
        pd.DataFrame({"id": k, "time": start + np.arange(len(x)) * np.timedelta64(1, "s"), "x": x, "y": y})
        for k, (x, y) in data.items()
    )
    table = spark.createDataFrame(pdf.sample(frac=1, random_state=1), "id int, time timestamp_ntz, x double, y double")
    series = index_series(table)
    return expanding(series.with_rows(stage(series.rows, "test")), SHORTEST, STEP)


@pytest.fixture(scope="module")
def windows(data):
    longest = max(len(x) for x, _ in data.values())
    ends = [e for e in range(longest % STEP, longest + 1, STEP) if e > SHORTEST]
    return {
        (key, e, kind): values[:e]
        for key, pair in data.items()
        for kind, values in zip("xy", pair)
        for e in ends
        if e <= len(values)
    }


def extracted(frames, names):
    rows = extract_features(frames, names).collect()
    return {(r["id"], r["end"], r["kind"], r["feature"]): r["value"] for r in rows}


def check(frames, windows, definitions, rel=1e-7, abs_=1e-9):
    got = extracted(frames, list(definitions))
    assert len(got) == len(windows) * len(definitions)
    for (key, end, kind), x in windows.items():
        for name, define in definitions.items():
            want, value = define(x), got[(key, end, kind, name)]
            if want is None:
                assert value is None
            else:
                assert value == pytest.approx(want, rel=rel, abs=abs_), (name, key, end, kind)


def test_lag_features_cross_blocks(frames, windows):
    names = {f"number_peaks__n_{n}": (lambda x, n=n: brute.number_peaks(x, n)) for n in (1, 10, 50)}
    names |= {f"c3__lag_{k}": (lambda x, k=k: brute.c3(x, k)) for k in (1, 3)}
    names |= {f"autocorrelation__lag_{k}": (lambda x, k=k: brute.autocorrelation(x, k)) for k in (0, 1, 9)}
    names |= {f"partial_autocorrelation__lag_{k}": (lambda x, k=k: brute.partial_autocorrelation(x, k)) for k in (0, 1, 2, 9)}
    names |= {f"ar_coefficient__coeff_{k}__k_10": (lambda x, k=k: brute.ar_coefficients(x)[k]) for k in (0, 1, 10)}
    lags = lambda x: np.array([brute.autocorrelation(x, k) for k in range(1, 41)])
    names['agg_autocorrelation__f_agg_"median"__maxlag_40'] = lambda x: np.median(lags(x))
    names['agg_autocorrelation__f_agg_"var"__maxlag_40'] = lambda x: lags(x).var()
    check(frames, windows, names, rel=1e-6, abs_=1e-8)


def test_unit_root(frames, windows):
    stem = 'augmented_dickey_fuller__attr_"{}"__autolag_"AIC"'
    names = {
        stem.format("teststat"): lambda x: brute.unit_root(x)[0],
        stem.format("usedlag"): lambda x: brute.unit_root(x)[1],
        stem.format("pvalue"): lambda x: unit_root_p_value(brute.unit_root(x)[0]),
    }
    check(frames, windows, names, rel=1e-5)


def test_unit_root_p_values_are_monotone():
    p = [unit_root_p_value(s) for s in np.linspace(-20, 3, 200)]
    assert all(a <= b + 1e-6 for a, b in zip(p, p[1:]))
    assert unit_root_p_value(-2.86) == pytest.approx(0.05, abs=2e-3)
    assert unit_root_p_value(-3.43) == pytest.approx(0.01, abs=1e-3)


def test_window_comparisons(frames, windows):
    names = {
        "longest_strike_above_mean": lambda x: brute.longest_run(x > x.mean()),
        "longest_strike_below_mean": lambda x: brute.longest_run(x < x.mean()),
        "count_above_mean": lambda x: (x > x.mean()).sum(),
        "index_mass_quantile__q_0.7": lambda x: brute.mass_quantile(x, 0.7),
        "ratio_beyond_r_sigma__r_1.5": lambda x: (np.abs(x - x.mean()) > 1.5 * x.std()).mean(),
        "binned_entropy__max_bins_10": lambda x: brute.entropy(np.histogram(x, 10)[0]),
        "energy_ratio_by_chunks__num_segments_10__segment_focus_0": lambda x: (np.array_split(x, 10)[0] ** 2).sum() / (x @ x),
        "energy_ratio_by_chunks__num_segments_10__segment_focus_9": lambda x: (np.array_split(x, 10)[9] ** 2).sum() / (x @ x),
        "median": np.median,
        "quantile__q_0.9": lambda x: np.quantile(x, 0.9),
        "mean_n_absolute_max__number_of_maxima_7": lambda x: np.sort(np.abs(x))[-7:].mean(),
        "ratio_value_number_to_time_series_length": lambda x: len(np.unique(x)) / len(x),
    }
    check(frames, windows, names)


@pytest.mark.parametrize("rows", [64, 1000])
def test_strikes_do_not_depend_on_blocks(frames, rows):
    names = windowed.strike_names()
    got = {tuple(r) for r in windowed.longest_strikes(frames, names, block_rows=rows).collect()}
    assert got == {tuple(r) for r in windowed.longest_strikes(frames, names).collect()}


def test_quantiles_of_windows(frames, windows):
    names = ["median", "quantile__q_0.1", "quantile__q_0.9"]
    rows = windowed.quantile_features(frames, names).collect()
    got = {(r["id"], r["end"], r["kind"], r["feature"]): r["value"] for r in rows}
    for (key, end, kind), x in windows.items():
        for name, q in zip(names, (0.5, 0.1, 0.9)):
            assert got[(key, end, kind, name)] == pytest.approx(np.quantile(x, q), abs=1e-12)


def test_patterns_and_chunks(frames, windows):
    names = {f"permutation_entropy__dimension_{d}__tau_1": (lambda x, d=d: brute.permutation_entropy(x, d)) for d in (3, 7)}
    for size in (5, 50):
        for stat in ("max", "var"):
            stem = f'__chunk_len_{size}__f_agg_"{stat}"'
            names['agg_linear_trend__attr_"slope"' + stem] = lambda x, s=size, g=stat: brute.chunk_line(x, s, g)[0]
            names['agg_linear_trend__attr_"intercept"' + stem] = lambda x, s=size, g=stat: brute.chunk_line(x, s, g)[1]
    check(frames, windows, names, rel=1e-6, abs_=1e-9)


def test_spectra(frames, windows):
    names = {f"spkt_welch_density__coeff_{k}": (lambda x, k=k: brute.density(x)[k]) for k in (2, 8)}
    names['spectral_moments__aggtype_"centroid"'] = lambda x: brute.moments(brute.density(x))[0]
    names['spectral_moments__aggtype_"variance"'] = lambda x: brute.moments(brute.density(x))[1]
    for k in (0, 1, 99):
        names[f'fft_coefficient__attr_"real"__coeff_{k}'] = lambda x, k=k: np.fft.rfft(x)[k].real
        names[f'fft_coefficient__attr_"abs"__coeff_{k}'] = lambda x, k=k: abs(np.fft.rfft(x)[k])
    check(frames, windows, names, rel=1e-7, abs_=1e-6)


def test_drift(frames, windows):
    names = {f"friedrich_coefficients__coeff_{i}__m_3__r_30": (lambda x, i=i: (brute.drift(x) or [None] * 5)[i]) for i in range(4)}
    names["max_langevin_fixed_point__m_3__r_30"] = lambda x: (brute.drift(x) or [None] * 5)[4]
    check(frames, windows, names, rel=1e-5, abs_=1e-8)


def test_trend_p_value():
    grid = np.linspace(-400, 400, 2_000_001)
    for t, df in ((0.3, 5), (2.5, 12), (-4.0, 80)):
        log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
        pdf = np.exp(log_c - (df + 1) / 2 * np.log1p(grid**2 / df))
        want = 2 * np.trapezoid(pdf[grid >= abs(t)], grid[grid >= abs(t)])
        assert float(incomplete_beta(df / 2, 0.5, df / (df + t * t))) == pytest.approx(want, rel=1e-3)


def test_block_and_whole_series_paths_agree(spark, frames):
    """A window of an expanding series has the features of the same rows as a series."""
    names = ["abs_energy", "skewness", "number_peaks__n_5", "sum_of_reoccurring_values", "cid_ce__normalize_True", "has_duplicate_max"]
    rows = frames.exploded().select("id", "end", "time", "x", "y").withColumnRenamed("end", "window")
    alone = whole_series(index_series(rows, ("id", "window")))
    got = {(r["id"], r["window"], r["kind"], r["feature"]): r["value"] for r in extract_features(alone, names).collect()}
    want = extracted(frames, names)
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9, abs=1e-9)


def test_constant_and_tiny_series(spark, make_series):
    table = make_series({1: ([2.0] * 40, [0.0] * 40), 2: ([1.0], [3.0]), 3: ([1.0, 2.0, 4.0], [5.0, 5.0, 1.0])})
    frames = whole_series(index_series(table))
    got = extracted(frames, efficient())
    assert len(got) == 6 * len(efficient())
    assert got[(1, 40, "x", "variance")] == 0.0
    assert got[(1, 40, "x", "skewness")] == 0.0
    assert got[(1, 40, "x", "autocorrelation__lag_1")] is None
    assert got[(1, 40, "y", "variation_coefficient")] is None
    assert got[(1, 40, "x", 'change_quantiles__f_agg_"mean"__isabs_False__qh_0.4__ql_0.0')] == 0.0
    assert got[(2, 1, "x", "mean_abs_change")] is None
    assert got[(2, 1, "x", "longest_strike_above_mean")] == 0.0
    assert got[(2, 1, "x", "mean_n_absolute_max__number_of_maxima_3")] is None
    assert got[(3, 3, "x", "mean_change")] == 1.5
    assert got[(3, 3, "x", "c3__lag_1")] == 8.0
    assert got[(3, 3, "x", "c3__lag_2")] == 0.0
    assert got[(3, 3, "y", "has_duplicate_max")] == 1.0
    assert got[(3, 3, "x", 'fft_coefficient__attr_"abs"__coeff_2')] is None
    nan = [key for key, value in got.items() if value is not None and math.isnan(value)]
    assert nan == []


def test_missing_values_are_refused(spark, make_series):
    table = make_series({1: ([1.0, 2.0], [1.0, 2.0])}).selectExpr("id", "time", "nullif(x, 1.0) AS x", "y")
    with pytest.raises(ValueError):
        extract_features(whole_series(index_series(table)), minimal())


def test_names():
    names = efficient()
    assert len(names) == len(set(names))
    assert sum(len(n) for _, n in families().values()) == len(names)
    spec = {"x": ["mean", "quantile__q_0.1"], "y": ['fft_coefficient__attr_"abs"__coeff_7']}
    assert from_columns(matrix_columns(spec)) == spec
    with pytest.raises(ValueError):
        from_columns(["x__no_such_feature"])


def test_matrix_and_impute(spark):
    inf = float("inf")
    rows = [(1, "x", "a", 1.0), (2, "x", "a", inf), (3, "x", "a", -inf), (4, "x", "a", None), (5, "x", "a", 4.0),
            (1, "y", "b", None), (2, "y", "b", float("nan"))]
    long = spark.createDataFrame(rows, "w int, kind string, feature string, value double")
    filled = {(r["w"], r["kind"]): r["value"] for r in impute(long, ["w"]).collect()}
    assert filled == {(1, "x"): 1.0, (2, "x"): 4.0, (3, "x"): 1.0, (4, "x"): 2.5, (5, "x"): 4.0, (1, "y"): 0.0, (2, "y"): 0.0}
    wide = to_matrix(impute(long, ["w"]), ["w"], ["x__a", "y__b"])
    assert sorted(wide.columns) == ["w", "x__a", "y__b"] and wide.count() == 5


def test_pieces_of_many_series_are_computed_together(spark, make_series):
    rng = np.random.default_rng(3)
    sizes = [30 + i % 3 for i in range(60)]
    series = index_series(make_series({i: (rng.normal(0, 1, n), rng.normal(0, 1, n)) for i, n in enumerate(sizes)}))
    some = expanding(series.with_rows(stage(series.rows, "many")), 9, 10)
    calls, windows = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def means(rows, stats):
        calls.add(1)
        windows.add(len(stats[0]))
        return [rows[0].mean(axis=1) + 0.0 * stats[0]]

    long = long_rows(some)
    ends = long.filter("pos = end - 1").selectExpr("id", "end", "kind", "end AS length")
    found = per_window(some, packed(some, long, ("v",)), ends, ("v",), ("length",), means, {"m": T.LongType()})
    assert found.count() == windows.value == ends.count()
    assert calls.value < windows.value / 3


def test_lag_products_do_not_depend_on_blocks(spark, make_series, monkeypatch):
    rng = np.random.default_rng(4)
    series = index_series(make_series({1: (rng.normal(0, 1, 90), rng.normal(0, 1, 90)), 2: (rng.normal(0, 1, 45), rng.normal(5, 2, 45))}))
    some = expanding(series.with_rows(stage(series.rows, "lags")), 9, 10)
    names = ["autocorrelation__lag_3", "ar_coefficient__coeff_2__k_10", *segments.unit_root_names()]

    def rows():
        found = extract_features(some, names).collect()
        return {(r["id"], r["end"], r["kind"], r["feature"]): r["value"] for r in found}

    want = rows()
    for module in (segments, blocks):
        monkeypatch.setattr(module, "BLOCK", 32)
    monkeypatch.setattr(segments, "window_totals", lambda f, t, width: blocks.window_totals(f, t, width, 32))
    got = rows()
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == value or got[key] == pytest.approx(value, rel=1e-6, abs=1e-9), key
