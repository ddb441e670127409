"""Spectra of short segments, wavelet responses at the start, drift polynomials."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.features.blocks import finished, packed, per_window, window_totals
from tremorline.features.rows import lagged_rows, long_rows
from tremorline.features.window_quantiles import window_quantiles
from tremorline.operators.rolling import Frames
from tremorline.session import stage

c = F.col

# Segment length and parameter grids of the feature catalogue.
SEGMENT = 256
DENSITY_COEFFS = (2, 5, 8)
ENTROPY_BINS = (2, 3, 5, 10, 100)
MOMENTS = ("centroid", "variance", "skew", "kurtosis")
WIDTHS = (2, 5, 10, 20)
WAVELET_COEFFS = 15
DRIFT_DEGREE, DRIFT_BINS = 3, 30
_WAVELET_HEAD = WAVELET_COEFFS + 10 * max(WIDTHS) // 2


def density_of(block: np.ndarray) -> np.ndarray:
    """One-sided power density of each line: mean-free, Hann-weighted."""
    size = block.shape[1]
    block = block - block.mean(axis=1, keepdims=True)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    if size == 1:
        window = np.ones(1)
    power = np.abs(np.fft.rfft(block * window, axis=1)) ** 2 / (window**2).sum()
    power[:, 1 : -1 if size % 2 == 0 else None] *= 2
    return power


def segment_density(values: Column) -> Column:
    """One-sided power density of equally long, mean-free, Hann-weighted segments."""

    @F.pandas_udf("array<double>")
    def finish(values: pd.Series) -> pd.Series:
        out: list = [None] * len(values)
        sizes = np.array([len(v) for v in values])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            power = density_of(np.vstack([values.iloc[i] for i in at]))
            for row, i in enumerate(at):
                out[i] = power[row]
        return pd.Series(out)

    return finish(values)


def window_density(frames: Frames, kinds: list[str] | None = None) -> DataFrame:
    """Average density per window: window keys, ``kind``, ``power`` (array by frequency).

    Windows of a full segment or more average the complete half-overlapping segments from
    the series start, each of which counts from the first window that contains it.
    Shorter windows are one segment of their own length.
    """
    rows = long_rows(frames, kinds).select(*frames.keys, "kind", "pos", "end", "last_end", "v")
    keys = [*frames.window_keys, "kind"]
    short = rows.filter(c("end") < SEGMENT).withColumn("last_end", F.least("last_end", F.lit(SEGMENT).cast("bigint")))
    short_windows = per_window(
        frames,
        packed(frames, short, ("v",)),
        short.filter(c("pos") == c("end") - 1).select(*keys),
        ("v",),
        (),
        lambda values, _: [density_of(values[0])],
        {"power": T.ArrayType(T.DoubleType())},
    ).select(*keys, "power")
    if frames.series.longest < SEGMENT:
        return short_windows
    half = SEGMENT // 2
    own = F.floor(c("pos") / half)
    inside = F.filter(F.array(own, own - 1), lambda m: (m >= 0) & (m * half + SEGMENT <= c("last_end")))
    pieces = (
        rows.withColumn("_m", F.explode(inside))
        .groupBy(*frames.keys, "kind", "_m")
        .agg(F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    )
    density = pieces.select(*keys, segment_density(F.transform("s", lambda s: s["v"])).alias("power"))
    per_end = density.select(*keys, F.posexplode("power").alias("f", "p")).groupBy(*keys, "f").agg(
        F.sum("p").alias("p"), F.count(F.lit(1)).alias("m")
    )
    # windows in which no segment ends still inherit the earlier ones
    ends = rows.filter((c("pos") == c("end") - 1) & (c("end") >= SEGMENT)).select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(half))).alias("f"), F.lit(0.0).alias("p"), F.lit(0).alias("m")
    )
    merged = per_end.unionByName(ends).groupBy(*keys, "f").agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
    summed = frames.upto(merged, {"all_p": (c("p"), "sum"), "all_m": (c("m"), "sum")}, ("f",))
    averaged = summed.select(*keys, "f", (c("all_p") / c("all_m")).alias("p"))
    as_array = F.transform(F.array_sort(F.collect_list(F.struct("f", "p"))), lambda s: s["p"])
    long_windows = averaged.groupBy(*keys).agg(as_array.alias("power"))
    return long_windows.unionByName(short_windows)


def density_entropy(power: np.ndarray, peak: np.ndarray, bins: int) -> np.ndarray:
    """Entropy of the histogram, of equal widths, of each density relative to its peak."""
    lines, size = power.shape
    place = power / peak
    low, high = place.min(axis=1, keepdims=True), place.max(axis=1, keepdims=True)
    low, high = np.where(low == high, low - 0.5, low), np.where(low == high, high + 0.5, high)
    edges = low + np.arange(bins + 1) * ((high - low) / bins)
    edges[:, -1:] = high
    at = np.minimum(((place - low) / (high - low) * bins).astype(np.int64), bins - 1)
    # a value within rounding of an edge goes by the edge
    at -= place < np.take_along_axis(edges, at, axis=1)
    at += (place >= np.take_along_axis(edges, at + 1, axis=1)) & (at != bins - 1)
    counts = np.bincount((at + bins * np.arange(lines)[:, None]).ravel(), minlength=lines * bins).reshape(lines, bins)
    share = counts / size
    return -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=1)


def _spectral(power: np.ndarray) -> dict[str, np.ndarray]:
    """Feature values of densities of one length, NaN where a feature is missing."""
    lines, size = power.shape
    none = np.full(lines, np.nan)
    values = {f"spkt_welch_density__coeff_{k}": power[:, k] if k < size else none for k in DENSITY_COEFFS}
    peak = power.max(axis=1, keepdims=True)
    flat = ~(peak[:, 0] > 0)
    for bins in ENTROPY_BINS:
        entropy = density_entropy(np.where(flat[:, None], 0.0, power), np.where(flat[:, None], 1.0, peak), bins)
        values[f"fourier_entropy__bins_{bins}"] = np.where(flat, np.nan, entropy)
    amplitude, order = np.sqrt(power), np.arange(size, dtype=float)
    mass = amplitude.sum(axis=1)
    with np.errstate(all="ignore"):
        m1, m2, m3, m4 = (np.where(mass == 0, np.nan, amplitude @ order**k / mass) for k in (1, 2, 3, 4))
        variance = m2 - m1 * m1
        skew = (m3 - 3 * m1 * variance - m1 * m1 * m1) / variance**1.5
        kurtosis = (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * m1 * m1 * m1 * m1) / (variance * variance)
    broad = variance >= 0.5
    moments = (m1, variance, np.where(broad, skew, np.nan), np.where(broad, kurtosis, np.nan))
    return values | {f'spectral_moments__aggtype_"{m}"': v for m, v in zip(MOMENTS, moments)}


def spectral_features(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Density at single frequencies, entropy of the density, moments of its amplitudes."""

    def finish(power: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = _spectral(power)
        found = np.stack([values[name] for name in names], axis=1)
        return found, np.isnan(found)

    return finished(window_density(frames, kinds), frames.window_keys, "power", list(names), finish)


def _wavelet_weights(size: int) -> np.ndarray:
    """Weights of the first rows of a window of that many rows, a column per width and position."""
    known = min(size, _WAVELET_HEAD)
    weights = np.zeros((known, len(WIDTHS) * WAVELET_COEFFS))
    for w, width in enumerate(WIDTHS):
        points = min(10 * width, size)
        offset = np.arange(points) - (points - 1) / 2
        shape = 2 / (np.sqrt(3 * width) * np.pi**0.25)
        wavelet = shape * (1 - (offset / width) ** 2) * np.exp(-(offset**2) / (2 * width**2))
        for k in range(WAVELET_COEFFS):
            tap = k + (points - 1) // 2 - np.arange(known)
            valid = (tap >= 0) & (tap < points)
            weights[valid, w * WAVELET_COEFFS + k] = wavelet[tap[valid]]
    return weights


def wavelet_features(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Ricker wavelet responses at the first positions. They depend on the first rows and
    the length of a window only, so one short list per series serves all its windows."""
    rows = long_rows(frames, kinds)
    heads = stage(
        rows.filter(c("pos") < _WAVELET_HEAD)
        .groupBy(*frames.keys, "kind")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
        .select(*frames.keys, "kind", F.transform("s", lambda s: s["v"]).alias("head")),
        "heads",
    )
    windows = rows.filter(c("pos") == c("end") - 1).select(*frames.window_keys, "kind").join(heads, [*frames.keys, "kind"])

    columns = [wavelet_names().index(name) for name in names]
    place = np.tile(np.arange(WAVELET_COEFFS), len(WIDTHS))

    def finish(heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(ends), len(place)))
        sizes = np.minimum(ends, 10 * max(WIDTHS))
        for size in np.unique(sizes):
            weights = _wavelet_weights(int(size))
            out[sizes == size] = heads[sizes == size, : len(weights)] @ weights
        return out[:, columns], (ends[:, None] <= place)[:, columns]

    return finished(windows, frames.window_keys, "head", list(names), finish)


def _cubics(x: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cubic fits, one a line, of the points that are ``there``, and where none is found: least
    squares of smallest norm on scaled powers."""
    lines, points = x.shape
    known = there.sum(axis=1)
    powers = np.where(there[:, :, None], x[:, :, None] ** np.arange(DRIFT_DEGREE, -1, -1), 0.0)
    scale = np.sqrt((powers * powers).sum(axis=1))
    fit = (known > 0) & (scale > 0).all(axis=1) & np.isfinite(scale).all(axis=1) & np.isfinite(np.where(there, y, 0.0)).all(axis=1)
    poly = np.full((lines, DRIFT_DEGREE + 1), np.nan)
    if fit.any():
        scale, known = scale[fit], known[fit]
        left, sizes, right = np.linalg.svd(powers[fit] / scale[:, None, :], full_matrices=False)
        least = known[:, None] * np.finfo(float).eps * sizes[:, :1]
        kept = (sizes > least) & (np.arange(sizes.shape[1]) < known[:, None])
        turned = np.einsum("lps,lp->ls", left, np.where(there, y, 0.0)[fit])
        turned = np.where(kept, turned / np.where(kept, sizes, 1.0), 0.0)
        poly[fit] = np.einsum("lsk,ls->lk", right, turned) / scale
    return poly, ~fit


def _largest_roots(poly: np.ndarray) -> np.ndarray:
    """Largest real part of the roots, one a line; NaN where there is no root."""
    out = np.full(len(poly), np.nan)
    full = (poly[:, 0] != 0) & (poly[:, -1] != 0)
    companion = np.zeros((int(full.sum()), DRIFT_DEGREE, DRIFT_DEGREE))
    companion[:, np.arange(1, DRIFT_DEGREE), np.arange(DRIFT_DEGREE - 1)] = 1.0
    companion[:, 0, :] = -poly[full, 1:] / poly[full, :1]
    usable = np.isfinite(companion).all(axis=(1, 2))
    found = np.full(len(companion), np.nan)
    found[usable] = np.linalg.eigvals(companion[usable]).real.max(axis=1)
    out[full] = found
    for line in np.flatnonzero(~full):
        roots = np.roots(poly[line])
        if len(roots):
            out[line] = np.max(roots.real)
    return out


def drift_features(
    frames: Frames, names: list[str], kinds: list[str] | None = None
) -> DataFrame:
    """Cubic fit of the mean step over 30 quantile bins of the value, and its largest root."""
    keys = [*frames.window_keys, "kind"]
    pairs = lagged_rows(long_rows(frames, kinds), frames.keys, [1]).filter(c("pos") >= 1)
    grid = [i / DRIFT_BINS for i in range(DRIFT_BINS + 1)]
    edges = window_quantiles(frames, pairs, "lag_1", grid)
    edges = stage(edges.filter(F.size(F.array_distinct("q")) == DRIFT_BINS + 1), "edges")

    def sums(rows: list[np.ndarray], stats: list[np.ndarray]) -> list[np.ndarray]:
        before, now = rows
        q = stats[0]
        # a bin includes its upper edge, which may sit on a value up to rounding
        inner = q[:, 1:-1] + 1e-12 * (q[:, -1:] - q[:, :1])
        out = np.empty((len(q), 3, DRIFT_BINS))
        if len(before) > 1:
            at = np.zeros(before.shape, np.int64)
            for edge in inner.T:
                at += before > edge[:, None]
            at = (at + DRIFT_BINS * np.arange(len(q))[:, None]).ravel()
            for i, weight in enumerate((np.ones(before.shape), before, now - before)):
                out[:, i] = np.bincount(at, weight.ravel(), DRIFT_BINS * len(q)).reshape(len(q), -1)
        else:
            for line, edges in enumerate(inner):
                at = np.searchsorted(edges, before[0], side="left")
                for i, weight in enumerate((np.ones(len(at)), before[0], now[0] - before[0])):
                    out[line, i] = np.bincount(at, weight, DRIFT_BINS)
        return [out.reshape(len(q), -1)]

    blocks = packed(frames, pairs, ("lag_1", "v"))
    found = per_window(frames, blocks, edges, ("lag_1", "v"), ("q",), sums, {"t": T.ArrayType(T.DoubleType())})
    totals = window_totals(frames, found, 3 * DRIFT_BINS)
    columns = [drift_names().index(name) for name in names]

    def finish(totals: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not totals.shape[1]:
            return np.zeros((len(ends), len(names))), np.ones((len(ends), len(names)), bool)
        count, before, step = np.moveaxis(totals.reshape(len(totals), 3, DRIFT_BINS), 1, 0)
        some = np.where(count > 0, count, 1.0)
        poly, failed = _cubics(before / some, step / some, count > 0)
        root = np.full(len(poly), np.nan)
        root[~failed] = _largest_roots(poly[~failed])
        values = np.column_stack([poly, root])
        return values[:, columns], np.isnan(values)[:, columns]

    # windows of one row or with coinciding quantiles have no bins and keep NULL
    windows = long_rows(frames, kinds).filter(c("pos") == c("end") - 1).select(*keys)
    return finished(windows.join(totals, keys, "left"), frames.window_keys, "t", list(names), finish)


def spectral_names() -> list[str]:
    return [
        *[f"spkt_welch_density__coeff_{k}" for k in DENSITY_COEFFS],
        *[f"fourier_entropy__bins_{b}" for b in ENTROPY_BINS],
        *[f'spectral_moments__aggtype_"{m}"' for m in MOMENTS],
    ]


def wavelet_names() -> list[str]:
    return [
        f"cwt_coefficients__coeff_{k}__w_{w}__widths_{WIDTHS}" for w in WIDTHS for k in range(WAVELET_COEFFS)
    ]


def drift_names() -> list[str]:
    stem = f"__m_{DRIFT_DEGREE}__r_{DRIFT_BINS}"
    return [
        *[f"friedrich_coefficients__coeff_{i}{stem}" for i in range(DRIFT_DEGREE + 1)],
        f"max_langevin_fixed_point{stem}",
    ]
