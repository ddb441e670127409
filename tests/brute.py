"""Plain numpy definitions of features, one window at a time."""

import itertools
import math

import numpy as np
import pandas as pd


def autocovariance(x, lag):
    d = x - x.mean()
    return d[: len(x) - lag] @ d[lag:]


def autocorrelation(x, lag):
    return autocovariance(x, lag) / ((len(x) - lag) * x.var())


def partial_autocorrelation(x, lag):
    """Last coefficient of the order-``lag`` Yule-Walker system."""
    if lag == 0:
        return 1.0
    r = np.array([autocovariance(x, k) / (len(x) - k) for k in range(lag + 1)])
    left = np.array([[r[abs(i - j)] for j in range(lag)] for i in range(lag)])
    return np.linalg.solve(left, r[1:])[-1]


def ar_coefficients(x, order=10):
    rows = np.column_stack([np.ones(len(x) - order)] + [x[order - k : len(x) - k] for k in range(1, order + 1)])
    return np.linalg.lstsq(rows, x[order:], rcond=None)[0]


def unit_root(x):
    depth = min(len(x) // 2 - 2, math.ceil(12 * (len(x) / 100) ** 0.25))
    step = np.diff(x)

    def design(lags, drop):
        at = np.arange(drop, len(step))
        columns = [np.ones(len(at)), x[at]] + [step[at - k] for k in range(1, lags + 1)]
        return np.column_stack(columns), step[at]

    def residual(a, b):
        w = np.linalg.lstsq(a, b, rcond=None)[0]
        return ((b - a @ w) ** 2).sum(), w

    scores = []
    for lags in range(depth + 1):
        a, b = design(lags, depth)
        scores.append(len(b) * math.log(residual(a, b)[0] / len(b)) + 2 * a.shape[1])
    used = int(np.argmin(scores))
    a, b = design(used, used)
    rss, w = residual(a, b)
    error = math.sqrt(rss / (len(b) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
    return w[1] / error, used


def drift(x, degree=3, bins=30):
    """Quantile edges at exact ranks; a bin includes its upper edge."""
    signal, step = x[:-1], np.diff(x)
    ranked = np.sort(signal)
    places = [divmod(i * (len(ranked) - 1), bins) for i in range(bins + 1)]
    edges = np.array([ranked[k] if not rest else ranked[k] + rest / bins * (ranked[k + 1] - ranked[k]) for k, rest in places])
    if len(np.unique(edges)) <= bins:
        return None
    at = np.searchsorted(edges[1:-1], signal, side="left")
    means = pd.DataFrame({"x": signal, "step": step}).groupby(at).mean()
    poly = np.polyfit(means["x"], means["step"], degree)
    return [*poly, np.roots(poly).real.max()]


def entropy(counts):
    p = counts[counts > 0] / counts.sum()
    return -(p * np.log(p)).sum()


def number_peaks(x, n):
    middle = x[n:-n]
    keep = np.ones(len(middle), bool)
    for k in range(1, n + 1):
        keep &= middle > x[n - k : len(x) - n - k]
        keep &= middle > x[n + k : len(x) - n + k]
    return keep.sum()


def longest_run(flags):
    return max((len(list(g)) for value, g in itertools.groupby(flags) if value), default=0)


def c3(x, lag):
    return (x[2 * lag :] * x[lag:-lag] * x[: -2 * lag]).mean()


def mass_quantile(x, q):
    mass = np.cumsum(np.abs(x)) / np.abs(x).sum()
    return (np.argmax(mass >= q) + 1) / len(x)


def permutation_entropy(x, dim):
    windows = np.lib.stride_tricks.sliding_window_view(x, dim)
    ranks = windows.argsort(axis=1, kind="stable").argsort(axis=1)
    counts = np.unique(ranks, axis=0, return_counts=True)[1]
    p = counts / counts.sum()
    return -(p * np.log(p)).sum()


def chunk_line(x, size, stat):
    parts = [x[i : i + size] for i in range(0, len(x), size)]
    y = np.array([getattr(p, stat)() for p in parts])
    k = np.arange(len(y))
    slope, intercept = np.polyfit(k, y, 1)
    return slope, intercept


def density(x, size=256):
    size = min(size, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = []
    for at in range(0, len(x) - size + 1, max(size // 2, 1)):
        part = x[at : at + size]
        power = np.abs(np.fft.rfft((part - part.mean()) * window)) ** 2 / (window**2).sum()
        power[1 : -1 if size % 2 == 0 else None] *= 2
        parts.append(power)
        if size < 256:
            break
    return np.mean(parts, axis=0)


def moments(power):
    """Moments of the amplitude over frequency numbers."""
    a = np.sqrt(power) / np.sqrt(power).sum()
    k = np.arange(len(a))
    m1 = (a * k).sum()
    return m1, (a * k**2).sum() - m1**2


def local_maxima(gain, order):
    m = len(gain)
    return [
        j
        for j in range(m)
        if all(gain[j] > gain[(j + s) % m] and gain[j] > gain[(j - s) % m] for s in range(1, order + 1))
    ]


def change_points(data, width, jump, min_size, count, cost):
    half, n = width // 2, len(data)
    ks = [k for k in range(0, n, jump) if half <= k < n - half]
    gain = [cost(data[k - half : k + half]) - cost(data[k - half : k]) - cost(data[k : k + half]) for k in ks]
    order = max(max(width, 2 * min_size) // (2 * jump), 1)
    peaks = sorted(((gain[j], ks[j]) for j in local_maxima(gain, order)), reverse=True)
    return sorted(k for _, k in peaks[:count]) + [n]


def l2(part):
    return part.var(axis=0).sum() * len(part)


def normal(part):
    return len(part) * np.linalg.slogdet(np.cov(part.T) + 1e-6 * np.eye(2))[1]
