"""Small numeric finishes on rows that are already aggregated (Arrow batches)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(function: Callable[[float], float], values: np.ndarray) -> np.ndarray:
    flat = np.asarray(values, float)
    return np.array([function(v) for v in flat.ravel()], float).reshape(flat.shape)


def _log_gamma(values: np.ndarray) -> np.ndarray:
    return _each(math.lgamma, values)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(z, float) for z in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(
            _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)
        ) / p
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        num, result = np.ones_like(d), d
        for m in range(1, 400):
            settled = result
            for step in (
                m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + step * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                num = 1 + step / num
                num = np.where(np.abs(num) < tiny, tiny, num)
                result = result * d * num
            if np.array_equal(settled, result, equal_nan=True):
                break
        value = np.where(y <= 0, 0.0, front * result)
    return np.where(flip, 1 - value, value)


def student_two_sided(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def finish(t: pd.Series, df: pd.Series) -> pd.Series:
        stat, free = t.to_numpy(float), df.to_numpy(float)
        ok = np.isfinite(stat) & (free > 0)
        out = np.full(len(stat), np.nan)
        out[ok] = incomplete_beta(free[ok] / 2, 0.5, free[ok] / (free[ok] + stat[ok] ** 2))
        return pd.Series(out).where(np.isfinite(out), None)

    return finish(t, df)


def normal_two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def finish(z: pd.Series) -> pd.Series:
        return pd.Series(_each(math.erfc, np.abs(z.to_numpy(float)) / math.sqrt(2)))

    return finish(z)


def _lines(lists: pd.Series, width: int) -> np.ndarray:
    """Lists as lines of an array, cut or filled up with NaN to ``width``."""
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate(lists.to_numpy()).astype(float) if sizes.sum() else np.zeros(0)
    place = np.arange(width)
    starts = np.cumsum(sizes) - sizes
    there = place < sizes[:, None]
    out = np.full((len(sizes), width), np.nan)
    out[there] = flat[(starts[:, None] + place)[there]]
    return out


def _before(values: np.ndarray) -> np.ndarray:
    """Running sums along a line, from zero."""
    return np.concatenate([np.zeros((len(values), 1)), np.cumsum(values, axis=1)], axis=1)


def _cut(values: np.ndarray, there: np.ndarray) -> pd.Series:
    """Lists of the lines, with nothing where ``there`` does not hold."""
    out = values.tolist()
    for line in np.flatnonzero(~there.all(axis=1)):
        out[line] = [x if known else None for x, known in zip(out[line], there[line])]
    return pd.Series(out, dtype=object)


def lag_covariances(
    products: Column, head: Column | str, tail: Column | str, s1: Column | str, n: Column | str) -> Column:
    """Sums of (x_t - mean)(x_{t+lag} - mean) by lag: plain lag products, corrected by the
    values a shift leaves out at either edge. NULL for lags the window is too short for."""

    @F.pandas_udf("array<double>")
    def finish(products: pd.Series, head: pd.Series, tail: pd.Series, s1: pd.Series, n: pd.Series) -> pd.Series:
        if not len(products):
            return pd.Series([], dtype=object)
        prod = np.stack(products.to_numpy())
        lag = np.arange(prod.shape[1])
        total, size = s1.to_numpy(float)[:, None], n.to_numpy()[:, None]
        mean = total / size
        lead, late = (_before(_lines(x, prod.shape[1] - 1)) for x in (head, tail))
        sums = prod - mean * (2 * total - lead - late) + (size - lag) * mean**2
        return _cut(sums, lag < size)

    return finish(products, head, tail, s1, n)


def partial_autocorrelations(covariances: Column, n: Column | str) -> Column:
    """Durbin-Levinson recursion on ten autocovariances; at most half the sample is used."""

    @F.pandas_udf("array<double>")
    def finish(covariances: pd.Series, n: pd.Series) -> pd.Series:
        if not len(covariances):
            return pd.Series([], dtype=object)
        cov = np.stack([np.asarray(x, float) for x in covariances])
        lag = np.arange(cov.shape[1])
        depth = np.minimum(len(lag) - 1, n.to_numpy() // 2 - 1)
        there = (lag <= depth[:, None]) & (depth > 0)[:, None] & (cov[:, :1] != 0)
        values = np.ones_like(cov)
        phi, noise = np.zeros((len(cov), 0)), cov[:, 0]
        with np.errstate(all="ignore"):
            for k in range(1, len(lag)):
                reflection = (cov[:, k] - (phi * cov[:, k - 1 : 0 : -1]).sum(axis=1)) / noise
                phi = np.column_stack([phi - reflection[:, None] * phi[:, ::-1], reflection])
                noise = noise * (1 - reflection**2)
                values[:, k] = reflection
        return _cut(values, there)

    return finish(covariances, n)


def lag_gram(
    products: np.ndarray, first: np.ndarray, newest: np.ndarray, total: np.ndarray, order: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x_{t-i} and of x_{t-i} x_{t-j} over t >= ``order``, i and j up to ``order``, per line.

    Full-length lag products lose the pairs among the ``first`` values that precede the
    sum and those among the ``newest`` (latest first) that a shift leaves out.
    """
    lead, late = _before(first[:, :order]), _before(newest[:, :order])
    index = np.arange(order + 1)
    sums = total[:, None] - lead[:, order - index] - late[:, index]
    gram = np.empty((len(total), order + 1, order + 1))
    for gap in range(order + 1):
        lead = _before(first[:, : order - gap] * first[:, gap:order])
        late = _before(newest[:, : order - gap] * newest[:, gap:order])
        i = np.arange(order + 1 - gap)
        found = products[:, gap, None] - lead[:, order - gap - i] - late[:, i]
        gram[:, i, i + gap] = found
        gram[:, i + gap, i] = found
    return sums, gram


def _solvable(lines: np.ndarray, solve: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """What ``solve`` finds for many lines at once; NaN for lines that have no solution, which
    are set apart by halving."""
    try:
        return solve(lines)
    except np.linalg.LinAlgError:
        if len(lines) == 1:
            return np.full((1, width), np.nan)
        halves = np.array_split(lines, 2)
        return np.concatenate([_solvable(half, solve, width) for half in halves])


def ar_coefficients(products: Column, head: Column, tail: Column, s1: Column, n: Column, center: Column) -> Column:
    """Intercept and ten lag weights of the least squares autoregression."""

    @F.pandas_udf("array<double>")
    def finish(
        products: pd.Series, head: pd.Series, tail: pd.Series, s1: pd.Series, n: pd.Series, center: pd.Series
    ) -> pd.Series:
        order = 10
        out = np.full(len(n), None, object)
        lines = np.flatnonzero(n.to_numpy() >= 2 * order + 1)  # else fewer equations than unknowns
        if not len(lines):
            return pd.Series(out)
        prod = np.stack(products.to_numpy()[lines])
        first, last = (_lines(x.iloc[lines], order) for x in (head, tail))
        total, size, origin = (x.to_numpy(float)[lines] for x in (s1, n, center))
        sums, gram = lag_gram(prod, first, last, total, order)
        left = gram.copy()
        left[:, 0, 0] = size - order
        left[:, 0, 1:] = left[:, 1:, 0] = sums[:, 1:]
        right = np.concatenate([sums[:, :1], gram[:, 0, 1:]], axis=1)

        def solve(some: np.ndarray) -> np.ndarray:
            return np.linalg.solve(left[some], right[some][:, :, None])[:, :, 0]

        weights = _solvable(np.arange(len(lines)), solve, order + 1)
        failed = np.isnan(weights).all(axis=1)
        weights[:, 0] += origin * (1 - weights[:, 1:].sum(axis=1))
        for line, values, none in zip(lines, weights.tolist(), failed):
            out[line] = None if none else values
        return pd.Series(out)

    return finish(products, head, tail, s1, n, center)


# Published response surface for the unit root p-value with a constant.
UNIT_ROOT_MAX, UNIT_ROOT_MIN, UNIT_ROOT_SPLIT = 2.74, -18.83, -1.61
UNIT_ROOT_SMALL = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p_value(stat: float) -> float:
    if stat > UNIT_ROOT_MAX:
        return 1.0
    if stat < UNIT_ROOT_MIN:
        return 0.0
    surface = UNIT_ROOT_SMALL if stat <= UNIT_ROOT_SPLIT else UNIT_ROOT_LARGE
    z = sum(weight * stat**power for power, weight in enumerate(surface))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def unit_root_depth(n: int) -> int:
    """Largest number of lagged steps tried for a series of n values."""
    return min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))


def _step_equations(
    products: np.ndarray, first: np.ndarray, newest: np.ndarray, total: np.ndarray, n: np.ndarray, depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """Cross products of (1, x_{t-1}, steps t-1 .. t-depth, step t) over t > depth, per line."""
    order = depth + 1
    sums, gram = lag_gram(products, first, newest, total, order)
    to_steps = np.zeros((depth + 2, order + 1))
    to_steps[0, 1] = 1.0
    for i in range(1, depth + 1):
        to_steps[i, i], to_steps[i, i + 1] = 1.0, -1.0
    to_steps[depth + 1, 0], to_steps[depth + 1, 1] = 1.0, -1.0
    rows = n - order
    full = np.empty((len(n), depth + 3, depth + 3))
    full[:, 0, 0] = rows
    full[:, 0, 1:] = full[:, 1:, 0] = sums @ to_steps.T
    full[:, 1:, 1:] = to_steps @ gram @ to_steps.T
    return full, rows


def unit_root_test(products: Column, head: Column, tail: Column, s1: Column, n: Column | str) -> Column:
    """Statistic, p-value and lag of the augmented unit root regression; the lag has the
    smallest Akaike criterion."""

    @F.pandas_udf("array<double>")
    def finish(products: pd.Series, head: pd.Series, tail: pd.Series, s1: pd.Series, n: pd.Series) -> pd.Series:
        out = np.full(len(n), None, object)
        total, size = s1.to_numpy(float), n.to_numpy()
        depths = np.array([unit_root_depth(int(x)) for x in size], np.int64)
        level = np.array([x[0] > 0 for x in products], bool)

        def equations(lines: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
            prod = np.stack([x[: depth + 2] for x in products.iloc[lines]])
            first, last = (_lines(x.iloc[lines], depth + 1) for x in (head, tail))
            return _step_equations(prod, first, last, total[lines], size[lines], depth)

        for depth in np.unique(depths[level & (depths >= 0)]):
            lines = np.flatnonzero(level & (depths == depth))
            full, rows = equations(lines, int(depth))

            def scored(some: np.ndarray) -> np.ndarray:
                # nested fits share one factorisation: each column lowers the residual
                lower = np.linalg.cholesky(full[some, :-1, :-1])
                gains = np.linalg.solve(lower, full[some, :-1, -1:])[:, :, 0] ** 2
                residual = full[some, -1, -1][:, None] - np.cumsum(gains, axis=1)[:, 1:]
                akaike = rows[some, None] * np.log(residual / rows[some, None]) + 2 * np.arange(2, depth + 3)
                return np.argmin(akaike, axis=1)[:, None].astype(float)

            with np.errstate(all="ignore"):
                best = _solvable(np.arange(len(lines)), scored, 1)[:, 0]
                for used in np.unique(best[~np.isnan(best)]).astype(int):
                    mine = lines[best == used]
                    some_full, some_rows = equations(mine, used)

                    def tested(some: np.ndarray) -> np.ndarray:
                        inverse = np.linalg.inv(some_full[some, :-1, :-1])
                        right = some_full[some, :-1, -1]
                        weights = (inverse @ right[:, :, None])[:, :, 0]
                        residual = some_full[some, -1, -1] - (weights * right).sum(axis=1)
                        square = residual / (some_rows[some] - used - 2) * inverse[:, 1, 1]
                        return np.column_stack([weights[:, 1] / np.sqrt(square), square < 0])

                    for line, (stat, negative) in zip(mine, _solvable(np.arange(len(mine)), tested, 2)):
                        if negative == 0:
                            out[line] = [float(stat), unit_root_p_value(float(stat)), float(used)]
        return pd.Series(out)

    return finish(products, head, tail, s1, n)
