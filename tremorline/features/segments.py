"""Features whose statistics merge: each row is aggregated once, in the segment between
two window ends, and segment results are accumulated over the ends of a series.

Aggregates and values are SQL expressions over the columns of ``long_rows``."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.features.blocks import BLOCK, lists_of, spread, struct_fields, window_totals
from tremorline.features.finishing import (
    ar_coefficients,
    lag_covariances,
    partial_autocorrelations,
    student_two_sided,
    unit_root_depth,
    unit_root_test,
)
from tremorline.features.rows import as_long, lagged_rows, long_rows
from tremorline.operators.indexing import with_halo
from tremorline.operators.rolling import Frames


@dataclass(frozen=True)
class Partial:
    """An aggregate over a segment and how segments merge: sum, min, max or own (the
    last segment only)."""

    agg: str
    merge: str = "sum"
    lags: tuple[int, ...] = ()
    peak: int | None = None


@dataclass(frozen=True)
class Feature:
    partials: tuple[str, ...]
    value: str


BASE = ("n", "s1", "s2", "lo", "hi")
EDGE = 40  # values kept from both ends of a window for lag statistics

# Parameter grids of the feature catalogue.
VALUES = (0, 1, -1)
RANGES = ((-1, 1), (-1e12, 0), (0, 1e12))
PEAKS = (1, 3, 5, 10, 50)
SPREAD_RATIOS = tuple(round(0.05 * i, 2) for i in range(1, 20))
TREND = ("pvalue", "rvalue", "intercept", "slope", "stderr")

# Values of a window from its accumulated sums.
MEAN = "(c + s1 / n)"
SUM = "(s1 + n * c)"
ENERGY = "(s2 + 2 * c * s1 + n * c * c)"
SD = "sqrt(var)"


def total(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def _tag(value: float) -> str:
    return str(value).replace("-", "m").replace(".", "p").replace("+", "")


def partials() -> dict[str, Partial]:
    known = {
        "n": Partial("count(1)"),
        "s1": Partial("sum(d)"),
        "s2": Partial("sum(d * d)"),
        "s3": Partial("sum(d * d * d)"),
        "s4": Partial("sum(d * d * d * d)"),
        "lo": Partial("min(v)", "min"),
        "hi": Partial("max(v)", "max"),
        "hi_first": Partial("max(struct(v, -pos AS p))", "max"),
        "hi_last": Partial("max(struct(v, pos AS p))", "max"),
        "lo_first": Partial("min(struct(v, pos AS p))", "min"),
        "lo_last": Partial("min(struct(v, -pos AS p))", "min"),
        "ge0": Partial(total("v >= 0")),
        "le0": Partial(total("v <= 0")),
        "v_first": Partial("sum(CASE WHEN pos = 0 THEN v END)"),
        "v_second": Partial("sum(CASE WHEN pos = 1 THEN v END)"),
        "v_last": Partial("max(CASE WHEN pos = end - 1 THEN v END)", "own"),
        "v_before": Partial("max(CASE WHEN pos = end - 1 THEN lag_1 END)", "own", (1,)),
        "abs_step": Partial("sum(abs(v - lag_1))", "sum", (1,)),
        "sq_step": Partial("sum((v - lag_1) * (v - lag_1))", "sum", (1,)),
        "t_d": Partial("sum(pos * d)"),
        "h1": Partial("sum(hours)"),
        "h2": Partial("sum(hours * hours)"),
        "h_d": Partial("sum(hours * d)"),
    }
    for value in VALUES:
        known[f"eq_{_tag(value)}"] = Partial(total(f"v = {value}"))
        known[f"cross_{_tag(value)}"] = Partial(total(f"(v > {value}) <> (lag_1 > {value})"), "sum", (1,))
    for low, high in RANGES:
        known[f"in_{_tag(low)}_{_tag(high)}"] = Partial(total(f"v >= {low:.1f} AND v < {high:.1f}"))
    for digit in range(1, 10):
        leading = "left(ltrim('0.', cast(abs(v) AS string)), 1)"
        known[f"digit_{digit}"] = Partial(total(f"{leading} = '{digit}'"))
    for lag in (1, 2, 3):
        mid, old = f"lag_{lag}", f"lag_{2 * lag}"
        known[f"c3_{lag}"] = Partial(f"sum(v * {mid} * {old})", "sum", (lag, 2 * lag))
        known[f"tras_{lag}"] = Partial(f"sum(v * v * {mid} - {mid} * {old} * {old})", "sum", (lag, 2 * lag))
    for n in PEAKS:
        known[f"peaks_{n}"] = Partial(f"sum(peak_{n})", "sum", (), n)
    return known


def _skewness() -> str:
    third = "(s3 / n - 3 * (s1 / n) * s2 / n + 2 * pow(s1 / n, 3))"
    corrected = f"sqrt(n * (n - 1.0D)) / nullif(n - 2.0D, 0) * try_divide({third}, pow(var, 1.5))"
    return f"CASE WHEN n < 3 THEN NULL WHEN var = 0 THEN 0.0 ELSE {corrected} END"


def _kurtosis() -> str:
    fourth = "(s4 / n - 4 * (s1 / n) * s3 / n + 6 * pow(s1 / n, 2) * s2 / n - 3 * pow(s1 / n, 4))"
    excess = f"(try_divide({fourth}, var * var) - 3)"
    scale = "try_divide(n - 1.0D, (n - 2.0D) * (n - 3.0D))"
    return f"CASE WHEN n < 4 THEN NULL WHEN var = 0 THEN 0.0 ELSE {scale} * ((n + 1) * {excess} + 6) END"


def _lag_mean(partial: str, lag: int) -> str:
    """Mean over the n - 2 lag triples of a window; zero where there is none."""
    return f"CASE WHEN n <= {2 * lag} THEN 0.0 ELSE try_divide({partial}, n - {2 * lag}) END"


def _agg_autocorrelation(stat: str) -> str:
    """Mean, median or variance of the autocorrelations at lags 1 to 40 that exist."""
    mean = "try_divide(aggregate(_acf, 0.0D, (a, x) -> a + x), size(_acf))"
    if stat == "mean":
        return mean
    if stat == "var":
        return f"try_divide(aggregate(_acf, 0.0D, (a, x) -> a + x * x), size(_acf)) - pow({mean}, 2)"
    low, high = "int((size(_acf) - 1) / 2)", "int(ceil((size(_acf) - 1) / 2))"
    return f"CASE WHEN size(_acf) > 0 THEN (get(array_sort(_acf), {low}) + get(array_sort(_acf), {high})) / 2 END"


def _benford() -> str:
    """Correlation of leading-digit shares with log10(1 + 1/digit)."""
    expected = [math.log10(1 + 1 / k) for k in range(1, 10)]
    centred = [e - sum(expected) / 9 for e in expected]
    digits = [f"digit_{k}" for k in range(1, 10)]
    mean = f"(({' + '.join(digits)}) / 9)"
    cov = " + ".join(f"{d} * {e!r}D" for d, e in zip(digits, centred))
    spread = " + ".join(f"pow({d} - {mean}, 2)" for d in digits)
    return f"try_divide({cov}, sqrt(({spread}) * {sum(e * e for e in centred)!r}D))"


def _line(attr: str, time_sum: str, time_squares: str, time_value: str) -> str:
    """Least squares line of the value on a time axis, from sums."""
    ss_t = f"({time_squares} - {time_sum} * {time_sum} / n)"
    ss_tx = f"({time_value} - {time_sum} * s1 / n)"
    slope = f"try_divide({ss_tx}, {ss_t})"
    fitted = f"coalesce(try_divide({ss_tx}, sqrt({ss_t} * n * var)), 0.0D)"
    r = f"CASE WHEN {ss_t} > 0 THEN greatest(least({fitted}, 1.0D), -1.0D) END"
    return {
        "slope": slope,
        "intercept": f"{MEAN} - {slope} * {time_sum} / n",
        "rvalue": r,
        "stderr": f"CASE WHEN n > 2 THEN sqrt(try_divide((1 - pow({r}, 2)) * n * var, {ss_t} * (n - 2))) END",
    }[attr]


CLOCKS = {
    "linear_trend": ("(n * (n - 1.0D) / 2)", "((n - 1.0D) * n * (2 * n - 1.0D) / 6)", "t_d"),
    "linear_trend_timewise": ("h1", "h2", "h_d"),
}
# lag products and edge values, from ``lag_lists`` of that depth
LAGS, DEEP_LAGS = "lags_10", f"lags_{EDGE}"


def catalogue() -> dict[str, Feature]:
    """Feature name (without axis) to the partials it needs and its value."""
    out: dict[str, Feature] = {}

    def add(name: str, value: str, *needs: str) -> None:
        out[name] = Feature(needs, value)

    add("sum_values", SUM)
    add("mean", MEAN)
    add("length", "n")
    add("standard_deviation", SD)
    add("variance", "var")
    add("root_mean_square", f"sqrt(greatest({ENERGY}, 0.0D) / n)")
    add("maximum", "hi")
    add("minimum", "lo")
    add("absolute_maximum", "greatest(abs(hi), abs(lo))")
    add("abs_energy", ENERGY)
    # a mean within rounding noise of the values counts as zero
    noise = "1e-12D * greatest(abs(hi), abs(lo))"
    add("variation_coefficient", f"CASE WHEN abs({MEAN}) > {noise} THEN {SD} / {MEAN} END")
    add("variance_larger_than_standard_deviation", f"var > {SD}")
    add("skewness", _skewness(), "s3")
    add("kurtosis", _kurtosis(), "s3", "s4")
    for r in SPREAD_RATIOS:
        add(f"large_standard_deviation__r_{r}", f"{SD} > {r}D * (hi - lo)")
    add("count_above__t_0", "ge0 / n", "ge0")
    add("count_below__t_0", "le0 / n", "le0")
    for value in VALUES:
        add(f"value_count__value_{value}", f"eq_{_tag(value)}", f"eq_{_tag(value)}")
        add(f"number_crossing_m__m_{value}", f"cross_{_tag(value)}", f"cross_{_tag(value)}")
    for low, high in RANGES:
        shown = {1e12: "1000000000000.0", -1e12: "-1000000000000.0"}
        key = f"in_{_tag(low)}_{_tag(high)}"
        add(f"range_count__max_{shown.get(high, high)}__min_{shown.get(low, low)}", key, key)
    add("has_duplicate_max", "hi_last.p <> -hi_first.p", "hi_first", "hi_last")
    add("has_duplicate_min", "-lo_last.p <> lo_first.p", "lo_first", "lo_last")
    add("first_location_of_maximum", "-hi_first.p / n", "hi_first")
    add("last_location_of_maximum", "(hi_last.p + 1) / n", "hi_last")
    add("first_location_of_minimum", "lo_first.p / n", "lo_first")
    add("last_location_of_minimum", "(1 - lo_last.p) / n", "lo_last")
    add("absolute_sum_of_changes", "coalesce(abs_step, 0.0D)", "abs_step")
    add("mean_abs_change", "try_divide(abs_step, n - 1)", "abs_step")
    add("mean_change", "try_divide(v_last - v_first, n - 1)", "v_first", "v_last")
    add(
        "mean_second_derivative_central",
        "CASE WHEN n > 2 THEN try_divide(v_last - v_before - v_second + v_first, 2 * (n - 2)) END",
        "v_first",
        "v_second",
        "v_last",
        "v_before",
    )
    add("cid_ce__normalize_False", "sqrt(coalesce(sq_step, 0.0D))", "sq_step")
    add("cid_ce__normalize_True", "CASE WHEN var > 0 THEN sqrt(coalesce(sq_step, 0.0D) / var) ELSE 0.0D END", "sq_step")
    for lag in (1, 2, 3):
        add(f"c3__lag_{lag}", _lag_mean(f"c3_{lag}", lag), f"c3_{lag}")
        add(f"time_reversal_asymmetry_statistic__lag_{lag}", _lag_mean(f"tras_{lag}", lag), f"tras_{lag}")
    for n in PEAKS:
        add(f"number_peaks__n_{n}", f"peaks_{n}", f"peaks_{n}")
    for lag in range(10):
        scaled = f"try_divide(get(_cov, {lag}), (n - {lag}) * var)"
        add(f"autocorrelation__lag_{lag}", f"CASE WHEN n > {lag} AND var > 1e-8D THEN {scaled} END", LAGS)
        add(f"partial_autocorrelation__lag_{lag}", f"get(_pacf, {lag})", LAGS)
    for stat in ("mean", "median", "var"):
        add(f'agg_autocorrelation__f_agg_"{stat}"__maxlag_40', _agg_autocorrelation(stat), DEEP_LAGS)
    for k in range(11):
        add(f"ar_coefficient__coeff_{k}__k_10", f"get(_ar, {k})", LAGS)
    add("benford_correlation", _benford(), *[f"digit_{k}" for k in range(1, 10)])
    for name, clock in CLOCKS.items():
        needs = ("t_d",) if name == "linear_trend" else ("h1", "h2", "h_d")
        for attr in TREND:
            value = f"_p_{name}" if attr == "pvalue" else _line(attr, *clock)
            add(f'{name}__attr_"{attr}"', value, *needs)
    return out


def window_sums(
    frames: Frames, names: list[str], kinds: list[str] | None = None
) -> DataFrame:
    """One row per window and axis with the accumulated partials in ``names`` and ``var``."""
    known = partials()
    wanted = {name: known[name] for name in dict.fromkeys([*BASE, *names])}
    lags = sorted({k for p in wanted.values() for k in p.lags})
    peaks = sorted({p.peak for p in wanted.values() if p.peak})
    rows = lagged_rows(long_rows(frames, kinds), frames.keys, lags, peaks)
    table = rows.groupBy(*frames.window_keys, "kind", "c").agg(
        *[F.expr(p.agg).alias(name) for name, p in wanted.items()]
    )
    if frames.step is not None:
        table = frames.upto(table, {name: (F.col(name), p.merge) for name, p in wanted.items() if p.merge != "own"})
    return table.withColumn("var", F.expr("greatest(s2 / n - (s1 / n) * (s1 / n), 0.0D)"))


def lag_lists(frames: Frames, kinds: list[str] | None, depth: int) -> DataFrame:
    """One row per window and axis with ``_prods``, the sums of d(t) d(t - lag) for lags up to
    ``depth``, ``_tail``, its last values, latest first, and ``_head``, its first ones.

    Blocks, with the rows before them repeated as a halo, give each segment its share.
    """
    keys = [*frames.keys, "kind"]
    rows = with_halo(long_rows(frames, kinds).select(*keys, "pos", "end", "d"), depth, BLOCK)
    blocks = spread(frames, rows, [*keys, "_block"]).groupBy(*keys, "_block").agg(
        F.collect_list(F.struct("pos", "end", "d", "_halo")).alias("_s")
    )

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, rows = struct_fields(batch.column("_s"))
            record = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            order = np.lexsort((rows["pos"], record))
            pos, end, halo = (rows[k][order] for k in ("pos", "end", "_halo"))
            d = np.asarray(rows["d"], float)[order]
            place = np.arange(len(d))
            since = place - offsets[record]
            new = (np.diff(record) != 0) | (np.diff(end) != 0) | (np.diff(halo.astype(np.int8)) != 0)
            starts = np.flatnonzero(np.concatenate([[True], new]))
            group = np.cumsum(np.concatenate([[0], new]))
            found = np.zeros((len(starts), 3, depth))
            for lag in range(1, depth + 1):
                there = np.where(since >= lag, d[np.maximum(place - lag, 0)], 0.0)
                found[:, 0, lag - 1] = np.add.reduceat(d * there, starts)
            last = np.flatnonzero(pos == end - 1)
            back = np.arange(depth)
            found[group[last], 1] = np.where(since[last][:, None] >= back, d[np.maximum(last[:, None] - back, 0)], 0.0)
            first = np.flatnonzero(pos < depth)
            found[group[first], 2, pos[first]] = d[first]
            own = np.flatnonzero(~halo[starts])
            taken = pa.array(record[starts[own]])
            arrays = [*(batch.column(k).take(taken) for k in keys), pa.array(end[starts[own]])]
            yield pa.RecordBatch.from_arrays([*arrays, lists_of(found[own].reshape(len(own), -1))], [*keys, "end", "t"])

    fields = {f.name: f.dataType for f in blocks.schema}
    schema = T.StructType([T.StructField(k, fields[k]) for k in keys]).add("end", T.LongType())
    found = blocks.mapInArrow(share, schema.add("t", T.ArrayType(T.DoubleType())))
    table = window_totals(frames, found, 3 * depth)
    parts = {name: [f"{name}_{i}" for i in range(depth)] for name in ("_prods", "_tail", "_head")}
    flat = [column for names in parts.values() for column in names]
    table = table.select(*frames.window_keys, "kind", *[F.get("t", F.lit(i)).alias(k) for i, k in enumerate(flat)])
    if frames.step is not None:
        table = frames.upto(table, {k: (F.col(k), "sum") for name in ("_prods", "_head") for k in parts[name]})
    arrays = [F.array(*names).alias(name) for name, names in parts.items()]
    return table.select(*frames.window_keys, "kind", *arrays)


def _products(depth: int) -> str:
    return f"concat(array(s2), slice(_prods, 1, {depth}))"


def extract(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    known = catalogue()
    chosen = {name: known[name] for name in names}
    needs = [p for f in chosen.values() for p in f.partials]
    table = window_sums(frames, [p for p in needs if p not in (LAGS, DEEP_LAGS)], kinds)
    if LAGS in needs or DEEP_LAGS in needs:
        deep = DEEP_LAGS in needs
        table = table.join(lag_lists(frames, kinds, EDGE if deep else 10), [*frames.window_keys, "kind"])
        products = _products(EDGE if deep else 9)
        table = table.withColumn("_cov", lag_covariances(F.expr(products), "_head", "_tail", "s1", "n"))
        if deep:
            scaled = "CASE WHEN var < 1e-10D THEN 0.0D WHEN var > 1e-8D THEN try_divide(x, (n - i - 1) * var) END"
            lags = f"transform(filter(slice(_cov, 2, {EDGE}), x -> x IS NOT NULL), (x, i) -> {scaled})"
            table = table.withColumn("_acf", F.expr(f"filter({lags}, x -> x IS NOT NULL)"))
    if any(name.startswith("partial_autocorrelation") for name in names):
        covariances = F.expr("transform(slice(_cov, 1, 10), (x, i) -> try_divide(x, n - i))")
        table = table.withColumn("_pacf", partial_autocorrelations(covariances, "n"))
    if any(name.startswith("ar_coefficient") for name in names):
        weights = ar_coefficients(F.expr(_products(10)), "_head", "_tail", "s1", "n", "c")
        table = table.withColumn("_ar", weights)
    for name, clock in CLOCKS.items():
        if f'{name}__attr_"pvalue"' in names:
            table = table.withColumn("_r", F.expr(_line("rvalue", *clock)))
            t = F.expr("CASE WHEN n > 2 THEN try_divide(_r * sqrt(n - 2), sqrt((1 - _r) * (1 + _r))) END")
            table = table.withColumn(f"_p_{name}", student_two_sided(t, F.expr("n - 2.0D")))
    return as_long(table, frames.window_keys, {name: f.value for name, f in chosen.items()})


def unit_root(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Augmented unit root test from lag products; the deepest lag follows from the
    longest series."""
    depth = max(1, unit_root_depth(frames.series.longest) + 1)
    table = window_sums(frames, [], kinds).join(lag_lists(frames, kinds, depth), [*frames.window_keys, "kind"])
    tested = table.withColumn("_test", unit_root_test(F.expr(_products(depth)), "_head", "_tail", "s1", "n"))
    attrs = {name: f"get(_test, {i})" for i, name in enumerate(unit_root_names())}
    return as_long(tested, frames.window_keys, {name: attrs[name] for name in names})


def unit_root_names() -> list[str]:
    return [f'augmented_dickey_fuller__attr_"{a}"__autolag_"AIC"' for a in ("teststat", "pvalue", "usedlag")]
