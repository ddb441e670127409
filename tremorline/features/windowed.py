"""Features that compare rows with a statistic of their own window (its mean, range,
quantiles or length). The rows are streamed once per window into partial aggregates;
no window is ever gathered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.features.blocks import BLOCK, finished, packed, per_window, window_totals
from tremorline.features.prefixes import FAN, longest_runs, per_prefix, sums_within
from tremorline.features.rows import as_long, lagged_rows, long_rows
from tremorline.features.segments import MEAN, SD, window_sums
from tremorline.features.window_quantiles import window_quantiles
from tremorline.operators.filling import forward_fill
from tremorline.operators.indexing import block_of, index_series
from tremorline.operators.rolling import Frames
from tremorline.operators.scans import running
from tremorline.session import stage

c = F.col

# Parameter grids of the feature catalogue.
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
SYMMETRY_RATIOS = tuple(round(0.05 * i, 2) for i in range(20))
SIGMAS = (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)
CORRIDOR = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
CORRIDORS = tuple((a, b) for a in CORRIDOR for b in CORRIDOR if a < b)
BINS = 10
PARTS = 10
CORRIDOR_CELLS = 1 << 20
FOURIER_BLOCK = 4096
FOURIER_WINDOWS = 16  # windows that a block is turned for at a time
SUM_BLOCK = 1024
FOURIER_COEFFS = tuple(range(100))
FOURIER_ATTRS = ("real", "imag", "abs", "angle")


def window_stats(frames: Frames, kinds: list[str] | None = None) -> DataFrame:
    """Size, mean, spread and range of every window, staged once for all families of a call."""
    wanted = ["n", f"{MEAN} AS mean", f"{SD} AS sd", "lo", "hi"]
    make = lambda: window_sums(frames, [], kinds).selectExpr(*frames.window_keys, "kind", *wanted)
    return frames.once(("stats", *(kinds or frames.series.values)), make)


def value_blocks(frames: Frames, kinds: list[str] | None, size: int = BLOCK) -> DataFrame:
    """Packed values, staged once where several families of a call read them."""
    make = lambda: packed(frames, long_rows(frames, kinds), ("v",), size)
    return frames.once(("blocks", size, *(kinds or frames.series.values)), make) if frames.shared.get("blocks") else make()


def value_quantiles(frames: Frames, kinds: list[str] | None, probabilities: list[float]) -> DataFrame:
    """Quantiles of the values of every window. Where several families of a call want some,
    those of all are selected together."""
    every = sorted({*probabilities, *frames.shared.get("probabilities", ())})
    if every == sorted(probabilities):
        return window_quantiles(frames, long_rows(frames, kinds), "v", probabilities)
    make = lambda: window_quantiles(frames, long_rows(frames, kinds), "v", every)
    table = frames.once(("quantiles", *(kinds or frames.series.values)), make)
    wanted = F.array(*[c("q")[every.index(p)] for p in probabilities])
    return table.select(*frames.window_keys, "kind", wanted.alias("q"))


def _first_true(ordered: np.ndarray, holds: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Index of the first element of a line of ``ordered`` for which a monotone condition holds,
    by bisection for a whole grid of conditions at once; its length where none holds. The grid
    has a line per line of ``ordered``, or any number of them for a single one."""
    size = ordered.shape[1]
    line = np.arange(len(ordered))[:, None]
    low, high = np.zeros(shape, np.int64), np.full(shape, size, np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        hit = holds(ordered[line, np.minimum(middle, size - 1)])
        active = low < high
        high = np.where(active & hit, middle, high)
        low = np.where(active & ~hit, middle + 1, low)
    return low


def _counts(values: np.ndarray, *stats: np.ndarray) -> np.ndarray:
    """Per window: rows beyond r sigma for every r, above and below the mean, per bin."""
    ordered = np.sort(values, axis=1)
    size = values.shape[1]
    mean, sd, lo, hi = (stat[:, None] for stat in stats)
    margins = np.hstack([sd * np.array(SIGMAS, float), 1e-12 * np.maximum(np.abs(lo), np.abs(hi))])
    above = size - _first_true(ordered, lambda v: v - mean > margins, margins.shape)
    below = _first_true(ordered, lambda v: ~(mean - v > margins), margins.shape)
    span = np.where(hi > lo, hi - lo, 1.0)
    number = np.arange(1, BINS)[None, :]
    starts = _first_true(ordered, lambda v: np.floor((v - lo) / span * BINS) >= number, (len(mean), BINS - 1))
    edges = np.hstack([np.zeros((len(mean), 1)), starts, np.full((len(mean), 1), size)])
    return np.hstack([above[:, :-1] + below[:, :-1], above[:, -1:], below[:, -1:], np.diff(edges, axis=1)]).astype(np.int64)


COUNTED = [*[f"beyond_{i}" for i in range(len(SIGMAS))], "above", "below", *[f"bin_{b}" for b in range(BINS)]]


def beyond_statistics(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Shares beyond r sigma, counts around the mean, entropy of the equal-width histogram.

    A block answers each threshold of a window by bisection of its sorted values.
    """
    found = per_window(
        frames,
        value_blocks(frames, kinds),
        window_stats(frames, kinds),
        ("v",),
        ("mean", "sd", "lo", "hi"),
        lambda rows, stats: list(_counts(rows[0], *stats).T),
        {name: T.LongType() for name in COUNTED},
    )
    values: dict[str, str] = {f"ratio_beyond_r_sigma__r_{r}": f"beyond_{i} / end" for i, r in enumerate(SIGMAS)}
    values |= {"count_above_mean": "above", "count_below_mean": "below"}
    shares = [f"CASE WHEN bin_{b} > 0 THEN -bin_{b} / end * ln(bin_{b} / end) ELSE 0.0D END" for b in range(BINS)]
    values[f"binned_entropy__max_bins_{BINS}"] = " + ".join(shares)
    table = found.groupBy(*frames.window_keys, "kind").agg(*[F.sum(n).alias(n) for n in COUNTED])
    return as_long(table, frames.window_keys, {name: values[name] for name in names})


def _ahead(frames: Frames, blocks: DataFrame) -> DataFrame:
    """Keys, ``_block`` and ``ahead``: the totals of the blocks before, summed."""
    keys, count = [*frames.keys, "kind"], frames.series.longest // SUM_BLOCK + 1
    summed = running(blocks, keys, ["_block"], c("_block"), count, {"_sum": (c("_total"), "sum")}, exclusive=True)
    return summed.select(*keys, "_block", F.coalesce("_sum", F.lit(0.0)).alias("ahead"))


def _running(frames: Frames, kinds: list[str] | None, term: str) -> DataFrame:
    """Rows with ``run``: the sum of ``term`` over the series up to and including the row,
    from sums inside small blocks and the totals of the blocks before."""
    rows = long_rows(frames, kinds).withColumn("_block", block_of(c("pos"), SUM_BLOCK)).withColumn("_term", F.expr(term))
    block_keys = [*frames.keys, "kind", "_block"]
    offsets = _ahead(frames, rows.groupBy(*block_keys).agg(F.sum("_term").alias("_total")))
    inside = Window.partitionBy(*block_keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("_run", F.sum("_term").over(inside)).join(offsets, block_keys)
    return within.withColumn("run", c("_run") + c("ahead"))


def energy_by_parts(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Share of the energy in each of ten consecutive parts of a window: differences of the
    running energy at the parts' last rows, looked up in the blocks that hold one. The first n mod 10 parts are one row longer."""
    keys = [*frames.window_keys, "kind"]
    block_keys = [*frames.keys, "kind", "_block"]
    rows = long_rows(frames, kinds).select(*keys, "pos", (c("v") * c("v")).alias("_term"))
    rows = rows.withColumn("_block", block_of(c("pos"), SUM_BLOCK))
    length = f"(end div {PARTS})"
    last_row = f"i * {length} + least(i, end % {PARTS}) - 1"
    bounds = (
        rows.filter(c("pos") == c("end") - 1)
        .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(PARTS))).alias("i"))
        .withColumn("pos", F.expr(last_row))
    )
    # Of all rows only those in a block with a wanted place are put in order.
    reached = bounds.select(*frames.keys, "kind", block_of(c("pos"), SUM_BLOCK).alias("_block")).distinct()
    inside = Window.partitionBy(*block_keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.join(reached, block_keys, "left_semi").withColumn("_run", F.sum("_term").over(inside))
    offsets = _ahead(frames, rows.groupBy(*block_keys).agg(F.sum("_term").alias("_total")))
    runs = within.join(offsets, block_keys).select(*frames.keys, "kind", "pos", (c("_run") + c("ahead")).alias("run"))
    at = bounds.join(runs, [*frames.keys, "kind", "pos"], "left")  # no row before the first part
    table = at.groupBy(*keys).agg(
        *[F.max(F.when(c("i") == i, F.coalesce("run", F.lit(0.0)))).alias(f"e{i}") for i in range(PARTS + 1)]
    )
    values = {
        f"energy_ratio_by_chunks__num_segments_{PARTS}__segment_focus_{i}": f"try_divide(e{i + 1} - e{i}, e{PARTS})"
        for i in range(PARTS)
    }
    return as_long(table, frames.window_keys, {name: values[name] for name in names})


def quantile_features(
    frames: Frames, names: list[str], kinds: list[str] | None = None
) -> DataFrame:
    """Median, quantiles and the symmetry flags that compare mean and median."""
    keys = [*frames.window_keys, "kind"]
    grid = [0.5, *QUANTILES] if any(n.startswith("quantile") for n in names) else [0.5]
    table = value_quantiles(frames, kinds, grid)
    values = {"median": "q[0]"} | {f"quantile__q_{q}": f"q[{i}]" for i, q in enumerate(grid[1:], start=1)}
    if any(n.startswith("symmetry_looking") for n in names):
        table = table.join(window_stats(frames, kinds), keys)
        for r in SYMMETRY_RATIOS:
            values[f"symmetry_looking__r_{r}"] = f"abs(mean - q[0]) < {r}D * (hi - lo)"
    return as_long(table, frames.window_keys, {name: values[name] for name in names})


def change_quantiles(
    frames: Frames, names: list[str], kinds: list[str] | None = None
) -> DataFrame:
    """Mean and variance of steps whose both ends lie between two quantiles of the window."""
    edges = stage(value_quantiles(frames, kinds, list(CORRIDOR)), "edges")
    corridors = [x for x in CORRIDORS if any(n.endswith(f"__qh_{x[1]}__ql_{x[0]}") for n in names)]
    places = [(CORRIDOR.index(low), CORRIDOR.index(high)) for low, high in corridors]

    lower, upper = ([pair[side] for pair in places] for side in (0, 1))

    def sums(rows: list[np.ndarray], stats: list[np.ndarray]) -> list[np.ndarray]:
        step = rows[1] - rows[0]
        low, high = (f(*rows)[:, :, None] for f in (np.fmin, np.fmax))
        known = ~np.isnan(rows[0])[:, :, None]
        terms = np.stack([np.ones_like(step), step, np.abs(step), step * step], axis=1)
        terms = np.where(np.isnan(terms), 0.0, terms)
        out = np.zeros((len(stats[0]), len(places), 4))
        some = max(1, CORRIDOR_CELLS // (step.shape[1] * len(places)))
        for part in range(0, len(out), some):
            at = slice(part, part + some)
            mine = at if len(step) > 1 else slice(None)
            left, right = (stats[0][at][:, None, side] for side in (lower, upper))
            inside = (left < right) & (low[mine] >= left) & (high[mine] <= right) & known[mine]
            out[at] = np.swapaxes(terms[mine] @ inside.astype(float), 1, 2)
        return [out.reshape(len(out), -1)]

    def sums_of_block(rows: list[np.ndarray], stats: list[np.ndarray]) -> list[np.ndarray]:
        step = rows[1] - rows[0]
        terms = np.stack([np.ones_like(step), step, np.abs(step), step * step])
        terms = np.where(np.isnan(terms) | np.isnan(rows[0]), 0.0, terms)
        left, right = (stats[0][:, side] for side in (lower, upper))
        found = sums_within(np.fmin(*rows), np.fmax(*rows), terms, left.ravel(), right.ravel())
        found = np.where((left < right).reshape(-1, 1), found, 0.0)
        return [found.reshape(len(left), -1)]

    outputs, width = {"t": T.ArrayType(T.DoubleType())}, 4 * len(places)
    if frames.series.longest > BLOCK:
        found = per_prefix(frames, long_rows(frames, kinds), edges, ("q",), sums_of_block, sums, outputs)
    else:
        rows = lagged_rows(long_rows(frames, kinds), frames.keys, [1])
        found = per_window(frames, packed(frames, rows, ("lag_1", "v")), edges, ("lag_1", "v"), ("q",), sums, outputs)
    stems = {}
    for i, (low, high) in enumerate(corridors):
        for is_abs in (False, True):
            for k, how in enumerate(("mean", "var")):
                stems[f'change_quantiles__f_agg_"{how}"__isabs_{is_abs}__qh_{high}__ql_{low}'] = (i, int(is_abs), k)
    chosen = np.array([stems[name] for name in names])

    def finish(totals: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, None]:
        m, moved, total, squares = np.moveaxis(totals.reshape(len(totals), -1, 4), 2, 0)
        some = np.where(m > 0, m, 1.0)
        first = np.stack([moved, total], axis=2) / some[:, :, None]
        spread = np.maximum((squares / some)[:, :, None] - first * first, 0.0)
        values = np.stack([first, spread], axis=3)
        return values[:, chosen[:, 0], chosen[:, 1], chosen[:, 2]], None

    table = window_totals(frames, found, width, BLOCK)
    return finished(table, frames.window_keys, "t", list(names), finish)


def mass_quantiles(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Relative position at which a share q of the absolute mass is reached.

    The running mass of a series only grows. Wanted masses and block offsets are merged in
    range partitions, where a forward fill tells in which block each mass is reached; only
    that block's rows are searched.
    """
    keys = [*frames.window_keys, "kind"]
    rows = stage(_running(frames, kinds, "abs(v)").select(*keys, "pos", "_block", "ahead", "run"), "running")
    wanted = [q for q in QUANTILES if f"index_mass_quantile__q_{q}" in names]
    shares = F.explode(F.array(*[F.lit(q) for q in wanted])).alias("q")
    targets = (
        rows.filter(c("pos") == c("end") - 1)
        .select(*keys, c("run").alias("total"), shares)
        .withColumn("mass", c("total") * c("q") * (1 - 1e-12))
    )
    offsets = rows.groupBy(*frames.keys, "kind", "_block").agg(F.min("ahead").alias("mass"))
    # a mass equal to an offset was reached before the block began, so targets sort first
    marks = targets.withColumn("_block", F.lit(None).cast("bigint")).unionByName(offsets, allowMissingColumns=True)
    marks = marks.withColumn("_mark", F.struct("mass", "_block", "end", "q"))
    merged = forward_fill(index_series(marks, (*frames.keys, "kind"), "_mark", ("_block",)))
    placed = merged.filter(c("q").isNotNull()).select(
        *keys, "q", "total", "mass", F.coalesce("_block", F.lit(0)).alias("_block")
    )
    found = placed.join(
        rows.select(*frames.keys, "kind", "_block", "pos", "run"), [*frames.keys, "kind", "_block"]
    ).filter((c("run") >= c("mass")) & (c("total") > 0))
    first = found.groupBy(*keys, "q").agg(F.min("pos").alias("pos"))
    # windows without mass keep NULL
    table = targets.select(*keys, "q").join(first, [*keys, "q"], "left")
    feature = F.concat(F.lit("index_mass_quantile__q_"), c("q").cast("string"))
    return table.select(*keys, feature.alias("feature"), ((c("pos") + 1) / c("end")).alias("value"))


def _strikes(values: np.ndarray, mean: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Per window: best run, run from the start, run to the end, above and below the mean."""
    noise = 1e-12 * np.maximum(np.abs(lo), np.abs(hi))
    distance = values - mean[:, None]
    size = values.shape[1]
    place = np.arange(size)
    out = []
    for hit in (distance > noise[:, None], -distance > noise[:, None]):
        last_miss = np.maximum.accumulate(np.where(hit, -1, place), axis=1)
        run = np.where(hit, place - last_miss, 0)
        prefix = np.where(hit.all(axis=1), size, hit.argmin(axis=1))
        out += [run.max(axis=1), prefix, run[:, -1]]
    return [np.full(len(mean), size), *out]


def _strikes_of_block(rows: list[np.ndarray], stats: list[np.ndarray]) -> list[np.ndarray]:
    """The same of one line of values for many windows: what is above a mean are the values from
    some rank on, what is below are those up to some rank."""
    values, (mean, lo, hi) = rows[1], (stat[:, None] for stat in stats)
    noise = 1e-12 * np.maximum(np.abs(lo), np.abs(hi))
    size = len(values)
    by_value = np.argsort(values, kind="stable")
    rank = np.empty(size, np.int64)
    rank[by_value] = np.arange(size)
    ordered = values[by_value][None, :]
    above = _first_true(ordered, lambda v: v - mean > noise, mean.shape)[:, 0]
    below = _first_true(ordered, lambda v: ~(mean - v > noise), mean.shape)[:, 0]
    out = []
    for ranks, least in ((rank, above), (size - 1 - rank, size - below)):
        edges = [np.searchsorted(-np.minimum.accumulate(r), -least, side="right") for r in (ranks, ranks[::-1])]
        out += [longest_runs(ranks, least), *edges]
    return [np.full(len(mean), size), *out]


def longest_strikes(
    frames: Frames, names: list[str], kinds: list[str] | None = None, block_rows: int = BLOCK
) -> DataFrame:
    """Longest run above or below the window mean.

    A block reports its best run and the runs touching its edges; edge runs of
    neighbouring blocks are added up.
    """
    keys = [*frames.window_keys, "kind"]
    measures = ("best", "prefix", "suffix")
    outputs = {name: T.LongType() for name in ("rows", *[f"{m}_{side}" for side in ("above", "below") for m in measures])}
    stats, columns = window_stats(frames, kinds), ("mean", "lo", "hi")
    least = max(1, block_rows // 8)
    if frames.series.longest > block_rows:
        sizes = (least, least * FAN, least * FAN * FAN)
        cut = lambda rows, stats: _strikes(rows[1], *stats)
        found = per_prefix(frames, long_rows(frames, kinds), stats, columns, _strikes_of_block, cut, outputs, sizes)
    else:
        blocks, strikes = value_blocks(frames, kinds, block_rows), lambda rows, stats: _strikes(rows[0], *stats)
        found = per_window(frames, blocks, stats, ("v",), columns, strikes, outputs)
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), *[c(f"{m}_{side}").alias(m) for m in measures])
            for side in ("above", "below")
        ]
    )
    blocks = found.select(*keys, "_block", "rows", F.inline(sides))
    full = c("best") == c("rows")
    breaks = {"_breaks": (F.when(full, 0).otherwise(1), "sum")}
    count = frames.series.longest // least + 1
    blocks = running(blocks, [*keys, "side"], ["_block"], c("_block"), count, breaks, exclusive=True)
    group = F.coalesce("_breaks", F.lit(0))
    pieces = F.when(full, F.array(F.struct(c("g").alias("g"), c("rows").alias("part")))).otherwise(
        F.array(
            F.struct(c("g").alias("g"), c("prefix").alias("part")),
            F.struct((c("g") + 1).alias("g"), c("suffix").alias("part")),
        )
    )
    joined = blocks.withColumn("g", group).select(*keys, "side", "best", F.inline(pieces)).groupBy(*keys, "side", "g").agg(
        F.sum("part").alias("joined"), F.max("best").alias("best")
    )
    strike = joined.groupBy(*keys, "side").agg(F.max(F.greatest("joined", "best")).alias("value"))
    feature = F.concat(F.lit("longest_strike_"), c("side"), F.lit("_mean"))
    return strike.select(*keys, feature.alias("feature"), c("value").cast("double").alias("value")).filter(
        c("feature").isin(list(names))
    )


def fourier_coefficients(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Discrete Fourier coefficients of the requested orders; NULL beyond half the window.

    Blocks of rows meet groups of windows. For all windows of a group that are cut at the
    same row a block contributes sums of every order at once, one array a window, which add
    up over the blocks. Order zero is the plain sum, all others ignore the series mean.
    """
    orders = sorted({int(n.rsplit("_", 1)[1]) for n in names})
    wanted = np.array(orders)
    keys = [*frames.window_keys, "kind"]
    rows = long_rows(frames, kinds).withColumn("place", c("pos").cast("double"))
    blocks = packed(frames, rows, ("d", "v", "place"), FOURIER_BLOCK)
    windows = rows.filter(c("pos") == c("end") - 1).select(*keys, c("end").alias("length"))

    def sums(rows: list[np.ndarray], stats: list[np.ndarray]) -> list[np.ndarray]:
        centred, values, place = rows
        lengths = stats[0]
        out = np.zeros((len(lengths), 2 * len(wanted) + 1))
        out[:, -1] = np.abs(values).sum(axis=1)
        if len(centred) > 1:  # many series: windows of one length turn alike
            for length in np.unique(lengths):
                some = lengths == length
                turns = np.exp((-2j * np.pi / length) * np.mod(np.outer(place[0], wanted), length))
                out[some, : len(wanted)], out[some, len(wanted) : -1] = centred[some] @ turns.real, centred[some] @ turns.imag
        else:
            for part in range(0, len(lengths), FOURIER_WINDOWS):
                some = slice(part, part + FOURIER_WINDOWS)
                turn = np.exp((-2j * np.pi / lengths[some])[:, None] * place)
                state = np.ones_like(turn)
                for order in range(wanted[-1] + 1):
                    at = np.searchsorted(wanted, order)
                    if wanted[at] == order:
                        found = state @ centred[0]
                        out[some, at], out[some, len(wanted) + at] = found.real, found.imag
                    state *= turn
        if wanted[0] == 0:
            out[:, 0] = values.sum(axis=1)
        return [out]

    found = per_window(
        frames, blocks, windows, ("d", "v", "place"), ("length",), sums, {"t": T.ArrayType(T.DoubleType())}
    )
    table = window_totals(frames, found, 2 * len(orders) + 1, FOURIER_BLOCK)
    parts = {f'fft_coefficient__attr_"{a}"__coeff_{k}': (i, j) for i, a in enumerate(FOURIER_ATTRS) for j, k in enumerate(orders)}
    chosen = np.array([parts[name] for name in names])

    def finish(totals: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        re, im, noise = totals[:, : len(wanted)], totals[:, len(wanted) : -1], totals[:, -1:] * 1e-12
        # order zero and the highest order of an even window are real; rounding noise is zero
        two_sided = (wanted > 0) & (wanted * 2 < ends[:, None]) & (np.abs(im) > noise)
        im = np.where(two_sided, im, 0.0)
        re = np.where(np.abs(re) > noise, re, 0.0)
        values = np.stack([re, im, np.sqrt(re * re + im * im), np.degrees(np.arctan2(im, re))], axis=1)
        return values[:, chosen[:, 0], chosen[:, 1]], (wanted * 2 > ends[:, None])[:, chosen[:, 1]]

    return finished(table, frames.window_keys, "t", list(names), finish)


def beyond_names() -> list[str]:
    return [
        *[f"ratio_beyond_r_sigma__r_{r}" for r in SIGMAS],
        "count_above_mean",
        "count_below_mean",
        f"binned_entropy__max_bins_{BINS}",
    ]


def energy_names() -> list[str]:
    return [f"energy_ratio_by_chunks__num_segments_{PARTS}__segment_focus_{i}" for i in range(PARTS)]


def quantile_names() -> list[str]:
    return [
        "median",
        *[f"quantile__q_{q}" for q in QUANTILES],
        *[f"symmetry_looking__r_{r}" for r in SYMMETRY_RATIOS],
    ]


def change_names() -> list[str]:
    return [
        f'change_quantiles__f_agg_"{g}"__isabs_{a}__qh_{high}__ql_{low}'
        for low, high in CORRIDORS
        for a in (False, True)
        for g in ("mean", "var")
    ]


def mass_names() -> list[str]:
    return [f"index_mass_quantile__q_{q}" for q in QUANTILES]


def strike_names() -> list[str]:
    return ["longest_strike_above_mean", "longest_strike_below_mean"]


def fourier_names() -> list[str]:
    return [f'fft_coefficient__attr_"{a}"__coeff_{k}' for k in FOURIER_COEFFS for a in FOURIER_ATTRS]
