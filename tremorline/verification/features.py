"""One query per feature group; long results (id, window_rows, kind, feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.features import occurrences, segments, spectral, windowed
from tremorline.features.registry import (
    column_name,
    efficient,
    extract_features,
    from_columns,
    impute,
    matrix_columns,
    minimal,
    to_matrix,
)
from tremorline.operators.rolling import Frames, expanding
from tremorline.verification.base import (
    LONG_MIN_TIMESHIFT,
    LONG_SENSOR,
    LONG_STEP,
    Query,
    long_sensor,
    long_windows,
    prelude,
    prepared,
    r6,
    rounded,
    windows,
)

WINDOW = "id, e, kind"
# Families that also run on a few long series.
LONG = ("quantiles", "change_quantiles", "beyond_sigma", "strikes", "mass_quantiles", "energy_by_chunks", "repeats", "changes")
NOISE = "1e-12 * greatest(abs(hi), abs(lo))"


def published(features: DataFrame) -> DataFrame:
    return features.select(
        "id", F.col("end").alias("window_rows"), "kind", "feature", rounded(F.col("value")).alias("value")
    )


def spark_query(names: list[str], frames=windows):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return published(extract_features(frames(spark, sf_dir), names))

    return run


def listed(values: dict[str, str], source: str) -> str:
    """Long result from one expression per feature over an aggregated source."""
    items = ", ".join(f"{{'feature': '{name}', 'value': CAST({sql} AS DOUBLE)}}" for name, sql in values.items())
    return f"""
SELECT id, e AS window_rows, kind, feature, {r6('value')} AS value
FROM (SELECT {WINDOW}, unnest([{items}], recursive := true) FROM ({source}) t) u"""


def grouped(values: dict[str, str], source: str = "r", extra: str = "", view: str | None = None) -> str:
    """Features that are aggregates of the rows of a window."""
    columns = ", ".join(f"CAST({sql} AS DOUBLE) AS f{i}" for i, sql in enumerate(values.values()))
    inner = f"SELECT {WINDOW}, {columns} FROM {source} GROUP BY {WINDOW}"
    return (view or prelude()) + extra + listed({name: f"f{i}" for i, name in enumerate(values)}, inner)


def lagged(count: int, source: str = "r2") -> str:
    lags = ", ".join(f"lag(v, {k}) OVER w AS l{k}" for k in range(1, count + 1))
    return f",\ng AS (SELECT *, {lags} FROM {source} WINDOW w AS (PARTITION BY {WINDOW} ORDER BY pos))"


# Gauss-Jordan steps on the rows ``m`` of a system, one a level of the recursion.
ELIMINATION = f"""elim AS (
    SELECT * FROM eq
    UNION ALL
    SELECT {WINDOW}, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k
        THEN list_transform(row, lambda x: x / m[k][k])
        ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END)
    FROM elim WHERE k <= len(m))"""


def share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)"


def number(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def one(column: str) -> str:
    return f"any_value({column})"


def build() -> dict[str, Query]:
    out: dict[str, Query] = {}
    names_of: dict[str, list[str]] = {}

    def add(name: str, sql_values: dict[str, str] | None, sql: str | None = None, names: list[str] | None = None, **kw) -> None:
        features = names or list(sql_values)
        text = sql if sql is not None else (grouped(sql_values, **kw) if sql_values else None)
        out["features_" + name] = Query(spark_query(features), text)
        names_of[name] = features

    add(
        "totals",
        {
            "sum_values": "sum(v)",
            "abs_energy": "sum(v * v)",
            "mean": "avg(v)",
            "root_mean_square": "sqrt(avg(v * v))",
            "length": "count(*)",
        },
    )
    add(
        "spread",
        {
            "standard_deviation": "stddev_pop(v)",
            "variance": "var_pop(v)",
            "variation_coefficient": "CASE WHEN abs(avg(v)) > 1e-12 * max(abs(v)) THEN stddev_pop(v) / avg(v) END",
            "variance_larger_than_standard_deviation": "CASE WHEN var_pop(v) > stddev_pop(v) THEN 1 ELSE 0 END",
            **{
                f"large_standard_deviation__r_{r}": f"CASE WHEN stddev_pop(v) > {r} * (max(v) - min(v)) THEN 1 ELSE 0 END"
                for r in segments.SPREAD_RATIOS
            },
        },
    )
    add("shape", {"skewness": "skewness(v)", "kurtosis": "kurtosis(v)"})
    add("extremes", {"maximum": "max(v)", "minimum": "min(v)", "absolute_maximum": "max(abs(v))"})
    add(
        "locations",
        {
            "first_location_of_maximum": "min(pos) FILTER (v = hi) / count(*)",
            "last_location_of_maximum": "(max(pos) FILTER (v = hi) + 1) / count(*)",
            "first_location_of_minimum": "min(pos) FILTER (v = lo) / count(*)",
            "last_location_of_minimum": "(max(pos) FILTER (v = lo) + 1) / count(*)",
            "has_duplicate_max": "CASE WHEN count(*) FILTER (v = hi) > 1 THEN 1 ELSE 0 END",
            "has_duplicate_min": "CASE WHEN count(*) FILTER (v = lo) > 1 THEN 1 ELSE 0 END",
        },
        source="r2",
    )
    add(
        "value_counts",
        {
            "count_above__t_0": share("v >= 0"),
            "count_below__t_0": share("v <= 0"),
            **{f"value_count__value_{x}": number(f"v = {x}") for x in (0, 1, -1)},
            "range_count__max_1__min_-1": number("v >= -1 AND v < 1"),
            "range_count__max_0__min_-1000000000000.0": number("v < 0"),
            "range_count__max_1000000000000.0__min_0": number("v >= 0"),
        },
    )
    add(
        "repeats",
        {
            "has_duplicate": "CASE WHEN max(c) > 1 THEN 1 ELSE 0 END",
            "ratio_value_number_to_time_series_length": "count(*) / sum(c)",
            "percentage_of_reoccurring_values_to_all_values": share("c > 1"),
            "percentage_of_reoccurring_datapoints_to_all_datapoints": "sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c)",
            "sum_of_reoccurring_values": "sum(CASE WHEN c > 1 THEN v ELSE 0 END)",
            "sum_of_reoccurring_data_points": "sum(CASE WHEN c > 1 THEN v * c ELSE 0 END)",
        },
        source="vc",
        extra=",\nvc AS (SELECT id, e, kind, v, count(*) AS c FROM r GROUP BY id, e, kind, v)",
    )
    largest = ",\ntop AS (SELECT *, row_number() OVER (PARTITION BY id, e, kind ORDER BY abs(v) DESC) AS k FROM r)"
    add(
        "largest",
        {f"mean_n_absolute_max__number_of_maxima_{k}": f"avg(abs(v)) FILTER (k <= {k})" for k in occurrences.LARGEST},
        source="top",
        extra=largest,
    )
    add(
        "changes",
        {
            "absolute_sum_of_changes": "sum(abs(v - l1))",
            "mean_abs_change": "avg(abs(v - l1))",
            "mean_change": "(arg_max(v, pos) - arg_min(v, pos)) / (count(*) - 1)",
            "mean_second_derivative_central": "(arg_max(v - l1, pos) - min(v - l1) FILTER (pos = 1)) / (2 * (count(*) - 2))",
            "cid_ce__normalize_False": "sqrt(sum((v - l1) * (v - l1)))",
            "cid_ce__normalize_True": "sqrt(sum((v - l1) * (v - l1)) / any_value(var))",
        },
        source="g",
        extra=lagged(1),
    )
    add(
        "nonlinear",
        {
            **{f"c3__lag_{k}": f"avg(v * l{k} * l{2 * k})" for k in (1, 2, 3)},
            **{
                f"time_reversal_asymmetry_statistic__lag_{k}": f"avg(v * v * l{k} - l{k} * l{2 * k} * l{2 * k})"
                for k in (1, 2, 3)
            },
        },
        source="g",
        extra=lagged(6),
    )
    add(
        "crossings",
        {f"number_crossing_m__m_{m}": number(f"(v > {m}) <> (l1 > {m})") for m in (0, 1, -1)},
        source="g",
        extra=lagged(1),
    )
    peak_columns = ", ".join(
        f"(v > max(v) OVER (PARTITION BY {WINDOW} ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        f" AND v > max(v) OVER (PARTITION BY {WINDOW} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
        f" AND pos >= {n} AND pos < e - {n}) AS p{n}"
        for n in segments.PEAKS
    )
    add(
        "peaks",
        {f"number_peaks__n_{n}": number(f"p{n}") for n in segments.PEAKS},
        source="pk",
        extra=f",\npk AS (SELECT *, {peak_columns} FROM r)",
    )
    pairs = f""",
pairs AS (
    SELECT a.id, a.e, a.kind, a.n, a.var, b.pos - a.pos AS lag, sum((a.v - a.mu) * (b.v - a.mu)) AS s
    FROM r2 a JOIN r b ON a.id = b.id AND a.e = b.e AND a.kind = b.kind AND b.pos BETWEEN a.pos AND a.pos + 40
    GROUP BY a.id, a.e, a.kind, a.n, a.var, b.pos - a.pos),
acf AS (SELECT id, e, kind, lag, s / ((n - lag) * var) AS a FROM pairs)"""
    add(
        "autocorrelation",
        {f"autocorrelation__lag_{k}": f"max(a) FILTER (lag = {k})" for k in range(10)},
        source="acf",
        extra=pairs,
    )
    add(
        "agg_autocorrelation",
        {
            'agg_autocorrelation__f_agg_"mean"__maxlag_40': "avg(a) FILTER (lag > 0)",
            'agg_autocorrelation__f_agg_"median"__maxlag_40': "median(a) FILTER (lag > 0)",
            'agg_autocorrelation__f_agg_"var"__maxlag_40': "var_pop(a) FILTER (lag > 0)",
        },
        source="acf",
        extra=pairs,
    )
    digits = f""",
digits AS (
    SELECT id, e, kind, k, count(*) FILTER (left(ltrim(CAST(abs(v) AS VARCHAR), '0.'), 1) = CAST(k AS VARCHAR)) AS c
    FROM r, range(1, 10) d(k) GROUP BY id, e, kind, k)"""
    add("benford", {"benford_correlation": "corr(c, log10(1 + 1.0 / k))"}, source="digits", extra=digits)

    def line(x: str, prefix: str) -> dict[str, str]:
        error = f"sqrt((1 - power(corr(v, {x}), 2)) * var_pop(v) / var_pop({x}) / (count(*) - 2))"
        return {
            f'{prefix}__attr_"slope"': f"regr_slope(v, {x})",
            f'{prefix}__attr_"intercept"': f"regr_intercept(v, {x})",
            f'{prefix}__attr_"rvalue"': f"corr(v, {x})",
            f'{prefix}__attr_"stderr"': error,
        }

    add("linear_trend", line("pos", "linear_trend"))
    hours = """,
h AS (SELECT *, (epoch_us(time) - min(epoch_us(time)) OVER (PARTITION BY id, e, kind)) / 3.6e9 AS hours FROM r)"""
    add("linear_trend_timewise", line("hours", "linear_trend_timewise"), source="h", extra=hours)
    # Two-sided Student tail for whole degrees of freedom as a finite sum in the correlation.
    tails = hours + f""",
fits AS (
    SELECT {WINDOW}, axis, count(*)::INTEGER - 2 AS df, abs(corr(v, x)) AS r
    FROM (SELECT {WINDOW}, v, unnest(['pos', 'hours']) AS axis, unnest([pos, hours]) AS x FROM h) GROUP BY {WINDOW}, axis),
tails AS (
    SELECT {WINDOW}, axis, 1 - CASE WHEN df % 2 = 0
        THEN r * list_sum(list_transform(range(0, df // 2),
             lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * power(1 - r * r, j)))
        ELSE 2 / pi() * (asin(r) + r * sqrt(1 - r * r) * list_sum(list_transform(range(0, (df - 1) // 2),
             lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * power(1 - r * r, j)))) END AS p
    FROM fits)"""
    add(
        "trend_p_values",
        {
            'linear_trend__attr_"pvalue"': "max(p) FILTER (axis = 'pos')",
            'linear_trend_timewise__attr_"pvalue"': "max(p) FILTER (axis = 'hours')",
        },
        source="tails",
        extra=tails,
    )
    chunk_sources, chunk_values = [], {}
    for size in occurrences.CHUNKS:
        chunk_sources.append(
            f"SELECT id, e, kind, {size} AS size, pos // {size} AS k, max(v) AS c_max, min(v) AS c_min, "
            f"avg(v) AS c_mean, var_pop(v) AS c_var FROM r GROUP BY id, e, kind, pos // {size}"
        )
        for g in occurrences.CHUNK_STATS:
            y, only = f"c_{g}", f"FILTER (size = {size})"
            slope = f"regr_slope({y}, k) {only}"
            m, r = f"count(*) {only}", f"corr({y}, k) {only}"
            spread = f"(var_pop({y}) {only}) / nullif(var_pop(k) {only}, 0)"
            stem = f'__chunk_len_{size}__f_agg_"{g}"'
            known = f"(max(k) {only}) > 0"
            r_safe = f"coalesce(CASE WHEN isnan({r}) THEN 0 ELSE {r} END, 0)"
            chunk_values |= {
                f'agg_linear_trend__attr_"slope"{stem}': f"CASE WHEN {known} THEN {slope} END",
                f'agg_linear_trend__attr_"intercept"{stem}': f"CASE WHEN {known} THEN regr_intercept({y}, k) {only} END",
                f'agg_linear_trend__attr_"rvalue"{stem}': f"CASE WHEN {known} THEN {r_safe} END",
                f'agg_linear_trend__attr_"stderr"{stem}': f"CASE WHEN {m} = 2 THEN 0 WHEN {m} > 2 THEN "
                f"sqrt(greatest(1 - power({r_safe}, 2), 0) * {spread} / ({m} - 2)) END",
            }
    add("chunk_trends", chunk_values, source="ch", extra=",\nch AS (" + " UNION ALL ".join(chunk_sources) + ")")
    add(
        "beyond_sigma",
        {
            **{f"ratio_beyond_r_sigma__r_{r}": share(f"abs(v - mu) > {r} * sd") for r in windowed.SIGMAS},
            "count_above_mean": number(f"v - mu > {NOISE}"),
            "count_below_mean": number(f"mu - v > {NOISE}"),
        },
        source="r2",
    )
    bins = """,
hist AS (
    SELECT id, e, kind, least(floor((v - lo) / (hi - lo) * 10), 9) AS b, count(*) / any_value(n) AS p
    FROM r2 GROUP BY id, e, kind, b)"""
    add("binned_entropy", {"binned_entropy__max_bins_10": "-sum(p * ln(p))"}, source="hist", extra=bins)
    parts = """,
parts AS (
    SELECT *, CASE WHEN pos < (n % 10) * (n // 10 + 1) THEN pos // (n // 10 + 1)
                   ELSE n % 10 + (pos - (n % 10) * (n // 10 + 1)) // (n // 10) END AS part FROM r2)"""
    add(
        "energy_by_chunks",
        {
            f"energy_ratio_by_chunks__num_segments_10__segment_focus_{i}": f"sum(v * v) FILTER (part = {i}) / any_value(energy)"
            for i in range(10)
        },
        source="parts",
        extra=parts,
    )
    add(
        "quantiles",
        {"median": "median(v)", **{f"quantile__q_{q}": f"quantile_cont(v, {q})" for q in windowed.QUANTILES}},
    )
    add(
        "symmetry",
        {
            f"symmetry_looking__r_{r}": f"CASE WHEN abs(avg(v) - median(v)) < {r} * (max(v) - min(v)) THEN 1 ELSE 0 END"
            for r in windowed.SYMMETRY_RATIOS
        },
    )
    edges = ", ".join(f"quantile_cont(v, {q}) AS e{int(q * 10)}" for q in windowed.CORRIDOR)
    change_values = {}
    for low, high in windowed.CORRIDORS:
        a, b = f"e{int(low * 10)}", f"e{int(high * 10)}"
        inside = f"{a} < {b} AND v BETWEEN {a} AND {b} AND l1 BETWEEN {a} AND {b}"
        for absolute, step in ((False, "v - l1"), (True, "abs(v - l1)")):
            for g, f in (("mean", "avg"), ("var", "var_pop")):
                name = f'change_quantiles__f_agg_"{g}"__isabs_{absolute}__qh_{high}__ql_{low}'
                change_values[name] = f"coalesce({f}({step}) FILTER ({inside}), 0)"
    add(
        "change_quantiles",
        change_values,
        source="cq",
        extra=lagged(1, "r")
        + f",\nedges AS (SELECT id, e, kind, {edges} FROM r GROUP BY id, e, kind),"
        + "\ncq AS (SELECT * FROM g JOIN edges USING (id, e, kind))",
    )
    mass = f""",
ms AS (
    SELECT *, sum(abs(v)) OVER (PARTITION BY {WINDOW} ORDER BY pos) / mass AS m FROM r2)"""
    add(
        "mass_quantiles",
        {f"index_mass_quantile__q_{q}": f"(min(pos) FILTER (m >= {q} * (1 - 1e-12)) + 1) / any_value(n)" for q in windowed.QUANTILES},
        source="ms",
        extra=mass,
    )
    runs = f""",
runs AS (
    SELECT id, e, kind, ga, gb, count(*) FILTER (v - mu > {NOISE}) AS above, count(*) FILTER (mu - v > {NOISE}) AS below FROM (
        SELECT *, sum(CASE WHEN v - mu > {NOISE} THEN 0 ELSE 1 END) OVER (PARTITION BY {WINDOW} ORDER BY pos) AS ga,
               sum(CASE WHEN mu - v > {NOISE} THEN 0 ELSE 1 END) OVER (PARTITION BY {WINDOW} ORDER BY pos) AS gb FROM r2)
    GROUP BY id, e, kind, ga, gb),
strikes AS (
    SELECT id, e, kind, sum(above) AS above, 0 AS below FROM runs GROUP BY id, e, kind, ga
    UNION ALL SELECT id, e, kind, 0, sum(below) FROM runs GROUP BY id, e, kind, gb)"""
    add(
        "strikes",
        {"longest_strike_above_mean": "max(above)", "longest_strike_below_mean": "max(below)"},
        source="strikes",
        extra=runs,
    )
    entropy_sources = []
    for d in occurrences.DIMENSIONS:
        at = ["v" if age == 0 else f"l{age}" for age in range(d)]
        bits = ", ".join(
            f"{at[a]} <= {at[b]}" for a in range(d - 1, 0, -1) for b in range(a - 1, -1, -1)
        )
        entropy_sources.append(
            f"SELECT id, e, kind, {d} AS d, count(*) AS c FROM g WHERE pos >= {d - 1} GROUP BY id, e, kind, [{bits}]"
        )
    out["features_permutation_entropy"] = Query(
        spark_query(occurrences.permutation_names()),
        prelude()
        + lagged(6, "r")
        + ",\npatterns AS ("
        + " UNION ALL ".join(entropy_sources)
        + "),\nentropy AS (SELECT id, e, kind, d, abs(ln(sum(c)) - sum(c * ln(c)) / sum(c)) AS value"
        + " FROM patterns GROUP BY id, e, kind, d)"
        + f"""
SELECT id, e AS window_rows, kind, 'permutation_entropy__dimension_' || d || '__tau_1' AS feature, {r6('value')} AS value
FROM entropy""",
    )
    fourier = f""",
ft AS (
    SELECT id, e, kind, k, CASE WHEN abs(re) > noise THEN re ELSE 0 END AS re,
           CASE WHEN k > 0 AND 2 * k < e AND abs(im) > noise THEN im ELSE 0 END AS im
    FROM (SELECT id, e, kind, k, sum(v * cos(2 * pi() * ((k * pos) % e) / e)) AS re,
                 -sum(v * sin(2 * pi() * ((k * pos) % e) / e)) AS im, 1e-12 * sum(abs(v)) AS noise
          FROM r, range(0, 100) o(k) WHERE 2 * k <= e GROUP BY id, e, kind, k)),
grid AS (SELECT w.id, w.e, x.kind, o.k FROM windows w, (VALUES ('x'), ('y')) x(kind), range(0, 100) o(k)),
parts AS (
    SELECT g.id, g.e, g.kind, g.k, re, im FROM grid g
    LEFT JOIN ft ON ft.id = g.id AND ft.e = g.e AND ft.kind = g.kind AND ft.k = g.k)
SELECT id, e AS window_rows, kind, 'fft_coefficient__attr_"' || attr || '"__coeff_' || k AS feature,
       {r6('value')} AS value
FROM (SELECT id, e, kind, k, unnest([{{'attr': 'real', 'value': re}}, {{'attr': 'imag', 'value': im}},
      {{'attr': 'abs', 'value': sqrt(re * re + im * im)}}, {{'attr': 'angle', 'value': degrees(atan2(im, re))}}],
      recursive := true) FROM parts)"""
    out["features_fourier"] = Query(spark_query(windowed.fourier_names()), prelude() + fourier)
    density = """,
hann AS (SELECT id, e, kind, pos, (v - mu) * (0.5 - 0.5 * cos(2 * pi() * pos / e)) AS u,
                power(0.5 - 0.5 * cos(2 * pi() * pos / e), 2) AS ww FROM r2),
psd AS (
    SELECT id, e, kind, k,
           (power(sum(u * cos(2 * pi() * ((k * pos) % e) / e)), 2) + power(sum(u * sin(2 * pi() * ((k * pos) % e) / e)), 2))
           / sum(ww) * (CASE WHEN k = 0 OR 2 * k = e THEN 1 ELSE 2 END) AS p
    FROM hann, range(0, 129) o(k) WHERE 2 * k <= e GROUP BY id, e, kind, k)"""
    add(
        "spectral_density",
        {f"spkt_welch_density__coeff_{k}": f"max(p) FILTER (k = {k})" for k in spectral.DENSITY_COEFFS},
        source="psd",
        extra=density,
    )
    moments = """,
weights AS (
    SELECT id, e, kind, sum(k * sqrt(p)) / sum(sqrt(p)) AS m1, sum(power(k, 2) * sqrt(p)) / sum(sqrt(p)) AS m2,
           sum(power(k, 3) * sqrt(p)) / sum(sqrt(p)) AS m3, sum(power(k, 4) * sqrt(p)) / sum(sqrt(p)) AS m4
    FROM psd GROUP BY id, e, kind)"""
    var = "(m2 - m1 * m1)"
    add(
        "spectral_moments",
        {
            'spectral_moments__aggtype_"centroid"': one("m1"),
            'spectral_moments__aggtype_"variance"': one(var),
            'spectral_moments__aggtype_"skew"': one(
                f"CASE WHEN {var} >= 0.5 THEN (m3 - 3 * m1 * {var} - power(m1, 3)) / power({var}, 1.5) END"
            ),
            'spectral_moments__aggtype_"kurtosis"': one(
                f"CASE WHEN {var} >= 0.5 THEN (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * power(m1, 4)) / power({var}, 2) END"
            ),
        },
        source="weights",
        extra=density + moments,
    )
    spans = ", ".join(f"({b})" for b in spectral.ENTROPY_BINS)
    entropy = f""",
relative AS (
    SELECT *, p / max(p) OVER (PARTITION BY id, e, kind) AS q FROM psd),
bounds AS (SELECT id, e, kind, min(q) AS lo, count(*) AS n FROM relative GROUP BY id, e, kind),
placed AS (
    SELECT id, e, kind, bins, least(floor((q - lo) / (1 - lo) * bins), bins - 1) AS b, count(*) / any_value(n) AS share
    FROM relative JOIN bounds USING (id, e, kind), (VALUES {spans}) s(bins) GROUP BY id, e, kind, bins, b)"""
    add(
        "fourier_entropy",
        {f"fourier_entropy__bins_{b}": f"-sum(share * ln(share)) FILTER (bins = {b})" for b in spectral.ENTROPY_BINS},
        source="placed",
        extra=density + entropy,
    )
    widths = ", ".join(f"({w})" for w in spectral.WIDTHS)
    wavelet = f""",
taps AS (
    SELECT id, e, kind, w, k, v, least(10 * w, e) AS m, k + (least(10 * w, e) - 1) // 2 - pos AS t
    FROM r, (VALUES {widths}) s(w), range(0, 15) o(k)),
resp AS (
    SELECT id, e, kind, w, k,
           sum(v * 2 / (sqrt(3.0 * w) * power(pi(), 0.25)) * (1 - power((t - (m - 1) / 2.0) / w, 2))
               * exp(-power(t - (m - 1) / 2.0, 2) / (2.0 * w * w))) AS c
    FROM taps WHERE t >= 0 AND t < m GROUP BY id, e, kind, w, k)"""
    add(
        "wavelet",
        {
            f"cwt_coefficients__coeff_{k}__w_{w}__widths_{spectral.WIDTHS}": f"max(c) FILTER (w = {w} AND k = {k})"
            for w in spectral.WIDTHS
            for k in range(spectral.WAVELET_COEFFS)
        },
        source="resp",
        extra=wavelet,
    )
    # Durbin-Levinson steps, one a level of the recursion; ``cov[k + 1]`` is lag k.
    levinson = pairs + """,
cov AS (SELECT id, e, kind, list(s / (n - lag) ORDER BY lag) FILTER (lag < 10) AS cov, any_value(n) AS n FROM pairs GROUP BY id, e, kind),
lev AS (
    SELECT id, e, kind, n, cov, 1 AS k, [cov[2] / cov[1]] AS phi, cov[1] * (1 - power(cov[2] / cov[1], 2)) AS noise, cov[2] / cov[1] AS a
    FROM cov WHERE cov[1] <> 0
    UNION ALL
    SELECT id, e, kind, n, cov, k + 1,
           list_append(list_transform(range(1, k + 1), lambda j: phi[j] - step * phi[k + 1 - j]), step), noise * (1 - step * step), step
    FROM (SELECT *, (cov[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * cov[k + 2 - j]))) / noise AS step
          FROM lev WHERE k < least(9, n // 2 - 1))),
pacf AS (SELECT id, e, kind, k, a FROM lev UNION ALL SELECT id, e, kind, 0, 1.0 FROM cov WHERE cov[1] <> 0)"""
    add(
        "partial_autocorrelation",
        {f"partial_autocorrelation__lag_{k}": f"max(a) FILTER (k = {k})" for k in range(10)},
        sql=grouped(
            {f"partial_autocorrelation__lag_{k}": f"max(a) FILTER (k = {k})" for k in range(10)}, source="pacf", extra=levinson
        ).replace("WITH ", "WITH RECURSIVE ", 1),
    )
    terms = ["1.0", *(f"l{k}" for k in range(1, 11))]
    equations = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in (*terms, "v")) + "]" for a in terms)
    autoregression = lagged(10, "r") + f""",
eq AS (SELECT {WINDOW}, 1 AS k, [{equations}] AS m FROM g WHERE pos >= 10 AND e >= 21 GROUP BY {WINDOW}),
{ELIMINATION}"""
    weights = {
        f"ar_coefficient__coeff_{k}__k_10": f"max(CASE WHEN e >= 21 THEN weight END) FILTER (i = {k})" for k in range(11)
    }
    solved = autoregression + f""",
ar AS (
    SELECT {WINDOW}, unnest(range(0, 11)) AS i, unnest(list_transform(m, lambda row: row[12])) AS weight FROM elim WHERE k = 12
    UNION ALL SELECT id, e, kind, 0, NULL FROM r WHERE e < 21)"""
    add("ar_coefficients", weights, sql=grouped(weights, source="ar", extra=solved).replace("WITH ", "WITH RECURSIVE ", 1))
    add("unit_root", None, names=segments.unit_root_names(), sql=_unit_root_sql())
    # The cubic is fitted on the bin means, brought to [-1, 1], by elimination. Of its roots
    # the largest real part is wanted: the cosine form where all three are real, else that
    # of the real root or of the two others.
    powers = "[" + ", ".join("[" + ", ".join(f"sum(power(z, {i + j}))" for j in range(4)) + f", sum(power(z, {i}) * y)]" for i in range(4)) + "]"
    cubic = f""",
p AS (
    SELECT {WINDOW}, b, v - b AS step
    FROM (SELECT {WINDOW}, v, lag(v) OVER (PARTITION BY {WINDOW} ORDER BY pos) AS b FROM r) WHERE b IS NOT NULL),
edges AS (
    SELECT {WINDOW}, quantile_cont(b, [{', '.join(f'{i}::DOUBLE / {spectral.DRIFT_BINS}' for i in range(spectral.DRIFT_BINS + 1))}]) AS q
    FROM p GROUP BY {WINDOW}),
binned AS (
    SELECT p.id, p.e, p.kind, b, step, len(list_filter(q[2:{spectral.DRIFT_BINS}], lambda x: x + 1e-12 * (q[{spectral.DRIFT_BINS + 1}] - q[1]) < b)) AS bin
    FROM p JOIN edges USING (id, e, kind) WHERE len(list_distinct(q)) = {spectral.DRIFT_BINS + 1}),
means AS (SELECT {WINDOW}, bin, avg(b) AS x, avg(step) AS y FROM binned GROUP BY {WINDOW}, bin),
span AS (SELECT {WINDOW}, (min(x) + max(x)) / 2 AS c, (max(x) - min(x)) / 2 AS s FROM means GROUP BY {WINDOW}),
eq AS (
    SELECT {WINDOW}, 1 AS k, {powers} AS m
    FROM (SELECT means.id, means.e, means.kind, y, (x - c) / s AS z FROM means JOIN span USING (id, e, kind)) GROUP BY {WINDOW}),
{ELIMINATION},
fitted AS (
    SELECT {WINDOW}, c, s, m[1][5] AS b0, m[2][5] AS b1, m[3][5] AS b2, m[4][5] AS b3
    FROM elim JOIN span USING (id, e, kind) WHERE k = 5),
reduced AS (
    SELECT *, b1 / b3 - power(b2 / b3, 2) / 3 AS dp, 2 * power(b2 / b3, 3) / 27 - b2 * b1 / (3 * b3 * b3) + b0 / b3 AS dq FROM fitted),
judged AS (SELECT *, dq * dq / 4 + dp * dp * dp / 27 AS d FROM reduced),
cubed AS (SELECT *, -dq / 2 + CASE WHEN dq > 0 THEN -1 ELSE 1 END * sqrt(greatest(d, 0)) AS u3 FROM judged),
rooted AS (SELECT *, sign(u3) * power(abs(u3), 1.0 / 3) AS u FROM cubed),
placed AS (
    SELECT *, CASE WHEN d < 0 THEN 2 * sqrt(-dp / 3) * cos(acos(greatest(-1.0, least(1.0, -dq / 2 / sqrt(-dp * dp * dp / 27)))) / 3)
                   ELSE greatest(u - coalesce(dp / nullif(3 * u, 0), 0), -(u - coalesce(dp / nullif(3 * u, 0), 0)) / 2) END AS t
    FROM rooted),
every AS (SELECT DISTINCT {WINDOW} FROM r)"""
    drift = dict(
        zip(
            spectral.drift_names(),
            [
                "b3 / power(s, 3)",
                "b2 / power(s, 2) - 3 * c * b3 / power(s, 3)",
                "b1 / s - 2 * c * b2 / power(s, 2) + 3 * c * c * b3 / power(s, 3)",
                "b0 - c * b1 / s + c * c * b2 / power(s, 2) - power(c, 3) * b3 / power(s, 3)",
                "c + s * (t - b2 / (3 * b3))",
            ],
        )
    )
    columns = ", ".join(f"{sql} AS f{i}" for i, sql in enumerate(drift.values()))
    fitted = f"SELECT every.id, every.e, every.kind, {columns} FROM every LEFT JOIN placed USING (id, e, kind)"
    add(
        "drift",
        None,
        names=spectral.drift_names(),
        sql=prelude().replace("WITH ", "WITH RECURSIVE ", 1) + cubic + listed({n: f"f{i}" for i, n in enumerate(drift)}, fitted),
    )

    minimal_values = {
        "sum_values": "sum(v)",
        "median": "median(v)",
        "mean": "avg(v)",
        "length": "count(*)",
        "standard_deviation": "stddev_pop(v)",
        "variance": "var_pop(v)",
        "root_mean_square": "sqrt(avg(v * v))",
        "maximum": "max(v)",
        "absolute_maximum": "max(abs(v))",
        "minimum": "min(v)",
    }
    out["features_minimal"] = Query(spark_query(minimal()), grouped(minimal_values))
    out["features_selected"] = Query(_selected, _selected_sql())
    out["features_from_names"] = Query(_from_names, _selected_sql())
    out["features_matrix"] = Query(_matrix, _matrix_sql())
    out["features_long_series"] = Query(spark_query(minimal(), long_windows), grouped(minimal_values, view=_long_prelude()))
    long_density = f""",
segs AS (
    SELECT r.id, r.e, r.kind, m, pos - 128 * m AS i, v, avg(v) OVER (PARTITION BY r.id, r.e, r.kind, m) AS mu
    FROM r JOIN range(0, 100000) s(m) ON m BETWEEN greatest((pos - 255 + 127) // 128, 0) AND pos // 128
    WHERE 128 * m + 256 <= r.e AND pos - 128 * m BETWEEN 0 AND 255),
parts AS (
    SELECT id, e, kind, m, k,
           sum((v - mu) * (0.5 - 0.5 * cos(2 * pi() * i / 256)) * cos(2 * pi() * ((k * i) % 256) / 256)) AS re,
           sum((v - mu) * (0.5 - 0.5 * cos(2 * pi() * i / 256)) * sin(2 * pi() * ((k * i) % 256) / 256)) AS im
    FROM segs, (VALUES (2), (5), (8)) o(k) GROUP BY id, e, kind, m, k),
psd AS (SELECT id, e, kind, k, avg(2 * (re * re + im * im) / 96.0) AS p FROM parts GROUP BY id, e, kind, k)"""
    out["features_spectral_density_long"] = Query(
        spark_query([f"spkt_welch_density__coeff_{k}" for k in spectral.DENSITY_COEFFS], long_windows),
        grouped(
            {f"spkt_welch_density__coeff_{k}": f"max(p) FILTER (k = {k})" for k in spectral.DENSITY_COEFFS},
            source="psd",
            extra=long_density,
            view=_long_prelude(),
        ),
    )
    for name in LONG:
        sql = out[f"features_{name}"].sql.replace(prelude(), _long_prelude(), 1)
        out[f"features_{name}_long"] = Query(spark_query(names_of[name], long_windows), sql)
    out["impute"] = Query(_impute, _impute_sql())
    names_of["fourier"] = windowed.fourier_names()
    names_of["permutation_entropy"] = occurrences.permutation_names()
    out["features_efficient"] = Query(_efficient, _efficient_sql(out, names_of))
    # A window end at every row: as many ends as rows to fold the segments over.
    for name in ("totals", "extremes", "repeats", "largest"):
        sql = out[f"features_{name}"].sql.replace(prelude(), prelude(LONG_SENSOR, LONG_MIN_TIMESHIFT, 1), 1)
        out[f"features_{name}_every_row"] = Query(spark_query(names_of[name], every_row), sql)
    return out


UNIT_ROOT_LAGS = 16  # enough for windows of 316 rows


def _unit_root_sql() -> str:
    """Elimination on the regression of a step on 1, the level before it and earlier steps.

    With the step itself as a last row, the corner element after j pivots is the residual of
    the fit on the first j columns: one elimination scores every number of lags. A second
    one on the chosen number, with a unit column beside it, gives the statistic.
    """
    lags = [f"y{k}" for k in range(1, UNIT_ROOT_LAGS + 1)]
    columns = ["1.0", "l", *lags]
    size = len(columns)

    def product(i: int, j: int | str) -> str:
        """Sum of products of two columns (a number, or 'y'), those beyond the depth as a unit matrix."""
        last = max(i, j) if isinstance(j, int) else i
        other = columns[j] if isinstance(j, int) else "y"
        inside = f"sum({columns[i]} * {other})"
        if last < 2:
            return inside
        return f"CASE WHEN max(depth) >= {last - 1} THEN {inside} ELSE {1.0 if i == j else 0.0} END"

    rows = [[product(i, j) for j in range(size)] for i in range(size)]
    right = [product(i, "y") for i in range(size)]
    first = [[*row, y] for row, y in zip(rows, right)] + [[*right, "sum(y * y)"]]
    second = [[*row, y, "1.0" if i == 1 else "0.0"] for i, (row, y) in enumerate(zip(rows, right))]
    matrix = lambda m: "[" + ", ".join("[" + ", ".join(row) + "]" for row in m) + "]"
    # Spark's value is missing where all values of a window are equal
    sql = f""",
level AS (
    SELECT {WINDOW}, pos, n, v - mu AS x, least(n // 2 - 2, ceil(12 * power(n / 100.0, 0.25)))::BIGINT AS tried
    FROM r2 WHERE sd > 0),
steps AS (SELECT *, lag(x) OVER w AS l, x - lag(x) OVER w AS y FROM level WINDOW w AS (PARTITION BY {WINDOW} ORDER BY pos)),
lagged AS (
    SELECT *, {', '.join(f'lag(y, {k}) OVER w AS y{k}' for k in range(1, UNIT_ROOT_LAGS + 1))}
    FROM steps WINDOW w AS (PARTITION BY {WINDOW} ORDER BY pos)),
eq AS (
    SELECT {WINDOW}, 1 AS k, {matrix(first)} AS m
    FROM (SELECT *, tried AS depth FROM lagged WHERE pos > tried) GROUP BY {WINDOW}),
{ELIMINATION},
sized AS (SELECT {WINDOW}, any_value(n) AS n, any_value(tried) AS tried FROM level GROUP BY {WINDOW}),
scored AS (
    SELECT elim.id, elim.e, elim.kind, k - 3 AS lags,
           (n - 1 - tried) * ln(m[{size + 1}][{size + 1}] / (n - 1 - tried)) + 2 * (k - 1) AS score
    FROM elim JOIN sized USING (id, e, kind) WHERE k - 3 BETWEEN 0 AND tried),
chosen AS (SELECT {WINDOW}, arg_min(lags, (score, lags)) AS used FROM scored GROUP BY {WINDOW}),
eq2 AS (
    SELECT {WINDOW}, 1 AS k, {matrix(second)} AS m, sum(y * y) AS yy, [{', '.join(right)}] AS xy, max(depth) AS used, count(*) AS rows_used
    FROM (SELECT lagged.*, used AS depth FROM lagged JOIN chosen USING (id, e, kind) WHERE pos > used) GROUP BY {WINDOW}),
{ELIMINATION.replace("elim", "elim2").replace("FROM eq", f"FROM (SELECT {WINDOW}, k, m FROM eq2)")},
done AS (
    SELECT elim2.id, elim2.e, elim2.kind, used, elim2.m[2][{size + 1}] AS w, elim2.m[2][{size + 2}] AS inv,
           (yy - list_sum(list_transform(range(1, {size + 1}), lambda i: elim2.m[i][{size + 1}] * xy[i]))) / (rows_used - used - 2) AS noise
    FROM elim2 JOIN eq2 USING (id, e, kind) WHERE elim2.k = {size + 1}),
tested AS (SELECT *, w / sqrt(noise * inv) AS stat FROM done),
surface AS (
    SELECT *, CASE WHEN stat <= -1.61 THEN 2.1659 + 1.4412 * stat + 0.038269 * stat * stat
                   ELSE 1.7339 + 0.93202 * stat - 0.12745 * stat * stat - 0.010368 * stat * stat * stat END AS z
    FROM tested),
valued AS (
    SELECT *, CASE WHEN stat > 2.74 THEN 1.0 WHEN stat < -18.83 THEN 0.0 WHEN abs(z) > 8 THEN (z > 0)::INTEGER
        ELSE 0.5 + z / 400 / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 401), lambda i:
            CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * i / 400, 2) / 2))) END AS p
    FROM surface),
every AS (SELECT DISTINCT {WINDOW} FROM r)"""
    result = "SELECT every.id, every.e, every.kind, stat AS f0, p AS f1, used AS f2 FROM every LEFT JOIN valued USING (id, e, kind)"
    values = {name: f"f{i}" for i, name in enumerate(segments.unit_root_names())}
    return prelude().replace("WITH ", "WITH RECURSIVE ", 1) + sql + listed(values, result)


def _long_prelude() -> str:
    return prelude(LONG_SENSOR, LONG_MIN_TIMESHIFT, LONG_STEP)


SELECTED = {
    "x": {"maximum": "max(v)", "abs_energy": "sum(v * v)", "c3__lag_1": "avg(v * l1 * l2)"},
    "y": {"minimum": "min(v)", "mean_abs_change": "avg(abs(v - l1))"},
}


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(extract_features(windows(spark, sf_dir), {k: list(v) for k, v in SELECTED.items()}))


def _from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that the columns of a matrix are named after."""
    columns = [column_name(kind, name) for kind, values in SELECTED.items() for name in values]
    return published(extract_features(windows(spark, sf_dir), from_columns(columns)))


def _selected_sql() -> str:
    chosen = {(k, name): sql for k, values in SELECTED.items() for name, sql in values.items()}
    columns = ", ".join(f"CAST({sql} AS DOUBLE) AS f{i}" for i, sql in enumerate(chosen.values()))
    parts = " UNION ALL ".join(
        f"SELECT id, e AS window_rows, kind, '{name}' AS feature, {r6(f'f{i}')} AS value FROM t WHERE kind = '{kind}'"
        for i, (kind, name) in enumerate(chosen)
    )
    return prelude() + lagged(2) + f",\nt AS (SELECT {WINDOW}, {columns} FROM g GROUP BY {WINDOW}) {parts}"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames: Frames = windows(spark, sf_dir)
    spec = {kind: ["maximum", "mean", "quantile__q_0.9"] for kind in ("x", "y")}
    columns = matrix_columns(spec)
    wide = to_matrix(extract_features(frames, spec), ["id", "end"], columns)
    return wide.select(
        "id", F.col("end").alias("window_rows"), *[rounded(F.col(f"`{n}`")).alias(n.replace(".", "_")) for n in columns]
    )


def _matrix_sql() -> str:
    columns = ", ".join(
        f"{r6(f'{sql} FILTER (kind = {kind!r})')} AS {kind}__{name}"
        for kind in ("x", "y")
        for name, sql in (("maximum", "max(v)"), ("mean", "avg(v)"), ("quantile__q_0_9", "quantile_cont(v, 0.9)"))
    )
    return prelude() + f"\nSELECT id, e AS window_rows, {columns} FROM r GROUP BY id, e"


def every_row(spark: SparkSession, sf_dir: str) -> Frames:
    return expanding(prepared(spark, sf_dir, long_sensor), LONG_MIN_TIMESHIFT, 1)


def _efficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalogue for both axes in one call."""
    return published(extract_features(windows(spark, sf_dir), efficient()))


def _efficient_sql(queries: dict[str, Query], names_of: dict[str, list[str]]) -> str:
    """Every feature of the catalogue from the query of its group."""
    left, parts = set(efficient()), []
    for name, features in names_of.items():
        mine, sql = left & set(features), queries[f"features_{name}"].sql
        if mine and sql:
            names = ", ".join(f"'{n}'" for n in sorted(mine))
            parts.append(f"SELECT id, window_rows, kind, feature, value FROM ({sql}) WHERE feature IN ({names})")
            left -= mine
    return "\nUNION ALL ".join(parts)


def _impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = extract_features(windows(spark, sf_dir), ["maximum", "minimum"])
    value = F.col("value")
    holes = F.when(F.pmod("end", F.lit(7)) == 0, None).when(F.pmod("end", F.lit(5)) == 0, float("inf"))
    broken = features.withColumn("value", holes.when(F.pmod("end", F.lit(4)) == 0, float("-inf")).otherwise(value))
    return published(impute(broken, ["id", "end"]))


def _impute_sql() -> str:
    return (
        prelude()
        + f""",
f AS (
    SELECT id, e, kind, 'maximum' AS feature, max(v) AS value FROM r GROUP BY id, e, kind
    UNION ALL SELECT id, e, kind, 'minimum', min(v) FROM r GROUP BY id, e, kind),
broken AS (
    SELECT *, (e % 7 <> 0 AND e % 5 <> 0 AND e % 4 <> 0) AS known FROM f),
stats AS (
    SELECT kind, feature, min(value) FILTER (known) AS lo, max(value) FILTER (known) AS hi,
           quantile_cont(value, 0.5) FILTER (known) AS med FROM broken GROUP BY kind, feature),
filled AS (
    SELECT id, e, b.kind, b.feature,
           CASE WHEN e % 7 = 0 THEN med WHEN e % 5 = 0 THEN hi WHEN e % 4 = 0 THEN lo ELSE value END AS value
    FROM broken b JOIN stats s ON b.kind = s.kind AND b.feature = s.feature)
SELECT id, e AS window_rows, kind, feature, {r6('coalesce(value, 0)')} AS value FROM filled"""
    )
