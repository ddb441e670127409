"""Feature sets, extraction by name, wide matrices and imputation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.features import occurrences, segments, spectral, windowed
from tremorline.features.rows import union_all
from tremorline.operators.indexing import quoted
from tremorline.operators.quantiles import group_quantiles
from tremorline.operators.rolling import Frames
from tremorline.session import stage, stage_folder, staging_scope

Family = Callable[[Frames, list[str], list[str]], DataFrame]

# Calls of more families write down each family's result before the next one runs.
FAMILIES_AT_ONCE = 4

# The ten features of the minimal set.
MINIMAL = (
    "sum_values",
    "median",
    "mean",
    "length",
    "standard_deviation",
    "variance",
    "root_mean_square",
    "maximum",
    "absolute_maximum",
    "minimum",
)


def families() -> dict[str, tuple[Family, list[str]]]:
    """Family name to its extractor and the features it yields; one scan per family."""
    return {
        "segments": (segments.extract, list(segments.catalogue())),
        "unit_root": (segments.unit_root, segments.unit_root_names()),
        "repeats": (occurrences.repeated_values, occurrences.repeat_names()),
        "largest": (occurrences.largest_magnitudes, occurrences.largest_names()),
        "permutation": (occurrences.permutation_entropy, occurrences.permutation_names()),
        "chunk_trend": (occurrences.chunk_trends, occurrences.chunk_trend_names()),
        "beyond": (windowed.beyond_statistics, windowed.beyond_names()),
        "energy": (windowed.energy_by_parts, windowed.energy_names()),
        "quantiles": (windowed.quantile_features, windowed.quantile_names()),
        "changes": (windowed.change_quantiles, windowed.change_names()),
        "mass": (windowed.mass_quantiles, windowed.mass_names()),
        "strikes": (windowed.longest_strikes, windowed.strike_names()),
        "fourier": (windowed.fourier_coefficients, windowed.fourier_names()),
        "spectral": (spectral.spectral_features, spectral.spectral_names()),
        "wavelet": (spectral.wavelet_features, spectral.wavelet_names()),
        "drift": (spectral.drift_features, spectral.drift_names()),
    }


def efficient() -> list[str]:
    """All features of the catalogue."""
    return [name for _, names in families().values() for name in names]


def minimal() -> list[str]:
    return list(MINIMAL)


def column_name(kind: str, feature: str) -> str:
    return f"{kind}__{feature}"


def from_columns(columns: list[str]) -> dict[str, list[str]]:
    """Matrix column names back to the features wanted per axis; unknown names are an error."""
    known = set(efficient())
    spec: dict[str, list[str]] = {}
    for column in columns:
        kind, _, feature = column.partition("__")
        if feature not in known:
            raise ValueError(f"unknown feature column {column!r}")
        spec.setdefault(kind, []).append(feature)
    return spec


def extract_features(frames: Frames, spec: list[str] | dict[str, list[str]]) -> DataFrame:
    """Long features: window keys, ``kind``, ``feature``, ``value``.

    ``spec`` is a list of features for every axis or a list per axis. Only the families
    that are asked for run, and only with the aggregates they need. Where many families are
    asked for, each one's features are staged, and its shuffles and its own staged tables go,
    before the next family runs: disk holds the features and one family's work at a time.
    """
    if frames.series.nulls:
        raise ValueError("fill missing values before extracting features")
    if not isinstance(spec, dict):
        spec = {kind: list(spec) for kind in frames.series.values}
    wanted = {name for names in spec.values() for name in names}
    grids = {"quantiles": [0.5, *windowed.QUANTILES], "changes": windowed.CORRIDOR}
    asked = [grids[f] for f, (_, names) in families().items() if f in grids and wanted & set(names)]
    # Families of one call share window statistics, packed values and quantiles.
    shared = {"probabilities": sorted({p for grid in asked for p in grid})} if len(asked) > 1 else {}
    shared["blocks"] = all(wanted & set(families()[f][1]) for f in ("beyond", "strikes"))
    many = sum(bool(wanted & set(names)) for _, names in families().values()) > FAMILIES_AT_ONCE
    spark, folder = frames.rows.sparkSession, stage_folder(frames.rows.sparkSession)
    shared["folder"] = folder
    frames = replace(frames, shared=shared)

    def computed(family: Family, names: list[str], kinds: list[str]) -> DataFrame:
        if not many:
            return family(frames, names, kinds)
        with staging_scope(spark):
            return stage(family(frames, names, kinds), "family", folder)

    tables = []
    for family, names in families().values():
        chosen: dict[tuple[str, ...], list[str]] = {}
        for kind, wanted in spec.items():
            mine = tuple(n for n in names if n in set(wanted))
            if mine:
                chosen.setdefault(mine, []).append(kind)
        tables += [computed(family, list(mine), kinds) for mine, kinds in chosen.items()]
    return union_all(tables)


def with_time_end(features: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Replace window length by the window's end time as the second part of its key."""
    return features.join(labels.select(*keys, "end", "time_end"), [*keys, "end"]).drop("end")


def to_matrix(features: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide matrix: one row per window, one column per axis and feature."""
    name = F.concat_ws("__", "kind", "feature")
    return features.withColumn("_name", name).groupBy(*keys).pivot("_name", columns).agg(F.max("value"))


def align_columns(matrix: DataFrame, train: DataFrame) -> DataFrame:
    """The columns of the training matrix in its order; a missing one is an error."""
    return matrix.select(*[quoted(name) for name in train.columns])


def matrix_columns(spec: dict[str, list[str]]) -> list[str]:
    return [column_name(kind, feature) for kind, names in spec.items() for feature in names]


def impute(features: DataFrame, window_keys: list[str]) -> DataFrame:
    """Per axis and feature: +inf to the largest finite value, -inf to the smallest, missing
    to the median; zero where no finite value exists."""
    value = F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    staged = stage(features.withColumn("_finite", F.when(finite, value)), "features")
    by = ["kind", "feature"]
    bounds = staged.groupBy(*by).agg(F.min("_finite").alias("_lo"), F.max("_finite").alias("_hi"))
    middle = group_quantiles(staged, by, "_finite", [0.5])
    middle = middle.select(*by, F.col("q")[0].alias("_mid"))
    stats = stage(bounds.join(middle, by, "left"), "impute")
    filled = (
        F.when(value == float("inf"), F.col("_hi"))
        .when(value == float("-inf"), F.col("_lo"))
        .when(F.col("_finite").isNull(), F.col("_mid"))
        .otherwise(value)
    )
    return staged.join(stats, by).select(*window_keys, *by, F.coalesce(filled, F.lit(0.0)).alias("value"))
