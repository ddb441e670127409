"""Features of repeated values, largest magnitudes, ordinal patterns and chunk trends.

Each family reduces the rows once per segment and accumulates over the window ends."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorline.features.rows import as_long, lagged_rows, long_rows
from tremorline.operators.indexing import block_of
from tremorline.operators.rolling import Frames
from tremorline.operators.scans import running_largest

c = F.col

# Parameter grids of the feature catalogue.
LARGEST = (3, 5, 7)
DIMENSIONS = (3, 4, 5, 6, 7)
CHUNKS = (5, 10, 50)
CHUNK_STATS = ("max", "min", "mean", "var")
CHUNK_ATTRS = ("intercept", "rvalue", "slope", "stderr")

REPEATS = (
    "has_duplicate",
    "ratio_value_number_to_time_series_length",
    "percentage_of_reoccurring_values_to_all_values",
    "percentage_of_reoccurring_datapoints_to_all_datapoints",
    "sum_of_reoccurring_values",
    "sum_of_reoccurring_data_points",
)


def repeated_values(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """A value becomes distinct at its first occurrence and reoccurring at its second, so
    counting both events per segment gives every window without regrouping its rows."""
    counted = long_rows(frames, kinds).groupBy(*frames.window_keys, "kind", "v").agg(F.count(F.lit(1)).alias("cnt"))
    counted = frames.upto(counted, {"earlier": (c("cnt"), "sum")}, ("v",), exclusive=True)
    before = F.coalesce("earlier", F.lit(0))
    turned = (c("before") < 2) & (c("before") + c("cnt") >= 2)
    points = F.when(turned, c("before") + c("cnt")).when(c("before") >= 2, c("cnt")).otherwise(0)
    events = (
        counted.withColumn("before", before)
        .groupBy(*frames.window_keys, "kind")
        .agg(
            F.sum("cnt").alias("n"),
            F.sum(F.when(c("before") == 0, 1).otherwise(0)).alias("distinct"),
            F.sum(F.when(turned, 1).otherwise(0)).alias("repeated"),
            F.sum(F.when(turned, c("v")).otherwise(0.0)).alias("repeated_sum"),
            F.sum(points).alias("points"),
            F.sum(c("v") * points).alias("points_sum"),
        )
    )
    totals = ("n", "distinct", "repeated", "repeated_sum", "points", "points_sum")
    table = frames.upto(events, {name: (c(name), "sum") for name in totals})
    values = {
        "has_duplicate": (c("distinct") < c("n")).cast("double"),
        "ratio_value_number_to_time_series_length": c("distinct") / c("n"),
        "percentage_of_reoccurring_values_to_all_values": c("repeated") / c("distinct"),
        "percentage_of_reoccurring_datapoints_to_all_datapoints": c("points") / c("n"),
        "sum_of_reoccurring_values": c("repeated_sum"),
        "sum_of_reoccurring_data_points": c("points_sum"),
    }
    return as_long(table, frames.window_keys, {name: values[name] for name in names})


def largest_magnitudes(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Mean of the k largest |x|.

    Per segment only its 7 largest values are kept; ``running_largest`` follows them over
    the window ends.
    """
    deepest = max(LARGEST)
    rows = long_rows(frames, kinds).select(*frames.window_keys, "kind", "pos", F.abs("v").alias("a"))
    by_block = Window.partitionBy(*frames.window_keys, "kind", "_block").orderBy(F.desc("a"))
    by_segment = Window.partitionBy(*frames.window_keys, "kind").orderBy(F.desc("a"))
    top = (
        rows.withColumn("_block", block_of(c("pos")))
        .withColumn("_r", F.row_number().over(by_block))
        .filter(c("_r") <= deepest)
        .withColumn("_r", F.row_number().over(by_segment))
        .filter(c("_r") <= deepest)
    )
    step = frames.step or 1
    count = frames.series.longest // step + 1 if frames.step else 1
    numbered = top.withColumn("_window", F.floor(c("end") / step))
    largest = running_largest(numbered, [*frames.keys, "kind"], "_window", count, "a", deepest)
    ends = top.select(*frames.window_keys, "kind", F.floor(c("end") / step).alias("_window")).distinct()
    per_window = largest.join(ends, [*frames.keys, "kind", "_window"])
    values = {}
    for k in LARGEST:
        mean = sum((c(f"m{i}") for i in range(2, k + 1)), c("m1")) / k
        values[f"mean_n_absolute_max__number_of_maxima_{k}"] = F.when(c("end") > k, mean)
    return as_long(per_window, frames.window_keys, {name: values[name] for name in names})


def _xlogx(count: Column) -> Column:
    return F.when(count > 0, count * F.ln(count.cast("double"))).otherwise(0.0)


def permutation_entropy(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Entropy of ordinal patterns of consecutive values.

    A pattern is the set of its pairwise comparisons. With counts c and total N the entropy
    is ln N - sum(c ln c) / N; the sum changes per segment only for patterns seen there.
    """
    dims = [d for d in DIMENSIONS if f"permutation_entropy__dimension_{d}__tau_1" in names]
    deepest = max(dims)
    rows = lagged_rows(long_rows(frames, kinds), frames.keys, list(range(1, deepest)))
    at = lambda age: c("v") if age == 0 else c(f"lag_{age}")

    def pattern(dim: int) -> Column:
        code = F.lit(0).cast("bigint")
        bit = 1
        for older in range(dim - 1, 0, -1):
            for newer in range(older - 1, -1, -1):
                code = code + F.when(at(older) <= at(newer), bit).otherwise(0)
                bit *= 2
        return code

    coded = F.array(
        *[F.struct(F.lit(d).alias("dim"), F.when(c("pos") >= d - 1, pattern(d)).alias("code")) for d in dims]
    )
    counted = (
        rows.select(*frames.window_keys, "kind", F.inline(coded))
        .groupBy(*frames.window_keys, "kind", "dim", "code")
        .agg(F.count("code").alias("cnt"))  # rows without a full pattern count zero
    )
    change = (
        frames.upto(counted, {"after": (c("cnt"), "sum")}, ("dim", "code"))
        .withColumn("delta", _xlogx(c("after")) - _xlogx(c("after") - c("cnt")))
        .groupBy(*frames.window_keys, "kind", "dim")
        .agg(F.sum("delta").alias("delta"), F.sum("cnt").alias("cnt"))
    )
    table = frames.upto(change, {"s": (c("delta"), "sum"), "n": (c("cnt"), "sum")}, ("dim",))
    value = F.when(c("n") > 0, F.ln(c("n").cast("double")) - c("s") / c("n"))
    feature = F.concat(F.lit("permutation_entropy__dimension_"), c("dim").cast("string"), F.lit("__tau_1"))
    return table.select(
        *frames.window_keys, "kind", feature.alias("feature"), F.abs(value).alias("value")
    )


def chunk_trends(frames: Frames, names: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Least squares line over chunk maxima, minima, means or variances.

    Complete chunks are summed into the segment of their last row and accumulated. The
    chunk cut short by the end of a window is built from the window's last rows.
    """
    sizes = [s for s in CHUNKS if any(f"__chunk_len_{s}__" in name for name in names)]
    rows = long_rows(frames, kinds)
    by_size = rows.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn(
        "chunk", F.floor(c("pos") / c("size"))
    )

    def stats(extra: list[Column]) -> list[Column]:
        spread = F.greatest(F.avg(c("d") * c("d")) - F.avg("d") * F.avg("d"), F.lit(0.0))
        return [
            F.max("d").alias("v_max"), F.min("d").alias("v_min"), F.avg("d").alias("v_mean"), spread.alias("v_var"), *extra
        ]

    complete = (
        by_size.groupBy(*frames.keys, "kind", "c", "size", "chunk")
        .agg(*stats([F.max("end").alias("end"), F.count(F.lit(1)).alias("_len")]))
        .filter(c("_len") == c("size"))
    )
    k = c("chunk").cast("double")
    sums = [F.count(F.lit(1)).alias("m"), F.sum(k).alias("k1"), F.sum(k * k).alias("k2")]
    for s in CHUNK_STATS:
        v = c(f"v_{s}")
        sums += [F.sum(v).alias(f"{s}_1"), F.sum(v * v).alias(f"{s}_2"), F.sum(k * v).alias(f"{s}_k")]
    per_segment = complete.groupBy(*frames.window_keys, "kind", "c", "size").agg(*sums)
    # The unfinished chunk of a window holds rows of at most the last 49 positions; such a
    # row can belong to an earlier segment, so it is matched to every end within reach.
    cut = F.floor(c("_ends") / c("size")) * c("size")
    if frames.step is None:
        reach = F.array(c("end"))
    else:
        reach = F.filter(
            F.sequence(c("end"), F.least(c("last_end"), c("end") + max(sizes)), F.lit(frames.step).cast("bigint")),
            lambda e: e - c("pos") < c("size"),
        )
    partial = (
        by_size.withColumn("_ends", F.explode(reach))
        .filter(c("pos") >= cut)
        .withColumn("end", c("_ends"))
        .groupBy(*frames.keys, "kind", "c", "size", "chunk", "end")
        .agg(*stats([]))
        .groupBy(*frames.window_keys, "kind", "c", "size")
        .agg(*sums)
    )
    names_of = [s for s in ("m", "k1", "k2")] + [f"{s}_{x}" for s in CHUNK_STATS for x in ("1", "2", "k")]
    tagged = per_segment.withColumn("own", F.lit(False)).unionByName(partial.withColumn("own", F.lit(True)))
    # every window needs a row for each size, even where no chunk ends in its segment
    windows = rows.filter(c("pos") == c("end") - 1).select(
        *frames.window_keys, "kind", "c", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"),
    )
    spine = windows.select("*", F.lit(False).alias("own"), *[F.lit(0.0).alias(x) for x in names_of])
    merged = tagged.unionByName(spine).groupBy(*frames.window_keys, "kind", "c", "size").agg(
        *[F.sum(F.when(~c("own"), c(x))).alias(f"seg_{x}") for x in names_of],
        *[F.sum(F.when(c("own"), c(x))).alias(f"own_{x}") for x in names_of],
    )
    summed = frames.upto(merged, {f"all_{x}": (c(f"seg_{x}"), "sum") for x in names_of}, ("size",))
    table = summed.select(
        *frames.window_keys,
        "kind",
        "c",
        "size",
        *[
            (F.coalesce(f"all_{x}", F.lit(0.0)) + F.coalesce(c(f"own_{x}"), F.lit(0.0))).alias(x)
            for x in names_of
        ],
    )
    pairs = []
    ss_k = "(k2 - k1 * k1 / m)"
    for s in CHUNK_STATS:
        origin = "0.0D" if s == "var" else "c"
        ss_v = f"greatest({s}_2 - {s}_1 * {s}_1 / m, 0.0D)"
        ss_kv = f"({s}_k - k1 * {s}_1 / m)"
        slope = f"CASE WHEN m > 1 THEN try_divide({ss_kv}, {ss_k}) END"
        fitted = f"coalesce(try_divide({ss_kv}, sqrt({ss_k} * {ss_v})), 0.0D)"
        r = f"CASE WHEN m > 1 THEN greatest(least({fitted}, 1.0D), -1.0D) END"
        residual = f"sqrt(try_divide((1 - pow({r}, 2)) * {ss_v}, {ss_k} * (m - 2)))"
        values = {
            "slope": slope,
            "intercept": f"{s}_1 / m + {origin} - ({slope}) * k1 / m",
            "rvalue": r,
            "stderr": f"CASE WHEN m = 2 THEN 0.0D WHEN m > 2 THEN {residual} END",
        }
        for attr, value in values.items():
            name = f"""concat('agg_linear_trend__attr_"{attr}"__chunk_len_', size, '__f_agg_"{s}"')"""
            pairs.append(f"struct({name} AS feature, CAST({value} AS double) AS value)")
    features = table.selectExpr(*frames.window_keys, "kind", f"inline(array({', '.join(pairs)}))")
    return features.filter(c("feature").isin(list(names)))


def repeat_names() -> list[str]:
    return list(REPEATS)


def largest_names() -> list[str]:
    return [f"mean_n_absolute_max__number_of_maxima_{k}" for k in LARGEST]


def permutation_names() -> list[str]:
    return [f"permutation_entropy__dimension_{d}__tau_1" for d in DIMENSIONS]


def chunk_trend_names() -> list[str]:
    return [
        f'agg_linear_trend__attr_"{a}"__chunk_len_{s}__f_agg_"{g}"'
        for s in CHUNKS
        for g in CHUNK_STATS
        for a in CHUNK_ATTRS
    ]
