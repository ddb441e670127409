"""Indexing, filling, scaling, rolling, sampling and change points on small arrays."""

import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import brute
from tremorline.functions.scalars import rul_class
from tremorline.operators.change_points import label_segments, merge_series, segment_merged, segment_series
from tremorline.operators.filling import fill_gaps, forward_fill
from tremorline.operators.indexing import index_series, running_sum, with_halo
from tremorline.operators.quantiles import group_quantiles
from tremorline.operators.rolling import expanding, rolled_table, trailing, window_labels, whole_series
from tremorline.operators.sampling import every_nth, every_nth_rolled, subsample
from tremorline.operators.scaling import minmax_scale, robust_scale


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(11)
    return {k: (rng.normal(k, 2, n), np.round(rng.exponential(1, n), 1)) for k, n in ((1, 300), (2, 120), (3, 41))}


def test_positions_survive_many_partitions(spark, arrays, make_series):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        series = index_series(make_series(arrays))
        rows = series.rows.toPandas().sort_values(["id", "pos"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert series.longest == 300
    for key, (x, y) in arrays.items():
        part = rows[rows.id == key]
        assert part.pos.tolist() == list(range(len(x)))
        assert np.allclose(part.x, x) and np.allclose(part.y, y)
        assert (part.n_rows == len(x)).all() and (part.max_rows == 300).all()
        assert np.allclose(part.center_x, x.mean())


def test_longest_series_is_looked_up_per_scope(spark, arrays, make_series):
    table = make_series(arrays).withColumn("split", F.when(F.col("id") == 1, "a").otherwise("b"))
    rows = index_series(table, ("split", "id"), scope=("split",)).rows
    got = {(r["split"], r["max_rows"]) for r in rows.select("split", "max_rows").distinct().collect()}
    assert got == {("a", 300), ("b", 120)}


def test_running_sum(spark):
    rows = [(k, i, float(i % 5)) for k in "ab" for i in range(200)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = running_sum(spark.createDataFrame(rows, "k string, i int, v double").repartition(5), ("k",), "i", ("v",)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(r["before_v"] == sum(j % 5 for j in range(r["i"])) for r in got) and len(got) == 400


def test_halo_repeats_the_end_of_a_block(spark):
    rows = spark.range(10).select(F.col("id").alias("pos"))
    got = sorted((r["_block"], r["_halo"], r["pos"]) for r in with_halo(rows, 2, 5).collect())
    assert [g for g in got if g[1]] == [(1, True, 3), (1, True, 4), (2, True, 8), (2, True, 9)]
    assert len([g for g in got if not g[1]]) == 10
    with pytest.raises(ValueError):
        with_halo(rows, 6, 5)


@pytest.mark.parametrize("block", [None, 7])
def test_fill_stays_within_a_series(spark, make_series, block):
    x1 = [np.nan, 1, np.nan, np.nan, 2] + [np.nan] * 20 + [5]
    x2 = [np.nan, 7, np.nan]
    table = make_series({1: (x1, x1), 2: (x2, x2)}).withColumn("x", F.nanvl("x", F.lit(None)))
    rows = forward_fill(index_series(table), block).toPandas().sort_values(["id", "pos"])
    for key, x in ((1, x1), (2, x2)):
        want = pd.Series(x).ffill()
        assert np.allclose(rows[rows.id == key].x.to_numpy(float), want, equal_nan=True)


def test_global_fill_takes_from_another_series(spark):
    at = lambda s: datetime.datetime(2023, 1, 1, 0, 0, s)
    rows = [(1, at(1), 1.0), (2, at(2), None), (1, at(3), None), (2, at(4), 4.0), (1, at(5), None)]
    table = spark.createDataFrame(rows, "id int, time timestamp_ntz, x double")
    got = {r["time"].second: r["x"] for r in fill_gaps(table, values=("x",), scope="global").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 4.0, 5: 4.0}
    got = {r["time"].second: r["x"] for r in fill_gaps(table, values=("x",)).collect()}
    assert got == {1: 1.0, 2: None, 3: 1.0, 4: 4.0, 5: 1.0}


def test_robust_scale(spark, arrays, make_series):
    scaled = robust_scale(index_series(make_series(arrays)))
    rows = scaled.rows.toPandas()
    for key, (x, _) in arrays.items():
        q = np.quantile(x, [0.25, 0.5, 0.75])
        part = rows[rows.id == key].sort_values("pos")
        assert np.allclose(part.x, (x - q[1]) / (q[2] - q[0]), atol=1e-12)
        assert np.allclose(part.center_x, part.x.mean())
    again = robust_scale(scaled).rows.toPandas().merge(rows, on=["id", "pos"])
    assert np.allclose(again.x_x, again.x_y, atol=1e-12)


def test_series_without_values_keeps_its_rows(spark):
    at = lambda s: datetime.datetime(2023, 1, 1, 0, 0, s)
    rows = [(1, at(s), float(s), 1.0) for s in range(7)] + [(2, at(s), None, 2.0) for s in range(4)]
    scaled = robust_scale(index_series(spark.createDataFrame(rows, "id int, time timestamp_ntz, x double, y double")))
    got = scaled.rows.collect()
    assert len(got) == 11 and {r["x"] for r in got if r["id"] == 2} == {None}
    assert {r["y"] for r in got} == {0.0}


@pytest.mark.parametrize("row", [(None, datetime.datetime(2023, 1, 1)), (1, None)])
def test_missing_key_or_time_fails(spark, row):
    rows = [(1, datetime.datetime(2023, 1, 2), 1.0, 1.0), (*row, 2.0, 2.0)]
    with pytest.raises(PySparkException):
        index_series(spark.createDataFrame(rows, "id int, time timestamp_ntz, x double, y double")).rows.collect()


def test_scaling_constants(spark, make_series):
    series = index_series(make_series({1: ([3.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0])}))
    assert {r["x"] for r in robust_scale(series).rows.collect()} == {0.0}
    rows = minmax_scale(series).rows.orderBy("pos").collect()
    assert [r["x"] for r in rows] == [0.0] * 5 and [r["y"] for r in rows] == [0.0, 0.25, 0.5, 0.75, 1.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]))
def test_bracketed_quantiles(spark, values, q):
    table = spark.createDataFrame([(1, float(v)) for v in values] + [(1, None), (2, 5.0)], "k int, v double")
    got = {r["k"]: r["q"] for r in group_quantiles(table, ["k"], "v", [q, 0.5]).collect()}
    assert got[1] == pytest.approx([np.quantile(values, q), np.median(values)], abs=1e-12)
    assert got[2] == [5.0, 5.0]


def test_bracketed_quantiles_of_a_large_group(spark):
    table = spark.range(120_000).select(F.lit(1).alias("k"), F.expr("double(if(id % 3 = 0, 7, (id * 7919) % 120011))").alias("v"))
    values = table.toPandas().v
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = group_quantiles(table, ["k"], "v", probabilities).first()["q"]
    assert got == pytest.approx(list(np.quantile(values, probabilities)), abs=1e-9)


def naive_windows(n, longest, shortest, step):
    return [e for e in range(longest, 0, -step) if e <= n and e >= shortest + 1]


@pytest.mark.parametrize("shortest,step", [(19, 15), (0, 1), (50, 130), (119, 7), (400, 3)])
def test_expanding_windows(spark, arrays, make_series, shortest, step):
    frames = expanding(index_series(make_series(arrays)), shortest, step)
    labels = window_labels(frames).toPandas()
    want = {(k, e) for k, (x, _) in arrays.items() for e in naive_windows(len(x), 300, shortest, step)}
    assert set(zip(labels.id, labels.end)) == want
    rolled = rolled_table(frames, window_labels(frames)).groupBy("id", "end").agg(F.count("*").alias("n"), F.max("pos").alias("p"))
    assert all(r["n"] == r["end"] and r["p"] == r["end"] - 1 for r in rolled.collect())
    assert labels.RUL_rolled.dropna().between(0, 1).all()
    for _, part in labels.groupby("id"):
        assert part.sort_values("end").RUL_rolled.iloc[-1] == 0 or len(part) == 1 and part.end.iloc[0] == 1


def test_label_is_the_minimum_over_the_window(spark, arrays, make_series):
    """Smallest RUL and its class, taken row by row over the rolled table."""
    frames = expanding(index_series(make_series(arrays)), 19, 15)
    rolled = frames.exploded().toPandas()
    labels = window_labels(frames).toPandas().set_index(["id", "end"])
    for key, part in rolled.groupby("id"):
        rul = (part.time.max() - part.time) / (part.time.max() - part.time.min())
        for end, values in rul.groupby(part.end):
            assert labels.loc[(key, end)].RUL_rolled == pytest.approx(values.min(), abs=1e-12)
            want = values.map(lambda v: 3 if v < 0.25 else 2 if v < 0.5 else 1).max()
            assert labels.loc[(key, end)].RUL_rolled_class == want


def test_span_of_one_series_and_series_end(spark, arrays, make_series):
    frames = expanding(index_series(make_series(arrays)), 19, 15)
    by_one = window_labels(frames, span_of=1).toPandas()
    assert by_one[by_one.id == 1].RUL_rolled.min() == 0
    assert by_one[by_one.id == 3].RUL_rolled.min() > 0.5
    with pytest.raises(ValueError):
        window_labels(frames, span_of=99).collect()
    by_series = window_labels(frames, end="series").toPandas()
    assert (by_series.groupby("id").RUL_rolled.min() >= 0).all()


def test_step_must_be_positive(spark, arrays, make_series):
    series = index_series(make_series(arrays))
    for step in (0, -3):
        with pytest.raises(ValueError):
            expanding(series, 10, step)
        with pytest.raises(ValueError):
            trailing(series, 10, step)


def test_rul_class_edges(spark):
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.2499, 0.25, 0.4999, 0.5, 1.0, None)], "v double")
    assert [r[0] for r in rows.select(rul_class(F.col("v"))).collect()] == [3, 3, 3, 2, 2, 1, 1, None]


def test_samples(spark, arrays, make_series):
    table = make_series(arrays)
    frames = expanding(index_series(table), 19, 15)
    rolled = frames.exploded().toPandas().sort_values(["id", "end", "pos"])
    want = rolled.iloc[::10][["id", "end", "pos"]].values.tolist()
    got = every_nth_rolled(frames, 10).toPandas().sort_values(["id", "end", "pos"])
    assert got[["id", "end", "pos"]].values.tolist() == want
    ordered = table.toPandas().sort_values(["id", "time"])
    assert len(every_nth(table, ("id", "time"), 7).toPandas().merge(ordered.iloc[::7])) == len(ordered.iloc[::7])


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_subsample_sizes(spark, share):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, 1).otherwise(F.col("id") % 40).alias("g"), "id")
    first, second = (subsample(rows, "g", ("id",), share) for _ in range(2))
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in second.collect()}
    sizes = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    taken = {r["g"]: r["count"] for r in first.groupBy("g").count().collect()}
    assert taken == {g: int(n * share) for g, n in sizes.items() if int(n * share)}


@pytest.mark.parametrize(
    "settings_",
    [
        {"width": 40, "jump": 5, "min_size": 2, "breakpoints": 4},
        {"width": 30, "jump": 7, "min_size": 60, "breakpoints": 3},
        {"width": 20, "jump": 1, "min_size": 2, "breakpoints": 50},
        {"width": 20, "jump": 3, "min_size": 10_000, "breakpoints": 5},
    ],
)
@pytest.mark.parametrize("cost", ["l2", "normal"])
def test_change_points(spark, arrays, make_series, settings_, cost):
    found = segment_series(index_series(make_series(arrays)), cost=cost, **settings_).toPandas()
    for key, pair in arrays.items():
        s = settings_
        want = brute.change_points(np.column_stack(pair), s["width"], s["jump"], s["min_size"], s["breakpoints"], getattr(brute, cost))
        part = found[found.id == key]
        assert sorted(part.breakpoint) == want
        assert part.position.max() == 1.0


def test_a_step_is_found_and_labelled(spark, make_series):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 700), rng.normal(8, 1, 500), rng.normal(-4, 1, 600)])
    table = make_series({1: (x, x)})
    merged = merge_series(table.withColumn("series", F.lit(1)))
    found = segment_merged(merged, width=200, breakpoints=2, cost="l2")
    cuts = sorted(r["breakpoint"] for r in found.collect())
    assert abs(cuts[0] - 700) <= 5 and abs(cuts[1] - 1200) <= 5 and cuts[2] == 1800
    labelled = label_segments(merged, found).groupBy("cats").agg(F.min("pos").alias("p")).orderBy("cats").collect()
    assert [r["p"] for r in labelled] == [0, *cuts[:2]]


def test_merge_order(spark, arrays, make_series):
    table = make_series(arrays).withColumn("series", F.col("id"))
    for order, first in (("input", 1), ("reversed", 3)):
        rows = merge_series(table, order=order).rows
        assert rows.filter("pos = 0").first()["series"] == first


def test_whole_series_is_one_window(spark, arrays, make_series):
    frames = whole_series(index_series(make_series(arrays)))
    assert {(r["id"], r["end"]) for r in frames.exploded().select("id", "end").distinct().collect()} == {(1, 300), (2, 120), (3, 41)}
