"""Relevance tests, class weights, evaluation, forests."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.learning.forest import (
    _ready, as_vectors, augment, augmented_columns, best_params, fit, fit_adapted, forest, grid, predict, predict_adapted, search, with_folds,
)
from tremorline.learning.nodes import best_setting, nested_search, predict_by_nodes
from tremorline.session import stage
from tremorline.verification import learning
from tremorline.learning.metrics import accuracy, class_weights, classification_report, confusion_matrix
from tremorline.operators.relevance import _exact_rank_p, _fisher_p, adjust, best_per_class, keep_features, relevance_table, select_relevant


def test_exact_rank_test_counts_arrangements():
    for n1, n2 in ((2, 5), (4, 4), (3, 7)):
        stats = [
            sum(1 for i in chosen for j in range(n1 + n2) if j not in chosen and j < i)
            for chosen in map(set, itertools.combinations(range(n1 + n2), n1))
        ]
        for u in range(n1 * n2 + 1):
            high = max(u, n1 * n2 - u)
            want = min(1.0, 2 * sum(s >= high for s in stats) / len(stats))
            assert _exact_rank_p(n1, n2, u) == pytest.approx(want)


def test_exact_table_test_sums_tables():
    for a, row, col, n in ((3, 5, 4, 12), (0, 6, 5, 11), (4, 4, 6, 9)):
        weight = {k: math.comb(row, k) * math.comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(w for w in weight.values() if w <= weight[a] * (1 + 1e-7)) / sum(weight.values())
        assert _fisher_p(a, row, col, n) == pytest.approx(want)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for w in range(200):
        label = w % 3 + 1
        labels.append((w, label))
        rows += [
            (w, "shifted", float(rng.normal(label, 1))),
            (w, "noise", float(rng.normal())),
            (w, "flag", float(label == 2) if w % 10 else 1.0),
            (w, "constant", 1.0),
            (w, "empty", None),
        ]
    features = spark.createDataFrame(rows, "w int, feature string, value double")
    return features, spark.createDataFrame(labels, "w int, label int")


def test_relevance(spark, table):
    features, labels = table
    result = relevance_table(features, labels, ["w"])
    rows = {(r["feature"], r["class"]): r for r in result.collect()}
    assert {r["type"] for k, r in rows.items() if k[0] == "flag"} == {"binary"}
    assert rows[("constant", 1)]["p_value"] is None and not rows[("constant", 1)]["relevant"]
    assert rows[("shifted", 1)]["p_value"] < 1e-6 and rows[("shifted", 2)]["relevant"]
    assert rows[("flag", 2)]["p_value"] < 1e-20
    assert rows[("noise", 1)]["p_value"] > 0.01
    for r in rows.values():
        if r["p_value"] is not None:
            assert r["p_value"] <= r["p_adjusted"] <= 1
    kept = {r["feature"] for r in select_relevant(features, result).select("feature").distinct().collect()}
    assert kept == {"shifted", "flag"}
    best = best_per_class(result, 1)
    assert {r["feature"] for r in best.collect()} == {"shifted", "flag"}
    assert keep_features(features, best).count() == 400


def test_rank_test_matches_the_plain_formula(spark, table):
    features, labels = table
    got = {r["class"]: r["p_value"] for r in relevance_table(features.filter("feature = 'shifted'"), labels, ["w"]).collect()}
    pdf = features.filter("feature = 'shifted'").join(labels, "w").toPandas()
    rank, n = pdf.value.rank(), len(pdf)
    for k in (1, 2, 3):
        n1 = (pdf.label == k).sum()
        u = rank[pdf.label == k].sum() - n1 * (n1 + 1) / 2
        z = (max(u, n1 * (n - n1) - u) - n1 * (n - n1) / 2 - 0.5) / math.sqrt(n1 * (n - n1) * (n + 1) / 12)
        assert got[k] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_adjusted_p_values_are_monotone(spark):
    rng = np.random.default_rng(4)
    rows = [(f"f{i}", k, float(p)) for k in (1, 2) for i, p in enumerate(rng.uniform(0, 0.1, 50) ** 2)]
    out = adjust(spark.createDataFrame(rows, "feature string, class int, p_value double")).toPandas()
    for _, part in out.groupby("class"):
        part = part.sort_values("p_value")
        assert part.p_adjusted.is_monotonic_increasing
        m, h = len(part), sum(1 / k for k in range(1, len(part) + 1))
        raw = part.p_value.to_numpy() * m * h / np.arange(1, m + 1)
        assert np.allclose(part.p_adjusted, np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1))


def test_metrics(spark):
    rows = [(1, 1)] * 5 + [(1, 2)] * 2 + [(2, 2)] * 3 + [(3, 1)]
    frame = spark.createDataFrame(rows, "label int, prediction int")
    weights = {r["label"]: r["weight"] for r in class_weights(frame).collect()}
    assert weights == pytest.approx({1: 11 / 21, 2: 11 / 9, 3: 11 / 3})
    matrix = {r["actual"]: (r["predicted_1"], r["predicted_2"], r["predicted_3"]) for r in confusion_matrix(frame, [1, 2, 3]).collect()}
    assert matrix == {1: (5, 2, 0), 2: (0, 3, 0), 3: (1, 0, 0)}
    report = {r["name"]: r for r in classification_report(frame).collect()}
    assert report["1"]["precision"] == pytest.approx(5 / 6) and report["1"]["recall"] == pytest.approx(5 / 7)
    assert report["3"]["f1"] == 0 and report["accuracy"]["f1"] == pytest.approx(8 / 11)
    assert report["weighted avg"]["recall"] == pytest.approx(8 / 11)
    assert accuracy(frame).first()[0] == pytest.approx(8 / 11)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        label, domain = i % 3 + 1, "target" if i % 4 == 0 else "source"
        # the second axis separates in the target only, the first in the source only
        a = label * 3 if domain == "source" else 0
        b = label * 3 if domain == "target" else 0
        rows.append((i, domain, label, float(rng.normal(a, 1)), float(rng.normal(b, 1))))
    return spark.createDataFrame(rows, "k int, domain string, label int, `f.0` double, f1 double")


def test_forest_and_adaptation(spark, blobs):
    columns = ["f.0", "f1"]
    source, target = (blobs.filter(F.col("domain") == d).drop("domain") for d in ("source", "target"))
    model = fit(as_vectors(source, columns), forest(trees=15, depth=4))
    plain = accuracy(predict(model, as_vectors(target, columns))).first()[0]
    adapted = fit_adapted(source, target, columns, forest(trees=15, depth=4))
    better = accuracy(predict_adapted(adapted, target, columns)).first()[0]
    assert better > 0.8 > plain
    row = augment(target, columns, "target").first()
    assert row["f.0__source"] == 0 and row["f.0__target"] == row["f.0__shared"] != 0
    with pytest.raises(ValueError):
        augment(target, columns, "other")


def test_adaptation_weighs_by_the_source(spark, blobs, monkeypatch):
    from tremorline.learning import forest as module

    source, target = blobs.filter("domain = 'source' and (label <> 3 or k % 5 = 0)"), blobs.filter("domain = 'target' and label = 3")
    seen = []
    monkeypatch.setattr(module, "fit", lambda rows, learner, weights: seen.append(module.with_weights(rows, weights=weights)))
    module.fit_adapted(source, target, ["f.0", "f1"])
    want = {r["label"]: r["weight"] for r in class_weights(source).collect()}
    assert {(r["label"], r["weight"]) for r in seen[0].select("label", "weight").collect()} == set(want.items())


def test_grid_search(spark, blobs):
    vectors = as_vectors(blobs.filter("domain = 'source'"), ["f.0", "f1"])
    folds = with_folds(vectors, "k").groupBy("label", "fold").count().collect()
    assert {r["fold"] for r in folds} == set(range(5)) and max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1
    learner = forest()
    params = grid(learner, depths=(1, 4), feature_shares=("sqrt",), leaf_rows=(2,), trees=(8,))
    best = best_params(search(vectors, "k", params, learner, folds=3))
    assert best["maxDepth"] == 4 and best["score"] > 0.8


def test_predictions_equal_a_walk_over_the_nodes(spark, sf_dir):
    rows = as_vectors(learning._embeddings(spark, sf_dir), learning.COLUMNS)
    model = fit(rows, forest(trees=12, depth=5))
    walked = {r["vec_id"]: r["prediction"] for r in predict_by_nodes(model, rows, "vec_id").collect()}
    assert walked == {r["vec_id"]: r["prediction"] for r in predict(model, rows).collect()}


@pytest.mark.parametrize("name", ["random_forest_rows", "domain_adaptation_rows"])
def test_queries_equal_a_walk_over_the_nodes(spark, sf_dir, monkeypatch, name):
    fitted = []
    for target in ("fit", "fit_adapted"):
        original = getattr(learning, target)
        monkeypatch.setattr(learning, target, lambda *a, f=original: fitted.append(f(*a)) or fitted[-1])
    got = {r["vec_id"]: r["prediction"] for r in learning.build()[name].run(spark, sf_dir).collect()}
    rows = learning._embeddings(spark, sf_dir)
    if name == "domain_adaptation_rows":
        rows = augment(rows.filter("vec_id % 3 = 0"), learning.COLUMNS, "target")
        rows = as_vectors(rows, augmented_columns(learning.COLUMNS))
    else:
        rows = as_vectors(rows, learning.COLUMNS)
    walked = {r["vec_id"]: r["prediction"] for r in predict_by_nodes(fitted[0], rows, "vec_id").collect()}
    assert got == walked and len(got) > 50


def test_nested_search_scores_every_prefix(spark, blobs):
    vectors = as_vectors(blobs.filter("domain = 'source'"), ["f.0", "f1"])
    learner, folds = forest(seed=5), 2
    scores = {
        (r["depth"], r["trees"]): r["score"]
        for r in nested_search(vectors, "k", learner, (1, 4), ("sqrt",), (2,), (3, 8, 1), folds).collect()
    }
    assert set(scores) == {(d, t) for d in (1, 4) for t in (1, 3, 8)}
    # the largest forest is the one that a separate fit gives
    params = grid(learner, depths=(1, 4), feature_shares=("sqrt",), leaf_rows=(2,), trees=(8,))
    separate = search(vectors, "k", params, learner, folds)
    for setting, score in zip(separate.getEstimatorParamMaps(), separate.avgMetrics):
        assert scores[setting[learner.maxDepth], 8] == pytest.approx(score)
    # a smaller one is the forest of its first trees
    ready = stage(with_folds(_ready(vectors), "k", folds), "ready")
    total = 0.0
    for fold in range(folds):
        model = learner.fit(ready.filter(F.col("fold") != fold), {learner.maxDepth: 4, learner.minInstancesPerNode: 2, learner.numTrees: 8, learner.featureSubsetStrategy: "sqrt"})
        held = ready.filter(F.col("fold") == fold).collect()
        guesses = []
        for r in held:
            votes = np.zeros(3)
            for tree in model.trees[:3]:
                raw = np.array(tree.predictRaw(r["features"]))
                votes += raw / raw.sum()
            guesses.append(int(votes.argmax()))
        for k in range(3):
            support = sum(r["_label"] == k for r in held)
            hits = sum(r["_label"] == k == g for r, g in zip(held, guesses))
            total += 2 * hits / max(1, support + guesses.count(k)) * support / len(held) / folds
    assert scores[4, 3] == pytest.approx(total)
    best = best_setting(spark.createDataFrame([(4, "sqrt", 2, 8, 0.9), (1, "sqrt", 2, 3, 0.9)], "depth int, feature_share string, leaf_rows int, trees int, score double"))
    assert best["trees"] == 3


def test_missing_feature_is_an_error(spark, blobs):
    broken = blobs.withColumn("f1", F.when(F.col("k") > 5, F.col("f1")))
    with pytest.raises(Exception, match="missing feature value"):
        as_vectors(broken, ["f1"]).select("features").collect()


def brute_upper_tail(n1, n2, u):
    """P(U >= u) twice from the full distribution of the rank sum, in whole numbers."""
    ways = {0: {0: 1}}
    for rank in range(1, n1 + n2 + 1):
        for size in sorted(ways, reverse=True):
            if size < n1:
                into = ways.setdefault(size + 1, {})
                for total, count in ways[size].items():
                    into[total + rank] = into.get(total + rank, 0) + count
    counts = {total - n1 * (n1 + 1) // 2: count for total, count in ways[n1].items()}
    high = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(c for v, c in counts.items() if v >= high) / sum(counts.values()))


@pytest.mark.parametrize(("n1", "n2"), [(1, 5), (2, 9), (5, 3), (8, 12), (7, 30), (40, 3)])
def test_exact_rank_p_equals_the_full_distribution(n1, n2):
    from tremorline.operators.relevance import _exact_rank_p

    for u in range(0, n1 * n2 + 1, max(1, n1 * n2 // 9)):
        assert _exact_rank_p(n1, n2, u, {}) == pytest.approx(brute_upper_tail(n1, n2, u), rel=1e-12)


@pytest.mark.parametrize("n2", [2_000, 20_000, 3_000_000])
def test_exact_rank_p_of_large_samples(n2):
    import math

    from tremorline.operators.relevance import _exact_rank_p

    assert _exact_rank_p(8, n2, 8 * n2, {}) == pytest.approx(2 / math.comb(n2 + 8, 8), rel=1e-12)
    assert _exact_rank_p(8, n2, 8 * n2 - 3, {}) == pytest.approx(2 * 7 / math.comb(n2 + 8, 8), rel=1e-12)
    for u in (4 * n2, 5 * n2, 7 * n2):
        assert 0 <= _exact_rank_p(8, n2, u, {}) <= 1
    # close to the normal tail in the middle
    sigma = math.sqrt(8 * n2 * (n2 + 9) / 12)
    assert _exact_rank_p(8, n2, 4 * n2 + sigma, {}) == pytest.approx(math.erfc(1 / math.sqrt(2)), rel=0.05)


def test_fisher_p_against_whole_numbers():
    import math
    from fractions import Fraction

    from tremorline.operators.relevance import _fisher_p

    for n, row, col in [(10, 4, 5), (30, 11, 17), (200, 60, 90), (1000, 3, 400)]:
        weights = {k: math.comb(row, k) * math.comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        for a, w in weights.items():
            want = float(Fraction(sum(v for v in weights.values() if v <= w), sum(weights.values())))
            assert _fisher_p(a, row, col, n) == pytest.approx(want, rel=1e-9)
    assert 0 <= _fisher_p(900_000, 1_000_000, 1_500_000, 3_000_000) < 1e-300
    assert _fisher_p(500_000, 1_000_000, 1_500_000, 3_000_000) == 1.0


@pytest.mark.parametrize("name", ["random_forest_rows", "grid_search_rows", "domain_adaptation_rows"])
def test_every_embedding_has_a_prediction(spark, sf_dir, name):
    from tremorline.verification import catalogue

    labels = {r["vec_id"]: r["label"] + 1 for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    want = {k: v for k, v in labels.items() if name != "domain_adaptation_rows" or k % 3 == 0}
    got = catalogue.build()[name].run(spark, sf_dir).collect()
    assert len(got) == len(want) and {r["vec_id"]: r["label"] for r in got} == want
    assert {r["prediction"] for r in got} <= set(range(1, 11))
    assert sum(r["label"] == r["prediction"] for r in got) > 0.3 * len(got)
