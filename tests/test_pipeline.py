"""The three plans end to end on snapshot files written by the test."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.operators.rolling import window_labels
from tremorline.plans import feature_selection, modelling, preprocessing
from tremorline.session import stage_root
from tremorline.sources.splits import split_catalogue

SPLITS = {
    "s_validate": ("source", ("validate/B1_3",)),
    "s_train": ("source", ("train/B1_1", "train/B1_2", "test/B2_1")),
    "s_test": ("source", ("test/B1_3",)),
    "t_train": ("target", ("train/B3_1",)),
    "t_test": ("target", ("test/B3_3",)),
}
NAMES = ["mean", "maximum", "abs_energy", "median", "quantile__q_0.9", "number_peaks__n_3", "c3__lag_1", "has_duplicate"]


@pytest.fixture(scope="module")
def data_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("snapshots")
    rng = np.random.default_rng(3)
    for folders in {f: None for _, fs in SPLITS.values() for f in fs}:
        folder = root / folders
        folder.mkdir(parents=True)
        size = int(rng.integers(500, 700))
        grown = np.linspace(1, 6, size)
        x, y = rng.normal(0, 1, size) * grown, rng.normal(2, 1, size) * grown
        for part, at in enumerate(np.array_split(np.arange(size), 5)):
            lines = [f"9;{i // 60};{i % 60};{i % 1000};{x[i]:.4f};{y[i]:.4f}" for i in at]
            (folder / f"acc_{part:05d}.csv").write_text("\n".join(lines) + "\n")
        (folder / "temp_00001.csv").write_text("not;a;number\n")
    return str(root)


def test_three_stages(spark, data_root, tmp_path):
    out = str(tmp_path / "out")
    staged = set(os.listdir(stage_root(spark)))
    preprocessing.run(spark, data_root, out, SPLITS, min_timeshift=59, step=20)
    labels = preprocessing.load_labels(spark, out)
    assert {r["split"] for r in labels.select("split").distinct().collect()} == set(SPLITS)
    assert {r["label"] for r in labels.select("label").distinct().collect()} == {1, 2, 3}

    spec = feature_selection.run(spark, out, min_timeshift=59, step=20, sample_step=2, names=NAMES)
    chosen = {f"{k}__{n}" for k, names in spec.items() for n in names}
    assert 0 < len(chosen) <= 2 * len(NAMES)
    matrix = feature_selection.load_matrix(spark, out, "t_test")
    assert chosen <= set(matrix.columns)
    frames = preprocessing.load_frames(spark, out, "t_test", 59, 20)
    assert matrix.count() == window_labels(frames).count()

    result = modelling.run(
        spark, out, grid_options={"depths": (3, 4), "feature_shares": ("sqrt",), "leaf_rows": (2,), "trees": (10,)}
    )
    # loading frames and labels outside of the plans stages nothing; plans clean up
    assert {d for d in os.listdir(stage_root(spark)) if d.startswith("scope-")} == {d for d in staged if d.startswith("scope-")}
    assert result["best"]["maxDepth"] in (3, 4)
    assert set(result["accuracy"]) == {"t_train", "t_test"}
    assert result["accuracy"]["t_train"] > 0.6
    predictions = spark.read.parquet(f"{out}/t_test_predictions")
    confusion = spark.read.parquet(f"{out}/t_test_confusion")
    total = confusion.select(F.sum(sum((F.col(f"predicted_{k}") for k in (1, 2, 3)), F.lit(0)))).first()[0]
    assert total == predictions.count() == matrix.count()


def test_split_catalogue(spark):
    rows = split_catalogue(spark).collect()
    assert len(rows) == 18
    assert [r["position"] for r in rows if r["split"] == "t_train"] == [1, 2]
