"""What staging leaves on disk."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from tremorline import session
from tremorline.features.registry import efficient, extract_features
from tremorline.operators.indexing import index_series
from tremorline.operators.rolling import expanding
from tremorline.session import stage


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(session._DROP_SHUFFLES, "false")
    table = stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    assert table.count() == 100 and spark.conf.get(session._DROP_SHUFFLES) == setting
    mine = {f for f in shuffle_files(spark) - before if f.endswith(".data")}
    assert mine  # of the count above, which is not a staged table
    spark.sparkContext._jvm.System.gc()
    again = stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    for _ in range(50):
        left = {f for f in shuffle_files(spark) - before - mine if f.endswith(".data")}
        if not left:
            break
        time.sleep(0.2)
    assert not left and again.schema == table.schema


def test_many_families_leave_their_features_and_what_they_share(spark, make_series, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    series = index_series(make_series({i: (rng.normal(0, 1, 40), rng.normal(0, 1, 40)) for i in range(3)}))
    some = expanding(series.with_rows(stage(series.rows, "rows")), 19, 15)
    folder = tmp_path / "staged"
    monkeypatch.setattr(session, "_open_scopes", [str(folder)])
    found = extract_features(some, efficient())
    assert {name.rsplit("-", 1)[0] for name in os.listdir(folder)} == {"family", "stats", "blocks", "quantiles"}
    windows = some.rows.filter("pos = end - 1").count()
    assert found.count() == windows * 2 * len(efficient())
