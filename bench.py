"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tremorline.session import build_session  # noqa: E402
from tremorline.verification import catalogue  # noqa: E402
from tremorline.verification.base import long_sensor, prepared  # noqa: E402

HEADLINE = [
    "window_labels_and_features",
    "index_series",
    "csv_scan",
    "ffill_per_id",
    "ffill_global",
    "robust_scale",
    "roll_windows",
    "window_labels",
    "step_sample_rolled",
    "features_minimal",
    "features_changes",
    "features_peaks",
    "features_agg_autocorrelation",
    "features_repeats",
    "features_largest",
    "features_permutation_entropy",
    "features_chunk_trends",
    "features_quantiles",
    "features_change_quantiles",
    "features_beyond_sigma",
    "features_strikes",
    "features_fourier",
    "features_spectral_density",
    "features_wavelet",
    "features_unit_root",
    "features_drift",
    "features_quantiles_long",
    "features_strikes_long",
    "features_matrix",
    "mann_whitney_u",
    "relevance_table",
    "changepoint_l2",
    "changepoint_normal",
    "subsample",
    "random_forest_rows",
    "domain_adaptation_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    known = catalogue.build()
    chosen = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    start = time.perf_counter()
    prepared(spark, sf_dir)
    seconds["prepare_sensor"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    prepared(spark, sf_dir, long_sensor)
    seconds["prepare_long_sensor"] = round(time.perf_counter() - start, 3)
    for name in chosen:
        start = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
