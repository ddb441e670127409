"""Exact interpolated quantiles per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline.session import stage

SKETCH_ACCURACY = 10_000


def group_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """``keys`` plus ``q``: array of linearly interpolated quantiles, NULLs ignored; NULLs
    for a group that has no value.

    Two scans, whatever the size of a group: a bounded sketch brackets each quantile, then
    only the values inside the brackets are ranked, pre-aggregated by value.
    """
    slack = 3.0 / SKETCH_ACCURACY
    edges = [e for p in probabilities for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    small = 2 * SKETCH_ACCURACY  # below this the sketch brackets are a few ranks wide: keep all values
    sketch = stage(
        df.groupBy(*keys).agg(
            F.count(value).alias("_n"),
            F.min(value).alias("_min"),
            F.max(value).alias("_max"),
            F.percentile_approx(value, edges, SKETCH_ACCURACY).alias("_edges"),
        ),
        "sketch",
    )
    n = F.col("_n")
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.when((n > small) & F.lit(p - slack > 0), F.col("_edges")[2 * i]).otherwise(F.col("_min")).alias("lo"),
                F.when((n > small) & F.lit(p + slack < 1), F.col("_edges")[2 * i + 1])
                .otherwise(F.col("_max"))
                .alias("hi"),
                (F.lit(p) * (n - 1)).alias("rank"),
            )
            for i, p in enumerate(probabilities)
        ]
    )
    v = F.col(value)
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys]
    hits = (
        df.filter(v.isNotNull())
        .select(*keys, v.alias("_v"))
        .alias("r")
        .join(sketch.alias("s"), reduce(lambda a, b: a & b, same))
        .select(*[F.col(f"r.`{k}`").alias(k) for k in keys], "_v", "_n", "_min", "_max", "_edges")
        .select(*keys, "_v", F.explode(brackets).alias("b"))
        .filter(F.col("_v") <= F.col("b.hi"))
        .select(*keys, "b.i", "b.rank", F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v"))
        .groupBy(*keys, "i", "rank", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first())
    ranked = hits.withColumn("_upto", F.sum("_c").over(upto)).filter(F.col("_v").isNotNull())
    low, high = F.floor("rank"), F.ceil("rank")
    picked = ranked.groupBy(*keys, "i", "rank").agg(
        F.min(F.when(F.col("_upto") > low, F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_upto") > high, F.col("_v"))).alias("_hi"),
    )
    value_at = F.col("_lo") + (F.col("rank") - low) * (F.col("_hi") - F.col("_lo"))
    checked = F.when(value_at.isNull(), F.raise_error(F.lit("quantile outside its bracket"))).otherwise(value_at)
    ordered = F.array_sort(F.collect_list(F.struct("i", checked.alias("q"))))
    found = picked.groupBy(*keys).agg(F.transform(ordered, lambda s: s["q"]).alias("q"))
    missing = F.array_repeat(F.lit(None).cast("double"), len(probabilities))
    without = sketch.filter("_n = 0").select(*keys, missing.alias("q"))
    return found.unionByName(without)
