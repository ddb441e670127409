"""Relevance of features for classes: rank and exact tests, false discovery control."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline.features.finishing import normal_two_sided
from tremorline.operators.indexing import running_sum
from tremorline.session import stage

EXACT_RANK_SAMPLE = 8  # smaller sample up to which untied ranks get exact p-values
PERIOD = math.lcm(*range(1, EXACT_RANK_SAMPLE + 1))


def class_counts(features: DataFrame, labels: DataFrame, on: list[str], classes: tuple[int, ...]) -> DataFrame:
    """Per (feature, value): ``cnt`` and ``c<class>`` counts, the sufficient statistics of all tests."""
    labelled = features.join(labels.select(*on, "label"), on).filter(F.col("value").isNotNull())
    return labelled.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("cnt"),
        *[F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(f"c{k}") for k in classes],
    )


def rank_statistics(counts: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    """Per feature and class (one against the rest): sizes, U of the class, tie-corrected
    deviation, distinct values and the 2x2 counts at the smallest value."""
    ranked = running_sum(counts, ("feature",), "value", ("cnt",))
    cnt = F.col("cnt").cast("double")
    rank = F.col("before_cnt") + (cnt + 1) / 2
    first = F.col("before_cnt") == 0
    per_feature = ranked.groupBy("feature").agg(
        F.sum(cnt).alias("n"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum(cnt * cnt * cnt - cnt).alias("ties"),
        F.sum(F.when(first, cnt)).alias("low"),
        *[F.sum(F.col(f"c{k}")).cast("double").alias(f"n{k}") for k in classes],
        *[F.sum(F.col(f"c{k}") * rank).alias(f"r{k}") for k in classes],
        *[F.sum(F.when(first, F.col(f"c{k}"))).cast("double").alias(f"low{k}") for k in classes],
    )
    sides = F.array(
        *[
            F.struct(
                F.lit(k).alias("class"),
                F.col(f"n{k}").alias("n1"),
                F.col(f"r{k}").alias("r1"),
                F.col(f"low{k}").alias("low1"),
            )
            for k in classes
        ]
    )
    one = per_feature.select("feature", "n", "distinct", "ties", "low", F.inline(sides))
    n, n1, n2 = F.col("n"), F.col("n1"), F.col("n") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    tied = F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))
    sigma = F.sqrt(F.greatest(n1 * n2 / 12 * ((n + 1) - tied), F.lit(0.0)))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sigma)
    kind = F.when(F.col("distinct") <= 1, "constant").when(F.col("distinct") == 2, "binary").otherwise("real")
    return one.select(
        "feature", kind.alias("type"), "class", "n", "n1", n2.alias("n2"), "low", "low1", "ties", u.alias("u"), z.alias("z")
    )


def _partition_table(parts: int) -> list[int]:
    """Numerator of 1 / ((1 - q) (1 - q^2) ... (1 - q^parts) (1 - q)) over (1 - q^PERIOD) to
    the power parts + 1; its length depends on ``parts`` only."""
    coefficients = [1]
    for step in (*range(1, parts + 1), 1):
        wide = coefficients + [0] * (PERIOD - step)
        for k in range(step, len(wide)):
            wide[k] += wide[k - step]
        for k in range(len(wide) - 1, PERIOD - 1, -1):
            wide[k] -= wide[k - PERIOD]
        coefficients = wide
    return coefficients


def _partitions_up_to(total: int, parts: int, table: list[int]) -> int:
    """Number of partitions of 0, 1, ..., ``total`` into parts of size at most ``parts``."""
    if total < 0:
        return 0
    return sum(
        table[k] * math.comb((total - k) // PERIOD + parts, parts)
        for k in range(total % PERIOD, min(total, len(table) - 1) + 1, PERIOD)
    )


def _exact_rank_p(n1: int, n2: int, u: float, tables: dict[int, list[int]] | None = None) -> float:
    """P(U >= u) twice, in whole numbers.

    Arrangements with U <= t are partitions of at most t into ``small`` parts of at most
    ``large``; leaving out the bound on the parts and taking back what breaks it gives
    2^small terms, each a few products, however large the samples are.
    """
    tables = {} if tables is None else tables
    small, large = min(n1, n2), max(n1, n2)
    top = small * large
    t = top - math.ceil(max(u, top - u))
    if small not in tables:
        tables[small] = _partition_table(small)
    # sums of subsets of large + 1, ..., large + small, with their signs
    signs = {0: 1}
    for i in range(1, small + 1):
        for s, sign in list(signs.items()):
            if s + large + i <= t:
                signs[s + large + i] = signs.get(s + large + i, 0) - sign
    ways = sum(sign * _partitions_up_to(t - s, small, tables[small]) for s, sign in signs.items())
    return min(1.0, 2 * ways / math.comb(n1 + n2, small))


def _fisher_p(a: float, row: float, col: float, n: float) -> float:
    """Two-sided exact p of a 2x2 table with first cell ``a`` and fixed margins.

    Terms are summed outwards, from the largest one and from where they fall to the
    observed one on either side, until they no longer count.
    """
    a, row, col, n = (int(v) for v in (a, row, col, n))
    low, high = max(0, row + col - n), min(row, col)
    mode = min(max((row + 1) * (col + 1) // (n + 2), low), high)

    def log_weight(k: int) -> float:
        return -sum(math.lgamma(v + 1) for v in (k, row - k, col - k, n - row - col + k))

    peak = log_weight(mode)

    def outwards(k: int, step: int) -> float:
        """Sum of the terms from ``k`` on, in units of the largest term."""
        if not low <= k <= high:
            return 0.0
        term = total = math.exp(log_weight(k) - peak)
        while low <= k + step <= high and term > total * 1e-18:
            if step > 0:
                term *= (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1))
            else:
                term *= k * (n - row - col + k) / ((row - k + 1) * (col - k + 1))
            k += step
            total += term
        return total

    limit = log_weight(a) + 1e-7
    if peak <= limit:
        return 1.0

    def first_below(end: int) -> int:
        """Nearest position to the mode, towards ``end``, whose term is at most the observed one."""
        inside, outside = 0, abs(end - mode) + 1
        sign = 1 if end > mode else -1
        while outside - inside > 1:
            middle = (inside + outside) // 2
            if log_weight(mode + sign * middle) <= limit:
                outside = middle
            else:
                inside = middle
        return mode + sign * outside

    above = outwards(first_below(high), 1) if high > mode else 0.0
    below = outwards(first_below(low), -1) if low < mode else 0.0
    return min(1.0, (above + below) / (outwards(mode, 1) + outwards(mode, -1) - 1.0))


def p_values(statistics: DataFrame) -> DataFrame:
    """Add ``p_value``: Fisher's exact test for binary features, the two-sided rank test with
    continuity correction for real ones (exact where one sample is tiny and untied)."""

    @F.pandas_udf("double")
    def exact(kind: pd.Series, n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series, low: pd.Series, low1: pd.Series) -> pd.Series:
        out: list[float | None] = []
        tables: dict[int, list[int]] = {}
        for k, a, b, stat, tied, first, cell in zip(kind, n1, n2, u, ties, low, low1):
            if k == "binary" and a > 0 and b > 0:
                out.append(_fisher_p(cell, first, a, a + b))
            elif k == "real" and 0 < min(a, b) <= EXACT_RANK_SAMPLE and tied == 0:
                out.append(_exact_rank_p(int(a), int(b), stat, tables))
            else:
                out.append(None)
        return pd.Series(out, dtype="float64")

    tail = F.least(normal_two_sided(F.greatest(F.col("z"), F.lit(0.0))), F.lit(1.0))
    rank_p = F.when(F.col("z").isNotNull(), tail)
    staged = statistics.withColumn("_exact", exact("type", "n1", "n2", "u", "ties", "low", "low1"))
    p = F.when(F.col("type") == "constant", F.lit(None)).when(
        F.col("_exact").isNotNull() & ~F.isnan("_exact"), F.col("_exact")
    )
    p = p.when(F.col("type") == "real", rank_p)
    return staged.withColumn("p_value", p.cast("double")).drop("_exact")


def adjust(table: DataFrame, level: float = 0.05) -> DataFrame:
    """Benjamini-Yekutieli step-up per class: ``p_adjusted`` and ``significant``; a feature is
    ``relevant`` with at least one significant class. The table has one row per feature and
    class, so it stays small whatever the data."""
    known = F.col("p_value").isNotNull()
    by_class = Window.partitionBy("class", known)
    m = F.count(F.lit(1)).over(by_class)
    rank = F.row_number().over(by_class.orderBy("p_value", "feature"))
    raised = table.withColumn("_m", m).withColumn("_rank", rank)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    raw = F.col("p_value") * F.col("_m") * harmonic / F.col("_rank")
    onward = by_class.orderBy("_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    adjusted = F.when(known, F.least(F.min("_raw").over(onward), F.lit(1.0)))
    flagged = raised.withColumn("_raw", raw).withColumn("p_adjusted", adjusted)
    significant = F.coalesce(F.col("p_adjusted") <= level, F.lit(False))
    flagged = flagged.withColumn("significant", significant)
    any_class = F.max(F.col("significant").cast("int")).over(Window.partitionBy("feature")) == 1
    return flagged.withColumn("relevant", any_class).drop("_m", "_rank", "_raw")


def relevance_table(
    features: DataFrame,
    labels: DataFrame,
    on: list[str],
    classes: tuple[int, ...] = (1, 2, 3),
    level: float = 0.05,
) -> DataFrame:
    """(feature, type, class, p_value, p_adjusted, significant, relevant).

    ``features`` is long with columns ``feature`` and ``value`` and the window key ``on``.
    """
    counts = class_counts(features, labels, on, classes)
    tested = stage(p_values(rank_statistics(counts, classes)), "relevance")
    return adjust(tested, level).select(
        "feature", "type", "class", "p_value", "p_adjusted", "significant", "relevant"
    )


def best_per_class(table: DataFrame, count: int = 20) -> DataFrame:
    """The features with the smallest p-values of each class, once each."""
    order = Window.partitionBy("class").orderBy("p_value", "feature")
    ranked = table.filter(F.col("p_value").isNotNull()).withColumn("_r", F.row_number().over(order))
    return ranked.filter(F.col("_r") <= count).select("feature").distinct()


def select_relevant(features: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of relevant features."""
    return features.join(table.filter("relevant").select("feature").distinct(), "feature", "left_semi")


def keep_features(features: DataFrame, chosen: DataFrame) -> DataFrame:
    return features.join(chosen.select("feature"), "feature", "left_semi")

