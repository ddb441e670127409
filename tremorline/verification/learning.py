"""Queries on feature relevance, class weights, evaluation and forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.features.registry import align_columns, extract_features
from tremorline.learning.forest import (
    as_vectors,
    augment,
    fit,
    fit_adapted,
    forest,
    predict,
    predict_adapted,
    with_folds,
)
from tremorline.learning.nodes import best_setting, nested_search
from tremorline.learning.metrics import accuracy, class_weights, classification_report, confusion_matrix
from tremorline.operators.relevance import (
    adjust,
    best_per_class,
    class_counts,
    keep_features,
    rank_statistics,
    relevance_table,
    select_relevant,
)
from tremorline.operators.rolling import rolled_table, window_labels
from tremorline.operators.sampling import subsample
from tremorline.session import stage
from tremorline.verification.base import Query, prelude, r6, rounded, table, windows
from tremorline.verification.series import LIFE

c = F.col
DIMS = 64  # entries of an embedding
COLUMNS = [f"e{i}" for i in range(DIMS)]
CLASSES = (1, 2, 3)
FEATURES = {"maximum": "max(v)", "sum_values": "sum(v)", "count_below__t_0": "avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END)"}


def window_features(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Long features named by axis and rounded, and the window labels."""
    frames = windows(spark, sf_dir)
    long = extract_features(frames, names)
    named = long.select("id", "end", F.concat_ws("__", "kind", "feature").alias("feature"), rounded(c("value")).alias("value"))
    labels = window_labels(frames).select("id", "end", c("RUL_rolled_class").alias("label"))
    return named, labels


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label 1..10, e0..): vectors as a feature matrix."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (c("label") + 1).alias("label"),
        *[c("embedding")[i].cast("double").alias(name) for i, name in enumerate(COLUMNS)],
    )


MATRIX_SQL = "m AS (SELECT vec_id, label + 1 AS label, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS {name}" for i, name in enumerate(COLUMNS)
) + " FROM embeddings)"


def _guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed rule as predictions: the true label, or the next one for negative e0."""
    wrong = F.when(c("e0") < 0, c("label") % 10 + 1).otherwise(c("label"))
    return _embeddings(spark, sf_dir).select("vec_id", "label", wrong.alias("prediction"))


GUESS_SQL = f"WITH {MATRIX_SQL}, g AS (SELECT vec_id, label, CASE WHEN e0 < 0 THEN label % 10 + 1 ELSE label END AS prediction FROM m)"


def _rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, labels = window_features(spark, sf_dir, list(FEATURES))
    stats = rank_statistics(class_counts(features, labels, ["id", "end"], CLASSES), CLASSES)
    return stats.select("feature", "type", "class", "n", "n1", rounded(c("u")).alias("u"), rounded(c("z")).alias("z"))


def _labelled_sql(features: dict[str, str]) -> str:
    selects = " UNION ALL ".join(
        f"SELECT id, e, kind || '__{name}' AS feature, {r6(f'CAST({sql} AS DOUBLE)')} AS value FROM r GROUP BY id, e, kind"
        for name, sql in features.items()
    )
    return prelude() + f",\n{LIFE},\nf AS ({selects}),\nlab AS (SELECT f.*, c.rul_class AS label FROM f JOIN classed c USING (id, e))"


RANK_SQL = """,
ranks AS (
    SELECT *, rank() OVER (PARTITION BY feature ORDER BY value)
              + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM lab),
ties AS (SELECT feature, sum(power(t, 3) - t) AS tie, count(*) AS distinct_values
         FROM (SELECT feature, value, count(*) AS t FROM lab GROUP BY feature, value) GROUP BY feature),
sums AS (
    SELECT feature, k AS class, count(*)::DOUBLE AS n, count(*) FILTER (label = k)::DOUBLE AS n1,
           coalesce(sum(rk) FILTER (label = k), 0) AS r1
    FROM ranks, (VALUES (1), (2), (3)) c(k) GROUP BY feature, k),
tests AS (
    SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n - n1 AS n2,
           sqrt(n1 * (n - n1) / 12 * ((n + 1) - tie / (n * (n - 1)))) AS sigma
    FROM sums JOIN ties USING (feature))"""


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-up adjustment of given p-values: one test per part type and class of supplier."""
    parts = table(spark, sf_dir, "lineitem").groupBy(
        F.concat(c("l_returnflag"), c("l_linestatus"), (c("l_suppkey") % 20).cast("string")).alias("feature"),
        (c("l_linenumber") % 3 + 1).cast("int").alias("class"),
    )
    scored = parts.agg(F.pow(F.round(F.avg("l_discount"), 6) * 10, F.lit(4.0)).alias("p_value"))
    table_ = adjust(scored.withColumn("p_value", c("p_value") / 40), 0.05)
    return table_.select("feature", "class", rounded(c("p_value") * 1000).alias("p1000"), rounded(c("p_adjusted")).alias("p_adjusted"), "significant", "relevant")


ADJUST_SQL = f"""WITH scored AS (
    SELECT l_returnflag || l_linestatus || (l_suppkey % 20) AS feature, l_linenumber % 3 + 1 AS class,
           power(round(avg(l_discount), 6) * 10, 4.0) / 40 AS p FROM lineitem GROUP BY ALL),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY class ORDER BY p, feature) AS i, count(*) OVER (PARTITION BY class) AS m FROM scored),
raw AS (SELECT *, p * m * list_sum(list_transform(range(1, m + 1), lambda k: 1.0 / k)) / i AS q FROM ranked),
adjusted AS (
    SELECT *, least(min(q) OVER (PARTITION BY class ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS a FROM raw)
SELECT feature, CAST(class AS INTEGER) AS class, {r6('p * 1000')} AS p1000, {r6('a')} AS p_adjusted, a <= 0.05 AS significant,
       bool_or(a <= 0.05) OVER (PARTITION BY feature) AS relevant FROM adjusted"""


TESTED = {
    "maximum": "max(v)", "mean": "avg(v)", "length": "count(*)", "abs_energy": "sum(v * v)",
    "has_duplicate": "CASE WHEN count(DISTINCT v) < count(*) THEN 1.0 ELSE 0.0 END",
    "count_above__t_0": "avg(CASE WHEN v >= 0 THEN 1.0 ELSE 0.0 END)",
    "mean_change": "(arg_max(v, pos) - arg_min(v, pos)) / (count(*) - 1)",
}


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, labels = window_features(spark, sf_dir, list(TESTED))
    found = relevance_table(features, labels, ["id", "end"])
    return found.select(
        "feature", "type", "class", rounded(c("p_value")).alias("p_value"), rounded(c("p_adjusted")).alias("p_adjusted"),
        "significant", "relevant",
    )


def _selected(spark: SparkSession, sf_dir: str, level: float) -> DataFrame:
    features, labels = window_features(spark, sf_dir, list(TESTED))
    features = stage(features, "features")
    kept = select_relevant(features, relevance_table(features, labels, ["id", "end"], level=level))
    return kept.select("id", c("end").alias("window_rows"), "feature", "value")


def _relevance_sql(level: float) -> str:
    """Tables ``lab`` (feature values with labels) and ``judged`` (tests, adjusted and flagged).

    Two-sided normal tail: the series of the error function, which loses nothing that six
    decimals show up to z = 5.6, where the tail is 2e-8; Fisher's test by log-gamma.
    """
    return _labelled_sql(TESTED) + RANK_SQL + f""",
low AS (
    SELECT feature, count(*)::DOUBLE AS low, count(*) FILTER (label = 1)::DOUBLE AS low1,
           count(*) FILTER (label = 2)::DOUBLE AS low2, count(*) FILTER (label = 3)::DOUBLE AS low3
    FROM lab JOIN (SELECT feature, min(value) AS v FROM lab GROUP BY feature) m USING (feature)
    WHERE value = v GROUP BY feature),
z AS (
    SELECT t.*, low, CASE class WHEN 1 THEN low1 WHEN 2 THEN low2 ELSE low3 END AS cell,
           greatest((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / nullif(sigma, 0), 0) / sqrt(2) AS x
    FROM tests t JOIN low USING (feature)),
hyper AS (
    SELECT feature, class, k, k = cell AS observed,
           -(lgamma(k + 1) + lgamma(low - k + 1) + lgamma(n1 - k + 1) + lgamma(n - low - n1 + k + 1)) AS w
    FROM (SELECT *, unnest(range(greatest(0, low + n1 - n)::BIGINT, least(low, n1)::BIGINT + 1)) AS k
          FROM z WHERE distinct_values = 2)),
fisher AS (
    SELECT feature, class, sum(exp(w - top)) FILTER (w <= seen + 1e-7) / sum(exp(w - top)) AS p
    FROM hyper JOIN (SELECT feature, class, max(w) AS top, max(w) FILTER (observed) AS seen FROM hyper GROUP BY ALL) t
         USING (feature, class)
    GROUP BY feature, class),
tested AS (
    SELECT z.feature, z.class,
           CASE WHEN distinct_values <= 1 THEN 'constant' WHEN distinct_values = 2 THEN 'binary' ELSE 'real' END AS type,
           CASE WHEN distinct_values <= 1 THEN NULL WHEN distinct_values = 2 THEN fisher.p WHEN x > 4 THEN 0
                ELSE least(1.0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90),
                     lambda i: power(-1, i) * power(x, 2 * i + 1) / (gamma(i + 1) * (2 * i + 1))))) END AS p
    FROM z LEFT JOIN fisher USING (feature, class)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY class, p IS NULL ORDER BY p, feature) AS i,
           count(*) OVER (PARTITION BY class, p IS NULL) AS m FROM tested),
raised AS (SELECT *, p * m * list_sum(list_transform(range(1, m + 1), lambda k: 1.0 / k)) / i AS q FROM placed),
adjusted AS (
    SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(q) OVER (PARTITION BY class, p IS NULL ORDER BY i
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS a FROM raised),
judged AS (
    SELECT feature, type, class, p, a, coalesce(a <= {level}, false) AS significant,
           bool_or(coalesce(a <= {level}, false)) OVER (PARTITION BY feature) AS relevant FROM adjusted)"""


def _topk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest three per class by a given score, once each, and their rows."""
    scores = table(spark, sf_dir, "lineitem").groupBy(
        (c("l_suppkey") % 50).cast("string").alias("feature"), (c("l_linenumber") % 3 + 1).alias("class")
    )
    scored = scores.agg(F.round(F.avg("l_tax"), 9).alias("p_value"))
    return keep_features(scored, best_per_class(scored, 3)).select("feature", c("class").cast("int").alias("class"), rounded(c("p_value")).alias("p_value"))


TOPK_SQL = f"""WITH scored AS (
    SELECT CAST(l_suppkey % 50 AS VARCHAR) AS feature, l_linenumber % 3 + 1 AS class, round(avg(l_tax), 9) AS p FROM lineitem GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY p, feature) AS i FROM scored)
SELECT feature, CAST(class AS INTEGER) AS class, {r6('p')} AS p_value FROM scored
WHERE feature IN (SELECT feature FROM best WHERE i <= 3)"""


def _last_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per window read off the rolled rows: the last one that is not missing."""
    frames = windows(spark, sf_dir)
    rolled = rolled_table(frames, window_labels(frames))
    labels = rolled.groupBy("id", "time_end").agg(
        F.max_by("RUL_rolled_class", F.when(c("RUL_rolled_class").isNotNull(), c("pos"))).alias("label")
    )
    return labels


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_weights(_embeddings(spark, sf_dir)).select("label", rounded(c("weight")).alias("weight"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = classification_report(_guessed(spark, sf_dir))
    return report.select("name", *[rounded(c(s)).alias(s) for s in ("precision", "recall", "f1")], "support")


REPORT_SQL = GUESS_SQL + f""",
k AS (SELECT DISTINCT label AS k FROM g UNION SELECT DISTINCT prediction FROM g),
per AS (
    SELECT k, count(*) FILTER (label = k) AS support, count(*) FILTER (label = k AND prediction = k) AS hits,
           count(*) FILTER (prediction = k) AS guesses FROM g, k GROUP BY k),
s AS (
    SELECT CAST(k AS VARCHAR) AS name, coalesce(hits / nullif(guesses, 0), 0) AS precision,
           coalesce(hits / nullif(support, 0), 0) AS recall,
           coalesce(2.0 * hits / nullif(guesses + support, 0), 0) AS f1, support, hits FROM per),
allrows AS (
    SELECT name, precision, recall, f1, support FROM s
    UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM s
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                     sum(f1 * support) / sum(support), sum(support) FROM s)
SELECT name, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, CAST(support AS BIGINT) AS support FROM allrows"""


def _augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    source, target = rows.filter(c("vec_id") % 3 != 0), rows.filter(c("vec_id") % 3 == 0)
    both = augment(source, COLUMNS, "source").unionByName(augment(target, COLUMNS, "target"))
    names = [f"{n}__{p}" for p in ("source", "target", "shared") for n in COLUMNS]
    return both.select("vec_id", "label", *[rounded(c(n)).alias(n) for n in names])


AUGMENT_SQL = f"WITH {MATRIX_SQL} SELECT vec_id, label, " + ", ".join(
    r6({"source": f"CASE WHEN vec_id % 3 <> 0 THEN {n} ELSE 0 END", "target": f"CASE WHEN vec_id % 3 = 0 THEN {n} ELSE 0 END", "shared": n}[p])
    + f" AS {n}__{p}"
    for p in ("source", "target", "shared")
    for n in COLUMNS
) + " FROM m"


def _subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = subsample(_events(spark, sf_dir), "user_id", ("event_id",), 0.4)
    return sample.select("user_id", "event_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id")


# One prediction per embedding, of models fitted on all of them. SQL cannot express the
# models; tests compare the predictions with a walk over the table of the forest's nodes.
def _forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_vectors(_embeddings(spark, sf_dir), COLUMNS)
    model = fit(rows, forest(trees=40, depth=5))
    return predict(model, rows).select("vec_id", "label", "prediction")


def _grid_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the best setting, which is refitted on all rows, and that setting."""
    rows = as_vectors(_embeddings(spark, sf_dir), COLUMNS)
    scores = nested_search(
        rows, "vec_id", forest(), depths=(1, 5), feature_shares=("sqrt",), leaf_rows=(8,), trees=(5, 10, 20), folds=2
    )
    best = best_setting(scores)
    model = fit(rows, forest(best["trees"], best["depth"], best["feature_share"], best["leaf_rows"]))
    return predict(model, rows).select(
        "vec_id",
        "label",
        "prediction",
        F.lit(best["depth"]).alias("depth"),
        F.lit(best["trees"]).alias("trees"),
        F.lit(best["score"]).alias("score"),
    )


def _adapted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all target rows, every third one; all rows are fitted on."""
    rows = _embeddings(spark, sf_dir)
    source, target = rows.filter(c("vec_id") % 3 != 0), rows.filter(c("vec_id") % 3 == 0)
    model = fit_adapted(source, target, COLUMNS, forest(trees=60, depth=6))
    return predict_adapted(model, target, COLUMNS).select("vec_id", "label", "prediction")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    train = rows.select("vec_id", "e3", "e1")
    return align_columns(rows, train).select("vec_id", rounded(c("e3")).alias("e3"), rounded(c("e1")).alias("e1"))


def build() -> dict[str, Query]:
    kind = "CASE WHEN distinct_values <= 1 THEN 'constant' WHEN distinct_values = 2 THEN 'binary' ELSE 'real' END"
    ranks = (
        _labelled_sql(FEATURES) + RANK_SQL
        + f" SELECT feature, {kind} AS type, class, n, n1, {r6('u')} AS u, "
        + f"{r6('(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / nullif(sigma, 0)')} AS z FROM tests"
    )
    labels_sql = _labelled_sql({"maximum": "max(v)"}) + " SELECT id, time_end, rul_class AS label FROM classed"
    confusion = ", ".join(f"count(*) FILTER (prediction = {k}) AS predicted_{k}" for k in range(1, 11))
    return {
        "mann_whitney_u": Query(_rank_query, ranks),
        "by_adjust": Query(_adjusted, ADJUST_SQL),
        "topk_union": Query(_topk_union, TOPK_SQL),
        "relevance_table": Query(
            _relevance,
            _relevance_sql(0.05)
            + f" SELECT feature, type, class, {r6('p')} AS p_value, {r6('a')} AS p_adjusted, significant, relevant FROM judged",
        ),
        "fdr_selection": Query(
            lambda spark, sf_dir: _selected(spark, sf_dir, 1e-5),
            _relevance_sql(1e-5)
            + " SELECT id, e AS window_rows, feature, value FROM lab WHERE feature IN (SELECT feature FROM judged WHERE relevant)",
        ),
        "window_last_label": Query(_last_label, labels_sql),
        "class_weights": Query(
            _weights,
            f"WITH {MATRIX_SQL}, n AS (SELECT label, count(*) AS n FROM m GROUP BY label) SELECT label, "
            + r6("(SELECT count(*) FROM m) / ((SELECT count(*) FROM n) * n)")
            + " AS weight FROM n",
        ),
        "stratified_folds": Query(
            lambda spark, sf_dir: with_folds(_embeddings(spark, sf_dir), "vec_id").select("vec_id", "label", "fold"),
            f"WITH {MATRIX_SQL} SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS INTEGER) AS fold FROM m",
        ),
        "confusion_matrix": Query(
            lambda spark, sf_dir: confusion_matrix(_guessed(spark, sf_dir), list(range(1, 11))),
            GUESS_SQL + f" SELECT label AS actual, {confusion} FROM g GROUP BY label",
        ),
        "classification_report": Query(_report, REPORT_SQL),
        "accuracy": Query(
            lambda spark, sf_dir: accuracy(_guessed(spark, sf_dir)).select(rounded(c("accuracy")).alias("accuracy")),
            GUESS_SQL + f" SELECT {r6('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM g",
        ),
        "subsample": Query(
            _subsample,
            "WITH h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id || '|42'), event_id) AS i, "
            "count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM h WHERE i <= floor(n * CAST(0.4 AS DOUBLE))",
        ),
        "feature_augmentation": Query(_augmented, AUGMENT_SQL),
        "align_columns": Query(_aligned, f"WITH {MATRIX_SQL} SELECT vec_id, {r6('e3')} AS e3, {r6('e1')} AS e1 FROM m"),
        "random_forest_rows": Query(_forest_rows),
        "grid_search_rows": Query(_grid_search_rows),
        "domain_adaptation_rows": Query(_adapted_rows),
    }
