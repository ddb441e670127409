"""Forests as tables of nodes: predictions by joins, and scores of every smaller forest.

A fitted forest is written down and read back as one row per node, so its trees never pass
through the driver. Rows walk all trees at once, one level a join: (row, tree, node) meets
the node's split and moves on to a child. The table of nodes is small next to the rows, and
Spark broadcasts it where its size allows.

The votes of the first k trees are the prediction of a forest of those k trees. So one
forest of the largest size scores every smaller one.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.learning.forest import FOLDS, _ready, with_folds
from tremorline.session import stage, stage_path

c = F.col


def node_table(model: RandomForestClassificationModel, spark: SparkSession) -> DataFrame:
    """tree, node, feature (-1 at a leaf), threshold, left, right and ``votes``: the share of
    each class among the rows that the node was fitted on."""
    path = stage_path(spark, "forest")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    return data.select(
        c("treeID").alias("tree"),
        c("id").alias("node"),
        c("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        c("leftChild").alias("left"),
        c("rightChild").alias("right"),
        F.transform("impurityStats", lambda x: F.when(total > 0, x / total).otherwise(0.0)).alias("votes"),
    )


def tree_votes(rows: DataFrame, key: str, nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """key, tree and ``votes`` of the leaf that each row reaches in each tree."""
    walked = rows.select(
        key, vector_to_array("features").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    ).withColumn("node", F.lit(0))
    splits = nodes.filter("feature >= 0").select("tree", "node", "feature", "threshold", "left", "right")
    for _ in range(depth):
        goes_left = F.get("x", c("feature")) <= c("threshold")
        child = F.when(c("feature").isNull(), c("node")).when(goes_left, c("left")).otherwise(c("right"))
        walked = walked.join(splits, ["tree", "node"], "left").select(key, "x", "tree", child.alias("node"))
    return walked.join(nodes.select("tree", "node", "votes"), ["tree", "node"]).select(key, "tree", "votes")


def _first_largest(votes: str):
    """Number of the class with most votes, the first among equals."""
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("int")


def predict_by_nodes(model: RandomForestClassificationModel, rows: DataFrame, key: str) -> DataFrame:
    """key and ``prediction`` in the original classes, by walking the table of nodes."""
    nodes = stage(node_table(model, rows.sparkSession), "nodes")
    depth, classes = model.getOrDefault("maxDepth"), model.numClasses
    found = tree_votes(rows, key, nodes, model.getNumTrees, depth)
    summed = found.groupBy(key).agg(F.array(*[F.sum(F.get("votes", F.lit(i))) for i in range(classes)]).alias("votes"))
    return summed.select(key, (_first_largest("votes") + 1).alias("prediction"))


def weighted_f1(predictions: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``score``: F1 of (_label, guess) by class, weighted by the classes' rows."""
    counts = predictions.groupBy(*by, "_label", "guess").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(c("_label") == c("guess"), c("n")).otherwise(0)
    actual = counts.groupBy(*by, c("_label").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    guessed = counts.groupBy(*by, c("guess").alias("class")).agg(F.sum("n").alias("guesses"))
    f1 = 2 * c("hits") / (c("support") + F.coalesce("guesses", F.lit(0)))
    scored = actual.join(guessed, [*by, "class"], "left")
    return scored.groupBy(*by).agg((F.sum(f1 * c("support")) / F.sum("support")).alias("score"))


def prefix_predictions(rows: DataFrame, key: str, votes: DataFrame, sizes: list[int], classes: int) -> DataFrame:
    """key, ``trees`` and ``guess`` (zero-based) of the forests of the first 1, 2, ... trees
    whose sizes are asked for."""
    first = Window.partitionBy(key).orderBy("tree").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = votes.withColumn(
        "votes", F.array(*[F.sum(F.get("votes", F.lit(i))).over(first) for i in range(classes)])
    )
    wanted = upto.withColumn("trees", c("tree") + 1).filter(c("trees").isin(sizes))
    return wanted.select(key, "trees", _first_largest("votes").cast("double").alias("guess"))


def nested_search(
    df: DataFrame, key: str, learner: RandomForestClassifier, depths: Iterable[int], feature_shares: Iterable[str],
    leaf_rows: Iterable[int], trees: Iterable[int], folds: int = FOLDS,
) -> DataFrame:
    """Every setting with its mean weighted F1 over the folds: depth, feature_share,
    leaf_rows, trees, score.

    One forest is fitted per depth, share, leaf and fold, of the largest number of trees;
    its first k trees are the forest of k trees.
    """
    sizes = sorted(set(trees))
    ready = stage(with_folds(_ready(df), key, folds), "folds")
    classes = int(ready.agg(F.max("_label")).first()[0]) + 1
    found = []
    for depth, share, leaf in product(depths, feature_shares, leaf_rows):
        setting = {
            learner.maxDepth: depth, learner.featureSubsetStrategy: share, learner.minInstancesPerNode: leaf,
            learner.numTrees: sizes[-1],
        }
        for fold in range(folds):
            model = learner.fit(ready.filter(c("fold") != fold), setting)
            held = ready.filter(c("fold") == fold)
            nodes = stage(node_table(model, df.sparkSession), "nodes")
            votes = tree_votes(held, key, nodes, sizes[-1], depth)
            guesses = prefix_predictions(held, key, votes, sizes, classes).join(held.select(key, "_label"), key)
            scored = weighted_f1(guesses, ["trees"])
            found.append(
                scored.select(
                    F.lit(depth).alias("depth"), F.lit(share).alias("feature_share"), F.lit(leaf).alias("leaf_rows"),
                    "trees", F.lit(fold).alias("fold"), "score",
                )
            )
    table = found[0]
    for more in found[1:]:
        table = table.unionByName(more)
    setting = ["depth", "feature_share", "leaf_rows", "trees"]
    return stage(table, "scores").groupBy(*setting).agg(F.avg("score").alias("score"))


def best_setting(scores: DataFrame) -> dict[str, object]:
    """The setting with the highest score; among equals the fewest trees, then the least depth."""
    return scores.orderBy(F.desc("score"), "trees", "depth", "leaf_rows", "feature_share").first().asDict()
