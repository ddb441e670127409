"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``.

Defined cases, all stages: a missing text is an empty one and goes with the quality rules, as
do empty texts; ties and repeated rows are kept or dropped together; very long texts are
taken whole; rows without an id stay only where nothing like them has one; an empty table
gives no rows; further columns are carried up to packing, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm import line_dedup, packing, quality_rules, secret_scan, simhash
from tremorline.session import delete_folder, stage_path, staging_scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats."""
    return with_text(line_dedup.drop_boilerplate(docs, F.col("source")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; the models are trained on what is left."""
    ratios = secret_scan.train(secret_scan.samples_of(docs))
    return with_text(secret_scan.redact(docs, ratios), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in windows of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def with_text(changed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a document with its new text and its new length."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return changed.select(*(new.get(c, F.col("row")[c]).alias(c) for c in columns))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("packing", pack),
]

# Fingerprints, scored secrets and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables go once its result is written, and
    its result once the next stage's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        path = stage_path(spark, name.replace(" ", "_"))
        with staging_scope(spark):
            made = function(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
