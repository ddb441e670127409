"""Exact duplicates by salted, content-checked combining.

Copies are found in three steps, none of which brings a whole group together:

1. *local*: equal (digest, salt, content) rows of a task collapse before the shuffle
   (partial aggregation);
2. *salted*: what is left meets by (digest, salt, content). A group of copies, however
   large, is spread over ``salts`` keys;
3. *global*: at most ``salts`` winners per content meet by (digest, content), and go back
   to the rows under each salt they came from, so the rows never meet by digest alone.

The content itself is a grouping key at every step, so two texts with one digest stay two
groups. Texts whose digest occurs once, counted by (digest, salt) first, equal no other
text; they skip the steps. Salts are computed from the row, so a task that runs again deals
its rows out the same way.

Defined cases: a missing text is an empty one; without an id a row loses to any row with
one, and a group of rows without ids keeps them all; rows repeated with one id are one
document and stay or go together; a very long text is compared whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.llm.text import ascii_lower
from tremorline.session import stage

SALTS = 32


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the largest id among the rows with the same normalised text (A-Z in
    lower case).
    """
    content = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    salt = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(salts))
    rows = docs.select(F.col(id_col).alias("id"), content.alias("content"))
    rows = rows.select("id", "content", F.sha2("content", 256).alias("digest"), salt.alias("salt"))
    digests = stage(rows.select("id", "digest", "salt"), "digests")
    # Joins are merge joins at every size: how many digests repeat follows the input, so
    # none is broadcast. Tables between a join and an aggregation on some of its keys are
    # written down, as Spark would otherwise do both in one stage, dealt by those alone.
    counted = stage(digests.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n")), "counted")
    repeated = counted.groupBy("digest").agg(F.sum("n").alias("all")).filter("all > 1").select("digest")
    places = stage(counted.join(repeated.hint("merge"), "digest").select("digest", "salt"), "repeated")
    copies = stage(rows.join(places.hint("merge"), ["digest", "salt"]), "copies")
    salted = copies.groupBy("digest", "salt", "content").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    winners = salted.groupBy("digest", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts")
    )
    groups = stage(winners.select("digest", F.explode("salts").alias("salt"), "content", "keep_id", "group_size"), "groups")
    in_groups = copies.join(groups.hint("merge"), ["digest", "salt", "content"]).select(
        "id", "digest", "keep_id", "group_size"
    )
    alone = digests.join(places.hint("merge"), ["digest", "salt"], "left_anti").select(
        "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return in_groups.unionByName(alone).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
