"""Lines that a whole site repeats, dropped by their share of the site's pages.

For every host, the pages that contain a line are counted (a line counts once a page) and
divided by the pages of the host. Lines above ``max_ratio`` that are on ``min_pages`` pages
or more are boilerplate of that host and go from all its pages.

Scale: counting is keyed by (host, line digest) with partial aggregation, so neither a host
with a third of all pages nor a line on every page lands in one task, and no text is
shuffled for it. What is left per host is small whatever the input: a line above the ratio
takes ``max_ratio`` of the host's pages, so a host has at most (mean distinct lines per
page) / ``max_ratio`` of them. That list goes back to the pages in a join which Spark
broadcasts only if the lists are small; otherwise the pages of a host meet it under
``SALTS`` keys, each of which has a copy of the list.

Defined cases: a missing host is a host of its own; a missing text stays missing; blank
lines are never boilerplate; a page whose every line is boilerplate would be left without
any content, keeps its text and is marked (such whole copies are the matter of the deduplicators);
repeated rows are pages of their own; a very long text is cut into its lines in one row; an
empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.llm.text import WORD
from tremorline.session import stage

MAX_RATIO = 0.02
MIN_PAGES = 5  # below that, chance and copies of a page look like boilerplate
SALTS = 16


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(
    pages: DataFrame, host: Column, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``host`` with ``digests``, the digests of its boilerplate lines."""
    totals = pages.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    worded = F.filter(lines_of(F.coalesce(F.col(text_col), F.lit(""))), lambda line: line.rlike(WORD))
    counts = (
        pages.select(host.alias("host"), F.explode(F.array_distinct(worded)).alias("line"))
        .groupBy("host", digest(F.col("line")).alias("digest"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    c, t = counts.alias("c"), totals.alias("t")
    return (
        c.join(t, F.col("c.host").eqNullSafe(F.col("t.host")))
        .filter(F.col("c.n") > max_ratio * F.col("t.pages"))
        .groupBy("c.host")
        .agg(F.collect_list("c.digest").alias("digests"))
    )


def drop_boilerplate(
    pages: DataFrame,
    host: Column,
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``row`` (the input's columns as a struct), ``text`` without the boilerplate lines,
    ``n_lines``, ``n_dropped`` and ``only_boilerplate``: nothing but boilerplate, text kept."""
    # Written first, so that the plan knows its size before any text is dealt out.
    lists = boilerplate(pages, host, text_col, max_ratio, min_pages)
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    found = stage(lists.select("host", "digests", salts.alias("salt")), "boilerplate").alias("b")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), salt.alias("salt")).alias("p")
    same = F.col("p.host").eqNullSafe(F.col("b.host")) & (F.col("p.salt") == F.col("b.salt"))
    joined = rows.join(found, same, "left").select("row", "digests")
    text = F.col("row")[text_col]
    lines = lines_of(F.coalesce(text, F.lit("")))

    def stays(line: Column) -> Column:
        return ~line.rlike(WORD) | ~F.array_contains("digests", digest(line))

    rest = joined.select(
        "row",
        lines.alias("lines"),
        F.when(F.col("digests").isNull(), lines).otherwise(F.filter(lines, stays)).alias("rest"),
    )
    emptied = F.exists("lines", lambda line: line.rlike(WORD)) & ~F.exists("rest", lambda line: line.rlike(WORD))
    judged = rest.select("row", "lines", "rest", emptied.alias("emptied"))
    kept = judged.select(
        "row", "lines", F.when(F.col("emptied"), F.col("lines")).otherwise(F.col("rest")).alias("rest"), "emptied"
    )
    return kept.select(
        "row",
        F.when(text.isNotNull(), F.array_join("rest", "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("rest")).cast("long").alias("n_dropped"),
        F.col("emptied").alias("only_boilerplate"),
    )
