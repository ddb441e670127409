"""Secrets in texts: fixed patterns, and strings that look random to two Markov models.

Two first-order character models, one of random strings and one of ordinary identifiers,
are counted from labelled samples: strings drawn at random over the alphabets of keys, and
long words and identifiers of the texts themselves, outside of pattern matches. So the
models know nothing of the patterns. A candidate string is reported when the log-likelihood
ratio of the two, summed over its characters, reaches ``MIN_LOG_RATIO``. Pattern matches
are always reported; the models only add spans.

All of it is column arithmetic. Training reads a bounded sample (``SAMPLE_DOCS`` documents
by a hash of their text, ``RANDOM_SAMPLES`` drawn strings) and is one grouped count with at
most 2 x 68 x 68 groups; that table is all that reaches the driver. A scan has no
shuffle. Spans of a text come from the pieces between its matches, in time linear in the
length of the text.

Defined cases: a missing text is an empty one and has no spans; without samples of both
classes nothing is added; repeated rows are scanned each, and of rows with one text the
sample takes all or none; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm.text import let, total

MASK = "[SECRET]"
MIN_LOG_RATIO = 6.0
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A pattern and the least length of one of its groups; shorter matches do not count.
    Texts whose lower case holds none of ``hints`` have no match."""

    name: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()

    def may_match(self, text: Column) -> Column:
        """Whether to look for the pattern: finding a plain string is far cheaper."""
        lower = F.lower(text)
        hinted = [lower.contains(hint) for hint in self.hints]
        return reduce(lambda a, b: a | b, hinted) & text.rlike(self.pattern) if hinted else text.rlike(self.pattern)


# The patterns. Matches are found without regard to length and then
# filtered; for access and hex a bound in the pattern comes to the same.
BASE = (
    Kind(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
        ("passw", "secret", "token", "api"),
    ),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18, ("akia",)),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Scored strings, and what the models call ordinary where it is outside of pattern matches.
CANDIDATE = Kind("random", r"[A-Za-z0-9+/_=-]{12,}", 0, 12)
SAMPLE_DOCS = 20_000
RANDOM_SAMPLES = 20_000
_ANY_BASE = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}"""
    r"""|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}"""
)

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: before the first character, or any other character
# Alphabets that keys and tokens are drawn from: letters and digits, base 64 and its form
# for URLs, capitals and digits, small letters and digits.
DRAWN = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62])


def _bigrams(token: Column) -> Column:
    """``previous * STATES + current`` for every character of ``token``."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(codes, lambda s: F.transform(s, lambda c, i: F.coalesce(F.get(s, i - 1), F.lit(0)) * STATES + c))


def train(samples: DataFrame, smoothing: float = 0.1) -> list[float]:
    """Log-likelihood ratios of all character pairs from ``samples`` (token, is_random)."""
    counts = (
        samples.select("is_random", F.explode(_bigrams(F.col("token"))).alias("pair"))
        .groupBy("is_random", "pair")
        .count()
        .collect()  # at most 2 * STATES * STATES rows
    )
    if {row.is_random for row in counts} != {True, False}:
        return [0.0] * STATES**2
    logs = []
    for wanted in (True, False):
        cells = [[smoothing] * STATES for _ in range(STATES)]
        for is_random, pair, n in counts:
            if is_random == wanted:
                cells[pair // STATES][pair % STATES] += n
        logs.append([math.log(v / sum(row)) for row in cells for v in row])
    return [a - b for a, b in zip(*logs)]


def random_strings(spark: SparkSession, count: int = RANDOM_SAMPLES) -> DataFrame:
    """``token``: strings of 12 to 48 characters, each alphabet of ``DRAWN`` in turn."""
    alphabet = F.get(F.array(*map(F.lit, DRAWN)), F.pmod("id", F.lit(len(DRAWN))).cast("int"))
    length = 12 + F.pmod(F.xxhash64("id"), F.lit(37)).cast("int")
    place = lambda i: F.pmod(F.xxhash64("id", i), F.length(alphabet)).cast("int") + 1
    drawn = F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(alphabet, place(i), F.lit(1)))
    return spark.range(count).select(F.array_join(drawn, "").alias("token"))


def samples_of(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_DOCS) -> DataFrame:
    """token, is_random: drawn strings, and long strings of about ``rows`` texts at most."""
    share = min(1.0, rows / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = F.when(text.rlike(_ANY_BASE), F.regexp_replace(text, _ANY_BASE, " ")).otherwise(text)
    ordinary = chosen.select(F.explode(F.regexp_extract_all(rest, F.lit(CANDIDATE.pattern), F.lit(0))).alias("token"))
    drawn = random_strings(docs.sparkSession).withColumn("is_random", F.lit(True))
    return drawn.unionByName(ordinary.withColumn("is_random", F.lit(False)))


def log_ratio(token: Column, table: Column) -> Column:
    """Summed log-likelihood ratio of ``token`` under the pair ``table`` of ``train``."""
    return F.aggregate(_bigrams(token), F.lit(0.0), lambda acc, pair: acc + F.get(table, pair))


def _running(values: Column) -> Column:
    """Running sums of a non-empty array, block by block, so that no step copies the whole."""

    def appended(part: Column, start: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(start.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, v: F.struct(
                (acc["sum"] + v).alias("sum"), F.array_append(acc["out"], acc["sum"] + v).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        sums = F.transform(numbers, lambda b: total(F.slice(v, b * BLOCK + 1, BLOCK)))
        return let(
            appended(sums, F.lit(0)),
            lambda ends: F.flatten(
                F.transform(
                    numbers,
                    lambda b: appended(F.slice(v, b * BLOCK + 1, BLOCK), F.coalesce(F.get(ends, b - 1), F.lit(0))),
                )
            ),
        )

    return let(values, blocks)


_SPAN = "struct<start:bigint,order:int,end:bigint,kind:string,value:string>"


def _spans(text: Column, kind: Kind, order: int) -> Column:
    """Spans of one kind: code points, end exclusive."""
    none = F.array().cast(f"array<{_SPAN}>")

    def located(hits: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        steps = F.transform(
            F.slice(gaps, 1, F.size(hits)),
            lambda gap, i: F.length(gap) + F.coalesce(F.length(F.get(hits, i - 1)["whole"]), F.lit(0)),
        )
        return let(
            _running(steps),
            lambda starts: F.transform(
                hits,
                lambda hit, i: F.struct(
                    F.get(starts, i).alias("start"),
                    F.lit(order).alias("order"),
                    (F.get(starts, i) + F.length(hit["whole"])).alias("end"),
                    F.lit(kind.name).alias("kind"),
                    hit["value"].alias("value"),
                ),
            ),
        )

    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    hits = F.zip_with(whole, value, lambda w, v: F.struct(w.alias("whole"), v.alias("value")))
    found = F.filter(let(hits, located), lambda s: F.length(s["value"]) >= kind.least)
    return F.when(kind.may_match(text), found).otherwise(none)


def table_literal(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")


def scan(
    docs: DataFrame, ratios: list[float], text_col: str = "text", min_log_ratio: float = MIN_LOG_RATIO
) -> DataFrame:
    """``row`` (the input's columns as a struct), ``base`` and ``added``: arrays of spans
    (start, order, end, kind, value), each ordered by start and kind."""
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    table = table_literal(ratios)
    base = F.array_sort(F.concat(*(_spans(text, kind, i) for i, kind in enumerate(BASE))))
    found = docs.select(F.struct("*").alias("row")).select(
        "row",
        base.alias("base"),
        F.filter(
            _spans(text, CANDIDATE, len(BASE)), lambda s: log_ratio(s["value"], table) >= min_log_ratio
        ).alias("candidates"),
    )
    # A candidate that a pattern has already reported whole is not news.
    spot = lambda s: F.concat_ws(":", s["start"], s["end"])
    old = F.array_intersect(F.transform("candidates", spot), F.transform("base", spot))
    return found.select(
        "row",
        "base",
        F.when(F.size("base") == 0, F.col("candidates"))
        .when(F.size("candidates") == 0, F.col("candidates"))
        .otherwise(_without("candidates", spot, old))
        .alias("added"),
    )


def _without(spans: str, spot: Callable[[Column], Column], old: Column) -> Column:
    """``spans`` less those whose ``spot`` is among ``old``: both lists are merged in one
    sort, where an old spot stands right before the span of the same place."""
    none = F.lit(None).cast(_SPAN)
    marked = F.array_sort(
        F.concat(
            F.transform(old, lambda o: F.struct(o.alias("spot"), F.lit(0).alias("side"), none.alias("span"))),
            F.transform(spans, lambda s: F.struct(spot(s).alias("spot"), F.lit(1).alias("side"), s.alias("span"))),
        )
    )
    return let(
        marked,
        lambda m: F.array_sort(
            F.transform(
                F.filter(
                    m, lambda x, i: (x["side"] == 1) & ~x["spot"].eqNullSafe(F.get(m, i - 1)["spot"])
                ),
                lambda x: x["span"],
            )
        ),
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined, by start and then kind."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(
    docs: DataFrame, ratios: list[float], text_col: str = "text", min_log_ratio: float = MIN_LOG_RATIO
) -> DataFrame:
    """``row`` and ``text`` with ``MASK`` for every secret: first the spans of ``scan``, as one
    where they overlap, then kind by kind, in the order of ``BASE`` and then the scored
    strings, what is a match only in the text that this has left."""
    table = table_literal(ratios)
    spans = F.concat("base", "added")
    out = scan(docs, ratios, text_col, min_log_ratio).select(
        "row", F.col("row")[text_col].alias("text"), spans.alias("spans"), (F.size(spans) > 0).alias("hit")
    )
    out = out.select("row", F.when(F.col("hit"), _covered(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("text"), "hit")
    for kind in (*BASE, CANDIDATE):
        masked = _masked(F.col("text"), kind, table, min_log_ratio)
        out = out.select("row", F.when(F.col("hit"), masked).otherwise(F.col("text")).alias("text"), "hit")
    return out.select("row", "text")


def _covered(text: Column, spans: Column) -> Column:
    """``text`` with ``MASK`` for every stretch that ``spans``, one at least, cover.

    A stretch begins where the first span opens and ends where none is open any more;
    where one ends and another begins at the same place, there are two.
    """
    edges = F.array_sort(
        F.concat(
            F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("step"))),
            F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(-1).alias("step"))),
        )
    )

    def outer(edges: Column) -> Column:
        opened = _running(F.transform(edges, lambda e: e["step"]))
        return F.filter(
            F.zip_with(edges, opened, lambda e, n: F.struct(e["at"].cast("int").alias("at"), e["step"].alias("step"), n.alias("open"))),
            lambda e: (e["open"] == 0) | ((e["open"] == 1) & (e["step"] == 1)),
        )

    def places(edges: Column, step: int) -> Column:
        return F.transform(F.filter(edges, lambda e: e["step"] == step), lambda e: e["at"])

    def joined(edges: Column) -> Column:
        starts, ends = F.concat(F.array(F.lit(0)), places(edges, -1)), F.concat(places(edges, 1), F.array(F.length(text)))
        # Slices of the characters take time linear in the text, substrings would not.
        return let(
            F.split(text, ""),
            lambda chars: F.array_join(
                F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")), MASK
            ),
        )

    return let(let(edges, outer), joined)


def _masked(text: Column, kind: Kind, table: Column, min_log_ratio: float) -> Column:
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole

    def secret(v: Column) -> Column:
        if kind is CANDIDATE:
            return log_ratio(v, table) >= min_log_ratio
        return F.length(v) >= kind.least

    shown = F.zip_with(whole, value, lambda w, v: F.when(secret(v), F.lit(MASK)).otherwise(w))
    pieces = F.zip_with(F.split(text, kind.pattern, -1), shown, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))))
    return F.when(text.rlike(kind.pattern), F.array_join(pieces, "")).otherwise(text)
