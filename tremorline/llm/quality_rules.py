"""Quality rules: a table of thresholds compiled into one projection.

The measures of a text (length, symbols, stop words, repeated lines, repeated runs of
words) are column expressions, the rules are rows of a table, and ``verdict`` turns the
table into one boolean expression. Nothing leaves the JVM and nothing is shuffled: each
row is judged alone, so hot sources, copies and lost executors do not matter.

Defined cases: a missing text is an empty one; a text without words has ratios 0 and
fails the length rule; a very long text is judged whole; repeated rows are judged each; an
empty table gives no rows; columns of the input, whatever their names, are only carried
along.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.llm.text import WORD, let, total, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

# Frequent function words of seven languages; a text in one of them is full of these.
STOP_WORDS = """
a an and are as at be but by for from has have he her his in is it its not of on or she that the their they this to was were which will with you
aber als am auf aus bei bis das dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach nicht oder sich sie sind und von war wie wird zu zum zur
au aux avec ce ces cette dans du elle est et il ils je la le les leur mais ne nous ont ou par pas plus pour que qui sa se ses son sont sur un une vous
al como con de del donde el ella en era esta este fue ha la las lo los más muy no para pero por que se ser sin sobre su sus un una y
che da dei della di è gli il non per sono una uno com da do dos em não o os para por um uma het een de van ik niet op te zijn dat
""".split()
_STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})


@dataclass(frozen=True)
class Rule:
    """Bounds, both included, that ``measure`` must keep; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


# Bounds are wide: ordinary prose of any length from twenty words passes them all.
RULES = (
    Rule("n_words", low=20),
    Rule("mean_word_length", low=3.0, high=10.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_word_ratio", high=0.3),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


# How each measure follows from the counts of a text.
MEASURES = {
    **{name: itemgetter(name) for name in (*COUNTS, "n_lines", "n_stop_words")},
    "mean_word_length": lambda c: _ratio(c["word_chars"], c["n_words"]),
    "symbols_per_word": lambda c: _ratio(c["n_symbols"], c["n_words"]),
    "stop_word_ratio": lambda c: _ratio(c["n_stop_words"], c["n_words"]),
    "dup_line_ratio": lambda c: _ratio(c["n_dup_lines"], c["n_lines"]),
    "repeat_word_ratio": lambda c: _ratio(c["n_repeat_words"], c["n_words"]),
}


def verdict(rules: tuple[Rule, ...], c: Column) -> Column:
    """The rule table as one boolean expression over the counts."""
    checks = [F.lit(True)]
    for rule in rules:
        value = MEASURES[rule.measure](c)
        if rule.low is not None:
            checks.append(value >= rule.low)
        if rule.high is not None:
            checks.append(value <= rule.high)
    return reduce(lambda a, b: a & b, checks)


def _joined_hashes(hashes: Column, step: int) -> Column:
    """Hashes of twice-as-wide windows: each paired with the one ``step`` further on."""
    return F.when(
        F.size(hashes) > step,
        F.zip_with(
            F.slice(hashes, 1, F.size(hashes) - step),
            F.slice(hashes, step + 1, F.size(hashes) - step),
            lambda a, b: F.xxhash64(a, b),
        ),
    ).otherwise(F.slice(hashes, 1, 0))


def _window_hashes(word_list: Column, window: int) -> Column:
    """One hash per window of words, doubled up from hashes of single words."""
    width, hashes = 1, F.transform(word_list, lambda w: F.xxhash64(w))
    while width < window:
        step = min(width, window - width)
        hashes = let(hashes, lambda h: _joined_hashes(h, step))
        width += step
    return hashes


def _repeated_positions(word_list: Column, window: int) -> Column:
    """Start positions of the windows whose words occur at least twice, ascending.

    Windows are sorted by their words, so equal ones are neighbours: n log n in the
    length of the text, with the words themselves compared.
    """
    grams = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), F.size(word_list) - (window - 1)),
            lambda i: F.struct(F.array_join(F.slice(word_list, i, window), " ").alias("g"), i.alias("p")),
        )
    )
    return let(
        grams,
        lambda s: F.array_sort(
            F.transform(
                F.filter(
                    s,
                    lambda x, i: x["g"].eqNullSafe(F.get(s, i - 1)["g"]) | x["g"].eqNullSafe(F.get(s, i + 1)["g"]),
                ),
                lambda x: x["p"],
            )
        ),
    )


def _covered(starts: Column, window: int) -> Column:
    """Number of positions inside windows that begin at the ascending ``starts``."""
    return let(
        starts,
        lambda s: total(
            F.transform(s, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1) - p, F.lit(window))))
        ),
    )


def counts(text: Column, window: int = WINDOW) -> Column:
    """Struct of all counts of a text.

    The lists of words and lines are bound once; a filter on the verdict, which Spark moves
    down to the scan, does not compute them again for every rule.
    """

    def counted(lists: Column) -> Column:
        word_list, lines = lists["words"], lists["lines"]
        # Equal windows have equal hashes: a text with distinct hashes repeats nothing, and
        # only the others, few in any corpus, compare the words.
        repeats = let(_window_hashes(word_list, window), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        symbols = F.length(text) - F.length(F.translate(text, SYMBOLS[1:-1], ""))
        numbers = {
            "n_words": F.size(word_list),
            "word_chars": total(F.transform(word_list, lambda w: F.length(w))),
            "n_symbols": F.when(text.rlike(SYMBOLS), symbols).otherwise(0),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_stop_words": F.size(F.filter(word_list, lambda w: w.isin(_STOP_FORMS))),
            "n_repeat_words": F.when(repeats, _covered(_repeated_positions(word_list, window), window)).otherwise(0),
        }
        return F.struct(*(value.cast("long").alias(name) for name, value in numbers.items()))

    lists = F.struct(
        words(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    return let(lists, counted)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def judgement(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the counts, ``base_failed`` and ``kept``."""

    def judged(c: Column) -> Column:
        fields = (*COUNTS, "n_lines", "n_stop_words")
        return F.struct(
            *(c[name].alias(name) for name in fields),
            base_failed(c).alias("base_failed"),
            (~base_failed(c) & verdict(rules, c)).alias("kept"),
        )

    return let(counts(F.coalesce(text, F.lit(""))), judged)


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row, beside ``row``, the struct of its
    columns."""
    return docs.select(F.struct("*").alias("row"), judgement(F.col(text_col), rules).alias("j")).select("row", "j.*")


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with the columns of ``docs``."""
    return docs.filter(judgement(F.col(text_col), rules)["kept"])
