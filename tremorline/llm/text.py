"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space is the six ASCII characters below and nothing else; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it.

    A plain reference inside a lambda would be evaluated for every element; a lambda
    variable is not.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character left alone."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def words(text: Column) -> Column:
    """Words of ``text`` in order; an empty or missing text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def total(values: Column) -> Column:
    """Sum of an array of whole numbers, 0 for an empty one."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + v)
