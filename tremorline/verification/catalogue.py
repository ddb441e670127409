"""All registered queries."""

from __future__ import annotations

from tremorline.verification import features, learning, series
from tremorline.verification.base import Query
from tremorline.verification.series import flagship

__all__ = ["build", "flagship"]


def build() -> dict[str, Query]:
    return {**series.build(), **features.build(), **learning.build()}
