"""Column functions for scores: buckets, terms and money."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(c: Column, thresholds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Name of the first threshold, from the highest, that the value reaches; null counts as below all."""
    out = F.lit(otherwise)
    for least, name in sorted(thresholds):
        out = F.when(c >= least, name).otherwise(out)
    return out


#: Tier thresholds of the boards: fixed values.
TIERS = ((85, "CRITICAL"), (70, "HIGH"), (55, "MEDIUM"))
NOTICE_LEVELS = ((95, "CRITICAL"), (85, "HIGH"), (70, "MEDIUM"))
SAMPLE_LEVELS = ((25, "VERY HIGH"), (10, "HIGH"), (5, "MEDIUM"))


def round2(c: Column) -> Column:
    """Two decimals, halves up, by plain arithmetic, so that any engine gives the same."""
    return F.floor(c * 100 + 0.5) / 100


def hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that a text contains, in their order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(lowered, t))


def term_points(text: Column, weights: Mapping[str, int]) -> Column:
    """Sum of the weights of the terms that a text contains, each once."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(F.contains(lowered, F.lit(t)), w).otherwise(0) for t, w in weights.items()), F.lit(0))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def half_even(c: Column) -> Column:
    """Whole number, halves to even."""
    return F.bround(c, 0).cast("int")
