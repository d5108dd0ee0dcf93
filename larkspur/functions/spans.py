"""Places of pattern matches in texts, with column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,end:int,match:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def sums_before(numbers: Column) -> Column:
    """For each of an array of ints the sum of those before it. Sums of blocks of about the square root of the array's
    size are added up first, so that n numbers take about n * sqrt(n) steps and no array grows."""

    def summed(v: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int"))

        def by_blocks(w: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda j: total(F.slice(v, j * w + 1, w)))

            def whole(b: Column) -> Column:
                before = F.transform(b, lambda _, j: total(F.slice(b, F.lit(1), j)))
                return let(before, lambda p: F.transform(v, lambda _, i: F.get(p, F.floor(i / w).cast("int")) + total(F.slice(v, F.floor(i / w).cast("int") * w + 1, i % w))))

            return let(blocks, whole)

        return let(width, by_blocks)

    return let(numbers, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(summed(v)))


def placed(text: Column, pattern: Column) -> Column:
    """Matches of a pattern with their places: array of struct (start, end, match), in code points.

    The pieces between matches come from split(); a match starts where the lengths before it add up to.
    """

    def found(pair: Column) -> Column:
        matches, pieces = pair["m"], pair["p"]
        lengths = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        return let(sums_before(lengths), lambda at: F.transform(matches, lambda m, i: let(F.get(at, i) + F.length(F.get(pieces, i)), lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))))

    pair = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern).alias("p"))
    return let(pair, lambda x: F.when(F.size(x["m"]) == 0, F.array().cast(SPAN_TYPE)).otherwise(found(x)))
