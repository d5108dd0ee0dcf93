"""Ranks of whole numbers inside groups from bitmaps with directories of counts: nothing as long as the table is sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import cut

#: Bits of a number that each level of the directory covers above the six of a word of 64 numbers.
LEVELS = (10, 16, 16, 16)


def _left(value: int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long"), by.cast("int"))


def _before(level: DataFrame, group: Sequence[str]) -> DataFrame:
    """Add `before`, the rows of the group that lie in smaller words than `at`, and `total`, those of the group.

    Level by level: sums inside a parent (1,024 words, then 65,536 children at most) by a window, then the same for the
    parents. The last level has one or two rows a group, for negative numbers and others."""
    return _sums(level, list(group), LEVELS)


def _sums(level: DataFrame, group: list[str], shifts: Sequence[int]) -> DataFrame:
    if not shifts:
        all_of = Window.partitionBy(*group)
        return level.withColumns({"before": F.sum("n").over(all_of.orderBy("at")) - F.col("n"), "total": F.sum("n").over(all_of)})
    up = F.shiftright("at", shifts[0]).alias("up")
    inside = level.select("*", up).withColumn("inside", F.sum("n").over(Window.partitionBy(*group, "up").orderBy("at")) - F.col("n"))
    above = _sums(level.groupBy(*group, up).agg(F.sum("n").alias("n")).withColumnRenamed("up", "at"), group, shifts[1:])
    above = above.select(*group, F.col("at").alias("up"), F.col("before").alias("above"), "total")
    return inside.join(above, [*group, "up"]).withColumn("before", F.col("above") + F.col("inside")).drop("up", "inside", "above")


def bitmap_ranks(rows: DataFrame, group: Sequence[str], key: str, weight: str | None = None) -> DataFrame:
    """Add `rank` (how much stands before a row: rows of its group with a smaller key), `same` (rows with its key, itself
    included) and `total` (rows of the group).

    Each group has a bitmap of its keys: words of 64 keys, of which only those with a bit are kept, merged by OR. A
    directory holds the counts before each word; the bits below a key in its word do the rest. Words in which a key
    repeats also hold the counts of their keys, 64 at most. With `weight` (a column of whole numbers above 0) a row counts as
    so many. Groups must not be null; a null key counts as the least long. `rows` is read three times: cut it first.
    """
    group = list(group)
    n = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    value = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long"))
    keyed = rows.withColumns({"at": F.shiftright(value, 6), "low": value.bitwiseAND(63).cast("int")})
    words = cut(keyed.groupBy(*group, "at").agg(F.bit_or(_left(1, F.col("low"))).alias("bits"), F.sum(n).alias("n")))
    directory = _before(words.select(*group, "at", "n"), group).select(*group, "at", "before", "total")
    crowded = words.where(F.col("n") > F.bit_count("bits")).select(*group, "at")
    counts = keyed.join(crowded, [*group, "at"], "left_semi").groupBy(*group, "at", "low").agg(F.sum(n).alias("n"))
    crowds = counts.groupBy(*group, "at").agg(F.collect_list(F.struct("low", "n")).alias("crowd"))
    found = words.drop("n").join(directory, [*group, "at"]).join(crowds, [*group, "at"], "left")
    joined = keyed.join(found, [*group, "at"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(_left(-1, F.col("low"))))).cast("long")
    zero = F.lit(0).cast("long")
    held = lambda keep: F.aggregate(F.filter("crowd", keep), zero, lambda s, x: s + x["n"])
    one = F.col("crowd").isNull()
    return joined.withColumns(
        {
            "rank": F.col("before") + F.when(one, below).otherwise(held(lambda x: x["low"] < F.col("low"))),
            "same": F.when(one, 1).otherwise(held(lambda x: x["low"] == F.col("low"))),
        }
    ).drop("at", "low", "bits", "before", "crowd")
