"""Packing: length buckets of least padding by dynamic programming, then batches of a token budget inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import blank_words, cut

#: Rows that one group of a bucket holds when ranks are given out.
GROUP_ROWS = 256


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets such that the padding of all rows to their bucket's upper length is
    least; `lengths` rise. best[k][j] is the least padded total of the first j lengths in k buckets; as the last cut
    moves right with j, each row is solved by halves."""
    n = len(lengths)
    total = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    best = np.where(np.arange(n + 1) == 0, 0.0, np.inf)
    choices = []
    for _ in range(min(buckets, n)):
        new, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            cut_at = np.arange(first, min(mid - 1, last) + 1)
            cost = best[cut_at] + lengths[mid - 1] * (total[mid] - total[cut_at])
            at = int(np.argmin(cost))
            new[mid], choice[mid] = cost[at], cut_at[at]
            todo += [(lo, mid - 1, first, int(choice[mid])), (mid + 1, hi, int(choice[mid]), last)]
        best = new
        choices.append(choice)
    cuts, at = [], n
    for choice in reversed(choices):
        if at:
            cuts.append(int(lengths[at - 1]))
            at = int(choice[at])
    return cuts[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """Batches of documents of like length.

    docs has doc_id and text; `length` is a column expression over docs, by default the number of words between blanks.
    The histogram of all exact lengths chooses the buckets; as n different lengths need n * (n - 1) / 2 tokens at least,
    it stays small beside the table (some 20,000 entries where no text has more words). Inside a bucket, batches are filled in
    the order of a hash of the id, each with as many rows as fit when all are padded to the bucket's length, at least
    one. Returns a row for each row of docs: doc_id, n_tokens, bucket (0 for the shortest), bucket_tokens (padded
    length), batch (number inside the bucket), slot (place in the batch). A null length counts as 0; a bucket of length
    0 is filled as if it were 1; rows with equal ids stand next to each other in any order; no rows give no rows. Other
    columns are not read.
    """
    count = F.size(blank_words(F.col("text"))) if length is None else length
    counted = cut(docs.select("doc_id", F.coalesce(count, F.lit(0)).cast("long").alias("n_tokens")))
    histogram = counted.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toPandas()
    upper = boundaries(histogram["n_tokens"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets) if len(histogram) else [0]
    ends = np.searchsorted(histogram["n_tokens"].to_numpy(np.int64), upper, side="right")
    sizes = np.diff(np.concatenate(([0], np.cumsum(histogram["n"].to_numpy(np.int64))[ends - 1]))) if len(histogram) else np.zeros(1, np.int64)
    number = sum((F.when(F.col("n_tokens") > u, 1).otherwise(0) for u in upper[:-1]), F.lit(0))
    of = lambda values: F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), F.col("bucket") + 1)
    mixed = F.xxhash64("doc_id", F.lit("pack"))
    placed = counted.withColumn("bucket", number.cast("int")).select("doc_id", "n_tokens", "bucket", of(upper).alias("bucket_tokens"), mixed.alias("mixed"))
    placed = placed.withColumn("part", F.pmod("mixed", of([max(1, -(-int(s) // GROUP_ROWS)) for s in sizes])))
    held = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = held.select(F.col("bucket").alias("b"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("mixed", "doc_id", "n_tokens")) - 1)
    joined = ranked.join(before, (F.col("bucket") == F.col("b")) & (F.col("part") == F.col("p")))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_tokens", F.lit(1)))).cast("long")
    rank = F.col("before") + F.col("rank")
    return joined.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(rank / room).cast("long").alias("batch"), (rank % room).cast("int").alias("slot"))
