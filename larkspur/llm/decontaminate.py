"""Benchmark decontamination by a prefix-filtered containment join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, few, lower_ascii

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters a-z and characters beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAP), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows of `window` item words with the ids of the items that hold them; a shorter item is one window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    spans = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        items.select("item_id", F.explode(F.transform(spans, lambda i: F.slice("w", i, window))).alias("win"))
        .groupBy("win")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )


def prefix_index(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """For each window its rarest token and where it stands.

    A window is contained only if all its tokens are, so a prefix of one token, the rarest over all documents, is
    enough as a join key.
    """
    placed = windows.select("win", "items", F.posexplode("win").alias("off", "token"))
    vocabulary = placed.select("token").distinct()
    seen = docs.select(F.explode(words(F.col("text"))).alias("token"))
    often = seen.join(few(vocabulary), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return (
        placed.join(often, "token", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("least"), F.first("items").alias("items"))
        .select(F.col("least.token").alias("token"), F.col("least.off").alias("off"), F.size("win").alias("len"), "win", "items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20) -> DataFrame:
    """Where documents repeat benchmark items.

    docs has doc_id and text, benchmark has item_id and text. Returns one row for each row of docs: doc_id, mark
    (hash of the text, which tells rows of one id apart), n_words, spans (array of start and end word positions, from 0, end exclusive), n_hit (words inside any span), items (ids as
    sorted strings), contaminated (n_hit > 0 and at least one word in `one_in` is hit). Null and empty texts have no words
    and are not contaminated; items without words are ignored; rows with the same id and text get the same answer; an
    empty benchmark finds nothing. Other columns of docs and benchmark are not read.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    index = cut(prefix_index(docs, item_windows(benchmark, window)))
    small = few(index)
    tokens = docs.select("doc_id", "mark", words(F.col("text")).alias("w"))
    if small is index:  # too large to broadcast: rows travel, so they carry only the words around
        around = tokens.select("doc_id", "mark", F.size("w").alias("n"), "w", F.posexplode("w").alias("pos", "token")).select(
            "doc_id", "mark", "n", "pos", "token", F.slice("w", F.greatest(F.col("pos") - window + 2, F.lit(1)), 2 * window - 1).alias("near")
        )
        first = F.greatest(F.col("pos") - window + 1, F.lit(0))
        found = F.slice("near", F.col("pos") - F.col("off") - first + 1, F.col("len"))
    else:
        around = tokens.select("doc_id", "mark", F.size("w").alias("n"), "w", F.posexplode("w").alias("pos", "token"))
        found = F.slice("w", F.col("pos") - F.col("off") + 1, F.col("len"))
    inside = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n"))
    hits = (
        around.join(small, "token")
        .where(inside)
        .select("doc_id", "mark", (F.col("pos") - F.col("off")).alias("start"), "len", "items", (found == F.col("win")).alias("same"))
        .where("same")
        .groupBy("doc_id", "mark")
        .agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "spans", "items")
    )
    covered = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(s["end"] - F.greatest(a["upto"], s["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    counted = docs.select("doc_id", "mark", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    return joined.select(
        "doc_id",
        "mark",
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        covered.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
