"""Byte-level BPE: documents to token ids and back, by merges that are replayed over the corpus' words."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import light_batches
from larkspur.llm.merge_replay import MergeReplay

#: Most words, and most bytes of words, whose ids travel to every task.
SHARED_WORDS = 400_000
SHARED_BYTES = 16_000_000
#: Words that a task counts before it passes the counts on.
COUNTED_WORDS = 300_000
#: Longest word among the shared ones, in characters.
SHARED_LENGTH = 64
#: Characters of texts, and words kept from text to text, that a task holds as words at once.
HELD_CHARS = 2_000_000
HELD_WORDS = 300_000

_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a file of lines with base64 and rank. The driver reads it; tasks get the table."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def splitter(pattern: str) -> regex.Pattern:
    r"""The compiled pattern; `\s` is Unicode's White_Space, which Python's sense of it exceeds by \x1c-\x1f."""
    white = pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")
    return regex.compile(white)


def count_words(docs: DataFrame, pattern: str) -> DataFrame:
    """word and n: how often each match of the pattern occurs in all texts (`text`; a null has none)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, seen = splitter(pattern).findall, Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(find(text or ""))
                if len(seen) > COUNTED_WORDS:
                    yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": list(seen.values())})

    light_batches(docs.sparkSession)
    return docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> dict[str, bytes]:
    """The ids (packed, little-endian, 32 bits each) of the corpus' most frequent words, at most SHARED_WORDS words and
    SHARED_BYTES bytes of them. Merges are replayed over these words in as many tasks as there are partitions."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges = MergeReplay(table.value)
        for batch in batches:
            ids = merges.encode([w.encode() for w in batch["word"]])
            yield pd.DataFrame({"word": pd.Series(list(batch["word"]), dtype=object), "n": batch["n"].to_numpy(), "ids": [np.array(x, "<u4").tobytes() for x in ids]})

    common = count_words(docs, pattern).where(F.length("word") <= SHARED_LENGTH).orderBy(F.desc("n"), "word").limit(SHARED_WORDS)
    parts = max(1, min(64, spark.sparkContext.defaultParallelism))
    encoded = common.repartition(parts, "word").mapInPandas(replay, "word string, n long, ids binary").toPandas()
    encoded = encoded.sort_values(["n", "word"], ascending=[False, True])
    size = encoded["word"].str.len().astype(np.int64).cumsum() * 4 + encoded["ids"].str.len().astype(np.int64).cumsum()
    fits = (size <= SHARED_BYTES).to_numpy(bool)
    return dict(zip(encoded["word"][fits], (bytes(x) for x in encoded["ids"][fits]), strict=True))


def encode_batches(ranks: dict[bytes, int], shared: dict[str, bytes], pattern: str) -> Callable[[pd.Series], Iterator[list[bytes]]]:
    """A function from texts to lists of packed ids, some texts at a time. Words that aren't shared are replayed together, for
    all texts of such a list, and kept for the next ones up to HELD_WORDS."""
    find, merges, table = splitter(pattern).findall, MergeReplay(ranks), dict(shared)

    def some(words: list[list[str]]) -> list[bytes]:
        nonlocal table
        seen = set().union(*words)
        new = list(seen.difference(table))
        if len(table) + len(new) > len(shared) + HELD_WORDS:
            table = dict(shared)
            new = list(seen.difference(table))
        table.update(zip(new, (np.array(x, "<u4").tobytes() for x in merges.encode([w.encode() for w in new])), strict=True))
        return [b"".join(map(table.__getitem__, text)) for text in words]

    def batches(texts: pd.Series) -> Iterator[list[bytes]]:
        words, chars = [], 0
        for text in texts:
            words.append(find(text or ""))
            chars += len(text or "")
            if chars > HELD_CHARS:
                yield some(words)
                words, chars = [], 0
        if words:
            yield some(words)

    return batches


def decode(ids: bytes, bytes_of: list[bytes | None]) -> bytes:
    """The bytes of packed ids."""
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, digests: Callable[[bytes, bytes], tuple] | None = None, schema: str = "ids binary, decoded binary") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits each) and decoded (the bytes of these ids) of each row of docs.

    `digests` turns ids and decoded bytes into other columns, named in `schema`, before they leave the task. Each match
    of the pattern is encoded on its own, as the token that it is, else by the merges in the order of their ranks; there
    are no special tokens. Null and empty texts have no tokens; rows stay as often as they come, whatever their ids; no
    rows give no rows. Other columns are not read.

    The texts are read twice and never shuffled: first the words of all texts are counted, then the frequent ones, whose
    merges were replayed before, are looked up, and all others are replayed where they occur. What travels to each
    task is bounded: the vocabulary and SHARED_WORDS words.
    """
    spark = docs.sparkSession
    light_batches(spark)
    table, shared = spark.sparkContext.broadcast(ranks), spark.sparkContext.broadcast(shared_words(docs, ranks, pattern))
    names = [part.split()[0] for part in schema.split(",")]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bytes_of = MergeReplay(table.value).bytes_of
        packed = encode_batches(table.value, shared.value, pattern)
        for batch in batches:
            at = 0
            for some in packed(batch["text"]):
                rows = [(ids, decode(ids, bytes_of)) for ids in some]
                rows = rows if digests is None else [digests(*row) for row in rows]
                columns = {name: pd.Series([row[i] for row in rows], dtype=object) for i, name in enumerate(names)}
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at : at + len(some)].to_numpy(dtype=object, na_value=None), "n_tokens": [len(ids) // 4 for ids in some], **columns})
                at += len(some)

    kind = docs.schema["doc_id"].dataType  # as text, since pandas makes floats of numbers with nulls
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(encode, f"doc_id string, n_tokens long, {schema}")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
