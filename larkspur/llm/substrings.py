"""Substring dedup: matching statistics against suffix automata of the passages that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, light_batches
from larkspur.llm.hashing import gram_hashes, word_hashes

#: Words of an anchor: the gram with the least hash in a window, the same wherever the window stands.
ANCHOR_WORDS = 8
#: Different passages around one anchor up to which an automaton is built; more are compared by window digests.
SHARD_PASSAGES = 500
#: Window starts that share a core when windows are compared by digest.
STRETCH = 8


class Automaton:
    """Suffix automaton of several word sequences, grown one sequence at a time."""

    def __init__(self) -> None:
        self.step: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.longest = [0]

    def _state(self, step: dict[bytes, int], link: int, longest: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for the words of q that are no longer than p's by more than one."""
        copy = self._state(dict(self.step[q]), self.link[q], self.longest[p] + 1)
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            q = self.step[last].get(word)
            if q is not None:
                last = q if self.longest[q] == self.longest[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state({}, 0, self.longest[last] + 1), last
            while p >= 0 and word not in self.step[p]:
                self.step[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.step[p][word]
                self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, word, q)
            last = new

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word, how many words up to and with it stand somewhere in the sequences."""
        state, length, out = 0, 0, []
        step, link, longest = self.step, self.link, self.longest
        for word in words:
            while state and word not in step[state]:
                state = link[state]
                length = longest[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
            out.append(length)
        return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end (exclusive) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def owners(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a word sequence: hash, position, first window start and last window start that belong to each.

    A window of `length` words belongs to the first of its grams that have the least hash.
    """
    grams = gram_hashes(hashes, ANCHOR_WORDS)
    span = length - ANCHOR_WORDS + 1
    if len(grams) < span:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    at = np.concatenate([view[i : i + 4096].argmin(axis=1) + np.arange(i, min(i + 4096, len(view))) for i in range(0, len(view), 4096)])
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return grams[at[new]], at[new], new, np.concatenate((new[1:], [len(at)])) - 1


def _profile(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n, whole, anchors = [], [], []
            for data in rows["data"]:
                hashes = word_hashes(bytes(data))
                n.append(len(hashes))
                whole.append(hashlib.blake2b(b" ".join(bytes(data).split()), digest_size=16).digest())
                anchors.append(np.unique(owners(hashes, length)[0]).view(np.int64))
            yield pd.DataFrame({"doc_id": rows["doc_id"], "mark": rows["mark"], "n_words": n, "whole": whole, "anchors": anchors})

    return run


def _passages(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc_id, mark, data, shared in zip(rows["doc_id"], rows["mark"], rows["data"], rows["shared"], strict=True):
                data = bytes(data)
                anchor, at, first, last = owners(word_hashes(data), length)
                words = data.split()
                anchor = anchor.view(np.int64)
                places: dict[tuple, list[int]] = {}
                for i in np.flatnonzero(np.isin(anchor, shared)):
                    text = b" ".join(words[first[i] : last[i] + length])
                    places.setdefault((anchor[i], text, at[i] - first[i], last[i] - first[i] + 1), []).append(first[i])
                for (a, text, offset, n), firsts in places.items():
                    out.append((a, hashlib.blake2b(text, digest_size=16).digest(), text, offset, n, doc_id, mark, firsts))
            yield pd.DataFrame(out, columns=["anchor", "passage", "words", "offset", "n", "doc_id", "mark", "firsts"])

    return run


def _repeats(length: int):
    """Of passages sorted by anchor and document: which windows stand in a passage of a smaller document."""

    def group(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        shard, waiting, at = Automaton(), [], None
        for anchor, passage, text, low in rows:
            if low != at:
                for words in waiting:
                    shard.add(words)
                waiting, at = [], low
            words = text.split(b" ")
            found = np.array(shard.statistics(words))[length - 1 :] >= length if len(shard.link) > 1 else np.zeros(1, bool)
            if not (found.all() and len(found) > 1 or len(words) == length and found.all()):
                waiting.append(words)
            if found.any():
                yield anchor, passage, [a for a, _ in runs(found)], [b for _, b in runs(found)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for rows in batches:
            out = []
            for row in zip(rows["anchor"], rows["passage"], rows["words"], rows["low"], strict=True):
                if held and held[0][0] != row[0]:
                    out += group(held)
                    held = []
                held.append((row[0], bytes(row[1]), bytes(row[2]), row[3]))
            yield pd.DataFrame(out, columns=["anchor", "passage", "begins", "ends"])
        yield pd.DataFrame(list(group(held)), columns=["anchor", "passage", "begins", "ends"])

    return run


def _repeats_by_digest(passages: DataFrame, length: int) -> DataFrame:
    """What _repeats() finds, for anchors with any number of passages: windows are grouped by digest.

    Windows that start in one stretch of STRETCH words before the anchor have a core of words in common. Cores that stand
    in one document only are dropped first, and with them the windows, so that few windows are spelled out.
    """
    words = F.split(F.col("words").cast("string"), " ")
    digest = lambda begin, n: F.md5(F.array_join(F.slice("w", (begin + 1).cast("int"), n), " ").cast("binary"))
    each = passages.select("anchor", "passage", "low", "offset", "n", words.alias("w"))
    stretches = each.select("*", F.explode(F.sequence(F.floor((F.col("offset") - F.col("n") + 1) / STRETCH), F.floor(F.col("offset") / STRETCH))).alias("stretch"))
    cores = stretches.withColumn("core", digest(F.greatest(F.col("offset") - F.col("stretch") * STRETCH, F.lit(0)), length - STRETCH + 1))
    shared = cores.groupBy("anchor", "stretch", "core").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a < b").select("anchor", "stretch", "core")
    first = F.greatest(F.col("offset") - F.col("stretch") * STRETCH - (STRETCH - 1), F.lit(0))
    last = F.least(F.col("offset") - F.col("stretch") * STRETCH, F.col("n") - 1)
    windows = cores.join(shared, ["anchor", "stretch", "core"], "left_semi").select("anchor", "passage", "low", "w", F.explode(F.sequence(first, last)).alias("at")).select("anchor", "passage", "low", "at", digest(F.col("at"), length).alias("window"))
    lowest = windows.groupBy("window").agg(F.min("low").alias("least"))
    starts = windows.join(lowest, "window").where("least < low").groupBy("anchor", "passage").agg(F.collect_list("at").alias("begins"))
    return starts.select("anchor", "passage", "begins", F.transform("begins", lambda x: x + 1).alias("ends"))


def _keep(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n, spans, kept = [], [], []
            for data, whole, begins, ends in zip(rows["data"], rows["whole"], rows["begins"], rows["ends"], strict=True):
                words = bytes(data).split()
                if whole and len(words) >= length:
                    gone = [(0, len(words))]
                elif begins is None or not len(begins):
                    gone = []
                else:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, np.asarray(begins), 1)
                    np.add.at(change, np.asarray(ends) + length - 1, -1)
                    gone = runs(np.cumsum(change)[:-1] > 0)
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in gone])
                if gone:
                    rest, at = [], 0
                    for a, b in [*gone, (len(words), len(words))]:
                        rest += words[at:a]
                        at = b
                    words = rest
                kept.append(b" ".join(words).decode())
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_words": n, "spans": spans, "kept": kept})

    return run


def dedup_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove passages of at least `length` words that already stand in a document with a smaller doc_id.

    docs has doc_id (long) and text. Returns a row for each row of docs: doc_id, n_words, spans (array of start and end
    word positions that are removed, end exclusive), kept (the other words joined by one space). Windows are judged on
    the texts as given. Null, empty and short texts lose nothing; of rows with equal text only those with the smallest
    id keep it; rows with one id never remove each other's words; rows with a null id keep all and remove nothing.
    Other columns are not read.

    Automata of all documents would have to meet all documents. Instead, each window belongs to an anchor, its gram with
    the least hash, and passages meet only where they share an anchor: each anchor's passages, in the order of their
    documents, are a shard with an automaton of its own, through which each next passage is streamed before it is added.
    Anchors with more than SHARD_PASSAGES different passages go another exact way: their windows are grouped by digest.
    """
    light_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data")).withColumn("mark", F.xxhash64("data"))
    profile = cut(docs.mapInPandas(_profile(length), f"doc_id {kind}, mark long, n_words long, whole binary, anchors array<long>")).where(f"doc_id is not null and n_words >= {length}")
    firsts = profile.groupBy("whole").agg(F.min("doc_id").alias("low_id"))
    judged = profile.join(firsts, "whole").select("doc_id", "mark", "anchors", (F.col("doc_id") > F.col("low_id")).alias("copy"))
    judged = cut(judged)
    placed = judged.where("not copy").select("doc_id", "mark", F.explode("anchors").alias("anchor"))
    shared = placed.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    wanted = placed.join(shared, "anchor", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("shared"))
    passages = docs.join(wanted, ["doc_id", "mark"]).mapInPandas(_passages(length), f"anchor long, passage binary, words binary, offset long, n long, doc_id {kind}, mark long, firsts array<long>")
    passages = cut(passages)
    different = cut(passages.groupBy("anchor", "passage", "words", "offset", "n").agg(F.min("doc_id").alias("low")))
    many = different.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor", (F.col("m") > SHARD_PASSAGES).alias("hot"))
    dealt = different.join(many, "anchor")
    sorted_shards = dealt.where("not hot").select("anchor", "passage", "words", "low").repartition("anchor").sortWithinPartitions("anchor", "low")
    found = sorted_shards.mapInPandas(_repeats(length), "anchor long, passage binary, begins array<long>, ends array<long>")
    found = found.unionByName(_repeats_by_digest(dealt.where("hot").drop("hot"), length))
    low = different.select("anchor", "passage", "low").join(found, ["anchor", "passage"], "left")
    again = F.col("doc_id") > F.col("low")
    none = F.array().cast("array<long>")
    shifted = lambda name: F.flatten(F.transform("firsts", lambda f: F.transform(F.coalesce(name, none), lambda x: x + f)))
    parts = (
        passages.select("anchor", "passage", "doc_id", "mark", "firsts", "n")
        .join(low, ["anchor", "passage"])
        .select("doc_id", "mark", F.when(again, F.col("firsts")).otherwise(shifted("begins")).alias("begins"), F.when(again, F.transform("firsts", lambda f: f + F.col("n"))).otherwise(shifted("ends")).alias("ends"))
        .where(F.size("begins") > 0)
        .groupBy("doc_id", "mark")
        .agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"), F.lit(False).alias("whole"))
    )
    copies = judged.where("copy").select("doc_id", "mark").distinct().select("doc_id", "mark", none.alias("begins"), none.alias("ends"), F.lit(True).alias("whole"))
    joined = docs.join(parts.unionByName(copies), ["doc_id", "mark"], "left").select("doc_id", "data", F.coalesce("whole", F.lit(False)).alias("whole"), "begins", "ends")
    return joined.mapInPandas(_keep(length), f"doc_id {kind}, n_words long, spans array<struct<start:long,end:long>>, kept string")
