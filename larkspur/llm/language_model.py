"""Language-model scoring of whole documents: corpus counts by Spark, a recurrent model trained on replicas."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import gru
from larkspur.llm.common import cut, light_batches

#: Token that ends a document; no word is empty.
END = b""
#: Tokens whose counts every task holds; the counts of all others are joined.
KNOWN_TOKENS = 65_536
#: Tokens of documents that are scored together; long documents then run beside many others.
SCORED_TOKENS = 3_000_000
#: Distinct tokens that a task gathers before it passes their counts on.
GATHERED_TOKENS = 300_000
#: Bytes of text that a replica learns from, about.
REPLICA_BYTES = 32_000_000


def _tokens(data: bytes) -> list[bytes]:
    return data.lower().split()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter = Counter()
    for rows in batches:
        for data in rows["data"]:
            held.update(_tokens(bytes(data)))
        held[END] += len(rows)
        if len(held) > GATHERED_TOKENS:
            yield pd.DataFrame({"token": list(held), "n": list(held.values())})
            held = Counter()
    yield pd.DataFrame({"token": list(held), "n": list(held.values())})


class _Numbers:
    """Numbers and counts of the tokens that tasks hold: the end, then by falling count. The model knows the first ones
    and one entry for all others."""

    def __init__(self, top: list[tuple[bytes, int]], words: int) -> None:
        counts = dict(top)
        held = [(END, counts.pop(END, 0)), *counts.items()]
        self.number = {t: i for i, (t, _) in enumerate(held)}
        self.log_count = np.log10(np.array([c for _, c in held], np.float64) + 1)
        self.other = min(words - 1, len(held))
        self.counts = np.array([*(c for _, c in held[: self.other]), 0], np.float64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, -1 for those that tasks don't hold."""
        get = self.number.get
        return np.array([get(w, -1) for w in words], np.int32)

    def known(self, numbers: np.ndarray) -> np.ndarray:
        """Numbers of the model's entries."""
        return np.where((numbers < 0) | (numbers > self.other), np.int32(self.other), numbers)


def _frequent(counts: DataFrame) -> tuple[list[tuple[bytes, int]], int]:
    """The tokens of the highest counts, at most KNOWN_TOKENS and all of the same count or none, and the end; also the
    count from which tokens are among them."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n"))
    upto = by_count.limit(KNOWN_TOKENS).collect()
    least, held = 1 << 62, 0
    for r in upto:
        held += r["tokens"]
        if held > KNOWN_TOKENS:
            break
        least = r["n"]
    chosen = counts.where((F.col("n") >= F.lit(least)) | (F.length("token") == 0))
    return sorted(((bytes(r["token"]), r["n"]) for r in chosen.collect()), key=lambda t: (-t[1], t[0])), least


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([v.size for v in like.values()])[:-1]
    return {k: x.reshape(v.shape).astype(gru.F32) for (k, v), x in zip(like.items(), np.split(flat, ends), strict=True)}


def _trainer(p: dict[str, np.ndarray], shape: gru.Shape, numbers: _Numbers):
    """A replica's weights in pieces, with the number of its tokens, from the replica's documents."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        weights, total = gru.train(p, shape, [numbers.known(numbers.of(_tokens(bytes(data)))) for data in rows["data"]])
        flat = _flat(weights).astype(np.float64)
        pieces = np.array_split(flat, max(1, len(flat) // 4096))
        return pd.DataFrame({"piece": range(len(pieces)), "tokens": total, "weights": list(pieces)})

    return run


def _deal(docs: DataFrame, replicas: int) -> DataFrame:
    """Number the replica of each row. Equal rows go to different replicas too, as a number of the row is hashed along."""
    return docs.select("data", F.pmod(F.xxhash64("data", F.monotonically_increasing_id()), F.lit(replicas)).alias("replica"))


def fit(docs: DataFrame, numbers: _Numbers, hidden: int, classes: int, one_in: int, rounds: int, replica_docs: int) -> tuple[dict[str, np.ndarray], gru.Shape]:
    """Train on one in `one_in` of docs (by a hash of text and id, so the share grows with the input), in rounds on
    different documents. In each round replicas train from the same weights and their mean, weighted by tokens, goes on;
    a replica learns from about `replica_docs` documents, fewer if they are long, and copies of a text are dealt like
    other documents."""
    shape = gru.Shape(len(numbers.counts), hidden, gru.class_edges(numbers.counts, classes))
    p = gru.initial(shape, numbers.counts)
    chosen = docs.withColumn("turn", F.pmod(F.xxhash64("data", "doc_id", F.lit("train")), F.lit(one_in * rounds)).cast("int")).where(F.col("turn") < rounds)
    counted = chosen.groupBy("turn").agg(F.count("*").alias("rows"), F.sum(F.octet_length("data")).alias("bytes")).collect()
    sizes = {r["turn"]: max(-(-r["rows"] // replica_docs), -(-r["bytes"] // REPLICA_BYTES)) for r in counted}
    for turn in range(rounds):
        if not sizes.get(turn):
            continue
        # Four times as many parts as replicas, so that few tasks get more than one.
        dealt = _deal(chosen.where(F.col("turn") == turn), sizes[turn]).repartition(4 * sizes[turn], "replica")
        pieces = dealt.groupBy("replica").applyInPandas(_trainer(p, shape, numbers), "piece int, tokens long, weights array<double>")
        each = pieces.select("piece", "tokens", F.posexplode("weights").alias("at", "w")).groupBy("piece", "at").agg((F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("w"))
        mean = each.toPandas().sort_values(["piece", "at"])
        p = _unflat(mean["w"].to_numpy(), p)
    return p, shape


def _scorer(p: dict[str, np.ndarray], shape: gru.Shape, numbers: _Numbers):
    """Model and count sums over the tokens that tasks know, and the tokens that they don't."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, out, tokens = [], [], 0
        end_log, end_seen = numbers.log_count[0], int(numbers.counts[0] > 0)

        def scored() -> pd.DataFrame:
            names = ["doc_id", "held_out", "n_tokens", "n_seen", "seen_log", "n_other", "other_log", "rest"]
            return pd.DataFrame(out, columns=names).assign(model_log=gru.score(p, shape, docs) / np.log(10))[[*names[:2], "model_log", *names[2:]]]

        for rows in batches:
            for doc_id, held_out, data in zip(rows["doc_id"], rows["held_out"], rows["data"], strict=True):
                words = _tokens(bytes(data))
                found = numbers.of(words)
                docs.append(numbers.known(found))
                unheld = np.flatnonzero(found < 0)
                others = numbers.log_count[found[found >= numbers.other]]
                known = numbers.log_count[found[found >= 0]].sum() + end_log
                out.append((doc_id, held_out, len(words) + 1, len(words) - len(unheld) + end_seen, known, len(unheld) + len(others), others.sum(), [words[i] for i in unheld]))
                tokens += len(words) + 1
            if tokens > SCORED_TOKENS:
                yield scored()
                docs, out, tokens = [], [], 0
        yield scored()

    return run


def score_documents(docs: DataFrame, words: int = 1536, hidden: int = 16, classes: int = 40, one_in: int = 1, rounds: int = 2, replica_docs: int = 16_000) -> DataFrame:
    """Log10 probabilities of whole documents under a gated recurrent model and under smoothed counts.

    docs has doc_id, text and held_out (boolean; null counts as false); the model learns from rows that aren't held out.
    Tokens are lower-cased (A-Z) words between ASCII blanks and one end for each document. Counts cover all training
    documents, and the recurrent weights are trained on all of them unless `one_in` asks for a share, which grows with
    the input. The model's vocabulary are the `words` - 2 most frequent words,
    the end and one entry for all others, under which a word has the probability (c + 1) / (sum of counts + number of
    such words + 1).

    Returns a row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null and
    empty texts are one end; without training documents all counts are 0. Repeated rows get equal scores. Other columns
    are not read.
    """
    light_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    learned = docs.where("not held_out").select("doc_id", "data")
    counts = cut(learned.select("data").mapInPandas(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 0"))
    all_tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top, least = _frequent(counts)
    numbers = _Numbers(top, words)
    inside = numbers.counts.sum()
    other_tokens, other_words = int(all_tokens - inside), int(distinct - (numbers.counts > 0).sum())
    numbers.counts[-1] = other_tokens
    p, shape = fit(learned, numbers, hidden, classes, one_in, rounds, replica_docs)
    schema = f"doc_id {kind}, held_out boolean, model_log double, n_tokens long, n_seen long, seen_log double, n_other long, other_log double, rest array<binary>"
    part = cut(docs.mapInPandas(_scorer(p, shape, numbers), schema).withColumn("row", F.monotonically_increasing_id()))
    rare = counts.where((F.col("n") < least) & (F.length("token") > 0))
    asked = part.where(F.size("rest") > 0).select("row", F.explode("rest").alias("token"))
    rest = asked.join(rare, "token").groupBy("row").agg(F.count("*").alias("n_rest"), F.sum(F.log10(F.col("n") + 1)).alias("rest_log"))
    rest_n, rest_log = F.coalesce("n_rest", F.lit(0)), F.coalesce("rest_log", F.lit(0.0))
    base = F.col("seen_log") + rest_log - F.col("n_tokens") * F.lit(float(np.log10(all_tokens + distinct + 1)))
    score = F.col("model_log") + F.col("other_log") + rest_log - F.col("n_other") * F.lit(float(np.log10(other_tokens + other_words + 1)))
    return part.drop("rest").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_seen") + rest_n).alias("n_known"), F.lit(int(all_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score")
    )
