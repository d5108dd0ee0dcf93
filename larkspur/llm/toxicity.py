"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, light_batches
from larkspur.llm.hashing import mix

#: Lengths of the n-grams, in code points.
SIZES = (3, 4, 5, 6)
#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 20
#: Rows whose features the driver spells out at once.
BLOCK_ROWS = 2000
#: Labelled rows that a replica of the counting reads.
ROWS_PER_TASK = 2500

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass
class Model:
    """Bucket numbers, their weights (classifier weight times log-count ratio) and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def grams(data: bytes) -> np.ndarray:
    """Bucket of each n-gram of the lower-cased (A-Z) text, with other ASCII signs than letters and digits as blanks."""
    text = (b" " + data.lower().translate(_TO_SPACE) + b" ").decode(errors="replace")
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, total = [], np.zeros(len(raw), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(raw) < n:
            break
        total = total[: len(raw) - n + 1] * _BASE + raw[n - 1 :]
        if n in SIZES:
            out.append((mix(total, n) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each bucket in how many toxic and how many other texts it occurs."""
    seen = np.zeros((2, BUCKETS), np.int32)
    for rows in batches:
        for data, toxic in zip(rows["data"], rows["toxic"], strict=True):
            seen[int(toxic), np.unique(grams(bytes(data)))] += 1
    found = np.flatnonzero(seen.any(axis=0))
    for at in range(0, len(found), 100_000):
        part = found[at : at + 100_000]
        yield pd.DataFrame({"bucket": part, "toxic": seen[1, part], "other": seen[0, part]})


def _select(slots: np.ndarray, data: bytes) -> np.ndarray:
    found = slots[grams(data)]
    return np.unique(found[found >= 0])


def _solve(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, rounds: int, decay: float) -> tuple[np.ndarray, float]:
    """Logistic regression on features ratio[j] by accelerated gradient steps with weight decay. Rows are gone through in
    blocks, so that the driver holds the features of all rows in their short form only."""
    w, b = np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    mean, square = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    blocks = [(np.concatenate(rows[i : i + BLOCK_ROWS]), np.array([len(r) for r in rows[i : i + BLOCK_ROWS]]), y[i : i + BLOCK_ROWS]) for i in range(0, len(rows), BLOCK_ROWS)]
    for t in range(1, rounds + 1):
        grad = np.append(decay * w, 0.0)
        weight = ratio * w
        for short, sizes, goal in blocks:
            feature, row = short.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
            z = b + np.bincount(row, weight[feature], len(sizes))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal) / len(y)
            grad[:-1] += ratio * np.bincount(feature, error[row], len(ratio))
            grad[-1] += error.sum()
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        move = 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w * ratio, b


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, features: int = 4096, rounds: int = 200, decay: float = 1e-4) -> Model:
    """Learn from labelled texts: docs has doc_id and text, labels has doc_id and toxic (0 or 1; others are ignored).

    The classifier is fitted on a sample of about `fit_rows` labelled rows, taken by a hash of the id (of rows with one
    id the least text); that bounds what the driver gets. Log-count ratios compare in how many toxic and other texts of the sample a bucket occurs, plus one;
    the `features` buckets (65,536 at most) that tell the classes apart best are kept. Without rows of both classes the model is the
    share of toxic rows alone.
    """
    light_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    share = min(1.0, fit_rows / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known
    tasks = max(1, -(-min(total, fit_rows) // ROWS_PER_TASK))
    data = F.coalesce("text", F.lit("")).cast("binary").alias("data")
    one_each = docs.select("doc_id", data).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("data").alias("data"), F.first("toxic").alias("toxic"))
    sample = cut(one_each.repartition(tasks, F.xxhash64("doc_id")).select("data", "toxic"))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    prior = float(np.log((toxic + 1) / (other + 1)))
    if not toxic or not other:
        return Model(np.empty(0, np.int64), np.empty(0), prior)
    counted = sample.mapInPandas(_count, "bucket int, toxic int, other int").groupBy("bucket").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    p, q = (F.col("a") + 1) / (toxic + 2), (F.col("b") + 1) / (other + 2)
    telling = F.abs(p - q) / F.sqrt(p * (1 - p) / toxic + q * (1 - q) / other)
    top = counted.where(F.col("a") + F.col("b") >= min(5, (toxic + other) // 20 + 1)).select("bucket", F.log(p / q).alias("ratio"), telling.alias("telling")).orderBy(F.desc("telling"), "bucket").limit(features).toPandas()
    buckets, ratio = top["bucket"].to_numpy(np.int64), top["ratio"].to_numpy(float)
    slots = np.full(BUCKETS, -1, np.int32)
    slots[buckets] = np.arange(len(buckets))

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"toxic": rows["toxic"], "found": [_select(slots, bytes(d)).astype(np.uint16).tobytes() for d in rows["data"]]})

    rows = sample.mapInPandas(rows_of, "toxic int, found binary").toPandas()
    weights, bias = _solve([np.frombuffer(r, np.uint16) for r in rows["found"]], rows["toxic"].to_numpy(float), ratio, rounds, decay)
    return Model(buckets, weights, bias)


def _slots(model: Model) -> np.ndarray:
    slots = np.full(BUCKETS, -1, np.int32)
    slots[model.buckets] = np.arange(len(model.buckets))
    return slots


def _scores(model: Model, slots: np.ndarray, texts: Iterable[bytes]) -> np.ndarray:
    z = np.array([model.bias + model.weights[_select(slots, t)].sum() for t in texts], float)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) for each row of docs (doc_id, text). Null and empty texts get
    the score of a text without known n-grams. Other columns are not read."""
    light_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = _slots(model)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": _scores(model, slots, map(bytes, rows["data"]))})

    data = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return data.mapInPandas(run, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below `threshold`."""
    light_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _slots(model)
        for rows in batches:
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            yield rows.filter(pa.array(_scores(model, slots, [(t or "").encode() for t in texts]) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
