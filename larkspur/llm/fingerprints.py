"""Document fingerprints by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hashes are taken modulo this prime (below 2**38); a selected hash and its position share one long.
PRIME = 274_877_906_899
BASE = 4_099
#: Positions take the low 25 bits, counted from the end, so that the rightmost of equal hashes is the least value.
PLACES = 1 << 25

_TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]+|[^\p{L}\p{M}\p{N}\s]"


def tokens(text: Column) -> Column:
    """Words of letters and digits; letters of scripts without blanks and other signs each on their own."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def _shifted(a: Column, by: int, size: Column) -> Column:
    return F.slice(a, by + 1, F.greatest(size, F.lit(0)))


def gram_hashes(df: DataFrame, words: str, out: str, k: int) -> DataFrame:
    """Add `out`: the rolling (polynomial) hash of each run of k tokens; a shorter, not empty text is one run.

    Adding a token multiplies by the base and adds the token's hash, so that hash i of k tokens follows from hash i of
    k - 1 tokens and token i + k - 1: one pass over the array for each token of a run.
    """
    first = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    df = df.withColumn("__t", first).withColumn("__n", F.size("__t")).withColumn("__h", F.col("__t"))
    for j in range(1, k):
        head = F.slice("__h", 1, F.greatest(F.col("__n") - j, F.lit(0)))
        df = df.withColumn("__h", F.when(F.col("__n") > j, F.zip_with(head, _shifted(F.col("__t"), j, F.col("__n") - j), lambda h, t: (h * BASE + t) % PRIME)).otherwise(F.slice("__h", 1, 1) if j > 1 else F.col("__h")))
    whole = F.aggregate("__t", F.lit(0).cast("long"), lambda h, t: (h * BASE + t) % PRIME)
    short = (F.col("__n") > 0) & (F.col("__n") < k)
    return df.withColumn(out, F.when(short, F.array(whole)).otherwise(F.col("__h"))).drop("__t", "__n", "__h")


def winnow(df: DataFrame, hashes: str, out: str, window: int) -> DataFrame:
    """Add `out`: the hashes selected from each window, the least and of equals the rightmost, with their positions, as
    longs in text order. The minimum over a window is built from minima over runs of 1, 2, 4, ... hashes."""
    packed = F.transform(hashes, lambda h, i: h * PLACES + (PLACES - 1 - F.pmod(i, F.lit(PLACES))))
    df = df.withColumn("__m", packed)
    done = 1
    while done < window:
        by = min(done, window - done)
        rest = F.size("__m") - by
        df = df.withColumn("__m", F.when(rest > 0, F.zip_with(F.slice("__m", 1, F.greatest(rest, F.lit(0))), _shifted(F.col("__m"), by, rest), lambda a, b: F.least(a, b))).otherwise(F.when(F.size("__m") > 0, F.array(F.array_min("__m"))).otherwise(F.col("__m"))))
        done += by
    return df.withColumn(out, F.array_distinct("__m")).drop("__m")


def fingerprint(df: DataFrame, text: str, out: str, k: int = 3, window: int = 5) -> DataFrame:
    """Add `out` (array of longs: hash times 2**25 plus position from the end) for the column `text`.

    Texts that share a run of k + window - 1 tokens share a selected hash. Null, empty and blank texts have an empty
    fingerprint; a text with fewer than k tokens has one hash, one with fewer hashes than a window has one selected.
    """
    df = gram_hashes(df.withColumn("__w", tokens(F.col(text))), "__w", "__g", k)
    return winnow(df, "__g", out, window).drop("__w", "__g")


def selected_hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 25)))


def as_text(fp: Column) -> Column:
    """`hash:position` in hexadecimal and decimal, by position."""
    return F.array_join(F.transform(fp, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 25))), F.lit(":"), (F.lit(PLACES - 1) - x % PLACES).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of the selected hashes of either text that both have; 1 for two empty fingerprints."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(docs: DataFrame, rows: int = 500, most: int = 1 << 16) -> DataFrame:
    """Put documents into parts of about `rows` neighbours by doc_id, each part with the first rows of the next one as
    guests (column guest), so that a window over a part sees each document's next one. After the last part comes the
    first. A null id stands before all others. Part bounds are approximate quantiles; beyond `most` parts, parts
    get more rows, which Spark sorts and spills like any window."""
    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300))
    numbered = docs.withColumn("__x", number)
    n = docs.count()
    parts = max(1, min(most, n // rows))
    splits = sorted(set(numbered.approxQuantile("__x", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    edges = [-float("inf"), *splits, float("inf")]
    if splits:
        placed = Bucketizer(splits=edges, inputCol="__x", outputCol="__part", handleInvalid="keep").transform(numbered)
    else:
        placed = numbered.withColumn("__part", F.lit(0))
    placed = placed.withColumn("__part", F.col("__part").cast("int"))
    firsts = {r["__part"]: r["x"] for r in placed.groupBy("__part").agg(F.min("__x").alias("x")).collect()}
    used = sorted(firsts)
    host = {p: used[i - 1] for i, p in enumerate(used)}
    pairs = [x for p in used for x in (F.lit(p), F.struct(F.lit(firsts[p]).alias("x"), F.lit(host[p]).alias("host")))]
    if not pairs:
        return placed.withColumn("guest", F.lit(0)).drop("__x")
    table = F.create_map(*pairs) if len(used) <= 64 else None
    if table is not None:
        entry = table[F.col("__part")]
    else:
        spark = docs.sparkSession
        rows_ = spark.createDataFrame([(p, firsts[p], host[p]) for p in used], "__p int, __first double, __host int")
        placed = placed.join(F.broadcast(rows_), F.col("__part") == F.col("__p")).drop("__p")
        entry = F.struct(F.col("__first").alias("x"), F.col("__host").alias("host"))
    here = F.struct(F.col("__part").alias("part"), F.lit(0).alias("guest"))
    there = F.struct(entry["host"].alias("part"), F.lit(1).alias("guest"))
    seats = F.when(F.col("__x") == entry["x"], F.array(here, there)).otherwise(F.array(here))
    return placed.withColumn("__seat", F.explode(seats)).withColumn("__part", F.col("__seat.part")).withColumn("guest", F.col("__seat.guest")).drop("__x", "__seat", "__first", "__host")


def fingerprint_edits(docs: DataFrame, k: int = 3, window: int = 5) -> DataFrame:
    """Fingerprints of documents and of edited copies of them.

    docs has doc_id and text. The edited text has the last quarter (rounded down) of the text's code points replaced by
    as many first ones of the next document's text, or all if it is shorter; next is by doc_id, after the last comes the
    first. Returns a row for each row of docs: doc_id, n_chars, edited, fp, edited_fp, next_fp. Null texts are empty;
    rows with one id follow each other by a hash of their text; a null id comes first; a single row is its own next.
    Other columns are not read.
    """
    seated = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("__part").orderBy("guest", "doc_id", F.xxhash64("text"), "text")
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    near = seated.withColumn("__next", F.coalesce(F.lead("text").over(order), F.lit("")))
    edited = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - tail), F.substring("__next", F.lit(1), tail))).withColumn("n_chars", n.cast("long")).drop("__next")
    both = fingerprint(fingerprint(edited, "text", "fp", k, window), "edited", "edited_fp", k, window)
    following = both.withColumn("next_fp", F.coalesce(F.lead("fp").over(order), F.array().cast("array<bigint>")))
    return following.where("guest = 0").select("doc_id", "n_chars", "edited", "fp", "edited_fp", "next_fp")
