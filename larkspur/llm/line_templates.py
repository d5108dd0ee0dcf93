"""Line dedup by a tree of line templates, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, few

ANY = "<*>"


def plain_lines(text: Column) -> Column:
    """The lines of a text, trimmed and with one blank between words."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    return F.transform(trimmed, lambda x: F.when(x.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")).otherwise(x))


def _lines(docs: DataFrame, depth: int, alike: float) -> DataFrame:
    """One row for each line with words: mask (each word with a digit written as a variable field), and leaf (token count
    and leading tokens). A line of which less than `alike` is fixed has itself as mask, and a leaf of its own."""
    each = docs.select("doc_id", "mark", F.posexplode(plain_lines(F.col("text"))).alias("at", "plain")).where("plain <> ''")
    masked = F.when(F.col("plain").rlike("[0-9]"), F.regexp_replace("plain", "(?<!\\S)\\S*[0-9]\\S*", ANY)).otherwise(F.col("plain"))
    each = each.withColumn("masked", masked)
    words = F.split("masked", " ")
    fixed = F.size(F.filter(words, lambda w: w != ANY))
    loose = F.when(F.col("masked").contains(ANY), fixed < F.size(words) * alike).otherwise(F.lit(False))
    rows = each.where(~F.col("masked").contains(ANY) | (fixed > 0)).withColumn("loose", loose)
    mask = F.when(F.col("loose"), F.col("plain")).otherwise(F.col("masked"))
    leaf = F.when(F.col("loose"), F.xxhash64("plain", F.lit("own"))).otherwise(F.xxhash64(F.size(words), F.array_join(F.slice(words, 1, depth), " ")))
    return rows.select("doc_id", "mark", "at", mask.alias("mask"), F.size(words).alias("n"), leaf.alias("leaf"))


def dedup_lines(docs: DataFrame, least: int = 10, depth: int = 3, alike: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines whose template recurs across documents.

    docs has doc_id and text. Lines end at newlines; words with digits are variable fields; lines meet in leaves of a
    tree of fixed depth: token count, then the first `depth` tokens. In a leaf, a token that fewer than `least` places
    have at its position is a variable field too; lines with equal remaining tokens share a template if at least `alike`
    of the tokens remain, otherwise a line is a template of its own. A template recurs if it stands at `least` places or
    more; a place of a line is a distinct text that holds it, so that mere copies of one document don't make its lines
    recur.
    Lines of which less than `alike` is fixed are no templates, but recur as they stand, digits included. Blank lines and
    lines of which each word holds a digit (rows of numbers) are never dropped, nor is a document emptied: one whose
    lines would all go stays as it is.

    Returns a row for each row of docs: doc_id, n_lines, n_dropped, text (the kept lines), and
    the columns of docs named in `carry`. Null texts are empty and have one blank line; repeated rows get equal results.
    Other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("one"), *carry).alias("carried")).withColumn("mark", F.xxhash64("text"))
    found = _lines(docs, depth, alike)
    narrow = cut(found.select("doc_id", "mark", "at", F.xxhash64("mask").alias("line"), "leaf", "n", "mask"))
    spread = cut(narrow.groupBy("line", "leaf", "n", "mark").agg(F.lit(1).alias("one")).groupBy("line", "leaf", "n").agg(F.count("*").alias("places")))
    leaves = spread.groupBy("leaf").agg(F.sum("places").alias("total"), F.count("*").alias("masks")).where((F.col("total") >= least) & (F.col("masks") > 1)).select("leaf")
    wanted = cut(spread.join(leaves, "leaf", "left_semi"))
    spelled = narrow.select("line", "mask").join(few(wanted.select("line")), "line", "left_semi").groupBy("line", "mask").agg(F.lit(1).alias("one"))
    tokens = cut(spelled.join(wanted, "line").select("line", "leaf", "n", "places", F.posexplode(F.split("mask", " ")).alias("pos", "token")))
    constant = tokens.where(F.col("token") != ANY).groupBy("leaf", "pos", "token").agg(F.sum("places").alias("seen")).where(F.col("seen") >= least).select("leaf", "pos", "token")
    rest = tokens.join(constant, ["leaf", "pos", "token"]).groupBy("line", "leaf", "n", "places").agg(F.count("*").alias("same"), F.sum(F.xxhash64("pos", "token").cast("decimal(38,0)")).alias("kept"))
    shared = rest.where(F.col("same") >= F.col("n") * alike).select("line", F.xxhash64("leaf", F.col("kept").cast("string"), "same").alias("template"))
    named = spread.join(shared, "line", "left").select("line", "places", F.coalesce("template", F.xxhash64("line", F.lit("own"))).alias("template"))
    often = named.groupBy("template").agg(F.sum("places").alias("total")).where(F.col("total") >= least).select("template")
    dropped = cut(named.join(often, "template", "left_semi").select("line"))
    gone = narrow.join(few(dropped), "line", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "gone")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    split = joined.select("doc_id", "text", "carried", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), F.split("text", "\n").alias("lines"))
    kept = F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    kept = split.select("doc_id", "text", "carried", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    empty = ~F.exists("kept", lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    stays = F.col("n_lines") == F.size("kept")
    return kept.select(
        "doc_id", "n_lines", F.when(empty, F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.when(stays | empty, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"), *(F.col(f"carried.{c}").alias(c) for c in carry)
    )
