"""Personal data: patterns, and terms that the corpus shows to reveal protected entities. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.spans import placed
from larkspur.llm.common import cut, few

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "term")

#: Fixed patterns. Possessive runs and conditions on what stands before a match keep the time for long runs of letters
#: or digits in proportion to their length; they find the same matches as the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"

_TERM = r"[\p{L}\p{N}_]{3,}"
SPAN = "struct<start:int,rank:int,end:int>"
_NONE = f"array<{SPAN}>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    digits = F.transform(F.split(F.reverse(_digits(match)), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


_CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(_IP_PARTS),
    "card": lambda m: F.length(_digits(m)).between(14, 19) & luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}
_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Texts without this cannot match.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def base_matches(text: Column, kind: str) -> Column:
    """Leftmost matches of a kind that pass its check; failing ones are dropped without another try."""
    found = F.filter(placed(text, F.lit(_PATTERNS[kind])), lambda m: _CHECKS[kind](m["match"]))
    if kind in _NEEDS:
        return F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))
    return found


def _spans(matches: Column, rank: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind, as array of struct (start, rank of the kind, end)."""
    return F.array_sort(F.concat(*(_spans(base_matches(text, k), i) for i, k in enumerate(KINDS[:4]))))


def revealing_terms(docs: DataFrame, support: int = 3, disclosure: float = 0.5, information: float = 3.0) -> DataFrame:
    """Terms that give protected entities away: term, share (of the term's lines that hold the entity), bits.

    An entity is a base match, lower-cased; it and a term (three or more letters, digits or underscores, lower-cased)
    co-occur in a line. Lines count once however often they repeat, so that copies of a text reveal nothing. A term is
    returned if it stands with an entity in `support` lines or more, if at least the share `disclosure` of its lines
    hold that entity, and if the pointwise mutual information of both is at least `information` bits.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    some = F.lit(False)
    for sign in ("@", "+"):
        some = some | F.contains("text", F.lit(sign))
    some = some | F.col("text").rlike(IP) | F.col("text").rlike(CARD)
    lines = texts.where(some).select(F.explode(F.split("text", "\n")).alias("text"))
    entities = F.array_distinct(F.flatten(F.array(*(F.transform(base_matches(F.col("text"), k), lambda m: F.lower(m["match"])) for k in KINDS[:4]))))
    held = lines.withColumn("entities", entities).where(F.size("entities") > 0).select(F.xxhash64("text").alias("line"), "text", "entities").groupBy("line").agg(F.min("text").alias("text"), F.min("entities").alias("entities"))
    held = cut(held)
    entity = held.select("line", F.explode("entities").alias("entity"))
    often = entity.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    terms = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(_TERM), F.lit(0)))
    in_lines = held.select("line", F.explode(terms(F.col("text"))).alias("term"))
    n_held = in_lines.groupBy("term").agg(F.count("*").alias("n_held")).where(F.col("n_held") >= support)
    # A pair's lines are among the entity's, and the share asks for enough of the term's: frequent terms meet only
    # entities that are frequent too.
    fits = (F.col("e.line") == F.col("t.line")) & (F.col("e.n_entity") >= F.col("t.n_held") * disclosure)
    pairs = entity.join(often, "entity").alias("e").join(in_lines.join(n_held, "term").alias("t"), fits).select("e.entity", "e.n_entity", "t.term")
    both = cut(pairs.groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support))
    both = both.where(~F.contains("entity", F.col("term")))
    wanted = cut(both.groupBy("term").agg(F.max("n_both").alias("most")))
    all_lines = texts.select(F.explode(F.split("text", "\n")).alias("text")).select(F.xxhash64("text").alias("line"), "text")
    holding = lambda lines, asked: lines.select("line", F.explode(terms(F.col("text"))).alias("term")).join(few(asked), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    # A term's lines of one part are no more than all its lines: if they are too many for the share, it is out.
    part = holding(all_lines.where(F.pmod("line", F.lit(64)) == 0), wanted.select("term")).withColumnRenamed("n_term", "n_part")
    possible = cut(wanted.join(part, "term", "left").where(F.coalesce("n_part", F.lit(0)) * disclosure <= F.col("most")).select("term"))
    counted = holding(all_lines, possible)
    total = all_lines.select("line").distinct().count() if not possible.isEmpty() else 1
    share = F.col("n_both") / F.col("n_term")
    bits = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    known = both.join(counted, "term").select("term", share.alias("share"), bits.alias("bits"))
    return known.where((F.col("share") >= disclosure) & (F.col("bits") >= information)).groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits"))


def find_personal_data(docs: DataFrame, support: int = 3, disclosure: float = 0.5, information: float = 3.0) -> DataFrame:
    """Spans of personal data in each text, and of terms that reveal it.

    docs has doc_id and text. Returns a row for each row of docs: doc_id, text, base (spans of the patterns), spans
    (those and spans of revealing terms that don't overlap them, kind `term`); a span is a struct of start, rank of its
    kind in KINDS and end (code points, end exclusive). Null texts are empty; repeated rows get equal results; a corpus
    without revealing terms adds none. Other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    terms = cut(revealing_terms(docs, support, disclosure, information))
    with_base = docs.withColumn("base", base_spans(F.col("text")))
    if terms.isEmpty():
        return with_base.select("doc_id", "text", "base", F.col("base").alias("spans"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))
    hit = docs.select("doc_id", "mark", F.explode(words).alias("term")).join(few(terms.select("term")), "term")
    held = hit.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("term")).alias("terms")).select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "terms")
    joined = with_base.join(held, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    whole = lambda term: F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), term, F.lit(r"(?![\p{L}\p{N}_])"))
    more = F.array_distinct(F.flatten(F.transform("terms", lambda t: _spans(placed(F.col("text"), whole(t)), KINDS.index("term")))))
    joined = joined.withColumn("more", more)
    free = F.filter(F.coalesce("more", F.array().cast(_NONE)), lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return joined.select("doc_id", "text", "base", F.array_sort(F.concat("base", free)).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with patterns generalised to their kind and revealing terms removed; of overlapping spans the first wins."""
    labels = F.array(*(F.lit(f"[{k.upper()}]" if k != "term" else "") for k in KINDS))
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(labels, s["rank"] + 1)).alias("out"))
        ),
    )
    return F.concat(walk["out"], F.substring(text, walk["at"] + 1, F.length(text)))
