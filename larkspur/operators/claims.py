"""Claims of sources: partners named in texts, and one row of evidence for each field that a source speaks of."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.signals import certainty, negated

#: Names and phrases of collaborations: fixed values.
NAME = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9'&]+(?:[^\S\n]+[A-Za-zÀ-ÖØ-öø-ÿ0-9'&]+){0,3}"
PAIR = rf"({NAME})(?:\s*×\s*|\s+[xX]\s+)({NAME})"
LAUNCHED = rf"({NAME})\s+and\s+({NAME})\s+(?:launched|announced|revealed|unveiled)\b.{{0,60}}?collaboration"
PARTNER = ("(?:in\\s+)?collaboration with\\s+", "teams? up with\\s+", "partner(?:ed|ship)? with\\s+", "crossover with\\s+", "special campaign with\\s+")
ARTICLES = ("the", "a", "an", "this", "that")
NAME_ENDS = (
    "for", "during", "at", "starting", "beginning", "from", "to", "with", "featuring", "on", "of", "and", "campaign", "collection", "event", "launch", "collaboration",
    "promotional", "promo", "pack", "packs", "exclusive", "official", "release", "edition", "complete", "set", "sets",
)

_CANDIDATE = "struct<left:string,right:string,start:int,end:int,match:string>"


def name_of(span: str) -> str:
    """A name without leading articles, up to the first word that no name holds."""
    words = span.split()
    begin = next((i for i, w in enumerate(words) if w.lower() not in ARTICLES), len(words))
    stop = next((i for i, w in enumerate(words[begin:], begin) if w.lower() in NAME_ENDS), len(words))
    return " ".join(words[begin:stop])


def proper(name: str) -> bool:
    letters = [c for c in name if c.isalpha()]
    return bool(letters) and letters[0].isupper()


def named_partners(text: str) -> list[dict]:
    """Candidates in order of preference: two names that launch something, pairs of names (from any letter on), then one
    partner for each phrase."""
    found = []
    launched = re.search(LAUNCHED, text, re.IGNORECASE)
    # a lookahead consumes nothing, so that a pair may begin inside another one that holds no names
    pairs = ((m.group(1), m.group(2), m.start(), m.end(2)) for m in re.finditer(f"(?={PAIR})", text))
    first = [(launched.group(1), launched.group(2), launched.start(), launched.end())] if launched else []
    for left, right, start, end in (*first, *pairs):
        names = name_of(left), name_of(right)
        if all(proper(n) for n in names):
            found.append({"left": names[0], "right": names[1], "start": start, "end": end, "match": text[start:end]})
    for phrase in PARTNER:
        m = re.search(f"{phrase}({NAME})", text, re.IGNORECASE)
        if m and name_of(m.group(1)):
            found.append({"left": None, "right": name_of(m.group(1)), "start": m.start(), "end": m.end(), "match": m.group(0)})
    return found


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(found=[named_partners(t) for t in b["text"]])


def detect_collabs(docs: DataFrame) -> DataFrame:
    """(seq, left, right, start, end, match, certainty): the first candidate of each text that isn't negated. Only texts
    that hold a sign or word of collaborations reach Python; null texts have none. docs has seq and text."""
    some = F.col("text").rlike(r"(?i)×|\s[x]\s|collaboration|teams? up with|partner(?:ed|ship)? with|crossover with|special campaign with")
    kind = dict(docs.select("seq").dtypes)["seq"]
    rows = docs.where(some).select("seq", "text").mapInPandas(_candidates, f"seq {kind}, text string, found array<{_CANDIDATE}>")
    first = F.try_element_at(F.filter("found", lambda c: ~negated(F.col("text"), c["start"])), F.lit(1))
    return rows.withColumn("c", first).where("c is not null").select("seq", "c.*", certainty(F.col("text"), F.col("c.start")).alias("certainty"))


#: Words of units, grading, asking prices and phases, first fit wins; denials of fields: fixed values.
UNIT_SCOPES = {
    "complete_set": ("complete set", "complete promo set", "full set", "entire set", "whole set"),
    "case": ("per case", "a case of", "sealed case"),
    "box": ("booster box", "per box", "a box of", "display box"),
    "lot": ("lot of", "as a lot", "card lot"),
    "bundle": ("bundle",),
    "pack": ("per pack", "a pack", "single pack", "promotional pack", "promo pack"),
    "single_item": ("single card", "individual card", "per card", "one card", "single item", "per unit", "individual item"),
}
GRADING = {"ungraded": ("ungraded", "raw copy", "raw card", "non-graded"), "graded": ("psa", "bgs", "cgc", "graded")}
ASKING = ("asking", "listed at", "listed for", "available for", "selling for", "up for", "asking price")
DATE_PHASES = {
    "announcement": ("announce", "reveal", "unveil"),
    "preorder": ("preorder", "pre-order"),
    "restock": ("restock",),
    "campaign_end": ("ends", "through", "until", "last day"),
    "event_start": ("event begins", "event starts", "doors open"),
}
DENIALS = {
    "limited_quantity": (r"\bnot\s+(?:a\s+)?limited\b", r"\bunlimited\s+(?:stock|quantity|supply|units|availability)\b"),
    "exclusive_promo": (r"\bnot\s+(?:an?\s+)?exclusive\b",),
    "numbered": (r"\bnot\s+numbered\b",),
    "sealed_product": (r"\bnot\s+sealed\b",),
    "membership_required": (r"\bno\s+membership\s+required\b", r"\bwithout\s+(?:a\s+)?membership\b"),
    "lottery_required": (r"\bno\s+lottery\b",),
}
#: Fields that signals speak of: fixed values.
VALUE_FIELDS = {"LIMITED_QUANTITY": "stated_quantity", "PURCHASE_LIMIT": "purchase_limit"}
PRICE_FIELDS = {"SPEND_REQUIREMENT": "required_spend", "RETAIL_PRICE": "retail_price"}
STATUS_VALUES = {"STATUS_SOLD_OUT": "sold_out", "STATUS_RESTOCKED": "restocked", "STATUS_LIVE": "live", "LOW_STOCK": "low_stock"}
TRUE_FIELDS = {
    "EXCLUSIVE_PROMO": ("exclusive_promo",), "NUMBERED_RELEASE": ("numbered",), "FIRST_EDITION": ("first_edition",), "FIRST_COLLABORATION": ("first_collaboration",), "ANNIVERSARY": ("anniversary_release",),
    "EXCLUSIVE_ARTWORK": ("exclusive_artwork",), "EXCLUSIVE_CHARACTER": ("exclusive_character",), "EVENT_EXCLUSIVE": ("event_exclusive",), "CONVENTION_EXCLUSIVE": ("convention_exclusive",),
    "TOURNAMENT_EXCLUSIVE": ("tournament_exclusive",), "RETAILER_EXCLUSIVE": ("retailer_exclusive",), "REGION_EXCLUSIVE": ("region_exclusive",), "BUNDLE_REQUIRED": ("bundle_required",),
    "REDEEMABLE_REWARD": ("redeemable_reward",), "SEALED_PRODUCT": ("sealed_product",), "MEMBERSHIP_EXCLUSIVE": ("membership_exclusive", "membership_required"),
    "LOTTERY_REQUIRED": ("lottery_required", "lottery_required"), "EVENT_ATTENDANCE_REQUIRED": ("event_attendance_required", "event_attendance_required"),
}


def _first_fit(text: Column, table: dict[str, tuple[str, ...]], other: str | None) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    fits = [F.when(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w)), name) for name, words in table.items()]
    return F.coalesce(*fits, F.lit(other))


def unit_scope(text: Column) -> Column:
    """Which unit a price is for: complete_set, case, box, lot, bundle, pack, single_item or unknown."""
    return _first_fit(text, UNIT_SCOPES, "unknown")


def grading(text: Column) -> Column:
    """ungraded, graded or null."""
    return _first_fit(text, GRADING, None)


def price_kind(text: Column) -> Column:
    """sold (not 'sold out'), asking or unknown."""
    return F.when(F.lower(F.coalesce(text, F.lit(""))).rlike(r"\bsold\b(?!\s+out)"), "sold").otherwise(_first_fit(text, {"asking": ASKING}, "unknown"))


def date_phase(text: Column) -> Column:
    """announcement, preorder, restock, campaign_end, event_start or release."""
    return _first_fit(text, DATE_PHASES, "release")


def _claim(field: Column, value: Column, scope: Column | None = None, evidence: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(value.isNotNull(), F.struct(field.alias("field"), value.cast("string").alias("value"), (none if scope is None else scope).alias("unit_scope"), (F.col("match") if evidence is None else evidence).alias("evidence")))


def _of(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col("signal")]


def detection_claims(detections: DataFrame) -> DataFrame:
    """(seq, field, value, unit_scope, confidence, certainty, evidence) of detections with seq, signal, confidence, start,
    end, match, certainty, context (60 signs on both sides, lower-cased), value, value_end, unit and whole_set."""
    signal, value, around = F.col("signal"), F.col("value").cast("string"), F.col("context")
    scope = F.when(F.coalesce("whole_set", F.lit(False)), "complete_set").otherwise(unit_scope(around))
    kind = price_kind(around)
    market = F.when(kind == "sold", "recent_sold_price").when(kind == "asking", "estimated_market_price").otherwise("current_market_price")
    left = F.least(F.col("start"), F.lit(60))
    skipped = F.greatest(left - 35, F.lit(0))
    near = F.substring(around, skipped + 1, left - skipped + F.col("end") - F.col("start") + 35)
    text = F.lit
    none = F.array(_claim(text(""), F.lit(None).cast("string")))
    claims = (
        F.when(signal.isin(*PRICE_FIELDS), F.array(_claim(_of(PRICE_FIELDS), value, scope)))
        .when(signal == "OBSERVED_RESALE_PRICE", F.array(_claim(market, value, scope), _claim(F.concat(market, text("__grading")), grading(around), evidence=around), _claim(F.concat(market, text("__price_kind")), kind, evidence=around)))
        .when(signal.isin(*VALUE_FIELDS), F.array(_claim(_of(VALUE_FIELDS), value)))
        .when((signal == "PROMOTIONAL_PACK") & value.isNotNull(), F.array(_claim(text("pack_quantity_note"), F.concat(value, text(" "), F.coalesce("unit", text("packs"))))))
        .when(signal == "RELEASE_DATE", F.array(_claim(F.when(date_phase(near) == "announcement", "announcement_date").otherwise("release_date"), F.col("match"))))
        .when(signal == "RELEASE_TIME", F.array(_claim(text("release_time"), F.col("match"))))
        .when(signal == "PURCHASE_WINDOW", F.array(_claim(text("purchase_window_start"), value), _claim(text("purchase_window_end"), F.col("value_end").cast("string"))))
        .when(signal.isin(*STATUS_VALUES), F.array(_claim(text("status"), _of(STATUS_VALUES))))
    )
    for name, fields in TRUE_FIELDS.items():
        claims = claims.when(signal == name, F.array(*(_claim(text(f), text("true")) for f in fields)))
    rows = detections.select("seq", "confidence", "certainty", F.explode(F.array_compact(claims.otherwise(none))).alias("c"))
    return rows.select("seq", "c.field", "c.value", "c.unit_scope", F.col("confidence").cast("double").alias("confidence"), "certainty", "c.evidence")


def denials(docs: DataFrame) -> DataFrame:
    """Claims of fields that texts deny ("not numbered"): value false, confidence 85. docs has seq and text."""
    found = []
    for field, patterns in DENIALS.items():
        said = F.coalesce(*(F.nullif(F.regexp_extract("text", f"(?i){p}", 0), F.lit("")) for p in patterns))
        found.append(F.when(said.isNotNull(), F.struct(F.lit(field).alias("field"), said.alias("evidence"))))
    rows = docs.where("text is not null").select("seq", F.explode(F.array_compact(F.array(*found))).alias("c"))
    return rows.select("seq", "c.field", F.lit("false").alias("value"), F.lit(None).cast("string").alias("unit_scope"), F.lit(85.0).alias("confidence"), F.lit("confirmed").alias("certainty"), "c.evidence")


def draft_claims(drafts: DataFrame, collabs: DataFrame) -> DataFrame:
    """Claims of identity: product_name (by the title), brand, franchise and collaboration_partner (by the collaboration
    that was detected, else 60 and confirmed), and retailer. drafts has these, seq and title."""
    by = collabs.groupBy("seq").agg(F.min_by(F.struct("match", "certainty", "confidence"), "start").alias("c"))
    d = drafts.join(by, "seq", "left")
    plain = [F.lit(60.0).alias("confidence"), F.lit("confirmed").alias("certainty")]
    told = [F.coalesce(F.col("c.confidence").cast("double"), F.lit(60.0)).alias("confidence"), F.coalesce("c.certainty", F.lit("confirmed")).alias("certainty")]
    row = lambda f, how, evidence: F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(None).cast("string").alias("unit_scope"), *how, evidence.alias("evidence")))
    said = F.coalesce("c.match", F.lit(""))
    rows = [row("product_name", plain, F.coalesce("title", F.lit(""))), *(row(f, told, said) for f in ("brand", "franchise", "collaboration_partner")), row("retailer", plain, F.concat(F.lit("retailer field on source: "), F.col("retailer")))]
    return d.select("seq", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("seq", "c.*")


def build_evidence(docs: DataFrame, detections: DataFrame, drafts: DataFrame) -> DataFrame:
    """The ledger: one row for each claim that a source makes about a field."""
    collabs = detections.where("signal = 'COLLABORATION'")
    return draft_claims(drafts, collabs).unionByName(detection_claims(detections)).unionByName(denials(docs))
