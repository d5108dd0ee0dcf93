"""Record shapes, confidences of merged records, and item signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scores as S


#: Shapes of records: fields that tell one, base and points (hundredths) for each signature field, and the most.
SHAPES = {
    "marketplace_listing": (60, 7, 95, ("marketplace", "listing_url", "price", "sold", "listing_type", "condition")),
    "retailer_product": (55, 8, 95, ("retailer", "retail_price", "sku", "purchase_limit", "availability", "required_spend")),
    "social_post": (65, 6, 92, ("account_name", "posted_at", "engagement", "url")),
    "structured_report": (97, 0, 97, ()),
    "event_listing": (60, 7, 93, ("organizer", "venue", "event_start", "event_end", "region")),
    "generic_article": (50, 8, 90, ("title", "body", "content", "source_name", "source_url", "published_at", "author")),
}


def route_payloads(df: DataFrame, margin: int = 15) -> DataFrame:
    """Add shape, confidence and ambiguous to records with any of the columns that shapes know.

    A shape that can take a record scores its base and points for each signature field that is there, up to its most;
    the best wins, unless the next is less than `margin` hundredths behind. Without any shape confidence is 0.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    given = lambda c: F.col(c).isNotNull() if c in kinds else F.lit(False)
    true = lambda c: (given(c) & ((F.col(c) != "") if kinds.get(c) == "string" else F.lit(True))) if c in kinds else F.lit(False)
    takes = {
        "marketplace_listing": (true("marketplace") | true("listing_url")) & (given("price") | given("current_bid")),
        "retailer_product": true("product_name") & (true("retailer") | given("retail_price") | true("sku") | given("purchase_limit") | given("required_spend")),
        "social_post": true("platform") & true("text"),
        "structured_report": given("schema_version") & given("product_identity"),
        "event_listing": true("event_name") & (true("event_start") | true("event_url")),
        "generic_article": true("title") & (true("body") | true("content")) & ~(true("retail_price") | true("listing_url") | true("sku") | true("platform")),
    }
    scored = []
    for i, (name, (base, each, most, fields)) in enumerate(SHAPES.items()):
        there = true if name in ("event_listing", "generic_article") else given
        points = F.least(F.lit(most), F.lit(base) + sum((F.when(there(c), each).otherwise(0) for c in fields), F.lit(0)))
        scored.append(F.struct(F.when(F.coalesce(takes[name], F.lit(False)), points).otherwise(0).alias("points"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.sort_array(F.array(*scored), asc=False)
    first, second = best[0], best[1]
    close = (second["points"] > 0) & (first["points"] - second["points"] < margin)
    some = first["points"] > 0
    return df.withColumns({"shape": F.when(some & ~close, first["name"]), "confidence": first["points"] / 100, "ambiguous": some & close})


def finalization_confidence(identity: Sequence[Column], market: Sequence[Column], identity_reviews: Column, market_reviews: Column, market_conflicts: Column) -> dict[str, Column]:
    """Confidence in identity (filled fields less 25 for each conflict to review), in the market (70 less 30 for each
    conflict to review and 10 for each other; 0 without prices) and in both; 0.85 of it if anything is to be reviewed."""
    filled = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in identity), F.lit(0)) * 100 / len(identity)
    first = S.clamp(filled - 25 * identity_reviews)
    priced = F.greatest(*(c.isNotNull() for c in market))
    second = F.when(priced, S.clamp(70.0 - 30 * market_reviews - 10 * market_conflicts)).otherwise(0.0)
    both = (first + F.when(second != 0, second).otherwise(first)) / 2 * F.when(identity_reviews + market_reviews > 0, 0.85).otherwise(1.0)
    return {"identity_confidence": S.round2(first), "market_confidence": S.round2(second), "finalization_confidence": S.round2(both)}


def item_signals(items: DataFrame, rules: Sequence[tuple[str, int, Column]], key: str, base: int = 40) -> DataFrame:
    """key, score (base plus the weights of the rules that hold, 0 to 100) and signals in the order of the rules."""
    holds = [F.coalesce(ok, F.lit(False)) for _, _, ok in rules]
    score = S.clamp(F.lit(base) + sum((F.when(h, w).otherwise(0) for h, (_, w, _) in zip(holds, rules, strict=True)), F.lit(0)))
    return items.select(key, score.alias("score"), F.array_join(F.array_compact(F.array(*(F.when(h, name) for h, (name, _, _) in zip(holds, rules, strict=True)))), ",").alias("signals"))


#: Item signals told by words of title and description: name, weight, words, reason. Fixed values.
WORD_SIGNALS = (
    ("limited_release", 12, ("limited",), "It is said to be limited."),
    ("exclusive", 10, ("exclusive",), "It is said to be exclusive."),
    ("collaboration", 10, ("collab", "collaboration", "travis scott", "off-white", "kobe"), "A partner in demand, or a collaboration, is named."),
    ("shock_drop", 14, ("shock drop",), "A sudden drop is announced, which is urgent."),
    ("restock", -8, ("restock", "available again"), "It is back in stock: worth watching, no reason to buy by itself."),
    ("reprint", -12, ("reprint",), "A reprint is named, and more supply can lower the price."),
    ("collector_interest", 10, ("promo", "collector", "anniversary", "exclusive", "limited"), "Words that draw collectors occur."),
)
#: Item signals told by scores: name, column, least scores with their weights. Fixed values.
SCORE_SIGNALS = (
    ("collector_value", "collector_score", ((85, 16), (70, 12), (55, 8), (35, 4))),
    ("investment_strategy", "strategy_score", ((85, 14), (70, 10), (55, 7))),
    ("source_consensus", "consensus_score", ((85, 14), (70, 10), (50, 6))),
)
ITEM_SIGNAL_ORDER = ("official_source", "limited_release", "exclusive", "collaboration", "shock_drop", "restock", "reprint", "historical_pattern", "collector_interest", "collector_value", "investment_strategy", "source_consensus")


def signal_evidence(items: DataFrame) -> DataFrame:
    """Add evidence (array of signal, weight, reason, in the order of ITEM_SIGNAL_ORDER) and score (40 and the weights,
    0 to 100).

    items may have title, description, url, patterns (array), collector_score, collector_level, strategy, strategy_score,
    consensus_score and confirmation_count; a column that is missing or null says nothing.
    """
    have = lambda c, kind, other: F.coalesce(F.col(c).cast(kind), F.lit(other)) if c in items.columns else F.lit(other)
    text = F.lower(F.concat_ws(" ", have("title", "string", ""), have("description", "string", "")))
    whole = lambda c: F.format_string("%.0f", have(c, "double", 0.0))
    row = lambda name, weight, reason: F.struct(F.lit(name).alias("signal"), weight.cast("int").alias("weight"), reason.alias("reason"))
    found = {"official_source": F.when(have("url", "string", "") != "", row("official_source", F.lit(12), F.lit("It has the link of a source.")))}
    if "patterns" in items.columns:
        found["historical_pattern"] = F.when(F.size("patterns") > 0, row("historical_pattern", F.lit(8), F.lit("It follows a known pattern.")))
    for name, weight, words, reason in WORD_SIGNALS:
        found[name] = F.when(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w)), row(name, F.lit(weight), F.lit(reason)))
    reasons = {
        "collector_value": F.concat(F.lit("Collectors rate it "), whole("collector_score"), F.lit(" of 100 ("), have("collector_level", "string", "UNKNOWN"), F.lit(").")),
        "investment_strategy": F.concat(F.lit("As "), have("strategy", "string", "UNKNOWN"), F.lit(" it scores "), whole("strategy_score"), F.lit(" of 100.")),
        "source_consensus": F.concat(F.lit("Sources agree by "), whole("consensus_score"), F.lit(" of 100; confirmations: "), have("confirmation_count", "string", "1"), F.lit(".")),
    }
    for name, column, steps in SCORE_SIGNALS:
        weight = F.coalesce(*(F.when(have(column, "double", 0.0) >= least, w) for least, w in steps))
        found[name] = F.when(weight.isNotNull(), row(name, weight, reasons[name]))
    evidence = F.array_compact(F.array(*(found[n] for n in ITEM_SIGNAL_ORDER if n in found)))
    return items.withColumn("evidence", evidence).withColumn("score", S.clamp(F.aggregate("evidence", F.lit(40), lambda a, e: a + e["weight"])))


def fill_by_tier(df: DataFrame, fields: Sequence[str], tiers: Sequence[str]) -> DataFrame:
    """Each field from the first tier (struct column) that has it, with the tiers that contributed, in their order."""
    value = {f: F.coalesce(*(F.col(f"{t}.{f}") for t in tiers)) for f in fields}
    used = []
    for i, t in enumerate(tiers):
        gave = F.lit(False)
        for f in fields:
            earlier = F.coalesce(*(F.col(f"{x}.{f}") for x in tiers[:i])) if i else F.lit(None)
            gave = gave | (F.col(f"{t}.{f}").isNotNull() & earlier.isNull())
        used.append(F.when(gave, t))
    return df.withColumns({**value, "provenance": F.array_join(F.array_compact(F.array(*used)), ",")}).drop(*tiers)


def classify_sources(docs: DataFrame, signals: DataFrame, primary: Sequence[str] = ("OFFICIAL", "RETAILER", "PRESS_RELEASE", "EVENT")) -> DataFrame:
    """seq and disposition of each source: duplicate of an earlier one (same link, else same text), irrelevant (no
    signals), else by rumours, market and primary sources, status signals, or supporting.

    docs has seq, probe (link or text key, may be null) and source_type; signals has seq, rumored and status (booleans).
    """
    first = docs.where("probe is not null").groupBy("probe").agg(F.min("seq").alias("first"))
    joined = docs.join(first, "probe", "left").join(signals.select("seq", "rumored", "status", F.lit(True).alias("found")), "seq", "left")
    kind = (
        F.when(F.col("seq") > F.col("first"), "REJECTED_DUPLICATE")
        .when(F.col("found").isNull(), "REJECTED_IRRELEVANT")
        .when(F.col("rumored"), "ACCEPTED_RUMOR")
        .when(F.col("source_type") == "MARKETPLACE", "ACCEPTED_MARKET_EVIDENCE")
        .when(F.col("source_type").isin(*primary), "ACCEPTED_PRIMARY")
        .when(F.col("status"), "ACCEPTED_STATUS_UPDATE")
        .otherwise("ACCEPTED_SUPPORTING")
    )
    return joined.select("seq", kind.alias("disposition"))
