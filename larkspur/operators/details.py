"""Product details out of texts, and texts out of records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scores as S

#: Patterns of counts, tried in turn, terms of accessories with their labels, weights of details: fixed values.
PACK_PATTERNS = (
    r"includes?\s+(\d+)\s+(?:pok[eé]mon\s+tcg\s+)?booster packs?",
    r"contains?\s+(\d+)\s+(?:pok[eé]mon\s+tcg\s+)?booster packs?",
    r"(\d+)\s+(?:pok[eé]mon\s+tcg\s+)?booster packs?",
    r"(\d+)[- ]pack booster",
)
PROMO_PATTERNS = (
    r"includes?\s+(\d+)\s+(?:exclusive\s+)?promo cards?",
    r"contains?\s+(\d+)\s+(?:exclusive\s+)?promo cards?",
    r"(\d+)\s+(?:exclusive\s+)?promo cards?",
)
ACCESSORY_TERMS = {
    "card sleeves": "Card sleeves",
    "deck box": "Deck box",
    "playmat": "Playmat",
    "binder": "Binder",
    "coin": "Collector coin",
    "damage-counter dice": "Damage-counter dice",
    "damage counter dice": "Damage-counter dice",
    "dice": "Dice",
    "condition markers": "Condition markers",
    "dividers": "Card dividers",
    "code card": "Digital code card",
    "energy cards": "Energy cards",
    "collector pin": "Collector pin",
    "oversize card": "Oversize card",
    "oversized card": "Oversize card",
    "sticker": "Stickers",
    "poster": "Poster",
}
DETAIL_WEIGHTS = {"retail_price": 20, "currency": 5, "release_date": 15, "availability": 15, "sku": 15, "image_url": 10, "pack_count": 8, "promo_card_count": 7, "set_name": 5}
DETAIL_LEVELS = ((85, "EXCELLENT"), (65, "GOOD"), (40, "PARTIAL"))


def first_integer(text: Column, patterns: Sequence[str]) -> Column:
    """The number in the first pattern that matches; null if none does."""
    return F.coalesce(*(F.regexp_extract(text, p, 1).try_cast("int") for p in patterns))


def product_details(items: DataFrame, text: Column, weights: Mapping[str, int] = DETAIL_WEIGHTS) -> DataFrame:
    """Add pack_count, promo_card_count, accessories (labels without repeats), completeness (sum of the weights of the
    filled details), its level and the missing details. Details that items has no column for count as missing."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    labels = F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(lowered, F.lit(t)), label) for t, label in ACCESSORY_TERMS.items()))))
    out = items.withColumns({"pack_count": first_integer(lowered, PACK_PATTERNS), "promo_card_count": first_integer(lowered, PROMO_PATTERNS), "accessories": labels})
    kinds = {f.name: f.dataType.typeName() for f in out.schema.fields}
    there = {c: F.lit(False) if c not in kinds else F.col(c).isNotNull() & (F.col(c) != "") if kinds[c] == "string" else F.col(c).isNotNull() for c in weights}
    score = sum((F.when(there[c], w).otherwise(0) for c, w in weights.items()), F.lit(0))
    missing = F.array_join(F.array_compact(F.array(*(F.when(~there[c], c) for c in weights))), ",")
    return out.withColumns({"completeness": score, "missing": missing}).withColumn("completeness_level", S.bucket(F.col("completeness"), DETAIL_LEVELS, "LIMITED"))


def money(amount: Column, currency: Column) -> Column:
    """$60 or $59.99 for dollars, else the amount with its code; null without an amount."""
    plain = F.when(amount == F.floor(amount), F.floor(amount).cast("string")).otherwise(F.format_string("%.2f", amount))
    text = F.when(F.coalesce(currency, F.lit("USD")) == "USD", F.concat(F.lit("$"), plain)).otherwise(F.concat(plain, F.lit(" "), currency))
    return F.when(amount.isNotNull(), text)


def listing_text(title: Column, marketplace: Column, scope: Column, graded: Column, sold: Column, price: Column, bid: Column, currency: Column) -> Column:
    """Struct of text and price_role of a marketplace listing. Only a sold item is said to be sold: a bid and an asking
    price are named as such."""
    grading = F.when(graded, ", graded").when(~graded, ", ungraded").otherwise("")
    thing = F.concat(F.coalesce(scope, F.lit("item")), grading)
    role = F.when(F.coalesce(sold, F.lit(False)), "sold").when(bid.isNotNull(), "auction_bid").when(price.isNotNull(), "asking").otherwise("unknown")
    said = (
        F.when(role == "sold", F.concat(F.lit(" This "), thing, F.lit(" sold for "), F.coalesce(money(price, currency), F.lit("an unknown price")), F.lit(".")))
        .when(role == "auction_bid", F.concat(F.lit(" The highest bid for this "), thing, F.lit(" is "), money(bid, currency), F.lit("; the auction is open.")))
        .when(role == "asking", F.concat(F.lit(" The asking price of this "), thing, F.lit(" is "), money(price, currency), F.lit("; nobody has bought it yet.")))
        .otherwise("")
    )
    return F.struct(F.concat(title, F.lit(" - a "), thing, F.lit(" listed on "), marketplace, F.lit("."), said).alias("text"), role.alias("price_role"))
