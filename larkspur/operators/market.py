"""Aggregates over quotes, decisions, patterns and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scores as S
from larkspur.functions import text as T
from larkspur.sources.tables import few

#: Keywords that are tested against each text; there are fewer than this many of one or two letters.
KEYWORDS = 20_000


def mean_cents(c: Column) -> Column:
    """Mean of whole cents as an amount with two decimals; nulls are left out."""
    return F.floor(F.sum(c) / F.count(c) + 0.5) / 100


def share_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, S.round2(part / whole * 100))


def aggregate_quotes(quotes: DataFrame, key: str) -> DataFrame:
    """One row for each key over quotes (average_cents, lowest_cents, highest_cents, sold_count): providers, those with
    data, mean of averages, lowest, highest, sold, confidence. Quotes without an average count as providers only."""
    there = F.col("average_cents").isNotNull()
    with_data = F.count_if(there)
    return quotes.groupBy(key).agg(
        F.count("*").alias("providers"),
        with_data.alias("providers_with_data"),
        mean_cents(F.col("average_cents")).alias("average_price"),
        (F.min(F.when(there, F.col("lowest_cents"))) / 100).alias("lowest_price"),
        (F.max(F.when(there, F.col("highest_cents"))) / 100).alias("highest_price"),
        F.coalesce(F.sum(F.when(there, F.col("sold_count"))), F.lit(0)).alias("sold_count"),
        F.when(with_data == 0, "UNKNOWN").when(with_data >= 2, "HIGH").otherwise("MEDIUM").alias("confidence"),
    )


def learning_summary(log: DataFrame) -> DataFrame:
    """Statistics of a decision log for each category and brand; missing figures are left out of means."""
    brand, category = F.coalesce(F.when(F.col("brand") != "", F.col("brand")), F.lit("Unknown")), F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("general"))
    decision = F.coalesce("decision", F.lit("WATCH"))
    total, profits = F.count("*"), F.count("profit_cents")
    counts = {"buy_count": "BUY", "strong_watch_count": "STRONG WATCH", "watch_count": "WATCH", "skip_count": "SKIP"}
    return log.groupBy(category.alias("category"), brand.alias("brand")).agg(
        total.alias("total_records"),
        F.count("roi_cents").alias("records_with_roi"),
        profits.alias("records_with_profit"),
        mean_cents(F.col("roi_cents")).alias("average_roi"),
        mean_cents(F.col("profit_cents")).alias("average_profit"),
        mean_cents(F.col("market_cents")).alias("average_market_price"),
        S.round2(F.sum(F.coalesce("score", F.lit(0))) / total).alias("average_score"),
        F.count_if(F.col("profit_cents") > 0).alias("profitable_count"),
        share_percent(F.count_if(F.col("profit_cents") > 0), profits).alias("profitable_rate"),
        *(F.count_if(decision == v).alias(k) for k, v in counts.items()),
        share_percent(F.count_if(decision == "BUY"), total).alias("buy_rate"),
        S.bucket(total, S.SAMPLE_LEVELS, "LOW").alias("confidence"),
    )


def summary_for(summary: DataFrame, wanted: DataFrame) -> DataFrame:
    """The summaries of the wanted (category, brand) pairs, with zeros and LOW for pairs never seen."""
    empty = {"total_records": F.lit(0), "buy_count": F.lit(0), "confidence": F.lit("LOW")}
    joined = wanted.join(summary, ["category", "brand"], "left")
    return joined.select("category", "brand", *(F.coalesce(F.col(c), v).alias(c) for c, v in empty.items()), "average_roi", "average_profit")


def match_patterns(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """(item_id, name, strength, historical_roi) of the patterns (name, category, keywords array, historical_roi) that
    an item (item_id, text, category) matches: keywords anywhere in its text, plus one for an equal category.

    A small table of keywords, whose rows are counted first, is tested against each text as a broadcast; a larger one is
    looked up by the first three letters of each keyword among the texts' three-letter grams, and keywords of one or two letters
    by themselves among the texts' grams of that length.
    """
    texts = items.select("item_id", F.lower("text").alias("text"))
    keywords = patterns.select("name", F.explode(F.array_distinct(F.transform("keywords", lambda k: F.lower(k)))).alias("keyword")).where("keyword <> ''")
    small = few(keywords, KEYWORDS)
    holds = F.contains("text", F.col("keyword"))
    if small is keywords:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 2, F.lit(1))), lambda i: F.substring("text", i, 3)))
        long = texts.withColumn("gram", F.explode(grams)).join(keywords.where(F.length("keyword") >= 3).withColumn("gram", F.substring("keyword", 1, 3)), "gram")
        found = long.where(holds).select("item_id", "name", "keyword")
        parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substring("text", i, n)))))
        short = texts.select("item_id", F.explode(parts).alias("keyword")).join(keywords.where(F.length("keyword") < 3), "keyword")
        found = found.unionByName(short.select("item_id", "name", "keyword")).distinct()
    else:
        found = texts.join(small, holds).select("item_id", "name", "keyword")
    by_category = items.where(F.coalesce("category", F.lit("")) != "").select("item_id", F.lower("category").alias("c")).join(patterns.select("name", F.lower("category").alias("c")), "c").select("item_id", "name")
    strength = found.select("item_id", "name").unionByName(by_category).groupBy("item_id", "name").agg(F.count("*").alias("strength"))
    return strength.join(patterns.select("name", "historical_roi"), "name")


def pattern_score(matches: DataFrame) -> DataFrame:
    """Strength-weighted mean return of each item's patterns; patterns without a return are counted only."""
    known = F.col("historical_roi").isNotNull()
    weight = F.when(known, F.greatest("strength", F.lit(1)))
    mean = F.sum(F.col("historical_roi") * weight) / F.sum(weight)
    return matches.groupBy("item_id").agg(
        F.coalesce(S.round2(mean), F.lit(0.0)).alias("pattern_score"), S.bucket(mean, ((70, "VERY HIGH"), (50, "HIGH"), (30, "MEDIUM")), "LOW").alias("confidence"), F.count("*").alias("match_count")
    )


def route_providers(items: DataFrame, available: tuple[str, ...]) -> DataFrame:
    """(item_id, position, provider) in the order in which an item's providers are asked; only available ones."""
    category, brand, title = (F.lower(F.coalesce(c, F.lit(""))) for c in ("category", "brand", "title"))
    cards = category.isin("pokemon", "tcg") | F.contains(brand, F.lit("pokemon")) | F.contains(title, F.lit("pokémon"))
    shoes = (category == "nike") | F.contains(brand, F.lit("nike")) | F.contains(title, F.lit("snkrs"))
    lists = F.when(cards, F.array(*map(F.lit, ("manual", "tcgplayer", "pricecharting", "ebay")))).when(shoes, F.array(*map(F.lit, ("manual", "stockx", "ebay")))).otherwise(F.array(F.lit("manual"), F.lit("ebay")))
    return items.select("item_id", F.posexplode(F.filter(lists, lambda p: p.isin(*available))).alias("position", "provider"))


#: Classes of the scan summary: fixed values.
IN_STOCK = ("instock", "available", "availablefororder")
OUT_OF_STOCK = ("outofstock", "soldout", "unavailable", "discontinued")
PREORDER = ("preorder", "preorderonly", "comingsoon")


def scan_summary(items: DataFrame, group: str) -> DataFrame:
    """Stock, price and exclusivity counts for each value of `group`."""
    a = T.norm_availability(F.col("availability"))
    return items.groupBy(group).agg(
        F.count_if(a.isin(*IN_STOCK)).alias("in_stock_count"),
        F.count_if(a.isin(*OUT_OF_STOCK)).alias("out_of_stock_count"),
        F.count_if(a.isin(*PREORDER)).alias("preorder_count"),
        F.count_if(~a.isin(*IN_STOCK, *OUT_OF_STOCK, *PREORDER)).alias("unknown_count"),
        F.count("retail_price").alias("known_price_count"),
        F.count_if(F.coalesce("limited_release", F.lit(False))).alias("exclusive_count"),
    )


def brand_memory(items: DataFrame, text: str, action: str) -> DataFrame:
    """Counters for each brand and the observations that follow from them."""
    t, a = F.lower(F.coalesce(text, F.lit(""))), F.upper(F.coalesce(action, F.lit("")))
    counted = items.groupBy("brand").agg(
        F.count("*").alias("total_items_seen"), F.count_if(F.contains(t, F.lit("promo"))).alias("promo_count"), F.count_if(F.contains(t, F.lit("exclusive"))).alias("exclusive_count"), F.count_if(a == "WATCH").alias("watch_count"), F.count_if(a == "BUY").alias("buy_count")
    )
    rules = {"promo_rising": F.col("promo_count") >= 3, "exclusives_frequent": F.col("exclusive_count") >= 2, "mostly_watch": F.col("watch_count") > F.col("buy_count"), "enough_observations": F.col("total_items_seen") >= 10}
    return counted.withColumn("observations", F.concat_ws(",", F.array_compact(F.array(*(F.when(c, k) for k, c in rules.items())))))
