"""Operators on single items: keys, validation, drop scoring, decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scores as S
from larkspur.functions import text as T


def product_key(category: Column, sku: Column, codes: Column, product_type: Column, url: Column, title: Column) -> Column:
    """The catalog key: the first of sku, set codes with type, url and title that is there; null if none is.

    codes is an array. The category is part of every key and 'tcg' where it is missing.
    """
    head = T.norm_value(F.when(F.coalesce(category, F.lit("")) == "", "tcg").otherwise(category))
    code = T.norm_code(sku)
    sets = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(codes, F.array().cast("array<string>")), T.norm_code), lambda c: c != "")))
    kind = T.norm_value(F.when(F.coalesce(product_type, F.lit("")) == "", "other").otherwise(product_type))
    link, name = T.url_key(url), T.norm_title(title)
    return (
        F.when(code != "", F.concat(head, F.lit(":sku:"), code))
        .when(F.size(sets) > 0, F.concat(head, F.lit(":codes:"), F.array_join(sets, "|"), F.lit(":"), kind))
        .when(link != "", F.concat(head, F.lit(":url:"), link))
        .when(name != "", F.concat(head, F.lit(":title:"), name))
    )


def dedup_key(brand: Column, franchise: Column, name: Column, partner: Column, release: Column, retailer: Column) -> Column:
    """Key of an opportunity: normalised parts, empty ones kept, joined by bars."""
    parts = [T.norm_text(brand), T.norm_text(franchise), T.norm_text(name), T.norm_text(partner), T.norm_day(release), T.norm_text(retailer)]
    return F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))


def roi_columns(retail: Column, sold: Column, shipping: Column | None = None, fee_rate: Column | None = None) -> dict[str, Column]:
    """Fees, shipping, net revenue, profit and return in percent of a resale; null where a side is missing."""
    ship = F.coalesce(shipping, F.lit(8.0)) if shipping is not None else F.lit(8.0)
    rate = F.coalesce(fee_rate, F.lit(0.13)) if fee_rate is not None else F.lit(0.13)
    both = retail.isNotNull() & sold.isNotNull()
    fees = sold * rate
    net = sold - fees - ship
    profit = net - retail
    roi = F.when(retail > 0, profit / retail * 100).otherwise(0.0)
    return {k: F.when(both, S.round2(v)) for k, v in {"fees": fees, "shipping": ship, "net_revenue": net, "profit": profit, "roi": roi}.items()}


def realized_roi(df: DataFrame, purchase: str, sold: str, shipping: str, fees: str) -> DataFrame:
    """Add total_profit, roi_percent and learning_status 'verified' where purchase and sale are known."""
    known = F.col(purchase).isNotNull() & F.col(sold).isNotNull()
    profit = F.col(sold) - F.col(purchase) - F.coalesce(shipping, F.lit(0)) - F.coalesce(fees, F.lit(0))
    return df.withColumns({
        "total_profit": F.when(known, S.round2(profit)),
        "roi_percent": F.when(known & (F.col(purchase) != 0), S.round2(profit / F.col(purchase) * 100)),
        "learning_status": F.when(known, "verified"),
    })


#: Term weights of the drop score: fixed values.
DROP_STRONG = {
    "limited": 18,
    "exclusive": 18,
    "pokemon center": 22,
    "plush": 14,
    "halloween": 22,
    "anniversary": 16,
    "collector": 16,
    "drop": 14,
    "coming soon": 14,
    "available": 10,
    "collection": 10,
    "disney": 14,
    "lego": 12,
    "funko": 12,
    "mattel": 10,
}
DROP_BAD = {"investor": -30, "earnings": -30, "quarter": -25, "dividend": -30, "board": -20, "appointment": -20, "financial": -25}
DROP_LEVELS = ((90, "CRITICAL"), (75, "HIGH"), (55, "MEDIUM"))
DROP_ACTIONS = ((90, "BUY IMMEDIATELY"), (75, "BUY IF AVAILABLE"), (55, "BUY IF CONVENIENT"))


def score_drops(df: DataFrame, text: Column, strong: Mapping[str, int] = DROP_STRONG, bad: Mapping[str, int] = DROP_BAD, least: int | None = 55) -> DataFrame:
    """Add score, level, action, hype, collector, urgency, resale and hits of a drop's text; keep scores from `least`."""
    share = lambda base, each, terms: F.least(F.lit(100), F.size(S.hits(text, terms)) * each + base)
    out = df.withColumns({
        "score": S.clamp(F.lit(35) + S.term_points(text, strong) + S.term_points(text, bad)),
        "hype": share(40, 10, ("new", "coming soon", "drop", "available")),
        "collector": share(35, 15, ("pokemon", "disney", "lego", "funko", "plush", "collector")),
        "urgency": share(30, 20, ("limited", "exclusive", "coming soon", "drop")),
        "resale": share(30, 15, ("pokemon center", "halloween", "anniversary", "exclusive", "limited")),
        "hits": F.array_join(F.slice(F.concat(F.transform(S.hits(text, list(strong)), lambda t: F.concat(F.lit("+ "), t)), F.transform(S.hits(text, list(bad)), lambda t: F.concat(F.lit("- "), t))), 1, 8), ", "),
    }).withColumns({"level": S.bucket(F.col("score"), DROP_LEVELS, "LOW"), "action": S.bucket(F.col("score"), DROP_ACTIONS, "WATCH ONLY")})
    return out if least is None else out.where(F.col("score") >= least)


#: Terms of the market signal: fixed values.
HOT_TERMS = ("pokemon", "pokémon", "pokemon center", "plush", "exclusive", "limited", "halloween", "anniversary", "disney", "lego", "funko", "stanley", "costco", "target")
WEAK_TERMS = ("investor", "earnings", "financial", "conference", "appointment", "board")


def market_signal(text: Column, comps: Column, hot: Sequence[str] = HOT_TERMS, weak: Sequence[str] = WEAK_TERMS) -> Column:
    """Struct of score and status from hot and weak terms and whether a link to sold items exists."""
    ready = F.when(F.coalesce(comps, F.lit("")) != "", 10).otherwise(0)
    score = S.clamp(F.lit(35) + 6 * F.size(S.hits(text, hot)) - 15 * F.size(S.hits(text, weak)) + ready)
    return F.struct(score.alias("score"), S.bucket(score, ((80, "strong"), (60, "watch")), "weak").alias("status"))


def comps_link(brand: Column, name: Column, base: str = "https://www.ebay.com/sch/i.html?_nkw=") -> Column:
    """Search link for sold items; null without brand and name."""
    query = F.trim(F.concat_ws(" ", F.coalesce(brand, F.lit("")), F.coalesce(name, F.lit(""))))
    return F.when(query != "", F.concat(F.lit(base), F.url_encode(query), F.lit("&LH_Sold=1&LH_Complete=1")))


def decision(score: Column, risk: Column, patterns: Column, profit: Column, roi: Column) -> dict[str, Column]:
    """Action and confidence from score, reprint risk, number of patterns and, where known, profit and return."""
    confidence = F.when((score >= 90) & (patterns >= 1), "VERY HIGH").when(score >= 75, "HIGH").when(score >= 60, "MEDIUM").otherwise("LOW")
    known = (
        F.when((profit <= 0) | (roi <= 0), "SKIP")
        .when(risk, "WATCH")
        .when((roi >= 60) & (score >= 70), "BUY")
        .when((roi >= 35) & (score >= 60), "STRONG WATCH")
        .when(roi >= 15, "WATCH")
        .otherwise("SKIP")
    )
    unknown = F.when(risk, "WATCH").when(score >= 90, "BUY").when(score >= 70, "STRONG WATCH").otherwise("WATCH")
    return {"action": F.when(roi.isNotNull(), known).otherwise(unknown), "confidence": confidence}


def opportunity_level(score: Column, confidence: Column) -> Column:
    return F.when((score >= 90) & (confidence == "VERY HIGH"), "EXCEPTIONAL").when(score >= 80, "HIGH").when(score >= 65, "MEDIUM").otherwise("LOW")


URGENT_TERMS = ("shock drop", "exclusive access", "today", "now available", "limited release", "first come")


def urgency(text: Column, terms: Sequence[str] = URGENT_TERMS) -> Column:
    return S.bucket(F.size(S.hits(text, terms)), ((3, "VERY HIGH"), (2, "HIGH"), (1, "MEDIUM")), "LOW")


#: Keywords that mark a drop: fixed values.
DROP_KEYWORDS = ("coming soon", "launch", "released", "available", "new", "exclusive", "limited", "collection", "plush", "pokemon center", "celebrate", "anniversary", "festival", "drop")


def admit_drops(df: DataFrame, title: str, published: str, now: Column, days: int = 30, keywords: Sequence[str] = DROP_KEYWORDS) -> DataFrame:
    """Rows published in the last `days` days or with a drop keyword in the title."""
    recent = F.coalesce(F.col(published) >= now - F.make_dt_interval(F.lit(days)), F.lit(False))
    return df.where(recent | (F.size(S.hits(F.col(title), keywords)) > 0))


def relative_age(ts: Column, now: Column) -> Column:
    """'just now', 'Nm ago', 'Nh ago' or 'Nd ago'; null without a time."""
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(ts.isNull(), None).when(s < 60, "just now").when(s < 3600, part(60, "m ago")).when(s < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))


def enrich_context(text: Column, rules: Sequence[tuple[str, str, str]] = (("pokemon", "Pokémon Center", "Collectible Plush"), ("lego", "LEGO", "Building Set"), ("disney", "Disney Store", "Disney Merchandise"))) -> dict[str, Column]:
    """Retailer and category by the last rule (term, retailer, category) whose term the text contains."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    retailer, category = F.lit("Unknown"), F.lit("Collectible")
    for term, shop, kind in rules:
        retailer = F.when(F.contains(lowered, F.lit(term)), shop).otherwise(retailer)
        category = F.when(F.contains(lowered, F.lit(term)), kind).otherwise(category)
    return {"retailer": retailer, "category": category}


def money_columns(spend: Column, sold: Column, market: Column, estimated: Column) -> dict[str, Column]:
    """Resale value by precedence sold, market, estimate; profit and return in percent of the spend."""
    resale = F.coalesce(sold, market, estimated)
    profit = resale - spend
    return {"resale": resale, "profit": S.round2(profit), "roi_percent": F.when(spend > 0, S.round2(profit / spend * 100))}


def check_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null holds."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items())))
