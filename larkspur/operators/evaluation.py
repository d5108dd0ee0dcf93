"""Evaluation of opportunities: component scores with reasons, recommendation, strategy, quantity, tags and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scores as S

_EVIDENCE = "array<struct<signal_type:string,confirmed:boolean,estimated:boolean,rumored:boolean,notes:string>>"
#: Columns of an opportunity that evaluation reads; those that a table lacks count as null.
FIELDS = {
    **dict.fromkeys(("product_name", "brand", "franchise", "product_line", "category", "subcategory", "collaboration_partner", "edition_name", "release_date", "purchase_window_start", "purchase_window_end", "status", "artist_name", "set_or_series", "sellout_speed", "demand_direction", "source_type"), "string"),
    **dict.fromkeys(("retail_price", "required_spend", "target_buy_price", "current_market_price", "recent_sold_price", "estimated_market_price", "peak_market_price", "sales_velocity", "franchise_strength"), "double"),
    **dict.fromkeys(("purchase_limit", "stated_quantity", "sold_listing_count"), "int"),
    **dict.fromkeys(
        ("membership_required", "lottery_required", "event_attendance_required", "bundle_required", "regional_exclusive", "online_available", "limited_quantity", "numbered", "first_edition", "first_collaboration", "anniversary_release", "exclusive_promo", "exclusive_artwork", "exclusive_character",
         "event_exclusive", "convention_exclusive", "retailer_exclusive", "region_exclusive", "membership_exclusive", "tournament_exclusive", "sealed_product", "redeemable_reward"),
        "boolean",
    ),
    **dict.fromkeys(("character_names", "risks", "catalyst_signals"), "array<string>"),
    "evidence": _EVIDENCE,
}
#: Texts that mean a complete set: fixed values.
SET_MARKERS = ("complete set", "complete promo set", "full set", "entire set", "whole set")
RECOMMENDATIONS = ("CRITICAL_BUY", "STRONG_BUY", "BUY", "CONDITIONAL_BUY", "WATCH", "SKIP", "AVOID")
SOURCE_POINTS = {"OFFICIAL": 25, "PRESS_RELEASE": 15, "RETAILER": 15, "NEWS": 8, "EVENT": 8, "COMMUNITY": 0, "MARKETPLACE": 0, "SOCIAL": -10, "OTHER": -10}
SCORES = ("collector", "flip", "hold", "scarcity", "demand", "hype", "acquisition", "risk", "confidence")


@dataclass(frozen=True)
class Config:
    """Weights and thresholds: fixed values by default."""

    weights: dict[str, float] = field(default_factory=lambda: {"monetization": 0.35, "collector": 0.10, "scarcity": 0.12, "demand": 0.13, "acquisition": 0.15, "hype": 0.15})
    risk_penalty: float = 0.3
    confidence_margin: float = 15.0
    thresholds: tuple[float, ...] = (58, 46, 34, 22, 13, 5)
    least_confidence: float = 35.0
    most_risk: float = 80.0
    rumor_cap: str = "WATCH"
    set_cap: str = "STRONG_BUY"
    most_quantity: int = 3
    quantities: tuple[int, ...] = (3, 2, 2, 1, 0, 0, 0)
    high_spend: float = 100.0
    very_high_spend: float = 500.0
    stated: tuple[int, int, int] = (100, 500, 2000)


def complete(opps: DataFrame) -> DataFrame:
    """Add the columns of FIELDS that are missing, as nulls."""
    return opps.withColumns({k: F.lit(None).cast(t) for k, t in FIELDS.items() if k not in opps.columns})


def _yes(*names: str) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(n), F.lit(False)) for n in names))


def _text(*names: str) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(n), F.lit("")) != "" for n in names))


def _status(name: str) -> Column:
    return F.lower(F.trim(F.coalesce("status", F.lit("")))) == name


def _some(array: str, test) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


def _count(test) -> Column:
    return F.size(F.filter(F.coalesce("evidence", F.array().cast(_EVIDENCE)), lambda e: F.coalesce(test(e), F.lit(False))))


def rumored() -> Column:
    return _status("rumored") | (_count(lambda e: e["rumored"]) > 0)


def is_complete_set() -> Column:
    """Whether the product itself is a complete set."""
    text = F.lower(F.concat_ws(" ", "product_name", "edition_name", "category", "subcategory"))
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in SET_MARKERS))


def resale_is_complete_set() -> Column:
    """Whether risks or evidence say that the resale price is a complete set's."""
    return _some("risks", lambda r: F.contains(F.lower(r), F.lit("complete set"))) | (_count(lambda e: F.contains(F.lower(e["notes"]), F.lit("complete set"))) > 0)


def prices() -> dict[str, Column]:
    """Price to buy at, price to sell at and whether that was observed or estimated; peaks are never used."""
    sell_kind = F.when(F.col("recent_sold_price").isNotNull() | F.col("current_market_price").isNotNull(), "observed").when(F.col("estimated_market_price").isNotNull(), "estimated")
    return {"target_buy_price": F.coalesce("required_spend", "retail_price", "target_buy_price"), "target_sell_price": F.coalesce("recent_sold_price", "current_market_price", "estimated_market_price"), "sell_kind": sell_kind}


#: A reason of a score: condition, points, sign of the reason (+, - or 0 for a note) and its text.
Reason = tuple[Column, Column | float, str, str | Column]


def _points(reasons: Sequence[Reason], start: float = 0.0) -> Column:
    parts = (F.when(F.coalesce(ok, F.lit(False)), p if isinstance(p, Column) else F.lit(float(p))).otherwise(0.0) for ok, p, _, _ in reasons)
    return reduce(lambda a, b: a + b, parts, F.lit(start))


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def _said(reasons: Sequence[Reason], sign: str) -> Column:
    texts = [F.when(F.coalesce(ok, F.lit(False)), what if isinstance(what, Column) else F.lit(what)) for ok, _, s, what in reasons if s == sign]
    return F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")


def _identity_beyond_brand() -> Column:
    return _text("franchise", "collaboration_partner", "product_line", "set_or_series")


def _strength() -> Reason:
    bonus = F.least(F.greatest(F.col("franchise_strength"), F.lit(0.0)), F.lit(100.0)) * 0.15
    return (F.col("franchise_strength").isNotNull(), bonus, "0", "Strength of the franchise applied")


def _demand(surging: float, rising: float, falling: float) -> list[Reason]:
    d = F.col("demand_direction")
    return [(d == "SURGING", surging, "+", "Surging demand"), (d == "RISING", rising, "+", "Rising demand"), (d == "FALLING", falling, "-", "Falling demand")]


def reasons(config: Config, mismatch: Column, is_rumor: Column) -> dict[str, tuple[float, list[Reason]]]:
    """Start value and reasons of each component score."""
    p = prices()
    buy, sell, kind = p["target_buy_price"], p["target_sell_price"], p["sell_kind"]
    both = (F.coalesce(buy, F.lit(0.0)) != 0) & (F.coalesce(sell, F.lit(0.0)) != 0)
    ratio = F.when(both, sell / buy)
    spread = F.when(ratio >= 3, 25.0).when(ratio >= 2, 18.0).when(ratio >= 1.5, 10.0).when(ratio > 1, 4.0).otherwise(0.0) * F.when(mismatch, 0.75).otherwise(1.0)
    window = _text("purchase_window_start") & _text("purchase_window_end")
    limit, stated = F.coalesce("purchase_limit", F.lit(0)) != 0, F.col("stated_quantity")
    low, moderate, high = config.stated
    scarce: list[Reason] = [
        (stated.isNotNull(), F.when(stated <= low, 25.0).when(stated <= moderate, 18.0).when(stated <= high, 10.0).otherwise(4.0), "+", F.concat(F.lit("Stated quantity: "), stated.cast("string"))),
        (_yes("numbered"), 10, "+", "Numbered release"),
        (limit, 8, "+", F.concat(F.lit("Purchase limit of "), F.col("purchase_limit").cast("string"))),
        (_yes("event_exclusive"), 10, "+", "Event-exclusive distribution"),
        (_yes("tournament_exclusive"), 10, "+", "Tournament-exclusive distribution"),
        (_yes("convention_exclusive"), 8, "+", "Convention-exclusive distribution"),
        (_yes("membership_exclusive", "membership_required"), 8, "+", "Membership requirement"),
        (_yes("lottery_required"), 12, "+", "Lottery-restricted distribution"),
        (_yes("region_exclusive", "regional_exclusive"), 6, "+", "Regional restriction"),
        (window, 6, "+", "Narrow purchase window"),
        (_status("sold_out"), 8, "+", "Currently sold out"),
    ]
    friction = reduce(lambda a, b: a + b, (F.when(_yes(c), 1).otherwise(0) for c in ("retailer_exclusive", "region_exclusive", "convention_exclusive", "tournament_exclusive")))
    n_risks, n_evidence = F.size(F.coalesce("risks", F.array().cast("array<string>"))), F.size(F.coalesce("evidence", F.array().cast(_EVIDENCE)))
    confirmed, estimated, rumors = _count(lambda e: e["confirmed"]), _count(lambda e: e["estimated"]), _count(lambda e: e["rumored"])
    identity = reduce(lambda a, b: a + b, (F.when(_text(c), 1).otherwise(0) for c in ("brand", "franchise", "product_name", "collaboration_partner")))
    source = F.coalesce(F.create_map(*(F.lit(x) for k, v in SOURCE_POINTS.items() for x in (k, float(v))))[F.col("source_type")], F.lit(-10.0))
    scarcity_known = F.coalesce(stated, F.lit(0)) != 0
    plain = ~(_yes("limited_quantity", "numbered", "event_exclusive", "convention_exclusive", "tournament_exclusive", "membership_exclusive", "retailer_exclusive", "region_exclusive") | scarcity_known)
    clamped = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), F.lit(most))
    return {
        "collector": (0.0, [
            (_yes("exclusive_artwork"), 15, "+", "Exclusive artwork"),
            (_yes("exclusive_character"), 12, "+", "Exclusive character"),
            (_text("artist_name"), 8, "+", F.concat(F.lit("Named artist: "), F.col("artist_name"))),
            (_yes("anniversary_release"), 12, "+", "Anniversary"),
            (_yes("first_collaboration"), 12, "+", "First collaboration of its kind"),
            (_yes("first_edition"), 10, "+", "First edition"),
            (_yes("numbered"), 8, "+", "Numbered release"),
            (_text("set_or_series"), 8, "+", "Part of a set"),
            (_yes("event_exclusive", "convention_exclusive", "tournament_exclusive"), 10, "+", "Exclusive to an event"),
            (F.col("source_type") == "OFFICIAL", 7, "+", "Official release"),
            (_text("collaboration_partner"), 8, "+", F.concat(F.lit("Collaboration partner: "), F.col("collaboration_partner"))),
            (_text("franchise"), 5, "+", F.concat(F.lit("Known franchise: "), F.col("franchise"))),
            (F.size(F.coalesce("character_names", F.array().cast("array<string>"))) > 0, 5, "+", F.concat(F.lit("Named characters: "), F.array_join("character_names", ", "))),
            _strength(),
        ]),
        "flip": (0.0, [
            (both & (spread > 0), spread, "+", F.format_string("Resale is %.1f times the price (%s)", ratio, kind)),
            (both & mismatch, 0, "-", "Resale price is that of a complete set"),
            (_text("sellout_speed"), 12, "+", F.concat(F.lit("Rapid sellout: "), F.col("sellout_speed"))),
            *_demand(10, 6, -15),
            (_yes("retailer_exclusive", "event_exclusive", "lottery_required", "membership_required"), 6, "+", "Difficult to acquire"),
            (window, 5, "+", "Narrow, defined purchase window"),
            (_yes("limited_quantity"), 8, "+", "Limited quantity"),
            (limit, 4, "+", F.concat(F.lit("Purchase limit of "), F.col("purchase_limit").cast("string"))),
            (_yes("exclusive_promo"), 5, "+", "Exclusive promotion"),
            (~_identity_beyond_brand(), -8, "-", "Unclear identity beyond the brand"),
            (_status("rumored"), -15, "-", "Release not yet confirmed"),
        ]),
        "hold": (0.0, [
            (_yes("sealed_product"), 10, "+", "Sealed product"),
            (_yes("first_edition"), 10, "+", "First edition"),
            (_yes("anniversary_release"), 8, "+", "Anniversary"),
            (_yes("exclusive_artwork"), 8, "+", "Exclusive artwork"),
            (stated.isNotNull(), F.when(stated <= 1000, 10.0).otherwise(3.0), "+", F.concat(F.lit("Stated quantity: "), stated.cast("string"))),
            (_yes("event_exclusive", "tournament_exclusive"), 8, "+", "Exclusive to an event"),
            (_text("collaboration_partner") & _yes("first_collaboration"), 10, "+", "Important first collaboration"),
            (_yes("lottery_required", "membership_required"), 6, "+", "Restricted acquisition"),
            _strength(),
            (F.col("demand_direction") == "FALLING", -10, "-", "Falling demand"),
            (plain, -10, "-", "Nothing sets it apart from mass-produced goods"),
        ]),
        "scarcity": (0.0, [*scarce, (_yes("limited_quantity") & (_points(scarce) == 0), 5, "0", "Limited quantity without other evidence")]),
        "demand": (0.0, [
            (F.col("sold_listing_count").isNotNull(), clamped(F.col("sold_listing_count") / 5, 15.0), "+", F.concat(F.lit("Sold listings: "), F.col("sold_listing_count").cast("string"))),
            (F.col("sales_velocity").isNotNull(), clamped(F.col("sales_velocity"), 15.0), "+", "Sales velocity known"),
            (_text("sellout_speed"), 15, "+", F.concat(F.lit("Rapid sellout: "), F.col("sellout_speed"))),
            *_demand(20, 10, -15),
            (F.size(F.coalesce("catalyst_signals", F.array().cast("array<string>"))) >= 3, 8, "+", "Several independent catalysts"),
        ]),
        "hype": (0.0, [
            (_text("collaboration_partner"), 15, "+", "Collaboration announced"),
            (_count(lambda e: e["signal_type"] == "COMMUNITY_HYPE") > 0, 15, "+", "Community hype"),
            ((_count(lambda e: e["signal_type"] == "RAPID_SELLOUT") > 0) | _text("sellout_speed"), 10, "+", "Rapid sellout draws attention"),
            (F.col("demand_direction") == "SURGING", 10, "+", "Surging short-term demand"),
            (_yes("redeemable_reward", "event_exclusive"), 5, "+", "Event or redemption"),
        ]),
        "acquisition": (100.0, [
            (_yes("membership_required", "membership_exclusive"), -15, "-", "Membership required"),
            (_yes("lottery_required"), -20, "-", "Lottery required"),
            (_yes("event_attendance_required"), -20, "-", "Attendance required"),
            (_yes("bundle_required"), -10, "-", "Bundle required"),
            (F.col("purchase_limit") == 1, -5, "-", "One for each customer"),
            (buy >= config.high_spend, F.when(buy >= config.very_high_spend, -20.0).otherwise(-10.0), "-", "Capital locked for each unit"),
            (friction > 0, -F.least(friction * 10.0, F.lit(20.0)), "-", "Restricted availability"),
            (_yes("online_available"), 10, "+", "Available online"),
        ]),
        "risk": (10.0, [
            (is_rumor, 30, "-", "Rumored release"),
            (~_identity_beyond_brand(), 10, "-", "Incomplete identity beyond the brand"),
            (mismatch, 25, "-", "Resale price of a complete set applied to one item"),
            (kind == "estimated", 10, "-", "Resale price is an estimate"),
            (F.col("demand_direction") == "FALLING", 15, "-", "Declining demand"),
            (_yes("redeemable_reward"), 8, "-", "Redemption uncertain"),
            (n_risks > 2, F.least((n_risks - 2) * 4.0, F.lit(12.0)), "-", F.concat(n_risks.cast("string"), F.lit(" risk factors reported"))),
        ]),
        "confidence": (40.0, [
            (source > 0, source, "+", F.concat(F.lit("Source type: "), F.col("source_type"))),
            (source <= 0, source, "-", F.coalesce(F.concat(F.lit("Source type: "), F.col("source_type")), F.lit("No source type"))),
            (identity >= 2, F.when(identity >= 4, 10.0).otherwise(5.0), "+", F.when(identity >= 4, "Complete identity").otherwise("Partial identity")),
            (buy.isNotNull(), 8, "+", "Buying price known"),
            (kind == "observed", 12, "+", "Observed resale price"),
            (kind == "estimated", 4, "0", "Estimated resale price"),
            (n_evidence > 0, 8, "+", F.concat(n_evidence.cast("string"), F.lit(" detections as evidence"))),
            (rumors > 0, -20, "-", "Some evidence is rumored"),
            ((rumors == 0) & (confirmed >= estimated) & (confirmed > 0), 10, "+", "Most evidence is confirmed"),
            (mismatch, -15, "-", "Evidence is about a complete set"),
            (is_rumor, -15, "-", "Rumored or unconfirmed"),
            (~_text("release_date") & ~_text("status"), -8, "-", "No release date or status"),
        ]),
    }


def component_scores(opps: DataFrame, config: Config = Config()) -> DataFrame:
    """Add rumored, complete_set_mismatch, the nine scores (collector_score and so on, 0 to 100) and score_explanation, a
    map from score to struct of positives, negatives and notes. Null fields are no evidence."""
    df = complete(opps).withColumns({"rumored": rumored(), "complete_set_mismatch": resale_is_complete_set() & ~is_complete_set()})
    found = reasons(config, F.col("complete_set_mismatch"), F.col("rumored"))
    said = lambda r: F.struct(_said(r, "+").alias("positives"), _said(r, "-").alias("negatives"), _said(r, "0").alias("notes"))
    explained = F.create_map(*(x for k, (_, r) in found.items() for x in (F.lit(f"{k}_score"), said(r))))
    return df.withColumns({f"{k}_score": _clamped(_points(r, start)) for k, (start, r) in found.items()} | {"score_explanation": explained})


def evaluate(opps: DataFrame, config: Config = Config()) -> DataFrame:
    """component_scores with opportunity_score, recommendation, primary_strategy, recommended_quantity, prices, profit and
    return, time horizons, missing_information, blocking_reasons and decision_summary.

    The weighted score loses a share of the risk and is capped by the confidence; rumors, complete-set prices, low
    confidence and high risk cap the recommendation. The input's own target_buy_price is a last resort.
    """
    df = component_scores(opps, config)
    w, col = config.weights, lambda k: F.col(f"{k}_score")
    base = F.greatest(col("flip"), col("hold")) * w["monetization"]
    for k in ("collector", "scarcity", "demand", "acquisition", "hype"):
        base = base + col(k) * w[k]
    df = df.withColumn("opportunity_score", _clamped(F.least(base - col("risk") * config.risk_penalty, col("confidence") + config.confidence_margin)))
    tier = F.lit(6)
    for i in range(5, -1, -1):
        tier = F.when(F.col("opportunity_score") >= config.thresholds[i], i).otherwise(tier)
    rank = {name: i for i, name in enumerate(RECOMMENDATIONS)}
    df = df.withColumn("__0", tier)
    df = df.withColumn("__1", F.when(F.col("rumored"), F.greatest("__0", F.lit(rank[config.rumor_cap]))).otherwise(F.col("__0")))
    df = df.withColumn("__2", F.when(F.col("complete_set_mismatch"), F.greatest("__1", F.lit(rank[config.set_cap]))).otherwise(F.col("__1")))
    df = df.withColumn("__3", F.when((F.col("__2") <= 3) & (col("confidence") < config.least_confidence), rank["WATCH"]).otherwise(F.col("__2")))
    df = df.withColumn("__4", F.when(col("risk") >= config.most_risk, rank["AVOID"]).otherwise(F.col("__3")))
    moved = lambda a, b, text: F.when(F.col(a) != F.col(b), text)
    blocking = F.array_compact(F.array(moved("__0", "__1", "Rumored release"), moved("__1", "__2", "Resale evidence is about a complete set"), moved("__2", "__3", "Confidence too low to buy"), moved("__3", "__4", "Risk too high")))
    name = F.element_at(F.array(*map(F.lit, RECOMMENDATIONS)), F.col("__4") + 1)
    flip, hold, collect = (F.when(col(k) >= least, col(k)) for k, least in (("flip", 40), ("hold", 30), ("collector", 35)))
    best = F.greatest(flip, hold, collect)
    flips, holds = F.when(flip >= 70, "FLIP_NOW").otherwise("QUICK_FLIP"), F.when(hold >= 70, "HOLD_LONG").when(hold >= 50, "HOLD_MEDIUM").otherwise("HOLD_SHORT")
    strategy = F.when(F.col("__4") == rank["AVOID"], "AVOID").when(best.isNull(), "WATCH").when(flip == best, flips).when(hold == best, holds).otherwise("COLLECT_ONLY")
    amount = F.least(F.element_at(F.array(*map(F.lit, config.quantities)), F.col("__4") + 1), F.lit(config.most_quantity))
    quantity = F.when(amount == 0, 0).otherwise(F.greatest(F.lit(0), F.least(amount, F.coalesce(F.col("purchase_limit"), amount))))
    p = prices()
    df = df.withColumns({"recommendation": name, "primary_strategy": strategy, "recommended_quantity": quantity, "blocking_reasons": blocking, **p})
    buy, sell = F.col("target_buy_price"), F.col("target_sell_price")
    missing = (
        (buy.isNull(), "required spend / retail price"),
        (sell.isNull(), "resale price evidence"),
        (~_text("release_date"), "release date"),
        (~_text("status"), "availability status"),
        (_yes("limited_quantity") & F.col("stated_quantity").isNull(), "stated production quantity"),
        (~_text("source_type"), "source type"),
        (~_text("franchise"), "franchise"),
    )
    horizon = lambda names: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("primary_strategy")]
    df = df.withColumns({"estimated_profit": S.round2(sell - buy), "missing_information": F.array_compact(F.array(*(F.when(ok, what) for ok, what in missing)))})
    df = df.withColumns({
        "estimated_roi_percent": F.when(buy != 0, S.round2(F.col("estimated_profit") / buy * 100)),
        "flip_time_horizon": horizon({"FLIP_NOW": "days", "QUICK_FLIP": "1-3 weeks"}),
        "hold_time_horizon": horizon({"HOLD_SHORT": "1-3 months", "HOLD_MEDIUM": "3-9 months", "HOLD_LONG": "9+ months"}),
        "decision_summary": F.concat(F.col("recommendation"), F.lit(" ("), F.col("primary_strategy"), F.lit(") - opportunity score "), F.bround("opportunity_score", 0).cast("int").cast("string"), F.lit("/100."), F.when(F.size("blocking_reasons") > 0, F.concat(F.lit(" "), F.array_join("blocking_reasons", " "))).otherwise("")),
    })
    return df.drop("__0", "__1", "__2", "__3", "__4")


def card_labels(evaluated: DataFrame, most: int = 3) -> DataFrame:
    """Add market_strength, confidence_label, market_trend, unit_scope and demand_tags (at most `most`, in the order of
    their rules) to the rows of evaluate()."""
    price = F.coalesce("recent_sold_price", "current_market_price", "estimated_market_price")
    blend = 0.4 * F.col("demand_score") + 0.3 * F.col("scarcity_score") + 0.3 * (100 - F.col("risk_score"))
    strength = F.when(price.isNull() & (F.col("demand_score") <= 0) & (F.col("scarcity_score") <= 0), "UNKNOWN").when(blend >= 65, "STRONG").when(blend >= 35, "MEDIUM").otherwise("WEAK")
    d = F.col("demand_direction")
    trend = F.when(d.isin("SURGING", "RISING"), "RISING").when(d == "FLAT", "STABLE").when(d == "FALLING", "FALLING").otherwise("UNKNOWN")
    rules = (
        (F.col("complete_set_mismatch"), "Complete set"),
        (F.col("sold_listing_count") < 3, "Few confirmed sales"),
        (_status("restocked"), "Restock risk"),
        (_yes("event_exclusive", "convention_exclusive"), "Event exclusive"),
        (_yes("tournament_exclusive"), "Player demand"),
        (_yes("exclusive_promo"), "Limited promo"),
        (_yes("limited_quantity") | (F.col("stated_quantity") <= 500), "Low supply"),
        ((F.col("source_type") == "OFFICIAL") & _yes("retailer_exclusive"), "Official exclusive"),
        (_yes("sealed_product"), "Sealed demand"),
        (_text("artist_name"), "Artist demand"),
        (F.size(F.coalesce("character_names", F.array().cast("array<string>"))) > 0, "Popular character"),
        (_text("sellout_speed"), "Fast sell-through"),
        (F.when(F.col("recent_sold_price") > 0, F.col("current_market_price") / F.col("recent_sold_price") >= 1.3), "High asking prices"),
        (F.col("hype_score") >= 60, "Hype-driven"),
    )
    tags = F.slice(F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), tag) for ok, tag in rules))), 1, most)
    tags = F.when((F.size(tags) == 0) & (F.col("collector_score") >= 50), F.array(F.lit("Collector demand"))).otherwise(tags)
    sure = F.col("confidence_score")
    return evaluated.withColumns({
        "market_strength": strength,
        "confidence_label": F.when(sure >= 70, "HIGH").when(sure >= 40, "MEDIUM").otherwise("LOW"),
        "market_trend": trend,
        "unit_scope": F.when(is_complete_set() | resale_is_complete_set(), "Complete set").otherwise("Single item"),
        "demand_tags": tags,
    })


def money(c: Column) -> Column:
    """$1,234 or $1,234.50; Unknown for null."""
    whole = F.format_string("$%,d", c.cast("long"))
    return F.when(c.isNull(), "Unknown").when(c == F.floor(c), whole).otherwise(F.format_string("$%,.2f", c))


def summary_text(evaluated: DataFrame) -> Column:
    """The report of an opportunity as lines: title, recommendation, strategy, spend, resale, upside, scores, reasons,
    risks and what is missing. Of resale prices sold, market, peak and estimate count in this order."""
    have = evaluated.columns
    col = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    left = F.upper(F.coalesce(F.when(_text("franchise"), F.col("franchise")), F.when(_text("brand"), F.col("brand")), F.lit("UNKNOWN")))
    title = (
        F.when(_text("collaboration_partner"), F.concat(left, F.lit(" × "), F.upper("collaboration_partner"), F.when(_yes("exclusive_promo"), " PROMO").otherwise("")))
        .when(_text("product_name"), F.concat(left, F.lit(" — "), F.upper("product_name")))
        .otherwise(left)
    )
    spend = F.coalesce("required_spend", "retail_price")
    seen = F.coalesce("recent_sold_price", "current_market_price", "peak_market_price")
    resale, guessed = F.coalesce(seen, F.col("estimated_market_price")), seen.isNull() & F.col("estimated_market_price").isNotNull()
    mark = F.when(guessed, " (estimated)").otherwise("")
    profit = F.coalesce(col("estimated_profit", "double"), S.round2(resale - spend))
    score = lambda c: F.coalesce(F.concat(F.bround(col(c, "double"), 0).cast("int").cast("string"), F.lit("/100")), F.lit("Unknown"))
    human = lambda c: F.coalesce(F.replace(F.when(col(c) != "", col(c)), F.lit("_"), F.lit(" ")), F.lit("UNKNOWN"))
    block = lambda head, value: F.array(F.lit(""), F.lit(head), value)
    bullets = lambda head, items: F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.concat(F.array(F.lit(""), F.lit(head)), F.transform(items, lambda x: F.concat(F.lit("- "), x)))).otherwise(F.array().cast("array<string>"))
    checks = ((spend.isNull(), "retail price or required spend"), (resale.isNull(), "market or resale price"), (F.col("release_date").isNull(), "release date"), (col("collector_score", "double").isNull(), "collector score"))
    lines = F.concat(
        F.array(title),
        F.when(_status("rumored"), F.array(F.lit("(RUMORED - not yet confirmed)"))).otherwise(F.array().cast("array<string>")),
        block("Recommendation:", human("recommendation")),
        block("Primary strategy:", human("primary_strategy")),
        block("Retail or required spend:", money(spend)),
        block("Observed or estimated resale:", F.concat(money(resale), mark)),
        block("Estimated gross upside:", F.concat(money(profit), F.when(profit.isNotNull(), mark).otherwise(""))),
        block("Collector Score:", score("collector_score")),
        block("Flip Score:", score("flip_score")),
        block("Hold Score:", score("hold_score")),
        bullets("Why it matters:", F.col("catalyst_signals")),
        bullets("Risks:", F.col("risks")),
        bullets("Missing information:", F.array_compact(F.array(*(F.when(ok, what) for ok, what in checks)))),
    )
    return F.array_join(lines, "\n")
