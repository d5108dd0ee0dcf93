"""Card games: product classes, demand and investment scores, and release dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scores as S
from larkspur.functions import text as T

#: Profiles of games: fixed values. Rules are tried in their order; a term's points count once.
LORCANA = {
    "brand": "Disney Lorcana",
    "rules": (
        ("booster_display", ("booster display", "booster box", "display box", "24 booster packs")),
        ("booster_pack", ("booster pack",)),
        ("illumineers_trove", ("illumineer's trove", "illumineers trove", "trove")),
        ("gift_set", ("gift set", "gift box")),
        ("collection_set", ("collection starter set", "collection set", "collector's collection", "collectors collection", "curator's collection", "curators collection")),
        ("quest_box", ("illumineer's quest", "illumineers quest")),
        ("starter_deck", ("starter deck", "2-player starter set", "two-player starter set", "gateway")),
        ("promo_card", ("promo card", "promotional card", "set championship promo", "challenge promo")),
        ("playmat", ("playmat", "play mat")),
        ("accessory", ("card sleeves", "deck box", "portfolio", "binder", "lore counter", "damage dice")),
    ),
    "demand": {"enchanted": 20, "serialized": 24, "promo card": 14, "exclusive": 12, "limited": 12, "collector": 10, "curator": 10, "set championship": 14, "challenge promo": 16, "first chapter": 15, "disney100": 18, "d23": 22},
    "scarcity": {"limited edition": 16, "exclusive": 12, "while supplies last": 14, "special collection": 10, "event exclusive": 18, "tournament exclusive": 18, "online exclusive": 12},
    "risk": {"reprint": -14, "reprinted": -14, "restock": -8, "available again": -8, "mass market": -5},
    "base": {"booster_display": 34, "booster_pack": 12, "illumineers_trove": 29, "gift_set": 25, "collection_set": 30, "quest_box": 24, "starter_deck": 16, "promo_card": 30, "playmat": 16, "accessory": 8, "other": 5},
    "sealed": ("booster_display", "booster_pack", "illumineers_trove", "gift_set", "collection_set", "quest_box", "starter_deck"),
    "codes": (r"\bD23\b", r"\bDisney100\b", r"\bDisney 100\b"),
}
ONE_PIECE = {
    "brand": "One Piece Card Game",
    "rules": (
        ("booster_box", ("booster box", "booster display", "24 packs")),
        ("booster_pack", ("booster pack", "extra booster", "premium booster")),
        ("starter_deck", ("starter deck", "start deck")),
        ("double_pack", ("double pack set", "double pack")),
        ("tin_pack", ("tin pack set", "tin pack")),
        ("devil_fruits_collection", ("devil fruits collection", "devil fruit collection")),
        ("illustration_box", ("illustration box",)),
        ("premium_collection", ("premium collection", "premium card collection", "premium bandai", "premium card set")),
        ("promo_card", ("promo card", "promotion card", "tournament pack", "winner card")),
        ("accessory", ("card sleeves", "card sleeve", "playmat", "play mat", "storage box", "deck case")),
    ),
    "demand": {
        "manga rare": 24,
        "manga card": 24,
        "alternate art": 14,
        "alt art": 14,
        "leader parallel": 15,
        "special card": 13,
        "secret rare": 12,
        "promotion card": 12,
        "promo card": 12,
        "winner card": 20,
        "championship": 18,
        "anniversary": 16,
        "premium bandai": 18,
        "limited": 12,
        "exclusive": 12,
    },
    "scarcity": {"premium bandai": 18, "order limit": 12, "limit 1": 16, "limited edition": 16, "event exclusive": 18, "store exclusive": 14, "official shop exclusive": 16, "while supplies last": 14},
    "risk": {"reprint": -16, "reprinted": -16, "card the best": -5, "restock": -8, "available again": -8},
    "base": {"booster_box": 35, "booster_pack": 15, "starter_deck": 18, "double_pack": 22, "tin_pack": 23, "devil_fruits_collection": 27, "illustration_box": 25, "premium_collection": 33, "promo_card": 32, "accessory": 8, "other": 5},
    "sealed": ("booster_box", "booster_pack", "starter_deck", "double_pack", "tin_pack", "devil_fruits_collection", "illustration_box", "premium_collection"),
    "codes": (r"\bOP[- ]?\d{1,2}\b", r"\bEB[- ]?\d{1,2}\b", r"\bST[- ]?\d{1,2}\b", r"\bPRB[- ]?\d{1,2}\b", r"\bDP[- ]?\d{1,2}\b", r"\bTS[- ]?\d{1,2}\b", r"\bDF[- ]?\d{1,2}\b", r"\bP[- ]?\d{1,3}\b"),
}
PROFILES = {"lorcana": LORCANA, "one_piece": ONE_PIECE}
#: Other names of games, and terms that flag a product: fixed values.
GAME_ALIASES = {"disney_lorcana": "lorcana", "lorcana_tcg": "lorcana", "onepiece": "one_piece", "one_piece_card_game": "one_piece", "one_piece_tcg": "one_piece"}
LIMITED_TERMS = ("limited", "exclusive", "special edition", "anniversary", "while supplies last", "event exclusive", "tournament exclusive", "premium bandai")
PROMO_TERMS = ("promo card", "promotion card", "promotional card", "exclusive card", "winner card")
VARIANT_TERMS = ("enchanted", "serialized", "manga rare", "alternate art", "alt art", "parallel", "special card", "secret rare", "foil")


def game_name(c: Column) -> Column:
    """Canonical name of a game."""
    plain = T.norm_value(c)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in GAME_ALIASES.items() for x in kv))[plain], plain)


def searchable() -> Column:
    """Title and description in lower case."""
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def first_type(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Type of the first rule of which the text holds a term, else 'other'."""
    out = F.lit("other")
    for name, terms in reversed(rules):
        out = F.when(contains_any(text, terms), name).otherwise(out)
    return out


def game_codes(text: Column, patterns: Sequence[str]) -> Column:
    """Set codes by pattern and place, without repeats: upper case, one dash between letters and number."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)) for p in patterns))
    clean = lambda m: F.regexp_replace(F.replace(F.upper(F.trim(m)), F.lit(" "), F.lit("-")), "-+", "-")
    dashed = lambda c: F.regexp_replace(c, r"^(OP|EB|ST|PRB|DP|TS|DF|P)(\d+)$", "$1-$2")
    return F.array_distinct(F.transform(found, lambda m: dashed(clean(m))))


def classify_products(items: DataFrame, game: str) -> DataFrame:
    """Add product_type, matched_terms, set_codes, sealed_product, limited_release, promo_included and collector_variant
    by a game's profile, from title and description (nulls are empty)."""
    p, text = PROFILES[game], searchable()
    kind = first_type(text, p["rules"])
    matched = F.array().cast("array<string>")
    for name, terms in p["rules"]:
        matched = F.when(kind == name, S.hits(text, terms)).otherwise(matched)
    raw = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    return items.withColumns({
        "product_type": kind,
        "matched_terms": matched,
        "set_codes": game_codes(raw, p["codes"]),
        "sealed_product": kind.isin(*p["sealed"]),
        "limited_release": contains_any(text, LIMITED_TERMS),
        "promo_included": contains_any(text, PROMO_TERMS),
        "collector_variant": contains_any(text, VARIANT_TERMS),
    })


#: Levels of scores: fixed values.
SCORE_LEVELS = ((85, "ELITE"), (70, "VERY HIGH"), (55, "HIGH"), (35, "MEDIUM"))
STRATEGIES = ("QUICK FLIP", "LONG-TERM HOLD", "SLEEPER WATCH")


def _flag(name: str, points: int) -> Column:
    return F.when(F.coalesce(F.col(name), F.lit(False)), points).otherwise(0)


def _share(score: Column, rate: float) -> Column:
    return S.half_even(score.cast("double") * rate)


def _by_type(table: Mapping[str, int], otherwise: int) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.coalesce("product_type", F.lit("other"))], F.lit(otherwise))


def _best(flip: Column, hold: Column, sleeper: Column) -> dict[str, Column]:
    name = F.when((flip >= hold) & (flip >= sleeper), STRATEGIES[0]).when(hold >= sleeper, STRATEGIES[1]).otherwise(STRATEGIES[2])
    return {"strategy": name, "strategy_score": F.greatest(flip, hold, sleeper)}


def game_scores(items: DataFrame, game: str) -> DataFrame:
    """Add collector_score, popularity_score, flip_score, hold_score, sleeper_score, strategy, strategy_score and
    collector_level. items has the columns of classify_products, availability and sources (array)."""
    p, text = PROFILES[game], searchable()
    demand, scarcity, risk = (S.term_points(text, p[k]) for k in ("demand", "scarcity", "risk"))
    base = _by_type(p["base"], 5)
    scored = items.withColumn("__scarcity", scarcity).withColumn("__demand", demand)
    scored = scored.withColumn("collector_score", S.clamp(base + F.col("__demand") + F.col("__scarcity") + risk + _flag("sealed_product", 8) + _flag("promo_included", 10) + _flag("collector_variant", 10) + _flag("limited_release", 10)))
    n = F.size(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))
    seen = F.when(n >= 3, 24).when(n == 2, 15).when(n == 1, 6).otherwise(0)
    scored = scored.withColumn("popularity_score", S.clamp(F.lit(12) + seen + _share(F.greatest("__demand", F.lit(0)), 0.60) + _share(F.greatest("__scarcity", F.lit(0)), 0.35) + _flag("limited_release", 8) + _flag("promo_included", 6)))
    c, q = F.col("collector_score"), F.col("popularity_score")
    gone = F.when(T.norm_availability(F.col("availability")).isin("soldout", "outofstock", "unavailable"), 12).otherwise(0)
    quiet = F.when(q <= 30, 22).when(q <= 50, 13).when(q >= 75, -10).otherwise(0)
    scored = scored.withColumns({
        "flip_score": S.clamp(F.lit(10) + _share(c, 0.28) + _share(q, 0.42) + _flag("limited_release", 10) + _flag("promo_included", 8) + gone),
        "hold_score": S.clamp(F.lit(8) + _share(c, 0.52) + _share(F.greatest("__scarcity", F.lit(0)), 0.45) + _flag("sealed_product", 12) + _flag("collector_variant", 10) + _flag("promo_included", 8)),
        "sleeper_score": S.clamp(F.lit(10) + _share(c, 0.38) + quiet + _flag("limited_release", 9) + _flag("promo_included", 7)),
    })
    best = _best(F.col("flip_score"), F.col("hold_score"), F.col("sleeper_score"))
    return scored.withColumns(best | {"collector_level": S.bucket(c, SCORE_LEVELS, "LOW")}).drop("__scarcity", "__demand")


#: Pokémon products: fixed values.
POKEMON_RULES = (
    ("elite_trainer_box", ("elite trainer box", " etb", "etb ")),
    ("booster_box", ("booster box", "display box")),
    ("booster_bundle", ("booster bundle",)),
    ("collection_box", ("premium collection", "special collection", "ex collection", "collection box", "poster collection", "binder collection")),
    ("tin", (" tin", "tin ", "mini tin")),
    ("single_card", ("single card", "promo card")),
    ("plush", ("plush", "poké plush")),
    ("figure", ("figure", "figurine", "statue")),
    ("pin", ("pin collection", "collector pin", "enamel pin")),
    ("accessory", ("playmat", "card sleeves", "deck box", "binder", "backpack", "hat", "shirt", "hoodie")),
)
POKEMON_SEALED = ("elite_trainer_box", "booster_box", "booster_bundle", "collection_box", "tin")
POKEMON_TIERS = {"booster_box": "VERY HIGH", "elite_trainer_box": "VERY HIGH", "booster_bundle": "HIGH", "collection_box": "HIGH", "single_card": "HIGH", "tin": "MEDIUM", "plush": "MEDIUM", "figure": "MEDIUM", "pin": "LOW", "accessory": "LOW", "other": "LOW"}
POKEMON_CENTER = ("pokemon center exclusive", "pokémon center exclusive", "pokemon center edition", "pokémon center edition")
POKEMON_PROMO = ("promo card", "promo cards", "exclusive promo", "stamped promo")
POKEMON_LIMITED = ("limited", "exclusive", "anniversary", "special release")
HIGH_DEMAND = {
    "pokemon center exclusive": 18,
    "pokémon center exclusive": 18,
    "elite trainer box": 15,
    "etb": 12,
    "booster box": 15,
    "booster bundle": 12,
    "premium collection": 12,
    "special collection": 10,
    "promo card": 12,
    "promo cards": 12,
    "anniversary": 12,
    "limited": 10,
    "exclusive": 10,
    "preorder": 8,
    "pre-order": 8,
}
MEDIUM_DEMAND = {"plush": 7, "figure": 7, "collector": 7, "collection": 5, "tin": 5, "pin": 4, "booster pack": 5, "trading card game": 5, "tcg": 4}
SUPPLY_RISK = {"reprint": -15, "restock": -8, "available again": -8, "general release": -5}
POPULARITY_LEVELS = ((85, "VIRAL"), (70, "VERY HIGH"), (55, "HIGH"), (35, "MEDIUM"))
COLLECTOR_BASE = {"booster_box": 34, "elite_trainer_box": 32, "booster_bundle": 27, "collection_box": 24, "single_card": 22, "tin": 16, "plush": 18, "figure": 16, "pin": 10, "accessory": 7, "other": 5}
FLIP_BASE = {"elite_trainer_box": 18, "booster_box": 16, "booster_bundle": 18, "collection_box": 14, "single_card": 18, "tin": 8, "plush": 10, "figure": 8, "pin": 4, "accessory": 2, "other": 0}
HOLD_BASE = {"booster_box": 24, "elite_trainer_box": 22, "booster_bundle": 14, "collection_box": 15, "single_card": 12, "tin": 10, "plush": 14, "figure": 12, "pin": 7, "accessory": 4, "other": 2}
SLEEPER_BASE = {"booster_box": 7, "elite_trainer_box": 5, "booster_bundle": 9, "collection_box": 16, "single_card": 14, "tin": 18, "plush": 18, "figure": 17, "pin": 15, "accessory": 10, "other": 8}


def classify_pokemon(items: DataFrame) -> DataFrame:
    """Add product_type, sealed_product, pokemon_center_exclusive, promo_included, limited_release and collector_tier."""
    text = searchable()
    kind = first_type(text, POKEMON_RULES)
    return items.withColumns({
        "product_type": kind,
        "sealed_product": kind.isin(*POKEMON_SEALED),
        "pokemon_center_exclusive": contains_any(text, POKEMON_CENTER),
        "promo_included": contains_any(text, POKEMON_PROMO),
        "limited_release": contains_any(text, POKEMON_LIMITED),
        "collector_tier": F.create_map(*(F.lit(x) for kv in POKEMON_TIERS.items() for x in kv))[kind],
    })


def freshness(day: Column, today: Column) -> Column:
    """Points for a release date: 12, 7, 3 within 3, 14, 30 days after it; 12 and 6 within 14 and 45 days before it."""
    age = F.datediff(today, day)
    ahead = F.when(age >= -14, 12).when(age >= -45, 6).otherwise(0)
    past = F.when(age <= 3, 12).when(age <= 14, 7).when(age <= 30, 3).otherwise(0)
    return F.when(age.isNull(), 0).when(age < 0, ahead).otherwise(past)


def release_urgency(items: DataFrame, today: Column) -> DataFrame:
    """Add urgency_level and urgency_score from availability and release_date (a date)."""
    a, days = F.lower(F.coalesce("availability", F.lit(""))), F.datediff("release_date", today)
    cases = ((a.isin("soldout", "outofstock"), "VERY HIGH", 95), (days.between(0, 7), "VERY HIGH", 90), (days.between(8, 21), "HIGH", 75), (days.between(-3, -1), "HIGH", 80), (days.between(-14, -4), "MEDIUM", 55), (a == "instock", "MEDIUM", 45))
    level, score = F.lit("LOW"), F.lit(20)
    for ok, name, points in reversed(cases):
        level, score = F.when(ok, name).otherwise(level), F.when(ok, points).otherwise(score)
    return items.withColumns({"urgency_level": level, "urgency_score": score})


#: Ranks of action windows: fixed values.
WINDOW_RANK = {"RELEASE DAY": 7, "PREORDER NOW": 6, "BUY THIS WEEK": 5, "NEWLY RELEASED": 4, "MONITOR": 3, "PAST RELEASE": 2, "DATE UNKNOWN": 1}


def release_entries(items: DataFrame, today: Column) -> DataFrame:
    """Add days_until_release, action_window, entry_urgency, recommended_action and date_position (the order inside a
    window). items has release_date, availability, flip_score and collector_score; missing scores count as 0."""
    d = F.datediff("release_date", today)
    wanted = (F.coalesce("flip_score", F.lit(0)) >= 70) | (F.coalesce("collector_score", F.lit(0)) >= 70)
    gone = T.norm_availability(F.col("availability")).isin("soldout", "outofstock")
    cases = (
        (d.isNull(), "DATE UNKNOWN", 10, F.lit("CONTINUE MONITORING")),
        (d == 0, "RELEASE DAY", 100, F.lit("CHECK STOCK IMMEDIATELY")),
        (d.between(1, 3), "PREORDER NOW", 95, F.lit("CHECK PREORDERS AND PURCHASE LIMITS")),
        (d.between(4, 7), "BUY THIS WEEK", 85, F.lit("PREPARE PURCHASE PLAN")),
        (d.between(8, 21), "MONITOR", 65, F.when(wanted, "TRACK PREORDERS").otherwise("CONTINUE MONITORING")),
        (d > 21, "MONITOR", 35, F.lit("ADD TO RELEASE WATCHLIST")),
        (d >= -3, "NEWLY RELEASED", 80, F.when(gone, "CHECK SECONDARY MARKET").otherwise("CHECK REMAINING STOCK")),
        (d >= -14, "NEWLY RELEASED", 55, F.lit("REVIEW DEMAND AND AVAILABILITY")),
        (F.lit(True), "PAST RELEASE", 20, F.lit("MONITOR LONG-TERM PERFORMANCE")),
    )
    window, urgency, action = (F.lit(None).cast(t) for t in ("string", "int", "string"))
    for ok, name, points, what in reversed(cases):
        window, urgency, action = F.when(ok, name).otherwise(window), F.when(ok, points).otherwise(urgency), F.when(ok, what).otherwise(action)
    position = F.when(d.isNull(), 999_999).when(d >= 0, d).otherwise(10_000 - d)
    return items.withColumns({"days_until_release": d, "action_window": window, "entry_urgency": urgency, "recommended_action": action, "date_position": position})


def release_calendar(items: DataFrame, today: Column) -> DataFrame:
    """release_entries by window, date, urgency and collector score."""
    rank = F.create_map(*(F.lit(x) for kv in WINDOW_RANK.items() for x in kv))
    return release_entries(items, today).orderBy(rank[F.col("action_window")].desc(), "date_position", F.desc("entry_urgency"), F.coalesce("collector_score", F.lit(0)).desc())


def pokemon_popularity(items: DataFrame, today: Column) -> DataFrame:
    """Add popularity_score, popularity_level, popularity_confidence and source_count.

    items has title, description, sources (array), source, source_url, availability and release_date.
    """
    text = searchable()
    names = F.concat(F.coalesce("sources", F.array().cast("array<string>")), F.array(F.coalesce("source", F.lit("")), F.coalesce("source_url", F.lit(""))))
    names = F.array_distinct(F.filter(F.transform(names, lambda s: F.lower(F.trim(s))), lambda s: s != ""))
    df = items.withColumn("__names", names).withColumn("source_count", F.size("__names"))
    n = F.col("source_count")
    named = lambda term: F.exists("__names", lambda s: F.contains(s, F.lit(term)))
    a = F.lower(F.coalesce("availability", F.lit("")))
    fresh = freshness(F.col("release_date"), today)
    points = F.when(n >= 3, 20).when(n == 2, 12).when(n == 1, 4).otherwise(0)
    points = points + F.when(named("pokemon_center"), 12).otherwise(0) + F.when(named("pokemon_news"), 8).otherwise(0)
    terms = HIGH_DEMAND | MEDIUM_DEMAND | SUPPLY_RISK
    points = points + S.term_points(text, terms) + F.when(a == "instock", 3).when(a.isin("soldout", "outofstock"), 10).otherwise(0) + fresh
    one = lambda ok: F.when(ok, 1).otherwise(0)
    signals = one(n >= 1) + one(named("pokemon_center")) + one(named("pokemon_news")) + F.size(S.hits(text, list(terms))) + one(a.isin("instock", "soldout", "outofstock")) + one(fresh > 0)
    score = S.clamp(F.lit(10) + points)
    sure = F.when((n >= 3) & (signals >= 5), "VERY HIGH").when((n >= 2) & (signals >= 3), "HIGH").when((n >= 1) & (signals >= 2), "MEDIUM").otherwise("LOW")
    return df.withColumns({"popularity_score": score, "popularity_level": S.bucket(score, POPULARITY_LEVELS, "LOW"), "popularity_confidence": sure}).drop("__names")


def pokemon_scores(items: DataFrame, today: Column) -> DataFrame:
    """classify_pokemon, pokemon_popularity and release_urgency, then collector_score, collector_level, hold_profile,
    flip_score, hold_score, sleeper_score, strategy and strategy_score."""
    df = release_urgency(pokemon_popularity(classify_pokemon(items), today), today)
    a, u, q = F.lower(F.coalesce("availability", F.lit(""))), F.col("urgency_score"), F.col("popularity_score")
    gone, center = a.isin("soldout", "outofstock"), F.col("pokemon_center_exclusive")
    stock = F.when(gone, 12).when(a == "instock", 2).otherwise(0)
    haste = F.when(u >= 90, 10).when(u >= 70, 7).when(u >= 45, 3).otherwise(0)
    exclusive = lambda points: F.when(center, points).otherwise(0)
    df = df.withColumn("collector_score", S.clamp(_by_type(COLLECTOR_BASE, 5) + exclusive(22) + _flag("promo_included", 14) + _flag("limited_release", 12) + _flag("sealed_product", 8) + stock + haste))
    c = F.col("collector_score")
    quiet = F.when(q <= 35, 18).when(q <= 55, 10).otherwise(-8)
    df = df.withColumns({
        "collector_level": S.bucket(c, SCORE_LEVELS, "LOW"),
        "hold_profile": F.when(c >= 85, "STRONG LONG-TERM HOLD").when(F.col("product_type").isin("booster_box", "elite_trainer_box") & (c >= 65), "LONG-TERM HOLD").when(c >= 55, "SHORT-TO-MEDIUM HOLD").when(c >= 35, "QUICK FLIP OR WATCH").otherwise("LOW PRIORITY"),
        "flip_score": S.clamp(_by_type(FLIP_BASE, 0) + _share(q, 0.35) + _share(u, 0.25) + _share(c, 0.15) + F.when(gone, 12).otherwise(0) + exclusive(8)),
        "hold_score": S.clamp(_by_type(HOLD_BASE, 0) + _share(c, 0.45) + _share(q, 0.10) + _flag("sealed_product", 10) + exclusive(12) + _flag("promo_included", 8) + _flag("limited_release", 10)),
        "sleeper_score": S.clamp(_by_type(SLEEPER_BASE, 0) + _share(c, 0.35) + quiet + F.when(u <= 45, 8).otherwise(0) + _flag("limited_release", 10) + _flag("promo_included", 8)),
    })
    return df.withColumns(_best(F.col("flip_score"), F.col("hold_score"), F.col("sleeper_score")))
