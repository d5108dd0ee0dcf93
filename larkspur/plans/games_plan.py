"""Registered queries over game items, release dates and evaluated opportunities, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import evaluation, games
from larkspur.plans.views import plain, view

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL (names of tables and views in braces)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = plain(sql)
        return f

    return add


def _today() -> Column:
    return F.lit("2024-01-01").cast("date")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(terms) -> str:
    return "(" + " OR ".join(f"contains(t, {_q(x)})" for x in terms) + ")"


def _sum(weights) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(t, {_q(k)}) THEN {v} ELSE 0 END" for k, v in weights.items()) + ")"


def _first(rules) -> str:
    return "CASE " + " ".join(f"WHEN {_any(terms)} THEN '{name}'" for name, terms in rules) + " ELSE 'other' END"


def _table(table, otherwise: int) -> str:
    return "CASE product_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {otherwise} END"


_CL = lambda x: f"greatest(0, least(100, {x}))"
_RE = lambda x, r: f"CAST(round_even(CAST({x} AS DOUBLE) * CAST({r} AS DOUBLE), 0) AS INT)"
_FL = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
_NA = "replace(replace(replace(lower(trim(coalesce(availability, ''))), '_', ''), '-', ''), ' ', '')"


def _game_ctes(game: str) -> str:
    p = games.PROFILES[game]
    codes = [c.replace("{1,2}", r"\d?").replace("{1,3}", r"\d?\d?") for c in p["codes"]]  # braces name tables here
    code = "regexp_replace(regexp_replace(replace(upper(trim(m)), ' ', '-'), '-+', '-', 'g'), '^(OP|EB|ST|PRB|DP|TS|DF|P)([0-9]+)$', '\\1-\\2')"
    found = "list_concat(" * (len(codes) - 1) + f"regexp_extract_all(raw, '(?i){codes[0]}')" + "".join(f", regexp_extract_all(raw, '(?i){c}'))" for c in codes[1:])
    types = ", ".join(_q(x) for x in p["sealed"])
    return f"""g0 AS (SELECT *, concat(title, ' ', description) AS raw, lower(concat(title, ' ', description)) AS t FROM {{game_items}} WHERE category = '{game}'),
g1 AS (SELECT *, {_first(p['rules'])} AS product_type, array_to_string(list_sort(list_distinct(list_transform({found}, lambda m: {code}))), ',') AS codes,
 {_any(games.LIMITED_TERMS)} AS limited_release, {_any(games.PROMO_TERMS)} AS promo_included, {_any(games.VARIANT_TERMS)} AS collector_variant FROM g0),
g2 AS (SELECT *, product_type IN ({types}) AS sealed_product, {_sum(p['demand'])} AS dem, {_sum(p['scarcity'])} AS sca, {_sum(p['risk'])} AS rsk FROM g1),
g3 AS (SELECT *, {_CL(f"{_table(p['base'], 5)} + dem + sca + rsk + {_FL('sealed_product', 8)} + {_FL('promo_included', 10)} + {_FL('collector_variant', 10)} + {_FL('limited_release', 10)}")} AS collector_score,
 {_CL(f"12 + CASE WHEN source IS NOT NULL THEN 6 ELSE 0 END + {_RE('greatest(dem, 0)', 0.60)} + {_RE('greatest(sca, 0)', 0.35)} + {_FL('limited_release', 8)} + {_FL('promo_included', 6)}")} AS popularity_score FROM g2),
g4 AS (SELECT *, {_CL(f"10 + {_RE('collector_score', 0.28)} + {_RE('popularity_score', 0.42)} + {_FL('limited_release', 10)} + {_FL('promo_included', 8)} + CASE WHEN {_NA} IN ('soldout', 'outofstock', 'unavailable') THEN 12 ELSE 0 END")} AS flip_score,
 {_CL(f"8 + {_RE('collector_score', 0.52)} + {_RE('greatest(sca, 0)', 0.45)} + {_FL('sealed_product', 12)} + {_FL('collector_variant', 10)} + {_FL('promo_included', 8)}")} AS hold_score,
 {_CL(f"10 + {_RE('collector_score', 0.38)} + CASE WHEN popularity_score <= 30 THEN 22 WHEN popularity_score <= 50 THEN 13 WHEN popularity_score >= 75 THEN -10 ELSE 0 END + {_FL('limited_release', 9)} + {_FL('promo_included', 7)}")} AS sleeper_score FROM g3)"""


_STRATEGY = "CASE WHEN flip_score >= hold_score AND flip_score >= sleeper_score THEN 'QUICK FLIP' WHEN hold_score >= sleeper_score THEN 'LONG-TERM HOLD' ELSE 'SLEEPER WATCH' END"


def _renamed(game: str, mark: str) -> str:
    return _game_ctes(game).replace("g0", f"{mark}0").replace("g1", f"{mark}1").replace("g2", f"{mark}2").replace("g3", f"{mark}3").replace("g4", f"{mark}4")


_BOTH = f"WITH {_renamed('lorcana', 'gl')}, {_renamed('one_piece', 'go')}"


def game_items(spark: SparkSession, d: str, game: str) -> DataFrame:
    sources = F.array_compact(F.array("source"))
    return view(spark, d, "game_items").where(F.col("category") == game).withColumn("sources", sources)


def both_games(spark: SparkSession, d: str) -> DataFrame:
    parts = [games.game_scores(games.classify_products(game_items(spark, d, g), g), g) for g in games.PROFILES]
    return parts[0].unionByName(parts[1])


_POKE0 = f"""k0 AS (SELECT *, lower(concat(title, ' ', description)) AS t, lower(coalesce(availability, '')) AS a, date_diff('day', DATE '2024-01-01', release_date) AS n, list_distinct(list_filter([lower(trim(coalesce(source, ''))), lower(trim(coalesce(source_url, '')))], lambda s: s <> '')) AS names FROM {{game_items}} WHERE category = 'pokemon'),
k1 AS (SELECT *, {_first(games.POKEMON_RULES)} AS product_type, {_any(games.POKEMON_CENTER)} AS center, {_any(games.POKEMON_PROMO)} AS promo_included, {_any(games.POKEMON_LIMITED)} AS limited_release FROM k0)"""

_F9 = f"""{_BOTH}, {_POKE0} SELECT seq, product_type, codes, sealed_product, limited_release, promo_included FROM gl2
UNION ALL SELECT seq, product_type, codes, sealed_product, limited_release, promo_included FROM go2
UNION ALL SELECT seq, product_type, '' AS codes, product_type IN ('elite_trainer_box', 'booster_box', 'booster_bundle', 'collection_box', 'tin'), limited_release, promo_included FROM k1"""


@query("F9_classify", _F9)
def f9(spark: SparkSession, d: str) -> DataFrame:
    """Classes of all three games' products."""
    names = ("seq", "product_type", "codes", "sealed_product", "limited_release", "promo_included")
    parts = [games.classify_products(game_items(spark, d, g), g).withColumn("codes", F.array_join(F.array_sort("set_codes"), ",")).select(*names) for g in games.PROFILES]
    poke = games.classify_pokemon(game_items(spark, d, "pokemon")).withColumn("codes", F.lit("")).select(*names)
    return parts[0].unionByName(parts[1]).unionByName(poke)


_A21 = ", ".join(f"{c}_score" for c in ("collector", "popularity", "flip", "hold", "sleeper"))


@query("A21_game_scores", f"{_BOTH} SELECT seq, {_A21}, {_STRATEGY} AS strategy FROM gl4 UNION ALL SELECT seq, {_A21}, {_STRATEGY} FROM go4")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return both_games(spark, d).select("seq", "collector_score", "popularity_score", "flip_score", "hold_score", "sleeper_score", "strategy")


_URGENCY = "CASE WHEN a IN ('soldout', 'outofstock') THEN 95 WHEN n BETWEEN 0 AND 7 THEN 90 WHEN n BETWEEN 8 AND 21 THEN 75 WHEN n BETWEEN -3 AND -1 THEN 80 WHEN n BETWEEN -14 AND -4 THEN 55 WHEN a = 'instock' THEN 45 ELSE 20 END"
_FRESH = "CASE WHEN n IS NULL THEN 0 WHEN n > 0 THEN CASE WHEN n <= 14 THEN 12 WHEN n <= 45 THEN 6 ELSE 0 END WHEN n >= -3 THEN 12 WHEN n >= -14 THEN 7 WHEN n >= -30 THEN 3 ELSE 0 END"
_TERMS = games.HIGH_DEMAND | games.MEDIUM_DEMAND | games.SUPPLY_RISK
_A22 = f"""WITH {_POKE0},
k2 AS (SELECT *, product_type IN ('elite_trainer_box', 'booster_box', 'booster_bundle', 'collection_box', 'tin') AS sealed_product, {_URGENCY} AS u, {_CL(f"10 + CASE WHEN len(names) >= 3 THEN 20 WHEN len(names) = 2 THEN 12 WHEN len(names) = 1 THEN 4 ELSE 0 END + CASE WHEN len(list_filter(names, lambda s: contains(s, 'pokemon_center'))) > 0 THEN 12 ELSE 0 END + CASE WHEN len(list_filter(names, lambda s: contains(s, 'pokemon_news'))) > 0 THEN 8 ELSE 0 END + {_sum(_TERMS)} + CASE WHEN a = 'instock' THEN 3 WHEN a IN ('soldout', 'outofstock') THEN 10 ELSE 0 END + {_FRESH}")} AS popularity_score FROM k1),
k3 AS (SELECT *, {_CL(f"{_table(games.COLLECTOR_BASE, 5)} + {_FL('center', 22)} + {_FL('promo_included', 14)} + {_FL('limited_release', 12)} + {_FL('sealed_product', 8)} + CASE WHEN a IN ('soldout', 'outofstock') THEN 12 WHEN a = 'instock' THEN 2 ELSE 0 END + CASE WHEN u >= 90 THEN 10 WHEN u >= 70 THEN 7 WHEN u >= 45 THEN 3 ELSE 0 END")} AS collector_score FROM k2),
k4 AS (SELECT *, {_CL(f"{_table(games.FLIP_BASE, 0)} + {_RE('popularity_score', 0.35)} + {_RE('u', 0.25)} + {_RE('collector_score', 0.15)} + CASE WHEN a IN ('soldout', 'outofstock') THEN 12 ELSE 0 END + {_FL('center', 8)}")} AS flip_score,
 {_CL(f"{_table(games.HOLD_BASE, 0)} + {_RE('collector_score', 0.45)} + {_RE('popularity_score', 0.10)} + {_FL('sealed_product', 10)} + {_FL('center', 12)} + {_FL('promo_included', 8)} + {_FL('limited_release', 10)}")} AS hold_score,
 {_CL(f"{_table(games.SLEEPER_BASE, 0)} + {_RE('collector_score', 0.35)} + CASE WHEN popularity_score <= 35 THEN 18 WHEN popularity_score <= 55 THEN 10 ELSE -8 END + CASE WHEN u <= 45 THEN 8 ELSE 0 END + {_FL('limited_release', 10)} + {_FL('promo_included', 8)}")} AS sleeper_score FROM k3)
SELECT seq, {_A21}, {_STRATEGY} AS strategy FROM k4"""


@query("A22_pokemon_scores", _A22)
def a22(spark: SparkSession, d: str) -> DataFrame:
    scored = games.pokemon_scores(game_items(spark, d, "pokemon").withColumn("sources", F.lit(None).cast("array<string>")), _today())
    return scored.select("seq", "collector_score", "popularity_score", "flip_score", "hold_score", "sleeper_score", "strategy")


_DAYS = "SELECT *, lower(coalesce(availability, '')) AS a, date_diff('day', DATE '2024-01-01', release_date) AS n FROM {dated_items}"


@query("F12_release_window", f"SELECT seq, {_URGENCY} AS urgency_score, CASE WHEN a IN ('soldout', 'outofstock') OR n BETWEEN 0 AND 7 THEN 'VERY HIGH' WHEN n BETWEEN 8 AND 21 OR n BETWEEN -3 AND -1 THEN 'HIGH' WHEN n BETWEEN -14 AND -4 OR a = 'instock' THEN 'MEDIUM' ELSE 'LOW' END AS urgency_level FROM ({_DAYS})")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return games.release_urgency(view(spark, d, "dated_items"), _today()).select("seq", "urgency_score", "urgency_level")


@query("F13_freshness", f"SELECT seq, {_FRESH} AS bonus FROM ({_DAYS})")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "dated_items").select("seq", games.freshness(F.col("release_date"), _today()).alias("bonus"))


@query(
    "W6_release_calendar",
    f"""SELECT seq, n AS days, CASE WHEN n IS NULL THEN 'DATE UNKNOWN' WHEN n = 0 THEN 'RELEASE DAY' WHEN n BETWEEN 1 AND 3 THEN 'PREORDER NOW' WHEN n BETWEEN 4 AND 7 THEN 'BUY THIS WEEK' WHEN n > 7 THEN 'MONITOR' WHEN n >= -14 THEN 'NEWLY RELEASED' ELSE 'PAST RELEASE' END AS action_window,
    CASE WHEN n IS NULL THEN 10 WHEN n = 0 THEN 100 WHEN n BETWEEN 1 AND 3 THEN 95 WHEN n BETWEEN 4 AND 7 THEN 85 WHEN n BETWEEN 8 AND 21 THEN 65 WHEN n > 21 THEN 35 WHEN n >= -3 THEN 80 WHEN n >= -14 THEN 55 ELSE 20 END AS entry_urgency,
    CASE WHEN n IS NULL THEN 'CONTINUE MONITORING' WHEN n = 0 THEN 'CHECK STOCK IMMEDIATELY' WHEN n BETWEEN 1 AND 3 THEN 'CHECK PREORDERS AND PURCHASE LIMITS' WHEN n BETWEEN 4 AND 7 THEN 'PREPARE PURCHASE PLAN' WHEN n BETWEEN 8 AND 21 THEN CASE WHEN coalesce(collector_score, 0) >= 70 THEN 'TRACK PREORDERS' ELSE 'CONTINUE MONITORING' END
    WHEN n > 21 THEN 'ADD TO RELEASE WATCHLIST' WHEN n >= -3 THEN CASE WHEN {_NA} IN ('soldout', 'outofstock') THEN 'CHECK SECONDARY MARKET' ELSE 'CHECK REMAINING STOCK' END WHEN n >= -14 THEN 'REVIEW DEMAND AND AVAILABILITY' ELSE 'MONITOR LONG-TERM PERFORMANCE' END AS recommended_action,
    CASE WHEN n IS NULL THEN 999999 WHEN n >= 0 THEN n ELSE 10000 - n END AS date_position FROM ({_DAYS})""",
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    rows = games.release_calendar(view(spark, d, "dated_items").withColumn("flip_score", F.lit(None).cast("double")), _today())
    return rows.select("seq", F.col("days_until_release").alias("days"), "action_window", "entry_urgency", "recommended_action", "date_position")


_P = lambda conditions: "(" + " + ".join(f"CASE WHEN coalesce({c}, false) THEN {n} ELSE 0 END" for c, n in conditions) + ")"
_DIR = lambda up, mid, down: [("demand_direction = 'SURGING'", up), ("demand_direction = 'RISING'", mid), ("demand_direction = 'FALLING'", down)]
_IDENT = "(franchise IS NOT NULL OR collaboration_partner IS NOT NULL)"
_SCARCE = _P([
    ("stated_quantity <= 100", 25), ("stated_quantity > 100 AND stated_quantity <= 500", 18), ("stated_quantity > 500 AND stated_quantity <= 2000", 10), ("stated_quantity > 2000", 4), ("numbered", 10), ("purchase_limit > 0", 8), ("event_exclusive", 10), ("lottery_required", 12), ("status = 'sold_out'", 8),
])
_W = f"""w0 AS (SELECT *, coalesce(status, '') = 'rumored' AS rumor, coalesce(recent_sold_price, current_market_price, estimated_market_price) AS sell, coalesce(required_spend, retail_price) AS buy, set_risk AND NOT contains(lower(product_name), 'complete set') AS mism FROM {{wide}}),
w1 AS (SELECT *, CASE WHEN coalesce(buy, 0) <> 0 AND coalesce(sell, 0) <> 0 THEN sell / buy END AS ratio FROM w0),
w2 AS (SELECT *,
 {_CL('0.0 + ' + _P([('exclusive_artwork', 15), ("artist_name IS NOT NULL", 8), ('anniversary_release', 12), ('first_edition', 10), ('numbered', 8), ('event_exclusive', 10), ("source_type = 'OFFICIAL'", 7), ('collaboration_partner IS NOT NULL', 8), ('franchise IS NOT NULL', 5)]))} AS collector_score,
 {_CL('CASE WHEN ratio >= 3 THEN 25.0 WHEN ratio >= 2 THEN 18.0 WHEN ratio >= 1.5 THEN 10.0 WHEN ratio > 1 THEN 4.0 ELSE 0.0 END * CASE WHEN mism THEN 0.75 ELSE 1.0 END + ' + _P([('sellout_speed IS NOT NULL', 12), *_DIR(10, 6, -15), ('event_exclusive OR lottery_required', 6), ('limited_quantity', 8), ('purchase_limit > 0', 4), (f'NOT {_IDENT}', -8), ('rumor', -15)]))} AS flip_score,
 {_CL('0.0 + ' + _P([('sealed_product', 10), ('first_edition', 10), ('anniversary_release', 8), ('exclusive_artwork', 8), ('stated_quantity <= 1000', 10), ('stated_quantity > 1000', 3), ('event_exclusive', 8), ('lottery_required', 6), ("demand_direction = 'FALLING'", -10), ('NOT (limited_quantity OR numbered OR event_exclusive OR coalesce(stated_quantity, 0) <> 0)', -10)]))} AS hold_score,
 {_CL(f'0.0 + {_SCARCE} + CASE WHEN limited_quantity AND {_SCARCE} = 0 THEN 5 ELSE 0 END')} AS scarcity_score,
 {_CL('CASE WHEN sold_listing_count IS NOT NULL THEN least(greatest(sold_listing_count / 5, 0.0), 15.0) ELSE 0.0 END + ' + _P([('sellout_speed IS NOT NULL', 15), *_DIR(20, 10, -15)]))} AS demand_score,
 {_CL('0.0 + ' + _P([('collaboration_partner IS NOT NULL', 15), ('sellout_speed IS NOT NULL', 10), ("demand_direction = 'SURGING'", 10), ('event_exclusive', 5)]))} AS hype_score,
 {_CL('100.0 + ' + _P([('lottery_required', -20), ('purchase_limit = 1', -5), ('buy >= 500', -20), ('buy >= 100 AND buy < 500', -10), ('online_available', 10)]))} AS acquisition_score,
 {_CL('10.0 + ' + _P([('rumor', 30), (f'NOT {_IDENT}', 10), ('mism', 25), ('recent_sold_price IS NULL AND current_market_price IS NULL AND estimated_market_price IS NOT NULL', 10), ("demand_direction = 'FALLING'", 15)]))} AS risk_score,
 {_CL("40.0 + CASE source_type WHEN 'OFFICIAL' THEN 25 WHEN 'PRESS_RELEASE' THEN 15 WHEN 'RETAILER' THEN 15 WHEN 'NEWS' THEN 8 WHEN 'EVENT' THEN 8 WHEN 'COMMUNITY' THEN 0 WHEN 'MARKETPLACE' THEN 0 ELSE -10 END + " + _P([('franchise IS NOT NULL AND collaboration_partner IS NOT NULL', 10), ('franchise IS NULL OR collaboration_partner IS NULL', 5), ('buy IS NOT NULL', 8), ('recent_sold_price IS NOT NULL OR current_market_price IS NOT NULL', 12), ('recent_sold_price IS NULL AND current_market_price IS NULL AND estimated_market_price IS NOT NULL', 4), ('mism', -15), ('rumor', -15), ('release_date IS NULL AND status IS NULL', -8)]))} AS confidence_score FROM w1),
w3 AS (SELECT *, {_CL('least(greatest(flip_score, hold_score) * 0.35 + collector_score * 0.10 + scarcity_score * 0.12 + demand_score * 0.13 + acquisition_score * 0.15 + hype_score * 0.15 - risk_score * 0.3, confidence_score + 15.0)')} AS opportunity_score FROM w2),
w4 AS (SELECT *, CASE WHEN opportunity_score >= 58 THEN 0 WHEN opportunity_score >= 46 THEN 1 WHEN opportunity_score >= 34 THEN 2 WHEN opportunity_score >= 22 THEN 3 WHEN opportunity_score >= 13 THEN 4 WHEN opportunity_score >= 5 THEN 5 ELSE 6 END AS r0 FROM w3),
w5 AS (SELECT *, greatest(r0, CASE WHEN rumor THEN 4 ELSE 0 END, CASE WHEN mism THEN 1 ELSE 0 END) AS r1 FROM w4),
w6 AS (SELECT *, CASE WHEN risk_score >= 80 THEN 6 WHEN r1 <= 3 AND confidence_score < 35 THEN 4 ELSE r1 END AS r, greatest(CASE WHEN flip_score >= 40 THEN flip_score END, CASE WHEN hold_score >= 30 THEN hold_score END, CASE WHEN collector_score >= 35 THEN collector_score END) AS best FROM w5)"""
_R6 = lambda c: f"round({c}, 6) AS {c}"
_SCORES = [f"{s}_score" for s in evaluation.SCORES]


def wide(spark: SparkSession, d: str) -> DataFrame:
    risks = F.when(F.col("set_risk"), F.array(F.lit("Price of a complete set"))).otherwise(F.array().cast("array<string>"))
    return view(spark, d, "wide").withColumn("risks", risks)


@query("A19_component_scores", f"WITH {_W} SELECT seq, {', '.join(map(_R6, _SCORES))} FROM w2")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.component_scores(wide(spark, d)).select("seq", *(F.round(c, 6).alias(c) for c in _SCORES))


@query(
    "A20_evaluate",
    f"""WITH {_W} SELECT seq, round(opportunity_score, 6) AS opportunity_score, ['CRITICAL_BUY', 'STRONG_BUY', 'BUY', 'CONDITIONAL_BUY', 'WATCH', 'SKIP', 'AVOID'][r + 1] AS recommendation,
    CASE WHEN r = 6 THEN 'AVOID' WHEN best IS NULL THEN 'WATCH' WHEN flip_score >= 40 AND flip_score = best THEN CASE WHEN flip_score >= 70 THEN 'FLIP_NOW' ELSE 'QUICK_FLIP' END WHEN hold_score >= 30 AND hold_score = best THEN CASE WHEN hold_score >= 70 THEN 'HOLD_LONG' WHEN hold_score >= 50 THEN 'HOLD_MEDIUM' ELSE 'HOLD_SHORT' END ELSE 'COLLECT_ONLY' END AS primary_strategy,
    CASE WHEN r > 3 THEN 0 ELSE greatest(0, least([3, 2, 2, 1][r + 1], coalesce(purchase_limit, 3))) END AS recommended_quantity, floor((sell - buy) * 100 + 0.5) / 100 AS estimated_profit,
    concat_ws(',', CASE WHEN buy IS NULL THEN 'required spend / retail price' END, CASE WHEN sell IS NULL THEN 'resale price evidence' END, CASE WHEN release_date IS NULL THEN 'release date' END, CASE WHEN status IS NULL THEN 'availability status' END, CASE WHEN limited_quantity AND stated_quantity IS NULL THEN 'stated production quantity' END, CASE WHEN source_type IS NULL THEN 'source type' END, CASE WHEN franchise IS NULL THEN 'franchise' END) AS missing FROM w6""",
)
def a20(spark: SparkSession, d: str) -> DataFrame:
    e = evaluation.evaluate(wide(spark, d))
    return e.select("seq", F.round("opportunity_score", 6).alias("opportunity_score"), "recommendation", "primary_strategy", "recommended_quantity", "estimated_profit", F.array_join("missing_information", ",").alias("missing"))


@query(
    "A26_card_tags",
    f"""WITH {_W}, c AS (SELECT *, 0.4 * demand_score + 0.3 * scarcity_score + 0.3 * (100 - risk_score) AS blend, list_filter([CASE WHEN mism THEN 'Complete set' END, CASE WHEN sold_listing_count < 3 THEN 'Few confirmed sales' END, CASE WHEN status = 'restocked' THEN 'Restock risk' END, CASE WHEN event_exclusive THEN 'Event exclusive' END, CASE WHEN limited_quantity OR stated_quantity <= 500 THEN 'Low supply' END,
    CASE WHEN sealed_product THEN 'Sealed demand' END, CASE WHEN artist_name IS NOT NULL THEN 'Artist demand' END, CASE WHEN sellout_speed IS NOT NULL THEN 'Fast sell-through' END, CASE WHEN recent_sold_price > 0 AND current_market_price / recent_sold_price >= 1.3 THEN 'High asking prices' END, CASE WHEN hype_score >= 60 THEN 'Hype-driven' END], lambda x: x IS NOT NULL) AS tags FROM w2)
    SELECT seq, CASE WHEN sell IS NULL AND demand_score <= 0 AND scarcity_score <= 0 THEN 'UNKNOWN' WHEN blend >= 65 THEN 'STRONG' WHEN blend >= 35 THEN 'MEDIUM' ELSE 'WEAK' END AS market_strength, CASE WHEN confidence_score >= 70 THEN 'HIGH' WHEN confidence_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_label,
    CASE WHEN demand_direction IN ('SURGING', 'RISING') THEN 'RISING' WHEN demand_direction = 'FLAT' THEN 'STABLE' WHEN demand_direction = 'FALLING' THEN 'FALLING' ELSE 'UNKNOWN' END AS market_trend, CASE WHEN len(tags) = 0 AND collector_score >= 50 THEN 'Collector demand' ELSE array_to_string(tags[1:3], ',') END AS tags FROM c""",
)
def a26(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.card_labels(evaluation.component_scores(wide(spark, d))).select("seq", "market_strength", "confidence_label", "market_trend", F.array_join("demand_tags", ",").alias("tags"))


@query("F26_summary_text")
def f26(spark: SparkSession, d: str) -> DataFrame:
    e = evaluation.evaluate(wide(spark, d))
    return e.select("seq", evaluation.summary_text(e).alias("summary"))
