"""Ranked boards: scores, tiers, ranks and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import scores as S
from larkspur.functions import text as T

#: Weights of the opportunity score: fixed values.
WEIGHTS = {"strategy_score": 0.30, "collector_score": 0.22, "hold_score": 0.16, "flip_score": 0.16, "popularity_score": 0.10, "sleeper_score": 0.06}
BONUSES = {"limited_release": 5, "promo_included": 4, "collector_variant": 4, "sealed_product": 3}
SCARCE = ("soldout", "outofstock", "unavailable")


def best_strategy(df: DataFrame) -> DataFrame:
    """Add strategy and strategy_score: the best of flip, hold and sleeper, in this order on ties."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    flip, hold, sleeper = z("flip_score"), z("hold_score"), z("sleeper_score")
    name = F.when((flip >= hold) & (flip >= sleeper), "QUICK FLIP").when(hold >= sleeper, "LONG-TERM HOLD").otherwise("SLEEPER")
    return df.withColumns({"strategy": name, "strategy_score": F.greatest(flip, hold, sleeper)})


def action(score: Column, strategy: Column) -> Column:
    high = F.when(strategy == "QUICK FLIP", "BUY QUICKLY IF MARGIN IS CONFIRMED").when(strategy == "LONG-TERM HOLD", "PRIORITIZE FOR HOLD").otherwise("RESEARCH IMMEDIATELY")
    good = F.when(strategy == "QUICK FLIP", "CHECK STOCK AND MARKET PRICE").when(strategy == "LONG-TERM HOLD", "CONSIDER BUYING FOR HOLD").otherwise("ADD TO HIGH-PRIORITY WATCHLIST")
    return F.when(score >= 85, high).when(score >= 70, good).when(score >= 55, "MONITOR PRICE AND AVAILABILITY").otherwise("LOW-PRIORITY WATCH")


def score_items(items: DataFrame) -> DataFrame:
    """Add opportunity_score (0 to 100), opportunity_tier and recommended_action; missing scores count as 0.

    items has the columns of WEIGHTS and BONUSES, strategy and availability.
    """
    base = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    bonus = sum((F.when(F.coalesce(F.col(c), F.lit(False)), b).otherwise(0) for c, b in BONUSES.items()), F.lit(0))
    bonus = bonus + F.when(T.norm_availability(F.col("availability")).isin(*SCARCE), 4).otherwise(0)
    scored = items.withColumn("opportunity_score", S.clamp(S.half_even(base + bonus)))
    return scored.withColumns({"opportunity_tier": S.bucket(F.col("opportunity_score"), S.TIERS, "WATCH"), "recommended_action": action(F.col("opportunity_score"), F.col("strategy"))})


BOARD_ORDER = ("opportunity_score", "collector_score", "hold_score", "flip_score")


def _falling(columns: tuple[str, ...]) -> list[Column]:
    return [*(F.coalesce(F.col(c), F.lit(0)).desc() for c in columns), F.col("seq").asc()]


def money_board(items: DataFrame, top: int = 20) -> DataFrame:
    """The `top` best items with overall_rank; equal ones keep the order of seq.

    Rows beyond the top are cut in each task before any rank is given.
    """
    best = score_items(items).orderBy(*_falling(BOARD_ORDER)).limit(top)
    return best.withColumn("overall_rank", F.row_number().over(Window.orderBy(*_falling(BOARD_ORDER))))


def top_per_category(items: DataFrame, k: int = 20) -> DataFrame:
    """The k best items of each category with their rank there.

    Ranks are first given in parts of a category, by a hash of seq, so that a category that holds most rows isn't one
    task's work; only each part's k best go on.
    """
    scored = score_items(items)
    part = Window.partitionBy("category", F.pmod(F.xxhash64("seq"), F.lit(64))).orderBy(*_falling(BOARD_ORDER))
    ahead = scored.withColumn("category_rank", F.row_number().over(part)).where(F.col("category_rank") <= k)
    return ahead.withColumn("category_rank", F.row_number().over(Window.partitionBy("category").orderBy(*_falling(BOARD_ORDER)))).where(F.col("category_rank") <= k)


def top_by_score(items: DataFrame, score: str, k: int = 10) -> DataFrame:
    """The k best items by one score, then by opportunity."""
    return score_items(items).orderBy(*_falling((score, "opportunity_score"))).limit(k)


CATALOG_ORDER = ("strategy_score", "collector_score", "hold_score", "flip_score", "popularity_score")


def catalog_top(items: DataFrame, n: int = 20, category: str | None = None) -> DataFrame:
    """The n best catalog rows, of one category if given."""
    chosen = items if category is None else items.where(F.lower(F.trim("category")) == category.strip().lower())
    return chosen.orderBy(*_falling(CATALOG_ORDER)).limit(n)


#: Ordinal ranks: fixed values.
ACTION_RANK = {"BUY": 4, "STRONG WATCH": 3, "WATCH": 2, "SKIP": 1}
LEVEL_RANK = {"VERY HIGH": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 0}


def ordinal(c: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[c], F.lit(0))


def rank_opportunities(df: DataFrame, limit: int = 10) -> DataFrame:
    """The best rows by action, return, profit, confidence, urgency and score; missing money counts as -999."""
    order = [
        ordinal(F.coalesce("decision", F.lit("WATCH")), ACTION_RANK).desc(),
        F.coalesce("roi", F.lit(-999.0)).desc(),
        F.coalesce("profit", F.lit(-999.0)).desc(),
        ordinal(F.coalesce("confidence", F.lit("UNKNOWN")), LEVEL_RANK).desc(),
        ordinal(F.coalesce("urgency", F.lit("UNKNOWN")), LEVEL_RANK).desc(),
        F.coalesce("score", F.lit(0)).desc(),
        F.col("seq").asc(),
    ]
    return df.orderBy(*order).limit(limit)


def best_candidate(candidates: DataFrame, group: str, good: Column) -> DataFrame:
    """For each group the first good row by seq, else the first row."""
    first = F.min_by(F.struct(*candidates.columns), F.struct(F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1), F.col("seq")))
    return candidates.groupBy(group).agg(first.alias("row")).select("row.*")
