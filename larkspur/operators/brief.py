"""Runs of stages that fail on their own, and the daily brief composed of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import boards, cards, changes
from larkspur.sources.tables import cut

#: Rows of the sections: fixed values.
URGENT, OVERALL, EACH = 15, 15, 10


def run_stages(spark: SparkSession, run_id: str, stages: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of the stages that ended, by name, and a row for each stage: run_id, stage, items and error.

    Each stage is written to the shared folder before the next begins, so one that fails, when it is planned or in a task,
    costs no other; its error is the first line of the message. changes.scan_report gives the run's status.
    """
    tables, rows = {}, []
    for name, stage in stages.items():
        try:
            found = cut(stage())
            rows.append((run_id, name, found.count(), None))
            tables[name] = found
        except Exception as failed:  # what a stage raises is its result here
            rows.append((run_id, name, None, f"{type(failed).__name__}: {str(failed).strip().splitlines()[0] if str(failed).strip() else ''}"))
    return tables, spark.createDataFrame(rows, "run_id string, stage string, items long, error string")


def _listed(rows: DataFrame, item: str, score: str) -> DataFrame:
    """place (from 1), item and score of the rows of a sorted table with a limit, which lie in one partition."""
    each = rows.agg(F.collect_list(F.struct(F.col(item).cast("string").alias("item"), F.col(score).cast("int").alias("score"))).alias("r"))
    return each.select(F.posexplode("r").alias("at", "r")).select((F.col("at") + 1).alias("place"), "r.item", "r.score")


def _action_rows(alerts: DataFrame, board: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Urgent alerts and board rows in the shape of cards.action_queue; both are told by the product."""
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}
    a = alerts.select(F.col("product_key").cast("string").alias("action_key"), F.col("product_key").cast("long").alias("seq"), "priority", F.col("alert_score").cast("int").alias("score"), "action", F.col("event").alias("reason"), F.lit(None).cast("double").alias("retail_price"))
    b = board.select(F.col("seq").cast("string").alias("action_key"), F.col("seq").cast("long").alias("seq"), F.col("opportunity_tier").alias("priority"), F.col("opportunity_score").cast("int").alias("score"), F.col("recommended_action").alias("action"), F.col("strategy").alias("reason"), F.col("retail_price").cast("double").alias("retail_price"))
    empty = none("title", "availability", "url")
    return a.withColumns(empty), b.withColumns(empty)


def brief_stages(catalog: DataFrame, items: DataFrame, alerts: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """The sections of the daily brief as stages, each giving place, item and score.

    urgent_alerts (15 active alerts), top_overall (15 of the board), top_flips, top_holds and top_sleepers (10 each),
    category_leaders (the best of each category, all at place 1), action_queue (urgent alerts and top rows merged),
    data_quality (rows of the catalog and completeness) and summary (seven counts: item names one, score is its number).
    items are the board's, with a strategy; alerts are scored ones; catalog has the core fields of cards.data_quality.
    """
    urgent, overall = (lambda: changes.rank_alerts(alerts, URGENT)), (lambda: boards.score_items(items).orderBy(*boards._falling(boards.BOARD_ORDER)).limit(OVERALL))

    def leaders() -> DataFrame:
        best = boards.top_per_category(items, 1).where("category is not null")
        return best.select(F.lit(1).alias("place"), F.col("seq").cast("string").alias("item"), F.col("opportunity_score").cast("int").alias("score"))

    def queue() -> DataFrame:
        return _listed(cards.action_queue(*_action_rows(urgent(), overall())), "action_key", "score")

    def quality() -> DataFrame:
        return cards.data_quality(catalog).select(F.lit(1).alias("place"), F.col("total").cast("string").alias("item"), F.col("completeness_score").cast("int").alias("score"))

    def summary() -> DataFrame:
        tiers = {f"{t.lower()}_count": F.count_if(F.col("opportunity_tier") == t) for t in ("CRITICAL", "HIGH", "MEDIUM", "WATCH")}
        counts = ((boards.score_items(items), 2, {"ranked_count": F.count("*")}), (catalog, 1, {"catalog_count": F.count("*")}), (alerts, 3, {"active_alert_count": F.count("*")}), (boards.score_items(items), 4, tiers))
        rows = []
        for table, place, named in counts:
            one = table.agg(*(c.alias(n) for n, c in named.items()))
            each = F.array(*(F.struct(F.lit(place + i).alias("place"), F.lit(n).alias("item"), F.col(n).cast("int").alias("score")) for i, n in enumerate(named)))
            rows.append(one.select(F.explode(each).alias("r")).select("r.*"))
        return reduce(DataFrame.unionByName, rows)

    top = lambda score: lambda: _listed(boards.top_by_score(items, score, EACH), "seq", score)
    return {
        "summary": summary,
        "action_queue": queue,
        "urgent_alerts": lambda: _listed(urgent(), "product_key", "alert_score"),
        "top_overall": lambda: _listed(overall(), "seq", "opportunity_score"),
        "top_flips": top("flip_score"),
        "top_holds": top("hold_score"),
        "top_sleepers": top("sleeper_score"),
        "category_leaders": leaders,
        "data_quality": quality,
    }


def daily_brief(spark: SparkSession, run_id: str, catalog: DataFrame, items: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(section, place, item, score) of all sections that could be made, and the report of run_stages."""
    tables, report = run_stages(spark, run_id, brief_stages(catalog, items, alerts))
    rows = spark.createDataFrame([], "section string, place int, item string, score int")
    for name, table in tables.items():
        rows = rows.unionByName(table.select(F.lit(name).alias("section"), "place", "item", "score"))
    return rows, report
