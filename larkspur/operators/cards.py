"""Views for people: cards, tags, saved items, calendars, queues, data quality and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scores as S


def card_view(cards: DataFrame, overrides: DataFrame, notes: DataFrame, links: DataFrame, saved: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Cards with overrides of `fields` winning, the number of notes and links and whether they are saved.

    Each side is brought to one row for each key first: the override with the highest seq, counts, distinct keys.
    """
    latest = overrides.groupBy(key).agg(*(F.max_by(f, "seq").alias(f"o_{f}") for f in fields))
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    joined = cards.join(latest, key, "left").join(count(notes, "n_notes"), key, "left").join(count(links, "n_links"), key, "left").join(saved.select(key).distinct().withColumn("__saved", F.lit(True)), key, "left")
    rest = [c for c in cards.columns if c not in fields]
    return joined.select(*rest, *(F.coalesce(f"o_{f}", f).alias(f) for f in fields), F.coalesce("n_notes", F.lit(0)).alias("n_notes"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("__saved", F.lit(False)).alias("saved"))


def saved_items_view(saved: DataFrame, cards: DataFrame, key: str, search: str | None = None, status: str | None = None) -> DataFrame:
    """Saved items: linked ones with the live name and status, others with their own; filtered by text and status.

    saved has saved_id, `key` (null for manual items), name, status; cards has `key`, name, status.
    """
    live = cards.select(key, F.col("name").alias("live_name"), F.col("status").alias("live_status"))
    out = saved.join(live, key, "left").select("saved_id", key, F.coalesce("live_name", "name").alias("name"), F.coalesce("live_status", "status").alias("status"), F.col("live_name").isNotNull().alias("linked"))
    if search:
        out = out.where(F.contains(F.lower("name"), F.lit(search.lower())))
    return out if status is None else out.where(F.col("status") == status)


#: Ranks of priorities: fixed values.
PRIORITY = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "WATCH": 0, "IGNORE": 0}
ACTION_FIELDS = ("title", "action", "reason", "retail_price", "availability", "url")


def _filled(c: str, kind: str) -> Column:
    return F.col(c).isNotNull() & ((F.col(c) != "") if kind == "string" else (F.col(c) != 0))


def action_queue(alerts: DataFrame, board: DataFrame, k: int = 20) -> DataFrame:
    """The k most urgent actions: CRITICAL and HIGH alerts and board rows, merged by action_key.

    Both have action_key, seq, priority, score and ACTION_FIELDS. The row of the highest priority leads (of equal ones an
    alert, then the smallest seq) and the others fill what it lacks in the same order; an alert's action and reason win;
    the score is the highest. Equal entries stand in the order in which their keys came first. Rows without a key are
    left out.
    """
    both = alerts.withColumn("k", F.lit(0)).unionByName(board.withColumn("k", F.lit(1))).where(F.col("priority").isin("CRITICAL", "HIGH") & F.col("action_key").isNotNull())
    kinds = {f.name: f.dataType.typeName() for f in both.schema.fields}
    both = both.withColumn("r", F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[F.col("priority")])
    order = F.struct(-F.col("r"), "k", "seq")
    by_alert = lambda c: F.min_by(F.when(F.col("k") == 0, F.col(c)), F.when((F.col("k") == 0) & _filled(c, kinds[c]), F.col("seq")))
    merged = both.groupBy("action_key").agg(
        F.max("r").alias("r"),
        F.max(F.coalesce("score", F.lit(0))).alias("score"),
        F.min(F.struct("k", "seq")).alias("first"),
        *(F.min_by(c, F.when(_filled(c, kinds[c]), order)).alias(c) for c in ACTION_FIELDS),
        by_alert("action").alias("alert_action"),
        by_alert("reason").alias("alert_reason"),
    )
    merged = merged.withColumns({"action": F.coalesce("alert_action", "action"), "reason": F.coalesce("alert_reason", "reason"), "source": F.when(F.col("first.k") == 0, "alert").otherwise("money_board"), "priority": F.when(F.col("r") == 4, "CRITICAL").otherwise("HIGH")})
    return merged.orderBy(F.desc("r"), F.desc("score"), "first").limit(k).select("action_key", "priority", "score", *ACTION_FIELDS, "source")


#: Fields whose presence makes a catalog row complete: fixed values.
CORE_FIELDS = ("retail_price", "availability", "release_date", "image_url")


def _missing(items: DataFrame) -> dict[str, Column]:
    kinds = {f.name: f.dataType.typeName() for f in items.schema.fields}
    return {c: F.col(c).isNull() | ((F.col(c) == "") if kinds[c] == "string" else F.lit(False)) for c in CORE_FIELDS}


def data_quality(items: DataFrame) -> DataFrame:
    """One row on a catalog: rows, how many know each core field, how many know all, and the share of known fields in
    percent (halves to even; 0 without rows)."""
    gaps = _missing(items)
    known = {c: F.count_if(~g) for c, g in gaps.items()}
    whole = ~(gaps["retail_price"] | gaps["availability"] | gaps["release_date"] | gaps["image_url"])
    counted = items.agg(F.count("*").alias("total"), *(v.alias(f"known_{c}_count") for c, v in known.items()), F.count_if(whole).alias("complete_core_count"))
    fields = sum((F.col(f"known_{c}_count") for c in CORE_FIELDS), F.lit(0))
    return counted.withColumn("completeness_score", F.when(F.col("total") > 0, F.bround(fields / (F.col("total") * 4) * 100, 0)).otherwise(0).cast("int"))


def missing_data(items: DataFrame, k: int = 20) -> DataFrame:
    """The k rows (seq, title, opportunity_score, missing) that lack core fields, by score, then the fewest gaps, then seq."""
    gaps = F.array_compact(F.array(*(F.when(g, c) for c, g in _missing(items).items())))
    rows = items.select("seq", "title", F.coalesce("opportunity_score", F.lit(0)).alias("opportunity_score"), gaps.alias("missing")).where(F.size("missing") > 0)
    return rows.orderBy(F.desc("opportunity_score"), F.size("missing"), "seq").limit(k)


#: Trust in sources: fixed values.
TRUST = {"pokemon_center_new_releases": 25, "pokemon_center_tcg": 25, "pokemon_news": 20, "pokemon_tcg_gallery": 20}
CONSENSUS_LEVELS = ((85, "VERY HIGH"), (70, "HIGH"), (50, "MEDIUM"))


def item_quality(items: DataFrame) -> Column:
    """How much an item says: points for each field that is there; fields that the table lacks give none."""
    kinds = {f.name: f.dataType.typeName() for f in items.schema.fields}
    points = {"sku": 25, "retail_price": 20, "release_date": 15, "availability": 10, "image_url": 8}
    there = lambda c: F.col(c).isNotNull() & ((F.col(c) != "") if kinds[c] == "string" else F.lit(True))
    total = sum((F.when(there(c), n).otherwise(0) for c, n in points.items() if c in kinds), F.lit(0))
    if "description" in kinds:
        total = total + F.least(F.lit(10), F.floor(F.length(F.coalesce("description", F.lit(""))) / 50)).cast("int")
    if "discovery_method" in kinds:
        total = total + F.when(F.col("discovery_method") == "structured_json", 12).otherwise(0)
    return total


def consensus(items: DataFrame, key: str, order: str, fields: Sequence[str], trust: Mapping[str, int] = TRUST) -> DataFrame:
    """One record for each group of items (key, order, source, sources, description and `fields`).

    The item that says most leads (the earliest of equal ones), the others fill what it lacks in their order; the longest
    description wins, the leader's among equals. sources are distinct, in the order of items. The score is 10, the trust
    in each source (5 for an unknown one) and 8, 15 or 20 for two, three or more items.
    """
    kinds = {f.name: f.dataType.typeName() for f in items.schema.fields}
    there = lambda c: F.col(c).isNotNull() & ((F.col(c) != "") if kinds[c] == "string" else F.lit(True))
    said = F.coalesce("description", F.lit("")) != ""
    lead = F.struct(item_quality(items).alias("q"), (-F.col(order)).alias("o"))
    merged = items.groupBy(key).agg(
        F.max_by(F.struct(*fields, "description"), lead).alias("lead"),
        *(F.min_by(c, F.when(there(c), F.col(order))).alias(f"any_{c}") for c in fields),
        F.max_by("description", F.when(said, F.struct(F.length("description"), -F.col(order)))).alias("longest"),
        F.count("*").alias("confirmation_count"),
    )
    named = F.filter(F.concat(F.array("source"), F.coalesce("sources", F.array().cast("array<string>"))), lambda s: F.coalesce(s, F.lit("")) != "")
    each = items.select(key, F.col(order).alias("o"), F.posexplode(named).alias("at", "s")).groupBy(key, "s").agg(F.min(F.struct("o", "at")).alias("first"))
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in trust.items() for x in kv))[F.col("s")], F.lit(5))
    sources = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "s"))), lambda e: e["s"]).alias("sources"), F.sum(weight).alias("trust"))
    joined = merged.join(sources, key, "left")
    n, m = F.col("confirmation_count"), F.coalesce(F.size("sources"), F.lit(0))
    score = S.clamp(F.lit(10) + F.coalesce("trust", F.lit(0)) + F.when(n >= 4, 20).when(n == 3, 15).when(n == 2, 8).otherwise(0)).cast("int")
    sure = F.when((m >= 3) & (n >= 3), "VERY HIGH").when((m >= 2) & (n >= 2), "HIGH").when(m >= 1, "MEDIUM").otherwise("LOW")
    own = lambda c: F.when(F.col(f"lead.{c}").isNotNull() & ((F.col(f"lead.{c}") != "") if kinds[c] == "string" else F.lit(True)), F.col(f"lead.{c}"))
    description = F.when(F.length("lead.description") >= F.length("longest"), F.col("lead.description")).otherwise(F.col("longest"))
    return joined.select(key, *(F.coalesce(own(c), f"any_{c}").alias(c) for c in fields), description.alias("description"), "sources", "confirmation_count", score.alias("consensus_score"), S.bucket(score, CONSENSUS_LEVELS, "LOW").alias("consensus_level"), sure.alias("consensus_confidence"))
