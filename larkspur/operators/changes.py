"""Change detection between scans, alerts, page versions and source health."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import scores as S
from larkspur.functions import text as T
from larkspur.sources.tables import cut

#: Ranks of tiers: fixed values.
TIER_RANK = {"WATCH": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def _rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TIER_RANK.items() for x in kv))[c], F.lit(0))


def _event(name: str | Column, importance: str | Column, before: Column | None = None, after: Column | None = None) -> Column:
    value = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(name).alias("event"), lit(importance).alias("importance"), value(before).alias("previous_value"), value(after).alias("current_value"))


def change_events(p: str, first: Column) -> Column:
    """The events of an observation whose predecessor is the struct column `p` (null fields if there is none).

    Columns: availability, price, sources (array), strategy_score, tier.
    """
    old = lambda c: F.col(f"{p}.{c}")
    was, now = T.availability_class(old("availability")), T.availability_class(F.col("availability"))
    cents = lambda c: F.floor(c * 100 + 0.5)
    fell = cents(F.col("price")) - cents(old("price"))
    gained = F.coalesce("strategy_score", F.lit(0.0)) - F.coalesce(old("strategy_score"), F.lit(0.0))
    fresh = F.array_sort(F.array_except(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce(old("sources"), F.array().cast("array<string>"))))
    better = F.col("tier").isNotNull() & (_rank(F.col("tier")) > _rank(old("tier")))
    weight = F.when(F.col("tier").isin("CRITICAL", "HIGH"), F.col("tier")).otherwise("MEDIUM")
    events = F.array_compact(
        F.array(
            F.when((was == "unavailable") & (now == "available"), _event("RESTOCK", "CRITICAL")),
            F.when((was == "available") & (now == "unavailable"), _event("SOLD_OUT", "HIGH")),
            F.when(fell < 0, _event("PRICE_DROP", "HIGH", cents(old("price")), cents(F.col("price")))),
            F.when(fell > 0, _event("PRICE_INCREASE", "MEDIUM", cents(old("price")), cents(F.col("price")))),
            F.when(F.size(fresh) > 0, _event("NEW_CONFIRMATION", "MEDIUM", None, F.array_join(fresh, ", "))),
            F.when(gained >= 10, _event("STRATEGY_UPGRADE", "HIGH", F.coalesce(old("strategy_score"), F.lit(0.0)).cast("int"), F.col("strategy_score").cast("int"))),
            F.when(better, _event("TIER_UPGRADE", weight, old("tier"), F.col("tier"))),
        )
    )
    return F.when(first, F.array(_event("NEW_PRODUCT", "HIGH"))).otherwise(events)


#: Kinds of single events, the first that holds counts.
SINGLE_ORDER = {"NEW_PRODUCT": 0, "RESTOCK": 1, "SOLD_OUT": 1, "PRICE_DROP": 2, "PRICE_INCREASE": 2, "NEW_CONFIRMATION": 3}

STATE = ("availability", "price", "sources", "strategy_score", "tier")


def detect_changes(obs: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Events (product_key, seq, event, importance, previous_value, current_value) of observations in the order of seq.

    Each observation is compared with the one before it of its product; the first with the row of `previous` (the
    columns of STATE by product_key), else it is a NEW_PRODUCT. Values of prices are whole cents. Rows without a key are
    left out.
    """
    events = change_events("__p", F.col("__p.there").isNull())
    return _with_previous(obs, previous).select("product_key", "seq", F.explode(events).alias("e")).select("product_key", "seq", "e.*")


def _with_previous(obs: DataFrame, previous: DataFrame | None) -> DataFrame:
    rows = obs.where("product_key is not null").select("product_key", "seq", *STATE)
    if previous is not None:
        rows = rows.unionByName(previous.select("product_key", F.lit(None).cast(obs.schema["seq"].dataType).alias("seq"), *STATE))
    order = Window.partitionBy("product_key").orderBy(F.col("seq").asc_nulls_first())
    return rows.withColumn("__p", F.lag(F.struct(F.lit(True).alias("there"), *STATE)).over(order)).where("seq is not null")


def single_event(events: Column) -> Column:
    """The first event of a change_events array: new product, availability, price, confirmation; NO_CHANGE without one."""
    order = F.create_map(*(F.lit(x) for kv in SINGLE_ORDER.items() for x in kv))
    ranked = F.transform(F.filter(events, lambda e: e["event"].isin(*SINGLE_ORDER)), lambda e: F.struct(order[e["event"]].alias("rank"), e["event"].alias("event")))
    return F.coalesce(F.array_min(ranked)["event"], F.lit("NO_CHANGE"))


def detect_change_single(obs: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """One event for each observation: new product, else availability, else price, else confirmation, else NO_CHANGE."""
    event = single_event(change_events("__p", F.col("__p.there").isNull()))
    return _with_previous(obs, previous).select("product_key", "seq", event.alias("event"))


def advance_state(obs: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The latest state of each product: that of the last observation, else the previous one."""
    rows = obs.where("product_key is not null").select("product_key", F.col("seq").cast("long").alias("seq"), *STATE)
    if previous is not None:
        rows = rows.unionByName(previous.select("product_key", F.lit(-1).cast("long").alias("seq"), *STATE))
    return rows.groupBy("product_key").agg(F.max_by(F.struct(*STATE), "seq").alias("s")).select("product_key", "s.*")


def new_alerts(alerts: DataFrame, active: DataFrame) -> DataFrame:
    """The first alert (by seq) of each product_key and event that has no active one yet."""
    waiting = alerts.join(active.select("product_key", "event").distinct(), ["product_key", "event"], "left_anti")
    first = F.min_by(F.struct(*alerts.columns), "seq")
    return waiting.groupBy("product_key", "event").agg(first.alias("row")).select("row.*")


#: What happens to alerts, in the order in which it counts where one seq has several.
ACTIONS = ("resolve", "alert", "acknowledge", "forward")


def action_order() -> Column:
    """A number by which actions (seq, action) follow each other."""
    rank = F.create_map(*(F.lit(x) for i, a in enumerate(ACTIONS) for x in (a, i)))[F.col("action")]
    return F.col("seq") * len(ACTIONS) + rank


def with_status(records: DataFrame) -> DataFrame:
    """Add status: RESOLVED, ACTIVE (acknowledged) or NEW."""
    return records.withColumn("status", F.when(F.col("resolved").isNotNull(), "RESOLVED").when(F.col("acknowledged").isNotNull(), "ACTIVE").otherwise("NEW"))


def alert_records(actions: DataFrame) -> DataFrame:
    """Records of alerts: product_key, event, opened, acknowledged, forwarded and resolved (seq of the first such action
    while the record was open, null without one) and status.

    actions has product_key, event, seq and action (alert, acknowledge, forward, resolve). An alert opens a record unless
    its product and event have an open one; a resolution closes it and so lets the next alert open another. Actions
    without an open record do nothing; equal ones count once; rows with a null key or an unknown action are left out.
    The actions between two resolutions are one island: its first alert opens the record.
    """
    known = actions.where(F.col("action").isin(*ACTIONS) & F.col("product_key").isNotNull() & F.col("event").isNotNull() & F.col("seq").isNotNull())
    # `at` says seq and action. An equal row changes nothing: a second resolution makes an island without an alert.
    rows = known.withColumn("seq", F.col("seq").cast("long")).select("product_key", "event", action_order().alias("at"))
    action, seq = F.pmod(F.col("at"), F.lit(len(ACTIONS))), F.floor(F.col("at") / len(ACTIONS))
    order = Window.partitionBy("product_key", "event").orderBy("at")
    island = F.coalesce(F.count_if(action == ACTIONS.index("resolve")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of = Window.partitionBy("product_key", "event", "island")
    opened = F.min(F.when(action == ACTIONS.index("alert"), F.col("at"))).over(of)
    open_rows = rows.withColumn("island", island).withColumn("first", opened).where("at >= first")
    when = lambda name: F.min(F.when(action == ACTIONS.index(name), seq))
    found = open_rows.groupBy("product_key", "event", "island").agg(when("alert").alias("opened"), when("acknowledge").alias("acknowledged"), when("forward").alias("forwarded"), when("resolve").alias("resolved"))
    return with_status(found.drop("island"))


def forward_once(records: DataFrame, events: DataFrame) -> DataFrame:
    """What goes on to the opportunities: (product_key, event, seq, opened): each record when it is first forwarded, and the
    NEW_PRODUCT event of each product even where no record was opened by it (opened is null then)."""
    sent = cut(records.where("forwarded is not null").select("product_key", "event", F.col("forwarded").alias("seq"), "opened"))
    fresh = events.where("event = 'NEW_PRODUCT'").groupBy("product_key", "event").agg(F.min(F.col("seq").cast("long")).alias("seq"))
    known = sent.where("event = 'NEW_PRODUCT'").select("product_key", "event").distinct()
    return sent.unionByName(fresh.join(known, ["product_key", "event"], "left_anti").withColumn("opened", F.lit(None).cast("long")))


#: Base scores of events and levels of alerts: fixed values.
EVENT_SCORES = {"RESTOCK": 48, "PRICE_DROP": 42, "TIER_UPGRADE": 36, "STRATEGY_UPGRADE": 32, "SOLD_OUT": 30, "NEW_PRODUCT": 24, "NEW_CONFIRMATION": 16, "PRICE_INCREASE": 8}
ALERT_LEVELS = ((85, "CRITICAL"), (70, "HIGH"), (50, "MEDIUM"), (30, "LOW"))
ALERT_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "WATCH": 0, "IGNORE": 0}


def score_alerts(events: DataFrame, items: DataFrame, least: int = 30) -> DataFrame:
    """Add alert_score (event base, shares of the item's scores and a bonus where they suit the event), priority, action
    and should_alert, and the item's opportunity_score.

    items has product_key, opportunity_score, opportunity_tier, collector_score, popularity_score, flip_score, hold_score
    and strategy; scores of unknown products and missing ones count as 0.
    """
    event, z = F.col("event"), lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    base = F.coalesce(F.create_map(*(F.lit(x) for kv in EVENT_SCORES.items() for x in kv))[event], F.lit(0))
    names = ("opportunity_score", "opportunity_tier", "collector_score", "popularity_score", "flip_score", "hold_score", "strategy")
    joined = events.join(items.select("product_key", *names), "product_key", "left")
    shares = S.half_even(z("opportunity_score") * 0.15) + S.half_even(z("collector_score") * 0.08) + S.half_even(z("popularity_score") * 0.06)
    bonus = F.when((event == "RESTOCK") & (z("flip_score") >= 70), 12).when((event == "PRICE_DROP") & (z("hold_score") >= 70), 10).when((event == "TIER_UPGRADE") & (F.col("opportunity_tier") == "CRITICAL"), 12).otherwise(0)
    score = S.clamp(base + shares + bonus)
    action = (
        F.when(event == "RESTOCK", F.when(score >= 70, "CHECK STOCK AND BUY QUICKLY IF MARGIN WORKS").otherwise("CHECK CURRENT STOCK"))
        .when(event == "PRICE_DROP", F.when(F.col("strategy") == "LONG-TERM HOLD", "REVIEW FOR HOLD PURCHASE").otherwise("RECHECK PROFIT MARGIN"))
        .when(event == "NEW_PRODUCT", F.when(score >= 70, "RESEARCH IMMEDIATELY").otherwise("ADD TO WATCHLIST"))
        .when(event == "SOLD_OUT", "WATCH SECONDARY MARKET")
        .when(event == "TIER_UPGRADE", "REVIEW BUY PRIORITY")
        .when(event == "STRATEGY_UPGRADE", "RECHECK INVESTMENT STRATEGY")
        .when(event == "NEW_CONFIRMATION", "REVIEW NEW OFFICIAL DATA")
        .when(event == "PRICE_INCREASE", "RECALCULATE PROFIT MARGIN")
        .otherwise("MONITOR")
    )
    return joined.withColumns({"alert_score": score, "priority": S.bucket(score, ALERT_LEVELS, "IGNORE"), "action": action, "should_alert": score >= least}).drop(*names[1:])


def rank_alerts(alerts: DataFrame, k: int = 20) -> DataFrame:
    """The k first alerts by priority, score and opportunity score; equal ones by key, seq and event."""
    rank = F.create_map(*(F.lit(x) for kv in ALERT_RANK.items() for x in kv))[F.col("priority")]
    return alerts.orderBy(F.coalesce(rank, F.lit(0)).desc(), F.desc("alert_score"), F.coalesce(F.col("opportunity_score").cast("double"), F.lit(0.0)).desc(), "product_key", "seq", "event").limit(k)


def alert_scan(board: DataFrame, obs: DataFrame, previous: DataFrame | None = None, active: DataFrame | None = None) -> DataFrame:
    """One scan: changes of the observations against the previous state, scored with the board's items, of these the
    alerts worth raising that are not active yet. board has the columns that score_alerts takes of items, active has
    product_key and event. advance_state gives the state for the next scan."""
    alerts = score_alerts(detect_changes(obs, previous), board).where("should_alert")
    return new_alerts(alerts, alerts.limit(0) if active is None else active)


STAMP = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"


def page_digests(fetches: DataFrame) -> DataFrame:
    """url, digest, loose (digest without time stamps) and empty for each fetch (url, body)."""
    body = F.coalesce("body", F.lit(""))
    return fetches.select("url", F.sha2(body, 256).alias("digest"), F.sha2(F.regexp_replace(body, STAMP, ""), 256).alias("loose"), (F.trim(body) == "").alias("empty"))


def compare_pages(was: DataFrame, now: DataFrame) -> DataFrame:
    """url and status of each row of `now` against `was`, both as page_digests gives them."""
    was = was.select(F.col("url").alias("old_url"), F.col("digest").alias("old"), F.col("loose").alias("old_loose"))
    known = was.groupBy(F.col("old").alias("known")).agg(F.lit(True).alias("elsewhere"))
    joined = now.join(was, F.col("url") == F.col("old_url"), "left").join(known, F.col("digest") == F.col("known"), "left")
    seen = F.col("old_url").isNotNull()
    status = (
        F.when(F.col("empty"), F.when(seen, "REMOVED").otherwise("UNCHANGED"))
        .when(~seen, F.when(F.col("elsewhere"), "DUPLICATE").otherwise("NEW"))
        .when(F.col("old") == F.col("digest"), "UNCHANGED")
        .when(F.col("old_loose") == F.col("loose"), "TIMESTAMP_ONLY")
        .otherwise("CHANGED")
    )
    return joined.select("url", status.alias("status"))


def page_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """url and status of each fetch of `current` (url, body) against `previous`: NEW, UNCHANGED, TIMESTAMP_ONLY, CHANGED,
    REMOVED or DUPLICATE (a new url whose body another url had). Only digests of bodies are shuffled."""
    return compare_pages(page_digests(previous), page_digests(current))


def failure_streaks(runs: DataFrame) -> DataFrame:
    """source_id, runs, consecutive_failures (since the last success) and last_success_at.

    runs has source_id, ts, event_id (order among equal times) and success. Two aggregations, no window: what is newer
    than the last success is counted after joining it.
    """
    at = F.struct("ts", "event_id")
    last = runs.groupBy("source_id").agg(F.max(F.when(F.col("success"), at)).alias("ok"), F.count("*").alias("runs"))
    later = runs.join(last, "source_id").where("not success").where(F.col("ok").isNull() | (at > F.col("ok"))).groupBy("source_id").agg(F.count("*").alias("n"))
    return last.join(later, "source_id", "left").select("source_id", "runs", F.coalesce("n", F.lit(0)).alias("consecutive_failures"), F.col("ok.ts").alias("last_success_at"))


def source_health(runs: DataFrame, now: Column, stale_hours: float = 168.0, inspect_after: int = 5, disable_after: int = 10, sources: DataFrame | None = None) -> DataFrame:
    """Status and recommended action of each source from its streak and the age of its last success.

    sources (source_id, enabled, lifecycle), if given, adds those that never ran; switched-off, retired and broken ones
    are disabled.
    """
    return health_of(failure_streaks(runs), now, stale_hours, inspect_after, disable_after, sources)


def health_of(streaks: DataFrame, now: Column, stale_hours: float = 168.0, inspect_after: int = 5, disable_after: int = 10, sources: DataFrame | None = None) -> DataFrame:
    """source_health over streaks that failure_streaks gave."""
    n, stale = F.col("consecutive_failures"), F.coalesce((F.unix_timestamp(now) - F.unix_timestamp("last_success_at")) / 3600 > stale_hours, F.lit(False))
    never = F.col("last_success_at").isNull() & (F.coalesce(n, F.lit(0)) == 0)
    status = F.when(never, "unknown").when(n >= inspect_after, "failing").when(stale, "stale").when(n > 0, "warning").otherwise("healthy")
    action = F.when(never, "none").when(n >= disable_after, "pause").when((n >= inspect_after) | stale, "inspect").when(n > 0, "retry").otherwise("none")
    if sources is not None:
        off = ~F.coalesce("enabled", F.lit(False)) | F.coalesce(F.col("lifecycle").isin("retired", "broken"), F.lit(False))
        streaks = sources.select("source_id", off.alias("off")).join(streaks, "source_id", "left")
        status, action = F.when(F.col("off"), "disabled").otherwise(status), F.when(F.col("off"), "none").otherwise(action)
    return streaks.withColumns({"health_status": status, "recommended_action": action}).drop("off")


def backoff(streaks: DataFrame, base: float = 60.0, most: float = 3600.0) -> DataFrame:
    """Add backoff_seconds: base times 2 to the streak less one, at most `most`; 0 without failures."""
    n = F.col("consecutive_failures")
    return streaks.withColumn("backoff_seconds", F.when(n <= 0, 0.0).otherwise(F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.least(n, F.lit(60)) - 1))))


def rolling_failures(events: DataFrame, seconds: int, key: str | None = None) -> DataFrame:
    """at (second), the key if there is one, and recent_failures: failures in the last `seconds` up to it, itself included, for
    each second with events (ts, success).

    Events are counted by second first. Time is cut into stretches of a day or of `seconds`, if these are more, and each
    takes what it needs of the one before, so that a window holds the seconds of two stretches at most, also without a key.
    """
    keys = [] if key is None else [key]
    width = max(seconds, 86400)
    counted = events.withColumn("at", F.unix_timestamp("ts")).groupBy(*keys, "at").agg(F.count_if(~F.col("success")).alias("n"))
    own = F.floor(F.col("at") / width)
    reach = F.when((own + 1) * width - F.col("at") <= seconds, F.array(own, own + 1)).otherwise(F.array(own))
    spread = counted.select(*keys, "at", "n", own.alias("own"), F.explode(reach).alias("stretch"))
    window = Window.partitionBy(*keys, "stretch").orderBy("at").rangeBetween(-seconds, 0)
    return spread.withColumn("recent_failures", F.sum("n").over(window)).where("own = stretch").select(*keys, "at", "recent_failures")


def failure_lockout(events: DataFrame, threshold: int, seconds: int, key: str = "source_id") -> DataFrame:
    """Failures at which `threshold` or more failures of the key lie in the last `seconds`, with their number. Rows without a key
    are left out."""
    failed = events.where(~F.col("success") & F.col(key).isNotNull()).withColumn("at", F.unix_timestamp("ts"))
    return failed.join(rolling_failures(failed, seconds, key), [key, "at"]).where(F.col("recent_failures") >= threshold).drop("at")


def lockout(events: DataFrame, key_threshold: int, all_threshold: int, seconds: int, key: str = "source_id") -> DataFrame:
    """events with recent_failures (of the key), recent_all (of all keys) and locked: whether either reaches its threshold in the
    last `seconds`. An event without a key is held against all keys only; it counts among their failures."""
    timed = events.withColumn("at", F.unix_timestamp("ts"))
    mine = rolling_failures(timed.where(F.col(key).isNotNull()), seconds, key)
    everyone = rolling_failures(timed, seconds).withColumnRenamed("recent_failures", "recent_all")
    joined = timed.join(mine, [key, "at"], "left").join(everyone, "at", "left").drop("at")
    locked = (F.col("recent_all") >= all_threshold) | F.coalesce(F.col("recent_failures") >= key_threshold, F.lit(False))
    return joined.withColumn("locked", F.coalesce(locked, F.lit(False)))


def retention_candidates(df: DataFrame, stamp: str, before: Column, limit: int) -> DataFrame:
    """The oldest rows from before a time, at most `limit` of them (a bounded sweep)."""
    return df.where(F.col(stamp) < before).orderBy(stamp, *[c for c in df.columns if c != stamp][:1]).limit(limit)


def scan_report(stages: DataFrame) -> DataFrame:
    """For each run SUCCESS, PARTIAL or FAILED from its stages (run_id, items, error): no errors, some items, none."""
    items, errors = F.sum(F.coalesce("items", F.lit(0))), F.count("error")
    return stages.groupBy("run_id").agg(items.alias("items"), errors.alias("errors"), F.when(errors == 0, "SUCCESS").when(items > 0, "PARTIAL").otherwise("FAILED").alias("status"))


#: Seconds of a stretch of a key's quotes in reuse_quotes.
STRETCH = 86400


def _chain(t: np.ndarray, at: int, seconds: int) -> list[int]:
    """Times fetched from place `at` on: each the first that comes more than `seconds` after the last."""
    out = []
    while at < len(t):
        out.append(int(t[at]))
        at = int(np.searchsorted(t, t[at] + seconds, "right"))
    return out


def reuse_quotes(quotes: DataFrame, key: str, seconds: int, previous: DataFrame | None = None) -> DataFrame:
    """(key, fetched_at) of quotes that are fetched when a quote is reused for `seconds`: the first of a key, then the first
    that comes later than the last one fetched by more than that. `previous` (key, fetched_at) holds earlier fetches.

    What comes before a day only matters by its last fetch, so each day of a key is settled for every quote it could
    start with (those within `seconds` of its beginning); the days of a key are then chained, and each day's fetches
    follow from its start. No task holds more than a day's distinct seconds, or the starts of one key's days. Quotes
    without a time or key are left out.
    """
    times = quotes.select(F.col(key).alias("key"), F.unix_timestamp("ts").alias("t")).dropna().distinct()
    days = cut(times.groupBy("key", F.floor(F.col("t") / STRETCH).alias("day")).agg(F.array_sort(F.collect_list("t")).alias("t")))

    @F.pandas_udf("struct<starts:array<long>,lasts:array<long>>")
    def settle(day: pd.Series, t: pd.Series) -> pd.DataFrame:
        starts = [x[: np.searchsorted(x, d * STRETCH + seconds, "left") + 1] for d, x in zip(day, t, strict=True)]
        lasts = [[_chain(x, i, seconds)[-1] for i in range(len(s))] for x, s in zip(t, starts, strict=True)]
        return pd.DataFrame({"starts": starts, "lasts": lasts})

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day")
        before, last = [], rows["last"].iloc[0]
        last = None if pd.isna(last) else int(last)
        for starts, lasts in zip(rows["starts"], rows["lasts"], strict=True):
            before.append(last)
            at = 0 if last is None else int(np.searchsorted(starts, last + seconds, "right"))
            last = int(lasts[at]) if at < len(lasts) else last
        return pd.DataFrame({"key": rows["key"], "day": rows["day"], "last": pd.array(before, "Int64")})

    @F.pandas_udf("array<long>")
    def fetched(t: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([_chain(x, 0 if pd.isna(b) else int(np.searchsorted(x, int(b) + seconds, "right")), seconds) for x, b in zip(t, last, strict=True)])

    settled = days.select("key", "day", settle("day", "t").alias("s")).select("key", "day", "s.*")
    if previous is None:
        settled = settled.withColumn("last", F.lit(None).cast("long"))
    else:
        settled = settled.join(previous.groupBy(F.col(key).alias("key")).agg(F.max("fetched_at").alias("last")), "key", "left")
    kind = settled.schema["key"].dataType.simpleString()
    begun = settled.groupBy("key").applyInPandas(chain, f"key {kind}, day long, last long")
    return days.join(begun, ["key", "day"]).select(F.col("key").alias(key), F.explode(fetched("t", "last")).alias("fetched_at"))


def duplicates(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Add duplicate_of: the first row (by `order`) with the same values of `by`; null for that row itself."""
    first = df.groupBy(*by).agg(F.min(order).alias("__first"))
    return df.join(first, list(by)).withColumn("duplicate_of", F.when(F.col(order) != F.col("__first"), F.col("__first"))).drop("__first")
