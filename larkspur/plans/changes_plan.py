"""Registered queries over observations, pages, runs, merges and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scores as S
from larkspur.operators import boards, changes, evidence, groups, merges
from larkspur.plans.items_plan import _nt
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


def observations(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "observations").withColumn("sources", F.array("source"))


_CLASS = lambda c: f"CASE WHEN replace(replace(lower({c}), ' ', ''), '-', '') IN ('instock', 'preorder') THEN 'available' WHEN replace(replace(lower({c}), ' ', ''), '-', '') = 'outofstock' THEN 'unavailable' ELSE 'unknown' END"
_TR = lambda c: f"CASE {c} WHEN 'WATCH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"
_CENT = lambda c: f"CAST(floor({c} * 100 + 0.5) AS BIGINT)"
_LG = """lg AS (SELECT *, lag(availability) OVER w AS pa, lag(price) OVER w AS pp, lag(source) OVER w AS ps, lag(strategy_score) OVER w AS pg, lag(tier) OVER w AS pt FROM {observations} WINDOW w AS (PARTITION BY product_key ORDER BY seq))"""
_C1 = f"""{_LG},
ev AS (
SELECT product_key, seq, 'NEW_PRODUCT' AS event, 'HIGH' AS importance, NULL AS previous_value, NULL AS current_value FROM lg WHERE seq = 1
UNION ALL SELECT product_key, seq, 'RESTOCK', 'CRITICAL', NULL, NULL FROM lg WHERE seq > 1 AND {_CLASS('pa')} = 'unavailable' AND {_CLASS('availability')} = 'available'
UNION ALL SELECT product_key, seq, 'SOLD_OUT', 'HIGH', NULL, NULL FROM lg WHERE seq > 1 AND {_CLASS('pa')} = 'available' AND {_CLASS('availability')} = 'unavailable'
UNION ALL SELECT product_key, seq, CASE WHEN {_CENT('price')} < {_CENT('pp')} THEN 'PRICE_DROP' ELSE 'PRICE_INCREASE' END, CASE WHEN {_CENT('price')} < {_CENT('pp')} THEN 'HIGH' ELSE 'MEDIUM' END, CAST({_CENT('pp')} AS VARCHAR), CAST({_CENT('price')} AS VARCHAR) FROM lg WHERE seq > 1 AND {_CENT('price')} <> {_CENT('pp')}
UNION ALL SELECT product_key, seq, 'NEW_CONFIRMATION', 'MEDIUM', NULL, source FROM lg WHERE seq > 1 AND source <> ps
UNION ALL SELECT product_key, seq, 'STRATEGY_UPGRADE', 'HIGH', CAST(CAST(pg AS INT) AS VARCHAR), CAST(CAST(strategy_score AS INT) AS VARCHAR) FROM lg WHERE seq > 1 AND strategy_score - pg >= 10
UNION ALL SELECT product_key, seq, 'TIER_UPGRADE', CASE WHEN tier IN ('CRITICAL', 'HIGH') THEN tier ELSE 'MEDIUM' END, pt, tier FROM lg WHERE seq > 1 AND tier IS NOT NULL AND {_TR('tier')} > {_TR('pt')})"""


@query("C1_detect_changes", f"WITH {_C1} SELECT * FROM ev")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return changes.detect_changes(observations(spark, d))


@query("C1_with_previous_state", f"WITH {_C1} SELECT * FROM ev WHERE seq > 5")
def c1p(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    return changes.detect_changes(obs.where("seq > 5"), changes.advance_state(obs.where("seq <= 5")))


@query("C2_single_event", f"""WITH {_LG} SELECT product_key, seq, CASE WHEN seq = 1 THEN 'NEW_PRODUCT' WHEN {_CLASS('pa')} = 'unavailable' AND {_CLASS('availability')} = 'available' THEN 'RESTOCK' WHEN {_CLASS('pa')} = 'available' AND {_CLASS('availability')} = 'unavailable' THEN 'SOLD_OUT'
WHEN {_CENT('price')} < {_CENT('pp')} THEN 'PRICE_DROP' WHEN {_CENT('price')} > {_CENT('pp')} THEN 'PRICE_INCREASE' WHEN source <> ps THEN 'NEW_CONFIRMATION' ELSE 'NO_CHANGE' END AS event FROM lg""")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return changes.detect_change_single(observations(spark, d))


@query("C3_advance_state", "SELECT product_key, availability, price, source, tier FROM (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY seq DESC) AS r FROM {observations}) WHERE r = 1")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return changes.advance_state(observations(spark, d)).select("product_key", "availability", "price", F.col("sources")[0].alias("source"), "tier")


@query("C4_new_alerts", f"""WITH {_C1} SELECT product_key, event, min(seq) AS seq FROM ev e WHERE seq > 6 AND NOT EXISTS (SELECT 1 FROM ev p WHERE p.seq <= 6 AND p.product_key = e.product_key AND p.event = e.event) GROUP BY product_key, event""")
def c4(spark: SparkSession, d: str) -> DataFrame:
    events = changes.detect_changes(observations(spark, d))
    return changes.new_alerts(events.where("seq > 6"), events.where("seq <= 6")).select("product_key", "event", "seq")


_RE = lambda x, r: f"CAST(round_even(CAST(coalesce({x}, 0) AS DOUBLE) * CAST({r} AS DOUBLE), 0) AS INT)"
_A25 = f"""SELECT product_key, seq, event, opportunity_score, alert_score, CASE WHEN alert_score >= 85 THEN 'CRITICAL' WHEN alert_score >= 70 THEN 'HIGH' WHEN alert_score >= 50 THEN 'MEDIUM' WHEN alert_score >= 30 THEN 'LOW' ELSE 'IGNORE' END AS priority,
CASE event WHEN 'RESTOCK' THEN CASE WHEN alert_score >= 70 THEN 'CHECK STOCK AND BUY QUICKLY IF MARGIN WORKS' ELSE 'CHECK CURRENT STOCK' END WHEN 'PRICE_DROP' THEN CASE WHEN hold_score > flip_score AND hold_score >= sleeper_score THEN 'REVIEW FOR HOLD PURCHASE' ELSE 'RECHECK PROFIT MARGIN' END WHEN 'NEW_PRODUCT' THEN CASE WHEN alert_score >= 70 THEN 'RESEARCH IMMEDIATELY' ELSE 'ADD TO WATCHLIST' END
WHEN 'SOLD_OUT' THEN 'WATCH SECONDARY MARKET' WHEN 'TIER_UPGRADE' THEN 'REVIEW BUY PRIORITY' WHEN 'STRATEGY_UPGRADE' THEN 'RECHECK INVESTMENT STRATEGY' WHEN 'NEW_CONFIRMATION' THEN 'REVIEW NEW OFFICIAL DATA' WHEN 'PRICE_INCREASE' THEN 'RECALCULATE PROFIT MARGIN' ELSE 'MONITOR' END AS action, alert_score >= 30 AS should_alert
FROM (SELECT ev.product_key, ev.seq, event, collector_score AS opportunity_score, hold_score, flip_score, sleeper_score, greatest(0, least(100, CASE event WHEN 'RESTOCK' THEN 48 WHEN 'PRICE_DROP' THEN 42 WHEN 'TIER_UPGRADE' THEN 36 WHEN 'STRATEGY_UPGRADE' THEN 32 WHEN 'SOLD_OUT' THEN 30 WHEN 'NEW_PRODUCT' THEN 24 WHEN 'NEW_CONFIRMATION' THEN 16 WHEN 'PRICE_INCREASE' THEN 8 ELSE 0 END
+ {_RE('collector_score', 0.15)} + {_RE('collector_score', 0.08)} + {_RE('popularity_score', 0.06)} + CASE WHEN event = 'RESTOCK' AND flip_score >= 70 THEN 12 WHEN event = 'PRICE_DROP' AND hold_score >= 70 THEN 10 WHEN event = 'TIER_UPGRADE' AND collector_score >= 85 THEN 12 ELSE 0 END)) AS alert_score FROM ev LEFT JOIN {{products}} p ON p.seq = ev.product_key)"""


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Changes scored with the products' scores; the collector score stands for the opportunity score."""
    items = boards.best_strategy(view(spark, d, "products")).withColumns({"opportunity_score": F.col("collector_score"), "opportunity_tier": S.bucket(F.col("collector_score"), S.TIERS, "WATCH")})
    return changes.score_alerts(changes.detect_changes(observations(spark, d)), items.withColumnRenamed("seq", "product_key"))


_ALERT = ("product_key", "seq", "event", "opportunity_score", "alert_score", "priority", "action", "should_alert")


@query("A25_score_alerts", f"WITH {_C1} {_A25}")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return alerts(spark, d).select(*_ALERT)


@query("W5_top_alerts", f"WITH {_C1}, al AS ({_A25}) SELECT * FROM al WHERE should_alert ORDER BY CASE priority WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, alert_score DESC, coalesce(opportunity_score, 0) DESC, product_key, seq, event LIMIT 20")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return changes.rank_alerts(alerts(spark, d).where("should_alert")).select(*_ALERT)


@query("C5_forward_once", f"WITH {_C1}, al AS ({_A25}), f AS (SELECT product_key, event, min(seq) AS seq FROM al WHERE priority IN ('CRITICAL', 'HIGH') GROUP BY product_key, event) SELECT * FROM f WHERE seq > 3")
def c5(spark: SparkSession, d: str) -> DataFrame:
    urgent = alerts(spark, d).where("priority in ('CRITICAL', 'HIGH')")
    return changes.new_alerts(urgent.where("seq > 3"), urgent.where("seq <= 3")).select("product_key", "event", "seq")


_STAMP = r"\b\d\d\d\d-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?\b"


@query("C7_page_changes", f"""WITH p AS (SELECT url, body FROM {{fetches}} WHERE round = 1), c AS (SELECT url, body FROM {{fetches}} WHERE round = 2)
SELECT c.url, CASE WHEN trim(c.body) = '' THEN CASE WHEN p.url IS NOT NULL THEN 'REMOVED' ELSE 'UNCHANGED' END WHEN p.url IS NULL THEN CASE WHEN c.body IN (SELECT body FROM p) THEN 'DUPLICATE' ELSE 'NEW' END
WHEN p.body = c.body THEN 'UNCHANGED' WHEN regexp_replace(p.body, '{_STAMP}', '', 'g') = regexp_replace(c.body, '{_STAMP}', '', 'g') THEN 'TIMESTAMP_ONLY' ELSE 'CHANGED' END AS status FROM c LEFT JOIN p ON p.url = c.url""")
def c7(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "fetches")
    return changes.page_changes(f.where("round = 1"), f.where("round = 2"))


_STREAK = "st AS (SELECT source_id, count(*) AS runs, count(*) FILTER (NOT success AND (ok IS NULL OR ord > ok)) AS consecutive_failures, max(CASE WHEN success THEN ts END) AS last_success_at FROM (SELECT *, row_number() OVER w AS ord, max(CASE WHEN success THEN rn END) OVER (PARTITION BY source_id) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, event_id) AS rn FROM {source_runs}) WINDOW w AS (PARTITION BY source_id ORDER BY ts, event_id)) GROUP BY source_id)"


@query("C8_source_health", f"""WITH {_STREAK} SELECT source_id, consecutive_failures, CASE WHEN last_success_at IS NULL AND consecutive_failures = 0 THEN 'unknown' WHEN consecutive_failures >= 5 THEN 'failing' WHEN stale THEN 'stale' WHEN consecutive_failures > 0 THEN 'warning' ELSE 'healthy' END AS health_status,
CASE WHEN last_success_at IS NULL AND consecutive_failures = 0 THEN 'none' WHEN consecutive_failures >= 10 THEN 'pause' WHEN consecutive_failures >= 5 OR stale THEN 'inspect' WHEN consecutive_failures > 0 THEN 'retry' ELSE 'none' END AS recommended_action
FROM (SELECT *, coalesce((epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(last_success_at))) / 3600 > 30, false) AS stale FROM st)""")
def c8(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return changes.source_health(view(spark, d, "source_runs"), now, stale_hours=30).select("source_id", "consecutive_failures", "health_status", "recommended_action")


@query("C9_backoff", f"WITH {_STREAK} SELECT source_id, consecutive_failures, CASE WHEN consecutive_failures <= 0 THEN 0 ELSE least(3600.0, 60.0 * pow(2, consecutive_failures - 1)) END AS backoff_seconds FROM st")
def c9(spark: SparkSession, d: str) -> DataFrame:
    return changes.backoff(changes.failure_streaks(view(spark, d, "source_runs"))).select("source_id", "consecutive_failures", "backoff_seconds")


@query("C10_failure_lockout", "SELECT event_id, source_id, recent_failures FROM (SELECT event_id, source_id, count(*) OVER (PARTITION BY source_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent_failures FROM {source_runs} WHERE NOT success) WHERE recent_failures >= 4")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return changes.failure_lockout(view(spark, d, "source_runs"), 4, 86400).select("event_id", "source_id", "recent_failures")


@query("C10_lockout", """WITH r AS (SELECT event_id, source_id, success, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM {source_runs}),
n AS (SELECT event_id, source_id, count(*) FILTER (NOT success) OVER (PARTITION BY source_id ORDER BY sec RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS recent_failures, count(*) FILTER (NOT success) OVER (ORDER BY sec RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS recent_all FROM r)
SELECT *, recent_failures >= 2 OR recent_all >= 5 AS locked FROM n""")
def c10_both(spark: SparkSession, d: str) -> DataFrame:
    return changes.lockout(view(spark, d, "source_runs"), 2, 5, 7200).select("event_id", "source_id", "recent_failures", "recent_all", "locked")


@query("C11_reuse_quotes", """WITH RECURSIVE q AS (SELECT DISTINCT source_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM {source_runs}), n AS (SELECT source_id, t, min(t) OVER (PARTITION BY source_id ORDER BY t RANGE BETWEEN 901 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM q),
r AS (SELECT source_id, min(t) AS t FROM q GROUP BY source_id UNION ALL SELECT n.source_id, n.nx FROM r JOIN n ON n.source_id = r.source_id AND n.t = r.t WHERE n.nx IS NOT NULL) SELECT source_id, t AS fetched_at FROM r""")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return changes.reuse_quotes(view(spark, d, "source_runs"), "source_id", 900)


@query("C12_retention", "SELECT event_id, source_id FROM {source_runs} WHERE ts < TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_id LIMIT 500")
def c12(spark: SparkSession, d: str) -> DataFrame:
    return changes.retention_candidates(view(spark, d, "source_runs"), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp"), 500).select("event_id", "source_id")


@query("C13_scan_report", "SELECT run_id, CAST(sum(coalesce(items, 0)) AS BIGINT) AS items, count(error) AS errors, CASE WHEN count(error) = 0 THEN 'SUCCESS' WHEN sum(coalesce(items, 0)) > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM (SELECT event_id // 7 AS run_id, CASE WHEN event_type <> 'error' THEN CAST(event_id % 3 AS BIGINT) END AS items, CASE WHEN event_type = 'error' THEN 'x' END AS error FROM {events}) GROUP BY run_id")
def c13(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "events")
    ok = F.col("event_type") != "error"
    return changes.scan_report(e.select(F.floor(F.col("event_id") / 7).cast("long").alias("run_id"), F.when(ok, F.col("event_id") % 3).alias("items"), F.when(~ok, "x").alias("error")))


_SRC = "s AS (SELECT product_key, string_agg(source, ',' ORDER BY o) AS sources FROM (SELECT product_key, source, min(seq) AS o FROM {observations} GROUP BY product_key, source) GROUP BY product_key)"
_U1 = f"""d AS (SELECT product_key, arg_max(description, length(description) * 1000000 + seq) AS description FROM {{observations}} WHERE coalesce(description, '') <> '' GROUP BY product_key), {_SRC}"""


@query("U1_upsert_catalog", f"""WITH {_U1} SELECT o.product_key, arg_max(price, seq) AS price, arg_max(tier, seq) FILTER (tier IS NOT NULL) AS tier, any_value(d.description) AS description, CAST(arg_min(observed_at, seq) AS DATE) AS first_seen_at, CAST(arg_max(observed_at, seq) AS DATE) AS last_seen_at, count(*) AS scan_count, any_value(s.sources) AS sources
FROM {{observations}} o LEFT JOIN d ON d.product_key = o.product_key LEFT JOIN s ON s.product_key = o.product_key GROUP BY o.product_key""")
def u1(spark: SparkSession, d: str) -> DataFrame:
    up = merges.upsert_catalog(view(spark, d, "observations"), "product_key", "seq", ("price", "tier"), "description", "source", "observed_at")
    return up.withColumns({"first_seen_at": F.to_date("first_seen_at"), "last_seen_at": F.to_date("last_seen_at"), "sources": F.array_join("sources", ",")})


@query("A9_first_wins", f"""WITH d AS (SELECT product_key, arg_max(description, length(description) * 1000000 - seq) AS description FROM {{observations}} WHERE coalesce(description, '') <> '' GROUP BY product_key), {_SRC}
SELECT o.product_key, arg_min(price, seq) AS price, arg_min(tier, seq) FILTER (tier IS NOT NULL) AS tier, any_value(d.description) AS description, any_value(s.sources) AS sources FROM {{observations}} o LEFT JOIN d ON d.product_key = o.product_key LEFT JOIN s ON s.product_key = o.product_key GROUP BY o.product_key""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return merges.dedup_first_wins(view(spark, d, "observations"), "product_key", "seq", ("price", "tier"), "description", "source").withColumn("sources", F.array_join("sources", ","))


@query("U2_override_history", """SELECT id, seq, field, old_value, new_value FROM (SELECT id, seq, 'priority' AS field, lag(priority) OVER w AS old_value, priority AS new_value FROM ed WINDOW w AS (PARTITION BY id ORDER BY seq) UNION ALL SELECT id, seq, 'status', lag(status) OVER w, status FROM ed WINDOW w AS (PARTITION BY id ORDER BY seq)) WHERE new_value IS DISTINCT FROM old_value""".replace("FROM ed", "FROM (SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM {orders})"))
def u2(spark: SparkSession, d: str) -> DataFrame:
    edits = view(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"))
    return merges.override_history(edits, ("priority", "status"))


@query("U3_upsert_opportunities", """SELECT opportunity_id, sold_price, market_price, score, status, change FROM (
SELECT o.opportunity_id, o.sold_price, o.market_price, o.score, o.status, 'kept' AS change FROM {opportunities} o WHERE o.opportunity_id NOT IN (SELECT opportunity_id FROM {opportunities_new})
UNION ALL SELECT n.opportunity_id, n.sold_price, n.market_price, n.score, n.status, CASE WHEN o.opportunity_id IS NULL THEN 'inserted' WHEN o.sold_price IS NOT DISTINCT FROM n.sold_price AND o.market_price IS NOT DISTINCT FROM n.market_price AND o.score = n.score AND o.status = n.status THEN 'kept' ELSE 'updated' END FROM {opportunities_new} n LEFT JOIN {opportunities} o ON o.opportunity_id = n.opportunity_id)""")
def u3(spark: SparkSession, d: str) -> DataFrame:
    return merges.upsert_rows(view(spark, d, "opportunities"), view(spark, d, "opportunities_new"), "opportunity_id").select("opportunity_id", "sold_price", "market_price", "score", "status", "change")


_VERSION = """SELECT opportunity_id, product_name, retailer, lower(replace(status, ' ', '_')) AS status, sold_price AS recent_sold_price, market_price AS current_market_price, required_spend, CAST(score AS DOUBLE) AS opportunity_score, CAST(seq % 5 AS INT) AS purchase_limit, CASE WHEN score > 50 THEN 'BUY' ELSE 'WATCH' END AS recommendation, seq % 9 = 4 AS set_price FROM {opportunities}"""
_VERSION_NEW = """SELECT opportunity_id, product_name, CASE WHEN seq % 11 = 7 THEN concat(retailer, '!') ELSE retailer END AS retailer, lower(replace(status, ' ', '_')) AS status, CASE WHEN seq % 22 = 1 THEN sold_price * 0.95 ELSE sold_price END AS recent_sold_price, market_price AS current_market_price, CASE WHEN seq % 11 = 8 THEN required_spend * 2 ELSE required_spend END AS required_spend,
CASE WHEN seq % 11 = 9 THEN NULL WHEN seq % 11 = 10 THEN score + 10.0 ELSE CAST(score AS DOUBLE) END AS opportunity_score, CAST(CASE WHEN seq % 11 = 6 THEN 9 ELSE seq % 5 END AS INT) AS purchase_limit, CASE WHEN score > 50 THEN 'BUY' ELSE 'WATCH' END AS recommendation, seq % 18 = 4 AS set_price FROM {opportunities_new}"""
_CHANGE_FIELDS = ("product_name", "retailer", "status", "recent_sold_price", "current_market_price", "required_spend", "opportunity_score", "purchase_limit", "recommendation")


def _change_sql(f: str) -> str:
    matters = {"status": "coalesce(n.status IN ('live', 'sold_out', 'restocked'), false) OR coalesce(o.status = 'rumored', false)", "opportunity_score": "coalesce(abs(n.opportunity_score - o.opportunity_score) >= 10, false)", "purchase_limit": "true", "recommendation": "true"}
    price = f"CASE WHEN o.{f} <> 0 AND n.{f} IS NOT NULL THEN abs(n.{f} - o.{f}) / abs(o.{f}) * 100 >= 15 ELSE true END" if f.endswith(("price", "spend")) else "false"
    return f"SELECT n.opportunity_id, '{f}' AS field, {matters.get(f, price)} AS material FROM n JOIN o ON o.opportunity_id = n.opportunity_id WHERE n.{f} IS DISTINCT FROM o.{f}"


@query("A18_change_summary", f"WITH o AS ({_VERSION}), n AS ({_VERSION_NEW}) {' UNION ALL '.join(map(_change_sql, _CHANGE_FIELDS))} UNION ALL SELECT n.opportunity_id, 'complete_set_mismatch', true FROM n JOIN o ON o.opportunity_id = n.opportunity_id WHERE o.set_price AND NOT n.set_price")
def a18(spark: SparkSession, d: str) -> DataFrame:
    old = spark.sql(_VERSION, opportunities=view(spark, d, "opportunities"))
    new = spark.sql(_VERSION_NEW, opportunities_new=view(spark, d, "opportunities_new"))
    return merges.change_summary(old, new, "opportunity_id", _CHANGE_FIELDS, "set_price").select("opportunity_id", "field", "material")


@query("W10_mark_duplicates", "SELECT seq, CASE WHEN seq > f THEN f END AS duplicate_of FROM (SELECT doc_id AS seq, min(doc_id) OVER (PARTITION BY text) AS f FROM {documents})")
def w10(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "texts").select("seq", F.sha2("text", 256).alias("digest"))
    return changes.duplicates(t, ("digest",), "seq").select("seq", "duplicate_of")


@query("W11_row_fingerprint", f"SELECT seq, concat('source:', {_nt('source')}) AS identity, substr(sha256(concat_ws('|', {_nt('lang')}, {_nt('source')}, '', substr({_nt('text')}, 1, 2000))), 1, 24) AS content_hash FROM {{texts}}")
def w11(spark: SparkSession, d: str) -> DataFrame:
    f = merges.row_fingerprint(F.lit(None).cast("string"), F.col("source"), F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("text"))
    return view(spark, d, "texts").select("seq", f.alias("f")).select("seq", "f.*")


@query("W13_table_fingerprint", "SELECT count(*) AS rows, CAST(CAST(sum(CAST(CAST(concat('0x', substr(sha256(concat_ws(chr(31), coalesce(concat('=', n_name), '-'), coalesce(concat('=', n_nationkey), '-'), coalesce(concat('=', n_regionkey), '-'))), 1, 15)) AS BIGINT) AS HUGEINT)) AS HUGEINT) AS VARCHAR) AS digest FROM {nation}")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return merges.table_fingerprint(view(spark, d, "nation"))


_RK = """CASE WHEN field_name = 'retail_price' THEN list_position(['OTHER','SOCIAL','COMMUNITY','MARKETPLACE','NEWS','PRESS_RELEASE','EVENT','OFFICIAL','RETAILER'], source_type) WHEN field_name IN ('current_market_price', 'recent_sold_price') THEN list_position(['OTHER','PRESS_RELEASE','EVENT','OFFICIAL','SOCIAL','COMMUNITY','NEWS','RETAILER','MARKETPLACE'], source_type)
WHEN field_name = 'product_name' THEN list_position(['OTHER','SOCIAL','COMMUNITY','MARKETPLACE','NEWS','EVENT','PRESS_RELEASE','RETAILER','OFFICIAL'], source_type) ELSE CASE source_type WHEN 'OFFICIAL' THEN 90 WHEN 'RETAILER' THEN 80 WHEN 'PRESS_RELEASE' THEN 75 WHEN 'EVENT' THEN 70 WHEN 'MARKETPLACE' THEN 55 WHEN 'NEWS' THEN 50 WHEN 'COMMUNITY' THEN 30 WHEN 'SOCIAL' THEN 20 ELSE 10 END END"""
_EV = f"e AS (SELECT *, coalesce(value_str, CAST(value_num AS VARCHAR)) AS value, {_RK} AS r, CASE certainty WHEN 'rumored' THEN 0 WHEN 'confirmed' THEN 2 ELSE 1 END AS c FROM {{evidence}}), "
_A10 = f"""{_EV}b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY r DESC, c DESC, confidence DESC, seq) AS k FROM e) WHERE k = 1),
x AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.group_id, e.field_name ORDER BY e.r DESC, e.c DESC, e.confidence DESC, e.seq) AS k FROM e JOIN b ON b.group_id = e.group_id AND b.field_name = e.field_name WHERE e.field_name = 'product_name' AND e.certainty <> 'rumored' AND contains({_nt('e.value')}, {_nt('b.value')}) AND {_nt('e.value')} <> {_nt('b.value')} AND {_nt('b.value')} <> '') WHERE k = 1),
n AS (SELECT group_id, field_name, count(DISTINCT value) AS vals, count(*) AS records FROM e GROUP BY group_id, field_name),
rs AS (SELECT b.group_id, b.field_name, coalesce(x.value, b.value) AS chosen, coalesce(x.source_type, b.source_type) AS chosen_source, n.vals AS values_, n.records FROM b LEFT JOIN x ON x.group_id = b.group_id AND x.field_name = b.field_name JOIN n ON n.group_id = b.group_id AND n.field_name = b.field_name)"""


@query("A10_resolve_fields", f"WITH {_A10} SELECT group_id, field_name, chosen, chosen_source, values_ AS n_values, records FROM rs")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return evidence.resolve_fields(view(spark, d, "evidence")).withColumnRenamed("values", "n_values")


@query("A10_accepted_records", f"WITH {_A10} SELECT e.group_id, e.field_name, e.seq, e.value = rs.chosen AS accepted FROM e JOIN rs ON rs.group_id = e.group_id AND rs.field_name = e.field_name")
def a10r(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "evidence")
    return evidence.accepted_records(e, evidence.resolve_fields(e))


@query("A11_price_conflicts", f"""WITH {_EV}s AS (SELECT group_id, field_name, min(value_num) AS low, max(value_num) AS high, max(r) AS top FROM e WHERE value_num IS NOT NULL GROUP BY group_id, field_name HAVING min(value_num) <> max(value_num)),
a AS (SELECT e.group_id, e.field_name, min(value_num) <> max(value_num) AS dis FROM e JOIN s ON s.group_id = e.group_id AND s.field_name = e.field_name WHERE e.certainty <> 'rumored' AND e.r = s.top AND value_num IS NOT NULL GROUP BY e.group_id, e.field_name),
v AS (SELECT s.*, coalesce(dis, false) AS dis, CASE WHEN low <= 0 THEN 'MEDIUM' WHEN (high - low) / low * 100 >= 200 THEN 'CRITICAL' WHEN (high - low) / low * 100 >= 50 THEN 'HIGH' WHEN (high - low) / low * 100 >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s LEFT JOIN a ON a.group_id = s.group_id AND a.field_name = s.field_name)
SELECT group_id, field_name, severity, severity IN ('HIGH', 'CRITICAL') AND dis AS requires_review FROM v""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return evidence.price_conflicts(view(spark, d, "evidence"))


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_PLACE = lambda order: f"10 - list_position({_LIST(order)}, source_type)"
_CLAIM = f"""e AS (SELECT *, coalesce(value_str, CAST(value_num AS VARCHAR)) AS value, {_nt("coalesce(value_str, CAST(value_num AS VARCHAR))")} AS nv, CASE WHEN field_name IN ('franchise', 'required_spend') THEN {_PLACE(evidence.IDENTITY_ORDER)} WHEN field_name IN ('retailer', 'status', 'purchase_limit') THEN {_PLACE(evidence.RETAIL_ORDER)} WHEN field_name = 'estimated_market_price' THEN {_PLACE(evidence.MARKET_ORDER)}
ELSE CASE source_type WHEN 'OFFICIAL' THEN 90 WHEN 'RETAILER' THEN 80 WHEN 'PRESS_RELEASE' THEN 75 WHEN 'EVENT' THEN 70 WHEN 'MARKETPLACE' THEN 55 WHEN 'NEWS' THEN 50 WHEN 'COMMUNITY' THEN 30 WHEN 'SOCIAL' THEN 20 ELSE 10 END END AS r, CASE certainty WHEN 'rumored' THEN 0 WHEN 'confirmed' THEN 2 ELSE 1 END AS c FROM {{claims}}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY r DESC, c DESC, confidence DESC, seq) AS k FROM e) WHERE k = 1),
x AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.group_id, e.field_name ORDER BY e.r DESC, e.c DESC, e.confidence DESC, e.seq) AS k FROM e JOIN b ON b.group_id = e.group_id AND b.field_name = e.field_name WHERE e.field_name IN ('franchise', 'retailer') AND e.certainty <> 'rumored' AND contains(e.nv, b.nv) AND e.nv <> b.nv) WHERE k = 1),
ch AS (SELECT b.group_id, b.field_name, coalesce(x.value, b.value) AS chosen, coalesce(x.source_type, b.source_type) AS chosen_source, coalesce(x.r, b.r) AS top FROM b LEFT JOIN x ON x.group_id = b.group_id AND x.field_name = b.field_name)"""


@query("A10_all_fields", f"WITH {_CLAIM} SELECT group_id, field_name, chosen, chosen_source FROM ch")
def a10_all(spark: SparkSession, d: str) -> DataFrame:
    return evidence.resolve_fields(view(spark, d, "claims")).select("group_id", "field_name", "chosen", "chosen_source")


@query("A11_field_conflicts", f"""WITH {_CLAIM}, v AS (SELECT group_id, field_name, count(DISTINCT value) AS n, min(value_num) AS low, max(value_num) AS high FROM e GROUP BY group_id, field_name HAVING count(DISTINCT value) > 1),
q AS (SELECT e.group_id, e.field_name, count(DISTINCT e.value) > 1 AS dis FROM e JOIN ch ON ch.group_id = e.group_id AND ch.field_name = e.field_name AND e.r = ch.top WHERE e.certainty <> 'rumored' GROUP BY e.group_id, e.field_name),
dv AS (SELECT DISTINCT group_id, field_name, value, nv FROM e WHERE field_name IN ('franchise', 'retailer')), ap AS (SELECT DISTINCT a.group_id, a.field_name FROM dv a JOIN dv b ON a.group_id = b.group_id AND a.field_name = b.field_name AND a.value <> b.value AND NOT contains(a.nv, b.nv) AND NOT contains(b.nv, a.nv)),
w AS (SELECT v.*, coalesce(dis, false) AS dis, ap.group_id IS NOT NULL AS apart, CASE WHEN low <= 0 THEN 'MEDIUM' WHEN (high - low) / low * 100 >= 200 THEN 'CRITICAL' WHEN (high - low) / low * 100 >= 50 THEN 'HIGH' WHEN (high - low) / low * 100 >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS price FROM v LEFT JOIN q ON q.group_id = v.group_id AND q.field_name = v.field_name LEFT JOIN ap ON ap.group_id = v.group_id AND ap.field_name = v.field_name)
SELECT group_id, field_name, n AS n_values, CASE WHEN field_name IN ('franchise', 'retailer') THEN CASE WHEN dis AND apart THEN 'CRITICAL' ELSE 'LOW' END WHEN field_name IN ('required_spend', 'estimated_market_price') THEN price WHEN field_name = 'status' THEN 'INFO' WHEN dis THEN 'MEDIUM' ELSE 'LOW' END AS severity,
CASE WHEN field_name IN ('franchise', 'retailer') THEN dis AND apart WHEN field_name IN ('required_spend', 'estimated_market_price') THEN price IN ('HIGH', 'CRITICAL') AND dis WHEN field_name = 'status' THEN false ELSE dis END AS requires_review FROM w""")
def a11_all(spark: SparkSession, d: str) -> DataFrame:
    return evidence.field_conflicts(view(spark, d, "claims")).withColumnRenamed("values", "n_values")


@query("A12_market_prices", """WITH m AS (SELECT group_id, field_name, median(value_num) AS m FROM {evidence} WHERE field_name IN ('recent_sold_price', 'current_market_price') AND value_num IS NOT NULL GROUP BY group_id, field_name),
j AS (SELECT e.*, m.m, value_num <= m.m * 1.3 AND value_num >= m.m / 1.3 AS inl FROM {evidence} e JOIN m ON m.group_id = e.group_id AND m.field_name = e.field_name WHERE value_num IS NOT NULL)
SELECT group_id, field_name, coalesce(median(value_num) FILTER (inl), any_value(m)) AS price, count(*) FILTER (inl) AS inliers, count(*) FILTER (NOT inl) AS outliers, count(DISTINCT unit_scope) FILTER (inl AND unit_scope <> 'unknown') AS unit_scopes, count(DISTINCT grading) FILTER (inl AND grading <> 'unknown') > 1 AS grading_conflict FROM j GROUP BY group_id, field_name""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return evidence.market_prices(view(spark, d, "evidence"), ("recent_sold_price", "current_market_price"), 1.3)


@query("A13_extreme_claims", """SELECT c.group_id, resale, spend FROM (SELECT group_id, max(value_num) AS resale, bool_and(source_type IN ('SOCIAL','COMMUNITY','OTHER')) AS weak FROM {evidence} WHERE field_name = 'current_market_price' GROUP BY group_id) c JOIN (SELECT group_id, min(value_num) AS spend FROM {evidence} WHERE field_name = 'retail_price' GROUP BY group_id) s ON s.group_id = c.group_id WHERE weak AND spend > 0 AND resale >= spend * 1.1""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return evidence.extreme_claims(view(spark, d, "evidence"), "current_market_price", "retail_price", 1.1)


@query("A14_resolve_status", """SELECT group_id, status, history FROM (SELECT group_id, string_agg(grading, '>' ORDER BY observed_at, seq) AS history FROM {evidence} GROUP BY group_id) h JOIN (SELECT group_id AS g, grading AS status FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN source_type IN ('OFFICIAL','RETAILER','EVENT') THEN 0 ELSE 1 END, observed_at DESC, seq) AS k FROM {evidence}) WHERE k = 1) s ON s.g = h.group_id""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return evidence.resolve_status(view(spark, d, "evidence").withColumn("status", F.col("grading")))


def products(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "products").select(F.col("seq").alias("id"), "title", "sku", F.col("product_type").alias("type"))


_TOK = "list_distinct(list_filter(string_split(trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND NOT list_contains(['pokemon','the','a','an','new','official','trading','card','game','tcg','product','with','and','edition'], w)))"
_J3 = f"""p AS (SELECT seq AS id, {_TOK} AS t, coalesce(product_type, 'unknown') AS ty, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(sku)), '[\\s_]+', '-', 'g'), '[^a-z0-9-]+', '', 'g'), '-+', '-', 'g'), '-') AS code FROM {{products}}),
g AS (SELECT list_sort(t) AS t, ty, min(id) AS rep FROM p WHERE len(t) > 0 GROUP BY 1, 2),
near AS (SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.rep < b.rep WHERE least(1.0, floor((len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) + CASE WHEN a.ty = b.ty AND a.ty <> 'unknown' THEN 0.15 ELSE 0 END) * 1000 + 0.5) / 1000) >= 0.72),
lk AS (SELECT a, b FROM near UNION ALL SELECT g.rep, p.id FROM p JOIN g ON list_sort(p.t) = g.t AND p.ty = g.ty WHERE p.id <> g.rep UNION ALL SELECT f.a, p.id FROM p JOIN (SELECT code, min(id) AS a FROM p WHERE coalesce(code, '') <> '' GROUP BY code) f ON f.code = p.code WHERE p.id <> f.a)"""


@query("J3_similar_products", f"""WITH {_J3}, scored AS (SELECT a.rep AS a, b.rep AS b, least(1.0, floor((len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) + CASE WHEN a.ty = b.ty AND a.ty <> 'unknown' THEN 0.15 ELSE 0 END) * 1000 + 0.5) / 1000) AS s FROM g a JOIN g b ON a.rep < b.rep),
same AS (SELECT g.rep AS a, p.id AS b FROM p JOIN g ON list_sort(p.t) = g.t AND p.ty = g.ty WHERE p.id <> g.rep UNION ALL SELECT f.a, p.id FROM p JOIN (SELECT code, min(id) AS a FROM p WHERE coalesce(code, '') <> '' GROUP BY code) f ON f.code = p.code WHERE p.id <> f.a)
SELECT a, b, max(s) AS similarity FROM (SELECT a, b, s FROM scored WHERE s >= 0.72 UNION ALL SELECT a, b, 1.0 FROM same) GROUP BY a, b""")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return groups.similar_products(products(spark, d))


@query("J5_product_groups", f"WITH RECURSIVE {_J3}, u AS (SELECT a AS x, b AS y FROM lk UNION SELECT b, a FROM lk), w AS (SELECT x AS id, x AS r FROM u UNION SELECT u.y, w.r FROM w JOIN u ON u.x = w.id WHERE w.r < u.y) SELECT p.id, least(p.id, coalesce(min(w.r), p.id)) AS group_id FROM p LEFT JOIN w ON w.id = p.id GROUP BY p.id")
def j5(spark: SparkSession, d: str) -> DataFrame:
    p = products(spark, d)
    return groups.group_products(p, groups.similar_products(p))


@query("W12_similar_texts", f"""WITH n AS (SELECT seq, list_sort(list_distinct(string_split({_nt('text')}, ' '))) AS t FROM {{texts}}), x AS (SELECT min(seq) AS id, t FROM n GROUP BY t), e AS (SELECT id, len(t) AS m, unnest(t) AS w FROM x),
c AS (SELECT a.id AS a, b.id AS b, a.m AS ma, b.m AS mb, count(*) AS k FROM e a JOIN e b ON a.w = b.w AND a.id < b.id GROUP BY ALL) SELECT a, b, round(k / (ma + mb - k), 6) AS similarity FROM c WHERE k / (ma + mb - k) >= 0.7""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts whose word sets are alike; equal word sets are represented by their smallest id."""
    from larkspur.functions import text as T

    words = view(spark, d, "texts").select(F.col("seq").alias("id"), F.array_sort(F.array_distinct(F.split(T.norm_text(F.col("text")), " "))).alias("tokens"))
    distinct = words.groupBy("tokens").agg(F.min("id").alias("id")).select("id", "tokens")
    return groups.similar_sets(distinct, 0.7).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("J14_category_paths", "WITH RECURSIVE e AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey // 2 END AS parent FROM {nation}), r AS (SELECT node, parent AS ancestor, 1 AS depth FROM e WHERE parent IS NOT NULL UNION ALL SELECT r.node, e.parent, r.depth + 1 FROM r JOIN e ON e.node = r.ancestor WHERE e.parent IS NOT NULL AND r.depth < 10) SELECT node, ancestor, depth FROM r")
def j14(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "nation")
    edges = n.select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") % 5 != 0, F.floor(F.col("n_nationkey") / 2)).cast("int").alias("parent"))
    return groups.reach(edges)
