"""Registered queries that replay tables as streams or write and read snapshots, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import changes
from larkspur.plans.changes_plan import _A25, _C1, alerts, observations
from larkspur.plans.changes_plan import SQL as BATCH_SQL
from larkspur.plans.views import plain, view
from larkspur.sources import snapshots
from larkspur.sources.tables import cut, shared_folder
from larkspur.streaming import changes as streams
from larkspur.streaming import keyed

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL (names of tables and views in braces)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = plain(sql)
        return f

    return add


def replay(rows: DataFrame, parts: Sequence[Column], run: Callable[[DataFrame, str], object]) -> str:
    """Let rows arrive in parts: each is added to a folder, then `run` takes the folder as a stream, with the place for its
    state and output, to the end of what is there. Returns that place."""
    spark = rows.sparkSession
    where = f"{shared_folder(spark)}/larkspur-stream-{uuid.uuid4().hex}"
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{where}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{where}/in"), where)
    return where


def arrived(rows: DataFrame, at: str, days: int, make: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """What a stream has emitted when all rows have arrived, each up to `days` late and so in another order than their times, in
    parts. A last row without a key, long after all others, settles what waits."""
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(days * 86400))
    known = cut(rows.withColumn("arrives", F.unix_timestamp(at) + late))
    low, high = known.agg(F.min("arrives"), F.max("arrives")).first()
    low, high = low or 0, high or 0
    edges = [low + (high - low + 1) * i // parts for i in range(parts + 1)]
    last = known.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != at else F.lit("9999-01-01").cast(f.dataType).alias(at) for f in known.schema))
    last = last.withColumn("arrives", F.lit(high + 1).cast("long"))
    cuts = [(F.col("arrives") >= a) & (F.col("arrives") < b) for a, b in zip(edges[:-1], [*edges[1:-1], high + 1], strict=True)]
    where = replay(known.unionByName(last), [*cuts, F.col("arrives") == high + 1], lambda s, w: keyed.run_to_end(make(s), w))
    return known.sparkSession.read.parquet(f"{where}/out")


def _observed(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select("product_key", F.col("seq").cast("long").alias("seq"), F.col("observed_at").cast("timestamp").alias("observed_at"), *changes.STATE)


@query("C1_stream_changes", f"WITH {_C1} SELECT * FROM ev")
def c1_stream(spark: SparkSession, d: str) -> DataFrame:
    """Observations arrive up to 60 days late, in three parts; the events are those of the batch operator."""
    return arrived(_observed(spark, d), "observed_at", 60, lambda s: streams.stream_changes(s, delay="60 days"))


@query("C2_stream_single")
def c2_stream(spark: SparkSession, d: str) -> DataFrame:
    return arrived(_observed(spark, d), "observed_at", 60, lambda s: streams.stream_single(s, delay="60 days"))


SQL["C2_stream_single"] = BATCH_SQL["C2_single_event"]

#: What ends a record of an event, and what confirms one.
_ENDS = {"RESTOCK": "SOLD_OUT", "SOLD_OUT": "RESTOCK", "PRICE_DROP": "PRICE_INCREASE", "PRICE_INCREASE": "PRICE_DROP"}
_ACT = f"""{_C1}, al AS ({_A25}),
act AS (SELECT product_key, event, seq, 'alert' AS action, 1 AS o FROM al WHERE should_alert
UNION ALL SELECT product_key, event, seq, 'forward', 3 FROM al WHERE priority IN ('CRITICAL', 'HIGH')
UNION ALL SELECT product_key, CASE event WHEN 'RESTOCK' THEN 'SOLD_OUT' WHEN 'SOLD_OUT' THEN 'RESTOCK' WHEN 'PRICE_DROP' THEN 'PRICE_INCREASE' ELSE 'PRICE_DROP' END, seq, 'resolve', 0 FROM ev WHERE event IN ('RESTOCK', 'SOLD_OUT', 'PRICE_DROP', 'PRICE_INCREASE')
UNION ALL SELECT product_key, 'NEW_PRODUCT', seq, 'acknowledge', 2 FROM ev WHERE event = 'NEW_CONFIRMATION'),
isl AS (SELECT *, coalesce(count(*) FILTER (action = 'resolve') OVER (PARTITION BY product_key, event ORDER BY seq, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM act),
op AS (SELECT *, min(CASE WHEN action = 'alert' THEN seq * 4 + o END) OVER (PARTITION BY product_key, event, island) AS first FROM isl),
rec AS (SELECT product_key, event, min(seq) FILTER (action = 'alert') AS opened, min(seq) FILTER (action = 'acknowledge') AS acknowledged, min(seq) FILTER (action = 'forward') AS forwarded, min(seq) FILTER (action = 'resolve') AS resolved
FROM op WHERE seq * 4 + o >= first GROUP BY product_key, event, island)"""
_REC = f"WITH {_ACT} SELECT *, CASE WHEN resolved IS NOT NULL THEN 'RESOLVED' WHEN acknowledged IS NOT NULL THEN 'ACTIVE' ELSE 'NEW' END AS status FROM rec"
_RECORD = ("product_key", "event", "opened", "acknowledged", "forwarded", "resolved", "status")


def scored_events(spark: SparkSession, d: str) -> DataFrame:
    return cut(alerts(spark, d).select("product_key", "event", F.col("seq").cast("long").alias("seq"), "priority", "should_alert"))


def alert_actions(scored: DataFrame) -> DataFrame:
    """Alerts open records, urgent ones are forwarded, the opposite event resolves, and a confirmation acknowledges a new product."""
    ends = F.create_map(*(F.lit(x) for kv in _ENDS.items() for x in kv))[F.col("event")]
    act = lambda when, action, event=F.col("event"): F.when(when, F.struct(event.alias("event"), F.lit(action).alias("action")))
    each = F.array(
        act(F.col("should_alert"), "alert"),
        act(F.col("priority").isin("CRITICAL", "HIGH"), "forward"),
        act(F.col("event").isin(*_ENDS), "resolve", ends),
        act(F.col("event") == "NEW_CONFIRMATION", "acknowledge", F.lit("NEW_PRODUCT")),
    )
    return scored.select("product_key", "seq", F.explode(each).alias("a")).where("a is not null").select("product_key", "a.event", "seq", "a.action")


@query("C4_alert_records", _REC)
def c4_records(spark: SparkSession, d: str) -> DataFrame:
    return changes.alert_records(alert_actions(scored_events(spark, d))).select(*_RECORD)


@query("C4_stream_alerts", _REC)
def c4_stream(spark: SparkSession, d: str) -> DataFrame:
    """Actions arrive up to 30 days late; the records that their transitions lead to."""
    dated = observations(spark, d).select("product_key", F.col("seq").cast("long").alias("seq"), F.col("observed_at").cast("timestamp").alias("observed_at"))
    actions = alert_actions(scored_events(spark, d)).join(dated, ["product_key", "seq"])
    found = arrived(actions, "observed_at", 30, lambda s: streams.stream_alert_records(s, delay="30 days"))
    return streams.records_of(found).select(*_RECORD)


@query("C5_forwarded", f"WITH {_ACT}, sent AS (SELECT product_key, event, forwarded AS seq, opened FROM rec WHERE forwarded IS NOT NULL) SELECT * FROM sent UNION ALL SELECT product_key, event, min(seq), NULL FROM ev e WHERE event = 'NEW_PRODUCT' AND NOT EXISTS (SELECT 1 FROM sent s WHERE s.product_key = e.product_key AND s.event = 'NEW_PRODUCT') GROUP BY product_key, event")
def c5_forwarded(spark: SparkSession, d: str) -> DataFrame:
    """Each record that was forwarded, once, and every new product."""
    scored = scored_events(spark, d)
    return changes.forward_once(changes.alert_records(alert_actions(scored)), scored)


@query("C7_stream_pages")
def c7_stream(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of fetches arrive one after the other; the statuses of the second."""
    fetches = view(spark, d, "fetches")
    where = replay(fetches, [F.col("round") == 1, F.col("round") == 2], lambda s, w: streams.fold_batches(s, streams.page_step, w))
    return spark.read.parquet(f"{where}/rows").where("batch = 1").drop("batch")


SQL["C7_stream_pages"] = BATCH_SQL["C7_page_changes"]


def _streaks(spark: SparkSession, d: str) -> DataFrame:
    found = arrived(view(spark, d, "source_runs"), "ts", 2, lambda s: streams.stream_streaks(s, "2 days"))
    return streams.latest(found, "source_id")


@query("C8_stream_health")
def c8_stream(spark: SparkSession, d: str) -> DataFrame:
    """Runs arrive up to two days late; the health of each source after the last."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return changes.health_of(_streaks(spark, d), now, stale_hours=30).select("source_id", "consecutive_failures", "health_status", "recommended_action")


SQL["C8_stream_health"] = BATCH_SQL["C8_source_health"]


@query("C9_stream_backoff")
def c9_stream(spark: SparkSession, d: str) -> DataFrame:
    return changes.backoff(_streaks(spark, d)).select("source_id", "consecutive_failures", "backoff_seconds")


SQL["C9_stream_backoff"] = BATCH_SQL["C9_backoff"]


@query("C10_stream_lockout")
def c10_stream(spark: SparkSession, d: str) -> DataFrame:
    return arrived(view(spark, d, "source_runs"), "ts", 2, lambda s: streams.stream_lockout(s, 4, 86400, delay="2 days"))


SQL["C10_stream_lockout"] = BATCH_SQL["C10_failure_lockout"].replace("SELECT event_id, source_id", "SELECT source_id, event_id", 1)


@query("C10_stream_global", 'SELECT DISTINCT sec AS "at", recent_failures FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS sec, count(*) OVER (ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent_failures FROM {source_runs} WHERE NOT success) WHERE recent_failures >= 3')
def c10_global(spark: SparkSession, d: str) -> DataFrame:
    return arrived(view(spark, d, "source_runs"), "ts", 2, lambda s: streams.stream_global_lockout(s, 3, 3600, "2 days"))


@query("C11_stream_quotes")
def c11_stream(spark: SparkSession, d: str) -> DataFrame:
    return arrived(view(spark, d, "source_runs"), "ts", 2, lambda s: streams.stream_quotes(s, "source_id", 900, "event_id", "2 days"))


SQL["C11_stream_quotes"] = BATCH_SQL["C11_reuse_quotes"]


@query("S2_snapshot_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {customer}")
def s2(spark: SparkSession, d: str) -> DataFrame:
    base = f"{shared_folder(spark)}/larkspur-snapshots-{uuid.uuid4().hex}"
    customers = view(spark, d, "customer")
    snapshots.write_snapshot(customers.where("c_custkey % 2 = 0"), base, "run-1")
    snapshots.write_snapshot(customers, base, "run-2")
    return snapshots.read_current(spark, base)


@query("S3_history", "SELECT * FROM (SELECT 'run-2' AS run_id, count(*) AS rows FROM {customer} UNION ALL SELECT 'run-1', count(*) FROM {customer} WHERE c_custkey % 2 = 0)")
def s3(spark: SparkSession, d: str) -> DataFrame:
    base = f"{shared_folder(spark)}/larkspur-snapshots-{uuid.uuid4().hex}"
    customers = view(spark, d, "customer")
    snapshots.write_snapshot(customers.where("c_custkey % 2 = 0"), base, "run-1")
    snapshots.write_snapshot(customers, base, "run-2")
    return snapshots.list_history(spark, base)


@query("S1_read_items", "SELECT n_nationkey, n_name FROM {nation}")
def s1(spark: SparkSession, d: str) -> DataFrame:
    base = f"{shared_folder(spark)}/larkspur-items-{uuid.uuid4().hex}"
    view(spark, d, "nation").select("n_nationkey", "n_name").write.json(base)
    missing = snapshots.read_items(spark, f"{base}-missing", "n_nationkey int, n_name string")
    return snapshots.read_items(spark, base, "n_nationkey int, n_name string").unionByName(missing)


_LINES = "concat(chr(123), '\"c_custkey\": ', CASE WHEN c_custkey % 7 = 1 THEN '\"none\"' ELSE CAST(c_custkey AS {0}) END, ', \"c_name\": \"', c_name, CASE WHEN c_custkey % 11 = 2 THEN '' ELSE '\"' END, ', \"more\": [1]', chr(125))"


@query("S1_quarantine", f"SELECT CASE WHEN ok THEN c_custkey END AS c_custkey, CASE WHEN ok THEN c_name END AS c_name, CASE WHEN NOT ok THEN line END AS record FROM (SELECT *, c_custkey % 7 <> 1 AND c_custkey % 11 <> 2 AS ok, {_LINES.format('VARCHAR')} AS line FROM {{customer}})")
def s1_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Customers as JSON lines, some of another type and some cut short: the rows that fit and the lines that don't."""
    base = f"{shared_folder(spark)}/larkspur-items-{uuid.uuid4().hex}"
    view(spark, d, "customer").select(F.expr(_LINES.format("STRING"))).write.text(base)
    rows, rejects = snapshots.read_checked(spark, base, "c_custkey long, c_name string")
    none = lambda kind: F.lit(None).cast(kind)
    return rows.withColumn("record", none("string")).unionByName(rejects.select(none("long").alias("c_custkey"), none("string").alias("c_name"), "record"))


@query("U4_append_log", "SELECT log_id, decision, score FROM {decision_log}")
def u4(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/larkspur-log-{uuid.uuid4().hex}"
    log = view(spark, d, "decision_log").select("log_id", "decision", "score")
    snapshots.append_log(log.where("log_id % 2 = 0"), path)
    snapshots.append_log(log.where("log_id % 2 = 1"), path)
    return spark.read.schema(log.schema).parquet(path)
