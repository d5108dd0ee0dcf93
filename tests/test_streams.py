"""Streams with keyed state against the batch operators and plain Python, whatever order rows arrive in."""

import random
from collections import Counter, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import changes
from larkspur.plans.streams_plan import arrived, replay
from larkspur.streaming import changes as streams
from larkspur.streaming import keyed

OBSERVED = "product_key long, seq long, observed_at timestamp, availability string, price double, sources array<string>, strategy_score double, tier string"
T0 = datetime(2024, 1, 1)


def rows_of(df):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def observed(spark):
    rng = random.Random(3)
    rows = []
    for key in (1, 2, 3, None):
        for seq in range(1, 40):
            rows.append((key, seq, T0 + timedelta(hours=5 * seq), rng.choice(["in stock", "sold out", "pre-order", None]), rng.choice([1.0, 2.5, None]), [rng.choice("ab")], rng.choice([1.0, 20.0, None]), rng.choice(["HIGH", "WATCH", None])))
    return spark.createDataFrame(rows, OBSERVED)


def test_changes_whatever_the_order_of_arrival(observed):
    for stream, batch in ((streams.stream_changes, changes.detect_changes), (streams.stream_single, changes.detect_change_single)):
        got = arrived(observed, "observed_at", 3, lambda s, f=stream: f(s, delay="3 days"))
        assert rows_of(got) == rows_of(batch(observed).select(got.columns))


def test_late_and_repeated_observations(spark):
    row = lambda seq, availability, price: (1, seq, T0 + timedelta(days=seq), availability, price, ["a"], 1.0, "HIGH")
    rows = spark.createDataFrame([row(1, "sold out", 5.0), row(3, "in stock", 5.0), row(2, "in stock", 4.0), row(9, "in stock", 3.0), row(9, "in stock", 3.0), (2, 30, T0 + timedelta(days=30), None, None, None, None, None), (None, 99, T0 + timedelta(days=99), None, None, None, None, None)], OBSERVED)
    parts = [F.col("seq").isin(1, 3), F.col("seq") == 30, F.col("seq") == 2, F.col("seq") == 9, F.col("seq") == 99]
    where = replay(rows, parts, lambda s, w: keyed.run_to_end(streams.stream_changes(s, delay="1 day"), w))
    got = sorted((r.product_key, r.seq, r.event, r.previous_value) for r in spark.read.parquet(f"{where}/out").collect())
    assert got == [(1, 1, "NEW_PRODUCT", None), (1, 2, "LATE", None), (1, 3, "RESTOCK", None), (1, 9, "LATE", None), (1, 9, "PRICE_DROP", "500"), (2, 30, "NEW_PRODUCT", None)]


@pytest.fixture(scope="module")
def runs(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 2, 3, None]), T0 + timedelta(seconds=rng.randrange(200_000)), rng.choice([True, False, False, None])) for i in range(600)]
    rows += [(1000 + i, 1, T0 + timedelta(seconds=5000), False) for i in range(20)]
    return spark.createDataFrame(rows, "event_id long, source_id long, ts timestamp, success boolean")


def test_lockout_matches_plain_python(runs):
    seconds, mine, everyone = 7200, 5, 14
    rows = [(r.event_id, r.source_id, int((r.ts - T0).total_seconds()), r.success) for r in runs.collect()]
    failures = [(k, t) for _, k, t, ok in rows if ok is False]
    got = {r.event_id: (r.recent_failures, r.recent_all, r.locked) for r in changes.lockout(runs, mine, everyone, seconds).collect()}
    assert len(got) == len(rows)
    for i, key, t, _ in rows:
        total = sum(t - seconds <= s <= t for _, s in failures)
        own = None if key is None else sum(k == key and t - seconds <= s <= t for k, s in failures)
        assert got[i] == (own, total, total >= everyone or (own or 0) >= mine)
    long = {r["at"]: r.recent_failures for r in changes.rolling_failures(runs, 100_000).collect()}
    base = int((runs.agg(F.unix_timestamp(F.min("ts"))).first()[0])) - min(t for _, _, t, _ in rows)
    assert all(long[base + t] == sum(t - 100_000 <= s <= t for _, s in failures) for _, _, t, _ in rows)


def test_streams_of_runs_match_their_batches(runs):
    known = runs.where("source_id is not null and success is not null")
    got = arrived(known, "ts", 1, lambda s: streams.stream_lockout(s, 5, 7200, delay="1 day"))
    assert rows_of(got) == rows_of(changes.failure_lockout(known, 5, 7200).select(got.columns))
    got = arrived(known, "ts", 1, lambda s: streams.stream_global_lockout(s, 14, 7200, "1 day"))
    seconds = known.where("not success").select(F.unix_timestamp("ts").alias("at")).distinct()
    assert rows_of(got) == rows_of(changes.rolling_failures(known, 7200).join(seconds, "at").where("recent_failures >= 14").select(got.columns))
    got = streams.latest(arrived(known, "ts", 1, lambda s: streams.stream_streaks(s, "1 day")), "source_id")
    assert rows_of(got) == rows_of(changes.failure_streaks(known).select(got.columns))
    got = arrived(known, "ts", 1, lambda s: streams.stream_quotes(s, "source_id", 900, "event_id", "1 day"))
    assert rows_of(got) == rows_of(changes.reuse_quotes(known, "source_id", 900).select(got.columns))


ACTIONS = "product_key long, event string, seq long, action string, observed_at timestamp"


def plain_records(rows):
    """Records by going through each key's actions one by one."""
    order, out = {"resolve": 0, "alert": 1, "acknowledge": 2, "forward": 3}, []
    by_key = {}
    for key, event, seq, action, _ in rows:
        if key is not None and event is not None and action in order:
            by_key.setdefault((key, event), set()).add((seq, order[action], action))
    for (key, event), actions in by_key.items():
        record, todo = None, deque(sorted(actions))
        while todo:
            seq, _, action = todo.popleft()
            if action == "alert" and record is None:
                record = {"opened": seq, "acknowledged": None, "forwarded": None, "resolved": None}
                out.append((key, event, record))
            elif record is not None and action != "alert":
                name = {"acknowledge": "acknowledged", "forward": "forwarded", "resolve": "resolved"}[action]
                record[name] = seq if record[name] is None else record[name]
                record = None if action == "resolve" else record
    status = lambda r: "RESOLVED" if r["resolved"] is not None else "ACTIVE" if r["acknowledged"] is not None else "NEW"
    return Counter((k, e, r["opened"], r["acknowledged"], r["forwarded"], r["resolved"], status(r)) for k, e, r in out)


FIELDS = ("product_key", "event", "opened", "acknowledged", "forwarded", "resolved", "status")


def test_alert_records(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["RESTOCK", "PRICE_DROP"]), seq, rng.choice(["alert", "alert", "forward", "acknowledge", "resolve"]), T0 + timedelta(hours=seq)) for k in (1, 2, 3) for seq in range(60) for _ in range(rng.randrange(3))]
    rows += [(None, "RESTOCK", 1, "alert", T0), (4, None, 1, "alert", T0), (5, "RESTOCK", 1, "unknown", T0), (6, "RESTOCK", 1, "forward", T0), (6, "RESTOCK", 2, "alert", T0), (6, "RESTOCK", 2, "alert", T0)]
    actions = spark.createDataFrame(rows, ACTIONS)
    want = plain_records(rows)
    assert rows_of(changes.alert_records(actions).select(*FIELDS)) == want
    known = actions.where("product_key is not null and event is not null and action <> 'unknown'")
    got = arrived(known, "observed_at", 1, lambda s: streams.stream_alert_records(s, delay="1 day"))
    assert rows_of(streams.records_of(got).select(*FIELDS)) == want


def test_alert_life_cycle_step_by_step(spark):
    """One open record a product and event; forwarding touches the open record only and not its status; a resolution lets the next
    alert open another, not forwarded yet; actions without an open record do nothing."""
    rows = [("alert", 1), ("alert", 2), ("forward", 3), ("forward", 4), ("resolve", 5), ("resolve", 6), ("forward", 7), ("alert", 8)]
    actions = spark.createDataFrame([(1, "RESTOCK", seq, action, T0) for action, seq in rows] + [(2, "RESTOCK", 1, "alert", T0)], ACTIONS)
    got = sorted(tuple(r) for r in changes.alert_records(actions).select(*FIELDS).collect())
    assert got == [(1, "RESTOCK", 1, None, 3, 5, "RESOLVED"), (1, "RESTOCK", 8, None, None, None, "NEW"), (2, "RESTOCK", 1, None, None, None, "NEW")]
    events = spark.createDataFrame([(1, "NEW_PRODUCT", 1), (1, "RESTOCK", 9)], "product_key long, event string, seq long")
    sent = sorted((r.product_key, r.event, r.seq, r.opened) for r in changes.forward_once(changes.alert_records(actions), events).collect())
    assert sent == [(1, "NEW_PRODUCT", 1, None), (1, "RESTOCK", 3, 1)]
    assert changes.alert_records(actions.limit(0)).count() == 0
