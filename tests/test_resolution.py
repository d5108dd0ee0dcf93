"""Worked examples of field resolution, changes of opportunities and registries of sources."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from larkspur.operators import evidence, merges, registry

SCHEMA = "group_id int, seq int, field_name string, value_num double, value_str string, source_type string, certainty string, confidence double"


def conflicts(spark, *rows):
    df = spark.createDataFrame([(1, i, *r, 50.0) for i, r in enumerate(rows)], SCHEMA)
    return {r.field_name: (r.severity, r.requires_review) for r in evidence.field_conflicts(df).collect()}


def test_sources_are_ordered_by_the_kind_of_field(spark):
    chosen = {}
    for field in ("franchise", "stated_quantity", "purchase_limit", "retailer", "estimated_market_price", "artist_name"):
        rows = [(1, i, field, None, s, s, "confirmed", 50.0) for i, s in enumerate(("NEWS", "MARKETPLACE", "OFFICIAL", "RETAILER"))]
        chosen[field] = evidence.resolve_fields(spark.createDataFrame(rows, SCHEMA)).first().chosen
    assert chosen == {"franchise": "OFFICIAL", "stated_quantity": "OFFICIAL", "purchase_limit": "RETAILER", "retailer": "RETAILER", "estimated_market_price": "MARKETPLACE", "artist_name": "OFFICIAL"}


def test_conflicts_of_fields(spark):
    text = lambda f, v, s, c="confirmed": (f, None, v, s, c)
    price = lambda f, v, s, c="confirmed": (f, v, None, s, c)
    assert conflicts(spark, text("brand", "Acme", "OFFICIAL"), text("brand", "Zeta", "OFFICIAL")) == {"brand": ("CRITICAL", True)}
    assert conflicts(spark, text("brand", "Acme", "OFFICIAL"), text("brand", "Acme Toys", "OFFICIAL")) == {"brand": ("LOW", False)}
    assert conflicts(spark, text("brand", "Acme", "OFFICIAL"), text("brand", "Zeta", "OFFICIAL", "rumored")) == {"brand": ("LOW", False)}
    assert conflicts(spark, text("brand", "Acme", "OFFICIAL"), text("brand", "Zeta", "SOCIAL")) == {"brand": ("LOW", False)}
    assert conflicts(spark, price("required_spend", 10.0, "OFFICIAL"), price("required_spend", 40.0, "OFFICIAL")) == {"required_spend": ("CRITICAL", True)}
    assert conflicts(spark, price("required_spend", 10.0, "OFFICIAL"), price("required_spend", 40.0, "NEWS")) == {"required_spend": ("CRITICAL", False)}
    assert conflicts(spark, price("estimated_market_price", 100.0, "NEWS"), price("estimated_market_price", 110.0, "NEWS")) == {"estimated_market_price": ("LOW", False)}
    assert conflicts(spark, text("status", "live", "RETAILER"), text("status", "sold_out", "RETAILER")) == {"status": ("INFO", False)}
    assert conflicts(spark, text("edition_name", "One", "NEWS"), text("edition_name", "Two", "NEWS")) == {"edition_name": ("MEDIUM", True)}
    assert conflicts(spark, text("edition_name", "One", "OFFICIAL"), text("edition_name", "Two", "NEWS")) == {"edition_name": ("LOW", False)}
    assert conflicts(spark, text("edition_name", "One", "OFFICIAL"), text("edition_name", "One", "NEWS"), text("artist", None, "NEWS")) == {}


def test_material_changes(spark):
    schema = "id int, status string, retail_price double, opportunity_score double, purchase_limit int, retailer string, updated_at string, set_price boolean"
    fields = ("status", "retail_price", "opportunity_score", "purchase_limit", "retailer", "updated_at")
    pairs = [
        (("announced", 10.0, 50.0, 1, "a", "x", True), ("live", 11.5, 60.0, 2, "b", "y", False)),
        (("live", 10.0, 50.0, 1, "a", "x", False), ("announced", 11.4, 59.9, 1, "a", "y", True)),
        (("rumored", None, None, 1, "a", "x", None), ("announced", 1.0, 60.0, 1, "a", "x", None)),
        (("live", 0.0, 5.0, 1, "a", "x", True), ("live", None, None, None, "a", "x", True)),
    ]
    old = spark.createDataFrame([(i, *o) for i, (o, _) in enumerate(pairs)] + [(9, "live", 1.0, 1.0, 1, "a", "x", True)], schema)
    new = spark.createDataFrame([(i, *n) for i, (_, n) in enumerate(pairs)], schema)
    got = {}
    for r in merges.change_summary(old, new, "id", fields, "set_price").collect():
        got.setdefault(r.id, {})[r.field] = r.material
    assert got == {
        0: {"status": True, "retail_price": True, "opportunity_score": True, "purchase_limit": True, "retailer": False, "complete_set_mismatch": True},
        1: {"status": False, "retail_price": False, "opportunity_score": False},
        2: {"status": True, "retail_price": True, "opportunity_score": False},
        3: {"retail_price": True, "opportunity_score": False, "purchase_limit": True},
    }


SOURCE = "source_id string, url string, enabled boolean, lifecycle string, connector_type string, source_type string, authority_level string"


def test_breaking_changes_of_sources(spark):
    row = lambda i, **x: tuple({"source_id": i, "url": "u", "enabled": True, "lifecycle": "active", "connector_type": "rss", "source_type": "t", "authority_level": "official_primary", **x}.values())
    old = spark.createDataFrame([row("same"), row("url"), row("first url", url=None), row("fell"), row("odd"), row("gone"), row("gone paused", lifecycle="paused"), row("gone off", enabled=False), row("off"), row("more")], SOURCE)
    new = spark.createDataFrame([row("same"), row("url", url="v"), row("first url"), row("fell", authority_level="reputable_press"), row("odd", authority_level="nobody"), row("off", enabled=False), row("more", connector_type="html", source_type="x"), row("new")], SOURCE)
    got = {r.source_id: (r.change, r.switched, r.breaking) for r in registry.diff_registry(old, new, "source_id", ("url", "enabled", "connector_type", "source_type", "authority_level")).collect()}
    assert got == {
        "url": ("changed", None, "url"), "first url": ("changed", None, ""), "fell": ("changed", None, "authority_level"), "odd": ("changed", None, ""), "gone": ("removed", None, "removed"),
        "gone paused": ("removed", None, ""), "gone off": ("removed", None, ""), "off": ("changed", "disabled", ""), "more": ("changed", None, "connector_type,source_type"), "new": ("added", None, ""),
    }


def test_settings_of_sources(spark):
    sources = spark.createDataFrame([(1, "own", {"a": "own"}), (2, None, None), (3, None, {})], "source_id int, schedule string, config map<string,string>")
    scouts = spark.createDataFrame([("x", "hourly", "low", {"a": "x", "b": "x"}), ("y", "daily", "high", {"b": "y", "c": "y"}), ("z", None, "archival", None)], "scout_id string, schedule string, priority string, config map<string,string>")
    links = spark.createDataFrame([(1, "y"), (2, "y"), (2, "x"), (2, "gone"), (3, "gone")], "source_id int, scout_id string")
    got = {r.source_id: (r.schedule, r.priority) for r in registry.effective_settings(sources, links, scouts).collect()}
    assert got == {1: ("own", "high"), 2: ("hourly", "high"), 3: ("manual", "medium")}
    configs = {r.source_id: r.config for r in registry.connector_configs(sources, links, scouts, {"a": "0", "d": "0"}).collect()}
    assert configs == {1: {"a": "own", "b": "y", "c": "y", "d": "0"}, 2: {"a": "x", "b": "y", "c": "y", "d": "0"}, 3: {"a": "0", "d": "0"}}
    assert registry.connector_configs(sources, links.limit(0), scouts).where("source_id = 2").first().config == {}


def test_order_of_the_worklist(spark):
    rows = [(i, "runnable", s, p, a, None) for i, (s, p, a) in enumerate([("daily", "archival", "official_primary"), ("daily", "medium", "manual_trusted"), ("daily", "medium", "official_primary"), ("manual", "critical", "official_primary"), ("daily", "low", "official_primary"), ("daily", "high", "x"), ("daily", "critical", "x"), (None, "critical", "x"), ("daily", "unheard", "x")])]
    work = spark.createDataFrame([*rows, (99, "disabled", "daily", "critical", "x", None)], "source_id int, state string, schedule string, priority string, authority_level string, scout_id string")
    assert [r.source_id for r in registry.ordered_worklist(work).collect()] == [6, 5, 2, 1, 4, 0, 8, 3, 7]


def test_exact_medians(spark):
    rng = random.Random(4)
    values = {"one": [5.0], "two": [1.0, 2.0], "same": [3.0] * 9, "signs": [rng.uniform(-50, 50) for _ in range(301)], "wide": [10 ** rng.uniform(-6, 12) for _ in range(400)], "near": [100 + rng.randrange(9) / 1000 for _ in range(500)], "zero": [0.0, 0.0, -1.0, 1.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: r.median for r in evidence.exact_medians(rows.groupBy("k", "v").agg(F.count("*").alias("n")), ["k"], "v", "n").collect()}
    assert got == {k: pytest.approx(statistics.median(vs), rel=1e-15) for k, vs in values.items()}
