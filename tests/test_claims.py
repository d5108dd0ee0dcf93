"""Signals, partners and claims of sources, on worked examples."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import changes, claims, pages, routing, signals

PARTNERS = [
    ("One Piece and Round1 launched a limited collaboration.", ("One Piece", "Round1")),
    ("The Sanrio x Starbucks collection sold out fast.", ("Sanrio", "Starbucks")),
    ("Pokemon revealed a collaboration with Van Gogh Museum.", (None, "Van Gogh Museum")),
    ("The brand partnered with Round1 for a summer campaign.", (None, "Round1")),
    ("This is a plain restock announcement.", None),
    ("This is not a collaboration with Round1.", None),
    ("Round1 Collaboration\nOne Piece and Round1 launched a limited collaboration.", ("One Piece", "Round1")),
    ("get a card from the One Piece x Round1 campaign", ("One Piece", "Round1")),
    ("The price is approximately $200 for the item.", None),
    ("Nike × Kobe", ("Nike", "Kobe")),
    ("", None),
    (None, None),
]


def test_partners(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(PARTNERS)], "seq long, text string, match string")
    got = {r.seq: (r.left, r.right) for r in claims.detect_collabs(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PARTNERS) if want}


def test_a_long_text_without_partners(spark):
    docs = spark.createDataFrame([(1, "some names x here " * 5000 + "Nike x Kobe")], "seq long, text string")
    assert [(r.left, r.right) for r in claims.detect_collabs(docs).collect()] == [("Nike", "Kobe")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a complete set of ungraded cards sold for", ("complete_set", "ungraded", "sold", "release")),
        ("booster box, asking $5, sold out", ("box", None, "asking", "release")),
        ("PSA 10, preorder until May", ("unknown", "graded", "unknown", "preorder")),
        (None, ("unknown", None, "unknown", "release")),
    ],
)
def test_contexts(spark, text, want):
    row = spark.range(1).select(F.lit(text).cast("string").alias("t")).select(claims.unit_scope(F.col("t")), claims.grading(F.col("t")), claims.price_kind(F.col("t")), claims.date_phase(F.col("t"))).first()
    assert tuple(row) == want


def test_denied_fields(spark):
    docs = spark.createDataFrame([(1, "This product is not limited. No lottery!"), (2, "limited"), (3, None)], "seq long, text string")
    assert {(r.seq, r.field, r.value, r.evidence) for r in claims.denials(docs).collect()} == {(1, "limited_quantity", "false", "not limited"), (1, "lottery_required", "false", "No lottery")}


def test_signals_of_a_text(spark):
    docs = spark.createDataFrame([(1, "Not exclusive promo. There is now a real 30th Anniversary EXCLUSIVE PROMO, rumored."), (2, None), (3, "")], "seq long, text string")
    got = {(r.signal, r.confidence, r.match, r.certainty) for r in signals.detect_signals(docs).collect()}
    assert got == {("ANNIVERSARY", 85, "30th Anniversary", "rumored"), ("EXCLUSIVE_PROMO", 85, "EXCLUSIVE PROMO", "rumored")}
    assert len(signals.KEYWORD_SIGNALS) == 27


def test_item_signals(spark):
    rows = [("Limited shock drop", "exclusive collab", "http://x", 90.0, "HIGH"), ("Reprint restock", None, None, None, None), (None, None, None, 34.0, None)]
    got = routing.signal_evidence(spark.createDataFrame(rows, "title string, description string, url string, collector_score double, collector_level string")).collect()
    assert [(e.signal, e.weight) for e in got[0].evidence] == [("official_source", 12), ("limited_release", 12), ("exclusive", 10), ("collaboration", 10), ("shock_drop", 14), ("collector_interest", 10), ("collector_value", 16)]
    assert got[0].score == 100 and got[0].evidence[-1].reason == "Collectors rate it 90 of 100 (HIGH)."
    assert [(e.signal, e.weight) for e in got[1].evidence] == [("restock", -8), ("reprint", -12)] and got[1].score == 20
    assert got[2].evidence == [] and got[2].score == 40


def test_xml_items(spark):
    bodies = [(1, '<r><items><item id="1"><t>a</t><t>b</t></item><item id="2"/></items></r>'), (2, "<r><items><item"), (3, None), (4, "<r/>"), (5, '<r xmlns:n="u"><items><n:item id="3"><t>c</t></n:item></items></r>')]
    got = pages.xml_items(spark.createDataFrame(bodies, "doc_id int, body string"), ("items", "item"), "_id int, t array<string>").collect()
    assert sorted((r.doc_id, r._id, r.t) for r in got) == [(1, 1, ["a", "b"]), (1, 2, None), (5, 3, ["c"])]


def test_alerts_are_raised_once(spark):
    obs = spark.createDataFrame([("k", 1, "out of stock"), ("k", 2, "in stock"), ("k", 3, "out of stock"), ("k", 4, "in stock")], "product_key string, seq long, availability string")
    obs = obs.selectExpr("*", "5.0D as price", "array('s') as sources", "50.0D as strategy_score", "'WATCH' as tier", "'d' as description", "'s' as source", "to_date('2024-01-01') as observed_at")
    board = spark.createDataFrame([("k", 80.0, "HIGH", 80.0, 80.0, 80.0, 10.0, "QUICK FLIP")], "product_key string, opportunity_score double, opportunity_tier string, collector_score double, popularity_score double, flip_score double, hold_score double, strategy string")
    first = changes.alert_scan(board, obs.where("seq <= 2"))
    assert {(r.event, r.seq) for r in first.collect()} == {("NEW_PRODUCT", 1), ("RESTOCK", 2)}
    second = changes.alert_scan(board, obs.where("seq > 2"), changes.advance_state(obs.where("seq <= 2")), first)
    assert {(r.event, r.seq) for r in second.collect()} == {("SOLD_OUT", 3)}


PRICES = [
    ("Customers who spent $200 on eligible purchases qualify.", [("$200", 200.0, "USD", "spend")]),
    ("Complete sets are selling for around $2,200.", [("$2,200", 2200.0, "USD", "resale")]),
    ("The retail price is $60 at launch.", [("$60", 60.0, "USD", "retail")]),
    ("A random number $60 appears here.", [("$60", 60.0, "USD", "price")]),
    ("60 USD retail, resold at 1,500 yen or 12.50 euros", [("60 USD", 60.0, "USD", "retail"), ("1,500 yen", 1500.0, "JPY", "resale"), ("12.50 eur", 12.5, "EUR", "resale")]),
    ("$5 " + "x" * 50 + " msrp", [("$5", 5.0, "USD", "price")]),
    ("USD 7.25 msrp", [("USD 7.25", 7.25, "USD", "retail")]),
    (None, []),
]


def test_prices(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PRICES)], "seq int, text string")
    rows = signals.detect_prices(docs).orderBy("seq", "start").collect()
    for i, (_, want) in enumerate(PRICES):
        assert [(r.match, r.amount, r.currency, r.role) for r in rows if r.seq == i] == want
