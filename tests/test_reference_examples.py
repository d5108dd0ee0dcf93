"""Examples of the behaviour that operators must match."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions.spans import placed
from larkspur.operators import cards, changes, evaluation, games, groups, market, matching, pages, registry, routing

ITEM = "title string, description string, sources array<string>, source string, source_url string, availability string, release_date date"


def test_high_restock_alert(spark):
    events = spark.createDataFrame([("k", 1, "RESTOCK"), ("x", 1, "SOMETHING")], "product_key string, seq int, event string")
    items = spark.createDataFrame([("k", 88.0, "CRITICAL", 90.0, 85.0, 92.0, 80.0, "QUICK FLIP")], "product_key string, opportunity_score double, opportunity_tier string, collector_score double, popularity_score double, flip_score double, hold_score double, strategy string")
    got = {r.product_key: r for r in changes.score_alerts(events, items).collect()}
    assert got["k"].alert_score == 48 + 13 + 7 + 5 + 12 and got["k"].priority == "CRITICAL" and got["k"].should_alert and got["k"].action == "CHECK STOCK AND BUY QUICKLY IF MARGIN WORKS"
    assert (got["x"].alert_score, got["x"].priority, got["x"].should_alert, got["x"].action) == (0, "IGNORE", False, "MONITOR")


def test_popularity_and_classes(spark):
    rows = [("Pokémon Center Exclusive Elite Trainer Box Promo Card", "Limited anniversary collector product", ["pokemon_center_new_releases", "pokemon_news", "pokemon_tcg_gallery"], "pokemon_center_new_releases", None, "SoldOut", None), ("Ordinary Product", "", None, None, None, None, None), ("Pikachu Poké Plush", None, None, None, None, None, None)]
    got = games.pokemon_scores(spark.createDataFrame(rows, ITEM), F.lit("2026-07-11").cast("date")).collect()
    assert got[0].popularity_score >= 85 and got[0].popularity_level == "VIRAL" and got[0].popularity_confidence == "VERY HIGH"
    assert (got[0].product_type, got[0].sealed_product, got[0].pokemon_center_exclusive, got[0].promo_included, got[0].collector_tier) == ("elite_trainer_box", True, True, True, "VERY HIGH")
    assert got[1].popularity_score <= 15 and got[1].popularity_level == "LOW"
    assert got[2].product_type == "plush" and not got[2].sealed_product


def test_game_scores(spark):
    def scored(game, title, description, sources):
        df = spark.createDataFrame([(title, description, sources, None, None, None, None)], ITEM)
        return games.game_scores(games.classify_products(df, game), game).first()

    gift = scored("lorcana", "Disney Lorcana D23 Limited Collector Gift Set", "Includes exclusive promo cards and Enchanted-style artwork.", ["lorcana_news", "lorcana_products"])
    assert gift.product_type == "gift_set" and gift.limited_release and gift.promo_included and gift.collector_score >= 70 and gift.strategy in ("QUICK FLIP", "LONG-TERM HOLD")
    pack = scored("one_piece", "BOOSTER PACK -ADVENTURE ON KAMI'S ISLAND- [OP15-EB04]", "Official One Piece Card Game booster product.", [])
    assert pack.product_type == "booster_pack" and {"OP-15", "EB-04"} <= set(pack.set_codes)
    premium = scored("one_piece", "ONE PIECE Premium Card Collection Anniversary Edition", "Premium Bandai limited edition with promo cards. Limit 1.", ["one_piece_products", "premium_bandai"])
    assert premium.product_type == "premium_collection" and premium.limited_release and premium.promo_included and premium.collector_score >= 80 and premium.hold_score >= 55


def test_release_windows(spark):
    df = spark.createDataFrame([(d, f"2026-07-{d:02d}" if d else None) for d in (11, 16, 14, 19, 9, 1, 0)], "k int, day string").withColumns({"release_date": F.to_date("day"), "availability": F.lit(None).cast("string"), "flip_score": F.lit(0), "collector_score": F.lit(0)})
    today = F.lit("2026-07-11").cast("date")
    got = {r.k: (r.action_window, r.days_until_release) for r in games.release_entries(df, today).collect()}
    assert got == {11: ("RELEASE DAY", 0), 16: ("BUY THIS WEEK", 5), 14: ("PREORDER NOW", 3), 19: ("MONITOR", 8), 9: ("NEWLY RELEASED", -2), 1: ("NEWLY RELEASED", -10), 0: ("DATE UNKNOWN", None)}
    assert games.release_calendar(df, today).first().k == 11
    urgent = {r.k: (r.urgency_level, r.urgency_score) for r in games.release_urgency(df, today).collect()}
    assert urgent[16] == ("VERY HIGH", 90) and urgent[9] == ("HIGH", 80) and urgent[0] == ("LOW", 20)


def opportunity(spark, **fields):
    names = [f"{k} {evaluation.FIELDS[k]}" for k in fields]
    return evaluation.card_labels(evaluation.evaluate(spark.createDataFrame([tuple(fields.values())], ", ".join(names)))).first()


def test_evaluation_of_the_two_promotions(spark):
    shared = dict(brand="One Piece", franchise="One Piece", collaboration_partner="Round1", required_spend=200.0, recent_sold_price=2200.0, exclusive_promo=True, retailer_exclusive=True, purchase_window_start="July 20", purchase_window_end="August 4")
    a = opportunity(spark, product_name="One Piece x Round1 Exclusive Promotional Card Packs", demand_direction="RISING", source_type="NEWS", risks=["This resale figure reflects a complete set of four promotional cards, not a single card."], **shared)
    b = opportunity(
        spark, product_name="One Piece x Round1 Verified Complete Promotional Card Set", edition_name="Complete Set", first_collaboration=True, numbered=True, limited_quantity=True, stated_quantity=100, purchase_limit=2, sellout_speed="within 30 minutes", demand_direction="SURGING",
        sold_listing_count=25, sales_velocity=10.0, online_available=True, status="live", release_date="July 20, 2026", source_type="OFFICIAL", catalyst_signals=["a", "b", "c"], **shared,
    )
    assert a.complete_set_mismatch and a.recommendation != "CRITICAL_BUY" and a.risk_score >= 30 and a.flip_score > 30 and a.demand_tags[0] == "Complete set"
    assert b.recommendation == "CRITICAL_BUY" and not b.complete_set_mismatch and b.risk_score < a.risk_score and b.confidence_score > a.confidence_score and b.recommended_quantity <= 2
    assert b.estimated_profit == 2000.0 and "Rapid sellout: within 30 minutes" in b.score_explanation["flip_score"].positives


def test_evaluation_of_cheap_and_expensive(spark):
    cheap = opportunity(spark, product_name="Cheap Promo Card", brand="Brand X", franchise="Brand X", required_spend=10.0, recent_sold_price=150.0, source_type="RETAILER", limited_quantity=True, purchase_limit=1)
    assert cheap.flip_score > 30 and cheap.estimated_roi_percent > 500
    weak = opportunity(spark, product_name="Expensive Weak Collectible", brand="Brand X", retail_price=870.0, current_market_price=890.0, source_type="RETAILER")
    assert weak.flip_score < 25
    bare = opportunity(spark, brand="Brand")
    assert bare.target_sell_price is None and "resale price evidence" in bare.missing_information


def test_summary(spark):
    e = evaluation.evaluate(spark.createDataFrame([("One Piece", "Round1", True, 200.0, 2200.5)], "franchise string, collaboration_partner string, exclusive_promo boolean, required_spend double, recent_sold_price double"))
    text = e.select(evaluation.summary_text(e)).first()[0].split("\n")
    assert text[0] == "ONE PIECE × ROUND1 PROMO" and "$200" in text and "$2,200.50" in text and "$2,000.50" in text and "- release date" in text


def test_consensus_of_two_sources(spark):
    rows = [(1, 1, "pokemon_news", ["pokemon_news"], "Short description", None), (1, 2, "pokemon_center_tcg", ["pokemon_center_tcg"], "Longer structured product description", 29.99)]
    r = cards.consensus(spark.createDataFrame(rows, "k int, seq int, source string, sources array<string>, description string, retail_price double"), "k", "seq", ("retail_price",)).first()
    assert (r.confirmation_count, set(r.sources), r.retail_price, r.consensus_score, r.description) == (2, {"pokemon_news", "pokemon_center_tcg"}, 29.99, 63, "Longer structured product description")


def test_missing_data(spark):
    df = spark.createDataFrame([(1, "Mystery", 65.0, None, None, None, "")], "seq int, title string, opportunity_score double, retail_price double, availability string, release_date string, image_url string")
    assert cards.data_quality(df).first().completeness_score == 0 and cards.missing_data(df).first().missing == list(cards.CORE_FIELDS)
    assert cards.data_quality(df.limit(0)).first().completeness_score == 0


def test_queue_admits_urgent_rows_only(spark):
    names = "action_key string, seq int, priority string, score double, title string, action string, reason string, retail_price double, availability string, url string"
    alerts = spark.createDataFrame([("a", 1, "HIGH", 50.0, None, "alert", None, None, None, None), ("b", 2, "MEDIUM", 99.0, "t", "x", "r", 1.0, None, None)], names)
    board = spark.createDataFrame([("a", 1, "CRITICAL", 90.0, "title", "board", "why", 5.0, None, None), ("c", 2, "WATCH", 99.0, "t", "x", "r", 1.0, None, None)], names)
    got = cards.action_queue(alerts, board).collect()
    assert len(got) == 1 and (got[0].priority, got[0].score, got[0].title, got[0].action, got[0].reason, got[0].retail_price, got[0].source) == ("CRITICAL", 90.0, "title", "alert", "why", 5.0, "alert")


def test_drafts_match_on_specific_fields(spark):
    rows = [(1, "Promo Packs", "One Piece", "One Piece", "Round1", None), (2, "Promo Packs", "One Piece", "One Piece", "Round1 promotional packs are", None), (3, "Booster Box", "One Piece", "One Piece", None, None), (4, None, "One Piece", "One Piece", None, None), (5, "promo packs!", "one piece", "One Piece", "ROUND1", None), (6, "Other", "Brand", None, None, "Shop")]
    drafts = spark.createDataFrame(rows, "id int, product_name string, brand string, franchise string, collaboration_partner string, retailer string").withColumn("id", F.col("id").cast("long"))
    pairs = matching.similar_drafts(drafts)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (1, 5), (1, 3), (2, 3)}  # brand and franchise of three known fields agree
    found = groups.group_products(drafts, pairs)
    assert {r.id: r.group_id for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6}
    known = spark.createDataFrame([(10, "Something Else", None), (11, "Promo", "Round1"), (12, "Promo Packs", "Round1")], "id long, product_name string, collaboration_partner string")
    assert {(r.group_id, r.existing_id) for r in matching.match_existing(drafts, found, known).collect()} == {(1, 11)}


def test_keywords_are_found_inside_words(spark, monkeypatch):
    items = spark.createDataFrame([(1, "Spring set", "a"), (2, "none", "b")], "item_id int, text string, category string")
    patterns = spark.createDataFrame([("p", "b", ["ring", "se"], 1.0)], "name string, category string, keywords array<string>, historical_roi double")
    want = {(1, 2), (2, 1)}
    assert {(r.item_id, r.strength) for r in market.match_patterns(items, patterns).collect()} == want
    monkeypatch.setattr(market, "KEYWORDS", 1)
    assert {(r.item_id, r.strength) for r in market.match_patterns(items, patterns).collect()} == want


@pytest.mark.parametrize(("href", "want"), [("//cdn.example/x", "https://cdn.example/x"), ("/a", "https://h.example/a"), ("b", "https://h.example/d/b"), ("../b#f", "https://h.example/b"), ("?q=1", "https://h.example/d/p?q=1"), ("http://z.example/", "http://z.example/"), ("#top", "https://h.example/d/p?x=1"), ("./c?x=/../y", "https://h.example/d/c?x=/../y")])
def test_links_are_resolved(spark, href, want):
    assert spark.range(1).select(pages.resolved(F.lit("https://h.example/d/p?x=1#z"), F.lit(href))).first()[0] == want


def test_record_shapes(spark):
    rows = [("ebay", 5.0, None, None), (None, None, "name", "shop"), ("ebay", 5.0, "name", "shop"), (None, None, None, None)]
    got = [(r.shape, r.confidence, r.ambiguous) for r in routing.route_payloads(spark.createDataFrame(rows, "marketplace string, price double, product_name string, retailer string")).collect()]
    assert got == [("marketplace_listing", 0.74, False), ("retailer_product", 0.63, False), (None, 0.74, True), (None, 0.0, False)]


def test_worklist_states(spark):
    rows = [(1, True, "active", "rss"), (2, False, "active", "rss"), (3, True, "broken", "rss"), (4, True, "deprecated", "rss"), (5, True, "active", None)]
    got = {r.source_id: (r.state, r.warning) for r in registry.worklist(spark.createDataFrame(rows, "source_id int, enabled boolean, lifecycle string, connector_type string")).collect()}
    assert got == {1: ("runnable", None), 2: ("disabled", None), 3: ("invalid", None), 4: ("runnable", "source is deprecated"), 5: ("invalid", None)}


def test_chains_are_followed_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "node long, parent long")
    assert groups.reach(edges.where("node >= 1")).where("node = 1").count() == 11


def test_places_of_many_matches(spark):
    df = spark.createDataFrame([("é1 " * 3000,)], "t string")
    r = df.select(placed(F.col("t"), F.lit("[0-9]")).alias("x")).first().x
    assert [m.start for m in r] == [3 * i + 1 for i in range(3000)]
