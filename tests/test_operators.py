"""The reference figures and edge cases of the operators, and a small run of every registered query."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import boards, changes, evidence, groups, items, market, merges


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_learning_summary_figures(spark):
    log = spark.createDataFrame(
        [("pokemon", "A", "BUY", 90, 4000, 8000, 10000), ("pokemon", "A", "WATCH", 70, 2000, 4000, 8000), ("pokemon", "A", "SKIP", 20, -500, -1000, 5000)],
        "category string, brand string, decision string, score int, profit_cents long, roi_cents long, market_cents long",
    )
    r = market.learning_summary(log).first()
    assert (r.average_roi, r.average_profit, r.average_market_price, r.profitable_count, r.buy_count, r.skip_count, r.confidence) == (36.67, 18.33, 76.67, 2, 1, 1, "LOW")


def test_state_changes(spark):
    obs = spark.createDataFrame(
        [("k", 1, "OutOfStock", 59.99, ["a"], 45.0, "WATCH"), ("k", 2, "InStock", 49.99, ["a", "b"], 70.0, "HIGH"), (None, 3, "InStock", 1.0, [], 0.0, None)],
        "product_key string, seq int, availability string, price double, sources array<string>, strategy_score double, tier string",
    )
    got = [r.event for r in changes.detect_changes(obs).orderBy("seq").collect()]
    assert got == ["NEW_PRODUCT", "RESTOCK", "PRICE_DROP", "NEW_CONFIRMATION", "STRATEGY_UPGRADE", "TIER_UPGRADE"]
    split = rows(changes.detect_changes(obs.where("seq = 2"), changes.advance_state(obs.where("seq = 1"))))
    assert split == rows(changes.detect_changes(obs).where("seq = 2"))
    shuffled = rows(changes.detect_changes(obs.orderBy(F.desc("seq")).repartition(3)))
    assert shuffled == rows(changes.detect_changes(obs))


def test_board_puts_the_limited_set_first(spark):
    data = [(1, "Limited Collector Set", 95.0, 90.0, 90.0, 95.0, 90.0, True, True, True, True), (2, "Plain", None, None, 20.0, 10.0, None, False, None, False, False)]
    names = "seq int, title string, collector_score double, popularity_score double, flip_score double, hold_score double, sleeper_score double, limited_release boolean, promo_included boolean, collector_variant boolean, sealed_product boolean"
    df = spark.createDataFrame(data, names).withColumns({"availability": F.lit("sold out"), "category": F.lit("x")})
    board = boards.money_board(boards.best_strategy(df)).orderBy("overall_rank").collect()
    assert board[0].title == "Limited Collector Set" and board[0].opportunity_score >= 85 and board[0].opportunity_tier == "CRITICAL"


def test_merge_precedence(spark):
    data = [("k", 1, "long words", 5.0, "a"), ("k", 2, "", None, "b"), ("k", 3, "same words", 7.0, "a"), ("k", 4, "x", 0.0, None), (None, 5, "y", 1.0, "c")]
    df = spark.createDataFrame(data, "key string, seq int, description string, price double, source string").withColumn("at", F.col("seq"))
    up = merges.upsert_catalog(df, "key", "seq", ("price",), "description", "source", "at").collect()
    assert len(up) == 1 and (up[0].price, up[0].description, up[0].sources, up[0].scan_count) == (0.0, "same words", ["a", "b"], 4)
    first = merges.dedup_first_wins(df, "key", "seq", ("price",), "description", "source").collect()
    assert (first[0].price, first[0].description) == (5.0, "long words")


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(4)
    sets = {i: sorted({rng.choice("abcdefghij") for _ in range(rng.randrange(0, 8))}) for i in range(80)}
    df = spark.createDataFrame(list(sets.items()), "id long, tokens array<string>")
    for t in (0.5, 0.7, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= t}
        assert {(r.a, r.b) for r in groups.similar_sets(df, t).collect()} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24), (5, 5)]
    got = {r.node: r.root for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 8, 21: 20, 22: 20, 23: 20, 24: 20}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cycles_end(spark):
    got = rows(groups.reach(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "node long, parent long")).where("node = ancestor").select("node"))
    assert got == [(1,), (2,), (3,)]


def test_page_changes(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "x 2024-01-01T00:00:00Z"), ("c", "x"), ("d", "same")], "url string, body string")
    new = spark.createDataFrame([("a", "x"), ("b", "x 2024-05-05 10:00:00"), ("c", "y"), ("d", " "), ("e", "same"), ("f", "z"), ("g", None)], "url string, body string")
    assert dict(rows(changes.page_changes(old, new))) == {"a": "UNCHANGED", "b": "TIMESTAMP_ONLY", "c": "CHANGED", "d": "REMOVED", "e": "DUPLICATE", "f": "NEW", "g": "UNCHANGED"}


def test_outlier_is_left_out(spark):
    data = [(1, i, "recent_sold_price", v, None, "MARKETPLACE", "confirmed", 80.0, "single_item", "unknown") for i, v in enumerate((100.0, 110.0, 105.0, 900.0))]
    df = spark.createDataFrame(data, "group_id int, seq int, field_name string, value_num double, value_str string, source_type string, certainty string, confidence double, unit_scope string, grading string")
    r = evidence.market_prices(df, ("recent_sold_price",)).first()
    assert (r.price, r.inliers, r.outliers) == (105.0, 3, 1)


def test_more_specific_name_wins(spark):
    data = [(1, 1, "product_name", None, "Alpha", "OFFICIAL", "confirmed", 90.0), (1, 2, "product_name", None, "Alpha Beta", "NEWS", "confirmed", 50.0), (1, 3, "product_name", None, "Alpha Beta Gamma", "SOCIAL", "rumored", 50.0)]
    df = spark.createDataFrame(data, "group_id int, seq int, field_name string, value_num double, value_str string, source_type string, certainty string, confidence double")
    assert evidence.resolve_fields(df).first().chosen == "Alpha Beta"


def test_text_functions(spark):
    df = spark.createDataFrame([("  Pokémon: The Élite-Box!! 12 ", None), (None, "")], "a string, b string")
    got = df.select(T.norm_text(F.col("a")), T.norm_title(F.col("a")), F.array_join(T.identity_tokens(F.col("a")), " "), T.norm_sku(F.lit(" Ab__c -d!")), T.parse_decimal(F.lit("$1,234.50")), T.parse_decimal(F.col("b"))).collect()
    assert tuple(got[0]) == ("pokémon the élite box 12", "pok mon the lite box 12", "box elite", "ab-c-d", 1234.5, None)
    assert tuple(got[1])[:3] == ("", "", "")


def test_roi(spark):
    r = items.roi_columns(F.lit(50.0), F.lit(100.0))
    got = spark.range(1).select(*(v.alias(k) for k, v in r.items())).first()
    assert (got.fees, got.net_revenue, got.profit, got.roi) == (13.0, 79.0, 29.0, 58.0)


def names():
    import __spark_entry__ as entry

    return [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", names())
def test_every_query_runs(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(set(df.columns)) == len(df.columns)
    df.write.mode("overwrite").format("noop").save()


def plain_leaders(rows):
    """Greedy leaders of (id, title, sku, type), one by one."""
    words = lambda t: {w for w in (t or "").split() if len(w) >= 3}

    def alike(x, y):
        if x[2] and x[2] == y[2]:
            return True
        a, b = words(x[1]), words(y[1])
        if not a or not b:
            return False
        bonus = 0.15 if x[3] is not None and x[3] == y[3] else 0
        return min(1.0, math.floor((len(a & b) / len(a | b) + bonus) * 1000 + 0.5) / 1000) >= 0.72

    leaders, out = [], {}
    for row in sorted(rows):
        found = next((x for x in leaders if alike(x, row)), None)
        out[row[0]] = row[0] if found is None else found[0]
        if found is None:
            leaders.append(row)
    return out


def test_leader_groups_equal_brute_force(spark):
    rng = random.Random(8)
    pool = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta"]
    rows = [(i, " ".join(rng.sample(pool, rng.randrange(0, 6))), rng.choice([None, None, "", "a1", "b2", "c3"]), rng.choice([None, "box", "pin"])) for i in range(150)]
    got = groups.leader_groups(spark.createDataFrame(rows + [(None, "alpha beta", None, None)], "id long, title string, sku string, type string"))
    assert {r.id: r.leader for r in got.collect()} == plain_leaders(rows)


def test_leaders_of_ten_thousand_equal_skus(spark):
    rows = [(i, f"item{i} word{i % 700}", "same-sku", None) for i in range(10_000)] + [(20_000, "item5 word5", None, None), (20_001, "alone", None, None)]
    got = groups.leader_groups(spark.createDataFrame(rows, "id long, title string, sku string, type string"))
    leaders = {r.id: r.leader for r in got.collect()}
    assert len(leaders) == len(rows) and all(leaders[i] == 0 for i in range(10_000)) and leaders[20_000] == 20_000 and leaders[20_001] == 20_001
