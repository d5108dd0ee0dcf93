"""Worked examples of confidences, difficulty and acceptance."""

from pyspark.sql import functions as F

from larkspur.operators import judgement

SCHEMA = "seq int, at int, signal string, confidence double, certainty string, value double"


def judged(spark, *docs, identity=True):
    """Each document is a list of (signal, confidence[, certainty[, value]])."""
    rows = [(i, k, d[0], float(d[1]), d[2] if len(d) > 2 else "confirmed", d[3] if len(d) > 3 else None) for i, doc in enumerate(docs) for k, d in enumerate(doc)]
    identified = spark.createDataFrame([(i, identity) for i in range(len(docs))], "seq int, has_identity boolean")
    found = judgement.judge_docs(judgement.with_difficulty(spark.createDataFrame(rows, SCHEMA)), identified)
    return [(round(r.relevance, 4), r.confidence, r.reason) for r in found.orderBy("seq").collect()]


def test_confidences(spark):
    rows = [(80, "OFFICIAL", "confirmed"), (95, "retailer", "confirmed"), (80, "SOCIAL", "rumored"), (20, "SOCIAL", "rumored"), (70, None, None), (70, "unheard", "estimated")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b int, s string, c string")
    assert [r.v for r in df.orderBy("i").select(judgement.adjusted_confidence(F.col("b"), F.col("s"), F.col("c")).alias("v")).collect()] == [90, 100, 30, 0, 70, 55]


def test_acceptance(spark):
    got = judged(
        spark,
        [("COLLABORATION", 80), ("EXCLUSIVE_PROMO", 80)],  # together, below the threshold
        [("STATUS_SOLD_OUT", 80)],
        [("STATUS_SOLD_OUT", 80), ("RAPID_SELLOUT", 50)],
        [("RETAIL_PRICE", 90, "confirmed", 10.0), ("OBSERVED_RESALE_PRICE", 90, "confirmed", 15.0)],
        [("RETAIL_PRICE", 90, "confirmed", 10.0), ("OBSERVED_RESALE_PRICE", 90, "confirmed", 14.9)],
        [("RETAIL_PRICE", 90, "confirmed", None), ("OBSERVED_RESALE_PRICE", 90, "confirmed", 99.0)],
        [("RETAIL_PRICE", 90), ("PURCHASE_LIMIT", 80), ("STATUS_RESTOCKED", 80)],
        [("EVENT_EXCLUSIVE", 100), ("LOTTERY_REQUIRED", 100)],  # 8 + 8 + 8 for difficulty: 0.6 of the threshold is 21
        [("EVENT_EXCLUSIVE", 100), ("LOTTERY_REQUIRED", 100, "rumored")],
        [("COLLABORATION", 100), ("COLLABORATION", 50), ("RAPID_SELLOUT", 100), ("RUMOR", 10)],
        [],
    )
    assert [r for _, _, r in got] == [None, "below_threshold", None, None, "below_threshold", "below_threshold", "below_threshold", None, "below_threshold", "below_threshold", "below_threshold"]
    assert got[0][:2] == (25.6, 80.0) and got[7][:2] == (24.0, 100.0) and got[9][:2] == (32.0, 83.33) and got[10][:2] == (0.0, 0.0)
    assert judged(spark, [("COLLABORATION", 100), ("EXCLUSIVE_PROMO", 100)], identity=False)[0][2] == "missing_product_identity"


def test_weak_signals_above_a_low_threshold(spark):
    rows = spark.createDataFrame([(1, 1, "STATUS_RESTOCKED", 90.0, "confirmed", None)], SCHEMA)
    identified = spark.createDataFrame([(1, True), (2, None)], "seq int, has_identity boolean")
    assert [r.reason for r in judgement.judge_docs(rows, identified, 1.0).orderBy("seq").collect()] == ["only_weak_signals", "missing_product_identity"]


def test_means_near_a_half_and_sums_in_any_order(spark):
    got = judged(spark, [("RAPID_SELLOUT", 65.02), ("HIGH_DEMAND", 65.03)], [("RAPID_SELLOUT", 65.0), ("HIGH_DEMAND", 65.25)])
    assert [c for _, c, _ in got] == [65.03, 65.12]  # 65.025 * 100 lies above a half, 65.125 * 100 is one
    parts = [("COLLABORATION", 62.0), ("LIMITED_QUANTITY", 46.0), ("STATUS_SOLD_OUT", 47.0), ("LOW_STOCK", 53.0)]
    both = {round(r, 14) for n in range(4) for r, _, _ in judged(spark, parts[n:] + parts[:n])}
    assert both == {21.0}
