"""Whether what was detected in a document makes an opportunity: confidences, relevance and the rules of acceptance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points by which a source's type and a detection's certainty change its confidence: fixed values.
SOURCE_POINTS = {"OFFICIAL": 10, "RETAILER": 10, "PRESS_RELEASE": 5, "EVENT": 5, "NEWS": 0, "MARKETPLACE": 0, "COMMUNITY": -10, "SOCIAL": -15, "OTHER": -5}
CERTAINTY_POINTS = {"confirmed": 0, "estimated": -15, "rumored": -35}

#: Weights of signals for relevance (others weigh nothing) and the least relevance: fixed values.
WEIGHTS = {
    "COLLABORATION": 20, "FIRST_COLLABORATION": 10, "EXCLUSIVE_PROMO": 12, "PROMOTIONAL_PACK": 6, "ANNIVERSARY": 8, "FIRST_EDITION": 6, "EXCLUSIVE_ARTWORK": 5, "EXCLUSIVE_CHARACTER": 5, "EVENT_EXCLUSIVE": 8, "CONVENTION_EXCLUSIVE": 8, "TOURNAMENT_EXCLUSIVE": 8,
    "RETAILER_EXCLUSIVE": 7, "REGION_EXCLUSIVE": 6, "MEMBERSHIP_EXCLUSIVE": 8, "LOTTERY_REQUIRED": 8, "EVENT_ATTENDANCE_REQUIRED": 5, "BUNDLE_REQUIRED": 4, "REDEEMABLE_REWARD": 4, "LIMITED_QUANTITY": 10, "NUMBERED_RELEASE": 6, "SPEND_REQUIREMENT": 6, "OBSERVED_RESALE_PRICE": 12,
    "STATUS_SOLD_OUT": 4, "STATUS_RESTOCKED": 2, "LOW_STOCK": 4, "RAPID_SELLOUT": 12, "HIGH_DEMAND": 6, "RISING_DEMAND": 6, "SURGING_DEMAND": 10, "HIGH_ACQUISITION_DIFFICULTY": 8, "SEALED_PRODUCT": 3, "COMMUNITY_HYPE": 4, "PURCHASE_WINDOW": 2,
}
THRESHOLD = 35.0

#: Barriers of which two make a product hard to get; signals that count together with one of others; signals that count
#: alone from 0.6 of the threshold on; signals that say nothing without others. Fixed values.
BARRIERS = ("LOTTERY_REQUIRED", "MEMBERSHIP_EXCLUSIVE", "EVENT_ATTENDANCE_REQUIRED", "BUNDLE_REQUIRED", "RETAILER_EXCLUSIVE", "EVENT_EXCLUSIVE", "SPEND_REQUIREMENT")
TOGETHER = (
    ("COLLABORATION", ("EXCLUSIVE_PROMO", "EVENT_EXCLUSIVE", "RETAILER_EXCLUSIVE")),
    ("SPEND_REQUIREMENT", ("EXCLUSIVE_PROMO", "PROMOTIONAL_PACK")),
    ("LIMITED_QUANTITY", ("COLLABORATION", "EXCLUSIVE_PROMO", "ANNIVERSARY")),
    ("ANNIVERSARY", ("EXCLUSIVE_PROMO", "LIMITED_QUANTITY", "NUMBERED_RELEASE")),
    ("STATUS_SOLD_OUT", ("RISING_DEMAND", "SURGING_DEMAND", "HIGH_DEMAND", "RAPID_SELLOUT")),
)
ALONE = ("EVENT_EXCLUSIVE", "CONVENTION_EXCLUSIVE", "TOURNAMENT_EXCLUSIVE", "LOTTERY_REQUIRED", "MEMBERSHIP_EXCLUSIVE", "RETAILER_EXCLUSIVE")
WEAK = ("RUMOR", "RETAIL_PRICE", "STATUS_LIVE", "STATUS_RESTOCKED", "PURCHASE_LIMIT")
SPENDING, RESALE, RESALE_TIMES = ("SPEND_REQUIREMENT", "RETAIL_PRICE"), "OBSERVED_RESALE_PRICE", 1.5


def _of(table: Mapping[str, int], c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], F.lit(0))


def adjusted_confidence(base: Column, source_type: Column, certainty: Column) -> Column:
    """A pattern's confidence changed by its source's type and its certainty, 0 to 100; unknown ones change nothing."""
    return F.greatest(F.lit(0), F.least(F.lit(100), base + _of(SOURCE_POINTS, F.upper(source_type)) + _of(CERTAINTY_POINTS, certainty)))


def with_difficulty(detections: DataFrame) -> DataFrame:
    """The detections (seq, at, signal, confidence, certainty, value) and HIGH_ACQUISITION_DIFFICULTY for each document with
    two or more BARRIERS that are no rumours, with their detections' mean confidence, after all others."""
    firm = detections.where(F.col("signal").isin(*BARRIERS) & ~F.col("certainty").eqNullSafe("rumored"))
    hard = firm.groupBy("seq").agg(F.count_distinct("signal").alias("kinds"), F.avg(F.col("confidence").cast("double")).alias("confidence")).where("kinds >= 2")
    shape = detections.schema
    added = hard.select("seq", F.lit(2**31 - 1).cast(shape["at"].dataType).alias("at"), F.lit("HIGH_ACQUISITION_DIFFICULTY").alias("signal"), "confidence", F.lit("confirmed").alias("certainty"), F.lit(None).cast(shape["value"].dataType).alias("value"))
    return detections.select("seq", "at", "signal", F.col("confidence").cast("double").alias("confidence"), "certainty", "value").unionByName(added)


def judge_docs(detections: DataFrame, identified: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each document of `identified` (seq, has_identity): relevance, confidence, create and reason.

    relevance is the sum of each signal's weight times its best confidence in percent, 0 to 100; confidence the mean of
    the detections that weigh something, else of all, to two places (0 without any; a half of what 100 times it gives goes to the
    even side). Sums are exact, so they don't depend on the order of rows. A document makes no opportunity
    without an identity (missing_product_identity); below the threshold, unless signals that count TOGETHER are there, a
    resale price is RESALE_TIMES the spending or more (of each the first by `at`, both known), or one that counts ALONE is
    there and relevance reaches 0.6 of it (below_threshold); with WEAK signals only (only_weak_signals). Detections (seq,
    at, signal, confidence, certainty, value) of other documents are left out; give those of with_difficulty.
    """
    weighed = detections.withColumn("w", _of(WEIGHTS, F.col("signal")))
    exact = lambda c: F.sum(c.cast("decimal(24,14)"))  # noqa: E731  whatever order rows come in
    each = weighed.groupBy("seq", "signal").agg(F.max(F.col("w") * F.col("confidence") / 100).alias("points"), exact(F.col("confidence")).alias("sum"), F.count("*").alias("n"), F.first("w").alias("w"), F.min(F.struct("at", "value")).alias("first"))
    of = lambda names: F.min(F.when(F.col("signal").isin(*names), F.col("first")))["value"]
    heavy = F.col("w") > 0
    docs = each.groupBy("seq").agg(
        F.least(F.lit(100.0), exact(F.col("points")).cast("double")).alias("relevance"),
        (F.sum(F.when(heavy, F.col("sum"))).cast("double") / F.sum(F.when(heavy, F.col("n")))).alias("heavy_mean"),
        (F.sum("sum").cast("double") / F.sum("n")).alias("mean"),
        F.collect_set("signal").alias("have"),
        of((RESALE,)).alias("resale"),
        of(SPENDING).alias("spend"),
    )
    known = identified.select("seq", F.coalesce("has_identity", F.lit(False)).alias("known")).join(docs, "seq", "left")
    known = known.withColumns({"relevance": F.coalesce("relevance", F.lit(0.0)), "have": F.coalesce("have", F.array().cast("array<string>"))})
    some = lambda names: F.arrays_overlap("have", F.array(*(F.lit(n) for n in names)))
    strong = F.coalesce((F.col("resale") != 0) & (F.col("spend") != 0) & (F.col("resale") >= F.col("spend") * RESALE_TIMES), F.lit(False))
    for one, others in TOGETHER:
        strong = strong | (F.array_contains("have", one) & some(others))
    passes = (F.col("relevance") >= threshold) | strong | (some(ALONE) & (F.col("relevance") >= threshold * 0.6))
    weak = F.size(F.array_except("have", F.array(*(F.lit(w) for w in WEAK)))) == 0
    reason = F.when(~F.col("known"), "missing_product_identity").when(~passes, "below_threshold").when(weak, "only_weak_signals")
    confidence = F.rint(F.coalesce("heavy_mean", "mean", F.lit(0.0)) * 100) / 100
    return known.select("seq", "relevance", confidence.alias("confidence"), reason.isNull().alias("create"), reason.alias("reason"))
