"""Resolution of conflicting evidence: priorities, conflicts, market prices and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as T
from larkspur.sources.tables import cut

#: Weights of source types and their order for retail and market fields: fixed values.
WEIGHTS = {"OFFICIAL": 90, "RETAILER": 80, "PRESS_RELEASE": 75, "EVENT": 70, "MARKETPLACE": 55, "NEWS": 50, "COMMUNITY": 30, "SOCIAL": 20, "OTHER": 10}
IDENTITY_ORDER = ("OFFICIAL", "RETAILER", "PRESS_RELEASE", "EVENT", "NEWS", "MARKETPLACE", "COMMUNITY", "SOCIAL", "OTHER")
RETAIL_ORDER = ("RETAILER", "OFFICIAL", "EVENT", "PRESS_RELEASE", "NEWS", "MARKETPLACE", "COMMUNITY", "SOCIAL", "OTHER")
MARKET_ORDER = ("MARKETPLACE", "RETAILER", "NEWS", "COMMUNITY", "SOCIAL", "OFFICIAL", "EVENT", "PRESS_RELEASE", "OTHER")
#: Fields whose sources are ordered as identity, retail and market evidence: fixed values.
IDENTITY_LED = (
    "product_name", "brand", "franchise", "collaboration_partner", "edition_name", "release_region", "category", "subcategory", "set_or_series", "release_date", "release_time", "purchase_window_start", "purchase_window_end", "announcement_date", "stated_quantity", "numbered", "first_edition",
    "first_collaboration", "anniversary_release", "exclusive_promo", "exclusive_artwork", "exclusive_character", "event_exclusive", "convention_exclusive", "tournament_exclusive", "membership_exclusive", "membership_required", "lottery_required", "event_attendance_required", "bundle_required",
    "sealed_product", "redeemable_reward", "required_spend", "purchase_method",
)
RETAIL_LED = ("retail_price", "purchase_limit", "status", "online_available", "in_store_available", "retailer_exclusive", "region_exclusive", "regional_exclusive", "purchase_url", "retailer")
MARKET_LED = ("recent_sold_price", "current_market_price", "estimated_market_price")
#: Fields of which a more specific value wins and a real disagreement is critical, and fields of prices: fixed values.
IDENTITY_FIELDS = ("product_name", "brand", "franchise", "collaboration_partner", "retailer")
PRICE_FIELDS = ("retail_price", "required_spend", "recent_sold_price", "current_market_price", "estimated_market_price")


def _lookup(table: dict[str, int], c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], F.lit(0))


def source_rank(field: Column, source: Column) -> Column:
    """Rank of a source type for a field: by the field's order if it has one, else by weight."""
    weight, out = _lookup(WEIGHTS, source), None
    for names, order in ((IDENTITY_LED, IDENTITY_ORDER), (RETAIL_LED, RETAIL_ORDER), (MARKET_LED, MARKET_ORDER)):
        placed = F.when(source.isin(*order), _lookup({s: len(order) - i for i, s in enumerate(order)}, source)).otherwise(weight)
        out = F.when(field.isin(*names), placed) if out is None else out.when(field.isin(*names), placed)
    return out.otherwise(weight)


def certainty_rank(c: Column) -> Column:
    return F.when(c == "rumored", 0).when(c == "confirmed", 2).otherwise(1)


def more_specific(a: Column, b: Column) -> Column:
    """Whether the normalised text a contains b and says more."""
    x, y = T.norm_text(a), T.norm_text(b)
    return (x != "") & (y != "") & F.contains(x, y) & (x != y)


def value_key() -> Column:
    return F.coalesce(F.col("value_str"), F.col("value_num").cast("string"))


def resolve_fields(evidence: DataFrame) -> DataFrame:
    """(group_id, field_name, chosen, chosen_source, values, records): the value with the best source rank, certainty
    and confidence, the earliest seq on ties; for identity fields a more specific value of a source that doesn't report
    rumours wins over it.

    evidence has group_id, seq, field_name, value_num, value_str, source_type, certainty, confidence. Groups are merged
    by aggregates alone: the best row first, then the best of those more specific than it.
    """
    rows = evidence.withColumn("value", value_key()).withColumn("rank", F.struct(source_rank(F.col("field_name"), F.col("source_type")).alias("r"), certainty_rank(F.col("certainty")).alias("c"), F.col("confidence").alias("f"), (-F.col("seq")).alias("s")))
    best = rows.groupBy("group_id", "field_name").agg(F.max_by(F.struct("value", "source_type"), "rank").alias("best"), F.count_distinct("value").alias("values"), F.count("*").alias("records"))
    names = rows.where(F.col("field_name").isin(*IDENTITY_FIELDS) & (F.col("certainty") != "rumored"))
    wider = names.join(best.select("group_id", "field_name", "best"), ["group_id", "field_name"]).where(more_specific(F.col("value"), F.col("best.value")))
    wider = wider.groupBy("group_id", "field_name").agg(F.max_by(F.struct("value", "source_type"), "rank").alias("wider"))
    chosen = F.coalesce("wider", "best")
    return best.join(wider, ["group_id", "field_name"], "left").select("group_id", "field_name", chosen["value"].alias("chosen"), chosen["source_type"].alias("chosen_source"), "values", "records")


def accepted_records(evidence: DataFrame, resolved: DataFrame) -> DataFrame:
    """(group_id, field_name, seq, accepted) for each record: whether it agrees with the chosen value."""
    rows = evidence.withColumn("value", value_key())
    return rows.join(resolved.select("group_id", "field_name", "chosen"), ["group_id", "field_name"]).select("group_id", "field_name", "seq", F.col("value").eqNullSafe(F.col("chosen")).alias("accepted"))


def price_severity(low: Column, high: Column) -> Column:
    percent = (high - low) / low * 100
    return F.when(low <= 0, "MEDIUM").when(percent >= 200, "CRITICAL").when(percent >= 50, "HIGH").when(percent >= 15, "MEDIUM").otherwise("LOW")


def field_conflicts(evidence: DataFrame) -> DataFrame:
    """(group_id, field_name, values, severity, requires_review) of fields whose records give different values.

    Sources of the chosen record's rank that report no rumours are comparable. Identity fields: CRITICAL and reviewed if
    comparable sources disagree and some two values don't contain one another, else LOW. Price fields: by the spread,
    reviewed from HIGH on if comparable sources disagree. status: INFO, never reviewed. Others: MEDIUM and reviewed if
    comparable sources disagree, else LOW. Records without a value count as one more value.
    """
    keys = ["group_id", "field_name"]
    rows = evidence.withColumns({"value": value_key(), "r": source_rank(F.col("field_name"), F.col("source_type")), "c": certainty_rank(F.col("certainty"))})
    different = F.count_distinct(F.struct(F.coalesce("value", F.lit("")), F.col("value").isNull()))
    spread = rows.groupBy(*keys).agg(different.alias("values"), F.min("value_num").alias("low"), F.max("value_num").alias("high"), F.count_distinct("value_num").alias("numbers")).where("values > 1")
    chosen = resolve_fields(evidence).select(*keys, "chosen", "chosen_source")
    best = chosen.select(*keys, source_rank(F.col("field_name"), F.col("chosen_source")).alias("top"))
    seen = F.count_distinct(F.struct(F.coalesce("value", F.lit("")), F.col("value").isNull()))
    comparable = rows.where(~F.col("certainty").eqNullSafe("rumored")).join(best, keys).where("r = top").groupBy(*keys).agg((seen > 1).alias("disagree"))
    # Values contain one another if each, in the order of length, lies within the next.
    names = rows.where(F.col("field_name").isin(*IDENTITY_FIELDS)).select(*keys, "value").distinct().withColumn("norm", F.coalesce(T.norm_text(F.col("value")), F.lit("")))
    order = Window.partitionBy(*keys).orderBy(F.length("norm"), "norm", "value")
    apart = names.withColumn("shorter", F.lag("norm").over(order)).where(F.col("shorter").isNotNull())
    apart = apart.groupBy(*keys).agg(F.bool_or((F.col("shorter") == "") | (F.col("shorter") == F.col("norm")) | ~F.contains("norm", F.col("shorter"))).alias("apart"))
    df = spread.join(comparable, keys, "left").join(apart, keys, "left")
    disagree, field = F.coalesce("disagree", F.lit(False)), F.col("field_name")
    price = F.when(F.col("numbers") < 2, "LOW").otherwise(price_severity(F.col("low"), F.col("high")))
    critical = field.isin(*IDENTITY_FIELDS) & disagree & F.coalesce("apart", F.lit(False))
    severity = F.when(critical, "CRITICAL").when(field.isin(*IDENTITY_FIELDS), "LOW").when(field.isin(*PRICE_FIELDS), price).when(field == "status", "INFO").when(disagree, "MEDIUM").otherwise("LOW")
    review = F.when(field.isin(*IDENTITY_FIELDS), critical).when(field.isin(*PRICE_FIELDS), price.isin("HIGH", "CRITICAL") & disagree).when(field == "status", F.lit(False)).otherwise(disagree)
    return df.select(*keys, "values", severity.alias("severity"), review.alias("requires_review"))


def price_conflicts(evidence: DataFrame) -> DataFrame:
    """(group_id, field_name, severity, requires_review) of price fields with different values: severity by the spread;
    review if it is high and sources of the best rank that report no rumours disagree."""
    rows = evidence.where(F.col("field_name").isin(*PRICE_FIELDS) & F.col("value_num").isNotNull()).withColumn("r", source_rank(F.col("field_name"), F.col("source_type")))
    keys = ["group_id", "field_name"]
    spread = rows.groupBy(*keys).agg(F.min("value_num").alias("low"), F.max("value_num").alias("high"), F.max("r").alias("top")).where("low <> high")
    agree = rows.where(F.col("certainty") != "rumored").join(spread.select(*keys, "top"), keys).where("r = top").groupBy(*keys).agg((F.min("value_num") != F.max("value_num")).alias("disagree"))
    severity = price_severity(F.col("low"), F.col("high"))
    review = severity.isin("HIGH", "CRITICAL") & F.coalesce("disagree", F.lit(False))
    return spread.join(agree, keys, "left").select(*keys, severity.alias("severity"), review.alias("requires_review"))


def exact_medians(counts: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """The keys and median: the exact median of numbers given as distinct values with how often they occur, above 0 times.

    A first histogram has cells of a tenth of a percent of a value's size, so a key has some ten thousand at most; of its two
    cells that hold the middle ranks only the values are then ordered. No task holds a key's values.
    """
    keys = list(keys)
    size = F.log(F.abs(F.col(value)) + 1) * 1000
    celled = counts.select(*keys, F.col(value).cast("double").alias("v"), F.col(n).alias("n"), F.floor(F.signum(value) * size).alias("cell"))
    of = Window.partitionBy(*keys)
    cells = celled.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    cells = cells.select(*keys, "cell", (F.sum("n").over(of.orderBy("cell")) - F.col("n")).alias("before"), F.col("n").alias("held"), F.sum("n").over(of).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = cells.where((F.col("before") <= high) & (F.col("before") + F.col("held") > low)).select(*keys, "cell", "before", "total")
    ranked = celled.join(middle, [*keys, "cell"]).withColumn("first", F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "cell").orderBy("v")) - F.col("n"))
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (F.col("first") + F.col("n") > rank), F.col("v")))
    return ranked.groupBy(*keys).agg((at(low) * 0.5 + at(high) * 0.5).alias("median"))


def market_prices(evidence: DataFrame, fields: tuple[str, ...], ratio: float = 2.5) -> DataFrame:
    """(group_id, field_name, price, inliers, outliers, unit_scopes, grading_conflict): the exact median of values
    within `ratio` of the median of all, or of all where none is; scopes that differ are counted. Equal values of a group are
    counted together first, so a group's rows don't meet in one task."""
    keys = ["group_id", "field_name"]
    rows = evidence.where(F.col("field_name").isin(*fields) & F.col("value_num").isNotNull())
    counts = cut(rows.groupBy(*keys, "value_num").agg(F.count("*").alias("n"), F.collect_set("unit_scope").alias("scopes"), F.collect_set("grading").alias("gradings")))
    center = exact_medians(counts, keys, "value_num", "n").withColumnRenamed("median", "m")
    judged = cut(counts.join(center, keys).withColumn("inlier", (F.col("value_num") <= F.col("m") * ratio) & (F.col("value_num") >= F.col("m") / ratio)))
    inner = exact_medians(judged.where("inlier"), keys, "value_num", "n").withColumnRenamed("median", "inner")
    number = lambda name: F.size(F.filter(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("inlier"), F.col(name))))), lambda x: x != "unknown")).cast("long")
    counted = lambda is_in: F.sum(F.when(is_in, F.col("n")).otherwise(0))
    found = judged.groupBy(*keys).agg(F.first("m").alias("m"), counted(F.col("inlier")).alias("inliers"), counted(~F.col("inlier")).alias("outliers"), number("scopes").alias("unit_scopes"), (number("gradings") > 1).alias("grading_conflict"))
    return found.join(inner, keys, "left").select(*keys, F.coalesce("inner", "m").alias("price"), "inliers", "outliers", "unit_scopes", "grading_conflict")


WEAK_SOURCES = ("SOCIAL", "COMMUNITY", "OTHER")


def extreme_claims(evidence: DataFrame, resale: str, spend: str, times: float = 15.0) -> DataFrame:
    """Groups whose highest resale claim is `times` their lowest spend or more and comes from weak sources only."""
    claim = evidence.where(F.col("field_name") == resale).groupBy("group_id").agg(F.max("value_num").alias("resale"), F.bool_and(F.col("source_type").isin(*WEAK_SOURCES)).alias("weak"))
    cost = evidence.where(F.col("field_name") == spend).groupBy("group_id").agg(F.min("value_num").alias("spend"))
    return claim.join(cost, "group_id").where("weak and spend > 0").where(F.col("resale") >= F.col("spend") * times).select("group_id", "resale", "spend")


def resolve_status(evidence: DataFrame, tier: tuple[str, ...] = ("OFFICIAL", "RETAILER", "EVENT")) -> DataFrame:
    """(group_id, status, history): the newest status of the authoritative sources if there are any, else of all (the
    earliest seq on ties); history is all of them in order of time."""
    strong = F.col("source_type").isin(*tier)
    pick = F.max_by("status", F.struct(F.when(strong, 1).otherwise(0).alias("t"), "observed_at", (-F.col("seq")).alias("s")))
    history = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("observed_at", "seq", "status"))), lambda x: x["status"]), ">")
    return evidence.groupBy("group_id").agg(pick.alias("status"), history.alias("history"))
