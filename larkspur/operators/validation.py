"""Validation of incoming records field by field, and constraints on stored opportunities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T

ERROR, WARNING = "ERROR", "WARNING"

#: Currencies and scopes of units that are known, and other names of scopes: fixed values.
SUPPORTED_CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CNY", "KRW")
UNIT_SCOPES = ("complete_set", "case", "box", "lot", "bundle", "pack", "single_item", "unknown")
SCOPE_ALIASES = {
    "single": "single_item",
    "item": "single_item",
    "unit": "single_item",
    "individual": "single_item",
    "sealed box": "box",
    "booster box": "box",
    "sealed case": "case",
    "complete set": "complete_set",
    "full set": "complete_set",
    "set": "complete_set",
}


def issue(broken: Column, field: str, code: str, severity: str = ERROR) -> Column:
    """Struct of field, code and severity where `broken` is true, else null."""
    return F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def filled(c: Column) -> Column:
    return F.coalesce(c.cast("string") != "", F.lit(False))


def norm_scope(c: Column) -> Column:
    """Canonical scope of a unit, or the value as it is; null and '' give null."""
    plain = F.lower(F.trim(c))
    named = F.replace(plain, F.lit(" "), F.lit("_"))
    table = F.create_map(*(F.lit(x) for pair in SCOPE_ALIASES.items() for x in pair))
    return F.when(~filled(c), None).when(named.isin(*UNIT_SCOPES), named).otherwise(F.coalesce(table[plain], c))


def amount_issues(field: str, negative: str) -> list[Column]:
    """Issues of a text that should be a number of 0 or more; missing ones have none."""
    n = T.parse_decimal(F.col(field))
    return [issue(filled(F.col(field)) & n.isNull(), field, "INVALID_NUMERIC"), issue(n < 0, field, negative)]


def record_issues(
    columns: Sequence[str],
    required: Sequence[str] = (),
    content: tuple[str, str] | None = None,
    prices: Sequence[str] = (),
    quantities: Sequence[str] = (),
    urls: Sequence[str] = (),
    stamps: Sequence[str] = (),
    long_texts: Sequence[str] = (),
    longest: int = 20000,
    oversized: str = "truncate",
) -> Column:
    """Array of the issues of a record, in the order of the rules.

    columns are those the record has; currency, source_type, unit_scope, sold with sold_at, graded with grade and
    grading_company, event_start with event_end are judged by their names where all of a rule's columns are there. Texts
    longer than `longest` are a warning (and cut by `cut_texts`) or, if `oversized` is 'reject', an error.
    """
    have, found = set(columns), []
    found += [issue(~filled(F.col(c)), c, "MISSING_REQUIRED_FIELD") for c in required]
    if content:
        found.append(issue(F.coalesce(F.trim(content[0]), F.lit("")).eqNullSafe("") & F.coalesce(F.trim(content[1]), F.lit("")).eqNullSafe(""), "/".join(content), "EMPTY_CONTENT"))
    found += [issue(filled(F.col(c)) & ~T.url_valid(F.col(c)), c, "INVALID_URL") for c in urls]
    found += [issue(filled(F.col(c)) & T.parse_ts(F.col(c)).isNull(), c, "UNPARSEABLE_TIMESTAMP", WARNING) for c in stamps]
    for c in prices:
        found += amount_issues(c, "NEGATIVE_PRICE")
    for c in quantities:
        found += amount_issues(c, "NEGATIVE_QUANTITY")
    if "currency" in have:
        found.append(issue(~T.norm_currency(F.col("currency")).isin(*SUPPORTED_CURRENCIES), "currency", "UNSUPPORTED_CURRENCY", WARNING))
    if "source_type" in have:
        found.append(issue(~T.canon(F.col("source_type"), T.SOURCE_ALIASES, T.SOURCE_TYPES).isin(*T.SOURCE_TYPES), "source_type", "UNRECOGNIZED_SOURCE_TYPE", WARNING))
    if "unit_scope" in have:
        found.append(issue(~norm_scope(F.col("unit_scope")).isin(*UNIT_SCOPES), "unit_scope", "UNRECOGNIZED_UNIT_SCOPE", WARNING))
    if {"sold", "sold_at"} <= have:
        found.append(issue(~F.col("sold") & filled(F.col("sold_at")), "sold_at", "INCOMPATIBLE_SOLD_STATUS"))
    if {"graded", "grade", "grading_company"} <= have:
        found.append(issue(~F.col("graded") & (filled(F.col("grade")) | filled(F.col("grading_company"))), "grade", "INCOMPATIBLE_GRADING_STATUS"))
    if {"event_start", "event_end"} <= have:
        found.append(issue(T.parse_ts(F.col("event_start")) > T.parse_ts(F.col("event_end")), "event_end", "EVENT_END_BEFORE_START"))
    for c in long_texts:
        code, severity = ("CONTENT_TOO_LARGE", ERROR) if oversized == "reject" else ("CONTENT_TRUNCATED", WARNING)
        found.append(issue(F.length(c) > longest, c, code, severity))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<field:string,code:string,severity:string>>")


def validate(records: DataFrame, issues: Column, strict: bool = False) -> DataFrame:
    """Add issues and valid (no error among them); with `strict` warnings count as errors and become such."""
    raised = F.transform(issues, lambda x: x.withField("severity", F.lit(ERROR))) if strict else issues
    # A generator keeps Spark from judging each record again where it filters by valid.
    judged = records.drop("issues").select("*", F.explode(F.array(F.struct(raised.alias("issues")))).alias("__judged"))
    return judged.withColumns({"issues": F.col("__judged.issues"), "valid": ~F.exists("__judged.issues", lambda x: x["severity"] == ERROR)}).drop("__judged")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows of validate(); each row is in one of them."""
    return checked.where("valid").drop("valid"), checked.where("not valid").drop("valid")


def cut_texts(records: DataFrame, columns: Sequence[str], longest: int = 20000) -> DataFrame:
    """Texts cut to `longest` code points, as the warning CONTENT_TRUNCATED says."""
    return records.withColumns({c: F.substring(c, 1, longest) for c in columns})


#: Columns of opportunities with a score of 0 to 100, amounts of 0 or more and values of enums: fixed values.
SCORES = ("collector_score", "flip_score", "hold_score", "scarcity_score", "demand_score", "hype_score", "acquisition_score", "risk_score", "confidence_score", "opportunity_score")
AMOUNTS = (
    "retail_price",
    "required_spend",
    "purchase_limit",
    "stated_quantity",
    "current_market_price",
    "recent_sold_price",
    "estimated_market_price",
    "peak_market_price",
    "active_listing_count",
    "sold_listing_count",
    "recommended_quantity",
    "target_buy_price",
    "target_sell_price",
)
ENUMS = {
    "acquisition_difficulty": ("EASY", "MODERATE", "HARD", "VERY_HARD", "EXTREME"),
    "demand_direction": ("FALLING", "FLAT", "RISING", "SURGING", "UNKNOWN"),
    "recommendation": ("CRITICAL_BUY", "STRONG_BUY", "BUY", "CONDITIONAL_BUY", "WATCH", "SKIP", "AVOID"),
    "primary_strategy": ("FLIP_NOW", "QUICK_FLIP", "HOLD_SHORT", "HOLD_MEDIUM", "HOLD_LONG", "COLLECT_ONLY", "WATCH", "AVOID"),
    "source_type": T.SOURCE_TYPES,
}


def constraint_breaches(rows: DataFrame, scores: Sequence[str] = SCORES, amounts: Sequence[str] = AMOUNTS, enums: Mapping[str, Sequence[str]] = ENUMS) -> DataFrame:
    """Add breaches: names of the constraints that a row breaks (score_ranges:column, nonnegative_amounts:column,
    enum:column), over those columns that are there. Nulls break none."""
    have = set(rows.columns)
    rules = {f"score_ranges:{c}": F.col(c).between(0, 100) for c in scores if c in have}
    rules |= {f"nonnegative_amounts:{c}": F.col(c) >= 0 for c in amounts if c in have}
    rules |= {f"enum:{c}": F.col(c).isin(*values) for c, values in enums.items() if c in have}
    broken = [F.when(~ok, name) for name, ok in rules.items()]
    return rows.withColumn("breaches", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
