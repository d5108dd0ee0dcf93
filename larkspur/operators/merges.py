"""Keyed upserts, first-wins merges, overrides, and digests of rows and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as T


def filled(c: str, df: DataFrame) -> Column:
    """Whether a value counts as there: not null, '' or an empty array; 0 and false do."""
    kind = df.schema[c].dataType.typeName()
    ok = F.col(c).isNotNull()
    return ok & (F.col(c) != "") if kind == "string" else ok & (F.size(c) > 0) if kind in ("array", "map") else ok


def _union_in_order(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Distinct values of a key in the order in which they first come, as an array."""
    first = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias(f"{value}s"))


def upsert_catalog(rows: DataFrame, key: str, order: str, values: Sequence[str], description: str, source: str, seen_at: str) -> DataFrame:
    """One record for each key: the last filled value of each column; the longest description, the later of equal ones;
    sources in the order of their first sight; first and last sight and the number of scans.

    `rows` are the old catalog's and the scan's rows together, in `order`.
    """
    long = F.when(F.coalesce(description, F.lit("")) != "", F.struct(F.length(description), F.col(order)))
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        *(F.max_by(v, F.when(filled(v, rows), F.col(order))).alias(v) for v in values),
        F.max_by(description, long).alias(description),
        F.min_by(seen_at, order).alias("first_seen_at"),
        F.max_by(seen_at, order).alias("last_seen_at"),
        F.count("*").alias("scan_count"),
    )
    return merged.join(_union_in_order(rows, key, order, source), key, "left")


def dedup_first_wins(rows: DataFrame, key: str, order: str, values: Sequence[str], description: str, source: str) -> DataFrame:
    """One record for each key: the first filled value of each column; a later description only if strictly longer."""
    long = F.when(F.coalesce(description, F.lit("")) != "", F.struct(F.length(description), -F.col(order)))
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min_by(v, F.when(filled(v, rows), F.col(order))).alias(v) for v in values), F.max_by(description, long).alias(description))
    return merged.join(_union_in_order(rows, key, order, source), key, "left")


def upsert_rows(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new row of each key, else the current one, with its change: inserted, updated or kept."""
    names = current.columns
    old = current.select(F.struct(*names).alias("o"), F.col(key).alias("ok"))
    fresh = new.select(F.struct(*names).alias("n"), F.col(key).alias("nk"))
    joined = old.join(fresh, F.col("ok") == F.col("nk"), "full_outer")
    change = F.when(F.col("ok").isNull(), "inserted").when(F.col("nk").isNull() | F.col("o").eqNullSafe(F.col("n")), "kept").otherwise("updated")
    return joined.select(F.coalesce("n", "o").alias("r"), change.alias("change")).select("r.*", "change")


def override_history(edits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(id, seq, field, old_value, new_value) of each edit that changes a field; edits of an id follow seq, before the
    first all fields are null."""
    order = Window.partitionBy("id").orderBy("seq")
    named = ", ".join(f"'{f}', cast({f} as string), cast(__old_{f} as string)" for f in fields)
    lagged = edits.select("id", "seq", *fields, *(F.lag(f).over(order).alias(f"__old_{f}") for f in fields))
    long = lagged.select("id", "seq", F.expr(f"stack({len(fields)}, {named}) as (field, new_value, old_value)"))
    return long.where(~F.col("new_value").eqNullSafe(F.col("old_value"))).select("id", "seq", "field", "old_value", "new_value")


#: Fields that never count as changes, statuses whose coming matters, fields whose every change matters, and prices: fixed values.
NOISE = ("created_at", "updated_at", "discovered_at", "last_verified_at", "opportunity_id", "raw_metadata", "score_explanation", "evidence", "normalized_product_name", "source_confidence", "reasoning")
TELLING_STATUSES = ("live", "sold_out", "restocked")
TELLING_FIELDS = ("membership_required", "lottery_required", "event_attendance_required", "bundle_required", "purchase_limit", "membership_exclusive", "recommendation", "primary_strategy")
PRICES = ("recent_sold_price", "current_market_price", "estimated_market_price", "retail_price", "required_spend")


def change_summary(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], mismatch: str | None = None, price_percent: float = 15.0, score_step: float = 10.0) -> DataFrame:
    """(key, field, previous_value, new_value, material) of each of `fields` that differs between two versions of a row.

    Material are: a status that becomes one of TELLING_STATUSES or was rumored; any change of TELLING_FIELDS; a price by
    `price_percent` or more, or that comes, goes or was 0; an opportunity_score by `score_step` or more between two known ones.
    Other changes are listed, not material; NOISE is left out. `mismatch` names a flag of complete-set prices: where it
    ends, a row complete_set_mismatch says so, which is material. Rows of one version only are left out.
    """
    names = [f for f in fields if f not in NOISE]
    flags = [mismatch] if mismatch else []
    pair = old.select(key, *(F.col(f).alias(f"o_{f}") for f in [*names, *flags])).join(new.select(key, *(F.col(f).alias(f"n_{f}") for f in [*names, *flags])), key)
    row = lambda f, o, n, matters: F.struct(F.lit(f).alias("field"), o.cast("string").alias("previous_value"), n.cast("string").alias("new_value"), matters.alias("material"))
    parts = []
    for f in names:
        o, n = F.col(f"o_{f}"), F.col(f"n_{f}")
        both = o.isNotNull() & n.isNotNull()
        if f == "status":
            matters = F.coalesce(n.isin(*TELLING_STATUSES), F.lit(False)) | o.eqNullSafe("rumored")
        elif f in PRICES:
            matters = F.when(both & (o != 0), F.abs(n - o) / F.abs(o) * 100 >= price_percent).otherwise(True)
        elif f == "opportunity_score":
            matters = F.when(both, F.abs(n - o) >= score_step).otherwise(False)
        else:
            matters = F.lit(f in TELLING_FIELDS)
        parts.append(F.when(~o.eqNullSafe(n), row(f, o, n, matters)))
    if mismatch:
        was, now = (F.coalesce(F.col(f"{v}_{mismatch}"), F.lit(False)) for v in "on")
        parts.append(F.when(was & ~now, row("complete_set_mismatch", was, now, F.lit(True))))
    return pair.select(key, F.explode(F.array_compact(F.array(*parts))).alias("c")).select(key, "c.*")


def row_fingerprint(link: Column, source_id: Column, title: Column, source: Column, published: Column, content: Column) -> Column:
    """Struct of identity (url or source id) and content digest of the normalised parts, as 24 hexadecimal digits."""
    identity = F.when(F.coalesce(link, F.lit("")) != "", F.concat(F.lit("url:"), T.norm_text(link))).when(source_id.isNotNull(), F.concat(F.lit("source:"), T.norm_text(source_id)))
    parts = F.concat_ws("|", T.norm_text(title), T.norm_text(source), F.trim(F.coalesce(published, F.lit(""))), F.substring(T.norm_text(content), 1, 2000))
    return F.struct(identity.alias("identity"), F.substring(F.sha2(parts.cast("binary"), 256), 1, 24).alias("content_hash"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """rows and digest of a table, whatever the order of its rows and columns: the digests of the rows (columns by name,
    as text, null apart from '') are summed in 15 hexadecimal digits each, so that repeated rows count."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(df.columns)))
    part = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))
