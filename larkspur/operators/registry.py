"""Source registries: integrity, links, differences, inherited settings and worklists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.groups import reach
from larkspur.sources.tables import few


def missing_references(sources: DataFrame, column: str, known: DataFrame, key: str, rule: str) -> DataFrame:
    """(source_id, rule, value) of sources whose `column` names no row of `known`."""
    named = sources.where(F.col(column).isNotNull()).select("source_id", F.col(column).alias("value"))
    return named.join(few(known.select(F.col(key).alias("value")).distinct()), "value", "left_anti").select("source_id", F.lit(rule).alias("rule"), F.col("value").cast("string").alias("value"))


def repeated(sources: DataFrame, column: str, rule: str) -> DataFrame:
    """(source_id, rule, value) of sources that share a value of `column` with others."""
    often = sources.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1").select(F.col(column).alias("v"))
    return sources.join(often, F.col(column) == F.col("v"), "left_semi").select("source_id", F.lit(rule).alias("rule"), F.col(column).cast("string").alias("value"))


def registry_issues(categories: DataFrame, brands: DataFrame, sources: DataFrame, scouts: DataFrame) -> DataFrame:
    """(kind, id, code, value) of all that is wrong in a registry, ids and values as texts.

    categories: category_id, parent_category_id; brands: brand_id, category_ids; sources: source_id, url, brand_id,
    category_ids, scout_ids, enabled, lifecycle; scouts: scout_id, enabled, source_ids. A repeated id gives one row with
    the number of repeats, a repeated url a row for each source but the first by id, a cycle a row for each category in
    it. Ownership counts whichever side declares it. Null references name nothing.
    """

    def rows(df: DataFrame, kind: str, key: str, code: str, value: Column | None = None) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit(code).alias("code"), (F.lit(None) if value is None else value).cast("string").alias("value"))

    def unknown(df: DataFrame, kind: str, key: str, named: Column, known: DataFrame, known_key: str, code: str) -> DataFrame:
        asked = df.select(key, named.alias("named")).where("named is not null").distinct()
        ids = few(known.select(F.col(known_key).alias("known")).distinct())
        return rows(asked.join(ids, F.col("named") == F.col("known"), "left_anti"), kind, key, code, F.col("named"))

    tables = {"category": categories, "brand": brands, "source": sources, "scout": scouts}
    found = [rows(df.groupBy(f"{kind}_id").agg(F.count("*").alias("n")).where("n > 1"), kind, f"{kind}_id", f"DUPLICATE_{kind.upper()}_ID", F.col("n") - 1) for kind, df in tables.items()]
    found.append(unknown(categories, "category", "category_id", F.col("parent_category_id"), categories, "category_id", "MISSING_CATEGORY_REFERENCE"))
    found.append(unknown(brands, "brand", "brand_id", F.explode("category_ids"), categories, "category_id", "MISSING_CATEGORY_REFERENCE"))
    found.append(unknown(sources, "source", "source_id", F.explode("category_ids"), categories, "category_id", "MISSING_CATEGORY_REFERENCE"))
    found.append(unknown(sources, "source", "source_id", F.col("brand_id"), brands, "brand_id", "MISSING_BRAND_REFERENCE"))
    found.append(unknown(sources, "source", "source_id", F.explode("scout_ids"), scouts, "scout_id", "MISSING_SCOUT_REFERENCE"))
    found.append(unknown(scouts, "scout", "scout_id", F.explode("source_ids"), sources, "source_id", "MISSING_SOURCE_REFERENCE"))
    cycles = reach(categories.select(F.col("category_id").alias("node"), F.col("parent_category_id").alias("parent"))).where("node = ancestor")
    found.append(rows(cycles, "category", "node", "CATEGORY_CYCLE"))
    first = sources.where("url <> ''").groupBy("url").agg(F.min("source_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    found.append(rows(sources.select("source_id", "url").join(first, "url").where("source_id <> owner").distinct(), "source", "source_id", "DUPLICATE_CANONICAL_URL", F.col("owner")))

    scout_state = few(scouts.select(F.col("scout_id").alias("s"), F.col("enabled").alias("on")).distinct())
    declared = sources.select("source_id", F.explode("scout_ids").alias("scout_id")).unionByName(scouts.select(F.explode("source_ids").alias("source_id"), "scout_id")).distinct()
    owners = declared.join(scout_state, F.col("scout_id") == F.col("s"), "left").groupBy("source_id").agg(F.bool_and(F.coalesce(~F.col("on"), F.lit(False))).alias("all_off"))
    enabled = sources.where("enabled").select("source_id").distinct().join(owners, "source_id", "left")
    found.append(rows(enabled.where("all_off is null"), "source", "source_id", "SOURCE_HAS_NO_SCOUT"))
    found.append(rows(enabled.where("all_off"), "source", "source_id", "SOURCE_SCOUT_STATE_CONFLICT"))
    runnable = declared.join(sources.where(F.col("lifecycle").isin("active", "proposed")).select("source_id"), "source_id", "left_semi").select("scout_id").distinct()
    found.append(rows(scouts.where("enabled").select("scout_id").distinct().join(runnable, "scout_id", "left_anti"), "scout", "scout_id", "SCOUT_HAS_NO_RUNNABLE_SOURCE"))
    return reduce(DataFrame.unionByName, found)


def repair_links(sources: DataFrame, scouts: DataFrame) -> DataFrame:
    """(source_id, scout_id) that either side declares: sources has scout_ids, scouts has source_ids (arrays)."""
    a = sources.select("source_id", F.explode("scout_ids").alias("scout_id"))
    b = scouts.select(F.explode("source_ids").alias("source_id"), "scout_id")
    return a.unionByName(b).distinct()


#: Ranks of priorities and of authority levels, the first is best: fixed values.
PRIORITIES = ("critical", "high", "medium", "low", "archival")
AUTHORITIES = ("official_primary", "official_secondary", "authorized_retailer", "reputable_press", "marketplace_confirmed_sale", "marketplace_asking", "community_verified", "community_unverified", "social_verified", "social_unverified", "manual_trusted", "manual_untrusted")


def rank_of(c: Column, names: Sequence[str], other: int = 99) -> Column:
    """The place of a name among `names`; `other` for unknown ones."""
    return F.coalesce(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))[c], F.lit(other))


def diff_registry(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change, changed_fields, switched, breaking) of sources that were added, removed or changed in `fields`.

    switched is enabled or disabled where that changed. breaking names what may break a run: another url or connector where
    both versions have one, another source_type, a fall from an official authority level to another known one, the
    removal of an active source that was enabled. Versions have the fields and enabled, lifecycle, url, connector_type, source_type
    and authority_level as far as they know them.
    """
    ruled = [c for c in ("enabled", "lifecycle", "url", "connector_type", "source_type", "authority_level") if c in old.columns and c in new.columns]
    names = list(dict.fromkeys([*fields, *ruled]))
    o = old.select(F.col(key).alias("ok"), *(F.col(f).alias(f"o_{f}") for f in names))
    n = new.select(F.col(key).alias("nk"), *(F.col(f).alias(f"n_{f}") for f in names))
    joined = o.join(n, F.col("ok") == F.col("nk"), "full_outer")
    was, now = (lambda f: F.col(f"o_{f}") if f in ruled else F.lit(None)), (lambda f: F.col(f"n_{f}") if f in ruled else F.lit(None))
    differ = F.array_compact(F.array(*(F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), f) for f in fields)))
    change = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "removed").otherwise("changed")
    moved = lambda f: (F.coalesce(was(f), F.lit("")) != "") & (F.coalesce(now(f), F.lit("")) != "") & (was(f) != now(f))
    fell = was("authority_level").isin(*AUTHORITIES) & now("authority_level").isin(*AUTHORITIES) & was("authority_level").startswith("official") & ~now("authority_level").startswith("official")
    changed = change == "changed"
    rules = {
        "url": changed & moved("url"),
        "connector_type": changed & moved("connector_type"),
        "source_type": changed & ~was("source_type").eqNullSafe(now("source_type")),
        "authority_level": changed & fell,
        "removed": (change == "removed") & was("enabled").cast("boolean") & (was("lifecycle") == "active"),
    }
    breaking = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()))), ",")
    on = F.coalesce(now("enabled").cast("boolean"), F.lit(False))
    switched = F.when(changed & ~was("enabled").eqNullSafe(now("enabled")), F.when(on, "enabled").otherwise("disabled"))
    rows = joined.select(F.coalesce("nk", "ok").alias(key), change.alias("change"), F.when(changed, differ).otherwise(F.array().cast("array<string>")).alias("differ"), switched.alias("switched"), breaking.alias("breaking"))
    return rows.where((F.col("change") != "changed") | (F.size("differ") > 0)).select(key, "change", F.array_join("differ", ",").alias("changed_fields"), "switched", "breaking")


def idle_scouts(scouts: DataFrame, sources: DataFrame) -> DataFrame:
    """scout_id of enabled scouts (scout_id, enabled, source_ids) none of whose sources is enabled and active or proposed."""
    runnable = sources.where(F.col("enabled") & F.col("lifecycle").isin("active", "proposed")).select("source_id")
    working = scouts.select("scout_id", F.explode("source_ids").alias("source_id")).join(runnable, "source_id", "left_semi").select("scout_id")
    return scouts.where("enabled").select("scout_id").join(working, "scout_id", "left_anti")


def effective_settings(sources: DataFrame, links: DataFrame, scouts: DataFrame, default_schedule: str = "manual") -> DataFrame:
    """source_id, schedule (the source's own, else that of its first scout by id that has one, else the default) and priority (the
    best of its scouts'; medium without scouts that are known)."""
    owned = links.join(few(scouts.select("scout_id", F.col("schedule").alias("s"), F.col("priority").alias("p"))), "scout_id")
    best = owned.groupBy("source_id").agg(F.min_by("s", F.when(F.col("s").isNotNull(), F.col("scout_id"))).alias("s"), F.min_by("p", F.struct(rank_of(F.col("p"), PRIORITIES), "scout_id")).alias("p"))
    return sources.join(best, "source_id", "left").select("source_id", F.coalesce("schedule", "s", F.lit(default_schedule)).alias("schedule"), F.coalesce("p", F.lit("medium")).alias("priority"))


def connector_configs(sources: DataFrame, links: DataFrame, scouts: DataFrame, default: dict[str, str] | None = None) -> DataFrame:
    """source_id and config (map of texts): the default's entries, over them those of its scouts in the order of their ids, over
    these the source's own. sources and scouts have `config`, a map; null and empty ones add nothing.

    Entries are rows of (source, name, level, scout); the highest level of each name stays."""
    row = lambda level, scout: [F.lit(level).alias("level"), scout.alias("scout")]
    own = sources.select("source_id", F.explode("config").alias("name", "value"), *row(2, F.lit(None).cast(scouts.schema["scout_id"].dataType)))
    theirs = links.join(few(scouts.select("scout_id", "config")), "scout_id").select("source_id", F.explode("config").alias("name", "value"), *row(1, F.col("scout_id")))
    rows = own.unionByName(theirs)
    if default:
        given = F.create_map(*(F.lit(x) for kv in default.items() for x in kv))
        rows = rows.unionByName(sources.select("source_id", F.explode(given).alias("name", "value"), *row(0, F.lit(None).cast(scouts.schema["scout_id"].dataType))))
    merged = rows.groupBy("source_id", "name").agg(F.max_by("value", F.struct("level", "scout")).alias("value"))
    maps = merged.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("config"))
    return sources.select("source_id").join(maps, "source_id", "left").select("source_id", F.coalesce("config", F.create_map().cast("map<string,string>")).alias("config"))


def worklist(sources: DataFrame, allow_proposed: bool = False, deprecated: str = "run_with_warning") -> DataFrame:
    """Add state (runnable, disabled or invalid), reason and warning to sources with enabled, lifecycle and
    connector_type. `deprecated` is run_with_warning or exclude."""
    life = F.coalesce("lifecycle", F.lit(""))
    cases = [
        (~F.coalesce("enabled", F.lit(False)), "disabled", "source is disabled"),
        (life == "retired", "disabled", "source is retired"),
        (life == "broken", "invalid", "source is marked broken"),
        (life == "paused", "disabled", "source is paused"),
        ((life == "proposed") & F.lit(not allow_proposed), "disabled", "source is proposed"),
        (F.col("connector_type").isNull(), "invalid", "source has no connector_type"),
        ((life == "deprecated") & F.lit(deprecated == "exclude"), "disabled", "source is deprecated"),
    ]
    state, reason = F.lit("runnable"), F.lit(None).cast("string")
    for ok, name, why in reversed(cases):
        state, reason = F.when(ok, name).otherwise(state), F.when(ok, why).otherwise(reason)
    return sources.withColumns({"state": state, "reason": reason, "warning": F.when((state == "runnable") & (life == "deprecated"), "source is deprecated")})


def ordered_worklist(work: DataFrame) -> DataFrame:
    """Runnable rows of worklist() with schedule, priority, authority_level and scout_id, and due (whether the schedule runs by
    itself), priority_rank and authority_rank: due ones first, then by priority, authority, scout and source."""
    due = ~F.coalesce(F.col("schedule"), F.lit("manual")).isin("manual", "disabled")
    ranked = work.where("state = 'runnable'").withColumns({"due": due, "priority_rank": rank_of(F.col("priority"), PRIORITIES), "authority_rank": rank_of(F.col("authority_level"), AUTHORITIES)})
    return ranked.orderBy(F.desc("due"), "priority_rank", "authority_rank", F.coalesce("scout_id", F.lit("")), "source_id")


def list_sources(sources: DataFrame, values: dict[str, Sequence], overlaps: dict[str, Sequence] | None = None) -> DataFrame:
    """Sources whose columns are among the given values and whose arrays share some, ordered by id."""
    keep: Column = F.lit(True)
    for c, v in values.items():
        keep = keep & F.col(c).isin(*v)
    for c, v in (overlaps or {}).items():
        keep = keep & F.arrays_overlap(c, F.array(*(F.lit(x) for x in v)))
    return sources.where(keep).orderBy("source_id")
