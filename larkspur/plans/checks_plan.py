"""Registered queries over validation, constraints, the registry's integrity and gaps in what signals tell, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import pages, registry, routing, signals, validation
from larkspur.plans.claims_plan import SQL as CLAIMS_SQL
from larkspur.plans.claims_plan import t1
from larkspur.plans.items_plan import _DEC
from larkspur.plans.views import plain, view

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL (names of tables and views in braces)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = plain(sql)
        return f

    return add


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _sql_issue(broken: str, field: str, code: str, severity: str = "ERROR") -> str:
    return f"CASE WHEN {broken} THEN '{field}:{code}:{severity}' END"


_WHEN = lambda c: f"try_strptime(trim({c}), ['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d'])"
_ISSUES = ",\n".join(
    [
        _sql_issue("coalesce(amount, '') = ''", "amount", "MISSING_REQUIRED_FIELD"),
        _sql_issue("coalesce(url, '') <> '' AND NOT regexp_matches(trim(url), '^(?i)https?://[^/?#]+')", "url", "INVALID_URL"),
        _sql_issue(f"coalesce(stamp, '') <> '' AND {_WHEN('stamp')} IS NULL", "stamp", "UNPARSEABLE_TIMESTAMP", "WARNING"),
        _sql_issue(f"coalesce(amount, '') <> '' AND {_DEC} IS NULL", "amount", "INVALID_NUMERIC"),
        _sql_issue(f"{_DEC} < 0", "amount", "NEGATIVE_PRICE"),
        _sql_issue("coalesce(currency, '') <> '' AND currency <> '$' AND upper(trim(currency)) NOT IN ('USD', 'EUR', 'GBP', 'JPY', 'CAD', 'AUD', 'CNY', 'KRW')", "currency", "UNSUPPORTED_CURRENCY", "WARNING"),
        _sql_issue(f"coalesce(source_type, '') <> '' AND upper(trim(source_type)) NOT IN ({_quoted(T.SOURCE_TYPES)}) AND lower(trim(source_type)) NOT IN ({_quoted(T.SOURCE_ALIASES)})", "source_type", "UNRECOGNIZED_SOURCE_TYPE", "WARNING"),
        _sql_issue(f"coalesce(unit_scope, '') <> '' AND replace(lower(trim(unit_scope)), ' ', '_') NOT IN ({_quoted(validation.UNIT_SCOPES)}) AND lower(trim(unit_scope)) NOT IN ({_quoted(validation.SCOPE_ALIASES)})", "unit_scope", "UNRECOGNIZED_UNIT_SCOPE", "WARNING"),
        _sql_issue(f"lower(trim(flag)) IN ({_quoted(T.FALSE_TEXTS)}) AND coalesce(stamp, '') <> ''", "sold_at", "INCOMPATIBLE_SOLD_STATUS"),
        _sql_issue("seq % 3 = 0 AND seq % 4 = 0", "grade", "INCOMPATIBLE_GRADING_STATUS"),
        _sql_issue(f"{_WHEN('stamp')} > TIMESTAMP '1996-01-01 00:00:00'", "event_end", "EVENT_END_BEFORE_START"),
        _sql_issue("length(url) > 26", "url", "CONTENT_TRUNCATED", "WARNING"),
    ]
)


@query("F18_record_issues", f"SELECT seq, array_to_string(i, ',') AS issues, NOT contains(array_to_string(i, ','), ':ERROR') AS valid FROM (SELECT seq, list_filter([{_ISSUES}], lambda x: x IS NOT NULL) AS i FROM {{dirty}})")
def f18_issues(spark: SparkSession, d: str) -> DataFrame:
    """Records of every line, accepted and quarantined ones with their issues."""
    k = F.col("seq")
    made = {"sold": T.parse_bool(F.col("flag")), "sold_at": F.col("stamp"), "graded": F.when(k % 3 == 0, False), "grade": F.when(k % 4 == 0, "9"), "grading_company": F.lit(None).cast("string"), "event_start": F.col("stamp"), "event_end": F.lit("1996-01-01")}
    records = view(spark, d, "dirty").withColumns(made)
    issues = validation.record_issues(records.columns, required=("amount",), prices=("amount",), urls=("url",), stamps=("stamp",), long_texts=("url",), longest=26)
    accepted, quarantined = validation.split_valid(validation.validate(records, issues))
    said = F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["field"], x["code"], x["severity"])), ",").alias("issues")
    return accepted.select("seq", said, F.lit(True).alias("valid")).unionByName(quarantined.select("seq", said, F.lit(False).alias("valid")))


@query("F19_constraint_breaches", """SELECT seq, array_to_string(list_filter([CASE WHEN confidence_score NOT BETWEEN 0 AND 100 THEN 'score_ranges:confidence_score' END, CASE WHEN opportunity_score NOT BETWEEN 0 AND 100 THEN 'score_ranges:opportunity_score' END,
CASE WHEN required_spend < 0 THEN 'nonnegative_amounts:required_spend' END, CASE WHEN purchase_limit < 0 THEN 'nonnegative_amounts:purchase_limit' END, CASE WHEN recommendation NOT IN ('CRITICAL_BUY', 'STRONG_BUY', 'BUY', 'CONDITIONAL_BUY', 'WATCH', 'SKIP', 'AVOID') THEN 'enum:recommendation' END], lambda x: x IS NOT NULL), ',') AS breaches
FROM (SELECT seq, CASE WHEN seq % 7 > 0 THEN seq % 120 END AS confidence_score, score - 3 AS opportunity_score, required_spend - 950 AS required_spend, seq % 9 - 2 AS purchase_limit, CASE seq % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'AVOID' WHEN 2 THEN 'HOLD' END AS recommendation FROM {opportunities})""")
def f19_breaches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq")
    rows = view(spark, d, "opportunities").select(
        "seq", F.when(k % 7 > 0, k % 120).alias("confidence_score"), (F.col("score") - 3).alias("opportunity_score"), (F.col("required_spend") - 950).alias("required_spend"), (k % 9 - 2).alias("purchase_limit"), F.when(k % 4 == 0, "BUY").when(k % 4 == 1, "AVOID").when(k % 4 == 2, "HOLD").alias("recommendation")
    )
    return validation.constraint_breaches(rows).select("seq", F.array_join("breaches", ",").alias("breaches"))


_CATEGORIES = "SELECT n_nationkey AS category_id, CASE WHEN n_nationkey = 7 THEN 99 WHEN n_nationkey = 11 THEN 12 WHEN n_nationkey = 12 THEN 11 WHEN n_nationkey % 5 > 0 THEN n_nationkey - n_nationkey % 5 END AS parent_category_id FROM {nation} UNION ALL SELECT r_regionkey, NULL FROM {region}"
_REGISTRY = f"""cat AS ({_CATEGORIES}), br AS (SELECT n_nationkey AS brand_id, [n_nationkey + 3, n_nationkey % 3] AS category_ids FROM {{nation}}),
src AS (SELECT s_suppkey AS source_id, concat('http://s/', s_suppkey % 90) AS url, CASE WHEN s_suppkey % 10 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS brand_id, [s_suppkey % 27] AS category_ids, CASE WHEN s_suppkey % 3 > 0 THEN [s_suppkey % 40] ELSE [] END AS scout_ids, s_suppkey % 4 <> 0 AS enabled, CASE WHEN s_suppkey % 11 = 0 THEN 'retired' ELSE 'active' END AS lifecycle FROM {{supplier}}),
sc AS (SELECT n_nationkey AS scout_id, n_nationkey % 3 <> 0 AS enabled, [n_nationkey * 11, n_nationkey * 1000000] AS source_ids FROM {{nation}}),
cy AS (SELECT category_id AS id, parent_category_id AS up, 1 AS depth FROM cat WHERE parent_category_id IS NOT NULL UNION SELECT cy.id, cat.parent_category_id, depth + 1 FROM cy JOIN cat ON cat.category_id = cy.up WHERE cat.parent_category_id IS NOT NULL AND depth < 40),
decl AS (SELECT source_id, unnest(scout_ids) AS scout_id FROM src UNION SELECT unnest(source_ids), scout_id FROM sc),
own AS (SELECT decl.source_id, bool_and(coalesce(NOT sc.enabled, false)) AS all_off FROM decl LEFT JOIN sc ON sc.scout_id = decl.scout_id GROUP BY decl.source_id)"""


@query(
    "J13_registry_issues",
    f"""WITH RECURSIVE {_REGISTRY}
SELECT 'category' AS kind, CAST(category_id AS VARCHAR) AS id, 'DUPLICATE_CATEGORY_ID' AS code, CAST(count(*) - 1 AS VARCHAR) AS value FROM cat GROUP BY category_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'category', CAST(category_id AS VARCHAR), 'MISSING_CATEGORY_REFERENCE', CAST(parent_category_id AS VARCHAR) FROM cat WHERE parent_category_id IS NOT NULL AND parent_category_id NOT IN (SELECT category_id FROM cat)
UNION ALL SELECT DISTINCT 'brand', CAST(brand_id AS VARCHAR), 'MISSING_CATEGORY_REFERENCE', CAST(c AS VARCHAR) FROM (SELECT brand_id, unnest(category_ids) AS c FROM br) WHERE c NOT IN (SELECT category_id FROM cat)
UNION ALL SELECT DISTINCT 'source', CAST(source_id AS VARCHAR), 'MISSING_CATEGORY_REFERENCE', CAST(c AS VARCHAR) FROM (SELECT source_id, unnest(category_ids) AS c FROM src) WHERE c NOT IN (SELECT category_id FROM cat)
UNION ALL SELECT DISTINCT 'source', CAST(source_id AS VARCHAR), 'MISSING_BRAND_REFERENCE', CAST(brand_id AS VARCHAR) FROM src WHERE brand_id NOT IN (SELECT brand_id FROM br)
UNION ALL SELECT DISTINCT 'source', CAST(source_id AS VARCHAR), 'MISSING_SCOUT_REFERENCE', CAST(c AS VARCHAR) FROM (SELECT source_id, unnest(scout_ids) AS c FROM src) WHERE c NOT IN (SELECT scout_id FROM sc)
UNION ALL SELECT DISTINCT 'scout', CAST(scout_id AS VARCHAR), 'MISSING_SOURCE_REFERENCE', CAST(c AS VARCHAR) FROM (SELECT scout_id, unnest(source_ids) AS c FROM sc) WHERE c NOT IN (SELECT source_id FROM src)
UNION ALL SELECT DISTINCT 'category', CAST(id AS VARCHAR), 'CATEGORY_CYCLE', NULL FROM cy WHERE id = up
UNION ALL SELECT 'source', CAST(source_id AS VARCHAR), 'DUPLICATE_CANONICAL_URL', CAST(o AS VARCHAR) FROM (SELECT source_id, min(source_id) OVER (PARTITION BY url) AS o FROM src) WHERE source_id <> o
UNION ALL SELECT 'source', CAST(source_id AS VARCHAR), 'SOURCE_HAS_NO_SCOUT', NULL FROM src WHERE enabled AND source_id NOT IN (SELECT source_id FROM decl)
UNION ALL SELECT 'source', CAST(src.source_id AS VARCHAR), 'SOURCE_SCOUT_STATE_CONFLICT', NULL FROM src JOIN own ON own.source_id = src.source_id WHERE enabled AND all_off
UNION ALL SELECT 'scout', CAST(scout_id AS VARCHAR), 'SCOUT_HAS_NO_RUNNABLE_SOURCE', NULL FROM sc WHERE enabled AND scout_id NOT IN (SELECT decl.scout_id FROM decl JOIN src ON src.source_id = decl.source_id WHERE lifecycle IN ('active', 'proposed'))""",
)
def j13_issues(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    nation, none = view(spark, d, "nation"), F.array().cast("array<int>")
    parent = F.when(n == 7, 99).when(n == 11, 12).when(n == 12, 11).when(n % 5 > 0, n - n % 5)
    regions = view(spark, d, "region").select(F.col("r_regionkey").alias("category_id"), F.lit(None).cast("int").alias("parent_category_id"))
    categories = nation.select(n.alias("category_id"), parent.alias("parent_category_id")).unionByName(regions)
    brands = nation.select(n.alias("brand_id"), F.array(n + 3, n % 3).alias("category_ids"))
    sources = view(spark, d, "supplier").select(
        s.alias("source_id"), F.concat(F.lit("http://s/"), (s % 90).cast("string")).alias("url"), (F.col("s_nationkey") + F.when(s % 10 == 0, 100).otherwise(0)).alias("brand_id"), F.array((s % 27).cast("int")).alias("category_ids"),
        F.when(s % 3 > 0, F.array((s % 40).cast("int"))).otherwise(none).alias("scout_ids"), (s % 4 != 0).alias("enabled"), F.when(s % 11 == 0, "retired").otherwise("active").alias("lifecycle"),
    )
    scouts = nation.select(n.alias("scout_id"), (n % 3 != 0).alias("enabled"), F.array((n * 11).cast("long"), (n * 1000000).cast("long")).alias("source_ids"))
    return registry.registry_issues(categories, brands, sources, scouts)


@query("T7_doc_gaps", f"""WITH d AS ({CLAIMS_SQL["T1_signal_types"].replace("{", "").replace("}", "")}), g AS (SELECT seq, list(DISTINCT signal) AS h FROM d GROUP BY seq), p AS (SELECT products.seq, products.seq % 3 = 0 AS known, coalesce(h, []) AS h FROM (SELECT p_partkey AS seq FROM {{part}}) products LEFT JOIN g ON g.seq = products.seq)
SELECT seq, array_to_string(list_filter([CASE WHEN NOT known THEN 'product_identity' END, CASE WHEN NOT list_has_any(h, ['SPEND_REQUIREMENT', 'RETAIL_PRICE', 'OBSERVED_RESALE_PRICE']) THEN 'pricing_information' END, CASE WHEN NOT list_has_any(h, ['STATUS_LIVE', 'STATUS_SOLD_OUT', 'STATUS_RESTOCKED', 'RELEASE_DATE', 'PURCHASE_WINDOW']) THEN 'release_or_availability_status' END], lambda x: x IS NOT NULL), ',') AS missing,
array_to_string(list_filter([CASE WHEN list_has_all(h, ['STATUS_SOLD_OUT', 'STATUS_LIVE']) THEN 'STATUS_SOLD_OUT/STATUS_LIVE' END, CASE WHEN list_has_all(h, ['STATUS_SOLD_OUT', 'STATUS_RESTOCKED']) THEN 'STATUS_SOLD_OUT/STATUS_RESTOCKED' END, CASE WHEN NOT known AND list_contains(h, 'RUMOR') THEN 'RUMOR_WITHOUT_IDENTITY' END], lambda x: x IS NOT NULL), ',') AS warnings FROM p""")
def t7_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What the signals of T1's sentences leave open; a third of the products have an identity."""
    known = view(spark, d, "products").select("seq", (F.col("seq") % 3 == 0).alias("has_identity"))
    return signals.doc_gaps(t1(spark, d).select("seq", "signal"), known).select("seq", F.array_join("missing", ",").alias("missing"), F.array_join("warnings", ",").alias("warnings"))


@query("U6_outbound_product", """WITH h AS (SELECT page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']+)["'']', 1)) AS a FROM {pages}),
l AS (SELECT page_id, list_distinct(list(concat(root, split_part(a, '#', 1)))) AS f FROM h WHERE contains(split_part(split_part(a, '#', 1), '?', 1), '/T') GROUP BY page_id)
SELECT p.page_id, CAST(coalesce(len(f), 0) AS INT) AS candidates, CASE WHEN len(f) = 1 THEN f[1] END AS product_url FROM {pages} p LEFT JOIN l ON l.page_id = p.page_id""")
def u6_outbound(spark: SparkSession, d: str) -> DataFrame:
    """The pages link to paths of their own hosts only, so any host will do."""
    return pages.outbound_product(view(spark, d, "pages"), (), "/T")


@query("F20_route_articles", """SELECT doc_id, CASE WHEN a > 0 AND NOT (s > 0 AND abs(a - s) < 15) THEN CASE WHEN a >= s THEN 'generic_article' ELSE 'social_post' END WHEN s > 0 AND a = 0 THEN 'social_post' END AS shape, greatest(a, s) / 100 AS confidence, a > 0 AND s > 0 AND abs(a - s) < 15 AS ambiguous
FROM (SELECT doc_id, CASE WHEN title IS NOT NULL AND coalesce(text, '') <> '' AND platform IS NULL THEN least(90, 50 + 8 * (2 + CASE WHEN source <> '' THEN 1 ELSE 0 END)) ELSE 0 END AS a, CASE WHEN platform IS NOT NULL AND coalesce(text, '') <> '' THEN 65 ELSE 0 END AS s
FROM (SELECT doc_id, text, source, CASE WHEN doc_id % 3 > 0 THEN lang END AS title, CASE WHEN doc_id % 5 = 0 THEN 'forum' END AS platform FROM {documents}))""")
def f20_articles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    records = view(spark, d, "documents").select("doc_id", "text", F.col("text").alias("body"), F.col("source").alias("source_name"), F.when(k % 3 > 0, F.col("lang")).alias("title"), F.when(k % 5 == 0, "forum").alias("platform"))
    return routing.route_payloads(records).select("doc_id", "shape", "confidence", "ambiguous")
