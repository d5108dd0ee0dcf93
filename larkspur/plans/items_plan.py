"""Registered queries over items, quotes, decisions and boards, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scores as S
from larkspur.functions import text as T
from larkspur.operators import boards, items, market
from larkspur.plans.views import plain, view
from larkspur.sources.tables import few

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL (names of tables and views in braces)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = plain(sql)
        return f

    return add


R2 = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
_avail = "replace(replace(replace(lower(trim(coalesce(availability, ''))), '_', ''), '-', ''), ' ', '')"


def _nt(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce(CAST({x} AS VARCHAR), '')), '[^\\pL\\pN]+', ' ', 'g'))"


@query("F1_norm_text", f"SELECT seq, {_nt('text')} AS unicode_key, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS ascii_key FROM {{texts}}")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "texts").select("seq", T.norm_text(F.col("text")).alias("unicode_key"), T.norm_title(F.col("text")).alias("ascii_key"))


@query(
    "F2_identity_tokens",
    """SELECT seq, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')), ' '),
    lambda w: length(w) >= 3 AND NOT list_contains(['pokemon','the','a','an','new','official','trading','card','game','tcg','product','with','and','edition'], w)))), ' ') AS tokens FROM {products}""",
)
def f2(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "products").select("seq", F.array_join(T.identity_tokens(F.col("title")), " ").alias("tokens"))


@query(
    "F3_codes",
    """SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(sku)), '[\\s_]+', '-', 'g'), '[^a-z0-9-]+', '', 'g'), '-+', '-', 'g'), '-') AS sku_key,
    regexp_replace(replace(upper(trim(coalesce(codes, ''))), ' ', '-'), '-+', '-', 'g') AS code_key FROM {products}""",
)
def f3(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "products").select("seq", T.norm_sku(F.col("sku")).alias("sku_key"), T.norm_code(F.col("codes")).alias("code_key"))


@query(
    "F4_norm_url",
    """SELECT seq, coalesce(regexp_matches(trim(url), '^(?i)https?://[^/?#]+'), false) AS valid,
    CASE WHEN coalesce(regexp_matches(trim(url), '^(?i)https?://[^/?#]+'), false) THEN concat(lower(regexp_extract(trim(url), '^([^:]+://[^/?#]*)', 1)), regexp_extract(trim(url), '^[^:]+://[^/?#]*([^#]*)', 1)) ELSE url END AS url,
    regexp_replace(split_part(lower(trim(coalesce(url, ''))), '#', 1), '/+$', '') AS url_key FROM {dirty}""",
)
def f4(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return view(spark, d, "dirty").select("seq", T.url_valid(u).alias("valid"), T.norm_url(u).alias("url"), T.url_key(u).alias("url_key"))


@query(
    "F5_availability",
    f"""SELECT seq, {_avail} AS availability, CASE WHEN {_avail} IN ('instock','available','preorder','preorderonly','availablefororder') THEN 'available'
    WHEN {_avail} IN ('soldout','outofstock','unavailable','discontinued','preorderclosed') THEN 'unavailable' ELSE 'unknown' END AS availability_class FROM {{products}}""",
)
def f5(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("availability")
    return view(spark, d, "products").select("seq", T.norm_availability(a).alias("availability"), T.availability_class(a).alias("availability_class"))


_DEC = "TRY_CAST(regexp_replace(amount, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


@query(
    "F6_lenient_values",
    f"""SELECT seq, {_DEC} AS amount, CASE WHEN round_even({_DEC}, 0) >= 0 THEN CAST(round_even({_DEC}, 0) AS BIGINT) END AS quantity,
    CASE WHEN lower(trim(flag)) IN ('true','yes','y','1','sold','active','confirmed','verified') THEN true WHEN lower(trim(flag)) IN ('false','no','n','0','unsold','inactive','unconfirmed','unverified') THEN false END AS flag,
    CASE WHEN coalesce(currency, '') = '' THEN NULL WHEN currency = '$' THEN 'USD' ELSE upper(trim(currency)) END AS currency FROM {{dirty}}""",
)
def f6(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "dirty").select("seq", T.parse_decimal(F.col("amount")).alias("amount"), T.parse_quantity(F.col("amount")).alias("quantity"), T.parse_bool(F.col("flag")).alias("flag"), T.norm_currency(F.col("currency")).alias("currency"))


@query(
    "F7_parse_stamp",
    """SELECT seq, strftime(coalesce(try_strptime(trim(stamp), '%Y-%m-%dT%H:%M:%SZ'), try_strptime(trim(stamp), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(stamp), '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') AS parsed,
    coalesce(stamp, '') <> '' AND coalesce(try_strptime(trim(stamp), '%Y-%m-%dT%H:%M:%SZ'), try_strptime(trim(stamp), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(stamp), '%Y-%m-%d')) IS NULL AS invalid FROM {dirty}""",
)
def f7(spark: SparkSession, d: str) -> DataFrame:
    p = T.parse_ts(F.col("stamp"))
    return view(spark, d, "dirty").select("seq", F.date_format(p, "yyyy-MM-dd HH:mm:ss").alias("parsed"), ((F.coalesce("stamp", F.lit("")) != "") & p.isNull()).alias("invalid"))


@query(
    "F8_canonical_types",
    """SELECT seq, CASE WHEN coalesce(source_type, '') = '' THEN NULL WHEN upper(trim(source_type)) IN ('OFFICIAL','RETAILER','PRESS_RELEASE','SOCIAL','COMMUNITY','MARKETPLACE','NEWS','EVENT','OTHER') THEN upper(trim(source_type))
    WHEN lower(trim(source_type)) = 'press release' THEN 'PRESS_RELEASE' WHEN lower(trim(source_type)) = 'forum' THEN 'COMMUNITY' WHEN lower(trim(source_type)) = 'convention' THEN 'EVENT' ELSE trim(source_type) END AS source_type FROM {dirty}""",
)
def f8(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "dirty").select("seq", T.canon(F.col("source_type"), T.SOURCE_ALIASES, T.SOURCE_TYPES).alias("source_type"))


_W = {"red": 18, "small": 14, "widget": 10, "ring": 22, "large": -25, "economy": 12, "promo": 16}
_pts = " + ".join(f"CASE WHEN contains(lower(t), '{k}') THEN {v} ELSE 0 END" for k, v in _W.items())


@query("F10_term_score", f"SELECT seq, CAST({_pts} AS INT) AS points, array_to_string(list_filter({list(_W)}, lambda k: contains(lower(t), k)), ',') AS hits FROM (SELECT seq, concat(title, ' ', description) AS t FROM {{products}})")
def f10(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws(" ", "title", "description")
    return view(spark, d, "products").select("seq", S.term_points(t, _W).alias("points"), F.array_join(S.hits(t, list(_W)), ",").alias("hits"))


@query("F14_admit_drops", "SELECT seq, title FROM {dated_items} WHERE coalesce(release_date >= DATE '2024-01-01' - INTERVAL 30 DAY, false) OR contains(lower(title), 'small') OR contains(lower(title), 'promo')")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return items.admit_drops(view(spark, d, "dated_items"), "title", "release_date", F.lit("2024-01-01").cast("timestamp"), 30, ("small", "promo")).select("seq", "title")


@query("F15_buckets", "SELECT seq, CASE WHEN collector_score >= 85 THEN 'CRITICAL' WHEN collector_score >= 70 THEN 'HIGH' WHEN collector_score >= 55 THEN 'MEDIUM' ELSE 'WATCH' END AS tier, CASE WHEN popularity_score >= 95 THEN 'CRITICAL' WHEN popularity_score >= 85 THEN 'HIGH' WHEN popularity_score >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS notice FROM {products}")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "products").select("seq", S.bucket(F.col("collector_score"), S.TIERS, "WATCH").alias("tier"), S.bucket(F.col("popularity_score"), S.NOTICE_LEVELS, "LOW").alias("notice"))


@query(
    "F16_first_keyword",
    """SELECT seq, coalesce(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: trim(w, ',.!?()[]')), lambda w: length(w) >= 4 AND NOT list_contains(['the','and','new','official','available','coming','soon'], w))[1], 'general') AS keyword FROM {texts}""",
)
def f16(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "texts").select("seq", T.first_keyword(F.col("text")).alias("keyword"))


@query(
    "F17_enrich_context",
    """SELECT seq, CASE WHEN contains(t, 'large') THEN 'Shop L' WHEN contains(t, 'widget') THEN 'Shop W' WHEN contains(t, 'small') THEN 'Shop S' ELSE 'Unknown' END AS retailer,
    CASE WHEN contains(t, 'large') THEN 'Big' WHEN contains(t, 'widget') THEN 'Tool' WHEN contains(t, 'small') THEN 'Tiny' ELSE 'Collectible' END AS category FROM (SELECT seq, lower(concat(brand, ' ', title)) AS t FROM {products})""",
)
def f17(spark: SparkSession, d: str) -> DataFrame:
    found = items.enrich_context(F.concat_ws(" ", "brand", "title"), (("small", "Shop S", "Tiny"), ("widget", "Shop W", "Tool"), ("large", "Shop L", "Big")))
    return view(spark, d, "products").select("seq", found["retailer"].alias("retailer"), found["category"].alias("category"))


@query(
    "F18_validate",
    f"""SELECT seq, array_to_string(list_filter([CASE WHEN coalesce(amount, '') = '' THEN 'amount_missing' END, CASE WHEN {_DEC} < 0 THEN 'amount_negative' END, CASE WHEN coalesce(url, '') <> '' AND NOT regexp_matches(trim(url), '^(?i)https?://[^/?#]+') THEN 'url_invalid' END,
    CASE WHEN coalesce(currency, '') <> '' AND upper(trim(currency)) NOT IN ('USD','EUR','GBP','JPY','CAD','AUD') AND currency <> '$' THEN 'currency_unknown' END], lambda x: x IS NOT NULL), ',') AS issues FROM {{dirty}}""",
)
def f18(spark: SparkSession, d: str) -> DataFrame:
    amount = T.parse_decimal(F.col("amount"))
    rules = {
        "amount_missing": F.coalesce("amount", F.lit("")) != "",
        "amount_negative": amount >= 0,
        "url_invalid": (F.coalesce("url", F.lit("")) == "") | T.url_valid(F.col("url")),
        "currency_unknown": T.norm_currency(F.col("currency")).isin(*T.CURRENCIES),
    }
    return view(spark, d, "dirty").select("seq", F.array_join(items.check_rules(rules), ",").alias("issues"))


@query(
    "F19_constraint_counts",
    """SELECT rule, count(*) AS violations FROM (SELECT unnest(list_filter([CASE WHEN score > 90 THEN 'score_range' END, CASE WHEN status NOT IN ('RUMORED','ANNOUNCED','LIVE') THEN 'status_enum' END, CASE WHEN sold_price < 0.01 THEN 'sold_positive' END], lambda x: x IS NOT NULL)) AS rule FROM {opportunities}) GROUP BY rule""",
)
def f19(spark: SparkSession, d: str) -> DataFrame:
    rules = {"score_range": F.col("score") <= 90, "status_enum": F.col("status").isin("RUMORED", "ANNOUNCED", "LIVE"), "sold_positive": F.col("sold_price") >= 0.01}
    return view(spark, d, "opportunities").select(F.explode(items.check_rules(rules)).alias("rule")).groupBy("rule").agg(F.count("*").alias("violations"))


@query("F22_money", f"SELECT seq, coalesce(sold_price, market_price, estimated_price) AS resale, {R2('coalesce(sold_price, market_price, estimated_price) - required_spend')} AS profit, CASE WHEN required_spend > 0 THEN {R2('(coalesce(sold_price, market_price, estimated_price) - required_spend) / required_spend * 100')} END AS roi_percent FROM {{opportunities}}")
def f22(spark: SparkSession, d: str) -> DataFrame:
    m = items.money_columns(F.col("required_spend"), F.col("sold_price"), F.col("market_price"), F.col("estimated_price"))
    return view(spark, d, "opportunities").select("seq", *(v.alias(k) for k, v in m.items()))


_A3 = """SELECT item_id, count(*) AS providers, count(average_cents) AS providers_with_data, floor(sum(average_cents) / count(average_cents) + 0.5) / 100 AS average_price, min(CASE WHEN average_cents IS NOT NULL THEN lowest_cents END) / 100 AS lowest_price,
max(CASE WHEN average_cents IS NOT NULL THEN highest_cents END) / 100 AS highest_price, CAST(coalesce(sum(CASE WHEN average_cents IS NOT NULL THEN sold_count END), 0) AS BIGINT) AS sold_count, CASE WHEN count(average_cents) = 0 THEN 'UNKNOWN' WHEN count(average_cents) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM {quotes} GROUP BY item_id"""


@query("A3_aggregate_quotes", _A3)
def a3(spark: SparkSession, d: str) -> DataFrame:
    return market.aggregate_quotes(view(spark, d, "quotes"), "item_id")


_F23 = f"""SELECT p.seq AS item_id, {R2('q.average_price * 0.13')} AS fees, {R2('8.0')} AS shipping, {R2('q.average_price - q.average_price * 0.13 - 8.0')} AS net_revenue, {R2('q.average_price - q.average_price * 0.13 - 8.0 - p.retail_price')} AS profit,
{R2('(q.average_price - q.average_price * 0.13 - 8.0 - p.retail_price) / p.retail_price * 100')} AS roi FROM {{products}} p JOIN q ON p.seq = q.item_id WHERE p.retail_price IS NOT NULL AND q.average_price IS NOT NULL"""


@query("F23_roi", f"WITH q AS ({_A3}) {_F23}")
def f23(spark: SparkSession, d: str) -> DataFrame:
    q = market.aggregate_quotes(view(spark, d, "quotes"), "item_id")
    r = items.roi_columns(F.col("retail_price"), F.col("average_price"))
    joined = view(spark, d, "products").select(F.col("seq").alias("item_id"), "retail_price").join(q, "item_id").where("retail_price is not null and average_price is not null")
    return joined.select("item_id", *(v.alias(k) for k, v in r.items()))


@query("F24_realized_roi", f"SELECT seq, {R2('sold_price - required_spend')} AS total_profit, {R2('(sold_price - required_spend) / required_spend * 100')} AS roi_percent, CASE WHEN sold_price IS NOT NULL AND required_spend IS NOT NULL THEN 'verified' END AS learning_status FROM {{opportunities}}")
def f24(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "opportunities").withColumns({"ship": F.lit(0), "fees": F.lit(0)})
    return items.realized_roi(o, "required_spend", "sold_price", "ship", "fees").select("seq", "total_profit", "roi_percent", "learning_status")


@query("F25_comps_link", "SELECT seq, concat('https://www.ebay.com/sch/i.html?_nkw=', replace(replace(trim(concat(brand, ' ', title)), '#', '%23'), ' ', '+'), '&LH_Sold=1&LH_Complete=1') AS link FROM {products}")
def f25(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "products").select("seq", items.comps_link(F.col("brand"), F.col("title")).alias("link"))


@query(
    "F27_relative_age",
    """SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago') ELSE concat(s // 86400, 'd ago') END AS age
    FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2024-03-01 00:00:00') - floor(epoch(ts)) AS BIGINT) AS s FROM {events}) WHERE s >= 0""",
)
def f27(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    return view(spark, d, "events").where(F.unix_timestamp("ts") <= F.unix_timestamp(now)).select("event_id", items.relative_age(F.col("ts"), now).alias("age"))


_KEY = """CASE WHEN coalesce(sku, '') <> '' THEN concat(category, ':sku:', regexp_replace(replace(upper(trim(sku)), ' ', '-'), '-+', '-', 'g'))
WHEN codes IS NOT NULL THEN concat(category, ':codes:', array_to_string(list_sort(list_distinct(list_transform(string_split(codes, ','), lambda c: regexp_replace(replace(upper(trim(c)), ' ', '-'), '-+', '-', 'g')))), '|'), ':', lower(coalesce(product_type, 'other')))
WHEN coalesce(url, '') <> '' THEN concat(category, ':url:', regexp_replace(split_part(lower(trim(url)), '#', 1), '/+$', '')) ELSE concat(category, ':title:', trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) END"""


def keyed(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "products")
    return p.withColumn("product_key", items.product_key(F.col("category"), F.col("sku"), F.split("codes", ","), F.col("product_type"), F.col("url"), F.col("title")))


@query("J1_product_key", f"SELECT seq, {_KEY} AS product_key FROM {{products}}")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).select("seq", "product_key")


@query("J2_dedup_key", f"SELECT seq, concat_ws('|', {_nt('brand')}, {_nt('franchise')}, {_nt('product_name')}, {_nt('collaboration_partner')}, {_nt('substr(release_date, 1, 10)')}, {_nt('retailer')}) AS dedup_key FROM {{opportunities}}")
def j2(spark: SparkSession, d: str) -> DataFrame:
    cols = ("brand", "franchise", "product_name", "collaboration_partner", "release_date", "retailer")
    return view(spark, d, "opportunities").select("seq", items.dedup_key(*(F.col(c) for c in cols)).alias("dedup_key"))


@query("J9_only_new", "SELECT opportunity_id, product_name FROM {opportunities_new} n WHERE NOT EXISTS (SELECT 1 FROM {opportunities} o WHERE o.opportunity_id = n.opportunity_id)")
def j9(spark: SparkSession, d: str) -> DataFrame:
    new, old = view(spark, d, "opportunities_new"), view(spark, d, "opportunities")
    return new.join(old.select("opportunity_id").distinct(), "opportunity_id", "left_anti").select("opportunity_id", "product_name")


@query("J10_pending_notifications", "SELECT n.opportunity_id, n.score, o.product_name FROM (SELECT opportunity_id, score, seq FROM {opportunities_new} WHERE score >= 70 AND status <> 'SOLD OUT') n LEFT JOIN {opportunities} o ON o.opportunity_id = n.opportunity_id ORDER BY n.seq DESC LIMIT 20")
def j10(spark: SparkSession, d: str) -> DataFrame:
    waiting = view(spark, d, "opportunities_new").where("score >= 70 and status <> 'SOLD OUT'").select("opportunity_id", "score", "seq")
    known = view(spark, d, "opportunities").select("opportunity_id", "product_name")
    return waiting.orderBy(F.desc("seq")).limit(20).join(known, "opportunity_id", "left").select("opportunity_id", "score", "product_name")


_PATTERNS = (("gadgets", "standard", ("widget", "gadget"), 80.0), ("reds", "economy", ("red", "promo"), 45.5), ("rings", "promo", ("ring",), None), ("small rings", "small", ("small ring", "exclusive promo"), 20.0))


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, c, list(k), r) for n, c, k, r in _PATTERNS], "name string, category string, keywords array<string>, historical_roi double")


_pat = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', [{', '.join(repr(x) for x in k)}], {'NULL' if r is None else r})" for n, c, k, r in _PATTERNS) + ") v(name, category, keywords, historical_roi)"
_J11 = f"""m AS (SELECT item_id, name, historical_roi, CAST(s AS BIGINT) AS strength FROM (SELECT i.seq AS item_id, p.name, p.historical_roi, len(list_filter(p.keywords, lambda k: contains(lower(i.t), k))) + CASE WHEN p.category = i.category THEN 1 ELSE 0 END AS s
FROM (SELECT seq, concat(title, ' ', description) AS t, category FROM {{products}}) i, ({_pat}) p) WHERE s > 0)"""


@query("J11_match_patterns", f"WITH {_J11} SELECT item_id, name, strength FROM m")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("item_id", "name", "strength")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "products").select(F.col("seq").alias("item_id"), F.concat_ws(" ", "title", "description").alias("text"), "category")
    return market.match_patterns(p, _patterns(spark))


@query("A4_pattern_score", f"WITH {_J11} SELECT item_id, coalesce({R2('sum(historical_roi * strength) / sum(CASE WHEN historical_roi IS NOT NULL THEN strength END)')}, 0) AS pattern_score, CASE WHEN sum(historical_roi * strength) / sum(CASE WHEN historical_roi IS NOT NULL THEN strength END) >= 70 THEN 'VERY HIGH' WHEN sum(historical_roi * strength) / sum(CASE WHEN historical_roi IS NOT NULL THEN strength END) >= 50 THEN 'HIGH' WHEN sum(historical_roi * strength) / sum(CASE WHEN historical_roi IS NOT NULL THEN strength END) >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, count(*) AS match_count FROM m GROUP BY item_id")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return market.pattern_score(_matches(spark, d))


@query("J12_route_providers", "SELECT item_id, position, provider FROM (SELECT seq AS item_id, unnest(l) AS provider, unnest(range(len(l))) AS position FROM (SELECT seq, CASE WHEN contains(lower(brand), 'brand#1') THEN ['manual', 'ebay'] ELSE ['manual', 'ebay'] END AS l FROM {products}))")
def j12(spark: SparkSession, d: str) -> DataFrame:
    return market.route_providers(view(spark, d, "products").withColumn("item_id", F.col("seq")), ("manual", "ebay", "stockx"))


_A1 = f"""SELECT coalesce(category, 'general') AS category, coalesce(brand, 'Unknown') AS brand, count(*) AS total_records, count(roi_cents) AS records_with_roi, count(profit_cents) AS records_with_profit, floor(sum(roi_cents) / count(roi_cents) + 0.5) / 100 AS average_roi,
floor(sum(profit_cents) / count(profit_cents) + 0.5) / 100 AS average_profit, floor(sum(market_cents) / count(market_cents) + 0.5) / 100 AS average_market_price, {R2('sum(score) / count(*)')} AS average_score, count(*) FILTER (profit_cents > 0) AS profitable_count,
CASE WHEN count(profit_cents) > 0 THEN {R2('count(*) FILTER (profit_cents > 0) / count(profit_cents) * 100')} END AS profitable_rate, count(*) FILTER (coalesce(decision, 'WATCH') = 'BUY') AS buy_count, count(*) FILTER (coalesce(decision, 'WATCH') = 'STRONG WATCH') AS strong_watch_count,
count(*) FILTER (coalesce(decision, 'WATCH') = 'WATCH') AS watch_count, count(*) FILTER (coalesce(decision, 'WATCH') = 'SKIP') AS skip_count, {R2("count(*) FILTER (coalesce(decision, 'WATCH') = 'BUY') / count(*) * 100")} AS buy_rate,
CASE WHEN count(*) >= 25 THEN 'VERY HIGH' WHEN count(*) >= 10 THEN 'HIGH' WHEN count(*) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM {{decision_log}} GROUP BY 1, 2"""


@query("A1_learning_summary", _A1)
def a1(spark: SparkSession, d: str) -> DataFrame:
    return market.learning_summary(view(spark, d, "decision_log"))


@query("A2_summary_for", f"WITH s AS ({_A1}), w AS (SELECT DISTINCT c_mktsegment AS category, concat('brand ', n_nationkey + 3) AS brand FROM {{customer}}, {{nation}}) SELECT w.category, w.brand, coalesce(total_records, 0) AS total_records, coalesce(buy_count, 0) AS buy_count, coalesce(confidence, 'LOW') AS confidence, average_roi, average_profit FROM w LEFT JOIN s ON s.category = w.category AND s.brand = w.brand")
def a2(spark: SparkSession, d: str) -> DataFrame:
    segments = view(spark, d, "customer").select(F.col("c_mktsegment").alias("category")).distinct()
    brands = view(spark, d, "nation").select(F.concat(F.lit("brand "), (F.col("n_nationkey") + 3).cast("string")).alias("brand")).distinct()
    wanted = segments.crossJoin(few(brands, 1000))  # the asked pairs: a few segments and brands
    return market.summary_for(market.learning_summary(view(spark, d, "decision_log")), wanted)


@query("A5_brand_memory", """SELECT *, concat_ws(',', CASE WHEN promo_count >= 3 THEN 'promo_rising' END, CASE WHEN exclusive_count >= 2 THEN 'exclusives_frequent' END, CASE WHEN watch_count > buy_count THEN 'mostly_watch' END, CASE WHEN total_items_seen >= 10 THEN 'enough_observations' END) AS observations
FROM (SELECT brand, count(*) AS total_items_seen, count(*) FILTER (contains(lower(description), 'promo')) AS promo_count, count(*) FILTER (contains(lower(description), 'exclusive')) AS exclusive_count, count(*) FILTER (collector_score < 50) AS watch_count, count(*) FILTER (collector_score >= 80) AS buy_count FROM {products} GROUP BY brand)""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "products").withColumn("act", F.when(F.col("collector_score") < 50, "watch").when(F.col("collector_score") >= 80, "Buy"))
    return market.brand_memory(p, "description", "act")


@query("A6_scan_summary", f"""SELECT product_type, count(*) FILTER (a IN ('instock','available','availablefororder')) AS in_stock_count, count(*) FILTER (a IN ('outofstock','soldout','unavailable','discontinued')) AS out_of_stock_count, count(*) FILTER (a IN ('preorder','preorderonly','comingsoon')) AS preorder_count,
count(*) FILTER (a NOT IN ('instock','available','availablefororder','outofstock','soldout','unavailable','discontinued','preorder','preorderonly','comingsoon')) AS unknown_count, count(retail_price) AS known_price_count, count(*) FILTER (limited_release) AS exclusive_count
FROM (SELECT *, {_avail} AS a FROM (SELECT coalesce(product_type, 'other') AS product_type, retail_price, limited_release, availability FROM {{products}})) GROUP BY product_type""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "products").withColumn("product_type", F.coalesce("product_type", F.lit("other")))
    return market.scan_summary(p, "product_type")


_DW = {"red": 18, "small": 14, "widget": 22, "exclusive": 18}
_DB = {"large": -30, "economy": -20}
_dp = " + ".join(f"CASE WHEN contains(t, '{k}') THEN {v} ELSE 0 END" for k, v in (_DW | _DB).items())


@query(
    "A23_score_drops",
    f"""SELECT seq, score, CASE WHEN score >= 90 THEN 'CRITICAL' WHEN score >= 75 THEN 'HIGH' WHEN score >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN score >= 90 THEN 'BUY IMMEDIATELY' WHEN score >= 75 THEN 'BUY IF AVAILABLE' WHEN score >= 55 THEN 'BUY IF CONVENIENT' ELSE 'WATCH ONLY' END AS action, urgency, resale,
    concat_ws(', ', CASE WHEN contains(t, 'red') THEN '+ red' END, CASE WHEN contains(t, 'small') THEN '+ small' END, CASE WHEN contains(t, 'widget') THEN '+ widget' END, CASE WHEN contains(t, 'exclusive') THEN '+ exclusive' END, CASE WHEN contains(t, 'large') THEN '- large' END, CASE WHEN contains(t, 'economy') THEN '- economy' END) AS hits
    FROM (SELECT seq, t, CAST(greatest(0, least(100, 35 + {_dp})) AS INT) AS score, CASE WHEN contains(t, 'exclusive') THEN 50 ELSE 30 END AS urgency, CASE WHEN contains(t, 'exclusive') THEN 45 ELSE 30 END AS resale FROM (SELECT seq, lower(concat(brand, ' ', title, ' ', description)) AS t FROM {{products}})) WHERE score >= 55""",
)
def a23(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws(" ", "brand", "title", "description")
    return items.score_drops(view(spark, d, "products"), t, _DW, _DB).select("seq", "score", "level", "action", "urgency", "resale", "hits")


@query(
    "A24_decide",
    f"""SELECT seq, CASE WHEN roi IS NOT NULL THEN CASE WHEN profit <= 0 OR roi <= 0 THEN 'SKIP' WHEN risk THEN 'WATCH' WHEN roi >= 60 AND score >= 70 THEN 'BUY' WHEN roi >= 35 AND score >= 60 THEN 'STRONG WATCH' WHEN roi >= 15 THEN 'WATCH' ELSE 'SKIP' END
    WHEN risk THEN 'WATCH' WHEN score >= 90 THEN 'BUY' WHEN score >= 70 THEN 'STRONG WATCH' ELSE 'WATCH' END AS action, CASE WHEN score >= 90 AND patterns >= 1 THEN 'VERY HIGH' WHEN score >= 75 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
    FROM (SELECT seq, score, seq % 5 = 1 AS risk, seq % 2 AS patterns, {R2('coalesce(sold_price, market_price, estimated_price) - required_spend')} AS profit, CASE WHEN required_spend > 0 THEN {R2('(coalesce(sold_price, market_price, estimated_price) - required_spend) / required_spend * 100')} END AS roi FROM {{opportunities}})""",
)
def a24(spark: SparkSession, d: str) -> DataFrame:
    m = items.money_columns(F.col("required_spend"), F.col("sold_price"), F.col("market_price"), F.col("estimated_price"))
    x = items.decision(F.col("score"), F.col("seq") % 5 == 1, F.col("seq") % 2, m["profit"], m["roi_percent"])
    return view(spark, d, "opportunities").select("seq", x["action"].alias("action"), x["confidence"].alias("confidence"))


_Z = lambda c: f"coalesce({c}, 0)"
_STRAT = f"""st AS (SELECT *, CASE WHEN flip_score >= hold_score AND flip_score >= sleeper_score THEN 'QUICK FLIP' WHEN hold_score >= sleeper_score THEN 'LONG-TERM HOLD' ELSE 'SLEEPER' END AS strategy, greatest(flip_score, hold_score, sleeper_score) AS strategy_score FROM {{products}}),
sc AS (SELECT *, CAST(greatest(0, least(100, round_even(0.0 + strategy_score * 0.30 + collector_score * 0.22 + hold_score * 0.16 + flip_score * 0.16 + coalesce(popularity_score, 0.0) * 0.10 + sleeper_score * 0.06
 + (CASE WHEN limited_release THEN 5 ELSE 0 END + CASE WHEN promo_included THEN 4 ELSE 0 END + CASE WHEN collector_variant THEN 4 ELSE 0 END + CASE WHEN sealed_product THEN 3 ELSE 0 END + CASE WHEN {_avail} IN ('soldout','outofstock','unavailable') THEN 4 ELSE 0 END), 0))) AS INT) AS opportunity_score FROM st),
bd AS (SELECT *, CASE WHEN opportunity_score >= 85 THEN 'CRITICAL' WHEN opportunity_score >= 70 THEN 'HIGH' WHEN opportunity_score >= 55 THEN 'MEDIUM' ELSE 'WATCH' END AS opportunity_tier,
 CASE WHEN opportunity_score >= 85 THEN CASE strategy WHEN 'QUICK FLIP' THEN 'BUY QUICKLY IF MARGIN IS CONFIRMED' WHEN 'LONG-TERM HOLD' THEN 'PRIORITIZE FOR HOLD' ELSE 'RESEARCH IMMEDIATELY' END WHEN opportunity_score >= 70 THEN CASE strategy WHEN 'QUICK FLIP' THEN 'CHECK STOCK AND MARKET PRICE' WHEN 'LONG-TERM HOLD' THEN 'CONSIDER BUYING FOR HOLD' ELSE 'ADD TO HIGH-PRIORITY WATCHLIST' END
 WHEN opportunity_score >= 55 THEN 'MONITOR PRICE AND AVAILABILITY' ELSE 'LOW-PRIORITY WATCH' END AS recommended_action FROM sc)"""
_ORD = "opportunity_score DESC, collector_score DESC, hold_score DESC, flip_score DESC, seq"


def board_items(spark: SparkSession, d: str) -> DataFrame:
    return boards.best_strategy(view(spark, d, "products"))


@query("A21_item_scores", f"WITH {_STRAT} SELECT seq, strategy, strategy_score, opportunity_score, opportunity_tier, recommended_action FROM bd")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return boards.score_items(board_items(spark, d)).select("seq", "strategy", "strategy_score", "opportunity_score", "opportunity_tier", "recommended_action")


@query("W1_money_board", f"WITH {_STRAT} SELECT row_number() OVER (ORDER BY {_ORD}) AS overall_rank, seq, title, opportunity_score, opportunity_tier, recommended_action FROM bd ORDER BY {_ORD} LIMIT 20")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return boards.money_board(board_items(spark, d)).select("overall_rank", "seq", "title", "opportunity_score", "opportunity_tier", "recommended_action")


@query("W1_top_flips", f"WITH {_STRAT} SELECT seq, title, flip_score FROM bd ORDER BY flip_score DESC, opportunity_score DESC, seq LIMIT 10")
def w1f(spark: SparkSession, d: str) -> DataFrame:
    return boards.top_by_score(board_items(spark, d), "flip_score").select("seq", "title", "flip_score")


@query("W2_top_per_category", f"WITH {_STRAT}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_ORD}) AS category_rank FROM bd) SELECT category, category_rank, seq, opportunity_score FROM r WHERE category_rank <= 20")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return boards.top_per_category(board_items(spark, d)).select("category", "category_rank", "seq", "opportunity_score")


@query("W3_catalog_top", f"WITH {_STRAT} SELECT seq, title, strategy_score FROM st WHERE category = 'promo' ORDER BY strategy_score DESC, collector_score DESC, hold_score DESC, flip_score DESC, coalesce(popularity_score, 0) DESC, seq LIMIT 20")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return boards.catalog_top(board_items(spark, d), 20, "Promo ").select("seq", "title", "strategy_score")


@query("W4_rank_opportunities", f"""SELECT seq, decision, roi, score FROM (SELECT seq, score, CASE seq % 5 WHEN 0 THEN 'BUY' WHEN 1 THEN 'WATCH' WHEN 2 THEN 'STRONG WATCH' WHEN 3 THEN 'SKIP' END AS decision, CASE WHEN seq % 3 = 0 THEN 'HIGH' WHEN seq % 3 = 1 THEN 'LOW' END AS confidence,
CASE WHEN required_spend > 0 THEN {R2('(coalesce(sold_price, market_price, estimated_price) - required_spend) / required_spend * 100')} END AS roi, {R2('coalesce(sold_price, market_price, estimated_price) - required_spend')} AS profit FROM {{opportunities}})
ORDER BY CASE coalesce(decision, 'WATCH') WHEN 'BUY' THEN 4 WHEN 'STRONG WATCH' THEN 3 WHEN 'WATCH' THEN 2 ELSE 1 END DESC, coalesce(roi, -999) DESC, coalesce(profit, -999) DESC, CASE confidence WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END DESC, score DESC, seq LIMIT 10""")
def w4(spark: SparkSession, d: str) -> DataFrame:
    m = items.money_columns(F.col("required_spend"), F.col("sold_price"), F.col("market_price"), F.col("estimated_price"))
    s = F.col("seq")
    o = view(spark, d, "opportunities").select("seq", "score", F.when(s % 5 == 0, "BUY").when(s % 5 == 1, "WATCH").when(s % 5 == 2, "STRONG WATCH").when(s % 5 == 3, "SKIP").alias("decision"), F.when(s % 3 == 0, "HIGH").when(s % 3 == 1, "LOW").alias("confidence"), F.lit(None).cast("string").alias("urgency"), m["roi_percent"].alias("roi"), m["profit"].alias("profit"))
    return boards.rank_opportunities(o).select("seq", "decision", "roi", "score")


@query("W9_best_candidate", "SELECT brand, seq, title FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN coalesce(release_date >= DATE '2023-12-02', false) OR contains(lower(title), 'small') THEN 0 ELSE 1 END, seq) AS r FROM {dated_items}) WHERE r = 1")
def w9(spark: SparkSession, d: str) -> DataFrame:
    good = (F.col("release_date") >= F.lit("2023-12-02").cast("date")) | F.contains(F.lower("title"), F.lit("small"))
    return boards.best_candidate(view(spark, d, "dated_items"), "brand", good).select("brand", "seq", "title")


def best_opportunities(spark: SparkSession, d: str) -> DataFrame:
    """Which products are the best opportunities now: items with the return that their quotes promise, best first."""
    q = market.aggregate_quotes(view(spark, d, "quotes"), "item_id").withColumnRenamed("item_id", "seq")
    r = items.roi_columns(F.col("retail_price"), F.col("average_price"))
    priced = board_items(spark, d).join(q.select("seq", "average_price", "confidence"), "seq").withColumns({"profit": r["profit"], "roi": r["roi"]}).where("roi is not null")
    return boards.money_board(priced).select("overall_rank", "seq", "title", "opportunity_score", "average_price", "profit", "roi", "confidence")


query("best_opportunities", f"WITH {_STRAT}, q AS ({_A3}), j AS (SELECT bd.*, q.average_price, q.confidence, {R2('q.average_price - q.average_price * 0.13 - 8.0 - bd.retail_price')} AS profit, {R2('(q.average_price - q.average_price * 0.13 - 8.0 - bd.retail_price) / bd.retail_price * 100')} AS roi FROM bd JOIN q ON q.item_id = bd.seq WHERE bd.retail_price IS NOT NULL AND q.average_price IS NOT NULL) SELECT row_number() OVER (ORDER BY {_ORD}) AS overall_rank, seq, title, opportunity_score, average_price, profit, roi, confidence FROM j ORDER BY {_ORD} LIMIT 20")(best_opportunities)
