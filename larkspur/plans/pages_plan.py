"""Registered queries over pages, texts, registries and cards, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import boards, cards, items, judgement, objects, pages, registry, signals
from larkspur.plans.items_plan import _STRAT, _nt, board_items
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


def _visible(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({bare}, '(?s)<[^>]*>', ' ', 'g')"
    for name, sign in pages.ENTITIES:
        quoted = sign.replace("'", "''")
        out = f"replace({out}, '{name}', '{quoted}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("S7_extract_pages", f"""SELECT page_id, nullif({_visible("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")}, '') AS title, nullif({_visible("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1\\s*>', 1)")}, '') AS h1, sha256({_visible('html')}) AS body_sha256, {_visible('html')} <> '' AS ok FROM {{pages}}""")
def s7(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract_pages(view(spark, d, "pages")).select("page_id", "title", "h1", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), "ok")


_HREF = "(?is)<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a\\s*>"


@query("S9_harvest_links", f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_HREF}', 0)) AS a, unnest(range(len(regexp_extract_all(html, '{_HREF}', 0)))) AS pos FROM {{pages}}),
l AS (SELECT page_id, pos, split_part(CASE WHEN regexp_matches(h, '^(?i)https?://') THEN h WHEN starts_with(h, '/') THEN concat(root, h) ELSE concat(root, '/', h) END, '#', 1) AS link, t AS text FROM (SELECT page_id, pos, trim(regexp_extract(a, '{_HREF}', 1)) AS h, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS root, {_visible(f"regexp_extract(a, '{_HREF}', 2)")} AS t FROM a))
SELECT page_id, link, arg_min(text, pos) AS text FROM l WHERE regexp_matches(lower(regexp_extract(link, '^[^:]+://([^/?#:]*)', 1)), '(^|\\.)example\\.(com|net)$') AND contains(lower(text), 'th') AND NOT contains(lower(text), 'zu') GROUP BY page_id, link""")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return pages.harvest_links(view(spark, d, "pages"), ("example.com", "example.net"), ("th",), ("zu",))


@query("U6_page_quality", f"SELECT page_id, CASE WHEN contains(lower(html), 'thanedble') THEN 'BLOCKED' WHEN length({_visible('html')}) < 1500 THEN 'EMPTY' ELSE 'OK' END AS quality FROM {{pages}}")
def u6(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_quality(view(spark, d, "pages"), ("thanedble",), 1500)


@query("S8_embedded_objects", "SELECT page_id, concat('page ', page_id) AS name, url FROM {pages}")
def s8(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a JSON-LD script made of their own url and id, as the stored ones have none."""
    made = F.concat(F.col("html"), F.lit('<script type="application/ld+json">{"@type":"Product","name":"page '), F.col("page_id").cast("string"), F.lit('","url":"'), F.col("url"), F.lit('"}</script>'))
    return pages.embedded_objects(view(spark, d, "pages").select("page_id", made.alias("html"))).select("page_id", "name", "url")


def _scripts(q: str) -> str:
    """Pages with scripts about themselves, in SQL for both engines: a list with a graph, objects deep inside others, offers as a list
    and as an object, relative and absolute links, page state with an object again, and broken JSON on each seventh page."""
    kind = "STRING" if q == "spark" else "VARCHAR"
    n = f"CAST(page_id AS {kind})"
    return f"""SELECT page_id, url, concat(html, replace(replace(concat('<script type="application/ld+json">', CASE WHEN page_id % 7 = 0 THEN '<<"name":"cut",' ELSE concat('[<<"@graph":[<<"@type":["Thing","Product"],"name":" page  ', {n}, ' ","url":"', CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/p/x' WHEN 2 THEN concat('item-', {n}, '?a=1#top') ELSE '../up' END,
'","offers":[<<"price":"$1,', CAST(100 + page_id % 900 AS {kind}), '.50","availability":"https://schema.example/InStock","priceCurrency":"USD">>,<<"price":1>>]>>,<<"@type":"Person","name":"someone">>]>>,<<"itemListElement":[<<"item":<<"headline":"deep ', {n}, '","sku":"S', {n}, '","priceCurrency":"EUR","price":7,"offers":<<"lowPrice":', {n}, '>>>>>>,<<"item":<<"title":"no detail">>>>,[<<"@type":"Article","abstract":"only text">>]]>>]') END,
'</script><script id="__NEXT_DATA__" type="application/json"><<"props":<<"pageProps":<<"product":<<"title":"state ', {n}, '","productID":"P', {n}, '","image":[<<"url":"/i/', {n}, '.png">>],"releaseDate":"2024-05-01","related":[<<"name":"deep twin","sku":"S', {n}, '">>,<<"name":"other","sku":"T', {n}, '","offers":[],"highPrice":"n/a","price":"12.5 ">>]>>>>>>>></script>'), '<<', chr(123)), '>>', chr(125))) AS html FROM {{pages}}"""


_S8 = rf"""made AS ({_scripts('duckdb')}),
sc AS (SELECT page_id, url, unnest(list_concat(regexp_extract_all(html, '(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>', 1), regexp_extract_all(html, '(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script\s*>', 1))) AS j FROM made),
ob AS (SELECT page_id, url AS page, t.value AS v FROM (SELECT * FROM sc WHERE json_valid(j)) s, json_tree(s.j) t WHERE t.type = 'OBJECT'),
c AS (SELECT page_id, page, trim(regexp_replace(coalesce(v->>'$.name', v->>'$.headline', v->>'$.title'), '\s+', ' ', 'g')) AS title, coalesce(v->>'$.url', v->>'$."@id"') AS link, coalesce(v->>'$.sku', v->>'$.productID') AS sku, v->>'$.productID' AS product_id, v->>'$.releaseDate' AS release_date,
  CASE WHEN json_type(v, '$.offers') = 'ARRAY' THEN v->'$.offers[0]' ELSE v->'$.offers' END AS o, v->>'$.image[0].url' AS picture, v, CASE WHEN json_type(v, '$."@type"') = 'ARRAY' THEN array_to_string(CAST(v->'$."@type"' AS VARCHAR[]), ',') ELSE coalesce(v->>'$."@type"', '') END AS structured_type FROM ob),
k AS (SELECT * FROM c WHERE title IS NOT NULL AND (list_has_any(string_split(structured_type, ','), ['Product', 'IndividualProduct', 'Article', 'NewsArticle']) OR sku IS NOT NULL OR release_date IS NOT NULL OR (o IS NOT NULL AND CAST(o AS VARCHAR) <> 'null'))),
r AS (SELECT *, regexp_extract(page, '^([^:]+://[^/?#]*)', 1) AS root, regexp_extract(page, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM k),
w AS (SELECT page_id, title, CASE WHEN link IS NULL THEN NULL WHEN contains(link, '://') THEN string_split(link, '#')[1] WHEN starts_with(link, '/') THEN concat(root, link) WHEN link = '../up' THEN concat(root, CASE WHEN len(string_split(path, '/')) <= 3 THEN '/' ELSE regexp_extract(path, '^(.*/)[^/]*/[^/]*$', 1) END, 'up') ELSE concat(root, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END, string_split(link, '#')[1]) END AS url,
  CASE WHEN json_type(o) = 'OBJECT' THEN CAST(replace(replace(coalesce(o->>'$.price', o->>'$.lowPrice'), '$', ''), ',', '') AS DOUBLE) ELSE TRY_CAST(trim(v->>'$.price') AS DOUBLE) END AS retail_price, coalesce(CASE WHEN json_type(o) = 'OBJECT' THEN o->>'$.priceCurrency' END, v->>'$.priceCurrency') AS currency, CASE WHEN json_type(o) = 'OBJECT' THEN string_split(o->>'$.availability', '/')[-1] END AS availability,
  release_date, sku, product_id, CASE WHEN picture IS NOT NULL THEN concat(root, picture) END AS image_url, structured_type FROM r)
SELECT * FROM w WHERE title <> 'deep twin' OR page_id % 7 = 0"""


@query("S8_structured_objects", f"WITH {_S8}")
def s8_structured(spark: SparkSession, d: str) -> DataFrame:
    made = spark.sql(_scripts("spark").replace("{pages}", "{p}"), p=view(spark, d, "pages"))
    return objects.structured_objects(made).drop("description")


@query("S4_feed_items", "SELECT page_id AS feed_id, concat('page ', page_id) AS title, url AS link, NULL AS summary FROM {pages}")
def s4(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pages")
    item = F.concat(F.lit("<rss><channel><item><title>page "), F.col("page_id").cast("string"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item><item><broken></channel></rss>"))
    return pages.feed_items(p.select(F.col("page_id").alias("feed_id"), item.alias("body"))).select("feed_id", "title", "link", "summary")


@query("S5_json_items", "SELECT event_id AS doc_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events} WHERE event_id % 3 <> 0")
def s5(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "events")
    body = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('{"data":{"items":['), F.col("props"), F.lit("]}}"))).otherwise("{broken")
    return pages.json_items(e.select(F.col("event_id").alias("doc_id"), body.alias("body")), ("data", "items"), "k long")


RULES = (("release", 90, ("\\bthe (?:and|of)\\b", "\\bder\\b")), ("limit", 70, ("\\bnot?\\b", "\\bles?\\b")), ("place", 60, ("\\bin\\b",)), ("claim", 40, ("\\bqueue?\\b", "\\bund\\b")))


def detections(spark: SparkSession, d: str) -> DataFrame:
    return signals.detect_keywords(view(spark, d, "texts"), RULES, ("is", "nicht", "pas"), ("thion", "zupf"), ("wher", "eau"))


query("T1_detect_keywords")(detections)


@query("T1_keyword_counts", """SELECT 'place' AS signal, count(*) AS docs FROM {texts} WHERE regexp_matches(text, '(?i)thha')""")
def t1c(spark: SparkSession, d: str) -> DataFrame:
    found = signals.detect_keywords(view(spark, d, "texts"), (("place", 60, ("thha",)),), ("nosuchword",))
    return found.groupBy("signal").agg(F.count("*").alias("docs"))


@query("T3_detect_prices")
def t3(spark: SparkSession, d: str) -> DataFrame:
    """Amounts, here runs of digits, of the texts; roles by words that occur in them."""
    return signals.detect_prices(view(spark, d, "texts"), (("retail", ("the", "der")), ("resale", ("of", "und"))), 40, r"\d{2,}(?:\.\d{1,2})?")


WEIGHTS = {"release": 60, "limit": 40, "place": 20, "claim": 30}


@query("T7_doc_signals")
def t7(spark: SparkSession, d: str) -> DataFrame:
    return signals.doc_signals(detections(spark, d), WEIGHTS, ("release", "limit"))


@query("T8_accept_docs")
def t8(spark: SparkSession, d: str) -> DataFrame:
    return signals.accept_docs(t7(spark, d), 80, (("release", "claim"),), ("limit",), ("place",)).select("seq", "signals", "accepted")


_ADJUSTED = "greatest(0, least(100, base + CASE upper(source_type) WHEN 'OFFICIAL' THEN 10 WHEN 'PRESS_RELEASE' THEN 5 WHEN 'COMMUNITY' THEN -10 WHEN 'SOCIAL' THEN -15 WHEN 'OTHER' THEN -5 ELSE 0 END + CASE certainty WHEN 'estimated' THEN -15 WHEN 'rumored' THEN -35 ELSE 0 END))"
_IN = lambda names: ", ".join(f"'{n}'" for n in names)
_HAS_ALL = " OR ".join(f"(list_contains(have, '{one}') AND list_has_any(have, [{_IN(others)}]))" for one, others in judgement.TOGETHER)
_JUDGED = f"""d AS (SELECT seq, at_, signal, CAST({_ADJUSTED} AS DOUBLE) AS confidence, certainty, value FROM {{detected}}),
hard AS (SELECT seq, 99 AS at_, 'HIGH_ACQUISITION_DIFFICULTY' AS signal, avg(confidence) AS confidence, 'confirmed' AS certainty, CAST(NULL AS DOUBLE) AS value FROM d WHERE signal IN ({_IN(judgement.BARRIERS)}) AND certainty <> 'rumored' GROUP BY seq HAVING count(DISTINCT signal) >= 2),
every AS (SELECT *, CASE signal {' '.join(f"WHEN '{k}' THEN {v}" for k, v in judgement.WEIGHTS.items())} ELSE 0 END AS w FROM (SELECT * FROM d UNION ALL SELECT * FROM hard)),
rel AS (SELECT seq, least(100.0, sum(p)) AS relevance FROM (SELECT seq, signal, max(w * confidence / 100) AS p FROM every GROUP BY seq, signal) GROUP BY seq),
doc AS (SELECT e.seq, coalesce(avg(confidence) FILTER (w > 0), avg(confidence)) AS mean, list(DISTINCT signal) AS have, first(value ORDER BY at_, value NULLS FIRST) FILTER (signal = 'OBSERVED_RESALE_PRICE') AS resale, first(value ORDER BY at_, value NULLS FIRST) FILTER (signal IN ('SPEND_REQUIREMENT', 'RETAIL_PRICE')) AS spend FROM every e GROUP BY e.seq),
j AS (SELECT o_orderkey AS seq, o_orderkey % 11 <> 0 AS known, coalesce(relevance, 0) AS relevance, coalesce(mean, 0) AS mean, coalesce(have, []) AS have, coalesce(resale <> 0 AND spend <> 0 AND resale >= spend * 1.5, false) OR {_HAS_ALL.replace('have', 'coalesce(have, [])')} AS strong FROM {{orders}} LEFT JOIN doc ON doc.seq = o_orderkey LEFT JOIN rel ON rel.seq = o_orderkey),
r AS (SELECT seq, relevance, mean, CASE WHEN NOT known THEN 'missing_product_identity' WHEN NOT (relevance >= 35 OR strong OR (list_has_any(have, [{_IN(judgement.ALONE)}]) AND relevance >= 21)) THEN 'below_threshold' WHEN len(list_filter(have, lambda x: NOT list_contains([{_IN(judgement.WEAK)}], x))) = 0 THEN 'only_weak_signals' END AS reason FROM j)"""


@query("T1_adjusted_confidence", f"SELECT seq, at_, signal, CAST({_ADJUSTED} AS INT) AS confidence FROM {{detected}}")
def t1_adjusted(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detected")
    return rows.select("seq", "at_", "signal", judgement.adjusted_confidence(F.col("base"), F.col("source_type"), F.col("certainty")).alias("confidence"))


@query("T8_judged_docs", f"WITH {_JUDGED} SELECT seq, round(relevance, 6) AS relevance, round_even(mean, 2) AS confidence, reason IS NULL AS \"create\", reason FROM r")
def t8_judged(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a document, its lines as detections; every eleventh has no identity."""
    rows = view(spark, d, "detected")
    found = rows.select("seq", F.col("at_").cast("int").alias("at"), "signal", judgement.adjusted_confidence(F.col("base"), F.col("source_type"), F.col("certainty")).alias("confidence"), "certainty", "value")
    identified = view(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 11 != 0).alias("has_identity"))
    judged = judgement.judge_docs(judgement.with_difficulty(found), identified)
    return judged.select("seq", F.round("relevance", 6).alias("relevance"), "confidence", "create", "reason")


@query("T9_draft_opportunities")
def t9(spark: SparkSession, d: str) -> DataFrame:
    return signals.draft_opportunities(detections(spark, d), ("release", "limit", "place"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("source_id"), "s_name", (F.col("s_nationkey") + F.when(k % 10 == 0, 100).otherwise(0)).alias("brand_id"), F.concat(F.lit("http://s/"), (k % 90).cast("string")).alias("url"), (k % 4 != 0).alias("enabled"), F.when(k % 11 == 0, "retired").otherwise("active").alias("lifecycle"),
        F.when(k % 3 == 0, F.concat(F.lit("every "), (k % 5).cast("string"))).alias("schedule"), (k % 7 + 1).cast("int").alias("priority"), F.array((k % 25).cast("int"), (k % 6).cast("int")).alias("scout_ids"), (k % 5 != 1).alias("due"),
    )


_SRC = """src AS (SELECT s_suppkey AS source_id, s_name, s_nationkey + CASE WHEN s_suppkey % 10 = 0 THEN 100 ELSE 0 END AS brand_id, concat('http://s/', s_suppkey % 90) AS url, s_suppkey % 4 <> 0 AS enabled, CASE WHEN s_suppkey % 11 = 0 THEN 'retired' ELSE 'active' END AS lifecycle,
CASE WHEN s_suppkey % 3 = 0 THEN concat('every ', s_suppkey % 5) END AS schedule, CAST(s_suppkey % 7 + 1 AS INT) AS priority, [CAST(s_suppkey % 25 AS INT), CAST(s_suppkey % 6 AS INT)] AS scout_ids, s_suppkey % 5 <> 1 AS due FROM {supplier})"""


@query("J13_check_registry", f"""WITH {_SRC} SELECT source_id, 'missing_brand' AS rule, CAST(brand_id AS VARCHAR) AS value FROM src WHERE brand_id NOT IN (SELECT n_nationkey FROM {{nation}})
UNION ALL SELECT source_id, 'duplicate_url', url FROM src WHERE url IN (SELECT url FROM src GROUP BY url HAVING count(*) > 1)""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    return registry.missing_references(s, "brand_id", view(spark, d, "nation"), "n_nationkey", "missing_brand").unionByName(registry.repeated(s, "url", "duplicate_url"))


_LINKS = "lk AS (SELECT source_id, unnest(scout_ids) AS scout_id FROM src UNION SELECT n_nationkey + 2 AS source_id, n_nationkey AS scout_id FROM {nation})"


def links(spark: SparkSession, d: str) -> DataFrame:
    scouts = view(spark, d, "nation").select(F.col("n_nationkey").alias("scout_id"), F.array((F.col("n_nationkey") + 2).cast("long")).alias("source_ids"))
    return registry.repair_links(sources(spark, d), scouts)


query("J15_repair_links", f"WITH {_SRC}, {_LINKS} SELECT source_id, scout_id FROM lk")(links)


_OLD = """SELECT source_id, url, enabled, lifecycle, CASE WHEN source_id % 5 <> 0 THEN 'rss' END AS connector_type, CASE WHEN source_id % 2 = 0 THEN 'rss_feed' ELSE 'official_news' END AS source_type, CASE source_id % 4 WHEN 0 THEN 'official_primary' WHEN 1 THEN 'reputable_press' WHEN 2 THEN 'official_secondary' ELSE 'other' END AS authority_level FROM <src>"""
_NEW = """SELECT source_id, CASE WHEN source_id % 8 = 1 THEN concat(url, 'x') WHEN source_id % 16 = 3 THEN '' ELSE url END AS url, CASE WHEN source_id % 9 = 2 THEN NOT enabled ELSE enabled END AS enabled, lifecycle, CASE WHEN source_id % 6 = 1 THEN 'html' ELSE connector_type END AS connector_type, CASE WHEN source_id % 14 = 5 THEN 'press_release' ELSE source_type END AS source_type,
CASE WHEN source_id % 10 IN (2, 4) THEN 'social_verified' WHEN source_id % 10 = 8 THEN 'official_secondary' ELSE authority_level END AS authority_level FROM <old> WHERE source_id % 13 <> 0 UNION ALL SELECT source_id + 100000, url, enabled, lifecycle, connector_type, source_type, authority_level FROM <old> WHERE source_id % 17 = 0"""
_DIFF_FIELDS = ("url", "enabled", "connector_type", "source_type", "authority_level")
_RANKED = "list_position(['official_primary','official_secondary','authorized_retailer','reputable_press','marketplace_confirmed_sale','marketplace_asking','community_verified','community_unverified','social_verified','social_unverified','manual_trusted','manual_untrusted'], {0}) > 0"


@query("J16_diff_registry", f"""WITH {_SRC}, old AS ({_OLD.replace('<src>', 'src')}), new AS ({_NEW.replace('<old>', 'old')}),
j AS (SELECT coalesce(n.source_id, o.source_id) AS source_id, CASE WHEN o.source_id IS NULL THEN 'added' WHEN n.source_id IS NULL THEN 'removed' ELSE 'changed' END AS change, concat_ws(',', {', '.join(f"CASE WHEN o.{f} IS DISTINCT FROM n.{f} THEN '{f}' END" for f in _DIFF_FIELDS)}) AS fields, CASE WHEN o.enabled <> n.enabled THEN CASE WHEN n.enabled THEN 'enabled' ELSE 'disabled' END END AS switched,
concat_ws(',', CASE WHEN o.url <> '' AND n.url <> '' AND o.url <> n.url THEN 'url' END, CASE WHEN o.connector_type <> n.connector_type THEN 'connector_type' END, CASE WHEN o.source_type <> n.source_type THEN 'source_type' END, CASE WHEN {_RANKED.format('o.authority_level')} AND {_RANKED.format('n.authority_level')} AND starts_with(o.authority_level, 'official') AND NOT starts_with(n.authority_level, 'official') THEN 'authority_level' END, CASE WHEN n.source_id IS NULL AND o.enabled AND o.lifecycle = 'active' THEN 'removed' END) AS breaking
FROM old o FULL JOIN new n ON o.source_id = n.source_id) SELECT source_id, change, CASE WHEN change = 'changed' THEN fields ELSE '' END AS changed_fields, switched, breaking FROM j WHERE change <> 'changed' OR fields <> ''""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    old = spark.sql(_OLD.replace("<src>", "{src}"), src=sources(spark, d))
    new = spark.sql(_NEW.replace("<old>", "{old}"), old=old)
    return registry.diff_registry(old, new, "source_id", _DIFF_FIELDS)


@query("J16_idle_scouts", f"WITH {_SRC}, sc AS (SELECT n_nationkey AS scout_id, n_nationkey % 3 <> 0 AS enabled, [n_nationkey * 2 + 1, n_nationkey + 4] AS ids FROM {{nation}}) SELECT scout_id FROM sc WHERE enabled AND NOT EXISTS (SELECT 1 FROM src WHERE list_contains(sc.ids, src.source_id) AND src.enabled AND src.lifecycle IN ('active', 'proposed'))")
def j16_idle(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    scouts = view(spark, d, "nation").select(k.alias("scout_id"), (k % 3 != 0).alias("enabled"), F.array(k * 2 + 1, k + 4).alias("source_ids"))
    return registry.idle_scouts(scouts, sources(spark, d))


_PRIO = "['critical', 'high', 'medium', 'low', 'archival']"


def _scouts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    priority = F.array(*(F.lit(p) for p in registry.PRIORITIES))[(k % 5).cast("int")]
    config = F.when(k % 4 == 0, F.lit(None).cast("map<string,string>")).otherwise(F.create_map(F.lit("timeout"), k.cast("string"), F.concat(F.lit("k"), (k % 3).cast("string")), F.concat(F.lit("scout "), k.cast("string"))))
    return view(spark, d, "nation").select(k.alias("scout_id"), F.when(k % 2 == 0, F.concat(F.lit("scout "), k.cast("string"))).alias("schedule"), priority.alias("priority"), config.alias("config"))


@query("J17_effective_settings", f"""WITH {_SRC}, {_LINKS}, b AS (SELECT lk.source_id, arg_min(CASE WHEN n_nationkey % 2 = 0 THEN concat('scout ', n_nationkey) END, n_nationkey) FILTER (n_nationkey % 2 = 0) AS s, min(n_nationkey % 5) AS p FROM lk JOIN {{nation}} ON n_nationkey = scout_id GROUP BY lk.source_id)
SELECT src.source_id, coalesce(src.schedule, b.s, 'daily') AS schedule, coalesce({_PRIO}[CAST(b.p AS INT) + 1], 'medium') AS priority FROM src LEFT JOIN b ON b.source_id = src.source_id""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    return registry.effective_settings(sources(spark, d), links(spark, d), _scouts(spark, d), "daily")


@query("J17_connector_configs", f"""WITH {_SRC}, {_LINKS}, en AS (SELECT source_id, 'retries' AS name, '3' AS value, 0 AS level, -1 AS scout FROM src UNION ALL SELECT source_id, 'timeout', '30', 0, -1 FROM src
UNION ALL SELECT source_id, 'timeout', CAST(n_nationkey AS VARCHAR), 1, n_nationkey FROM lk JOIN {{nation}} ON n_nationkey = scout_id WHERE n_nationkey % 4 <> 0 UNION ALL SELECT source_id, concat('k', n_nationkey % 3), concat('scout ', n_nationkey), 1, n_nationkey FROM lk JOIN {{nation}} ON n_nationkey = scout_id WHERE n_nationkey % 4 <> 0
UNION ALL SELECT source_id, 'k1', 'own', 2, -1 FROM src WHERE source_id % 6 = 0), m AS (SELECT source_id, name, arg_max(value, level * 1000 + scout) AS value FROM en GROUP BY source_id, name)
SELECT m.source_id, string_agg(concat(name, '=', value), ',' ORDER BY name) AS config FROM m JOIN src ON src.source_id = m.source_id GROUP BY m.source_id""")
def j17_configs(spark: SparkSession, d: str) -> DataFrame:
    own = sources(spark, d).withColumn("config", F.when(F.col("source_id") % 6 == 0, F.create_map(F.lit("k1"), F.lit("own"))))
    found = registry.connector_configs(own, links(spark, d), _scouts(spark, d), {"retries": "3", "timeout": "30"})
    return found.select("source_id", F.array_join(F.transform(F.map_entries("config"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("config"))


@query("J18_ordered_worklist", f"""WITH {_SRC}, k AS (SELECT source_id, CASE source_id % 6 WHEN 0 THEN 'unknown' ELSE {_PRIO}[CAST(source_id % 5 AS INT) + 1] END AS priority, CASE source_id % 4 WHEN 0 THEN 'official_primary' WHEN 1 THEN 'reputable_press' WHEN 2 THEN 'other' ELSE 'manual_untrusted' END AS authority, CASE source_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'daily' END AS schedule FROM src WHERE enabled AND lifecycle = 'active'),
r AS (SELECT *, coalesce(schedule, 'manual') = 'daily' AS due, coalesce(list_position({_PRIO}, priority) - 1, 99) AS priority_rank, CASE authority WHEN 'official_primary' THEN 0 WHEN 'reputable_press' THEN 3 WHEN 'manual_untrusted' THEN 11 ELSE 99 END AS authority_rank FROM k)
SELECT source_id, due, CAST(priority_rank AS INT) AS priority_rank, authority_rank, CAST(row_number() OVER (ORDER BY due DESC, priority_rank, authority_rank, source_id) AS INT) AS place FROM r ORDER BY place LIMIT 200""")
def j18_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The 200 first of the worklist, with their places."""
    i = F.col("source_id")
    priority = F.when(i % 6 == 0, "unknown").otherwise(F.array(*(F.lit(p) for p in registry.PRIORITIES))[(i % 5).cast("int")])
    authority = F.when(i % 4 == 0, "official_primary").when(i % 4 == 1, "reputable_press").when(i % 4 == 2, "other").otherwise("manual_untrusted")
    own = sources(spark, d).withColumns({"connector_type": F.lit("rss"), "priority": priority, "authority_level": authority, "schedule": F.when(i % 3 == 0, "manual").when(i % 3 == 1, "daily"), "scout_id": F.lit(None).cast("string")})
    first = registry.ordered_worklist(registry.worklist(own)).limit(200).select("source_id", "due", "priority_rank", "authority_rank")
    rows = first.agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("due")).alias("later"), "priority_rank", "authority_rank", "source_id", "due"))), lambda r, k: F.struct(r["source_id"].alias("source_id"), r["due"].alias("due"), r["priority_rank"].alias("priority_rank"), r["authority_rank"].alias("authority_rank"), (k + 1).alias("place"))).alias("r"))
    return rows.select(F.explode("r").alias("r")).select("r.*")


@query("J19_list_sources", f"WITH {_SRC} SELECT source_id, url FROM src WHERE lifecycle = 'active' AND list_has_any(scout_ids, [3, 4])")
def j19(spark: SparkSession, d: str) -> DataFrame:
    return registry.list_sources(sources(spark, d), {"lifecycle": ["active"]}, {"scout_ids": [3, 4]}).select("source_id", "url")


@query("J20_card_view", """WITH o AS (SELECT o_orderkey % 2000 AS seq, arg_max(o_orderpriority, o_orderkey) AS name FROM {orders} WHERE o_orderkey % 3 = 0 GROUP BY 1), n AS (SELECT l_partkey AS seq, count(*) AS c FROM {lineitem} WHERE l_linenumber = 7 GROUP BY 1), l AS (SELECT l_partkey AS seq, count(*) AS c FROM {lineitem} WHERE l_linenumber = 6 GROUP BY 1)
SELECT p.seq, p.score, coalesce(o.name, p.product_name) AS product_name, coalesce(n.c, 0) AS n_notes, coalesce(l.c, 0) AS n_links, p.seq IN (SELECT o_custkey FROM {orders} WHERE o_orderkey % 50 = 0) AS saved FROM {opportunities} p LEFT JOIN o ON o.seq = p.seq LEFT JOIN n ON n.seq = p.seq LEFT JOIN l ON l.seq = p.seq""".replace("p.seq, p.score", "p.seq AS card_id, p.score"))
def j20(spark: SparkSession, d: str) -> DataFrame:
    base = view(spark, d, "opportunities").select(F.col("seq").alias("card_id"), "score", "product_name")
    orders, lines = view(spark, d, "orders"), view(spark, d, "lineitem")
    over = orders.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") % 2000).alias("card_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("product_name"))
    note = lambda n: lines.where(f"l_linenumber = {n}").select(F.col("l_partkey").alias("card_id"))
    saved = orders.where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("card_id"))
    return cards.card_view(base, over, note(7), note(6), saved, "card_id", ("product_name",)).select("card_id", "score", "product_name", "n_notes", "n_links", "saved")


@query("J21_saved_items", """SELECT s.o_orderkey AS saved_id, coalesce(c.product_name, s.o_orderpriority) AS name, coalesce(c.status, s.o_orderstatus) AS status, c.product_name IS NOT NULL AS linked FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN concat('opp-', o_custkey) END AS k FROM {orders}) s LEFT JOIN {opportunities} c ON c.opportunity_id = s.k WHERE contains(lower(coalesce(c.product_name, s.o_orderpriority)), 'i')""")
def j21(spark: SparkSession, d: str) -> DataFrame:
    saved = view(spark, d, "orders").select(F.col("o_orderkey").alias("saved_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("opp-"), F.col("o_custkey").cast("string"))).alias("opportunity_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"))
    known = view(spark, d, "opportunities").select("opportunity_id", F.col("product_name").alias("name"), "status")
    return cards.saved_items_view(saved, known, "opportunity_id", search="I").select("saved_id", "name", "status", "linked")


@query("W8_daily_brief", f"""WITH {_STRAT} SELECT 'top_overall' AS section, count(*) AS n, CAST(sum(opportunity_score) AS BIGINT) AS total FROM (SELECT * FROM bd ORDER BY opportunity_score DESC, collector_score DESC, hold_score DESC, flip_score DESC, seq LIMIT 20)
UNION ALL SELECT concat('tier_', opportunity_tier), count(*), CAST(sum(opportunity_score) AS BIGINT) FROM bd GROUP BY opportunity_tier""")
def w8(spark: SparkSession, d: str) -> DataFrame:
    b = board_items(spark, d)
    part = lambda df, name: df.groupBy(name.alias("section")).agg(F.count("*").alias("n"), F.sum("opportunity_score").alias("total"))
    return part(boards.money_board(b), F.lit("top_overall")).unionByName(part(boards.score_items(b), F.concat(F.lit("tier_"), F.col("opportunity_tier"))))


@query("A23_market_signal", """SELECT seq, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'watch' ELSE 'weak' END AS status FROM (SELECT seq, CAST(greatest(0, least(100, 35 + 6 * (CASE WHEN contains(t, 'exclusive') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'limited') THEN 1 ELSE 0 END) + CASE WHEN url IS NOT NULL THEN 10 ELSE 0 END)) AS INT) AS score FROM (SELECT seq, url, lower(concat(brand, ' ', title, ' ', description)) AS t FROM {products}))""")
def s6(spark: SparkSession, d: str) -> DataFrame:
    m = items.market_signal(F.concat_ws(" ", "brand", "title", "description"), F.col("url"))
    return view(spark, d, "products").select("seq", m.alias("m")).select("seq", "m.*")


@query("F3_set_codes", "SELECT seq, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(upper(c), '\\b(OP|ST|EB|PRB)[- ]?(\\d\\d)\\b', 0), lambda m: concat(regexp_extract(m, '^([A-Z]+)', 1), '-', regexp_extract(m, '(\\d+)$', 1))))), ',') AS set_codes FROM (SELECT seq, concat('op ', 10 + seq % 5, ' and EB', 10 + seq % 3) AS c FROM {products})")
def f3c(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.lit("op "), (10 + F.col("seq") % 5).cast("string"), F.lit(" and EB"), (10 + F.col("seq") % 3).cast("string"))
    return view(spark, d, "products").select("seq", F.array_join(F.array_sort(T.set_codes(c)), ",").alias("set_codes"))
