"""Registered queries over record shapes, confidences, tiers and leader groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import groups, routing
from larkspur.plans.items_plan import R2
from larkspur.plans.changes_plan import _TOK
from larkspur.plans.views import plain, view

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL (names of tables and views in braces)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = plain(sql).replace("<<", "{").replace(">>", "}")
        return f

    return add


@query("J6_leader_groups", f"""WITH RECURSIVE p AS (SELECT seq AS id, row_number() OVER (ORDER BY seq) AS n, {_TOK} AS t, coalesce(product_type, 'unknown') AS ty, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(sku)), '[\\s_]+', '-', 'g'), '[^a-z0-9-]+', '', 'g'), '-+', '-', 'g'), '-') AS code FROM {{products}}),
m AS (SELECT b.id, list(a.id) AS ms FROM p a JOIN p b ON a.id < b.id AND (a.code = b.code AND a.code <> '' OR len(a.t) > 0 AND len(b.t) > 0 AND least(1.0, floor((len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) + CASE WHEN a.ty = b.ty AND a.ty <> 'unknown' THEN 0.15 ELSE 0 END) * 1000 + 0.5) / 1000) >= 0.72) GROUP BY b.id),
q AS MATERIALIZED (SELECT p.id, p.n, coalesce(m.ms, []) AS ms FROM p LEFT JOIN m ON m.id = p.id),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS leaders
UNION ALL SELECT q.n, q.id, coalesce(list_min(list_intersect(r.leaders, q.ms)), q.id), CASE WHEN len(list_intersect(r.leaders, q.ms)) > 0 THEN r.leaders ELSE list_append(r.leaders, q.id) END FROM r JOIN q ON q.n = r.n + 1)
SELECT id, leader FROM r WHERE n > 0""")
def j6(spark: SparkSession, d: str) -> DataFrame:
    """Greedy leaders among all products; the SQL takes them one by one."""
    p = view(spark, d, "products").select(F.col("seq").alias("id"), "title", "sku", F.col("product_type").alias("type"))
    return groups.leader_groups(p)


@query("A17_finalization_confidence", f"""SELECT seq, {R2('i')} AS identity_confidence, {R2('m')} AS market_confidence, {R2('(i + CASE WHEN m <> 0 THEN m ELSE i END) / 2 * CASE WHEN r1 + r2 > 0 THEN 0.85 ELSE 1.0 END')} AS finalization_confidence FROM (SELECT seq, r1, r2, greatest(0, least(100, (2 + CASE WHEN franchise IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN collaboration_partner IS NOT NULL THEN 1 ELSE 0 END) * 100 / 4 - 25 * r1)) AS i,
CASE WHEN sold_price IS NOT NULL OR market_price IS NOT NULL THEN greatest(0, least(100, 70.0 - 30 * r2 - 10 * c)) ELSE 0.0 END AS m FROM (SELECT *, CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS r1, CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS r2, seq % 3 AS c FROM {{opportunities}}))""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq")
    found = routing.finalization_confidence([F.col(c) for c in ("product_name", "brand", "franchise", "collaboration_partner")], [F.col("sold_price"), F.col("market_price")], F.when(k % 7 == 0, 1).otherwise(0), F.when(k % 5 == 0, 1).otherwise(0), k % 3)
    return view(spark, d, "opportunities").select("seq", *(v.alias(n) for n, v in found.items()))


@query("T11_item_signals", """SELECT seq, CAST(greatest(0, least(100, 40 + CASE WHEN limited_release THEN 20 ELSE 0 END + CASE WHEN promo_included THEN 15 ELSE 0 END + CASE WHEN retail_price < 950 THEN 10 ELSE 0 END + CASE WHEN availability = 'sold_out' THEN -30 ELSE 0 END)) AS INT) AS score,
concat_ws(',', CASE WHEN limited_release THEN 'limited' END, CASE WHEN promo_included THEN 'promo' END, CASE WHEN retail_price < 950 THEN 'cheap' END, CASE WHEN availability = 'sold_out' THEN 'sold_out' END) AS signals FROM {products}""")
def t11(spark: SparkSession, d: str) -> DataFrame:
    rules = (("limited", 20, F.col("limited_release")), ("promo", 15, F.col("promo_included")), ("cheap", 10, F.col("retail_price") < 950), ("sold_out", -30, F.col("availability") == "sold_out"))
    return routing.item_signals(view(spark, d, "products"), rules, "seq")


@query("U5_fill_by_tier", """SELECT seq, coalesce(CASE WHEN seq % 3 = 0 THEN title END, CASE WHEN seq % 2 = 0 THEN upper(title) END, description) AS name, coalesce(retail_price, collector_score) AS price,
concat_ws(',', CASE WHEN seq % 3 = 0 OR retail_price IS NOT NULL THEN 'structured' END, CASE WHEN seq % 3 <> 0 AND seq % 2 = 0 OR retail_price IS NULL THEN 'meta' END, CASE WHEN seq % 3 <> 0 AND seq % 2 <> 0 THEN 'visible' END) AS provenance FROM {products}""")
def u5(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq")
    none = F.lit(None).cast("double")
    tiers = view(spark, d, "products").select("seq", F.struct(F.when(k % 3 == 0, F.col("title")).alias("name"), F.col("retail_price").alias("price")).alias("structured"), F.struct(F.when(k % 2 == 0, F.upper("title")).alias("name"), F.col("collector_score").alias("price")).alias("meta"), F.struct(F.col("description").alias("name"), none.alias("price")).alias("visible"))
    return routing.fill_by_tier(tiers, ("name", "price"), ("structured", "meta", "visible"))


@query("A15_classify_sources", """SELECT t.seq, CASE WHEN t.seq > f THEN 'REJECTED_DUPLICATE' WHEN NOT contains(text, 'th') THEN 'REJECTED_IRRELEVANT' WHEN contains(text, 'thion') THEN 'ACCEPTED_RUMOR' WHEN st = 'MARKETPLACE' THEN 'ACCEPTED_MARKET_EVIDENCE' WHEN st = 'OFFICIAL' THEN 'ACCEPTED_PRIMARY' WHEN contains(text, 'sold') THEN 'ACCEPTED_STATUS_UPDATE' ELSE 'ACCEPTED_SUPPORTING' END AS disposition
FROM (SELECT seq, text, CASE seq % 3 WHEN 0 THEN 'MARKETPLACE' WHEN 1 THEN 'OFFICIAL' ELSE 'NEWS' END AS st, min(seq) OVER (PARTITION BY text) AS f FROM {texts}) t""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "texts")
    k = F.col("seq")
    docs = t.select("seq", F.sha2("text", 256).alias("probe"), F.when(k % 3 == 0, "MARKETPLACE").when(k % 3 == 1, "OFFICIAL").otherwise("NEWS").alias("source_type"))
    found = t.where(F.contains("text", F.lit("th"))).select("seq", F.contains("text", F.lit("thion")).alias("rumored"), F.contains("text", F.lit("sold")).alias("status"))
    return routing.classify_sources(docs, found)


_TXT = "concat(title, CASE seq % 4 WHEN 0 THEN concat(' includes ', seq % 9, ' booster packs') WHEN 1 THEN concat(' ', seq % 7, ' exclusive promo cards and dice') WHEN 2 THEN ' Playmat, COIN and damage-counter dice' ELSE '' END)"


@query("F11_product_details", f"""WITH t AS (SELECT *, lower({_TXT}) AS x FROM {{products}}), p AS (SELECT *, CASE WHEN seq % 4 = 0 THEN CAST(seq % 9 AS INT) END AS pack_count, CASE WHEN seq % 4 = 1 THEN CAST(seq % 7 AS INT) END AS promo_card_count FROM t),
s AS (SELECT *, CASE WHEN retail_price IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN coalesce(availability, '') <> '' THEN 15 ELSE 0 END + CASE WHEN coalesce(sku, '') <> '' THEN 15 ELSE 0 END + CASE WHEN pack_count IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN promo_card_count IS NOT NULL THEN 7 ELSE 0 END AS completeness FROM p)
SELECT seq, pack_count, promo_card_count, concat_ws(',', CASE WHEN contains(x, 'playmat') THEN 'Playmat' END, CASE WHEN contains(x, 'coin') THEN 'Collector coin' END, CASE WHEN contains(x, 'damage-counter dice') THEN 'Damage-counter dice' END, CASE WHEN contains(x, 'dice') THEN 'Dice' END) AS accessories, completeness,
CASE WHEN completeness >= 65 THEN 'GOOD' WHEN completeness >= 40 THEN 'PARTIAL' ELSE 'LIMITED' END AS completeness_level FROM s""")
def f11(spark: SparkSession, d: str) -> DataFrame:
    from larkspur.operators import details

    k = F.col("seq")
    more = F.when(k % 4 == 0, F.concat(F.lit(" includes "), (k % 9).cast("string"), F.lit(" booster packs"))).when(k % 4 == 1, F.concat(F.lit(" "), (k % 7).cast("string"), F.lit(" exclusive promo cards and dice"))).when(k % 4 == 2, " Playmat, COIN and damage-counter dice").otherwise("")
    return details.product_details(view(spark, d, "products"), F.concat("title", more)).select("seq", "pack_count", "promo_card_count", F.array_join("accessories", ",").alias("accessories"), "completeness", "completeness_level")


@query("F21_listing_text", """SELECT seq, concat(product_name, ' - a ', th, ' listed on ', retailer, '.', CASE role WHEN 'sold' THEN concat(' This ', th, ' sold for ', m, '.') WHEN 'asking' THEN concat(' The asking price of this ', th, ' is ', m, '; nobody has bought it yet.') ELSE '' END) AS text, role AS price_role
FROM (SELECT seq, product_name, retailer, concat('box', CASE seq % 3 WHEN 0 THEN ', graded' WHEN 1 THEN ', ungraded' ELSE '' END) AS th, CASE WHEN seq % 5 = 0 THEN 'sold' WHEN market_price IS NOT NULL THEN 'asking' ELSE 'unknown' END AS role,
coalesce(CASE WHEN market_price IS NULL THEN NULL WHEN market_price = floor(market_price) THEN concat('$', CAST(floor(market_price) AS BIGINT)) ELSE concat('$', printf('%.2f', market_price)) END, 'an unknown price') AS m FROM {opportunities})""")
def f21(spark: SparkSession, d: str) -> DataFrame:
    from larkspur.operators import details

    k = F.col("seq")
    t = details.listing_text(F.col("product_name"), F.col("retailer"), F.lit("box"), F.when(k % 3 == 0, True).when(k % 3 == 1, False), k % 5 == 0, F.col("market_price"), F.lit(None).cast("double"), F.lit("USD"))
    return view(spark, d, "opportunities").select("seq", t.alias("t")).select("seq", "t.*")


def _offers(spark: SparkSession, d: str) -> DataFrame:
    """Sentences made from the products' own numbers."""
    k = F.col("seq")
    said = F.concat("title", F.lit(" is limited to "), (k % 900 + 1).cast("string"), F.lit(" pieces, "), F.when(k % 3 == 0, "not ").otherwise(""), F.lit("numbered, limit "), (k % 4 + 1).cast("string"), F.lit(" per customer, from May "), (k % 28 + 1).cast("string"), F.lit(", 2024 at "), (k % 12 + 1).cast("string"), F.lit(" PM"))
    return view(spark, d, "products").select("seq", said.alias("text"))


@query("T4_detect_quantities", """SELECT seq, 'limited_quantity' AS kind, CAST(seq % 900 + 1 AS INT) AS value FROM {products} UNION ALL SELECT seq, 'purchase_limit', CAST(seq % 4 + 1 AS INT) FROM {products} WHERE seq % 3 <> 0 UNION ALL SELECT seq, 'numbered', NULL FROM {products} WHERE seq % 3 <> 0""")
def t4(spark: SparkSession, d: str) -> DataFrame:
    from larkspur.operators import signals

    return signals.detect_quantities(_offers(spark, d)).select("seq", "kind", "value")


@query("T5_detect_dates", """SELECT seq, 'date' AS kind, concat('May ', seq % 28 + 1, ', 2024') AS match FROM {products} UNION ALL SELECT seq, 'time', concat(seq % 12 + 1, ' PM') FROM {products}""")
def t5(spark: SparkSession, d: str) -> DataFrame:
    from larkspur.operators import signals

    return signals.detect_dates(_offers(spark, d)).select("seq", "kind", "match")
