"""Registered queries over signal types, collaborations, the evidence ledger, XML documents and the alert scan, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scores as S
from larkspur.functions.spans import placed
from larkspur.operators import boards, changes, claims, pages, routing, signals
from larkspur.plans.changes_plan import _A25, _C1, observations
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


@query("S6_xml_items", """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS line_number, CAST(l_quantity AS DOUBLE) AS quantity, concat(l_returnflag, ',', l_linestatus) AS flags, CAST(l_suppkey AS VARCHAR) AS carrier FROM {lineitem} WHERE l_orderkey % 7 <> 0""")
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Each order as an XML document; those whose key 7 divides are cut off and give nothing."""
    line = F.format_string('<line no="%d"><qty>%s</qty><flag>%s</flag><flag>%s</flag><ship mode="%s">x</ship></line>', F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("string"), "l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string"))
    body = F.concat(F.lit("<order><lines>"), F.array_join(F.collect_list(line), ""), F.when(F.col("doc_id") % 7 == 0, "</li").otherwise("</lines></order>"))
    docs = view(spark, d, "lineitem").withColumn("doc_id", F.col("l_orderkey")).groupBy("doc_id").agg(body.alias("body"))
    items = pages.xml_items(docs, ("lines", "line"), "_no int, qty double, flag array<string>, ship struct<_mode:string,_VALUE:string>")
    return items.select("doc_id", F.col("_no").alias("line_number"), F.col("qty").alias("quantity"), F.array_join("flag", ",").alias("flags"), F.col("ship._mode").alias("carrier"))


@query("C6_alert_scan", f"""WITH {_C1}, al AS ({_A25}), raised AS (SELECT * FROM al WHERE should_alert), r AS (SELECT *, row_number() OVER (PARTITION BY product_key, event ORDER BY seq) AS n FROM raised WHERE seq > 6)
SELECT product_key, event, seq, alert_score, priority, action FROM r WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM raised a WHERE a.seq <= 6 AND a.product_key = r.product_key AND a.event = r.event)""")
def c6(spark: SparkSession, d: str) -> DataFrame:
    """The second of two scans; the first one's alerts are active. The collector score stands for the opportunity score."""
    items = boards.best_strategy(view(spark, d, "products")).withColumns({"opportunity_score": F.col("collector_score"), "opportunity_tier": S.bucket(F.col("collector_score"), S.TIERS, "WATCH")})
    board, obs = items.withColumnRenamed("seq", "product_key"), observations(spark, d)
    before = obs.where("seq <= 6")
    found = changes.alert_scan(board, obs.where("seq > 6"), changes.advance_state(before), changes.alert_scan(board, before))
    return found.select("product_key", "event", "seq", "alert_score", "priority", "action")


PHRASES = ("A 25th anniversary edition with an exclusive promo card.", "Sold out within minutes, back in stock soon.", "This is not a first edition.", "Rumored: factory sealed, by lottery for members only.")


def _chosen(seq, phrases):
    return F.element_at(F.array(*(F.lit(p) if isinstance(p, str) else p for p in phrases)), (seq % len(phrases) + 1).cast("int"))


@query("T1_signal_types", """SELECT seq, signal, confidence, CAST(length(title) + 2 + place AS INT) AS start, match, certainty FROM {products} JOIN (VALUES (0, 'ANNIVERSARY', 85, 2, '25th anniversary', 'confirmed'), (0, 'EXCLUSIVE_PROMO', 85, 35, 'exclusive promo', 'confirmed'), (0, 'PROMOTIONAL_PACK', 65, 45, 'promo card', 'confirmed'),
(1, 'STATUS_SOLD_OUT', 85, 0, 'Sold out', 'confirmed'), (1, 'STATUS_RESTOCKED', 80, 25, 'back in stock', 'confirmed'), (1, 'RAPID_SELLOUT', 90, 0, 'Sold out within', 'confirmed'),
(3, 'SEALED_PRODUCT', 80, 9, 'factory sealed', 'rumored'), (3, 'LOTTERY_REQUIRED', 80, 28, 'lottery', 'rumored'), (3, 'MEMBERSHIP_EXCLUSIVE', 85, 40, 'members only', 'rumored')) AS v(k, signal, confidence, place, match, certainty) ON v.k = seq % 4""")
def t1(spark: SparkSession, d: str) -> DataFrame:
    """Titles of products with a phrase that follows their number."""
    p = view(spark, d, "products")
    docs = p.select("seq", F.concat_ws(". ", "title", _chosen(F.col("seq"), PHRASES)).alias("text"))
    return signals.detect_signals(docs).select("seq", "signal", "confidence", "start", "match", "certainty")


@query("T6_detect_collabs", """SELECT c_custkey AS seq, CASE WHEN c_custkey % 4 <> 1 THEN replace(n_name, '_', '') END AS left_name, c_mktsegment AS right_name, CAST(CASE c_custkey % 4 WHEN 0 THEN 14 WHEN 1 THEN 11 ELSE 0 END AS INT) AS start, CASE WHEN c_custkey % 4 = 1 THEN 'estimated' ELSE 'confirmed' END AS certainty FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 2""")
def t6(spark: SparkSession, d: str) -> DataFrame:
    """Sentences about the nations and segments of customers."""
    c = view(spark, d, "customer").join(view(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nation = F.replace("n_name", F.lit("_"), F.lit(""))
    pair = F.concat(nation, F.lit(" x "), "c_mktsegment")
    said = (
        F.concat(F.lit("New drop from the "), pair, F.lit(" collection")),
        F.concat(F.lit("Reportedly in collaboration with "), "c_mktsegment", F.lit(" for a summer")),
        F.concat(F.lit("it is not "), pair),
        F.concat(nation, F.lit(" and "), "c_mktsegment", F.lit(" launched a limited collaboration")),
    )
    docs = c.select(F.col("c_custkey").alias("seq"), _chosen(F.col("c_custkey"), said).alias("text"))
    return claims.detect_collabs(docs).select("seq", F.col("left").alias("left_name"), F.col("right").alias("right_name"), "start", "certainty")


_LEDGER = """SELECT seq, 'product_name' AS field, title AS value, NULL AS unit_scope, 60.0 AS confidence FROM {products}
UNION ALL SELECT seq, 'brand', brand, NULL, 60.0 FROM {products} UNION ALL SELECT seq, 'retailer', 'Shop', NULL, 60.0 FROM {products} WHERE seq % 5 = 0
UNION ALL SELECT seq, field, CASE WHEN value = '$' THEN CAST(seq % 500 + 1 AS VARCHAR) ELSE value END, unit_scope, confidence FROM {products} JOIN (VALUES (0, 'recent_sold_price', '$', 'single_item', 70.0), (0, 'recent_sold_price__grading', 'graded', NULL, 70.0), (0, 'recent_sold_price__price_kind', 'sold', NULL, 70.0), (0, 'numbered', 'false', NULL, 85.0),
(1, 'estimated_market_price', '$', 'box', 70.0), (1, 'estimated_market_price__price_kind', 'asking', NULL, 70.0), (1, 'sealed_product', 'true', NULL, 80.0), (2, 'status', 'restocked', NULL, 80.0), (2, 'status', 'sold_out', NULL, 85.0),
(3, 'membership_exclusive', 'true', NULL, 85.0), (3, 'membership_required', 'true', NULL, 85.0)) AS v(k, field, value, unit_scope, confidence) ON v.k = seq % 4"""


@query("T10_evidence_ledger", _LEDGER)
def t10(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the products' texts; amounts in them are resale prices."""
    p, k = view(spark, d, "products"), F.col("seq")
    price = F.concat(F.lit("$"), (k % 500 + 1).cast("string"), F.lit("."))
    said = (F.concat(F.lit("One card graded PSA 9 sold for "), price, F.lit(" Not numbered.")), F.concat(F.lit("Factory sealed booster box listed at "), price), "Restock announced, sold out fast.", "Announced for members only.")
    docs = p.select("seq", F.concat_ws(". ", "title", _chosen(k, said)).alias("text"))
    none = F.lit(None).cast("string")
    told = signals.detect_signals(docs).withColumn("value", none)
    amounts = docs.select("seq", "text", F.explode(placed(F.col("text"), F.lit(r"\$\d+"))).alias("m"))
    at = F.col("m.start"), F.col("m.end")
    prices = amounts.select("seq", F.lit("OBSERVED_RESALE_PRICE").alias("signal"), F.lit(70).alias("confidence"), "m.start", "m.end", "m.match", signals.certainty(F.col("text"), at[0]).alias("certainty"), signals.context(F.col("text"), *at).alias("context"), F.substring("m.match", 2, 20).alias("value"))
    detections = told.unionByName(prices).withColumns({"value_end": none, "unit": none, "whole_set": F.lit(False)})
    drafts = p.select("seq", "title", F.col("title").alias("product_name"), "brand", none.alias("franchise"), none.alias("collaboration_partner"), F.when(k % 5 == 0, "Shop").alias("retailer"))
    return claims.build_evidence(docs, detections, drafts).select("seq", "field", "value", "unit_scope", "confidence")


@query("T11_signal_evidence", """WITH i AS (SELECT seq, lower(concat(title, ' ', description)) AS t, coalesce(url, '') AS u, coalesce(collector_score, 0) AS c, greatest(flip_score, hold_score, sleeper_score) AS s, coalesce(popularity_score, 0) AS k FROM {products}),
e AS (SELECT seq, 'official_source' AS signal, 12 AS weight FROM i WHERE u <> '' UNION ALL SELECT seq, 'limited_release', 12 FROM i WHERE contains(t, 'limited') UNION ALL SELECT seq, 'exclusive', 10 FROM i WHERE contains(t, 'exclusive')
UNION ALL SELECT seq, 'historical_pattern', 8 FROM i WHERE seq % 8 = 3 UNION ALL SELECT seq, 'collector_interest', 10 FROM i WHERE contains(t, 'promo') OR contains(t, 'collector') OR contains(t, 'anniversary') OR contains(t, 'exclusive') OR contains(t, 'limited')
UNION ALL SELECT seq, 'collector_value', CASE WHEN c >= 85 THEN 16 WHEN c >= 70 THEN 12 WHEN c >= 55 THEN 8 ELSE 4 END FROM i WHERE c >= 35 UNION ALL SELECT seq, 'investment_strategy', CASE WHEN s >= 85 THEN 14 WHEN s >= 70 THEN 10 ELSE 7 END FROM i WHERE s >= 55
UNION ALL SELECT seq, 'source_consensus', CASE WHEN k >= 85 THEN 14 WHEN k >= 70 THEN 10 ELSE 6 END FROM i WHERE k >= 50)
SELECT seq, signal, weight, CAST(greatest(0, least(100, 40 + sum(weight) OVER (PARTITION BY seq))) AS INT) AS score FROM e""")
def t11(spark: SparkSession, d: str) -> DataFrame:
    """The products' signals; popularity stands for consensus, every eighth product has a pattern."""
    items = boards.best_strategy(view(spark, d, "products")).withColumns({"consensus_score": F.col("popularity_score"), "patterns": F.when(F.col("seq") % 8 == 3, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>"))})
    found = routing.signal_evidence(items)
    return found.select("seq", "score", F.explode("evidence").alias("e")).select("seq", "e.signal", "e.weight", "score")
