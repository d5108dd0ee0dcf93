"""Inputs of the registered queries: views over the given tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A name in braces is a table or another view.
VIEWS = {
    "products": """
SELECT p_partkey AS seq, concat(p_name, ' ', lower(p_type)) AS title, concat('Part ', p_name, ' of type ', p_type, CASE WHEN p_size % 3 = 0 THEN ', exclusive promo' ELSE '' END) AS description,
  p_brand AS brand, lower(p_type) AS category, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS product_type,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS retail_price,
  CASE p_partkey % 6 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'sold_out' WHEN 2 THEN 'Pre-Order' WHEN 3 THEN ' OutOfStock' WHEN 4 THEN 'coming soon' END AS availability,
  CASE WHEN p_partkey % 4 = 0 THEN concat(' sku ', p_partkey % 500, ' ') END AS sku,
  CASE WHEN p_partkey % 4 = 1 THEN concat('op ', p_partkey % 7, ',EB--', p_partkey % 11) END AS codes,
  CASE WHEN p_partkey % 4 = 2 THEN concat('HTTPS://Shop.example/', p_partkey % 300, '/#top') END AS url,
  CAST((p_partkey * 7) % 101 AS DOUBLE) AS collector_score, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST((p_partkey * 11) % 101 AS DOUBLE) END AS popularity_score,
  CAST((p_partkey * 17) % 101 AS DOUBLE) AS flip_score, CAST((p_partkey * 23) % 101 AS DOUBLE) AS hold_score, CAST((p_partkey * 29) % 101 AS DOUBLE) AS sleeper_score,
  p_size % 2 = 0 AS limited_release, p_size % 3 = 0 AS promo_included, p_size % 5 = 0 AS collector_variant, p_size % 7 = 0 AS sealed_product
FROM {part}
""",
    "dated_items": """
SELECT seq, title, brand, category, collector_score, popularity_score, availability,
  CASE WHEN seq % 7 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(seq % 120 - 60 AS INT) AS DATE) END AS release_date FROM {products}
""",
    "observations": """
SELECT l_partkey AS product_key, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS seq,
  l_shipdate AS observed_at, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, CASE l_returnflag WHEN 'N' THEN 'In Stock' WHEN 'R' THEN 'pre-order' ELSE 'OutOfStock' END AS availability,
  concat('s', l_suppkey % 5) AS source, CAST((l_orderkey * 7) % 101 AS DOUBLE) AS strategy_score,
  CASE l_orderkey % 5 WHEN 0 THEN 'WATCH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' END AS tier,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('line ', l_linenumber, substr('xxxxxxxxxx', 1, CAST(l_quantity % 10 AS INT))) END AS description
FROM {lineitem}
""",
    "quotes": """
SELECT l_partkey AS item_id, concat('s', l_suppkey) AS provider, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(floor(sum(CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)) / count(*)) AS BIGINT) END AS average_cents,
  min(CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)) AS lowest_cents, max(CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)) AS highest_cents, count(*) AS sold_count
FROM {lineitem} GROUP BY l_partkey, l_suppkey
""",
    "decision_log": """
SELECT o_orderkey AS log_id, c_mktsegment AS category, CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE concat('brand ', c_nationkey) END AS brand,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'BUY' WHEN '2' THEN 'STRONG WATCH' WHEN '3' THEN 'WATCH' WHEN '4' THEN NULL ELSE 'SKIP' END AS decision, o_orderkey % 101 AS score,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) - 20000000 END AS profit_cents,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 173 AS BIGINT) * 100 - 4000 END AS roi_cents, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS market_cents, o_orderdate AS logged_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
""",
    "opportunities": """
SELECT concat('opp-', p_partkey) AS opportunity_id, p_partkey AS seq, p_name AS product_name, p_brand AS brand, p_type AS franchise, CASE WHEN p_partkey % 3 = 0 THEN concat('Partner ', p_partkey % 20, '!') END AS collaboration_partner,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('2024-0', p_partkey % 9 + 1, '-15T00:00:00Z') END AS release_date, concat('Shop #', p_partkey % 6) AS retailer,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) END AS required_spend, CASE WHEN p_partkey % 2 = 0 THEN round(p_retailprice * (p_partkey % 4), 2) END AS sold_price,
  CASE WHEN p_partkey % 3 <> 0 THEN round(p_retailprice * 1.5, 2) END AS market_price, round(p_retailprice * (1 + p_partkey % 3), 2) AS estimated_price, p_partkey % 101 AS score,
  CASE p_partkey % 4 WHEN 0 THEN 'RUMORED' WHEN 1 THEN 'ANNOUNCED' WHEN 2 THEN 'LIVE' ELSE 'SOLD OUT' END AS status
FROM {part}
""",
    "opportunities_new": """
SELECT opportunity_id, seq, product_name, brand, franchise, collaboration_partner, release_date, retailer, required_spend,
  CASE WHEN seq % 11 = 1 THEN round(sold_price * 1.2, 2) ELSE sold_price END AS sold_price, CASE WHEN seq % 11 = 2 THEN NULL ELSE market_price END AS market_price, estimated_price,
  CASE WHEN seq % 11 = 3 THEN score + 9 WHEN seq % 11 = 4 THEN score + 2 ELSE score END AS score, CASE WHEN seq % 11 = 5 THEN 'LIVE' ELSE status END AS status
FROM {opportunities} WHERE seq % 10 <> 9
UNION ALL
SELECT concat(opportunity_id, '-n'), seq + 1000000, product_name, brand, franchise, collaboration_partner, release_date, retailer, required_spend, sold_price, market_price, estimated_price, score, status
FROM {opportunities} WHERE seq % 10 = 3
""",
    "messy": """
SELECT l_orderkey * 8 + l_linenumber AS seq, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate FROM {lineitem}
""",
    "dirty": """
SELECT seq, CASE seq % 7 WHEN 0 THEN concat('$', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), '.50') WHEN 1 THEN '' WHEN 2 THEN '-5' WHEN 3 THEN 'n/a' WHEN 4 THEN concat('1,', CAST(l_suppkey % 900 + 100 AS STRING), '.25 USD') WHEN 5 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS amount,
  CASE seq % 6 WHEN 0 THEN '$' WHEN 1 THEN ' usd ' WHEN 2 THEN 'EUR' WHEN 3 THEN 'XYZ' WHEN 4 THEN NULL ELSE '' END AS currency,
  CASE seq % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' unsold' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' WHEN 4 THEN 'N' ELSE NULL END AS flag,
  CASE seq % 8 WHEN 0 THEN 'Official' WHEN 1 THEN 'press release' WHEN 2 THEN 'forum' WHEN 3 THEN 'NEWS' WHEN 4 THEN 'blog' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE 'convention' END AS source_type,
  CASE seq % 6 WHEN 0 THEN 'Booster Box' WHEN 1 THEN 'complete set' WHEN 2 THEN 'Unit' WHEN 3 THEN 'crate' WHEN 4 THEN NULL ELSE 'lot' END AS unit_scope,
  CASE seq % 6 WHEN 0 THEN concat(substr(CAST(l_shipdate AS STRING), 1, 10), 'T10:20:30Z') WHEN 1 THEN substr(CAST(l_shipdate AS STRING), 1, 10) WHEN 2 THEN concat(substr(CAST(l_shipdate AS STRING), 1, 10), ' 01:02:03') WHEN 3 THEN 'soon' WHEN 4 THEN '' ELSE '2024-13-40' END AS stamp,
  CASE seq % 5 WHEN 0 THEN concat('HTTP://Shop.Example/A?', CAST(l_partkey AS STRING), '#x') WHEN 1 THEN 'ftp://x.example/y' WHEN 2 THEN ' https://b.example' WHEN 3 THEN NULL ELSE 'nothing' END AS url
FROM {messy}
""",
    "evidence": """
SELECT l_partkey AS group_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS seq,
  CASE l_linenumber % 4 WHEN 0 THEN 'retail_price' WHEN 1 THEN 'recent_sold_price' WHEN 2 THEN 'current_market_price' ELSE 'product_name' END AS field_name,
  CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 END AS value_num, CASE WHEN l_linenumber % 4 = 3 THEN substr('Alpha Beta Gamma', 1, CAST(5 * (l_suppkey % 3 + 1) AS INT)) END AS value_str,
  CASE l_suppkey % 8 WHEN 0 THEN 'OFFICIAL' WHEN 1 THEN 'RETAILER' WHEN 2 THEN 'PRESS_RELEASE' WHEN 3 THEN 'NEWS' WHEN 4 THEN 'MARKETPLACE' WHEN 5 THEN 'SOCIAL' WHEN 6 THEN 'COMMUNITY' ELSE 'OTHER' END AS source_type,
  CAST(l_quantity * 2 AS DOUBLE) AS confidence, CASE l_orderkey % 3 WHEN 0 THEN 'single_item' WHEN 1 THEN 'box' ELSE 'unknown' END AS unit_scope, CASE l_returnflag WHEN 'A' THEN 'graded' WHEN 'R' THEN 'ungraded' ELSE 'unknown' END AS grading,
  CASE l_orderkey % 4 WHEN 0 THEN 'rumored' WHEN 1 THEN 'estimated' ELSE 'confirmed' END AS certainty, l_shipdate AS observed_at, concat('u', l_suppkey) AS source_id
FROM {lineitem}
""",
    "claims": """
SELECT l_suppkey AS group_id, l_orderkey * 8 + l_linenumber AS seq, CASE l_partkey % 7 WHEN 0 THEN 'franchise' WHEN 1 THEN 'retailer' WHEN 2 THEN 'status' WHEN 3 THEN 'purchase_limit' WHEN 4 THEN 'required_spend' WHEN 5 THEN 'estimated_market_price' ELSE 'artist_name' END AS field_name,
  CASE WHEN l_partkey % 7 IN (3, 4, 5) THEN CAST(l_suppkey % 5 + 4 AS DOUBLE) * (CASE WHEN l_orderkey % 9 = 0 THEN 1.5 WHEN l_orderkey % 31 = 0 THEN 2.5 WHEN l_orderkey % 47 = 0 THEN 4.0 ELSE 1.0 END) END AS value_num,
  CASE WHEN l_partkey % 7 IN (0, 1) THEN CASE WHEN l_suppkey % 4 = 0 AND l_orderkey % 10 = 0 THEN 'Delta' ELSE substr('Alpha Beta Gamma', 1, CAST(5 * (l_orderkey % 3 + 1) AS INT)) END WHEN l_partkey % 7 = 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'live' ELSE 'sold_out' END WHEN l_partkey % 7 = 6 THEN CASE WHEN l_orderkey % 6 = 0 AND l_suppkey % 2 = 0 THEN 'B. Artist' ELSE 'A. Artist' END END AS value_str,
  CASE (l_orderkey + l_suppkey) % 9 WHEN 0 THEN 'OFFICIAL' WHEN 1 THEN 'RETAILER' WHEN 2 THEN 'PRESS_RELEASE' WHEN 3 THEN 'NEWS' WHEN 4 THEN 'MARKETPLACE' WHEN 5 THEN 'SOCIAL' WHEN 6 THEN 'COMMUNITY' WHEN 7 THEN 'EVENT' ELSE 'OTHER' END AS source_type,
  CAST(l_quantity * 2 AS DOUBLE) AS confidence, CASE l_orderkey % 4 WHEN 0 THEN 'rumored' WHEN 1 THEN 'estimated' ELSE 'confirmed' END AS certainty
FROM {lineitem}
""",
    "detected": """
SELECT l_orderkey AS seq, l_linenumber AS at_, CASE (l_partkey * 7 + l_linenumber) % 26 WHEN 0 THEN 'COLLABORATION' WHEN 1 THEN 'EXCLUSIVE_PROMO' WHEN 2 THEN 'SPEND_REQUIREMENT' WHEN 3 THEN 'RETAIL_PRICE' WHEN 4 THEN 'OBSERVED_RESALE_PRICE' WHEN 5 THEN 'PURCHASE_LIMIT' WHEN 6 THEN 'LIMITED_QUANTITY' WHEN 7 THEN 'ANNIVERSARY' WHEN 8 THEN 'EVENT_EXCLUSIVE' WHEN 9 THEN 'LOTTERY_REQUIRED'
  WHEN 10 THEN 'STATUS_SOLD_OUT' WHEN 11 THEN 'RISING_DEMAND' WHEN 12 THEN 'RUMOR' WHEN 13 THEN 'STATUS_LIVE' WHEN 14 THEN 'PROMOTIONAL_PACK' WHEN 15 THEN 'BUNDLE_REQUIRED' WHEN 16 THEN 'NUMBERED_RELEASE' WHEN 17 THEN 'RETAILER_EXCLUSIVE' WHEN 18 THEN 'RAPID_SELLOUT' WHEN 19 THEN 'STATUS_RESTOCKED' WHEN 20 THEN 'RISK_WARNING' WHEN 21 THEN 'SEALED_PRODUCT' ELSE 'RETAIL_PRICE' END AS signal,
  CAST(45 + l_quantity AS INT) AS base, CASE l_suppkey % 5 WHEN 0 THEN 'rumored' WHEN 1 THEN 'estimated' ELSE 'confirmed' END AS certainty, CASE l_suppkey % 7 WHEN 0 THEN 'OFFICIAL' WHEN 1 THEN 'press_release' WHEN 2 THEN 'COMMUNITY' WHEN 3 THEN 'SOCIAL' WHEN 4 THEN 'NEWS' WHEN 5 THEN 'OTHER' END AS source_type, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 40 AS DOUBLE) END AS value
FROM {lineitem}
""",
    "game_items": """
SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'pokemon' WHEN 1 THEN 'lorcana' ELSE 'one_piece' END AS category,
  concat(p_name, ' ', CASE p_partkey % 13 WHEN 0 THEN 'Elite Trainer Box' WHEN 1 THEN 'Booster Box' WHEN 2 THEN 'Booster Pack' WHEN 3 THEN 'Premium Collection' WHEN 4 THEN 'Gift Set' WHEN 5 THEN 'Starter Deck [OP15-EB04]' WHEN 6 THEN 'mini tin' WHEN 7 THEN 'Plush' WHEN 8 THEN 'Promo Card P-001' WHEN 9 THEN 'Playmat'
    WHEN 10 THEN 'Collection Starter Set D23' WHEN 11 THEN 'Figure' ELSE p_type END) AS title,
  concat(lower(p_type), CASE WHEN p_size % 2 = 0 THEN ' limited edition' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN ' with promo card' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN ' alternate art foil' ELSE '' END, CASE WHEN p_size % 7 = 0 THEN ' Pokemon Center exclusive' ELSE '' END,
    CASE WHEN p_size % 11 = 0 THEN ' reprint restock' ELSE '' END, CASE WHEN p_size % 13 = 0 THEN ' anniversary' ELSE '' END) AS description,
  CASE p_partkey % 5 WHEN 0 THEN 'SoldOut' WHEN 1 THEN 'InStock' WHEN 2 THEN 'sold out' WHEN 3 THEN 'PreOrder' END AS availability,
  CASE p_partkey % 4 WHEN 0 THEN 'pokemon_center_tcg' WHEN 1 THEN 'pokemon_news' WHEN 2 THEN 'Shop A' END AS source, CASE WHEN p_partkey % 6 < 3 THEN concat('https://s', CAST(p_partkey % 6 AS STRING), '.example') END AS source_url,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(p_partkey % 120 - 60 AS INT) AS DATE) END AS release_date
FROM {part}
""",
    "drafts": """
SELECT p_partkey AS id, concat(p_name, ' ', CAST(p_partkey % 251 AS STRING)) AS product_name, p_brand AS brand, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS franchise,
  CASE WHEN p_partkey % 4 = 0 THEN concat('Partner ', CAST(p_partkey % 300 AS STRING)) END AS collaboration_partner, CASE WHEN p_partkey % 5 = 0 THEN concat('Shop ', CAST(p_partkey % 97 AS STRING)) END AS retailer
FROM {part}
""",
    "wide": """
SELECT p_partkey AS seq, concat(p_name, CASE WHEN p_partkey % 17 = 0 THEN ' Complete Set' ELSE '' END) AS product_name, p_brand AS brand, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS franchise, CASE WHEN p_partkey % 3 = 0 THEN concat('Partner ', CAST(p_partkey % 20 AS STRING)) END AS collaboration_partner,
  CASE WHEN p_partkey % 4 <> 0 THEN '2024-03-01' END AS release_date, CASE p_partkey % 6 WHEN 0 THEN 'rumored' WHEN 1 THEN 'live' WHEN 2 THEN 'sold_out' WHEN 3 THEN 'restocked' END AS status,
  CASE WHEN p_partkey % 8 <> 0 THEN CAST(p_retailprice AS DOUBLE) / 4 END AS retail_price, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_partkey % 90 + 10 AS DOUBLE) END AS required_spend,
  CASE WHEN p_partkey % 4 = 1 THEN CAST(p_partkey % 400 AS DOUBLE) END AS recent_sold_price, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_partkey % 700 + 5 AS DOUBLE) END AS current_market_price, CASE WHEN p_partkey % 5 < 3 THEN CAST(p_retailprice AS DOUBLE) / 3 END AS estimated_market_price,
  CASE WHEN p_size % 4 < 2 THEN CAST(p_size % 4 + 1 AS INT) END AS purchase_limit, CASE WHEN p_size % 3 = 0 THEN CAST(p_size * 60 AS INT) END AS stated_quantity, CASE WHEN p_size % 5 < 3 THEN CAST(p_size AS INT) END AS sold_listing_count,
  p_size % 2 = 0 AS exclusive_artwork, CASE WHEN p_size % 7 = 0 THEN 'An Artist' END AS artist_name, p_size % 11 = 0 AS anniversary_release, p_size % 6 = 0 AS first_edition, p_size % 9 = 0 AS numbered, p_size % 8 = 0 AS event_exclusive, p_size % 10 = 0 AS lottery_required, p_partkey % 2 = 0 AS limited_quantity,
  p_partkey % 3 = 0 AS sealed_product, p_partkey % 7 < 4 AS online_available, CASE WHEN p_partkey % 9 < 3 THEN 'within 30 minutes' END AS sellout_speed, CASE p_partkey % 5 WHEN 0 THEN 'SURGING' WHEN 1 THEN 'RISING' WHEN 2 THEN 'FLAT' WHEN 3 THEN 'FALLING' END AS demand_direction,
  CASE p_partkey % 9 WHEN 0 THEN 'OFFICIAL' WHEN 1 THEN 'RETAILER' WHEN 2 THEN 'NEWS' WHEN 3 THEN 'SOCIAL' WHEN 4 THEN 'COMMUNITY' WHEN 5 THEN 'EVENT' WHEN 6 THEN 'PRESS_RELEASE' WHEN 7 THEN 'MARKETPLACE' END AS source_type, p_partkey % 13 = 0 AS set_risk
FROM {part}
""",
    "source_runs": """
SELECT event_id, user_id AS source_id, ts, event_type <> 'error' AS success FROM {events}
""",
    "fetches": """
SELECT url, 1 AS round, CASE WHEN page_id % 6 = 4 THEN concat('same page ', CAST(page_id % 4 AS STRING)) ELSE html END AS body FROM (SELECT url, min_by(html, page_id) AS html, min(page_id) AS page_id FROM {pages} GROUP BY url) a WHERE page_id % 7 <> 3
UNION ALL
SELECT url, 2 AS round, CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN concat(html, ' more') WHEN 2 THEN concat(html, ' 2024-05-06T07:08:09Z') WHEN 3 THEN '' ELSE concat('same page ', CAST(page_id % 4 AS STRING)) END AS body
FROM (SELECT url, min_by(html, page_id) AS html, min(page_id) AS page_id FROM {pages} GROUP BY url) b WHERE page_id % 9 <> 8
""",
    "texts": """
SELECT doc_id AS seq, text, lang, source FROM {documents}
""",
}


def needed(sql: str, found: dict[str, str] | None = None) -> dict[str, str]:
    """The views that a query names, each after those it needs itself."""
    found = {} if found is None else found
    for name, text in VIEWS.items():
        if "{" + name + "}" in sql and name not in found:
            needed(text, found)
            found[name] = text
    return found


def plain(sql: str) -> str:
    """DuckDB's form of a query that names tables and views in braces."""
    strip = lambda t: t.replace("{", "").replace("}", "")
    ctes = ",\n".join(f"{n} AS ({strip(t)})" for n, t in needed(sql).items())
    body = strip(sql).strip()
    head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.startswith(h)), "")
    if not ctes:
        return body
    return f"{head}{ctes},\n{body[len(head):]}" if head else f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, or a table of the folder."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    import re

    names = dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in names})
