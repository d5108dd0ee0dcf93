"""Matches of drafts by overlapping fields, and product objects in pages, against plain Python and worked examples."""

import json
import random


from larkspur.operators import matching, objects

FIELDS = ("product_name", "brand", "franchise", "retailer", "edition_name")
SCHEMA = "id long, " + ", ".join(f"{f} string" for f in FIELDS)


def some_drafts(seed, n):
    rng = random.Random(seed)
    words = ["ace", "bee", "cat", "ace bee", "bee cat", "ace bee cat"]
    return [(i, *(rng.choice(words) if rng.random() < 0.5 else rng.choice([None, ""]) for _ in FIELDS)) for i in range(n)]


def similarity(x, y):
    both = [(a, b) for a, b in zip(x[1:], y[1:]) if a and b]
    return sum(a in b or b in a for a, b in both) / len(both) if both else 0


def test_ambiguous_and_existing_match_plain_python(spark):
    rows, known = some_drafts(1, 70), [(1000 + r[0], *r[1:]) for r in some_drafts(2, 40)]
    drafts = spark.createDataFrame(rows, SCHEMA)
    groups = spark.createDataFrame([(i, i if i % 4 else max(i - 1, 0)) for i in range(70)], "id long, group_id long")
    members = {}
    for i in range(70):
        members.setdefault(i if i % 4 else max(i - 1, 0), []).append(i)
    firsts = [rows[g] for g in members]
    want = {}
    for x in firsts:
        if len(members[x[0]]) == 1:
            n = sum(0 < similarity(x, y) < 0.6 - 1e-9 for y in firsts if y[0] != x[0])
            if n >= 2:
                want[x[0]] = n
    assert {r.id: r.partial_matches for r in matching.ambiguous_groups(drafts, groups).collect()} == want and want
    want = {}
    for x in firsts:
        fits = [y[0] for y in known if similarity(x, y) >= 0.6 - 1e-9]
        if fits:
            want[x[0]] = min(fits)
    got = matching.match_existing(drafts, groups, spark.createDataFrame(known, SCHEMA))
    assert {r.group_id: r.existing_id for r in got.collect()} == want and want


def test_a_shared_brand_makes_no_pairs(spark):
    rows = spark.createDataFrame([(i, f"name{i:04d}x", "same brand", None, None, None) for i in range(400)], SCHEMA)
    sides = matching.signatures(rows)
    assert matching._overlaps(sides, sides, 0.6).count() == 3 * 400


def page(*payloads, state=None):
    scripts = "".join(f'<script type="application/ld+json">{p if isinstance(p, str) else json.dumps(p)}</script>' for p in payloads)
    return scripts + (f'<script id="__NEXT_DATA__">{json.dumps(state)}</script>' if state is not None else "")


def found(spark, html):
    df = spark.createDataFrame([(1, "https://a.example/shop/list?p=1", html)], "page_id long, url string, html string")
    return [r.asDict() for r in objects.structured_objects(df).orderBy("title").collect()]


def test_nested_listed_and_state_objects(spark):
    deep = {"a": [[{"b": {"@type": "Product", "name": " Deep\n one ", "url": {"@id": "item#x"}, "image": ["/i.png#f"], "offers": {"price": "1,299.50", "availability": "https://s.example/InStock"}}}]]}
    listed = [{"headline": "Listed", "sku": "S1", "offers": [{"lowPrice": 5, "priceCurrency": "USD"}, {"price": 1}]}, {"name": "No detail"}, 7, None, "text"]
    state = {"props": {"x": {"title": "State", "productID": "P1", "price": "n/a", "highPrice": "$9", "image": {"contentUrl": "img.png"}, "offers": []}, "again": {"name": "Twin", "sku": "S1"}}}
    rows = found(spark, page(deep, "{broken", listed, state=state))
    assert [r["title"] for r in rows] == ["Deep one", "Listed", "State"]
    one, two, three = rows
    assert (one["url"], one["image_url"], one["retail_price"], one["availability"], one["structured_type"]) == ("https://a.example/shop/item", "https://a.example/i.png#f", 1299.5, "InStock", "Product")
    assert (two["sku"], two["retail_price"], two["currency"], two["url"]) == ("S1", 5.0, "USD", None)
    assert (three["sku"], three["product_id"], three["retail_price"], three["image_url"]) == ("P1", "P1", 9.0, "https://a.example/shop/img.png")


def test_pages_without_objects(spark):
    assert found(spark, None) == found(spark, "") == found(spark, page("", "[]", "{}", '"text"', "3")) == found(spark, page({"name": "", "sku": "1"}, {"@type": ["Product"]}, {"name": "only a name"})) == []


def test_deep_nesting(spark):
    value = {"name": "Bottom", "sku": "B"}
    for i in range(30):
        value = {"k": value} if i % 2 else [value]
    assert [r["sku"] for r in found(spark, page(value))] == ["B"]
