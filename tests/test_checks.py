"""Validation, constraints, registries, gaps, product links, reused quotes and folds over batches."""

import random

from pyspark.sql import functions as F

from larkspur.operators import changes, pages, registry, routing, signals, validation

RECORD = "id int, title string, body string, url string, published_at string, price string, quantity string, currency string, source_type string, unit_scope string, sold boolean, sold_at string, graded boolean, grade string, grading_company string, event_start string, event_end string"
CLEAN = dict(id=0, title="A", body="b", url="https://a.example/x", published_at="2024-05-06", price="$5", quantity="2", currency="KRW", source_type="forum", unit_scope="booster box", sold=True, sold_at="2024-05-06", graded=None, grade="9", grading_company=None, event_start="2024-05-06", event_end="2024-05-07")


def checked(spark, rows, strict=False, **kw):
    names = [c.split()[0] for c in RECORD.split(", ")]
    records = spark.createDataFrame([tuple({**CLEAN, "id": i, **r}[n] for n in names) for i, r in enumerate(rows)], RECORD)
    issues = validation.record_issues(records.columns, required=("title",), content=("title", "body"), prices=("price",), quantities=("quantity",), urls=("url",), stamps=("published_at",), long_texts=("body",), **kw)
    return validation.validate(records, issues, strict)


def test_record_issues(spark):
    cases = [
        ({}, []),
        ({"title": None}, ["MISSING_REQUIRED_FIELD"]),
        ({"title": "", "body": " "}, ["MISSING_REQUIRED_FIELD", "EMPTY_CONTENT"]),
        ({"url": "ftp://x"}, ["INVALID_URL"]),
        ({"published_at": "soon"}, ["UNPARSEABLE_TIMESTAMP"]),
        ({"price": "free"}, ["INVALID_NUMERIC"]),
        ({"price": "-1", "quantity": "-2"}, ["NEGATIVE_PRICE", "NEGATIVE_QUANTITY"]),
        ({"currency": "XXX", "source_type": "blog", "unit_scope": "crate"}, ["UNSUPPORTED_CURRENCY", "UNRECOGNIZED_SOURCE_TYPE", "UNRECOGNIZED_UNIT_SCOPE"]),
        ({"sold": False}, ["INCOMPATIBLE_SOLD_STATUS"]),
        ({"graded": False}, ["INCOMPATIBLE_GRADING_STATUS"]),
        ({"event_start": "2024-05-08"}, ["EVENT_END_BEFORE_START"]),
        ({"body": "x" * 20001}, ["CONTENT_TRUNCATED"]),
        ({"price": None, "quantity": "", "url": None, "currency": None, "source_type": "", "unit_scope": None, "published_at": "", "sold": None, "event_end": None}, []),
    ]
    got = {r.id: r for r in checked(spark, [c for c, _ in cases]).collect()}
    assert [[x.code for x in got[i].issues] for i in range(len(cases))] == [codes for _, codes in cases]
    warnings = {4, 7, 11}
    assert {i for i, r in got.items() if r.valid} == {0, 12} | warnings
    accepted, quarantined = validation.split_valid(checked(spark, [c for c, _ in cases], strict=True))
    assert {r.id for r in accepted.collect()} == {0, 12} and quarantined.count() == 11 and {x.severity for r in quarantined.collect() for x in r.issues} == {"ERROR"}
    assert [x.code for x in checked(spark, [{"body": "x" * 50}], longest=40, oversized="reject").first().issues] == ["CONTENT_TOO_LARGE"]
    cut = validation.cut_texts(checked(spark, [{"body": "é" * 50}]), ["body"], 40).first()
    assert cut.body == "é" * 40


def test_constraint_breaches(spark):
    rows = spark.createDataFrame([(1, 101.0, -1, "NEWS"), (2, None, None, None), (3, 0.0, 0, "BLOG")], "id int, risk_score double, purchase_limit int, source_type string")
    got = {r.id: r.breaches for r in validation.constraint_breaches(rows).collect()}
    assert got == {1: ["score_ranges:risk_score", "nonnegative_amounts:purchase_limit"], 2: [], 3: ["enum:source_type"]}


def test_registry_issues(spark):
    categories = spark.createDataFrame([("a", None), ("b", "c"), ("c", "b"), ("d", "x"), ("a", None)], "category_id string, parent_category_id string")
    brands = spark.createDataFrame([("n", ["a", "zz"])], "brand_id string, category_ids array<string>")
    source = "source_id string, url string, brand_id string, category_ids array<string>, scout_ids array<string>, enabled boolean, lifecycle string"
    sources = spark.createDataFrame([("s1", "u", "n", ["a"], ["k1"], True, "active"), ("s2", "u", "m", None, [], True, "active"), ("s3", None, None, [], ["k2"], True, "retired"), ("s4", None, None, [], ["k9"], True, "active")], source)
    scouts = spark.createDataFrame([("k1", True, ["s1", "s7"]), ("k2", False, []), ("k3", True, None)], "scout_id string, enabled boolean, source_ids array<string>")
    got = {(r.kind, r.id, r.code, r.value) for r in registry.registry_issues(categories, brands, sources, scouts).collect()}
    assert got == {
        ("category", "a", "DUPLICATE_CATEGORY_ID", "1"),
        ("category", "d", "MISSING_CATEGORY_REFERENCE", "x"),
        ("category", "b", "CATEGORY_CYCLE", None),
        ("category", "c", "CATEGORY_CYCLE", None),
        ("brand", "n", "MISSING_CATEGORY_REFERENCE", "zz"),
        ("source", "s2", "MISSING_BRAND_REFERENCE", "m"),
        ("source", "s2", "DUPLICATE_CANONICAL_URL", "s1"),
        ("source", "s2", "SOURCE_HAS_NO_SCOUT", None),
        ("source", "s3", "SOURCE_SCOUT_STATE_CONFLICT", None),
        ("source", "s4", "MISSING_SCOUT_REFERENCE", "k9"),
        ("scout", "k1", "MISSING_SOURCE_REFERENCE", "s7"),
        ("scout", "k3", "SCOUT_HAS_NO_RUNNABLE_SOURCE", None),
    }


def test_gaps_of_documents(spark):
    found = spark.createDataFrame([(1, "STATUS_SOLD_OUT"), (1, "STATUS_LIVE"), (1, "RETAIL_PRICE"), (2, "RUMOR")], "seq int, signal string")
    known = spark.createDataFrame([(1, True), (2, False), (3, None)], "seq int, has_identity boolean")
    got = {r.seq: (r.missing, r.warnings) for r in signals.doc_gaps(found, known).collect()}
    everything = ["product_identity", "pricing_information", "release_or_availability_status"]
    assert got == {1: ([], ["STATUS_SOLD_OUT/STATUS_LIVE"]), 2: (everything, ["RUMOR_WITHOUT_IDENTITY"]), 3: (everything, [])}


def test_outbound_products(spark):
    link = '<a href="{}">x</a>'.format
    html = {1: link("https://www.pokemoncenter.com/product/1#a") + link("https://www.pokemoncenter.com/product/1") + link("/product/9"), 2: link("https://pokemoncenter.com/product/1") + link("//pokemoncenter.com/product/2"), 3: "no links", 4: None}
    rows = spark.createDataFrame([(i, "https://news.example/a", h) for i, h in html.items()], "page_id int, url string, html string")
    got = {r.page_id: (r.candidates, r.product_url) for r in pages.outbound_product(rows).collect()}
    assert got == {1: (1, "https://www.pokemoncenter.com/product/1"), 2: (2, None), 3: (0, None), 4: (0, None)}


def test_articles(spark):
    rows = spark.createDataFrame([(1, "t", "b", "u", None), (2, "t", None, None, None), (3, "t", "b", None, "k")], "id int, title string, body string, source_url string, sku string")
    got = {r.id: (r.shape, r.confidence) for r in routing.route_payloads(rows).collect()}
    assert got == {1: ("generic_article", 0.74), 2: (None, 0.0), 3: (None, 0.0)}


def test_quotes_are_reused(spark):
    rng = random.Random(5)
    times = {k: sorted(rng.randrange(0, 5 * 86400) for _ in range(n)) for k, n in (("a", 4000), ("b", 30), ("c", 1))}
    times["a"] += times["a"][:50]
    rows = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts] + [("d", None), (None, 7)], "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    for seconds in (900, 200_000):
        want = set()
        for k, ts in times.items():
            last = None
            for t in sorted(ts):
                if last is None or t - last > seconds:
                    want.add((k, t))
                    last = t
        got = [(r.k, r.fetched_at) for r in changes.reuse_quotes(rows, "k", seconds).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    carried = changes.reuse_quotes(rows.where("k = 'c'"), "k", 900, spark.createDataFrame([("c", times["c"][0] - 10)], "k string, fetched_at long"))
    assert carried.count() == 0
