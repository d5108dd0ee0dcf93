"""Isolated stages, checked reading and ways to ancestors."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import boards, brief, changes, groups, market
from larkspur.sources import snapshots


def test_a_stage_that_fails_costs_no_other(spark):
    def broken():
        raise ValueError("no source\nsecond line")

    stages = {"first": lambda: spark.range(3), "planned": lambda: spark.range(1).select("nothing"), "raised": broken, "in a task": lambda: spark.range(1).select(F.raise_error(F.lit("bad row")).cast("int").alias("x")), "empty": lambda: spark.range(0), "last": lambda: spark.range(2)}
    tables, report = brief.run_stages(spark, "r1", stages)
    got = {r.stage: (r["items"], r.error) for r in report.collect()}
    assert sorted(tables) == ["empty", "first", "last"] and tables["last"].count() == 2
    assert {k: v[0] for k, v in got.items()} == {"first": 3, "planned": None, "raised": None, "in a task": None, "empty": 0, "last": 2}
    assert got["raised"][1] == "ValueError: no source" and got["planned"][1] and got["in a task"][1] and got["first"][1] is None
    assert changes.scan_report(report).first().status == "PARTIAL"
    assert changes.scan_report(brief.run_stages(spark, "r2", {"raised": broken})[1]).first().status == "FAILED"
    assert changes.scan_report(brief.run_stages(spark, "r3", {"first": lambda: spark.range(3)})[1]).first().status == "SUCCESS"


def test_a_brief_without_a_catalog_has_the_other_sections(spark):
    items = spark.createDataFrame([(i, f"t{i}", "c" if i % 2 else None, 10.0 * (i % 9), 5.0, 5.0 * i, 1.0, 2.0, False, False, False, False, "in stock", 1.0) for i in range(20)], "seq long, title string, category string, collector_score double, popularity_score double, flip_score double, hold_score double, sleeper_score double, limited_release boolean, promo_included boolean, collector_variant boolean, sealed_product boolean, availability string, retail_price double")
    items = boards.best_strategy(items)
    alerts = spark.createDataFrame([(3, 1, "RESTOCK", "HIGH", 75, 50.0, "CHECK"), (4, 1, "SOLD_OUT", "LOW", 30, 50.0, "WATCH")], "product_key long, seq long, event string, priority string, alert_score int, opportunity_score double, action string")
    rows, report = brief.daily_brief(spark, "run", spark.createDataFrame([(1,)], "seq int"), items, alerts)
    assert {r.stage for r in report.where("error is not null").collect()} == {"data_quality"}
    got = {}
    for r in rows.orderBy("section", "place").collect():
        got.setdefault(r.section, []).append((r.item, r.score))
    assert len(got["top_overall"]) == 15 and len(got["top_flips"]) == 10 and got["top_flips"][0] == ("19", 95)
    assert got["urgent_alerts"] == [("3", 75), ("4", 30)] and got["action_queue"] == [("3", 75)]
    assert dict(got["summary"])["active_alert_count"] == 2 and len(got["summary"]) == 7 and len(got["category_leaders"]) == 1


def test_lines_that_do_not_fit_are_kept(spark, tmp_path):
    lines = ['{"id": 1, "name": "a"}', "", "   ", '{"id": "x", "name": "b"}', '{"id": 2', '{"id": 3, "other": [1]}', "[1]", "null", "text", '{"id": null, "name": null}', '{"id": 4, "name": "a"}']
    (tmp_path / "part.json").write_text("\n".join(lines))
    rows, rejects = snapshots.read_checked(spark, str(tmp_path), "id int, name string")
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(map(str, [(1, "a"), (3, None), (None, None), (4, "a")]))
    assert sorted(r.record for r in rejects.collect()) == sorted(['{"id": "x", "name": "b"}', '{"id": 2', "[1]", "null", "text"]) and rejects.first().file == "part.json"
    none, gone = snapshots.read_checked(spark, str(tmp_path / "missing"), "id int")
    assert none.count() == gone.count() == 0 and none.columns == ["id"]


def plain_reach(edges):
    up = {}
    for n, p in edges:
        if n is not None and p is not None:
            up.setdefault(n, set()).add(p)
    out = set()
    for n in up:
        depth, front, seen = 1, set(up[n]), {}
        while front:
            seen.update((x, depth) for x in front)
            depth += 1
            front = {y for x in front for y in up.get(x, ())} - seen.keys()
        out |= {(n, a, d) for a, d in seen.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_by_the_shortest_way(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.choice([None, *range(25)])) for _ in range(40)] + [(3, 3), (None, 4)]
    got = {tuple(r) for r in groups.reach(spark.createDataFrame(edges, "node long, parent long")).select("node", "ancestor", "depth").collect()}
    assert got == plain_reach(edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, own = [], groups.cut
    monkeypatch.setattr(groups, "cut", lambda df: rounds.append(1) or own(df))
    chain = spark.range(1500).select(F.col("id").alias("node"), (F.col("id") + 1).alias("parent"))
    found = groups.reach(chain)
    assert found.count() == 1500 * 1501 // 2 and found.agg(F.max("depth")).first()[0] == 1500 and len(rounds) <= 26


def test_many_keywords_find_what_few_find(spark, monkeypatch):
    items = spark.createDataFrame([(1, "An xy box", "c"), (2, "a", None), (3, None, "C"), (4, "", "d"), (5, "new BOXED xyz", None)], "item_id int, text string, category string")
    patterns = spark.createDataFrame([("p", "c", ["x", "xy", "box", "A"], 1.0), ("q", "z", ["y", "boxed", "nothing", ""], None)], "name string, category string, keywords array<string>, historical_roi double")
    few = sorted(map(tuple, market.match_patterns(items, patterns).collect()), key=str)
    monkeypatch.setattr(market, "KEYWORDS", 2)
    assert sorted(map(tuple, market.match_patterns(items, patterns).collect()), key=str) == few and len(few) == 6
