"""Actions of alerts are shuffled once, and repeated ones change nothing."""

from larkspur.operators import changes

ACTIONS = "product_key long, event string, seq long, action string"


def test_actions_are_shuffled_once_and_repeats_change_nothing(spark):
    rows = [(1, "RESTOCK", seq, a) for seq, a in ((-1, "alert"), (0, "resolve"), (0, "alert"), (2, "forward"), (3, "resolve"), (3, "alert"), (4, "acknowledge"))]
    once, often = (spark.createDataFrame(r, ACTIONS) for r in (rows, rows * 3 + [(1, "RESTOCK", None, "resolve"), (1, "RESTOCK", None, "alert")]))
    found = changes.alert_records(often)
    assert sorted(map(str, found.collect())) == sorted(map(str, changes.alert_records(once).collect()))
    got = {r.opened: (r.acknowledged, r.forwarded, r.resolved, r.status) for r in found.collect()}
    assert got == {-1: (None, None, 0, "RESOLVED"), 0: (None, 2, 3, "RESOLVED"), 3: (4, None, None, "ACTIVE")}
    plan = changes.alert_records(often)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
