"""Records are judged once, and stamps are those that Spark's formats take."""

from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import validation


def test_issues_are_computed_once_a_row(spark):
    records = spark.createDataFrame([("", "x"), ("5", "https://a.example"), (None, None)], "amount string, url string")
    issues = validation.record_issues(records.columns, required=("amount",), urls=("url",))
    accepted, quarantined = validation.split_valid(validation.validate(records, issues))
    assert [r.amount for r in accepted.collect()] == ["5"] and quarantined.count() == 2
    assert records.columns + ["issues"] == accepted.columns
    for part in (accepted, quarantined):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("MISSING_REQUIRED_FIELD") == 1


def test_stamps_as_spark_reads_them(spark):
    days = ["2024-05-06", "2024-5-06", "2024-02-30", "2024-13-01", "0001-01-01", "+12024-05-06", "-0005-05-06", "12024-05-06", "24-05-06", "2024-00-10", "2024-12-31", "2024-01-32", "٢024-05-06"]
    times = ["", " 01:02:03", "T01:02:03", "t01:02:03", "T01:02:03Z", "t01:02:03z", "T24:00:00", "T01:02:03+02:00", "T01:02:03-0200", "T01:02:03+02", "T01:02", " 1:02:03", "  01:02:03", "T01:02:60Z", "T01:02:03.5", "T01:02:03Z x", "\n"]
    rows = [(d + t,) for d in days for t in times] + [(None,), ("",), ("soon",), ("  2024-05-06 ",)]
    df = spark.createDataFrame(rows, "s string")
    plain = F.coalesce(*(F.try_to_timestamp(F.trim("s"), F.lit(f)) for f in T.STAMP_FORMATS))
    wrong = df.select("s", T.parse_ts(F.col("s")).alias("got"), plain.alias("want")).where("not (got <=> want)")
    assert wrong.collect() == []
