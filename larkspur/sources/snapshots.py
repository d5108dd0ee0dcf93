"""Items, snapshots, history and logs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_items(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a schema; broken records are left out and a missing path gives an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_checked(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """JSON lines with a schema, and the lines that don't fit it: (rows, rejects). rejects has record (the line) and file.

    A line fits if it is an object whose values have the types of the schema; names that the schema lacks are passed over, blank
    lines count for neither. Every other line is in one of the two tables. A missing path gives two empty tables.
    """
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], shape), spark.createDataFrame([], "record string, file string")
    broken = "__broken"
    marked = T.StructType([*shape.fields, T.StructField(broken, T.StringType())])
    lines = spark.read.text(path).where(F.btrim("value") != "").withColumn("file", F.col("_metadata.file_name"))
    parsed = lines.select("value", "file", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}).alias("r"))
    fits = F.col("r").isNotNull() & F.col(f"r.{broken}").isNull()
    return parsed.where(fits).select(*(F.col("r").getField(f.name).alias(f.name) for f in shape)), parsed.where(~fits).select(F.col("value").alias("record"), "file")


def write_snapshot(df: DataFrame, base: str, run_id: str) -> None:
    """Add a run to the history and make it the current snapshot. Nothing that is being read is overwritten: the current
    snapshot is a pointer to the run."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{base}/history/run_id={run_id}")
    spark.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("overwrite").json(f"{base}/current")


def read_current(spark: SparkSession, base: str) -> DataFrame:
    run_id = spark.read.schema("run_id string").json(f"{base}/current").first()[0]
    return spark.read.parquet(f"{base}/history/run_id={run_id}")


def list_history(spark: SparkSession, base: str, limit: int = 30) -> DataFrame:
    """run_id and rows of the newest runs."""
    return spark.read.parquet(f"{base}/history").groupBy("run_id").agg(F.count("*").alias("rows")).orderBy(F.desc("run_id")).limit(limit)


def read_history(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    """One run; only its folder is read."""
    return spark.read.parquet(f"{base}/history").where(F.col("run_id") == run_id).drop("run_id")


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log."""
    df.write.mode("append").parquet(path)
