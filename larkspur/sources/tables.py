"""Tables in the cluster's shared folder, and small tables that may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table counted beforehand is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary one is made only where none is set, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("larkspur.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("larkspur.shared.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspur-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table of at most `most` rows for broadcast; a larger one is returned as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
