"""Tables written to cut lineage, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows up to which a table goes to every task.
SENT_ROWS = 200_000


def sent_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df to be broadcast if it has at most `most` rows by count, else to be joined by shuffle, whatever its estimate.

    The estimate of a table that was made of few columns may be far too small, and then either side would be sent.
    """
    most = SENT_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_merge")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is set and driver and executors are one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarn-scratch-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
