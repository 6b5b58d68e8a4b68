"""Stored tables: intermediate results in the folder that the driver and all executors share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables of up to this size are dealt out before work on texts.
SMALL_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master gets a folder of its own; a cluster raises."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='provena-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if the optimizer takes it for small, as a table in one file may be read by one task; else as it is, without a shuffle."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # nothing is run for it
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage is cut, lost executors do no harm."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
