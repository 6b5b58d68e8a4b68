"""Helpers shared by the training-data operators: durable tables, sized broadcasts, distributed prefix sums."""
from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

#: A side is broadcast only when it has been counted and has no more rows than this (rows are narrow: ids, hashes, numbers).
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch that holds texts.
BATCH_ROWS = 512
#: Where durable() put its tables; entries go with the DataFrames.
_PLACES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local master gets a folder of its own; a cluster raises."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='provena-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back. Cuts lineage; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that durable() wrote and that nothing reads any more."""
    for df in tables:
        if path := _PLACES.pop(df, None):
            jvm = df.sparkSession._jvm
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """df, after setting its session to send Python no more than so many rows at once: a batch of whole texts is held by the JVM and by Python, several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle. From compressed files and arrays Spark may take a side of millions of rows to be a few MB, and send it through the driver."""
    return df.hint("merge")


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """(df with a broadcast hint, True) if it has at most `rows` rows, else (df to be joined by shuffle, False). df should be cheap to count."""
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df), True) if small else (by_shuffle(df), False)


def new_name(start: str, columns: list[str]) -> str:
    """A column name that starts so and that none of the columns has, whatever the case."""
    taken = {c.lower() for c in columns}
    while start.lower() in taken:
        start += "_"
    return start


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Exclusive running totals within each key, without one task per key.

    Rows of a key are ordered by (bucket, *order); `bucket` must be monotone in the wanted order or define it. Each
    (key, bucket) is summed where it lies; only one row per (key, bucket) is then accumulated over the buckets.
    values maps the name of each new column to the column that it totals. Keys and bucket must not be null.
    """
    at = [*keys, bucket]
    parts = df.groupBy(*at).agg(*[F.sum(v).alias(f"_part_{o}") for o, v in values.items()])
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*at, *[F.coalesce(F.sum(f"_part_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in values])
    within = W.partitionBy(*at).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_in_{o}") for o, v in values.items()])
    rows = rows.join(parts, at)
    keep = [c for c in df.columns]
    return rows.select(*keep, *[(F.col(f"_off_{o}") + F.col(f"_in_{o}")).cast("long").alias(o) for o in values])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than the six ASCII white-space characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
