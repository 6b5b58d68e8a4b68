"""Text encoders: character n-gram TF-IDF with a truncated SVD, fitted and applied as joins and distributed matrix products, and a registry of encoders."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, SparkSession, functions as F

from provena.functions.text import LATIN, Profile, key_tokens, unit, word_ngrams
from provena.sources.tables import stored

#: Dimensions of the projection at most, and buckets that n-grams are hashed to for it; exact TF-IDF cosines need neither.
DIMS, BUCKETS = 256, 4096


def tf_idf(texts: DataFrame, id_col: str, text_col: str = "text", profile: Profile = LATIN, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, g, w): unit vectors of the character n-grams (2 to 4 within padded words) with weight (1 + ln tf) * idf, idf (g, idf)).

    idf is ln((1 + n) / (1 + df)) + 1 over the texts, or that which is given; n-grams that it doesn't have are left out. Texts without words have no rows.
    """
    tf = texts.select(id_col, F.explode(word_ngrams(key_tokens(F.col(text_col), profile))).alias("g")).groupBy(id_col, "g").agg((1 + F.log(F.count("*"))).alias("tf"))
    if idf is None:
        n = texts.agg(F.count("*").alias("n"))
        idf = tf.groupBy("g").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("g", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    v = tf.join(idf, "g").select(id_col, "g", (F.col("tf") * F.col("idf")).alias("w"))
    norm = v.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return v.join(norm, id_col).select(id_col, "g", (F.col("w") / F.col("norm")).alias("w")), idf


def cosines(vectors: DataFrame, queries: DataFrame, id_col: str, query_id: str) -> DataFrame:
    """query_id, id, score: inner products of sparse vectors (id, g, w) that share an n-gram."""
    return queries.withColumnRenamed("w", "_q").join(vectors, "g").groupBy(query_id, id_col).agg(F.sum(F.col("w") * F.col("_q")).alias("score"))


@dataclass(frozen=True)
class Encoder:
    """idf: g, idf; projection: bucket, p array<double>. fit, encode, save and load make the contract that the registry's encoders keep."""
    idf: DataFrame
    projection: DataFrame
    profile: Profile

    def encode(self, texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
        """id, embedding: unit vectors of the projection; texts without a known n-gram get no row."""
        v, _ = tf_idf(texts, id_col, text_col, self.profile, self.idf)
        hashed = v.groupBy(id_col, F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.sum("w").alias("w"))
        parts = hashed.join(F.broadcast(self.projection), "bucket")  # BUCKETS rows of DIMS numbers at most
        summed = parts.select(id_col, F.posexplode(F.transform("p", lambda p: p * F.col("w"))).alias("at", "x")).groupBy(id_col, "at").agg(F.sum("x").alias("x"))
        return summed.groupBy(id_col).agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])).alias("embedding"))

    def save(self, path: str) -> None:
        self.idf.write.mode("overwrite").parquet(f"{path}/idf")
        self.projection.write.mode("overwrite").parquet(f"{path}/projection")


def fit(texts: DataFrame, id_col: str, text_col: str = "text", profile: Profile = LATIN, dims: int = DIMS) -> Encoder:
    """The encoder of a corpus: idf of its n-grams and the first right singular vectors of its hashed TF-IDF matrix, by a distributed SVD."""
    v, idf = tf_idf(texts, id_col, text_col, profile)
    idf = stored(idf, "encoder-idf")
    rows = v.groupBy(id_col, F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int").alias("b")).agg(F.sum("w").alias("w")).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("r"))
    rows = stored(rows, "encoder-rows")
    n = min(dims, max(1, rows.count() - 1), BUCKETS - 1)
    matrix = RowMatrix(rows.select("r").rdd.map(lambda x: Vectors.sparse(BUCKETS, [(c.b, c.w) for c in x.r])))
    basis = matrix.computeSVD(n, False).V.toArray()  # BUCKETS x dims numbers
    table = texts.sparkSession.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(basis)], "bucket int, p array<double>")
    return Encoder(idf, stored(table, "encoder-projection"), profile)


def load(spark: SparkSession, path: str, profile: Profile = LATIN) -> Encoder:
    return Encoder(spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/projection"), profile)


ENCODERS: dict[str, Callable[..., Encoder]] = {"tfidf-char": fit}


def create(name: str, *args, **options) -> Encoder:
    """A fitted encoder by its registered name; an unknown name is an error that lists those there are."""
    if name not in ENCODERS:
        raise ValueError(f"no encoder {name!r}; there are {', '.join(sorted(ENCODERS))}")
    return ENCODERS[name](*args, **options)
