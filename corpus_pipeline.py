"""A training corpus from documents: toxicity, exact and near duplicates, mixing, tokens. Part of the llm subpackage."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from provena.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from provena.llm.common import documents, durable, if_small, labels, new_name

#: The end-to-end rows depend on a trained classifier and on alignment, which SQL can't express; tests hold run() against plain Python.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier predicts to be toxic go; the others stay as they are.

    Null and empty texts score alike and stay or go together; rows that repeat are judged each. An empty table stays empty.
    """
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the document with the largest id stays; rows that repeat an id and text stay once.

    A null id stays only where no other id has the text. Columns of docs named like the stage's own do no harm.
    """
    told = durable(exact_dedup.exact_dedup(docs, with_hash=True).groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "pipeline-copies")
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    here = told.select(F.col("doc_id").alias("_told_id"), F.col("text_sha256").alias("_told_sha"), F.col("kept").alias("_told_kept"))
    match = lambda t: docs["doc_id"].eqNullSafe(t["_told_id"]) & (sha == t["_told_sha"])
    gone, _ = if_small(here)
    once = here.where("_told_kept")
    out = docs.join(gone, match(gone), "left_anti")
    if once.isEmpty():
        return out
    own = new_name("_sha", docs.columns)
    once, _ = if_small(once)
    again = docs.join(once, match(once), "left_semi").withColumn(own, sha).dropDuplicates(["doc_id", own]).drop(own)
    return out.unionByName(again)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each cluster of near duplicates stays: the one with the smallest id, a null id only where there is no other.

    Rows are told by id and text, so one that repeats an id with another text is judged by its own. Rows that repeat
    both stay or go together. Texts of fewer than 4 words, empty and null ones go only as copies of an equal one.
    """
    told = near_dedup.near_duplicates(docs, with_md5=True).where(~F.col("kept"))
    gone, _ = if_small(durable(told.select(F.col("doc_id").alias("_told_id"), F.col("text_md5").alias("_told_md5")).distinct(), "pipeline-near"))
    md5 = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_told_id"]) & (md5 == gone["_told_md5"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes words of, whole, once for each time around that takes them; rows repeat where a source is repeated.

    Rows without words (null and empty texts) are never taken and go. Rows with a null or repeated id are taken like others: rows are
    told by all of their columns, and of equal rows as many come out as the mix takes of all of them.
    """
    row = F.struct(F.xxhash64(*docs.columns).alias("a"), F.unhex(F.md5(F.concat_ws("\n", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns]))).alias("b"))
    name, nth = new_name("_row", docs.columns), new_name("_nth", docs.columns)
    told = mixing.mix(docs, carry=(row.alias("_told_row"),))
    told = durable(told.select("_told_row", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("_told_copies")), "pipeline-mix")
    many = durable(told.groupBy("_told_row").count().where("count > 1").select(F.col("_told_row").alias("_many")), "pipeline-mix-many")
    taken = told.where("_told_copies > 0")
    one, _ = if_small(taken.join(if_small(many)[0], F.col("_told_row") == F.col("_many"), "left_anti"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_told_copies")))
    rows = docs.withColumn(name, row)
    out = rows.join(one, F.col(name) == F.col("_told_row")).select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias(nth)).drop(nth)
    if many.isEmpty():
        return out
    equal = rows.join(if_small(many)[0], F.col(name) == F.col("_many"), "left_semi").dropDuplicates([name])
    equal = equal.join(if_small(taken)[0], F.col(name) == F.col("_told_row")).select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias(nth)).drop(nth)
    return out.unionByName(equal)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row that is left; a null text has no tokens, rows that repeat each get a row."""
    return bpe.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
