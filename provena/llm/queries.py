"""The opN_ queries: each operator over its whole table with production parameters, and the SQL they are held against."""
from __future__ import annotations

from pyspark.sql import functions as F

from provena.llm import bpe, exact_dedup, mixing, mpeg_ts, near_dedup, pii, quality, sharding, toxicity, url_filter
from provena.llm.common import documents, durable, labels


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir), with_hash=True)


def op2_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).withColumn("by_shard", F.array_join("by_shard", ","))


def op3_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op4_mpeg_ts(spark, sf_dir):
    return mpeg_ts.digests(mpeg_ts.read_media(mpeg_ts.write_media(documents(spark, sf_dir))))


def op5_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_quality(spark, sf_dir):
    return quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_pii(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = pii.find_pii(docs, durable(pii.revealing_terms(docs), "pii-terms"))
    return found.withColumn("sanitised_sha256", F.sha2("sanitised", 256)).drop("sanitised")


def op8_url_filter(spark, sf_dir):
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rule_table(spark))


def op9_sharding(spark, sf_dir):
    return sharding.balanced_shards(documents(spark, sf_dir))


def op10_bpe(spark, sf_dir):
    return bpe.encode_documents(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_near_dedup, op4_mpeg_ts, op5_toxicity, op6_quality, op7_pii, op8_url_filter, op9_sharding, op10_bpe)}
ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE, "op2_mixing": mixing.oracle(), "op8_url_filter": url_filter.ORACLE}
