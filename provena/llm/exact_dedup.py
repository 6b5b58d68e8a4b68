"""Exact deduplication by progressive refinement: length, then a prefix's hash, then the hash of the whole text."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from provena.llm.common import if_small


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, with_hash: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept (and text_sha256 with with_hash).

    Texts are equal when identical; a null text counts as empty. The largest id of a group stays. Rows that repeat
    an id together with its text are one document: each row is returned and gets the same answer, and each counts in
    group_size. A null id never stays beside other ids; alone it stays (keep_id null). An empty table gives no rows.
    Other columns of docs are ignored.

    Only rows whose (length, prefix hash) occurs again have their whole text hashed. Lengths and prefix hashes are
    counted with map-side partial sums; texts themselves are never shuffled. Where the surviving groups are too many
    to broadcast, the hash is taken in the scan and narrow rows are joined by shuffle, whose hot keys AQE splits.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id", "_t", F.octet_length("_t").cast("long").alias("_len"), F.xxhash64(F.substring("_t", 1, prefix_chars)).alias("_pre"))
    lengths, _ = if_small(base.groupBy("_len").count().where("count > 1").select("_len"))
    narrow = base.select("_len", "_pre")
    prefixes = narrow.join(lengths, "_len", "left_semi").groupBy("_len", "_pre").count().where("count > 1").select("_len", "_pre")
    prefixes, small = if_small(prefixes)
    digest = F.unhex(F.sha2("_t", 256))
    if small:
        rows = base.join(prefixes.withColumn("_again", F.lit(True)), ["_len", "_pre"], "left")
        rows = rows.withColumn("_sha", F.when(F.col("_again"), digest))
    else:
        rows = base.withColumn("_sha", digest)
    hashed = [F.sha2("_t", 256).alias("text_sha256")] if with_hash else []
    rows = rows.select("doc_id", "_len", "_sha", *hashed)
    groups = rows.where("_sha is not null").groupBy("_len", "_sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups, _ = if_small(groups)
    out = rows.join(groups, ["_len", "_sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), *(["text_sha256"] if with_hash else []))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
