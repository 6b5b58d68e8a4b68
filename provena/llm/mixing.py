"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from provena.llm.common import durable, if_small, running_total, words

#: Weights by the source's rank in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source's target exceeds this many times its size.
EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes has one row per source: src (not null), no_src (true for the null source), source_size. Adds target.

    Targets share the sum of all sizes by weight; none exceeds epochs times its size and the excess is shared again
    by weight among the rest. Sources fill in the order of cap / weight, so the fixed point has a closed form:
    a source is capped if, with all earlier ones capped, its share of what remains would reach its cap. The sums are
    exact integers. The windows run over one row per source, after aggregation.
    """
    rank = F.row_number().over(W.orderBy("no_src", "src")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    fill = W.orderBy(F.col("cap").cast("double") / F.col("weight"), "no_src", "src")
    every = W.partitionBy()
    out = out.withColumn("_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("_weights", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    out = out.withColumn("_total", F.sum("source_size").over(every))
    left = F.col("_total") - F.col("_before")
    out = out.withColumn("_capped", left.cast("double") * F.col("weight") >= F.col("cap").cast("double") * F.col("_weights"))
    # the first source that is not capped fixes the level for all from there on
    out = out.withColumn("_left", F.first(F.when(~F.col("_capped"), left), True).over(fill.rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("_share", F.first(F.when(~F.col("_capped"), F.col("_weights")), True).over(fill.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("_left").isNull(), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("_left")).cast("double") / F.col("_share"))
    return out.select("src", "no_src", "source_size", "weight", target.alias("target"))


def apportion(targets: DataFrame, block_tokens: int, shards: int) -> DataFrame:
    """Integer quotas of blocks per source and shard: src, no_src, source_size, target, seats array<long> (cumulative by shard).

    Sainte-Lague gives seat k of a source the quotient target / (2k - 1); the highest quotients win. It is house
    monotone, so the blocks of the first s shards are an apportionment too and a shard's quota is the difference of
    two. Of the many quotients only those near the divisor can be in doubt: with n sources and B blocks the divisor
    lies between T / (B + n/2) and T / (B - n/2), so seats below are certain and about 2n quotients are ranked.
    """
    t = targets.crossJoin(targets.agg(F.sum("target").alias("_t"), F.count("*").alias("_n"), F.sum("source_size").alias("_words")))  # one row
    t = t.withColumn("_blocks", F.round(F.col("_words") / F.lit(block_tokens)).cast("long"))
    t = t.withColumn("_shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    t = t.withColumn("_house", F.floor(F.col("_blocks") * F.col("_shard") / F.lit(shards)).cast("long"))
    seats = lambda house: F.floor(F.col("target") * house / F.col("_t") + 0.5)
    low = F.when((F.col("_t") > 0) & (F.col("_house") > F.col("_n") / 2 + 1), F.greatest(F.lit(0), seats(F.col("_house") - F.col("_n") / 2 - 1))).otherwise(0).cast("long")
    high = F.when(F.col("_t") > 0, seats(F.col("_house") + F.col("_n") / 2 + 1)).otherwise(0).cast("long")
    t = t.withColumn("_low", low).withColumn("_high", F.greatest(low, high))
    key = ["src", "no_src"]
    doubt = t.where("_high > _low").select(*key, "_shard", "_house", "target", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    ranked = doubt.withColumn("_rank", F.row_number().over(W.partitionBy("_shard").orderBy((F.col("target") / (2 * F.col("_k") - 1)).desc(), "no_src", "src", "_k")))
    sure = t.groupBy("_shard").agg(F.sum("_low").alias("_sure"))
    won = ranked.join(sure, "_shard").where(F.col("_rank") <= F.col("_house") - F.col("_sure")).groupBy(*key, "_shard").agg(F.count("*").alias("_won"))
    out = t.join(won, [*key, "_shard"], "left").withColumn("_seats", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.groupBy(*key, "source_size", "target").agg(F.array_sort(F.collect_list(F.struct("_shard", "_seats"))).getField("_seats").alias("seats"))


def mix(docs: DataFrame, block_tokens: int = 16, shards: int = 8, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, by_shard array<long>; and the columns `carry` of the row.

    size counts words; null and empty texts have 0 and are taken 0 times. A null source is a source of its own, last
    in order. Each source's documents stand in the order of md5(seed:doc_id); its words in that order form blocks of
    block_tokens. The source's quota of blocks is taken from the front, as often around as it needs, so a document
    is taken whole, the same number of times or once more, but for the one where the quota ends. Shard s takes the blocks from the end of
    the quotas of the shards before it to the end of its own, going around; by_shard has the words of the document that each takes
    (their sum is taken). Reruns agree; rows that repeat an id are
    interchangeable. An empty table gives no rows. Other columns are ignored.

    Texts are read once and never shuffled. Positions in a hot source come from per-bucket sums. Per-source windows run on one
    row per source.
    """
    src = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(src, F.lit("")).alias("src"), src.isNull().alias("no_src"), words(F.col(text_col)).alias("size"), *carry)
    more = rows.columns[4:]
    rows = rows.withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    rows = durable(rows.withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")), "mix-sizes")
    key = ["src", "no_src"]
    sizes = rows.groupBy(*key).agg(F.sum("size").alias("source_size"))
    quotas, _ = if_small(durable(apportion(source_targets(sizes, weights, epochs), block_tokens, shards), "mix-quotas"))
    placed = running_total(rows, key, "_bucket", ["_order", "size"], {"_start": "size"})
    out = placed.join(quotas, key)
    total = F.col("source_size")

    def words_before(due: Column) -> Column:
        """Words of the document among the first `due` words that the source gives, going around."""
        rounds = F.floor(due / F.greatest(total, F.lit(1)))
        return F.when(total > 0, rounds * F.col("size") + F.greatest(F.lit(0), F.least(due - rounds * total - F.col("_start"), F.col("size")))).otherwise(0).cast("long")

    upto = F.transform(F.concat(F.array(F.lit(0).cast("long")), "seats"), lambda c: words_before(F.least(c * block_tokens, total * epochs)))
    out = out.withColumn("_upto", upto)
    shard_words = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.element_at("_upto", s + 1) - F.element_at("_upto", s))
    return out.select("doc_id", "size", "source_size", "target", F.element_at("_upto", -1).alias("taken"), shard_words.alias("by_shard"), *more)


def oracle(block_tokens: int = 16, shards: int = 8, seed: int = 1) -> str:
    """The contract's columns in DuckDB SQL, for the whole table: quotients of every seat are ranked."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
             md5('{seed}:' || doc_id::VARCHAR) AS o FROM documents),
s0 AS (SELECT src, no_src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
s AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY no_src, src) - 1) % 3 + 1] AS w FROM s0),
c AS (SELECT *, 3 * source_size AS cap, (SELECT sum(source_size) FROM s) AS total FROM s),
f AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, no_src, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
        sum(w) OVER (ORDER BY cap::DOUBLE / w, no_src, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM c),
g AS (SELECT *, remain::DOUBLE * w >= cap::DOUBLE * ws AS capped FROM f),
lv AS (SELECT remain AS r0, ws AS w0 FROM g WHERE NOT capped ORDER BY cap::DOUBLE / w, no_src, src LIMIT 1),
t AS (SELECT src, no_src, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (w * r0)::DOUBLE / w0 END AS target, round(total / {block_tokens})::BIGINT AS blocks
      FROM g LEFT JOIN lv ON true),
q AS (SELECT src, no_src, target / (2 * k - 1) AS quotient, k, blocks FROM (SELECT *, unnest(range(1, (ceil(target / {block_tokens}) + 3 + (SELECT count(*) FROM s))::BIGINT)) AS k FROM t WHERE target > 0)),
rk AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, no_src, src, k) AS rk FROM q),
sh AS (SELECT unnest(range(0, {shards + 1})) AS shard),
won AS (SELECT t.src, t.no_src, list(least(seats * {block_tokens}, 3 * source_size) ORDER BY shard) AS dues
        FROM (SELECT t.src, t.no_src, t.source_size, shard, count(rk) AS seats FROM t CROSS JOIN sh LEFT JOIN rk ON rk.src = t.src AND rk.no_src = t.no_src AND rk.rk <= t.blocks * shard // {shards} GROUP BY ALL) AS t GROUP BY ALL),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, won.dues,
        coalesce(sum(d.size) OVER (PARTITION BY d.src, d.no_src ORDER BY o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t USING (src, no_src) JOIN won USING (src, no_src)),
z AS (SELECT *, list_transform(dues, lambda due: CASE WHEN source_size > 0
        THEN due // source_size * size + greatest(0, least(due % source_size - start, size)) ELSE 0 END::BIGINT) AS upto FROM p)
SELECT doc_id, size, source_size, target, upto[{shards + 1}] AS taken,
       array_to_string(list_transform(range(1, {shards + 1}), lambda i: upto[i + 1] - upto[i]), ',') AS by_shard
FROM z"""
