"""Sharding by balanced label propagation: linked documents move to their neighbours' shards under capacity quotas."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provena.llm.common import durable, if_small, running_total

#: A propagation round moves documents only while their new shard holds at most this share of the mean load.
CAPACITY = 1.0
#: Propagation ends when nothing moves, at the latest after this many rounds (each round only lowers the cut).
ROUNDS = 8
#: A shard with less room than this share of the mean load counts as full.
SLACK = 0.02
BUCKETS = 1024
#: A hub's wishes are spread over this many buckets, as one hub may hold a third of all rows.
SALTS = 64


def _loads(rows: DataFrame, shards: int) -> list[int]:
    """Bytes in each shard; the driver gets one number per shard."""
    got = {r["shard"]: r["load"] for r in rows.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    return [int(got.get(s) or 0) for s in range(shards)]


def _lookup(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def _fill(rows: DataFrame, room: list[int], shards: int) -> DataFrame:
    """Deal unlinked rows to shards in proportion to room: a row goes where the middle of its bytes falls on the line of all rooms."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    room = [max(0, r) for r in room]
    if not sum(room):
        room = [1] * shards
    ends, upto = [], 0
    for r in room[:-1]:
        upto += r
        ends.append(int(total * upto / sum(room)))
    placed = running_total(rows.withColumn("_all", F.lit(0)), ["_all"], "bucket", ["node"], {"_start": "size"})
    middle = F.col("_start") + F.floor(F.col("size") / 2)
    shard = sum((F.when(middle >= e, 1).otherwise(0) for e in ends), F.lit(0)) if ends else F.lit(0)
    return placed.select("node", "hub", "size", "bucket", shard.cast("int").alias("shard"))


def propagate(linked: DataFrame, shards: int, mean: float, rounds: int = ROUNDS, capacity: float = CAPACITY) -> DataFrame:
    """Label propagation on the graph of documents and the hubs that link them; linked has node, hub, size, bucket.

    A hub stands for all links among its documents, so that a group of n has n links and not n * n. Each round a hub
    sums its documents' bytes by shard; all want the heaviest shard that has room for the whole hub. Where none has,
    those outside the heavier shards want the heaviest that has any room, so a group larger than a shard is cut into
    few pieces. Wishes are granted in the order of hubs while the shard's quota lasts; the others wait for the next round.
    """
    rows = durable(linked.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")), "shard-start")
    for _ in range(rounds):
        loads = _loads(rows, shards)
        room = [x if x >= SLACK * mean else 0 for x in (int(capacity * mean) - y for y in loads)]
        votes = rows.groupBy("hub", "shard").agg(F.sum("size").alias("bytes"))
        spare = _lookup(room, F.col("shard"))
        whole = votes.groupBy("hub").agg(F.sum("bytes").alias("all"))
        votes = votes.join(whole, "hub")
        place = F.struct("bytes", (-F.col("shard")).alias("at"))
        best = votes.groupBy("hub").agg(F.max(F.when(spare >= F.col("all") - F.col("bytes"), place)).alias("whole"), F.max(F.when(spare > 0, place)).alias("part"))
        to = F.coalesce("whole.at", "part.at")
        wish = votes.join(best, "hub").withColumn("to", (-to).cast("int"))
        wish = wish.where(F.col("to").isNotNull() & (F.col("to") != F.col("shard")) & (F.col("whole").isNotNull() | (F.col("bytes") <= F.col("part.bytes")))).select("hub", "shard", "to")
        wish, _ = if_small(durable(wish, "shard-wishes"))
        movers = durable(rows.join(wish, ["hub", "shard"]).select("node", "hub", "size", "to", (F.pmod(F.xxhash64("hub"), F.lit(BUCKETS)) * SALTS + F.pmod(F.xxhash64("node"), F.lit(SALTS))).cast("int").alias("bucket")), "shard-movers")
        placed = running_total(movers, ["to"], "bucket", ["hub", "node"], {"_start": "size"})
        granted = durable(placed.where(F.col("_start") + F.col("size") <= _lookup(room, F.col("to"))).select("node", F.col("to")), "shard-moves")
        if granted.isEmpty():
            break
        granted, _ = if_small(granted)
        rows = durable(rows.join(granted, "node", "left").select("node", "hub", "size", "bucket", F.coalesce("to", "shard").alias("shard")), "shard-round")
    return rows


def balanced_shards(docs: DataFrame, links: DataFrame | None = None, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    links (doc_id, hub) links documents that share a hub; a document may be given one hub. By default equal texts are linked.
    Linked documents settle by label propagation; then unlinked ones fill every shard to the mean, the larger first
    and the smallest last, so loads end within about the size of a small document of each other. A null text has size 1
    and is equal to an empty one. Rows that repeat an id keep together only if their texts agree. slot counts 0, 1, ... within each
    shard. An empty table gives no rows. Other columns are ignored.

    The text is read once; everything after runs on narrow rows in the shared folder. Running totals and slots
    are taken per bucket and joined, never in one task per shard. The driver gets one number per shard.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.unhex(F.sha2(text, 256)).alias("hub"))
    # rows that repeat an id and text are one node in the links, but keep a row each
    base = base.withColumn("node", F.xxhash64("doc_id", "hub"))
    if links is not None:
        own = links.groupBy(F.col("doc_id")).agg(F.min(F.col("hub").cast("string").cast("binary")).alias("_hub"))
        base = base.join(own, "doc_id", "left").withColumn("hub", F.coalesce("_hub", "hub")).drop("_hub")
    base = durable(base.withColumn("bucket", F.pmod(F.col("node"), F.lit(BUCKETS)).cast("int")), "shard-base")
    nodes = base.groupBy("node").agg(F.first("hub").alias("hub"), F.sum("size").alias("size"), F.first("bucket").alias("bucket"))
    nodes = durable(nodes, "shard-nodes")
    total = nodes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    mean = total / shards
    hubs = nodes.groupBy("hub").count().where("count > 1").select("hub", F.lit(True).alias("_linked"))
    hubs, _ = if_small(hubs)
    nodes = durable(nodes.join(hubs, "hub", "left").withColumn("_linked", F.coalesce("_linked", F.lit(False))), "shard-linked")
    done = propagate(nodes.where("_linked").drop("_linked"), shards, mean)
    loads = _loads(done, shards)
    steps = [None, mean / 40, mean / 400, 0]
    for most, least in zip(steps, steps[1:]):
        tier = nodes.where(~F.col("_linked") & (F.col("size") > least) & (F.lit(True) if most is None else F.col("size") <= most)).drop("_linked")
        dealt = durable(_fill(tier, [int(mean - x) for x in loads], shards), "shard-tier")
        loads = [a + b for a, b in zip(loads, _loads(dealt, shards))]
        done = done.unionByName(dealt.select(done.columns))
    rows = base.join(done.select("node", "shard"), "node")
    rows = durable(rows.withColumn("_one", F.lit(1).cast("long")), "shard-rows")
    placed = running_total(rows, ["shard"], "bucket", ["node", "doc_id"], {"slot": "_one"})
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
