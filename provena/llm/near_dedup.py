"""Near-duplicate detection by Order MinHash (all k-mers of short texts); candidates verified by banded alignment of words."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm.common import by_shuffle, durable, forget, if_small, small_batches

#: Words in a k-mer, k-mers in a key (kept in the order of the text) and keys of a text.
MER, PICKS, BANDS = 2, 2, 32
#: Texts of up to EXACT words are keyed by all of their k-mers of SHORT_MER words, those of more than PLAIN also by bands. Texts of
#: which one has at most PLAIN words are alike only if the other has at most EXACT.
SHORT_MER, EXACT, PLAIN = 3, 48, 38
#: Documents are linked if 1 - (word edits) / (words of the longer) is at least this.
SIMILARITY = 0.8
#: Counters of a text's words by hash. They never differ by more than the words do, so a pair they tell apart is apart.
BAG = 128
#: A bucket is compared in blocks of about this many members, and of about this many bytes of words.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Blocks of up to this many members are compared many at once.
SMALL = 32
#: Labels are broadcast up to this many rows; a shuffle of such narrow rows costs little, and the driver holds what is broadcast.
SENT = 20_000
#: Counters of a bag where words are at hand: nearly all that differs shows.
WIDE_BAG = 1024

_SEEDS, _ODD = np.random.default_rng(7).integers(1, 2**63, (2, BANDS), dtype=np.uint64) | np.array([[0], [1]], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LAST = np.uint64(2**64 - 1)


def normal(text: str | None) -> bytes:
    """UTF-8 words in ASCII lower case with single spaces; words end at ASCII white space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a normalised text."""
    if not raw:
        return np.empty(0, np.uint64)
    a = np.frombuffer(raw, np.uint8)
    start = np.concatenate([[0], np.flatnonzero(a == 32) + 1])
    length = np.diff(np.append(start, len(a) + 1))
    place = np.arange(len(a)) - np.repeat(start, length)[: len(a)]
    power = np.cumprod(np.concatenate([[1], np.full(int(length.max()), 0x100000001B3)]).astype(np.uint64))
    value = np.where(a == 32, 0, a.astype(np.uint64) + np.uint64(1))
    return _mix(np.add.reduceat(value * power[place], start))


def _mers(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    mer = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        mer = mer * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return _mix(mer + np.uint64(k))


def _labelled(mer: np.ndarray) -> np.ndarray:
    """k-mers in text order, each mixed with how often it came before, so that repeated ones count as often as they stand."""
    order = np.argsort(mer, kind="stable")
    run = mer[order]
    fresh = np.append(True, run[1:] != run[:-1])[: len(run)]
    if fresh.all():
        return mer
    at = np.arange(len(run))
    again = at - np.maximum.accumulate(np.where(fresh, at, 0))
    out = mer.copy()
    out[order] = np.where(again > 0, _mix(run + again.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), run)
    return out


def bucket_keys(words: np.ndarray) -> np.ndarray:
    """Keys of a text's word hashes, of which texts that are alike share one.

    Up to EXACT words they are all k-mers of SHORT_MER words: of k-mers of equal length one more than there may be edits, one is left
    whole, and of 0.2 edits a word it has SHORT_MER words (2 if the longer text has 5). Longer texts have an Order MinHash: each of BANDS hashes
    picks the PICKS smallest occurrence-labelled k-mers, and the key is those in the order of the text. Of the 2-mers of two texts
    with a fifth of the words replaced, at least 0.43 are common even if the edits are spread evenly, so two picks agree with a chance of 0.18
    or more and no key agrees with one of at most 0.82 ** 32 = 0.002.
    """
    n = len(words)
    keys = [band_keys(words)]
    if n <= EXACT:
        keys += [np.unique(_mers(words, SHORT_MER)), *([np.unique(_mers(words, 2))] if 4 <= n <= 5 else [])]
    return np.concatenate(keys).view(np.int64)


def band_keys(words: np.ndarray) -> np.ndarray:
    """The key of each band, for texts of more than PLAIN words."""
    if len(words) <= PLAIN:
        return np.empty(0, np.uint64)
    mer = _labelled(_mers(words, MER))
    keys = []
    step = max(1, min(BANDS, 50_000 // len(mer)))
    for at in range(0, BANDS, step):
        seeds = _SEEDS[at : at + step]
        v = (mer[None, :] ^ seeds[:, None]) * _ODD[at : at + step, None]
        rows, picks = np.arange(len(seeds)), []
        for _ in range(PICKS):
            picks.append(v.argmin(axis=1))
            v[rows, picks[-1]] = _LAST
        key = seeds
        for p in np.sort(picks, axis=0):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + mer[p])
        keys.append(key)
    return np.concatenate(keys)


def short_hashes(words: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash: what texts are aligned by."""
    return (words >> np.uint64(32)).astype("<u4")


def word_bag(seq: np.ndarray, counters: int = BAG) -> np.ndarray:
    return np.minimum(np.bincount((seq >> np.uint32(8)) % np.uint32(counters), minlength=counters), 255).astype(np.uint8)


def edit_distance(a: list, b: list, most: int) -> int:
    """Edits (insert, delete, replace) between two sequences, or most + 1 if there are more.

    Bit-parallel within the band of `most` diagonals to either side: at element j of b the bits of a whole number stand for the
    elements j - most to j + most of a, and hold where the distance rises (up) or falls (down) from one to the next.
    """
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m or not most:
        return min(max(n, m), most + 1)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, edge = (1 << 2 * most + 1) - 1, 1 << 2 * most
    up, down = every ^ ((1 << most) - 1), 0
    score = min(n, most)  # follows the lower edge of the band until it meets the end of a, then that row
    turn = n - most
    for j, y in enumerate(b, 1):
        same = at.get(y, 0)
        shift = j - most - 1
        same = (same >> shift if shift > 0 else same << -shift) & every
        level = ((((same & up) + up) ^ up) | same | down) & every
        rise = down | (every & ~(level | up))
        fall = level & up
        if j <= turn:
            score += not level & edge
            if score > 3 * most + m - n:
                return most + 1
        else:
            bit = 1 << n - j + most
            score += bool(rise & bit) - bool(fall & bit)
            if score - (m - j) > most:
                return most + 1
        up = fall | (every & ~(level >> 1 | rise))
        down = level >> 1 & rise
    return min(score, most + 1)


def allowed(long: int, least: float) -> int:
    return int((1 - least) * long + 1e-9)


def similar(x: list, y: list, least: float = SIMILARITY) -> bool:
    """Whether two sequences of words agree in at least `least` of the longer one under the best alignment."""
    most = allowed(max(len(x), len(y)), least)
    return abs(len(x) - len(y)) <= most and edit_distance(x, y, most) <= most


def _told_apart(words_a, words_b, bags_a, bags_b, least: float):
    """Of rows of two tables side by side: whether sizes or bags show more edits than are allowed, and how far the bags are apart."""
    long, both = np.maximum(words_a, words_b), words_a + words_b
    most = ((1 - least) * long + 1e-9).astype(np.int64)
    apart = (np.maximum(bags_a, bags_b) - np.minimum(bags_a, bags_b)).sum(axis=1, dtype=np.int32)
    return (2 * long - both > most) | (apart > both - 2 * (long - most)), apart


def open_pairs(words, bags, ends, upper, alone, label, least: float):
    """Yields (i, j, apart): rows of one block, of different labels, that are not told apart; each pair once.

    Rows stand block by block, blocks end at `ends`. A block that is not `alone` pairs its upper rows with the others only.
    """
    chunk = 2_097_152 // bags.shape[1]
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    block = np.repeat(np.arange(len(ends)), sizes)
    small = np.flatnonzero((alone & (sizes <= SMALL))[block]) if len(ends) else np.empty(0, np.int64)
    for step in range(1, int(sizes[block[small]].max()) if len(small) else 0):
        i = small[small + step < len(block)]
        j = i + step
        keep = (block[i] == block[j]) & (label[i] != label[j])
        i, j = i[keep], j[keep]
        for cut in range(0, len(i), chunk):
            p, q = i[cut : cut + chunk], j[cut : cut + chunk]
            told, apart = _told_apart(words[p], words[q], bags[p], bags[q], least)
            yield p[~told], q[~told], apart[~told]
    for k in np.flatnonzero(~(alone & (sizes <= SMALL))):
        rows = np.arange(starts[k], ends[k])
        a, b = (rows, rows) if alone[k] else (rows[~upper[rows]], rows[upper[rows]])
        if not len(a) or not len(b):
            continue
        names, count = np.unique(label[rows], return_counts=True)
        if len(names) == 1:
            continue
        main = label == names[count.argmax()]  # a pair of different labels has a row outside the main one; labels may change meanwhile
        for x, y in ((a[~main[a]], b),) if alone[k] else ((a[~main[a]], b), (b[~main[b]], a[main[a]])):
            for at in range(0, len(x), 64):
                z = x[at : at + 64]
                fit = np.abs(words[z][:, None] - words[y][None, :]) <= (1 - least) * np.maximum(words[z][:, None], words[y][None, :]) + 1e-9
                fit &= label[z][:, None] != label[y][None, :]
                if alone[k]:
                    fit &= main[y][None, :] | (z[:, None] < y[None, :])
                i, j = np.nonzero(fit)
                for cut in range(0, len(i), chunk):
                    p, q = z[i[cut : cut + chunk]], y[j[cut : cut + chunk]]
                    told, apart = _told_apart(words[p], words[q], bags[p], bags[q], least)
                    yield p[~told], q[~told], apart[~told]


def _blocks(batches, columns: list[str]):
    """Tables of whole blocks (rows that agree in `columns`, which the batches are sorted by), with the ends of the blocks."""
    kept = None
    for batch in batches:
        here = pa.Table.from_batches([batch])
        kept = here if kept is None else pa.concat_tables([kept, here])
        ids = np.stack([kept.column(c).to_numpy().astype(np.int64) for c in columns])
        ends = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        if len(ends):  # the last block may go on in the next batch
            yield kept.slice(0, ends[-1]), ends
            kept = kept.slice(ends[-1])
    if kept is not None and kept.num_rows:
        yield kept, np.array([kept.num_rows])


def _names(table, column: str) -> np.ndarray:
    """A column of 16-byte names as an array of them."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), "S16")


def _flags(table, column: str) -> np.ndarray:
    return np.array(table.column(column).to_pylist(), bool)


_OPEN = ["key", "lo", "hi", "upper", "node", "n_words"]


def _open_members(least: float):
    """A function for mapInArrow over blocks with bags: the rows that have others of another label in their block which sizes and bags don't tell apart.

    Rows without labels are each of its own. lead is one of these others: the smallest of those that the bags show half the edits that are allowed, or less, else the nearest. large
    says whether the block has over SMALL rows.
    """
    def run(batches):
        for table, ends in _blocks(batches, ["key", "lo", "hi"]):
            n = table.num_rows
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            rank = np.array(table.column("node").to_pylist(), object).argsort().argsort()
            label = np.unique(_names(table, "label"), return_inverse=True)[1]
            words, bags = table.column("n_words").to_numpy().astype(np.int64), np.frombuffer(b"".join(table.column("bag").to_pylist()), np.uint8).reshape(n, -1)
            first = ends - 1
            best = np.full(n, np.iinfo(np.int64).max)
            for i, j, apart in open_pairs(words, bags, ends, _flags(table, "upper"), lo[first] == hi[first], label, least):
                long = np.maximum(words[i], words[j])
                room = words[i] + words[j] - 2 * (long - ((1 - least) * long + 1e-9).astype(np.int64))
                far = np.where(2 * apart <= room, 0, (1 + apart.astype(np.int64)) * n)
                np.minimum.at(best, i, far + rank[j])
                np.minimum.at(best, j, far + rank[i])
            found = np.flatnonzero(best < np.iinfo(np.int64).max)
            where = np.empty(n, np.int64)
            where[rank] = np.arange(n)
            lead = table.column("node").take(pa.array(where[best[found] % n]))
            size = np.diff(np.append(0, ends))
            large = pa.array(np.repeat(size > SMALL, size)[found])
            yield from table.select([*_OPEN, "label"]).take(pa.array(found)).append_column("lead", lead).append_column("large", large).to_batches(max_chunksize=4096)

    return run


_OPEN_DDL = "key long, lo int, hi int, upper boolean, node binary, n_words int, label binary, lead binary, large boolean"


def neighbours(members: DataFrame, least: float) -> DataFrame:
    """key, lo, hi, upper, node, n_words, lead (see _open_members) of the members of a bucket that have others in a block which sizes and bags don't tell apart.

    members: key, n (size of the bucket), node (16 bytes), n_words, bag. A bucket is dealt out as pairs of blocks. One row for a member and block, however
    many pairs there are.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("_own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), (F.col("_own") > F.col("_other")).alias("upper"), "node", F.col("node").alias("label"), "n_words", "bag")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(_open_members(least), _OPEN_DDL).select(*_OPEN, "lead")


def distinct_blocks(near: DataFrame) -> DataFrame:
    """The rows of near without those of small blocks (up to SMALL members) that have the same members as another."""
    at = ["key", "lo", "hi"]
    alone = F.col("lo") == F.col("hi")
    sums = near.groupBy(*at).agg(F.bit_xor(F.xxhash64("node", "upper")).alias("_one"), F.bit_xor(F.xxhash64("upper", "node")).alias("_two"), F.count("*").alias("_n"), F.sum("n_words").alias("_words"))
    small = durable(sums.where(F.col("_n") <= SMALL), "near-small")
    firsts = small.groupBy("_one", "_two", "_n", "_words", alone.alias("_alone")).agg(F.min(F.struct(*at)).alias("at")).select("at.*")
    return near.join(by_shuffle(small.select(*at).join(by_shuffle(firsts), at, "left_anti")), at, "left_anti")


def refined(near: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The rows of near (key, lo, hi, upper, node, n_words, label) that wide bags don't tell apart from all others of another label in their block, with large and lead (see _open_members).

    Names are hashes, so the members of a group of near copies mostly agree on a lead. words: node, wide.
    """
    rows = near.join(by_shuffle(words.select("node", F.col("wide").alias("bag"))), "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return rows.mapInArrow(_open_members(least), _OPEN_DDL)


def led(near: DataFrame) -> DataFrame:
    """a, b: one pair for each node of near, with the smallest lead over its blocks, which a group of near copies mostly has in common."""
    return near.groupBy("node").agg(F.min("lead").alias("lead")).select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def unconnected(near: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of near, with the label of their node, in blocks whose members carry more labels than one. A node that label does not name is its own."""
    at = ["key", "lo", "hi"]
    named = near.join(by_shuffle(label.withColumnRenamed("node", "_node")), F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("label", "node")).drop("_node")
    named = durable(named, "near-named")
    apart = named.groupBy(*at).agg(F.min("label").alias("_least"), F.max("label").alias("_most")).where("_least != _most")
    out = durable(named.join(by_shuffle(apart.select(*at)), at, "left_semi"), "near-unconnected")
    forget(named)
    return out


def verify(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs (a, b) of nodes that are similar. words: node, seq."""
    both = pairs.join(by_shuffle(words.select(F.col("node").alias("a"), F.col("seq").alias("_x"))), "a").join(by_shuffle(words.select(F.col("node").alias("b"), F.col("seq").alias("_y"))), "b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                p = batch.slice(at, 256)
                ok = [similar(np.frombuffer(x, "<u4").tolist(), np.frombuffer(y, "<u4").tolist(), least) for x, y in zip(p.column("_x").to_pylist(), p.column("_y").to_pylist())]
                yield p.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "_x", "_y").mapInArrow(run, "a binary, b binary")


def join_blocks(members: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """a, b: links between members of a block that carry different labels; as many as join all that alignment shows to be connected.

    members: key, lo, hi, upper, large, node, n_words, label; words: node, seq, bands. Of the pairs of a block the nearest by their bags are aligned first, and a
    pair that is connected by then is not aligned, so no more links come out than a block has members, and none between two labels is passed over.
    In large blocks a pair is left to the block of the first band that both texts share. Blocks are divided where their words are many.
    """
    at = ["key", "lo", "hi"]
    alone = F.col("lo") == F.col("hi")
    sums = members.groupBy(*at).agg(F.min("label").alias("_least"), F.max("label").alias("_most"), F.sum("n_words").alias("_words")).where("_least != _most")
    rows = members.join(by_shuffle(sums.select(*at, F.greatest(F.lit(1), F.ceil(F.col("_words") * 4 / BLOCK_BYTES)).cast("int").alias("_cuts"))), at)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_cuts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
    # a block cut in parts: pairs of parts, with sides by part if the block was one, else each upper part with each other
    rows = rows.select(F.xxhash64(*at).alias("block"), F.when(alone, F.least("_own", "_other")).when(F.col("upper"), F.col("_other")).otherwise(F.col("_own")).alias("lo"),
                       F.when(alone, F.greatest("_own", "_other")).when(F.col("upper"), F.col("_own")).otherwise(F.col("_other")).alias("hi"),
                       F.when(alone, F.col("_own") > F.col("_other")).otherwise(F.col("upper")).alias("upper"), alone.alias("one"), "large", "key", "node", "label")
    rows = rows.join(by_shuffle(words.select("node", "seq", "bands")), "node").repartition("block", "lo", "hi").sortWithinPartitions("block", "lo", "hi")

    def run(batches):
        for table, ends in _blocks(batches, ["block", "lo", "hi"]):
            node, n = table.column("node").to_pylist(), table.num_rows
            seqs = [np.frombuffer(x, "<u4") for x in table.column("seq").to_pylist()]
            lists: list = [None] * n
            label = np.unique(_names(table, "label"), return_inverse=True)[1]
            lo, hi, one, large, key = table.column("lo").to_numpy(), table.column("hi").to_numpy(), _flags(table, "one"), _flags(table, "large"), table.column("key").to_numpy()
            # texts without bands share none
            bands = np.stack([np.frombuffer(x, "<i8") if x else np.full(BANDS, -1 - k, np.int64) for k, x in enumerate(table.column("bands").to_pylist())])
            first = ends - 1
            a, b = [], []
            for i, j, apart in open_pairs(np.array([len(s) for s in seqs], np.int64), np.stack([word_bag(s, WIDE_BAG) for s in seqs]), ends, _flags(table, "upper"), one[first] & (lo[first] == hi[first]), label, least):
                same = bands[i] == bands[j]
                own = ~large[i] | ~same.any(axis=1) | (bands[i, same.argmax(axis=1)] == key[i])
                i, j, apart = i[own], j[own], apart[own]
                for k in np.argsort(apart, kind="stable").tolist():
                    p, q = int(i[k]), int(j[k])
                    if label[p] == label[q]:
                        continue
                    for x in (p, q):
                        lists[x] = lists[x] or seqs[x].tolist()
                    if similar(lists[p], lists[q], least):
                        label[label == label[q]] = label[p]
                        a.append(node[p])
                        b.append(node[q])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label of the nodes of edges (a, b): label is the smallest node that is connected.

    Every node points to its smallest neighbour if that is smaller than itself; pointers are followed to their
    ends by joins of the node table with itself, then edges are contracted to labels and those within one label dropped. Repeats until
    no edge is left. Only the first contraction joins all edges.
    """
    left = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-edges")
    total = None
    while True:
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        at = durable(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("label")), "near-pointers")
        while True:
            further = at.select(F.col("node").alias("label"), F.col("label").alias("further"))
            jumped = durable(at.join(if_small(further, SENT)[0], "label", "left").select("node", "label", F.coalesce("further", "label").alias("further")), "near-pointers")
            at = jumped.select("node", F.col("further").alias("label"))
            if jumped.where("further != label").isEmpty():
                break
        if total is None:
            total = at
        else:
            total = total.join(if_small(at.select(F.col("node").alias("label"), F.col("label").alias("further")), SENT)[0], "label", "left")
            total = durable(total.select("node", F.coalesce("further", "label").alias("label")), "near-labels")
        small, _ = if_small(at, SENT)
        left = left.join(small.select(F.col("node").alias("a"), F.col("label").alias("a2")), "a").join(small.select(F.col("node").alias("b"), F.col("label").alias("b2")), "b")
        left = durable(left.where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "near-edges")
        if left.isEmpty():
            return total


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", with_md5: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, class_id, cluster_id, kept (and text_md5, 16 bytes, with with_md5).

    class_id is the smallest id with the same words (ASCII lower case, any white space); cluster_id the smallest id that is
    connected by links between classes; kept marks that document (all its rows, if rows repeat an id with its words). Two classes are linked if they share a
    key and their words align with similarity `least` (0.8 or more) or more. Texts of fewer than 4 words, empty and null ones are linked by
    equality alone. Classes are told by their words, so rows that repeat an id with other words are documents of their own. A null id is in the class of its
    text, never kept beside other ids. An empty table gives no rows. Other columns are ignored.

    Copies are reduced to one class before any pairing. A member of a bucket is first aligned with one other that sizes and bags of words
    don't tell from it, the same for all of a group, which joins most groups. What is left is told apart by wider bags and aligned with one
    of another group in the same way. Then the blocks whose members are not yet all connected are
    gone through pair by pair within a task, so no link between members is passed over and no more rows are made than there are members.
    Links, labels and words stay distributed: a side is broadcast only after a count, however small Spark takes it to be.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_md5"), text.alias("text"))

    def sketch(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                p = batch.slice(at, 256)
                raw = [normal(t) for t in p.column("text").to_pylist()]
                words = [word_hashes(r) for r in raw]
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("text_md5"), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array([bucket_keys(w) for w in words], pa.list_(pa.int64())),
                                                  pa.array([len(w) for w in words], pa.int32()), pa.array([word_bag(short_hashes(w)).tobytes() for w in words], pa.binary())], ["doc_id", "text_md5", "node", "keys", "n_words", "bag"])

    base = durable(rows.mapInArrow(sketch, "doc_id long, text_md5 binary, node binary, keys array<long>, n_words int, bag binary"), "near-sketch")
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("row")  # the smallest id, null last
    one = [F.first(c).alias(c) for c in ("keys", "n_words", "bag")]  # equal in all rows of a class
    classes = durable(base.groupBy("node").agg(least_row, *one).select("node", F.xxhash64("node").alias("name"), F.col("row.doc_id").alias("class_id"), F.col("row.text_md5").alias("text_md5"), "keys", "n_words", "bag"), "near-classes")
    # by short names: should two classes share one, a bucket gets a member too many
    keyed = classes.select("name", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(by_shuffle(shared), "key").join(by_shuffle(classes.select("name", "node", "n_words", "bag")), "name").drop("name")
    opened = durable(neighbours(members, least), "near-open")
    near = durable(distinct_blocks(opened), "near-blocks")
    forget(opened)
    wanted = durable(near.select("node").distinct().join(by_shuffle(classes), "node").select("node", "class_id", "text_md5"), "near-wanted")
    words = durable(words_of(rows, wanted), "near-words")
    if words.count() > wanted.count():  # rows that repeat an id with its text
        words = durable(words.groupBy("node").agg(*[F.first(x).alias(x) for x in ("seq", "bands", "wide")]), "near-words")
    # blocks that the first leads connect are done: only the rest is joined with the wide bags, and with the words after that
    pairs = durable(led(near), "near-pairs")
    links = durable(verify(pairs, words, least), "near-links")
    label = components(links)
    left = unconnected(near.drop("lead"), label)
    named = durable(refined(left, words, least), "near-refined")
    forget(near, wanted, left)
    others = durable(led(named), "near-pairs")
    again = durable(verify(others, words, least), "near-links")
    every = links.unionByName(again)
    if not again.isEmpty():
        label = components(every)
        renamed = label.select(F.col("node").alias("_old"), F.col("label").alias("_new"))  # a label is a node of its own group
        named = durable(named.join(by_shuffle(renamed), F.col("label") == F.col("_old"), "left").withColumn("label", F.coalesce("_new", "label")).drop("_old", "_new"), "near-relabelled")
    more = durable(join_blocks(named, words, least).distinct(), "near-links")
    if not more.isEmpty():
        label = components(every.unionByName(more))
    known = classes.select("node", "class_id").join(by_shuffle(label), "node", "left").select("node", "class_id", F.coalesce("label", "node").alias("label"))
    first = F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "node")).alias("first")
    groups = known.join(by_shuffle(label.select("label").distinct()), "label", "left_semi").groupBy("label").agg(first).select("label", "first.*")
    groups = groups.select("label", F.col("class_id").alias("cluster_id"), F.col("node").alias("keeper"))
    known = known.join(by_shuffle(groups), "label", "left")
    answer = durable(known.select("node", "class_id", F.when(F.col("keeper").isNull(), F.col("class_id")).otherwise(F.col("cluster_id")).alias("cluster_id"), (F.coalesce("keeper", "node") == F.col("node")).alias("keeps")), "near-answer")
    out = base.select("doc_id", "text_md5", "node").join(by_shuffle(answer), "node")
    forget(classes, pairs, others, words, links, again, named, more)
    return out.select("doc_id", "class_id", "cluster_id", (F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), *(["text_md5"] if with_md5 else []))


def words_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, seq (32 bits of each word's hash), bands (keys), wide (bag) of the wanted classes (node, class_id, text_md5), from the rows (doc_id, text_md5, text) that they name."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                p = batch.slice(at, 256)
                words = [word_hashes(normal(t)) for t in p.column("text").to_pylist()]
                short = [short_hashes(w) for w in words]
                yield pa.RecordBatch.from_arrays([p.column("node"), pa.array([x.tobytes() for x in short], pa.binary()), pa.array([band_keys(w).astype("<u8").tobytes() for w in words], pa.binary()),
                                                  pa.array([word_bag(x, WIDE_BAG).tobytes() for x in short], pa.binary())], ["node", "seq", "bands", "wide"])

    small, _ = if_small(wanted.withColumnRenamed("text_md5", "_md5"))
    there = rows.join(small, F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_md5") == F.col("_md5"))).select("node", "text")
    return there.mapInArrow(run, "node binary, seq binary, bands binary, wide binary")


def brute_force(texts: dict[int, str | None], least: float = SIMILARITY) -> dict[int, int]:
    """cluster_id by comparing all pairs of texts: for tests."""
    raw = {i: normal(t).split() for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if root(i) != root(j) and (raw[i] == raw[j] or similar(raw[i], raw[j], least)):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}
