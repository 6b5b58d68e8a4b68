"""Retrieval over many queries at once: a stored index, BM25, exact dense search, rank fusion, exact and near phrases, hybrid search."""
from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType

from provena.functions.text import LATIN, Profile, inner, key_tokens
from provena.sources.tables import spread, stored

# Constants of BM25 and of reciprocal-rank fusion, depth of the lists that are fused.
K1, B, EPSILON, RRF_K, DEPTH = 1.5, 0.75, 0.25, 60, 3
#: Queries are broadcast only if counted and no more than this.
BROADCAST_ROWS = 200_000
#: Numbers in the vectors of a tile of the dense search: of its queries and of its items.
TILE_QUERIES, TILE_ITEMS = 1 << 20, 1 << 22


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows. df should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_term_counts(df: DataFrame, words: str, name: str) -> DataFrame:
    """df with array<struct<term, tf>> of an array of words, by the runs of its sorted form: a record is one row, so nothing is shuffled.

    The sorted form and the starts of its runs are columns first, as what a lambda names is evaluated for every element.
    """
    df = df.withColumn("_sorted", F.array_sort(words))
    o, n = F.col("_sorted"), F.size("_sorted")
    df = df.withColumn("_starts", F.filter(F.transform(o, lambda w, i: F.when((i == 0) | (w != F.get(o, i - 1)), i)), lambda i: i.isNotNull()))
    ends = F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(n))
    counts = F.zip_with("_starts", ends, lambda i, j: F.struct(F.get(o, i).alias("term"), (j - i).cast("long").alias("tf")))
    return df.withColumn(name, F.when(n > 0, counts).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))).drop("_sorted", "_starts")


@dataclass(frozen=True)
class Index:
    """records: id, n_words, keys array<string>, terms array<struct<term, tf>>; vocabulary: term, df, idf; stats: one row of n_docs, avg_words."""
    records: DataFrame
    vocabulary: DataFrame
    stats: DataFrame
    id_col: str
    profile: Profile


def build_index(docs: DataFrame, id_col: str, text_col: str = "text", profile: Profile = LATIN) -> Index:
    """The index of a corpus: the only reading of its texts. Tables are stored in the shared folder; what reads them takes the columns it needs.

    Null texts have no words, repeated ids are records each. Terms in over half of the records get EPSILON times the mean idf.
    """
    words = spread(docs.select(id_col, text_col)).select(F.col(id_col), F.coalesce(key_tokens(F.col(text_col), profile), F.array().cast("array<string>")).alias("keys"))
    records = stored(with_term_counts(words.withColumn("n_words", F.size("keys")), "keys", "terms").select(id_col, "n_words", "keys", "terms"), "index-records")
    stats = records.agg(F.count("*").alias("n_docs"), F.avg("n_words").alias("avg_words"))
    df = records.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = stored(df.crossJoin(F.broadcast(stats.select("n_docs"))).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).drop("n_docs"), "index-terms")  # one row
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    vocabulary = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return Index(records, vocabulary, stats, id_col, profile)


def postings(index: Index) -> DataFrame:
    """id, n_words, term, tf. A text without words gives no rows."""
    return index.records.select(index.id_col, "n_words", F.explode("terms").alias("_t")).select(index.id_col, "n_words", "_t.term", "_t.tf")


def bm25(index: Index, queries: DataFrame, query_id: str, query_text: str = "text") -> DataFrame:
    """query_id, id, score > 0: the sum of the weights of a query's terms, repeated terms counting again.

    Records are cut down to the terms that some query has and dealt by id once; a record's scores for all queries then come about in
    its own task, so that what is shuffled follows the records, and not the records times the queries.
    """
    asked = queries.select(F.col(query_id), F.explode(key_tokens(F.col(query_text), index.profile)).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qtf"))
    asked = stored(asked, "index-asked")
    terms = stored(index.vocabulary.join(sized(asked.select("term").distinct()), "term").select("term", "idf"), "index-asked-terms")
    kept = postings(index).join(sized(terms), "term")
    kept = kept.groupBy(index.id_col).agg(F.first("n_words").alias("n_words"), F.collect_list(F.struct("term", "idf", "tf")).alias("_t"))
    hits = kept.select(index.id_col, "n_words", F.explode("_t").alias("_t")).join(sized(asked), F.col("_t.term") == F.col("term")).crossJoin(F.broadcast(index.stats))
    norm = K1 * (1 - B + B * F.col("n_words") / F.col("avg_words"))
    weight = F.col("qtf") * F.col("_t.idf") * F.col("_t.tf") * (K1 + 1) / (F.col("_t.tf") + norm)
    return hits.groupBy(index.id_col, query_id).agg(F.sum(weight).alias("score")).where("score > 0").select(query_id, index.id_col, "score")


def top(scores: DataFrame, query_id: str, id_col: str, k: int, score: str = "score", digits: int = 6) -> DataFrame:
    """query_id, id, rank from 1, score; the k best of each query, ties by id. Scores are compared as rounded to `digits`."""
    s = scores.withColumn(score, F.round(score, digits))
    return s.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc(score), id_col))).where(F.col("rank") <= k)


def dense_scores(items: DataFrame, id_col: str, queries: DataFrame, query_id: str, vector: str = "embedding", same: str | None = None) -> DataFrame:
    """query_id, id, score: inner products of each query with every item; same restricts to items that agree in that column."""
    q = queries.select(F.col(id_col).alias(query_id), F.col(vector).alias("_q"), *([F.col(same).alias("_same")] if same else []))
    met = items.join(sized(q), F.col(same) == F.col("_same")) if same else items.crossJoin(sized(q))  # a stated query set against all rows
    return met.select(query_id, id_col, inner(F.col(vector), F.col("_q")).alias("score"))


def dense_top(items: DataFrame, id_col: str, queries: DataFrame, query_id: str, k: int, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, id, score, rank: top() of dense_scores(), without a row for each pair of a query and an item.

    Blocks of queries meet blocks of items, and a task multiplies two blocks as matrices. What can be among the k best of a block of items, but for the
    error of such a product and for rounding, is scored again in the order of dense_scores(), so scores are the same to the last bit. Of equal scores of a
    query the k smallest ids are enough. Vectors that are null, hold a null or no finite number, or are not as long as most, are scored as pairs with all others.
    """
    tasks = 2 * items.sparkSession.sparkContext.defaultParallelism
    i = items.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    q = queries.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    most = i.where(F.size("_v") > 0).groupBy(F.size("_v").alias("_size")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_size").limit(1).collect()
    width = most[0]["_size"] if most else 1
    usual = (F.size("_v") == width) & F.forall("_v", lambda x: F.coalesce(F.abs(x.cast("double")) < 1e15, F.lit(False)))
    i, q = (stored(x.withColumn("_usual", F.coalesce(usual, F.lit(False))), f"dense-{n}") for x, n in ((i, "items"), (q, "queries")))
    n_items, n_queries = (x.where("_usual").count() for x in (i, q))
    ni, nq = max(1, -(-n_items * width // TILE_ITEMS)), max(1, -(-n_queries * width // TILE_QUERIES))
    nq = max(nq, min(-(-n_queries // 64), -(-tasks // ni)))  # small tables too are dealt over all cores
    block = lambda n: F.pmod(F.xxhash64("_id", "_v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = i.where("_usual").select(block(ni).alias("_bi"), every(nq).alias("_bq"), F.lit(False).alias("_asks"), "_id", "_v")
    tiles = tiles.unionByName(q.where("_usual").select(every(ni).alias("_bi"), block(nq).alias("_bq"), F.lit(True).alias("_asks"), "_id", "_v"))
    slack = 10.0**-digits  # scores that round to the same are nearer than this

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("_asks").to_numpy()
        vectors = table.column("_v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, width)
        place = np.empty(len(asks), np.int64)
        place[pc.sort_indices(table, sort_keys=[("_id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(asks))
        at_q, at_i = np.flatnonzero(asks), np.flatnonzero(~asks)
        x, y = vectors[at_q], vectors[at_i]
        longest = np.sqrt((y * y).sum(axis=1).max(initial=0.0))
        columns = np.ascontiguousarray(y.T)
        found: list = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at in range(0, len(x) if len(y) else 0, 32):
            part = x[at : at + 32]
            near = part @ columns
            if near.shape[1] > k:
                error = 4 * width * np.finfo(np.float64).eps * np.sqrt((part * part).sum(axis=1)) * longest
                floor = np.partition(near, -k, axis=1)[:, -k] - 2 * error - slack
                a, b = np.nonzero(near >= floor[:, None])
            else:
                a, b = np.nonzero(np.ones(near.shape, bool))
            score = np.zeros(len(a))
            for d in range(width):
                score += columns[d][b] * part[a, d]
            order = np.lexsort((place[at_i[b]], -score, a))
            a, b, score = a[order], b[order], score[order]
            fresh = np.append(True, (a[1:] != a[:-1]) | (score[1:] != score[:-1]))[: len(a)]
            n = np.arange(len(a))
            few = n - np.maximum.accumulate(np.where(fresh, n, 0)) < k
            found.append((at_q[at + a[few]], at_i[b[few]], score[few]))
        a, b, score = (np.concatenate(z) for z in zip(*found))
        ids = table.column("_id")
        return pa.table({query_id: ids.take(pa.array(a)), id_col: ids.take(pa.array(b)), "score": score})

    kind = items.schema[id_col].dataType.simpleString()
    scores = tiles.repartition(2 * ni * nq, "_bi", "_bq").groupBy("_bi", "_bq").applyInArrow(best, f"{query_id} {kind}, {id_col} {kind}, score double")
    for some, asked in ((i.where("not _usual"), q), (i.where("_usual"), q.where("not _usual"))):
        if not some.where("not _usual").isEmpty() or not asked.where("not _usual").isEmpty():
            name = lambda x, n: x.select(F.col("_id").alias(n), F.col("_v").alias(vector))
            scores = scores.unionByName(dense_scores(name(some, id_col), id_col, name(asked, id_col), query_id, vector))
    return top(scores, query_id, id_col, k, digits=digits)


def fuse(first: DataFrame, second: DataFrame, query_id: str, id_col: str, k: int) -> DataFrame:
    """query_id, id, fused, first_rank, second_rank, rank: reciprocal-rank fusion of two rankings with rank from 1.

    Ties: those in the first ranking go first, by its rank, then by the second's.
    """
    both = first.select(query_id, id_col, F.col("rank").alias("first_rank")).join(second.select(query_id, id_col, F.col("rank").alias("second_rank")), [query_id, id_col], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    both = both.withColumn("fused", F.round(part("first_rank") + part("second_rank"), 9))
    order = W.partitionBy(query_id).orderBy(F.desc("fused"), F.col("first_rank").asc_nulls_last(), F.col("second_rank").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asked_phrases(index: Index, queries: DataFrame, query_id: str, text_col: str, least: int = 3) -> DataFrame:
    """query_id, q (key words, `least` or more)."""
    return queries.select(F.col(query_id), key_tokens(F.col(text_col), index.profile).alias("q")).where(F.size("q") >= least)


def _anchored(index: Index, asked: DataFrame, query_id: str, anchors: Column) -> DataFrame:
    """query_id, q, id, start (from 1), n_words, keys of windows in records that fit one of a query's anchors.

    anchors: how many of the query's words are anchors, the rarest of the vocabulary, unknown words first (these have no window). Only the matching
    positions are joined; a record's words are fetched for those afterwards.
    """
    words = asked.select(query_id, F.posexplode("q").alias("_at", "term"))
    known = index.vocabulary.join(sized(words.select("term").distinct()), "term").select("term", "df")
    ranked = words.join(sized(known), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = W.partitionBy(query_id).orderBy("df", "_at")
    ranked = ranked.withColumn("_r", F.row_number().over(order)).join(asked.select(query_id, F.size("q").alias("_n"), anchors.alias("_anchors")), query_id).where((F.col("_r") <= F.col("_anchors")) & (F.col("df") > 0))
    ranked = stored(ranked.select(query_id, "term", "_at", "_n"), "index-anchors")
    at = index.records.select(index.id_col, "n_words", F.posexplode("keys").alias("_p", "term")).join(sized(ranked), "term")
    at = at.select(query_id, index.id_col, (F.col("_p") - F.col("_at") + 1).alias("start"), "n_words", "_n").where("start >= 1 and start + _n - 1 <= n_words")
    windows = stored(at.select(query_id, index.id_col, "start").distinct(), "index-windows")
    return index.records.join(sized(windows), index.id_col).join(sized(asked), query_id)


def phrases(index: Index, queries: DataFrame, query_id: str, limit: int | None = None, text_col: str = "text") -> DataFrame:
    """query_id, id, n_words of records that contain a query's words (3 or more) as a run; shortest first, with a rank, if limited.

    An equi-join on the query's rarest word replaces the scan for the phrase.
    """
    found = _anchored(index, _asked_phrases(index, queries, query_id, text_col), query_id, F.lit(1))
    hits = found.where(F.slice("keys", F.col("start"), F.size("q")) == F.col("q")).select(query_id, index.id_col, "n_words").distinct()
    if limit is None:
        return hits
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy("n_words", index.id_col))).where(F.col("rank") <= limit)


@F.pandas_udf(BooleanType())
def close_spelling(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two words of 2 letters or more have a Ratcliff-Obershelp ratio of 0.75 or more."""
    return pd.Series([min(len(x), len(y)) >= 2 and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.75 for x, y in zip(a, b)])


def near_phrases(index: Index, queries: DataFrame, query_id: str, text_col: str = "text") -> DataFrame:
    """query_id, id, n_words of records with the query's words as a run but for one (from 6 words on two) misspelled words.

    The first or the second word must be right. With m misspelled words, one of any m + 1 is right, so windows are found by the m + 1 rarest.
    Spelling is only compared for windows that pass the count.
    """
    most = lambda q: F.when(F.size(q) < 6, 1).otherwise(2)
    found = _anchored(index, _asked_phrases(index, queries, query_id, text_col), query_id, most("q") + 1)
    pairs = F.zip_with("q", F.slice("keys", F.col("start"), F.size("q")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hits = found.select(query_id, index.id_col, "start", "n_words", most("q").alias("_most"), pairs.alias("_pairs"))
    hits = hits.withColumn("miss", F.filter("_pairs", lambda p: p["a"] != p["b"])).where((F.size("miss") > 0) & (F.size("miss") <= F.col("_most")))
    right = lambda i: F.get("_pairs", F.lit(i))["a"] == F.get("_pairs", F.lit(i))["b"]
    hits = hits.where(right(0) | right(1)).select(query_id, index.id_col, "start", "n_words", "miss")
    one = hits.withColumn("m", F.explode("miss")).withColumn("ok", close_spelling(F.col("m.a"), F.col("m.b")))
    good = one.groupBy(query_id, index.id_col, "start", "n_words").agg(F.bool_and("ok").alias("ok")).where("ok")
    return good.select(query_id, index.id_col, "n_words").distinct()


def append_phrases(ranked: DataFrame, index: Index, queries: DataFrame, query_id: str, k: int, text_col: str = "text") -> DataFrame:
    """ranked (query_id, id, score) with the k shortest records that contain the query, exactly before nearly, added at its lowest score; appended tells them."""
    asked = queries.select(query_id, text_col)
    exact = phrases(index, asked, query_id, text_col=text_col).select(query_id, index.id_col, "n_words", F.lit(0).alias("_near"))
    near = near_phrases(index, asked, query_id, text_col=text_col).select(query_id, index.id_col, "n_words", F.lit(1).alias("_near"))
    found = exact.unionByName(near).groupBy(query_id, index.id_col).agg(F.min("_near").alias("_near"), F.min("n_words").alias("n_words"))
    found = found.withColumn("_r", F.row_number().over(W.partitionBy(query_id).orderBy("_near", "n_words", index.id_col))).where(F.col("_r") <= k)
    floor = ranked.groupBy(query_id).agg(F.min("score").alias("score"))
    more = found.select(query_id, index.id_col).join(ranked, [query_id, index.id_col], "left_anti").join(floor, query_id, "left").select(query_id, index.id_col, F.coalesce("score", F.lit(0.0)).alias("score"))
    return ranked.select(query_id, index.id_col, "score").withColumn("appended", F.lit(False)).unionByName(more.withColumn("appended", F.lit(True)))


def ranked_with_phrases(index: Index, queries: DataFrame, query_id: str, k: int = 8, text_col: str = "text") -> DataFrame:
    """query_id, id, score, rank: the k best by BM25 and, without a rank, the records that contain the query, exactly or nearly, below them."""
    best = stored(top(bm25(index, queries, query_id, text_col), query_id, index.id_col, k), "index-bm25")
    more = append_phrases(best.select(query_id, index.id_col, "score"), index, queries, query_id, k, text_col)
    return more.join(best.select(query_id, index.id_col, "rank"), [query_id, index.id_col], "left").select(query_id, index.id_col, "score", "rank")


def hybrid(index: Index, dense: DataFrame, queries: DataFrame, query_id: str, k: int = 8, text_col: str = "text") -> DataFrame:
    """query_id, id, score, appended: BM25 and dense lists of DEPTH * k fused by reciprocal ranks, the k best, and the records that contain the query below them.

    dense: query_id, id, score of the dense search, whichever encoder made it.
    """
    words = stored(top(bm25(index, queries, query_id, text_col), query_id, index.id_col, DEPTH * k), "index-bm25")
    fused = fuse(words, top(dense, query_id, index.id_col, DEPTH * k), query_id, index.id_col, k)
    best = stored(fused.select(query_id, index.id_col, F.col("fused").alias("score")), "index-fused")
    return append_phrases(best, index, queries, query_id, k, text_col)
