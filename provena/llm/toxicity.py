"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from provena.llm.common import small_batches

#: N-gram lengths and the number of buckets that they are hashed to.
LENGTHS, BITS = (4, 5), 20
#: The classifier is fitted on at most this many labelled rows of each label, the first by hash of their ids.
MAX_PER_LABEL = 3_000
#: N-grams in fewer texts of the sample carry no weight.
MIN_TEXTS = 5
THRESHOLD = 0.7


def ngrams(text: str) -> list[np.ndarray]:
    """Bucket of every n-gram of the lower-cased text between two spaces, one array for each length; repeats included."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    for n in LENGTHS:
        m = len(a) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B1) + a[k : k + m] + np.uint64(n)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return out


@dataclass
class Model:
    """weights has a weight for each bucket (mostly 0): the log-count ratio times the learned coefficient."""
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        z = self.bias
        hot = [h[self.weights[h] != 0] for h in ngrams(text)]
        if hot:
            z += float(self.weights[np.unique(np.concatenate(hot))].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts: list[str], labels: list[int], prior: float, steps: int = 200, ridge: float = 10.0, alpha: float = 1.0) -> Model:
    """Presence of an n-gram counts; its ratio is log of (share of toxic texts with it / share of others), smoothed by alpha.

    Logistic regression on the ratio-scaled presences by full-batch Adam with an L2 penalty; both labels weigh the same
    in sum, so scores hold for equal shares of them. With one label only, or none, every text scores the prior.
    """
    weights = np.zeros(1 << BITS, np.float32)
    y = np.array(labels, np.float64)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Model(weights, bias)
    rows = [np.unique(np.concatenate(g)) if (g := ngrams(t)) else np.empty(0, np.int32) for t in texts]
    counts = np.zeros((2, 1 << BITS))
    for r, label in zip(rows, labels):
        counts[label, r] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((counts[1] + alpha) / (n1 + 2 * alpha)) - np.log((counts[0] + alpha) / (n0 + 2 * alpha))
    used = (counts.sum(axis=0) >= MIN_TEXTS) & (np.abs(ratio) > 0.5)
    number = np.cumsum(used) - 1
    rows = [number[r[used[r]]] for r in rows]
    at = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    r = ratio[used]
    w, b = np.zeros(len(r)), 0.0
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    x = r[at]
    weigh = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for step in range(1, steps + 1):
        z = np.bincount(doc, w[at] * x, minlength=len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weigh
        g = np.append(np.bincount(at, err[doc] * x, minlength=len(r)) + ridge / len(y) * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    weights[used] = (w * r).astype(np.float32)
    return Model(weights, float(b))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, per_label: int) -> DataFrame:
    """text, label, prior: at most per_label rows of each label that aren't held out, and the share of 1 among all such rows."""
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = own.where(~held_out(F.col("doc_id"))).withColumn("_h", F.xxhash64("doc_id"))
    prior = own.agg(F.avg("label").alias("prior"))
    picked = [own.where(F.col("label") == k).orderBy("_h", "doc_id").limit(per_label) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1]).crossJoin(F.broadcast(prior))  # prior: one row
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])  # at most 2 * per_label rows are broadcast
    return texts.select("doc_id", "text", "label", "prior")


def fit_in_one_task(sample: DataFrame, train) -> bytes:
    """Runs train(texts, labels, prior) -> bytes in one task over the bounded sample, in the order of doc_id."""
    def run(frames):
        if got := list(frames):
            pdf = pd.concat(got, ignore_index=True).sort_values("doc_id")
            yield pd.DataFrame({"model": [train(pdf.text.tolist(), pdf.label.tolist(), float(pdf.prior.iloc[0]))]})

    rows = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return rows[0].model if rows else train([], [], 0.5)


def score_texts(docs: DataFrame, make_scorer, held_out, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted by make_scorer()(text); one row per row of docs."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        score = make_scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([score(t) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _pack(m: Model) -> bytes:
    at = np.flatnonzero(m.weights).astype(np.int32)
    return np.float64(m.bias).tobytes() + at.tobytes() + m.weights[at].tobytes()


def _unpack(raw: bytes) -> Model:
    n = (len(raw) - 8) // 8
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(raw, np.int32, n, 8)] = np.frombuffer(raw, np.float32, n, 8 + 4 * n)
    return Model(weights, float(np.frombuffer(raw, np.float64, 1)[0]))


def is_held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _scorer(docs: DataFrame, labels: DataFrame, per_label: int):
    sample = labelled_sample(docs, labels, "toxic", is_held_out, per_label)
    raw = fit_in_one_task(sample, lambda t, y, p: _pack(fit(t, y, p)))
    model = docs.sparkSession.sparkContext.broadcast(raw)  # at most 8 MB
    return lambda: _unpack(model.value).score


def drop_toxic(docs: DataFrame, labels: DataFrame, per_label: int = MAX_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that score_toxicity doesn't predict to be toxic; filtered in the scan, without a join."""
    make = _scorer(docs, labels, per_label)

    def run(batches):
        score = make()
        for b in batches:
            yield b.filter(pa.array([score(t or "") < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = MAX_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. docs: doc_id, text; labels: doc_id, toxic.

    Only labels of rows that aren't held out are learned, on at most per_label rows of each label; texts alone are
    scored, whole. Null and empty texts score alike. Labels that are null or not 0 or 1 are ignored; of several for an
    id the largest counts. Without labels of both kinds every text scores the share of toxic ones (0.5 without any).
    Repeated rows each get their score; an empty table gives no rows; other columns are ignored.
    """
    return score_texts(docs, _scorer(docs, labels, per_label), is_held_out, threshold)
