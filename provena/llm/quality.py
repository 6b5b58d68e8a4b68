"""Quality classifier: gated attention-based multiple-instance learning over the passages of a document."""
from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, functions as F

from provena.llm.toxicity import fit_in_one_task, labelled_sample, score_texts

#: Words in a passage; a document is the bag of all its passages.
PASSAGE_WORDS = 50
#: A fit takes at least this many steps, so that a small sample is gone through often enough.
STEPS = 600
#: Sizes of a passage's encoding and of the attention space.
HIDDEN, ATTENTION = 24, 12
MAX_PER_LABEL = 3_000
THRESHOLD = 0.3
FEATURES = 256 + 4


def passages(text: str) -> np.ndarray:
    """One row of features for each passage of a text; an empty text has one passage without words.

    Square roots of the shares of each byte value, then: share of distinct words, share of words equal to the one before,
    mean word length (in 20 bytes), share of words that begin with A-Z.
    """
    a = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(a) else np.empty(0, np.int64)
    if not len(start):
        return np.zeros((1, FEATURES), np.float32)
    n = len(start)
    of_word = np.arange(n) // PASSAGE_WORDS
    count = int(of_word[-1]) + 1
    edge = np.append(start[::PASSAGE_WORDS], len(a))
    edge[0] = 0
    of_byte = np.repeat(np.arange(count), np.diff(edge))
    out = np.zeros((count, FEATURES), np.float32)
    out[:, :256] = np.bincount(of_byte * 256 + a, minlength=count * 256).reshape(count, 256)
    length = np.maximum(1, np.diff(edge))[:, None]
    out[:, :256] = np.sqrt(out[:, :256] / length)
    # each word's polynomial hash, white space counting as 0
    place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))])
    power = np.cumprod(np.concatenate([[1], np.full(max(1, int(place.max())), 0x100000001B3)]).astype(np.uint64))
    value = np.where(blank, 0, a.astype(np.uint64) + 1)
    word = np.add.reduceat(value * power[place], start)
    word = (word ^ word >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
    words = np.bincount(of_word, minlength=count)
    distinct = np.unique(of_word.astype(np.uint64) << np.uint64(40) | word)
    out[:, 256] = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=count) / words
    same = np.concatenate([[False], word[1:] == word[:-1]])
    out[:, 257] = np.bincount(of_word, same, minlength=count) / words
    out[:, 258] = np.bincount(of_byte, ~blank, minlength=count) / words / 20
    first = a[start]
    out[:, 259] = np.bincount(of_word, (first >= 65) & (first <= 90), minlength=count) / words
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Model:
    """h = tanh(W x + b); attention logits w . (tanh(V h) * sigmoid(U h)); a document is its passages' h weighted by the softmax."""

    names = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = params or {"W": r.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": r.normal(0, 0.3, (HIDDEN, ATTENTION)),
                            "w": r.normal(0, 0.3, ATTENTION), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        logit = (t * s) @ p["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, logit)
        e = np.exp(logit - top[bag])
        a = e / np.bincount(bag, e, minlength=bags)[bag]
        z = np.zeros((bags, HIDDEN))
        np.add.at(z, bag, a[:, None] * h)
        return _sigmoid(z @ p["c"] + p["d"]), (h, t, s, a, z)

    def score(self, text: str) -> float:
        p, h = self.p, np.tanh(passages(text) @ self.p["W"] + self.p["b"])
        logit = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
        a = np.exp(logit - logit.max())
        return float(_sigmoid((a / a.sum()) @ h @ p["c"] + p["d"][0]))

    def gradients(self, x, bag, bags, y, weigh):
        p = self.p
        out, (h, t, s, a, z) = self.forward(x, bag, bags)
        err = (out - y) * weigh
        g = {"c": z.T @ err, "d": np.array([err.sum()])}
        dz = err[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        dlogit = a * (da - np.bincount(bag, a * da, minlength=bags)[bag])
        g["w"] = (t * s).T @ dlogit
        dts = dlogit[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        g["W"], g["b"] = x.T @ dh, dh.sum(axis=0)
        return g

    def pack(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **self.p)
        return f.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> "Model":
        with np.load(io.BytesIO(raw)) as f:
            return cls({k: f[k].astype(np.float32) for k in cls.names})


def fit(texts: list[str], labels: list[int], prior: float, epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Adam on the cross-entropy of document labels, for `epochs` passes or as many as make STEPS steps, if that is more; both labels weigh the same in sum. With one label only every text scores the prior."""
    m = Model()
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        m.p["c"] = np.zeros(HIDDEN)
        m.p["d"] = np.array([np.log(prior / (1 - prior))])
        return m
    bags = [passages(t) for t in texts]
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    r = np.random.default_rng(2)
    first, second = {k: np.zeros_like(v) for k, v in m.p.items()}, {k: np.zeros_like(v) for k, v in m.p.items()}
    step = 0
    epochs = max(epochs, STEPS * batch // len(y))
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            x = np.concatenate([bags[i] for i in own])
            bag = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
            g = m.gradients(x, bag, len(own), y[own], weigh[own] / len(own))
            step += 1
            for k in m.names:
                grad = g[k] + decay * m.p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                m.p[k] = m.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def is_held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, per_label: int = MAX_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. docs: doc_id, text; labels: doc_id, quality.

    Only labels of rows that aren't held out are learned, on at most per_label rows of each label, all passages of
    each. Every passage of every text is scored. Null and empty texts score alike, as one passage without words.
    Labels that are null or not 0 or 1 are ignored; of several for an id the largest counts. Without labels of both
    kinds every text scores the share of good ones (0.5 without any). Repeated rows each get their score; an empty
    table gives no rows; other columns are ignored.
    """
    sample = labelled_sample(docs, labels, "quality", is_held_out, per_label)
    raw = fit_in_one_task(sample, lambda t, y, p: fit(t, y, p).pack())
    model = docs.sparkSession.sparkContext.broadcast(raw)  # under 100 KB

    def make():
        return Model.unpack(model.value).score

    return score_texts(docs, make, is_held_out, threshold)
