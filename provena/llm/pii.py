"""PII: pattern spans, and information-theoretic sanitisation of terms that reveal the protected values across the corpus."""
from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm.common import durable, if_small, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of a protected value that count as occurring with it.
WINDOW = 10
#: A term is judged for a value if they occur together in this many different contexts (copies of a context count once), or in
#: two that chance explains with at most CHANCE.
SUPPORT, CHANCE = 3, 0.01
#: Share of a value's information content that a term may reveal; above it the term is generalised, above REMOVE removed.
DISCLOSURE, REMOVE = 0.8, 0.95
#: Different terms that a task counts before it passes the counts on.
COUNTED = 100_000
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
PUNCTUATION = ".,;:!?()[]{}<>\"'|*#$%&"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern kinds, in the order of KINDS, then start; time grows with the length of the text only.

    E-mails are found from their '@' outwards: the local part is the whole run of its characters before it. Addresses
    are sought within runs of digits and dots. Both give the leftmost matches of the plain patterns.
    """
    out: list[tuple[str, int, int]] = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    for run in _NUMERIC.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _term(token: str) -> str:
    return token.strip(PUNCTUATION)


def _terms(tokens) -> set[str]:
    """Terms of lower-cased tokens: all that is left when punctuation at the edges is stripped."""
    return {t for x in tokens if (t := _term(x))}


def contexts(text: str, spans: list[tuple[str, int, int]]) -> dict[str, set[str]]:
    """For each protected value of a text, the terms within WINDOW words of any of its mentions."""
    out: dict[str, set[str]] = {}
    for kind, s, e in spans:
        before = [w.lower() for w in text[:s].rsplit(None, WINDOW)[-WINDOW:]]
        after = [w.lower() for w in text[e:].split(None, WINDOW)[:WINDOW]]
        value = text[s:e].lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", text[s:e])
        out.setdefault(f"{kind}:{value}", set()).update(_terms(before + after))
    return out


def _counted(batches, terms):
    """term, n: in how many of a task's texts each of terms(text) occurs, and how many texts there are (term null). Counts go on when COUNTED are held."""
    seen: Counter = Counter()
    for b in batches:
        for t in b.column("text").to_pylist():
            seen.update(terms(t))
        seen[None] += b.num_rows
        if len(seen) > COUNTED:
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])
            seen = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])


def revealing_terms(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """term, value, disclosure, action of terms that reveal a protected value beyond the threshold. docs: doc_id, text.

    With N documents, IC(c) = log(N / n(c)) is what a value c is worth and PMI(c; t) = log(N n(c, t) / (n(c) n(t)))
    what a term t tells of it; disclosure is PMI / IC, 1 where t occurs nowhere without c. Counts are of documents, over all of them; a pair
    needs `support` different contexts, or two where chance would bring two or more with at most CHANCE (Poisson, by the counts of
    both), so that copies of one text alone don't make its words revealing.
    """
    rows = small_batches(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def mentions(batches):
        for b in batches:
            seen: Counter = Counter()
            for t in b.column("text").to_pylist():
                for value, terms in contexts(t, base_spans(t)).items():
                    seen[value, tuple(sorted(terms))] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([hashlib.blake2b(" ".join(k[1]).encode(), digest_size=8).digest() for k in keys], pa.binary()),
                                              pa.array([list(k[1]) for k in keys], pa.list_(pa.string())), pa.array([seen[k] for k in keys], pa.int64())], ["value", "context", "terms", "n"])

    found = rows.mapInArrow(mentions, "value string, context binary, terms array<string>, n long")
    found = durable(found.groupBy("value", "context").agg(F.sum("n").alias("n"), F.first("terms").alias("terms")), "pii-contexts")
    values = found.groupBy("value").agg(F.sum("n").alias("n_value"), F.count("*").alias("contexts")).where(F.col("contexts") >= min(support, 2))
    often = found.join(values.select("value"), "value", "left_semi") if not (small := if_small(values.select("value")))[1] else found.join(small[0], "value", "left_semi")
    pairs = often.select("value", "n", F.explode("terms").alias("term")).groupBy("value", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("contexts")).where(F.col("contexts") >= min(support, 2))
    pairs = durable(pairs.join(values.select("value", "n_value"), "value"), "pii-pairs")
    wanted, few = if_small(pairs.select("term").distinct())
    if few:
        names = docs.sparkSession.sparkContext.broadcast(frozenset(wanted.toArrow().column("term").to_pylist()))  # at most BROADCAST_ROWS terms

        def document_counts(batches):
            terms = names.value
            yield from _counted(batches, lambda t: terms & _terms(set(t.lower().split())) if terms else ())

        counts = rows.mapInArrow(document_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    else:
        def all_terms(batches):
            yield from _counted(batches, lambda t: _terms(set(t.lower().split())))

        counts = rows.mapInArrow(all_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    counts = durable(counts, "pii-counts")
    total = counts.where("term is null").agg(F.coalesce(F.max("n_term"), F.lit(0)).alias("n")).first()["n"]  # one number
    told = pairs.join(counts.where("term is not null"), "term")
    by_chance = F.col("n_value") * F.col("n_term") / F.lit(float(max(total, 1)))
    told = told.where((F.col("contexts") >= support) | (F.lit(1.0) - F.exp(-by_chance) * (1 + by_chance) <= CHANCE))
    pmi = F.log(F.lit(float(max(total, 1))) * F.col("n_pair") / (F.col("n_value") * F.col("n_term")))
    told = told.withColumn("disclosure", pmi / F.log(F.lit(float(max(total, 1))) / F.col("n_value"))).where((F.col("n_value") < total) & (F.col("disclosure") >= disclosure))
    worst = told.groupBy("term").agg(F.max_by("value", F.struct("disclosure", "value")).alias("value"), F.max("disclosure").alias("disclosure"))
    return worst.withColumn("action", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise"))


def general(token: str) -> str:
    """The class that a generalised term is replaced by: what it looks like, but not what it says."""
    if token.isdigit():
        return "NUMBER"
    if any(c.isdigit() for c in token):
        return "CODE"
    return "NAME" if token[:1].isupper() else "WORD"


def _all_spans(text: str, hot: set[str]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    extra: list[tuple[str, int, int]] = []
    if hot:
        taken = sorted((s, e) for _, s, e in base)
        k = 0
        for m in _TOKEN.finditer(text):
            token = m.group()
            inner = _term(token)
            if inner.lower() in hot:
                s = m.start() + token.find(inner)
                e = s + len(inner)
                while k < len(taken) and taken[k][1] <= s:
                    k += 1
                if not (k < len(taken) and taken[k][0] < e):
                    extra.append(("term", s, e))
    return base, extra


def find_pii(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_generalised, n_removed, sanitised.

    spans lists kind:start:end (code points, end exclusive) of the pattern kinds, then of revealing terms outside them
    (kind term). sanitised is the text with pattern spans replaced by [KIND], removed terms by [REMOVED], generalised ones by their class ([NAME], [WORD], [NUMBER] or [CODE]). A null text is
    empty; rows that repeat each get a row; an empty table gives no rows; other columns are ignored.

    The terms are broadcast only if counted and small; otherwise each document's own terms are joined with them.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    small, few = if_small(terms.select("term", "action"))
    if few:
        listed = small.toArrow()  # at most BROADCAST_ROWS terms
        known = spark.sparkContext.broadcast(dict(zip(listed.column("term").to_pylist(), listed.column("action").to_pylist())))
        rows = rows.withColumn("hot", F.lit(None).cast("map<string,string>"))
    else:
        known = None
        keyed = rows.withColumn("_key", F.xxhash64("doc_id", "text"))

        def own_terms(batches):
            for b in batches:
                for k, t in zip(b.column("_key").to_pylist(), b.column("text").to_pylist()):
                    names = sorted(_terms(set(t.lower().split())))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(names), pa.int64()), pa.array(names, pa.string())], ["_key", "term"])

        own = keyed.select("_key", "text").mapInArrow(own_terms, "_key long, term string").distinct()
        own = own.join(terms.select("term", "action"), "term").groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("hot"))
        rows = keyed.join(own, "_key", "left").select("doc_id", "text", "hot")

    def run(batches):
        all_known = known.value if known else None
        for b in batches:
            out = []
            for i, t, h in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("hot").to_pylist()):
                actions = all_known if all_known is not None else dict(h or ())
                hot = set(actions) & _terms(set(t.lower().split())) if actions else set()
                base, extra = _all_spans(t, hot)
                n = Counter(k for k, _, _ in base)
                show = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                clean, done, told = [], 0, Counter()
                for kind, s, e in sorted(base + extra, key=lambda x: (x[1], -x[2])):
                    if s >= done:
                        removes = actions.get(t[s:e].lower()) == "remove"
                        mark = kind.upper() if kind != "term" else "REMOVED" if removes else general(t[s:e])
                        told[removes] += kind == "term"
                        clean += [t[done:s], f"[{mark}]"]
                        done = e
                out.append((i, *[n[k] for k in KINDS], hashlib.sha256(show(base).encode()).hexdigest(), show(base + extra), told[False], told[True], "".join(clean) + t[done:]))
            columns = list(zip(*out)) if out else [()] * 10
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, kinds)], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_generalised", "n_removed", "sanitised"])

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_generalised long, n_removed long, sanitised string")


def brute_force(text: str | None) -> tuple:
    """n_email, n_ip, n_card, n_phone and the base spans by the plain patterns: for tests on short texts."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    n = Counter(k for k, _, _ in out)
    return (*[n[k] for k in KINDS], ",".join(f"{k}:{s}:{e}" for k, s, e in out))
