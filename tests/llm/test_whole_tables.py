"""Operators on whole tables against plain Python, and the rows that a pipeline meets seldom."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provena.llm import bpe, mixing, mpeg_ts, near_dedup, pii, quality, sharding, toxicity


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_media_of_every_document(docs, texts):
    got = {r.doc_id: r for r in mpeg_ts.digests(mpeg_ts.read_media(mpeg_ts.write_media(docs))).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert all(got[i][k] == v for k, v in mpeg_ts.brute_force(t).items())
        n = len(mpeg_ts.pad(t.encode()))
        assert f"units={-(-n // mpeg_ts.UNIT)};random_access={-(-n // mpeg_ts.UNIT)};last_pts={(-(-n // mpeg_ts.UNIT) - 1) * mpeg_ts.TICKS};cc_errors=0;crc_errors=0" in got[i].feature


def test_pii_patterns_in_every_document(spark, docs, texts):
    none = spark.createDataFrame([], "term string, action string")
    for r in pii.find_pii(docs, none).collect():
        n_email, n_ip, n_card, n_phone, spans = pii.brute_force(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (n_email, n_ip, n_card, n_phone, spans)


def test_revealing_terms_against_brute_force(spark):
    """PMI over information content of every term beside every value, by plain counting."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcde") for _ in range(3))
    corpus = [" ".join(word() for _ in range(30)) for _ in range(120)]
    for k in range(3):
        corpus += [f"{word()} {word()} keeper{k} wrote to box{k}@corp.example {word()} {word()} {'odd' + str(k) if j % 2 else word()}" for j in range(5)]
    n, holds, beside = len(corpus), Counter(), defaultdict(lambda: defaultdict(set))
    pairs, values = Counter(), Counter()
    for t in corpus:
        holds.update(set(t.split()))
        m = re.search(r"\S+@\S+", t)
        if m:
            around = set(t[: m.start()].split()[-10:] + t[m.end() :].split()[:10])
            values["email:" + m.group()] += 1
            for w in around:
                pairs["email:" + m.group(), w] += 1
                beside["email:" + m.group()][w].add(tuple(sorted(around)))
    want = {}
    for (v, w), both in pairs.items():
        chance = values[v] * holds[w] / n
        seen = len(beside[v][w])
        if seen >= pii.SUPPORT or seen == 2 and 1 - math.exp(-chance) * (1 + chance) <= pii.CHANCE:
            d = math.log(n * both / (values[v] * holds[w])) / math.log(n / values[v])
            if d >= pii.DISCLOSURE:
                want[w] = max(want.get(w, 0), round(d, 9))
    got = {r.term: round(r.disclosure, 9) for r in pii.revealing_terms(spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")).collect()}
    assert got == want and {"keeper0", "keeper1", "keeper2"} <= set(got)


def test_generalised_terms_keep_their_class(spark):
    rows = spark.createDataFrame([(1, "Smith met x9 and 77 at home, Smith")], "doc_id long, text string")
    terms = spark.createDataFrame([("smith", "generalise"), ("x9", "generalise"), ("77", "generalise"), ("home", "remove"), ("met", "generalise")], "term string, action string")
    r = pii.find_pii(rows, terms).first()
    assert r.sanitised == "[NAME] [WORD] [CODE] and [NUMBER] at [REMOVED], [NAME]" and (r.n_generalised, r.n_removed) == (5, 1)


@pytest.mark.parametrize("op, score, column, held", [(toxicity, toxicity.score_toxicity, "toxic", lambda h: h % 3 == 1), (quality, quality.score_quality, "quality", lambda h: h % 5 == 0)])
def test_scores_are_those_of_a_plain_fit(spark, data, docs, texts, op, score, column, held):
    """The same learner on the rows that may be learned, in one process, and its scores of every document."""
    lab = spark.read.parquet(f"{data}/labels.parquet")
    known = {r.doc_id: r[column] for r in lab.collect() if r[column] in (0, 1) and r.doc_id in texts and not held(zlib.crc32(str(r.doc_id).encode()))}
    ids = sorted(known)
    model = op.fit([texts[i] for i in ids], [known[i] for i in ids], sum(known.values()) / len(known))
    if op is quality:
        model = quality.Model.unpack(model.pack())
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in score(docs, lab).collect()}
    for i, t in texts.items():
        want = model.score(t)
        assert abs(got[i][0] - want) < 1e-6 and got[i][1] == (got[i][0] >= op.THRESHOLD) and got[i][2] == held(zlib.crc32(str(i).encode()))


def test_shards_of_every_document(docs, texts, monkeypatch):
    rows = sharding.balanced_shards(docs).collect()
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[raw].add(r.shard)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    assert max(load.values()) <= max(sum(load.values()) / 8 * 1.05, max(len(t.encode()) + 1 for t in texts.values()))
    # propagation has settled by then: more rounds cut no fewer links
    monkeypatch.setattr(sharding, "ROUNDS", 16)
    more = {r.doc_id: r.shard for r in sharding.balanced_shards(docs).collect()}
    assert all(len({more[i] for i in texts if texts[i] == t}) == 1 for t in set(texts.values()))


def test_shard_words_add_up(docs):
    for r in mixing.mix(docs).collect():
        assert sum(r.by_shard) == r.taken and all(x >= 0 for x in r.by_shard) and len(r.by_shard) == 8


ROWS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (1, "one two three four five six seven eight nine ten"), (3, "one two three four five six seven eight nine zen"), (None, "one two three four five six seven eight nine pen"),
        (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (7, None), (8, ""), (None, ""), (9, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (9, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]


def test_near_copies_of_repeated_and_null_ids(spark):
    rows = [(*tuple(r)[:1], *tuple(r)[1:]) for r in near_dedup.near_duplicates(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()]
    got = Counter(rows)
    assert got == Counter([(1, 1, 1, True), (None, 1, 1, False), (9, 1, 1, False), (9, 1, 1, False), (1, 1, 1, True), (3, 3, 1, False), (None, None, 1, False), (7, 7, 7, True), (8, 7, 7, False), (None, 7, 7, False)])


def test_stages_lose_no_row_for_its_id(spark, tmp_path):
    frame = spark.createDataFrame([(i, t, "s", k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, source string, _row int")
    left = lambda df: sorted(r._row for r in df.collect())
    # equal texts: the largest id stays, rows that repeat id and text once, a null id only alone
    copies = corpus_pipeline.drop_copies(spark, frame, "")
    assert copies.columns == frame.columns and left(copies) in ([1, 2, 3, 6, 8], [1, 2, 3, 6, 9])
    # near copies: the row of the smallest id of each group, told by its text
    near = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert near.columns == frame.columns and left(near) == [0, 1, 5]
    mixed = corpus_pipeline.mix_sources(spark, frame, "")
    taken = Counter(left(mixed))
    assert mixed.columns == frame.columns and set(taken) == {0, 1, 2, 3, 4, 8, 9}  # all that have words, whatever their id
    told = mixing.mix(frame).collect()
    assert sum(taken.values()) == sum(-(-r.taken // r.size) for r in told if r.taken)


def test_equal_rows_are_mixed_as_often_as_they_are_taken(spark):
    frame = spark.createDataFrame([(1, "a b c", "x")] * 3 + [(2, "d e f g", "x"), (None, "h i j", "y")], "doc_id long, text string, source string")
    got = Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, frame, "").collect())
    want = Counter()
    for r in mixing.mix(frame).collect():
        want[r.doc_id] += -(-r.taken // r.size)
    assert Counter({k[0]: v for k, v in got.items()}) == +want


def test_chunks_beyond_the_broadcast(spark, docs, texts):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, shared_chunks=0).collect()}
    assert got == dict(zip(texts, bpe.brute_force(list(texts.values()))))


def test_another_tokenizer_goes_through_the_library(spark, docs, texts):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not bpe.encodes_by_words(path) and bpe.encodes_by_words(bpe.default_tokenizer())
    some = list(texts)[:40]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs.where(F.col("doc_id").isin(some)), path).collect()}
    assert got == dict(zip(some, bpe.brute_force([texts[i] for i in some], path)))


def test_joins_agree_or_are_told():
    """Pieces of a text put together, with the words that overlap cut off again, are the tokens of the whole; foreign tokens don't agree."""
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) + r.choice(["", "", ",", "."]) for _ in range(6000))
    enc, raw = bpe.encoder(bpe.default_tokenizer()), text.encode()
    shared = {fp: (99, 2) for k, (*_, fp) in enumerate(bpe.cores(raw)) if k % 3}
    pieces, owned = bpe._plan(raw, 1, shared)
    known, out = {fp: raw[s:e].decode() for s, e, fp in bpe.cores(raw)}, []
    assert not owned and sum(p[0] == "ref" for p in pieces) > 3
    for kind, what, *ends in pieces:
        head, tail = enc.encode(ends)
        ids = enc.encode([known[what] if kind == "ref" else what])[0]
        assert bpe._agreed(ids, head, tail) and not bpe._agreed(ids[1:], ids[:1], tail)
        out.append(ids if kind == "ref" else ids[len(head) : len(ids) - len(tail)])
    assert (np.concatenate(out) == enc.encode([text])[0]).all()
