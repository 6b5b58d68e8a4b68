"""Edge cases that every training-data operator shares, and each against brute force, SQL or held-out labels."""
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provena.llm import bpe, exact_dedup, mixing, mpeg_ts, near_dedup, pii, quality, queries, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, keep_id string, hub string, kind string"


def doc(i, text, source="s"):
    return (i, text, "en", source, None, 7, "x", "y", "z")


EDGE = [doc(1, None), doc(2, ""), doc(3, "a b c d e f g"), doc(4, "a b c d e f g"), doc(4, "a b c d e f g"), doc(None, "a b c d e f g"), doc(5, "word " * 30_000, None), doc(6, "x" * 50_000), doc(7, " \n\t "), doc(8, "é ß <|endoftext|> 'll 12", None)]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (6, 0, 1), (3, None, None), (None, 1, 1), (7, 5, 9)], LABELS)


OPERATORS = {
    "exact": lambda d, lab: exact_dedup.exact_dedup(d, with_hash=True), "mix": lambda d, lab: mixing.mix(d), "near": lambda d, lab: near_dedup.near_duplicates(d),
    "ts": lambda d, lab: mpeg_ts.digests(mpeg_ts.read_media(mpeg_ts.write_media(d))), "toxicity": toxicity.score_toxicity, "quality": quality.score_quality,
    "pii": lambda d, lab: pii.find_pii(d, pii.revealing_terms(d)), "shards": lambda d, lab: sharding.balanced_shards(d), "bpe": lambda d, lab: bpe.encode_documents(d, with_ids=True),
    "urls": lambda d, lab: url_filter.judge_urls(d.withColumn("url", F.col("text")), url_filter.rule_table(d.sparkSession), id_col="doc_id")}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_each_get_an_answer(name, edge, empty, labels):
    rows = OPERATORS[name](edge, labels).collect()
    assert len(rows) == len(EDGE)
    assert sorted(map(repr, rows)) == sorted(map(repr, OPERATORS[name](edge, labels).collect()))
    assert OPERATORS[name](empty, labels).count() == 0
    assert OPERATORS[name](empty, labels.limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_edge_rows(spark, edge, empty, labels, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = stage(spark, edge, str(tmp_path))
    assert out.count() <= 3 * len(EDGE) and stage(spark, empty, str(tmp_path)).count() == 0
    if name != "bpe":
        assert out.columns == edge.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[rel.columns.index(c)] for c in cols]) for r in rel.fetchall())


def test_exact_answers(edge):
    got = {(r.doc_id, r.group_size): r for r in exact_dedup.exact_dedup(edge).collect()}
    assert got[(1, 2)].keep_id == 2 and not got[(1, 2)].kept and got[(2, 2)].kept
    assert got[(4, 4)].kept and got[(3, 4)].keep_id == 4 and not got[(None, 4)].kept


def test_exact_without_broadcast_agrees(edge, monkeypatch):
    want = sorted(map(repr, exact_dedup.exact_dedup(edge).collect()))
    monkeypatch.setattr(exact_dedup, "if_small", lambda df: (df, False))
    assert sorted(map(repr, exact_dedup.exact_dedup(edge).collect())) == want


def test_mix_meets_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 16 for s in taken)


def test_sainte_lague_by_quotients(spark):
    t = spark.createDataFrame([(f"s{i}", False, 1000, float(v)) for i, v in enumerate([5000, 3, 3, 3, 40, 40, 1000, 911])], "src string, no_src boolean, source_size long, target double")
    got = {r.src: r.seats for r in mixing.apportion(t, 16, 4).collect()}
    for s, house in enumerate(8000 // 16 * k // 4 for k in range(1, 5)):
        seats = {f"s{i}": 0 for i in range(8)}
        goal = dict(zip(seats, [5000, 3, 3, 3, 40, 40, 1000, 911]))
        for _ in range(house):
            best = max(seats, key=lambda k: (goal[k] / (2 * seats[k] + 1), -int(k[1:])))
            seats[best] += 1
        assert {k: v[s] for k, v in got.items()} == seats


def test_transport_stream_round_trip():
    for n in (0, 1, 64, 168, 170, 171, 184, 15_990, 16_000, 16_001, 50_000):
        d = random.Random(n).randbytes(n)
        s = mpeg_ts.mux(d)
        r = mpeg_ts.demux(s)
        assert r["payload"] == d and r["cc_errors"] == r["crc_errors"] == 0 and len(s) % 188 == 0
        assert [u[0] for u in r["units"]] == [k * mpeg_ts.TICKS for k in range(-(-n // mpeg_ts.UNIT))] and all(u[1] for u in r["units"])
    s = bytearray(mpeg_ts.mux(bytes(5000)))
    assert mpeg_ts.demux(bytes(s[:188 * 5] + s[188 * 6 :]))["cc_errors"] == 1
    assert mpeg_ts.demux(bytes(s[:188 * 6] + s[188 * 5 :]))["cc_errors"] == 0
    s[200] ^= 1
    assert mpeg_ts.demux(bytes(s))["crc_errors"] == 1 and mpeg_ts.demux(b"")["payload"] == b""


def test_media_digests(edge):
    for r, t in zip(sorted(mpeg_ts.digests(mpeg_ts.read_media(mpeg_ts.write_media(edge.where("doc_id is not null").dropDuplicates(["doc_id"])))).collect(), key=lambda r: r.doc_id), [None, "", "a b c d e f g", "a b c d e f g"]):
        assert all(r[k] == v for k, v in mpeg_ts.brute_force(t).items())


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(3)
    for _ in range(300):
        a = [r.randint(0, 5) for _ in range(r.randint(0, 25))]
        b = [x for x in a if r.random() > 0.2] + [r.randint(0, 5) for _ in range(r.randint(0, 4))]
        for most in (0, 1, 2, 3, 8, 40):
            d = plain(a, b)
            assert near_dedup.edit_distance(a, b, most) == (d if d <= most else most + 1)


def test_near_clusters_against_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    r = random.Random(5)
    base = [f"w{r.randint(0, 5000)}" for _ in range(200)]
    made = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 12):
            w[r.randrange(200)] = f"n{r.randint(0, 10**6)}"
        made.append((10_000 + i, " ".join(w)))
    made.append((20_000, " ".join(base[:100] + [f"q{k}" for k in range(100)])))
    rows = [(x.doc_id, x.text) for x in docs.collect()] + made
    got = {x.doc_id: x.cluster_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_dedup.brute_force(dict(rows))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 199)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{k: 100 for k in range(100, 130)}, 199: 199, 200: 199, 201: 199}


def held_out_errors(rows, labels, want):
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    return sum(r.predicted != labels[r.doc_id] for r in own) / len(own), want


@pytest.mark.parametrize("op, column, most", [(toxicity.score_toxicity, "toxic", 0.08), (quality.score_quality, "quality", 0.05)])
def test_held_out_accuracy(spark, op, column, most):
    d = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{d}/labels.parquet")
    rows = op(spark.read.parquet(f"{d}/documents.parquet"), lab).collect()
    truth = {r.doc_id: r[column] for r in lab.collect()}
    mod, is_held = (3, lambda x: x == 1) if column == "toxic" else (5, lambda x: x == 0)
    assert all(r.held_out == is_held(zlib.crc32(str(r.doc_id).encode()) % mod) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted != truth[r.doc_id] for r in own) / len(own) <= most


def test_attention_gradients():
    import numpy as np
    m, texts = quality.Model(), ["a b c " * 60, "X!! Y!! " * 90, ""]
    bags = [quality.passages(t) for t in texts]
    x, bag = np.concatenate(bags), np.repeat(np.arange(3), list(map(len, bags)))
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)
    g = m.gradients(x, bag, 3, y, w)
    loss = lambda: -(y * np.log(p := m.forward(x, bag, 3)[0]) + (1 - y) * np.log(1 - p)).sum()
    for k in m.names:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        m.p[k][at] += 1e-5
        a = loss()
        m.p[k][at] -= 2e-5
        assert abs((a - loss()) / 2e-5 - g[k][at]) < 1e-5
        m.p[k][at] += 1e-5


PII = ["mail bob.a+1@ex-a.co.uk, @x a@b.c@d.e.f", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "4111 1111-1111 1111 and 4111111111111112", "+1 (555) 010-9999 +12 +1234567 8901234567", "a@@b.cc é+49 30 1234567é", "1..2.3.4 x@y z@1.2.3.4 +1", ""]


def test_base_spans_are_the_plain_patterns():
    r = random.Random(9)
    texts = PII + ["".join(r.choice("a1.@+- ()é9") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        want = pii.brute_force(t)
        got = pii.base_spans(t)
        assert ",".join(f"{k}:{s}:{e}" for k, s, e in got) == want[4]


def test_revealing_terms(spark):
    rows = [(i, f"note {'abcdefghij'[i % 10] * 4} the zorblax agent wrote to secret@corp.example on day {'qwertyuiop'[i % 10] * 3} the") for i in range(6)]
    rows += [(100 + i, f"the plain text number {'klmnopqrst'[i % 10] * 4} the") for i in range(60)] + [(500, "someone saw Zorblax, today"), (501, "copy owner solo@corp.example quixotic")] + [(600 + i, "copy owner solo@corp.example quixotic") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = pii.revealing_terms(docs)
    named = {r.term: r for r in terms.collect()}
    assert "zorblax" in named and "the" not in named and "quixotic" not in named
    got = {r.doc_id: r for r in pii.find_pii(docs, terms).collect()}
    assert got[500].spans == "term:12:19" and got[500].n_email == 0 and got[0].spans.startswith("email:") and "[EMAIL]" in got[0].sanitised


def test_pii_without_broadcast_agrees(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the zorblax agent {'abcdef'[i] * 4} wrote secret@corp.example") for i in range(6)] + [(50 + i, "plain words here") for i in range(20)], "doc_id long, text string")
    want = sorted(map(repr, pii.find_pii(docs, pii.revealing_terms(docs)).collect()))
    monkeypatch.setattr(pii, "if_small", lambda df: (df, False))
    assert sorted(map(repr, pii.find_pii(docs, pii.revealing_terms(docs)).collect())) == want and "term:" in want[0]


def test_urls(spark):
    urls = ["http://a.com/x", "http://a.com", "ftp://WWW.Example.com/en/1?q#f", "x://b.example.com/en/", "x://notexample.com/en/", "http://q.net/fr/", "http://net/es/a", "nothing", None, "http://com/?/en/", "http://a.net/FR/"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark)).orderBy("page_id").collect()]
    assert got == [("a.com", "/x", "com/", "allow"), ("a.com", "", None, "allow"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("b.example.com", "/en/", "example.com/en/", "block"),
                   ("notexample.com", "/en/", "com/", "allow"), ("q.net", "/fr/", "net/fr/", "block"), ("net", "/es/a", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "/", "com/", "allow"), ("a.net", "/FR/", None, "allow")]


def test_shards_keep_groups_and_balance(spark):
    r = random.Random(4)
    rows = [(i, "w" * r.randint(1, 400) + str(i)) for i in range(900)] + [(1000 + i, f"copy {i % 20} " + "z" * 50) for i in range(100)] + [(5000 + i, "hot" * 40) for i in range(800)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    load, slots, homes = [0] * 8, {s: [] for s in range(8)}, {}
    for x in got:
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
        homes.setdefault(text[x.doc_id], set()).add(x.shard)
        assert x.text_crc32 == zlib.crc32(text[x.doc_id].encode()) and x.size == len(text[x.doc_id]) + 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load) - min(load) <= 0.03 * sum(load) / 8
    assert all(len(h) == 1 for t, h in homes.items() if not t.startswith("hot")) and len(homes["hot" * 40]) <= 4  # a third of all bytes needs three shards


def test_bpe_equals_the_library(spark, data):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    r = random.Random(1)
    shared = " ".join(f"word{r.randint(0, 999)}" for _ in range(3000))
    docs += [(100_000 + i, f"Start {i}x {shared} end{i}") for i in range(5)] + [(200_000, None), (200_001, "<|endoftext|>I'LL Ǆ İ e\u0301 Σίσυφος\x1c x\u00a0y ² ½ __ 漢字😀"), (200_002, "y" * 20_000), (200_003, shared[5:-7])]
    rows = bpe.encode_documents(spark.createDataFrame(docs, "doc_id long, text string"), with_ids=True)
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in rows.collect()}
    want = dict(zip([i for i, _ in docs], bpe.brute_force([t for _, t in docs])))
    assert got == want
    some = rows.where("doc_id >= 200000")
    for x in bpe.decode_documents(some).collect():
        assert hashlib.sha256(x.text.encode()).hexdigest() == got[x.doc_id][2]


def test_chunks_follow_content():
    r = random.Random(2)
    shared = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(4000)).encode()
    a, b = (bpe.cores(p + shared) for p in (b"x y ", b"another start of the text "))
    common = {fp for *_, fp in a} & {fp for *_, fp in b}
    assert len(common) >= len(a) - 2 > 5


def test_pipeline_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    clean = {r.doc_id for r in toxicity.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect() if not r.predicted}
    last = {}
    for i in sorted(clean):
        last[docs[i]] = i
    cluster = near_dedup.brute_force({i: docs[i] for i in last.values()})
    left = {i for i, c in cluster.items() if i == c}
    frame = spark.read.parquet(f"{d}/documents.parquet").where(F.col("doc_id").isin(*left))
    want = sorted(i for r in mixing.mix(frame).collect() if r.taken for i in [r.doc_id] * -(-r.taken // r.size))
    assert sorted(r.doc_id for r in rows) == want
    truth = dict(zip(docs, bpe.brute_force(list(docs.values()))))
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == truth[r.doc_id] for r in rows)


def replaced(words, share, r, every=False):
    """words with a share of them replaced, at random places or evenly spread."""
    n = int(len(words) * share + 1e-9)
    at = [int((k + 0.5) * len(words) / n) for k in range(n)] if every else r.sample(range(len(words)), n)
    return [f"n{r.randint(0, 10**9)}" if i in set(at) else w for i, w in enumerate(words)]


def test_near_pairs_of_every_length_and_edit(spark):
    """Pairs of 5 to 400 words at 10 to 20 % edits."""
    r = random.Random(11)
    rows = []
    for n in (5, 8, 10, 12, 15, 30, 38, 39, 48, 49, 60, 150, 400):
        for share in (0.1, 0.15, 0.2):
            for every in (False, True):
                for _ in range(4):
                    a = [f"v{r.randint(0, 10**9)}" for _ in range(n)]
                    rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(replaced(a, share, r, every)))]
    for k in range(6):  # a phrase repeated, with a fifth of the words new
        a = [f"u{k}"] * 300
        rows += [(len(rows) + j, " ".join(replaced(a, 0.1, r, True))) for j in range(2)]
    got = {x.doc_id: x.cluster_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_near_chains_beside_a_crowd(spark, monkeypatch):
    """B near the hot text A, C near B but not near A, D near C only; in one block and in many."""
    r = random.Random(12)
    a = [f"v{k}" for k in range(200)]
    rows = [(i, " ".join(replaced(a, 0.05, r))) for i in range(150)]
    for _ in range(12):
        b = replaced(a, 0.05, r)
        c = replaced(b, 0.18, r)
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate((b, c, replaced(c, 0.18, r)))]
    rows += [(len(rows) + k, " ".join(a[:80] + [f"q{k}x{j}" for j in range(120)])) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_dedup.brute_force(dict(rows))
    assert {x.doc_id: x.cluster_id for x in near_dedup.near_duplicates(frame).collect()} == want
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    assert {x.doc_id: x.cluster_id for x in near_dedup.near_duplicates(frame).collect()} == want


def test_revealing_terms_of_any_spelling(spark):
    names = ["jean-luc", "o'brien", "acct-4471", "user99", "xi", "\u0915\u093f\u0930\u0923"]
    rows = [(10 * k + j, f"{'pqrst'[j] * 5} {name} wrote to box{k}@corp.example {'uvwxy'[j] * 4} {'y' * 900} end") for k, name in enumerate(names) for j in range(2)]
    rows += [(1000 + i, f"plain words of text number {i}") for i in range(200)] + [(2000, "saw Jean-Luc, and (O'Brien)"), (3000, "once@corp.example hapax")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = pii.revealing_terms(docs)
    named = {r.term for r in terms.collect()}
    assert set(names) <= named and "plain" not in named and "hapax" not in named
    got = {r.doc_id: r for r in pii.find_pii(docs, terms).collect()}
    assert got[2000].spans == "term:4:12,term:19:26"


def test_blocks_that_the_first_leads_connect_are_not_refined(spark, monkeypatch):
    """A group of near copies goes on only where its members are not yet connected, and the clusters are those of all pairs."""
    r = random.Random(5)
    rows, went = [], []
    for group in range(3):
        words = [f"g{group}w{r.randrange(400)}" for _ in range(120)]
        for n in range(40):
            own = list(words)
            for _ in range(4):
                own[r.randrange(120)] = f"x{n}"
            rows.append((100 * group + n, " ".join(own)))
    refined = near_dedup.refined

    def seen(near, words, least):
        went.append(near.count())
        return refined(near, words, least)

    monkeypatch.setattr(near_dedup, "refined", seen)
    got = {x.doc_id: x.cluster_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_dedup.brute_force(dict(rows))
    assert went == [0]


def test_near_copies_are_broadcast_only_after_a_count(spark, monkeypatch):
    """Where no side is counted as small none is broadcast, whatever Spark takes the sides for, and the clusters are those of all pairs."""
    r = random.Random(9)
    rows = []
    for group in range(4):
        words = [f"g{group}w{r.randrange(300)}" for _ in range(90)]
        for n in range(6):
            own = list(words)
            for _ in range(4 * n):
                own[r.randrange(90)] = f"x{group}y{r.randrange(50)}"
            rows.append((10 * group + n, " ".join(own)))
    plans, durable, if_small = [], near_dedup.durable, near_dedup.if_small

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return durable(df, name)

    monkeypatch.setattr(near_dedup, "durable", noted)
    monkeypatch.setattr(near_dedup, "if_small", lambda df, *_: if_small(df, 0))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(("answer", out._jdf.queryExecution().sparkPlan().toString()))
    assert [name for name, plan in plans if "Broadcast" in plan] == []
    assert sum("Join" in plan for _, plan in plans) > 5
    assert {x.doc_id: x.cluster_id for x in out.collect()} == near_dedup.brute_force(dict(rows))


@pytest.mark.parametrize("stage", ["exact_dedup", "near_dedup"])
def test_stages_broadcast_only_what_is_counted(spark, monkeypatch, tmp_path, stage):
    """Where no table of what goes is counted as small, a stage joins the documents with it by shuffle, whatever Spark takes it for."""
    rows = [(i, f"w{i % 8} " * 4 + " ".join(f"v{i % 8}t{k}" for k in range(30)) + " " * (i % 2), "en", "s", None) for i in range(24)]
    rows += rows[:3]  # rows that repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    run = dict(corpus_pipeline.STAGES)[stage]
    want = sorted(map(repr, run(spark, docs, str(tmp_path)).collect()))
    if_small = corpus_pipeline.if_small
    monkeypatch.setattr(corpus_pipeline, "if_small", lambda df, *_: if_small(df, 0))
    out = run(spark, docs, str(tmp_path))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
    assert sorted(map(repr, out.collect())) == want
