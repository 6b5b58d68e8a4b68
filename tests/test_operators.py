"""Golden rows of the text, alignment, extraction, rule, retrieval and fold operators."""
import random

import pytest
from pyspark.sql import functions as F

from provena.functions import text as T
from provena.operators import align, evaluate, extract, retrieval, rules
from provena.sources import readers
from provena.streaming import folds


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("word, stem", [("والكتاب", "كتاب"), ("الله", "الله"), ("بالله", "الله"), ("فالله", "الله"), ("وال", "وال"), ("كالبحر", "بحر"), ("للناس", "ناس"), ("قلم", "قلم")])
def test_stem(spark, word, stem):
    assert one(spark, T.light_stem(F.lit(word))) == stem


def test_normal_forms(spark):
    t = F.lit("قَالَ أحمدُ: المدرسةُ، 12")
    assert one(spark, T.normalize(t, T.ARABIC)) == "قال احمد المدرسه"
    assert one(spark, T.display_tokens(t, T.ARABIC)) == ["قال", "أحمد", "المدرسة"]
    assert one(spark, T.normalize(F.lit("Hello,  World_2 x"))) == "hello world x"
    decomposed = "ا" + "ٔ" + "حمد"
    assert one(spark, T.normalize(F.lit(decomposed), T.ARABIC, compose=True)) == "احمد"
    assert one(spark, T.normalize(F.lit(None).cast("string"))) is None


def test_runs_and_pairs(spark):
    arr = lambda s: F.split(F.lit(s), " ")
    assert one(spark, T.contains_run(arr("a b c d"), arr("b c"))) and not one(spark, T.contains_run(arr("a b"), arr("a b c")))
    assert one(spark, T.letter_pairs(F.lit("abab"))) == ["ab", "ba"] and one(spark, T.letter_pairs(F.lit("a"))) == ["a"]
    assert one(spark, T.split_particles(arr("لاتكتب لاعب"), F.array(F.lit("تكتب"), F.lit("لاعب"), F.lit("عب")))) == ["لا", "تكتب", "لاعب"]
    rows = spark.createDataFrame([(1, ["لاتكتب", "لاعب"]), (2, ["قلم"]), (3, []), (4, None)], "id int, words array<string>")
    vocabulary = spark.createDataFrame([("تكتب",), ("لاعب",), ("عب",)], "term string")
    assert {r.id: r.words for r in T.split_joined(rows, "words", vocabulary).collect()} == {1: ["لا", "تكتب", "لاعب"], 2: ["قلم"], 3: [], 4: None}
    assert one(spark, T.quote_url(F.lit("a b/ج"))) == "a%20b%2F%D8%AC"
    assert one(spark, T.word_ngrams(F.array(F.lit("a")), 2, 4)) == [" a", "a ", " a "]


def aligned(spark, pairs, *profile, **options):
    """The alignments of (claim, source) pairs, in their order."""
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").coalesce(1)
    return [r.al for r in align.align_pairs(rows, "a", "b", *profile, **options).orderBy("i").collect()]


def test_align_self_and_changes(spark):
    text = "one two three four five six"
    full, part, changed, empty, null = aligned(spark, [(text, text), ("three four", text), ("one two tree four five six", text), ("", text), (None, text)], stemmed=False)
    assert full["exact"] and full["claim_coverage"] == full["dice"] == 1.0 and (full["span_start"], full["span_end"]) == (0, 6)
    assert part["exact"] and part["span_start"] == 2 and part["span_coverage"] == 1.0
    assert not changed["exact"] and [d["op"] for d in changed["diff"]] == ["equal", "changed", "equal"] and changed["added"] == [["tree"]]
    assert tuple(changed["diff"][1]) == ("changed", None, "tree", "three") and changed["diff"][0]["text"] == "one two"
    assert empty["diff"] == [] and null["claim_coverage"] == 0.0 and not null["exact"]
    missing, other, tail = aligned(spark, [("one two four five six", text), ("zzz", text), ("five seven", text)])
    assert [d["op"] for d in missing["diff"]] == ["equal", "missing", "equal"]
    assert other["added"] == [["zzz"]] and tail["tail_source"] == "six"


def test_align_keeps_negation_and_picks_the_span(spark):
    """The literal words win over an earlier run of equal stems; a conjunction may stand before the first word; content words count apart."""
    pair = ("كتاب جديد", "الكتاب الجديد ثم كتاب جديد")
    kept, literal = aligned(spark, [("يكتب الطالب درسا", "قال لا يكتب الطالب درسا"), pair], T.ARABIC, stemmed=False, keep_negation=True)
    assert not kept["exact"] and kept["diff"][0]["op"] == "missing"
    assert literal["exact"] and (literal["span_start"], literal["span_end"]) == (3, 5)
    loose, content = aligned(spark, [pair, ("في بيت", "من بيت")], T.ARABIC)
    assert loose["span_start"] == 0 and content["claim_coverage"] == 0.5 and content["content_coverage"] == 1.0
    after, = aligned(spark, [("قل خيرا", "ثم وقل خيرا")], T.ARABIC, stemmed=False, leading_conjunction=True)
    assert after["exact"] and after["span_start"] == 1


def test_first_run_against_slices():
    import random
    r = random.Random(2)
    for _ in range(500):
        hay, needle = ([r.choice("abc") for _ in range(n)] for n in (r.randint(0, 12), r.randint(1, 4)))
        assert align.first_run(hay, needle) == next((i for i in range(len(hay)) if hay[i : i + len(needle)] == needle), None)


def test_align_benchmark_passages_to_themselves(spark, data):
    b = spark.read.parquet(f"{data}/benchmark.parquet").withColumn("s", F.col("text"))
    got = align.align_pairs(b, "text", "s", stemmed=False).where(F.size(T.key_tokens(F.col("text"))) > 0).select("al.exact", "al.claim_coverage").collect()
    assert got and all(r.exact and r.claim_coverage == 1 for r in got)


def claims(spark, *texts):
    """The claims of each text, in order."""
    rows = extract.extract_claims(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"]).orderBy("id", "claim_id").collect()
    return [[r for r in rows if r.id == i] for i in range(len(texts))]


def test_extract_quotes_cues_and_limits(spark):
    quote, many, personal, asked, null, blank, plain = claims(spark, 'قال تعالى: «نص أول هنا» ثم "قول آخر"', " ".join(f'"word {i}"' for i in range(15)), "هل يجوز لي أن أسافر؟", "هل هذا الحديث: العلم نور وهدى صحيح", None, "   ", 'a "bc de" f')
    assert [(x["text"], x["hint"], x["level"]) for x in quote] == [("نص أول هنا", "quran", "A"), ("قول آخر", "unknown", "B")]
    assert len(many) == 12 and many[0]["omitted"] == 3 and [x["claim_id"] for x in many] == list(range(1, 13))
    assert personal[0]["level"] == "D"
    assert asked[0]["hint"] == "hadith" and asked[0]["text"] == "العلم نور وهدى"
    assert null[0]["text"] == "" and len(blank) == 1 and [x["text"] for x in plain] == ["bc de"]


def test_extract_spans_and_offsets(spark):
    texts = ['«أ "بب جج" دد» ثم "هه وو"', "﴿نص آية هنا﴾ وبعدها زوجتي قالت شيئا. قال رسول الله ﷺ العلم نور للناس، فهل يجوز لي تركه؟", "أعطني حديثا يثبت هذا الكلام. لماذا يصوم الناس رمضان؟", "one two three. four five six? " + "x " * 200]
    overlap, mixed, back, long = claims(spark, *texts)
    assert [x["text"] for x in overlap] == ['أ "بب جج" دد', "هه وو"]
    assert [x["hint"] for x in mixed] == ["quran", "personal", "personal", "hadith"] and mixed[3]["text"] == "العلم نور للناس"
    assert mixed[1]["text"] == "﴿نص آية هنا﴾ وبعدها زوجتي قالت شيئا" and mixed[2]["text"].endswith("تركه")
    assert {x["request"] for x in back} == {"evidence_ref", "question"}
    assert [x["text"] for x in long][:2] == ["one two three", "four five six"] and len(long) == 3
    for text, found in zip(texts, (overlap, mixed, back, long)):
        for x in found:
            assert x["text"] in text[x["start"] : x["end"]] and x["context_after"] in ("", text[x["end"] : x["end"] + 120])


def test_extract_against_plain_quotes(spark, data):
    """Quoted spans of whole documents against a plain scan in priority of the styles."""
    import re
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.concat(F.lit("«x y» "), F.col("text"), F.lit(' "end here"')).alias("text"))
    got = {}
    for r in extract.extract_claims(rows.where(F.length("text") < 3000), ["doc_id"]).where("hint != 'personal'").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    for r in rows.where(F.length("text") < 3000).collect():
        want = []
        for _, pattern in extract.QUOTES:
            want += [m.span() for m in re.finditer(pattern, r.text) if all(m.end() <= s or m.start() >= e for s, e in want)]
        assert got[r.doc_id] == sorted(want)[:12]


def test_verdict_table(spark):
    cols = "level string, hint string, question boolean, n_words int, v_coverage double, v_exact boolean, v_whole boolean, h_content double, h_exact boolean, h_whole boolean, h_verdict string, source_verified boolean, want string"
    cases = [("D", "personal", True, 5, None, None, None, None, None, None, None, None, "REFER"), ("D", "personal", False, 5, 1.0, True, True, None, None, None, None, True, "VERIFIED"),
             ("A", "quran", False, 5, 0.9, False, False, None, None, None, None, True, "ALTERED"), ("A", "quran", False, 2, 0.9, False, False, None, None, None, None, True, "NEEDS_REVIEW"),
             ("A", "quran", False, 5, 0.3, False, False, None, None, None, None, True, "NO_ORIGIN"), ("A", "hadith", False, 5, None, None, None, 0.9, True, True, "NOT_AUTHENTIC", True, "NOT_AUTHENTIC"),
             ("A", "hadith", False, 5, None, None, None, 0.7, False, False, "VERIFIED", True, "NEEDS_REVIEW"), ("C", "unknown", False, 5, None, None, None, None, None, None, None, None, "DISPUTED"),
             ("B", "unknown", False, 5, 0.7, False, False, None, None, None, None, True, "NEEDS_REVIEW"), ("B", "unknown", False, 1, None, None, None, None, None, None, None, None, "NO_ORIGIN"),
             ("B", "unknown", False, 2, 1.0, True, True, None, None, None, None, True, "VERIFIED")]
    got = rules.judge(spark.createDataFrame(cases, cols)).collect()
    assert [r.verdict for r in got] == [r.want for r in got]


def test_unreviewed_source_needs_review(spark):
    cols = "level string, hint string, question boolean, n_words int, v_coverage double, v_exact boolean, v_whole boolean, h_content double, h_exact boolean, h_whole boolean, h_verdict string, source_verified boolean"
    df = spark.createDataFrame([("A", "quran", False, 5, 1.0, True, True, None, None, None, None, False)], cols)
    assert rules.judge(df, rules.Thresholds(require_verified=True)).first().verdict == "NEEDS_REVIEW"


def test_near_phrase_and_close(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "the quick brawn fox jumps over"), (3, "the quick zzzzz fox jumps")], "id int, text string")
    q = spark.createDataFrame([(9, "quick brown fox jumps")], "qid int, text string")
    index = retrieval.build_index(docs, "id")
    assert [(r.qid, r.id) for r in retrieval.near_phrases(index, q, "qid").collect()] == [(9, 2)]
    assert [r.id for r in retrieval.phrases(index, q, "qid").collect()] == [1]


def test_mutations(spark):
    r = spark.createDataFrame([(1, "aa bbbbb cc dddd ee ff gg hhhh ii")], "id int, text string")
    got = {x.family: x.query for x in evaluate.typo_mutations(r, "id").collect()}
    assert got["letter_dropped"] == "aa bbbb cc dddd ee ff gg hhhh ii" and got["two_words_typos"] == "aa bbbb cc ddd ee ff gg hhhh ii"
    assert got["excerpt_with_typo"] == "cc ddd ee ff gg" and set(got) == {"exact", "letter_dropped", "letters_swapped", "two_words_typos", "excerpt_with_typo"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1|1|first\n# note\n1|2| second \n")
    assert [tuple(r) for r in readers.numbered_lines(spark, str(tmp_path / "a.txt")).orderBy("ord").collect()] == [(1, 1, "first"), (1, 2, "second")]
    raw = spark.createDataFrame([('{"x": [{"s": 1, "verse": 2, "txt": "t"}, {"s": 3}]}',), ("broken",), (None,)], "j string")
    got = readers.tolerant_records(raw, "j", {"grp": ["surah", "s"], "ord": ["ayah", "verse"], "text": ["text", "txt"]}).collect()
    assert [(r.grp, r.ord, r.text) for r in got] == [("1", "2", "t")]
    assert spark.createDataFrame([("<p>a &amp; b</p><script>x</script>",)], "h string").select(readers.plain_text("h").alias("t")).first().t == "a & b"
    readers.save_index({"p": spark.range(3)}, str(tmp_path / "i"))
    assert readers.load_index(spark, str(tmp_path / "i"), ["p"])["p"].count() == 3
    assert readers.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "a.txt")).endswith("a.txt")
    docs = spark.createDataFrame([(1, ["x", "y"])], "id int, grades array<string>")
    links = spark.createDataFrame([(1, ["u"])], "id int, urls array<string>")
    assert [(g.item, g.url) for g in readers.with_links(docs, links, "id", "grades", "urls").first().grades] == [("x", "u"), ("y", None)]


def test_folds():
    assert folds.admit([0, 1, 2, 59, 60, 61], 2)[0] == [True, True, False, False, True, True]
    assert folds.cache_hits(list("abacab"), [0, 1, 2, 3, 4, 5], 2, 100) == [False, False, True, False, True, False]
    assert folds.cache_hits(["a", "a", "a"], [0, 5, 11], 2, 10) == [False, True, False]
    assert folds.cache_hits(["a", "a", "a"], [0, 1, 2], 2, 10, ok=[False, True, True]) == [False, False, True]


def test_folds_against_whole_histories(spark):
    """A hot key in many batches, ties in time and a null key, against the fold of each key's sorted rows."""
    rows = [(i % 3 if i % 4 else 0, i, f"2024-01-01 00:{i // 7 % 60:02d}:{i % 60:02d}", "abc"[i * i % 3]) for i in range(400)] + [(None, 999, "2024-01-01 00:00:00", "a")]
    df = spark.createDataFrame(rows, "k long, id long, ts string, item string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        admitted = {r.id: r.admitted for r in folds.rate_limit(df, "k", "id", "ts", 2).collect()}
        hits = {r.id: r.hit for r in folds.cache(df, "k", "id", "ts", "item", 2, 90.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    second = lambda ts: int(ts[14:16]) * 60 + int(ts[17:])
    for k in range(3):
        own = sorted((second(ts), i, item) for key, i, ts, item in rows if key == k)
        assert [admitted[i] for _, i, _ in own] == folds.admit([t for t, *_ in own], 2)[0]
        assert [hits[i] for _, i, _ in own] == folds.cache_hits([x for *_, x in own], [t for t, *_ in own], 2, 90.0)
    assert 999 not in admitted


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    schema = "user_id long, event_id long, t double"
    rows = [(i % 3, i, float(i * 7 % 50)) for i in range(60)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = folds.rate_limit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "user_id", "event_id", 3)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: r.admitted for r in spark.table("limited").collect()}
    want = {}
    for u in range(3):
        own = sorted((t, e) for k, e, t in rows if k == u)
        want |= dict(zip([e for _, e in own], folds.admit([t for t, _ in own], 3)[0]))
    assert got == want


def test_dense_top_makes_no_row_for_each_pair_and_is_the_top_of_all_scores(spark):
    r = random.Random(3)
    v = lambda: [r.gauss(0, 1) / 8 for _ in range(64)]
    common = v()
    rows = [(n, v()) for n in range(300)] + [(n, common) for n in range(300, 360)] + [(360, None), (361, [0.5] * 3), (362, [float("nan")] * 64), (363, [None] + [0.1] * 63), (None, v()), (7, v()), (364, []), (365, [0.0] * 64)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.where("vec_id % 20 = 0 or vec_id >= 360")
    want = retrieval.top(retrieval.dense_scores(e, "vec_id", q, "query_id"), "query_id", "vec_id", 8)
    got = retrieval.dense_top(e, "vec_id", q, "query_id", 8)
    key = lambda t: sorted(map(repr, t.select("query_id", "vec_id", "rank", "score").collect()))
    assert key(got) == key(want)
    plain = retrieval.dense_top(e.where("vec_id < 360"), "vec_id", q.where("vec_id < 360"), "query_id", 8)
    assert "Join" not in plain._jdf.queryExecution().executedPlan().toString()
    assert key(plain) == key(retrieval.top(retrieval.dense_scores(e.where("vec_id < 360"), "vec_id", q.where("vec_id < 360"), "query_id"), "query_id", "vec_id", 8))
    assert retrieval.dense_top(e.limit(0), "vec_id", q, "query_id", 8).count() == retrieval.dense_top(e, "vec_id", q.limit(0), "query_id", 8).count() == 0


@pytest.mark.parametrize("name", ["dense_topk", "rrf_topk"])
def test_dense_queries_meet_no_nested_loop(spark, name):
    from provena.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
