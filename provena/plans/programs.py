"""Named queries of the batch programs: captures and their checks, forms of questions, evaluation and display, each with its SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import text as T
from provena.operators import display, encoder, evaluate, retrieval
from provena.plans import samples
from provena.plans.queries import _P, TOK, WORDS, _scores, query, table
from provena.sources import validation
from provena.sources.tables import stored

# -- captures and checks --------------------------------------------------------------------------------------------

_INFO = "'الراوي: [' || n_name || '] المحدث: ' || r_name || ' المصدر: S' || n_regionkey || ' | الصفحة أو الرقم: ' || n_nationkey || ' خلاصة حكم المحدث: '"


def _results(spark, d):
    """r_regionkey, body: a response for each region with a block for each of its nations; every fifth has no ruling."""
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    info = F.concat(F.lit("الراوي: ["), "n_name", F.lit("] المحدث: "), "r_name", F.lit(" المصدر: S"), F.col("n_regionkey").cast("string"), F.lit(" | الصفحة أو الرقم: "), F.col("n_nationkey").cast("string"), F.lit(" خلاصة حكم المحدث: "), F.when(F.col("n_nationkey") % 5 != 0, "<b>صحيح</b>").otherwise(""))
    block = F.concat(F.lit('<div class="hadith">'), F.col("n_nationkey").cast("string"), F.lit(" - land of <i>"), "n_name", F.lit('</i> &amp; more . .</div>\n<div class="hadith-info">'), info, F.lit("</div>"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", block.alias("b")))), lambda x: x["b"]), "")
    return j.groupBy("r_regionkey").agg(html.alias("html")).select("r_regionkey", F.to_json(F.struct(F.struct(F.col("html").alias("result")).alias("ahadith"))).alias("body"))


@query("""SELECT r_regionkey, pos, text, narrator, muhaddith, source, ref, grade FROM (SELECT r_regionkey, n_nationkey, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1)::INTEGER AS pos,
'land of ' || n_name || ' & more' AS text, n_name AS narrator, r_name AS muhaddith, 'S' || n_regionkey AS source, n_nationkey::VARCHAR AS ref, 'صحيح' AS grade FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE n_nationkey % 5 <> 0""")
def live_records(spark, d):
    return validation.result_records(_results(spark, d), "r_regionkey", "body")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'labels' WHEN n_nationkey % 4 = 1 THEN 'empty_field' WHEN n_nationkey % 4 = 2 THEN 'no_text' END AS error FROM nation""")
def strict_results(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey") % 4
    tail = F.when(k == 0, "").otherwise(F.concat(F.lit(" خلاصة حكم المحدث: "), F.when(k == 1, "").otherwise("حسن")))
    f = F.concat(F.when(k == 2, "3 - ").otherwise(F.concat(F.lit("3 - "), "n_name")), F.lit(" الراوي: a المحدث: b المصدر: c الصفحة أو الرقم: 7"), tail)
    return validation.strict_result(n.select("n_nationkey", F.concat(F.lit("<p>"), f, F.lit("</p>")).alias("f")), "f").select("n_nationkey", "error")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 0 THEN 0 END::INTEGER AS grade_index, ['no_grades', 'incomplete', 'unknown_ruling', 'other_class'][n_nationkey % 5 + 1] AS problem FROM nation WHERE n_nationkey % 5 < 4""")
def grade_checks(spark, d):
    k = F.col("n_nationkey") % 5
    grade = F.struct(F.lit("m").alias("muhaddith"), F.when(k == 1, " ").otherwise("s").alias("source"), F.lit("1").alias("ref"), F.when(k == 2, "رأي").otherwise("ضعيف جدا").alias("grade"), F.when(k == 3, "weak").otherwise("very_weak").alias("class"))
    return validation.grade_violations(table(spark, d, "nation").select("n_nationkey", F.when(k > 0, F.array(grade)).alias("grades")), "n_nationkey", "grades")


@query("""SELECT l_shipdate::DATE >= o_orderdate::DATE AS in_order, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def review_dates(spark, d):
    """Dates as ISO stamps with a zone on one side and as plain dates on the other."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stamp = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return rows.select(validation.reviewed_after(stamp, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("in_order")).groupBy("in_order").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT c_custkey, c_custkey % 7 <> 0 AS verified, c_custkey % 3 = 0 AS told, c_custkey % 5 = 0 AS missing, c_custkey % 4 AS n, c_custkey % 11 = 0 AS wrong FROM customer)
SELECT c_custkey, 'not_reviewed' AS problem FROM r WHERE NOT verified UNION ALL SELECT c_custkey, 'provenance' FROM r WHERE told AND missing UNION ALL SELECT c_custkey, 'endpoint' FROM r WHERE told AND c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'dates' FROM r WHERE told AND missing UNION ALL SELECT c_custkey, 'not_quoted' FROM r WHERE told AND wrong UNION ALL SELECT c_custkey, 'no_evidence' FROM r WHERE NOT told AND n = 0""")
def seed_checks(spark, d):
    k = F.col("c_custkey")
    source = F.concat(F.lit("as told, "), F.when(k % 11 != 0, F.col("c_name")).otherwise("other words"), F.lit("; end"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("text"), (k % 7 != 0).alias("verified"), F.when(k % 3 == 0, "assisted_api_transcript").alias("method"), F.when(k % 2 == 0, "http://x").otherwise("https://x").alias("endpoint"), F.lit("q").alias("query"),
                                              F.when(k % 5 != 0, "2026-10-03").alias("retrieved_at"), F.lit("2026-10-04T10:00:00Z").alias("reviewed_at"), source.alias("source_text"), (k % 4).alias("n_evidence"))
    return validation.seed_violations(rows, "c_custkey")


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\p{M}ـ]', '', 'g'), '\p{P}', ' ', 'g'), '\s+', ' ', 'g'))) AS key FROM documents""")
def text_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.text_key(F.col("text"))).alias("key"))


@query(f"SELECT id, trim(regexp_replace(translate(regexp_replace(regexp_replace(text, '[\\x{{feff}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{00ad}}]', '', 'g'), '{T.MARKS}', '', 'g'), '{T.VARIANTS[0]}', '{T.VARIANTS[1]}'), '\\s+', ' ', 'g')) AS normal FROM {_P}")
def comparer_normal(spark, d):
    return spark.createDataFrame(samples.PHRASES, "id int, text string").select("id", T.comparable(F.col("text")).alias("normal"))


@query("SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id <> 1 THEN text ELSE 'In the beginning ' || text END AS text FROM conversations")
def opening_removed(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.concat(F.lit("In the beginning "), "text"))
    return c.select("conv_id", "turn", T.first_of_group(F.col("text"), F.col("conv_id"), F.col("turn") + 1, "In the beginning").alias("text"))


# -- forms ----------------------------------------------------------------------------------------------------------

@query("""SELECT item_id, form, replace(pattern, '{}', text) AS query FROM benchmark, (VALUES ('quoted', 'قال رسول الله ﷺ: «{}»'), ('what_is_its_grade', 'ما صحة حديث {}؟'), ('heard_that', 'سمعت أن النبي قال {}، صحيح؟')) f(form, pattern)""")
def question_forms(spark, d):
    return evaluate.question_forms(table(spark, d, "benchmark"), "item_id")


@query(f"""WITH w AS (SELECT item_id, text, {WORDS.format('text')} AS ws FROM benchmark), a AS (SELECT *, list_sort(list_transform(ws, lambda v, i: {{'n': -length(v), 'i': i}}))[1].i AS longest FROM w WHERE len(ws) > 0),
n AS (SELECT *, list_transform(ws, lambda v, i: CASE WHEN i = longest AND length(v) >= 3 THEN left(v, 2) || 'ـ' || substr(v, 3) ELSE v END || CASE WHEN i = 2 AND len(ws) >= 3 THEN '،' ELSE '' END) AS nw FROM a)
SELECT item_id, 'marked' AS form, '﴿' || text || '﴾' AS query, 'VERIFIED' AS expected FROM a UNION ALL
SELECT item_id, 'noisy', nw[1] || '  ' || array_to_string(nw[2:], ' ') || '.', 'VERIFIED' FROM n UNION ALL
SELECT item_id, 'word_missing', '﴿' || array_to_string(list_concat(ws[1:len(ws)//2], ws[len(ws)//2+2:]), ' ') || '﴾', 'ALTERED' FROM a WHERE len(ws) >= 6""")
def verse_forms(spark, d):
    return evaluate.verse_forms(table(spark, d, "benchmark"), "item_id")


@query("SELECT n_nationkey, run FROM nation, (SELECT unnest(range(1, 4))::INTEGER AS run)")
def repeated_cases(spark, d):
    return evaluate.repeated(table(spark, d, "nation").select("n_nationkey"), 3)


@query(rf"""SELECT ' ' || trim(regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{Nl}}\p{{No}}\s]', ' ', 'g'), '\s+', ' ', 'g')) || ' ' AS p FROM (SELECT text AS t FROM benchmark UNION ALL SELECT text FROM benchmark WHERE item_id % 2 = 0)
WHERE trim(regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{Nl}}\p{{No}}\s]', ' ', 'g'), '\s+', ' ', 'g')) <> ''""")
def padded_corpus(spark, d):
    b = table(spark, d, "benchmark").withColumn("source_text", F.when(F.col("item_id") % 2 == 0, F.col("text")))
    return evaluate.padded_corpus(b, ["text", "source_text"])


# -- evaluation -----------------------------------------------------------------------------------------------------

_TRIED = """t AS (SELECT o_orderkey AS id, o_orderpriority AS form, ['VERIFIED', 'NO_ORIGIN', 'ALTERED', 'REFER'][o_orderkey % 4 + 1] AS expected, ['VERIFIED', 'NO_ORIGIN', 'ALTERED', 'REFER', 'VERIFIED'][o_custkey % 5 + 1] AS got,
o_custkey % 3 = 0 AS in_verses, o_custkey % 2 = 0 AS in_records, CASE WHEN o_orderkey % 3 > 0 THEN 's' || (o_orderkey % 3) END AS source, CASE WHEN o_custkey % 7 = 0 THEN 's1' END AS expected_source FROM orders),
u AS (SELECT *, CASE expected WHEN 'VERIFIED' THEN in_verses WHEN 'NO_ORIGIN' THEN NOT in_verses AND NOT in_records ELSE false END AS exact,
got = expected AND CASE WHEN expected_source IS NOT NULL THEN source IS NOT DISTINCT FROM expected_source WHEN expected IN ('VERIFIED', 'ALTERED') THEN source IS NOT NULL ELSE true END AS engine FROM t)"""


def _tried(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    codes = ["VERIFIED", "NO_ORIGIN", "ALTERED", "REFER"]
    t = table(spark, d, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("form"), of(codes, k % 4).alias("expected"), of([*codes, "VERIFIED"], c % 5).alias("got"), (c % 3 == 0).alias("in_verses"), (c % 2 == 0).alias("in_records"),
                                         F.when(k % 3 > 0, F.concat(F.lit("s"), (k % 3).cast("string"))).alias("source"), F.when(c % 7 == 0, "s1").alias("expected_source"))
    c = F.col
    return t.withColumns({"exact": evaluate.exact_sufficient(c("expected"), c("in_verses"), c("in_records")), "engine": evaluate.engine_sufficient(c("expected"), c("got"), c("source"), c("expected_source"))})


@query(f"WITH {_TRIED} SELECT form, count(*) AS items, count(*) FILTER (exact) AS n_exact, count(*) FILTER (engine) AS n_engine, round(count(*) FILTER (exact) / count(*), 4) AS exact_rate, round(count(*) FILTER (engine) / count(*), 4) AS engine_rate FROM u GROUP BY GROUPING SETS ((), (form))")
def benefit_by_form(spark, d):
    return evaluate.benefit(_tried(spark, d), ["form"], "exact", "engine")


@query(f"WITH {_TRIED} SELECT expected, count(*) AS claims, count(*) FILTER (exact) AS exact_sufficient, count(*) FILTER (got = expected) AS matches FROM u GROUP BY expected")
def baseline_by_expected(spark, d):
    return evaluate.by_expected(_tried(spark, d).withColumn("same", F.col("got") == F.col("expected")), "expected", "exact", "same")


@query(f"""WITH {_TRIED} SELECT form, CASE WHEN expected_source = source THEN 'right_source_other_verdict' WHEN source IS NULL THEN 'no_source' ELSE 'other_source' END AS category, got, count(*) AS n FROM u WHERE NOT engine GROUP BY ALL""")
def failure_breakdown(spark, d):
    c = F.col
    return evaluate.failures(_tried(spark, d).where(~c("engine")), "form", c("expected_source").eqNullSafe(c("source")) & c("source").isNotNull(), c("source"), "got")


@query("""WITH w AS (SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS ordinal FROM conversations WHERE turn % 2 = 0), e AS (SELECT DISTINCT conv_id, unnest([0, 1, 2])::INTEGER AS ordinal FROM conversations)
SELECT e.conv_id, e.ordinal, ['user', 'assistant', 'user'][e.ordinal + 1] AS expected, w.role AS actual FROM e LEFT JOIN w USING (conv_id, ordinal)""")
def expected_against_actual(spark, d):
    c = table(spark, d, "conversations")
    cases = c.select("conv_id").distinct().withColumn("expected", F.array(F.lit("user"), F.lit("assistant"), F.lit("user")))
    return evaluate.expected_against_actual(cases, "conv_id", "expected", c.where("turn % 2 = 0"), "role", "turn")


@query("""WITH g AS (SELECT user_id, avg(value) FILTER (event_type = (SELECT min(event_type) FROM events)) AS a, avg(value) FILTER (event_type = (SELECT max(event_type) FROM events)) AS b FROM events GROUP BY user_id)
SELECT count(*) AS groups, count(*) FILTER (a > b) AS a_beats_b FROM g""")
def method_beats(spark, d):
    e = table(spark, d, "events")
    first, last = e.agg(F.min("event_type"), F.max("event_type")).first()  # two names
    return evaluate.beats(e, "user_id", "event_type", "value", first, last)


@query("""WITH p AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, count(DISTINCT l_linestatus) AS v, count(DISTINCT l_returnflag) AS x FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'runs' AS problem FROM p WHERE n <> 3 UNION ALL SELECT l_orderkey, 'versions' FROM p WHERE v > 1 UNION ALL SELECT l_orderkey, 'differs' FROM p WHERE x > 1""")
def evidence_consistency(spark, d):
    return evaluate.consistency(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", 3)


_HOLD = f"""v AS (SELECT conv_id, turn, {WORDS.format('text')} AS ws FROM conversations), r AS (SELECT conv_id, turn, conv_id || ':' || turn || CASE WHEN turn % 2 = 0 THEN '-' || (turn + 1) ELSE '' END AS id, ws[3:5] AS intended FROM v),
h AS (SELECT r.id, r.intended, ' ' || string_agg(array_to_string(v.ws, ' '), ' ' ORDER BY v.turn) || ' ' AS p FROM r JOIN v ON v.conv_id = r.conv_id AND v.turn BETWEEN r.turn AND r.turn + CASE WHEN r.turn % 2 = 0 THEN 1 ELSE 0 END GROUP BY ALL)"""


@query(f"WITH {_HOLD} SELECT id, array_to_string(intended, ' ') AS intended, len(intended) > 0 AND contains(p, ' ' || array_to_string(intended, ' ') || ' ') AS holds FROM h")
def range_holds(spark, d):
    v = table(spark, d, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("ord"), T.wording_tokens(F.col("text")).alias("w"))
    run = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("-"), (F.col("ord") + 1).cast("string"))).otherwise("")
    r = v.select(F.concat(F.col("grp").cast("string"), F.lit(":"), F.col("ord").cast("string"), run).alias("id"), F.slice("w", 3, 3).alias("intended"))
    return evaluate.holds(r, "id", "intended", v, "w").withColumn("intended", F.array_join("intended", " "))


_CHARS = f"""cw AS (SELECT item_id, ' ' || unnest({TOK.format('text')}) || ' ' AS p FROM benchmark), cn AS (SELECT item_id, p, unnest([2, 3, 4]) AS n FROM cw), cg AS (SELECT item_id, substr(p, i, n) AS g FROM (SELECT item_id, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM cn WHERE length(p) >= n)),
ctf AS (SELECT item_id, g, 1 + ln(count(*)) AS tf FROM cg GROUP BY ALL), cdf AS (SELECT g, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM ctf GROUP BY g),
cv AS (SELECT item_id, g, tf * cdf.idf AS w FROM ctf JOIN cdf USING (g)), cl AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM cv GROUP BY item_id), cu AS (SELECT item_id, g, w / norm AS w FROM cv JOIN cl USING (item_id)),
qw AS (SELECT qid, ' ' || unnest({TOK.format('text')}) || ' ' AS p FROM hq), qn AS (SELECT qid, p, unnest([2, 3, 4]) AS n FROM qw), qg AS (SELECT qid, substr(p, i, n) AS g FROM (SELECT qid, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM qn WHERE length(p) >= n)),
qtf AS (SELECT qid, g, 1 + ln(count(*)) AS tf FROM qg GROUP BY ALL), qv AS (SELECT qid, g, tf * cdf.idf AS w FROM qtf JOIN cdf USING (g)), ql AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qv GROUP BY qid), qu AS (SELECT qid, g, w / norm AS w FROM qv JOIN ql USING (qid)),
dn AS (SELECT qid, item_id, round(sum(qu.w * cu.w), 6) AS score FROM qu JOIN cu USING (g) GROUP BY ALL)"""
_HQ = f"hq AS (SELECT item_id AS qid, array_to_string(({WORDS.format('text')})[2:9], ' ') AS text FROM benchmark)"


def _excerpts(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(T.wording_tokens(F.col("text")), 2, 8), " ").alias("text"))


def _dense(spark, d):
    records = table(spark, d, "benchmark")
    vectors, idf = encoder.tf_idf(records, "item_id")
    asked, _ = encoder.tf_idf(_excerpts(spark, d), "qid", idf=stored(idf, "char-idf"))
    return encoder.cosines(vectors, asked, "item_id", "qid")


@query(_scores("benchmark", "item_id", "hq", "qid").replace("WITH ", f"WITH {_HQ}, ", 1) + f""", {_CHARS},
a AS (SELECT * FROM (SELECT qid, item_id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id))::INTEGER AS first_rank FROM s) WHERE first_rank <= 24),
b AS (SELECT * FROM (SELECT qid, item_id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id))::INTEGER AS second_rank FROM dn) WHERE second_rank <= 24),
f AS (SELECT *, round(coalesce(1 / (60 + first_rank)::DOUBLE, 0) + coalesce(1 / (60 + second_rank)::DOUBLE, 0), 9) AS fused FROM a FULL JOIN b USING (qid, item_id))
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY fused DESC, first_rank NULLS LAST, second_rank NULLS LAST))::INTEGER AS rank FROM f) WHERE rank <= 8""")
def hybrid_ranked(spark, d):
    """BM25 and character n-gram cosine fused, for an excerpt of every passage."""
    index = retrieval.build_index(table(spark, d, "benchmark"), "item_id")
    words = retrieval.top(retrieval.bm25(index, _excerpts(spark, d), "qid"), "qid", "item_id", 24)
    return retrieval.fuse(words, retrieval.top(_dense(spark, d), "qid", "item_id", 24), "qid", "item_id", 8)


@query()
def hybrid_search(spark, d):
    """The whole search: both rankings fused, and the passages that contain the excerpt, exactly or nearly, below."""
    return retrieval.hybrid(retrieval.build_index(table(spark, d, "benchmark"), "item_id"), _dense(spark, d), _excerpts(spark, d), "qid")


@query()
def svd_search(spark, d):
    """The nearest passages of each passage under the fitted and projected encoder; itself first."""
    records = table(spark, d, "benchmark")
    e = stored(encoder.create("tfidf-char", records, "item_id").encode(records, "item_id"), "embeddings")
    return retrieval.top(retrieval.dense_scores(e, "item_id", e, "query_id"), "query_id", "item_id", 3).select("query_id", "item_id", "rank")


# -- display --------------------------------------------------------------------------------------------------------

@query(f"""WITH {_TRIED}, k AS (SELECT *, CASE WHEN in_verses THEN NULL WHEN in_records THEN 'hasan' ELSE 'weak' END AS kind FROM u)
SELECT got AS verdict, CASE got WHEN 'VERIFIED' THEN CASE kind WHEN 'hasan' THEN 'hasan' WHEN 'weak' THEN 'weak' ELSE 'verified' END WHEN 'NO_ORIGIN' THEN 'noorigin' WHEN 'ALTERED' THEN 'altered' ELSE 'refer' END AS tone,
CASE got WHEN 'VERIFIED' THEN 1 WHEN 'NO_ORIGIN' THEN 4 WHEN 'ALTERED' THEN 3 ELSE 7 END AS place, count(*) AS n FROM k GROUP BY ALL""")
def verdict_looks(spark, d):
    kind = F.when(F.col("in_verses"), None).when(F.col("in_records"), "hasan").otherwise("weak")
    return _tried(spark, d).groupBy(F.col("got").alias("verdict"), display.tone(F.col("got"), kind).alias("tone"), display.verdict_rank(F.col("got")).cast("int").alias("place")).agg(F.count("*").alias("n"))


@query()
def responses(spark, d):
    """One JSON response for each conversation, its turns standing for claims."""
    c = table(spark, d, "conversations").withColumn("verdict", F.when(F.col("role") == "user", "REFER").otherwise("VERIFIED"))
    return display.response(c, "conv_id", "turn", ["turn", "verdict", "text"])
