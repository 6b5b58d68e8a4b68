"""The named queries over the driver's tables and the SQL that each is held against."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from provena.functions import text as T
from provena.operators import align, evaluate, extract, retrieval, rules, verdicts
from provena.plans import samples
from provena.sources import readers
from provena.sources.tables import stored
from provena.streaming import folds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Words of the latin profile in DuckDB SQL.
TOK = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{Nl}}\p{{No}}\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
#: The wording stream keeps case until its words are cut.
WORDS = r"list_transform(list_filter(string_split_regex(regexp_replace({0}, '[^\p{{L}}\p{{Nl}}\p{{No}}\s]', ' ', 'g'), '\s+'), lambda x: x <> ''), lambda x: lower(x))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- tokens and normal forms ----------------------------------------------------------------------------------------

@query(f"SELECT lang, count(*) AS docs, sum(len(w))::BIGINT AS tokens, count(DISTINCT source) AS sources FROM (SELECT lang, source, {TOK.format('text')} AS w FROM documents) GROUP BY lang")
def token_stats(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(T.key_tokens(F.col("text")))).alias("tokens"), F.count_distinct("source").alias("sources"))


def phrases(spark) -> DataFrame:
    return spark.createDataFrame(samples.PHRASES, "id int, text string")


_P = f"(SELECT id, text FROM (VALUES {samples.values(samples.PHRASES)}) v(id, text))"
_MARKLESS = f"trim(regexp_replace(' ' || regexp_replace(nfc_normalize({{0}}), '{T.MARKS}', '', 'g') || ' ', ' ([{''.join(T.CONJUNCTIONS)}]?){T.JOINED_WORD} ', ' \\1{T.SPLIT_WORD} ', 'g'))"
_NORMAL = rf"trim(regexp_replace(regexp_replace(translate({_MARKLESS}, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[^\p{{{{L}}}}\p{{{{Nl}}}}\p{{{{No}}}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_SPELL = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.SPELLINGS.items()) + " ELSE {0} END"


@query(f"SELECT id, {_NORMAL.format('text')} AS normal FROM {_P}")
def arabic_normalize(spark, d):
    return phrases(spark).select("id", T.normalize(F.col("text"), T.ARABIC, compose=True).alias("normal"))


def _stem_sql(w: str) -> str:
    forms = ", ".join(f"'{x}'" for x in T.DIVINE_FORMS)
    bare = f"CASE WHEN length({w}) >= 4 AND left({w}, 1) IN ('و', 'ف') THEN substr({w}, 2) ELSE {w} END"
    cut = " ".join(f"WHEN starts_with(b, '{a}') AND length(b) >= {len(a) + 2} THEN substr(b, {len(a) + 1})" for a in T.ARTICLES)
    return f"SELECT id, pos, CASE WHEN {w} IN ({forms}) OR (b <> {w} AND b IN ({forms})) THEN '{T.DIVINE_NAME}' ELSE CASE {cut} ELSE b END END AS stem FROM (SELECT *, {bare} AS b FROM words)"


@query(f"""WITH n AS (SELECT id, string_split({_NORMAL.format('text')}, ' ') AS ws FROM {_P}),
words AS (SELECT id, i::INTEGER AS pos, {_SPELL.format("ws[i]")} AS w FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM n) WHERE ws[i] <> '')
{_stem_sql('w')}""")
def arabic_stem(spark, d):
    keys = T.key_tokens(F.col("text"), T.ARABIC, compose=True)
    return phrases(spark).select("id", F.posexplode(keys).alias("p", "stem")).select("id", (F.col("p") + 1).alias("pos"), "stem")


@query(f"""WITH n AS (SELECT id, list_filter(string_split_regex(regexp_replace({_MARKLESS.format('text')}, '[^\\p{{L}}\\p{{Nl}}\\p{{No}}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM {_P})
SELECT id, array_to_string(list_transform(ws, lambda x: {_SPELL.format(f"translate(x, '{T.WORDING_FROM}', '{T.WORDING_TO}')")}), ' ') AS wording FROM n""")
def arabic_wording(spark, d):
    return phrases(spark).select("id", F.array_join(T.wording_tokens(F.col("text"), T.ARABIC, compose=True), " ").alias("wording"))


@query(f"SELECT w AS term, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS w FROM benchmark) GROUP BY w")
def vocabulary(spark, d):
    return table(spark, d, "benchmark").select(F.explode(T.wording_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


# -- BM25 -----------------------------------------------------------------------------------------------------------

def _tf(doc_id: str, docs: str) -> str:
    return f"t AS MATERIALIZED (SELECT {doc_id}, {TOK.format('text')} AS ws FROM {docs}), tf AS MATERIALIZED (SELECT {doc_id}, n_words, term, count(*) AS tf FROM (SELECT {doc_id}, len(ws)::INTEGER AS n_words, unnest(ws) AS term FROM t) GROUP BY ALL)"


_IDF = """st AS MATERIALIZED (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_words FROM t),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs CROSS JOIN st),
mean AS MATERIALIZED (SELECT avg(raw) AS m FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw CROSS JOIN mean)"""


def _scores(docs: str, doc_id: str, queries: str, query_id: str) -> str:
    return f"""WITH {_tf(doc_id, docs)}, {_IDF},
q AS (SELECT {query_id}, term, count(*) AS qtf FROM (SELECT {query_id}, unnest({TOK.format('text')}) AS term FROM {queries}) GROUP BY ALL),
s AS (SELECT {query_id}, {doc_id}, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_words / avg_words))), 6) AS score
      FROM q JOIN idf USING (term) JOIN tf USING (term), st GROUP BY ALL HAVING sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_words / avg_words))) > 0)"""


@query(f"WITH {_tf('doc_id', 'documents')} SELECT doc_id, n_words, count(*) AS n_terms, max(tf) AS max_tf FROM tf GROUP BY ALL")
def postings(spark, d):
    records = retrieval.build_index(table(spark, d, "documents"), "doc_id").records.where("n_words > 0")
    return records.select("doc_id", "n_words", F.size("terms").cast("long").alias("n_terms"), F.array_max("terms.tf").alias("max_tf"))


@query(f"WITH {_tf('doc_id', 'documents')}, {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def doc_freq_idf(spark, d):
    return retrieval.build_index(table(spark, d, "documents"), "doc_id").vocabulary.select("term", "df", F.round("idf", 6).alias("idf"))


def _index(spark, d) -> retrieval.Index:
    return retrieval.build_index(table(spark, d, "documents"), "doc_id")


def _bm25(spark, d) -> DataFrame:
    return retrieval.bm25(_index(spark, d), table(spark, d, "benchmark"), "item_id")


@query(_scores("documents", "doc_id", "benchmark", "item_id") + "SELECT item_id, doc_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s) WHERE rank <= 8")
def bm25_topk(spark, d):
    return retrieval.top(_bm25(spark, d), "item_id", "doc_id", 8)


@query(_scores("documents", "doc_id", "benchmark", "item_id") + "SELECT item_id, lang, doc_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)) WHERE rank <= 3")
def bm25_topk_by_kind(spark, d):
    """The kind is applied to scores of whole-corpus statistics."""
    s = _bm25(spark, d).withColumn("score", F.round("score", 6)).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return s.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "lang").orderBy(F.desc("score"), "doc_id"))).where("rank <= 3").select("item_id", "lang", "doc_id", "score", "rank")


# -- dense and fused ------------------------------------------------------------------------------------------------

_DENSE = "d AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score, q.label = e.label AS same FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 20 = 0")  # the stated query set, against all rows


@query(f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM d) WHERE rank <= 8")
def dense_topk(spark, d):
    e, q = _vectors(spark, d)
    return retrieval.dense_top(e, "vec_id", q, "query_id", 8)


@query(f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM d WHERE same) WHERE rank <= 8")
def dense_topk_by_kind(spark, d):
    e, q = _vectors(spark, d)
    return retrieval.top(retrieval.dense_scores(e, "vec_id", q, "query_id", same="label"), "query_id", "vec_id", 8)


@query(f"""WITH {_DENSE}, h AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(q.embedding[1:32]::DOUBLE[], e.embedding[1:32]::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
a AS (SELECT * FROM (SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS first_rank FROM d) WHERE first_rank <= 24),
b AS (SELECT * FROM (SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS second_rank FROM h) WHERE second_rank <= 24),
f AS (SELECT *, round(coalesce(1 / (60 + first_rank)::DOUBLE, 0) + coalesce(1 / (60 + second_rank)::DOUBLE, 0), 9) AS fused FROM a FULL JOIN b USING (query_id, vec_id))
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first_rank NULLS LAST, second_rank NULLS LAST))::INTEGER AS rank FROM f) WHERE rank <= 8""")
def rrf_topk(spark, d):
    e, q = _vectors(spark, d)
    half = lambda x: x.withColumn("embedding", F.slice("embedding", 1, 32))
    a = retrieval.dense_top(e, "vec_id", q, "query_id", 24)
    b = retrieval.dense_top(half(e), "vec_id", half(q), "query_id", 24)
    return retrieval.fuse(a, b, "query_id", "vec_id", 8)


# -- phrases --------------------------------------------------------------------------------------------------------

def _pad(doc_id: str, docs: str) -> str:
    return f"(SELECT {doc_id}, ' ' || array_to_string(ws, ' ') || ' ' AS p, len(ws)::INTEGER AS n_words FROM (SELECT {doc_id}, {TOK.format('text')} AS ws FROM {docs}))"


_PHRASE = f"ph AS (SELECT q.item_id, b.doc_id, b.n_words FROM {_pad('item_id', 'benchmark')} q JOIN {_pad('doc_id', 'documents')} b ON contains(b.p, q.p) WHERE q.n_words >= 3)"


@query(f"WITH {_PHRASE} SELECT * FROM ph")
def phrase_matches(spark, d):
    return retrieval.phrases(_index(spark, d), table(spark, d, "benchmark"), "item_id")


@query(_scores("documents", "doc_id", "benchmark", "item_id") + f""", {_PHRASE},
t8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 8),
p8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_words, doc_id) AS pr FROM ph) WHERE pr <= 8)
SELECT item_id, doc_id, score, false AS appended FROM t8 UNION ALL
SELECT item_id, doc_id, coalesce((SELECT min(score) FROM t8 WHERE t8.item_id = p8.item_id), 0) AS score, true AS appended FROM p8 WHERE NOT EXISTS (SELECT 1 FROM t8 WHERE t8.item_id = p8.item_id AND t8.doc_id = p8.doc_id)""")
def phrase_append(spark, d):
    """Phrase matches are added below the ranked list at its lowest score."""
    index, asked = _index(spark, d), table(spark, d, "benchmark")
    top = stored(retrieval.top(retrieval.bm25(index, asked, "item_id"), "item_id", "doc_id", 8).select("item_id", "doc_id", "score"), "ranked")
    phrase = retrieval.phrases(index, asked, "item_id", limit=8).select("item_id", "doc_id")
    floor = top.groupBy("item_id").agg(F.min("score").alias("score"))
    more = phrase.join(top, ["item_id", "doc_id"], "left_anti").join(floor, "item_id", "left").select("item_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return top.withColumn("appended", F.lit(False)).unionByName(more.withColumn("appended", F.lit(True)))


@query(f"WITH {_PHRASE} SELECT lang, item_id, count(*) AS records FROM ph JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ALL")
def count_containing(spark, d):
    hits = retrieval.phrases(_index(spark, d), table(spark, d, "benchmark"), "item_id")
    return hits.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "item_id").agg(F.count("*").alias("records"))


@query(f"WITH {_PHRASE} SELECT item_id, count(doc_id) AS n_relevant, min(doc_id) AS first_doc FROM (SELECT item_id FROM benchmark) LEFT JOIN ph USING (item_id) GROUP BY item_id")
def containment_relevance(spark, d):
    hits = retrieval.phrases(_index(spark, d), table(spark, d, "benchmark"), "item_id")
    return table(spark, d, "benchmark").select("item_id").join(hits, "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("n_relevant"), F.min("doc_id").alias("first_doc"))


@query()
def near_phrase(spark, d):
    """Every passage, as it is (family exact) and with one or two words misspelled, and the documents that have it but for spelling."""
    asked = evaluate.typo_mutations(table(spark, d, "benchmark"), "item_id")
    asked = asked.select(F.concat_ws("/", F.col("item_id").cast("string"), "family").alias("qid"), "item_id", "family", F.col("query").alias("text"))
    return retrieval.near_phrases(_index(spark, d), asked, "qid").join(asked.select("qid", "item_id", "family"), "qid").select("item_id", "family", "doc_id", "n_words")


# -- adjacency, classes, samples ------------------------------------------------------------------------------------

@query("""SELECT a.conv_id, a.turn, a.text || ' ' || b.text || ' ' || c.text AS text FROM conversations a
JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 2""")
def adjacent_runs(spark, d):
    return evaluate.adjacent_runs(table(spark, d, "conversations"), "conv_id", "turn", "text", 2)


@query("SELECT c.conv_id, c.turn, n.text AS next_text FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1")
def neighbour_lookup(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return c.select("conv_id", "turn").join(nxt, ["conv_id", "turn"], "left")


@query("SELECT min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def identical_text_classes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).where("n > 1").drop("h")


@query("SELECT source, arg_min(doc_id, sha256('7:' || doc_id::VARCHAR)) AS doc_id FROM documents GROUP BY source")
def hash_sample_per_group(spark, d):
    return evaluate.hash_sample(table(spark, d, "documents"), "source", "doc_id", "7")


_DROP = "left({0}, length({0}) // 2) || substr({0}, length({0}) // 2 + 2)"
_SWAP = f"CASE WHEN {{0}}[length({{0}})//2] <> {{0}}[length({{0}})//2+1] THEN left({{0}}, length({{0}})//2-1) || {{0}}[length({{0}})//2+1] || {{0}}[length({{0}})//2] || substr({{0}}, length({{0}})//2+2) ELSE {_DROP} END"


@query(f"""WITH w AS (SELECT item_id, {WORDS.format('text')} AS ws FROM benchmark), u AS (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
o AS (SELECT item_id, ws, list(i ORDER BY length(ws[i]) DESC, i) AS o FROM u GROUP BY item_id, ws),
x AS (SELECT *, ws[o[1]] AS a, ws[o[2]] AS b FROM o),
y AS (SELECT item_id, ws, 'exact' AS family, ws AS q FROM x UNION ALL
SELECT item_id, ws, 'letter_dropped', list_concat(ws[1:o[1]-1], [{_DROP.format('a')}], ws[o[1]+1:]) FROM x WHERE length(a) >= 4 UNION ALL
SELECT item_id, ws, 'letters_swapped', list_concat(ws[1:o[1]-1], [{_SWAP.format('a')}], ws[o[1]+1:]) FROM x WHERE length(a) >= 4 UNION ALL
SELECT item_id, ws, 'two_words_typos', list_transform(ws, lambda v, i: CASE WHEN i = o[1] OR i = o[2] THEN {_DROP.format('v')} ELSE v END) FROM x WHERE len(ws) >= 4 AND length(b) >= 4),
ex AS (SELECT item_id, ws[(len(ws)-5)//2+1:(len(ws)-5)//2+5] AS e FROM w WHERE len(ws) >= 9), eu AS (SELECT item_id, e, unnest(range(1, 6)) AS i FROM ex), eo AS (SELECT item_id, e, list(i ORDER BY length(e[i]) DESC, i) AS o FROM eu GROUP BY item_id, e),
z AS (SELECT item_id, family, q FROM y UNION ALL SELECT item_id, 'excerpt_with_typo', list_transform(e, lambda v, i: CASE WHEN i = o[1] THEN {_DROP.format('v')} ELSE v END) FROM eo WHERE length(e[o[1]]) >= 4)
SELECT item_id, family, array_to_string(q, ' ') AS query FROM z""")
def mutations_typos(spark, d):
    return evaluate.typo_mutations(table(spark, d, "benchmark"), "item_id").select("item_id", "family", "query")


def _known_item(spark, d) -> DataFrame:
    records = table(spark, d, "benchmark")
    # the decomposed family is left out, as DuckDB has no decomposition to compare with
    q = evaluate.text_mutations(records, "item_id").where("family != 'decomposed'").select(F.concat_ws("/", F.col("item_id").cast("string"), "family").alias("qid"), F.col("item_id").alias("source_id"), "family", F.col("query").alias("text"))
    ranked = retrieval.top(retrieval.bm25(retrieval.build_index(records, "item_id"), q, "qid"), "qid", "item_id", 8)
    ranked = ranked.join(q.select("qid", "source_id"), "qid")
    first = evaluate.first_relevant(ranked, "qid", F.col("item_id") == F.col("source_id"))
    return q.select("qid", "family", "source_id").join(first, "qid", "left")


_LONGEST = "list_sort(list_transform({0}, lambda v, i: {{'n': -length(v), 'i': i}}))[1].i"
_MUT = f"""m0 AS (SELECT item_id, text, {WORDS.format('text')} AS ws FROM benchmark), m AS (SELECT *, CASE WHEN len(ws) >= 8 THEN ws[(len(ws)-5)//2+1:(len(ws)-5)//2+5] END AS ex FROM m0 WHERE len(ws) > 0),
mt AS (SELECT *, coalesce(ex, ws) AS tw, {_LONGEST.format('coalesce(ex, ws)')} AS longest FROM m),
mu AS (SELECT item_id, 'verbatim' AS family, text AS text FROM m UNION ALL SELECT item_id, 'punctuation_spacing', '« ' || array_to_string(ws, ' ،  ') || ' »' FROM m UNION ALL
SELECT item_id, 'upper_case', upper(array_to_string(ws, ' ')) FROM m UNION ALL SELECT item_id, 'negation_added', '{evaluate.NOT} ' || array_to_string(ws, ' ') FROM m UNION ALL
SELECT item_id, 'vowel_noise', array_to_string(list_transform(ws, lambda v: left(v, 1) || '{evaluate.VOWEL}' || substr(v, 2)), ' ') FROM m UNION ALL
SELECT item_id, CASE WHEN ex IS NULL THEN 'single_word_transposition' ELSE 'five_word_excerpt_transposition' END, array_to_string(list_transform(tw, lambda v, i: CASE WHEN i = longest THEN {_SWAP.format('v')} ELSE v END), ' ') FROM mt WHERE length(tw[longest]) >= 4 UNION ALL
SELECT item_id, 'five_word_excerpt', array_to_string(ex, ' ') FROM m WHERE ex IS NOT NULL),
mq AS (SELECT item_id::VARCHAR || '/' || family AS qid, item_id AS source_id, family, text FROM mu)"""
_RANKS = _scores("benchmark", "item_id", "mq", "qid").replace("WITH ", f"WITH {_MUT}, ", 1) + """,
rk AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id))::INTEGER AS rank FROM s),
r AS (SELECT qid, family, mq.source_id, (SELECT min(rank) FROM rk WHERE rk.qid = mq.qid AND rk.item_id = mq.source_id AND rank <= 8) AS rank FROM mq)"""


@query(_RANKS + """SELECT family, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3,
round(avg(CASE WHEN rank <= 8 THEN 1.0 ELSE 0.0 END), 6) AS hit_8, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr_8 FROM r GROUP BY GROUPING SETS ((), (family))""")
def hit_mrr_by_group(spark, d):
    return evaluate.grouped_metrics(_known_item(spark, d), ["family"])


@query(_RANKS + "SELECT qid, family, source_id, rank FROM r WHERE rank IS NULL OR rank > 1")
def regressions(spark, d):
    return _known_item(spark, d).where("rank is null or rank > 1").select("qid", "family", "source_id", "rank")


# -- comparison, aggregates -----------------------------------------------------------------------------------------

@query("""SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, CASE WHEN b.conv_id IS NULL THEN 'missing' WHEN a.conv_id IS NULL THEN 'extra' WHEN a.text = b.text THEN 'equal' ELSE 'differs' END AS status
FROM conversations a FULL JOIN (SELECT conv_id, turn + 1 AS turn, text FROM conversations) b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def corpus_compare(spark, d):
    c = table(spark, d, "conversations")
    return evaluate.compare(c, c.withColumn("turn", F.col("turn") + 1), ["conv_id", "turn"], "text")


def _classes(spark, d) -> DataFrame:
    lab = table(spark, d, "labels")
    cls = F.when(F.col("toxic") == 1, "fabricated").when(F.col("quality") == 1, "authentic").otherwise("weak")
    return table(spark, d, "documents").select("doc_id", "source", "lang").join(lab.select("doc_id", cls.alias("class")), "doc_id", "left")


_CLASSES = "c AS (SELECT source, lang, CASE WHEN toxic = 1 THEN 'fabricated' WHEN quality = 1 THEN 'authentic' WHEN quality IS NOT NULL THEN 'weak' END AS class FROM documents LEFT JOIN labels USING (doc_id))"
_GRADE = "CASE WHEN count(class) = 0 THEN 'NEEDS_REVIEW' WHEN bool_or(class = 'authentic') AND bool_or(class <> 'authentic') THEN 'DISPUTED' WHEN bool_or(class = 'authentic') THEN 'VERIFIED' ELSE 'NOT_AUTHENTIC' END"


@query(f"WITH {_CLASSES} SELECT source || '/' || lang AS k, {_GRADE} AS verdict FROM c GROUP BY source, lang")
def grade_verdict(spark, d):
    return rules.grade_verdict(_classes(spark, d).withColumn("k", F.concat_ws("/", "source", "lang")), "k", "class")


@query(f"WITH {_CLASSES}, v AS (SELECT {_GRADE} AS verdict FROM c GROUP BY source, lang), codes AS (SELECT unnest({list(rules.VERDICTS)!r}) AS verdict) SELECT verdict, (SELECT count(*) FROM v WHERE v.verdict = codes.verdict) AS n FROM codes")
def verdict_summary_zero_filled(spark, d):
    return rules.zero_filled(rules.grade_verdict(_classes(spark, d).withColumn("k", F.concat_ws("/", "source", "lang")), "k", "class"))


@query("SELECT event_type, date_trunc('month', ts)::DATE::VARCHAR AS month, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY GROUPING SETS ((), (event_type), (event_type, date_trunc('month', ts)))")
def task_method_summary(spark, d):
    e = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-01").alias("month"), "value")
    return e.groupingSets([[], ["event_type"], ["event_type", "month"]], "event_type", "month").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"))


def _has_sql(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" if " " in w else f"contains(' ' || {t} || ' ', ' {w} ')" for w in words) + ")"


_G = f"""g AS (SELECT id, grade, {_NORMAL.format('grade')} AS t FROM (VALUES {samples.values(samples.GRADES)}) v(id, grade)),
j AS (SELECT *, array_to_string(list_transform(string_split(t, ' '), lambda x: CASE WHEN length(x) > 3 AND left(x, 1) IN ('و', 'ف', 'ب') THEN substr(x, 2) ELSE x END), ' ') AS u FROM g),
c AS (SELECT id, grade, CASE WHEN {_has_sql('t', rules.FABRICATED)} OR {_has_sql('u', rules.FABRICATED)} THEN 'fabricated' WHEN {_has_sql('t', rules.BASELESS)} THEN 'baseless'
WHEN {_has_sql('t', rules.WEAK)} OR {_has_sql('u', rules.WEAK)} THEN 'weak' WHEN {_has_sql('t', rules.AUTHENTIC)} OR {_has_sql('u', rules.AUTHENTIC)} THEN 'authentic' ELSE 'unclassified' END AS class,
{_has_sql('t', rules.CHAIN)} AND NOT {_has_sql('t', rules.BASELESS)} AS chain FROM j)"""


@query(f"WITH {_G} SELECT id, grade, class, chain FROM c")
def ruling_classifier(spark, d):
    g = spark.createDataFrame(samples.GRADES, "id int, grade string")
    return g.select("id", "grade", rules.ruling_class(F.col("grade"), True).alias("class"), rules.chain_only(F.col("grade"), True).alias("chain"))


@query(f"""WITH {_G}, a AS (SELECT id, count(*) AS n, count(*) FILTER (class = 'authentic') AS accept, count(*) FILTER (class IN ('weak', 'fabricated', 'baseless')) AS against,
count(*) FILTER (class IN ('weak', 'fabricated', 'baseless') AND NOT chain) AS reject FROM c GROUP BY id)
SELECT *, CASE WHEN accept > 0 AND reject > 0 THEN 'DISPUTED' WHEN accept > 0 AND against = 0 AND accept * 2 >= n THEN 'VERIFIED' WHEN accept = 0 AND reject >= 2 AND reject * 2 >= n THEN 'NOT_AUTHENTIC' ELSE 'IN_SOURCE' END AS verdict FROM a""")
def rulings_aggregate(spark, d):
    return rules.rulings_by(spark.createDataFrame(samples.GRADES, "id int, grade string"), "id")


@query("""SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events) WHERE n = 1) WHERE m <= 12""")
def dedupe_keep_first_cap(spark, d):
    return evaluate.keep_first(table(spark, d, "events").select("event_type", "user_id", "event_id"), ["event_type"], ["user_id"], "event_id", 12)


@query("""WITH c AS (SELECT conv_id, turn AS start, CASE WHEN role = 'user' THEN 'D' ELSE 'B' END AS level, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
r AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN n > 3 AND level <> 'D' THEN 1 ELSE 0 END, start))::INTEGER AS claim_id FROM c)
SELECT conv_id, start, level, claim_id, CASE WHEN claim_id = 1 AND n > 3 THEN n - 3 ELSE 0 END AS omitted FROM r WHERE claim_id <= 3""")
def claim_truncation(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("start"), F.when(F.col("role") == "user", "D").otherwise("B").alias("level"))
    return extract.truncate(c, "conv_id", limit=3)


#: The same patterns where \b doesn't know Arabic letters: t is in normal form, so words end at blanks.
_PERSONAL_SQL = extract.PERSONAL.replace(r"\bانا\b.*\bهل\b", "(^| )انا( .*)? هل( |$)").replace(r".*\b(لي|علي)\b", "(.* )?(لي|علي)( |$)")


def _any_sql(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


@query(f"""WITH w AS (SELECT id, window_text, {_NORMAL.format('window_text')} AS t FROM (VALUES {samples.values(samples.WINDOWS)}) v(id, window_text)),
p AS (SELECT *, CASE WHEN {_any_sql('t', extract.VERSE_CUES)} THEN 'quran' WHEN contains(window_text, '{extract.HONORIFIC}') OR {_any_sql('t', extract.RECORD_CUES)} THEN 'hadith' END AS cue,
regexp_matches(t, '{_PERSONAL_SQL}') AS personal FROM w)
SELECT id, cue, personal, CASE WHEN cue IS NOT NULL THEN 'A' WHEN personal THEN 'D' WHEN {_any_sql('t', extract.DISPUTED)} THEN 'C' ELSE 'B' END AS level FROM p""")
def cue_and_level(spark, d):
    w = spark.createDataFrame(samples.WINDOWS, "id int, window_text string").withColumn("t", T.normalize(F.col("window_text"), T.ARABIC, compose=True))
    w = w.withColumn("cue", extract.cue_type(F.col("t"), F.col("window_text")))
    return w.select("id", "cue", extract.is_personal(F.col("t")).alias("personal"), extract.level(F.col("t"), F.coalesce("cue", F.lit("unknown"))).alias("level"))


@query("""SELECT doc_id, i::INTEGER AS pos, q[i] AS body FROM (SELECT doc_id, regexp_extract_all(text, '"([^"]{2,})"', 1) AS q, unnest(range(1, len(regexp_extract_all(text, '"([^"]{2,})"', 1)) + 1)) AS i FROM documents)""")
def quoted_spans(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(extract.quoted(F.col("text"))).alias("p", "body")).select("doc_id", (F.col("p") + 1).alias("pos"), "body")


@query(f"""WITH w AS (SELECT item_id, ' ' || unnest({TOK.format('text')}) || ' ' AS p FROM benchmark),
n AS (SELECT item_id, p, unnest([2, 3, 4]) AS n FROM w), g AS (SELECT item_id, substr(p, i, n) AS g FROM (SELECT item_id, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM n WHERE length(p) >= n)),
tf AS (SELECT item_id, g, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL), df AS (SELECT g, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY g),
v AS (SELECT item_id, g, tf * idf AS w FROM tf JOIN df USING (g)), l AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY item_id),
u AS (SELECT item_id, g, w / norm AS w FROM v JOIN l USING (item_id))
SELECT a.item_id AS query_id, b.item_id, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b USING (g) WHERE a.item_id % 20 = 0 GROUP BY ALL""")
def char_ngram_tfidf_cosine(spark, d):
    docs = table(spark, d, "benchmark")
    tf = docs.select("item_id", F.explode(T.word_ngrams(T.key_tokens(F.col("text")))).alias("g")).groupBy("item_id", "g").agg((1 + F.log(F.count("*"))).alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    idf = tf.groupBy("g").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("g", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    v = tf.join(idf, "g").select("item_id", "g", (F.col("tf") * F.col("idf")).alias("w"))
    u = v.join(v.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "item_id").select("item_id", "g", (F.col("w") / F.col("norm")).alias("w"))
    q = u.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "g", F.col("w").alias("qw"))  # the stated query set, against all rows
    return q.join(u, "g").groupBy("query_id", "item_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("cosine"))


@query("""WITH b AS (SELECT r_name, n_name, list_distinct(list_transform(range(1, length(r_name)), lambda i: substr(r_name, i, 2))) AS x, list_distinct(list_transform(range(1, length(n_name)), lambda i: substr(n_name, i, 2))) AS y FROM region JOIN nation ON r_regionkey = n_regionkey)
SELECT r_name, n_name, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS similarity FROM b""")
def bigram_jaccard(spark, d):
    j = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select("r_name", "n_name", F.round(T.jaccard(T.letter_pairs(F.col("r_name")), T.letter_pairs(F.col("n_name"))), 6).alias("similarity"))


# -- pages, captures, gates -----------------------------------------------------------------------------------------

@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)
SELECT page_id, h[i] AS href, t[i] AS label FROM (SELECT *, unnest(range(1, greatest(len(h), len(t)) + 1)) AS i FROM l)""")
def html_records(spark, d):
    return readers.link_rows(table(spark, d, "pages"), "page_id", "html")


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, sha256(html) AS sha256, regexp_matches(url, '^https?://') AS valid_url FROM pages")
def page_captures(spark, d):
    p = readers.capture(table(spark, d, "pages"), "html", "url")
    return p.select("page_id", readers.page_title(F.col("html")).alias("title"), "sha256", "valid_url")


@query()
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", readers.plain_text(F.col("html")).alias("text"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) ORDER BY o_orderkey LIMIT 100")
def capture_todo(spark, d):
    return readers.todo(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", 100)


@query("""SELECT 'unique' AS rule, count(*) - count(DISTINCT doc_id) AS violations FROM documents UNION ALL SELECT 'present_text', count(*) FILTER (text IS NULL) FROM documents UNION ALL SELECT 'present_lang', count(*) FILTER (lang IS NULL) FROM documents""")
def constraint_report(spark, d):
    return evaluate.constraint_report(table(spark, d, "documents"), "doc_id", ["text", "lang"])


@query("""WITH r AS (SELECT doc_id // 1000 AS part, doc_id, sha256(doc_id::VARCHAR || '|' || lang || '|' || text) AS h FROM documents), p AS (SELECT part, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM r GROUP BY part),
q AS (SELECT part // 1000 AS part, sha256(string_agg(h, '' ORDER BY part)) AS h FROM p GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY part)) AS digest FROM q""")
def content_digest(spark, d):
    return evaluate.content_digest(table(spark, d, "documents"), "doc_id", ["lang", "text"])


@query("""SELECT gate, count(*) AS n FROM (SELECT CASE WHEN octet_length(encode(text)) > 32768 THEN 'too_large' WHEN length(trim(text)) > 8000 THEN 'too_long' WHEN length(trim(text)) < 2 THEN 'too_short' ELSE 'accepted' END AS gate FROM documents) GROUP BY gate""")
def request_gate(spark, d):
    return readers.accepted(table(spark, d, "documents")).groupBy("gate").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS docs, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (quality = 1) AS verified_docs, count(*) >= 6236 AS complete FROM documents LEFT JOIN labels USING (doc_id)")
def index_stats(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("docs"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"), F.count_if(F.col("quality") == 1).alias("verified_docs"), (F.count("*") >= 6236).alias("complete"))


@query("SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, round(count(*) FILTER (quality = 1) / count(quality), 6) AS good_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def kind_pivot(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    p = j.groupBy("lang").pivot("quality", [1, 0]).agg(F.count("doc_id")).select("lang", F.coalesce("1", F.lit(0)).alias("good"), F.coalesce("0", F.lit(0)).alias("bad"))
    return p.withColumn("good_rate", F.round(F.try_divide("good", F.col("good") + F.col("bad")), 6))


@query("SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'passage', item_id, text FROM benchmark")
def union_corpora(spark, d):
    a = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(table(spark, d, "benchmark").select(F.lit("passage").alias("kind"), F.col("item_id").alias("id"), "text"))


@query("""SELECT n_name, n_nationkey, 'https://example.org/?q=' || url_encode(array_to_string((string_split(n_name || ' of the ' || r_name || ' region, part', ' '))[1:6], ' ')) AS url FROM nation JOIN region ON n_regionkey = r_regionkey""")
def search_urls(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    words = readers.search_words(F.concat("n_name", F.lit(" of the "), "r_name", F.lit(" region, part")))
    return j.select("n_name", "n_nationkey", F.concat(F.lit("https://example.org/?q="), T.quote_url(words)).alias("url"))


@query("""WITH e AS (SELECT conv_id, list(role ORDER BY turn) AS actual FROM conversations GROUP BY conv_id)
SELECT actual[1:2] = ['user', 'assistant'] AS passed, count(*) AS n FROM e GROUP BY ALL""")
def regression_pass(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role")))["role"].alias("actual"))
    return c.select((F.slice("actual", 1, 2) == F.array(F.lit("user"), F.lit("assistant"))).alias("passed")).groupBy("passed").agg(F.count("*").alias("n"))


# -- table functions and folds --------------------------------------------------------------------------------------

@query()
def align_claims(spark, d):
    """Each passage held against the 8 documents that BM25 ranks first for it and all that contain it, exactly or nearly; those below have no rank."""
    index, asked = _index(spark, d), table(spark, d, "benchmark")
    top = stored(retrieval.top(retrieval.bm25(index, asked, "item_id"), "item_id", "doc_id", 8).select("item_id", "doc_id", "rank"), "ranked")
    more = retrieval.phrases(index, asked, "item_id").select("item_id", "doc_id").unionByName(retrieval.near_phrases(index, asked, "item_id").select("item_id", "doc_id")).distinct()
    top = top.unionByName(more.join(top, ["item_id", "doc_id"], "left_anti").withColumn("rank", F.lit(None).cast("int")))
    pairs = top.join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("claim")), "item_id").join(table(spark, d, "documents").select("doc_id", F.col("text").alias("source")), "doc_id")
    al = align.align_pairs(pairs, "claim", "source", stemmed=False)
    return al.select("item_id", "doc_id", "rank", F.round("al.claim_coverage", 6).alias("claim_coverage"), F.round("al.dice", 6).alias("dice"), F.col("al.exact").alias("exact"), F.col("al.span_start").alias("span_start"), F.col("al.span_end").alias("span_end"))


def _posts(spark, d) -> DataFrame:
    """post, text: every passage, or the first turn of the conversation of its number, as people ask about one; the form goes by the number."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("n"), T.wording_tokens(F.col("text")).alias("w"))
    t = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("n")).agg(F.min_by("text", "turn").alias("turn")).select("n", T.wording_tokens(F.col("turn")).alias("v"))
    b = b.join(t, "n", "left").withColumn("v", F.coalesce("v", "w"))
    said = lambda w: F.array_join(w, " ")
    first = lambda w: F.slice(w, 1, 5)
    wrong = F.concat(F.array(F.lit("zzzz")), F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))))
    forms = [F.concat(F.lit("قال تعالى: «"), said("v"), F.lit("»")), F.concat(F.lit("قال تعالى: «"), said(wrong), F.lit("»")), F.concat(F.lit("في الحديث «"), said("w"), F.lit("»")), F.concat(F.lit('"'), said("w"), F.lit('"')),
             F.concat(F.lit('"'), said(first("v")), F.lit('"')), F.concat(F.lit('"'), F.coalesce(F.get("w", F.lit(0)), F.lit("")), F.lit('"')), F.concat(F.lit('"'), said(F.transform(first("w"), lambda w: F.concat(F.lit("q"), F.reverse(w)))), F.lit('"')),
             F.concat(F.lit("هل يجوز لي "), said(first("w")), F.lit("؟")), F.lit("حكم مسالة مختلفة كثيرا"), F.lit("كيف يكون هذا الامر كله؟"), F.concat(F.lit("أعطني حديثا يثبت أن "), said(first("w"))), F.lit("أعطني حديثا يثبت هذا الكلام")]
    return b.select(F.concat_ws("/", F.lit("post"), F.col("n").cast("string")).alias("post"), F.get(F.array(*forms), (F.col("n") % len(forms)).cast("int")).alias("text"))


def _corpus(spark, d) -> verdicts.Corpus:
    """Conversations stand for verses (a group's turns), passages for records, graded by the labels of their number."""
    c, b, lab = table(spark, d, "conversations"), table(spark, d, "benchmark"), table(spark, d, "labels")
    verses = c.groupBy(F.col("conv_id").alias("grp"), F.col("turn").alias("ord")).agg(F.min("text").alias("text")).select(F.concat_ws(":", F.col("grp").cast("string"), F.col("ord").cast("string")).alias("id"), "grp", "ord", "text", F.lit(True).alias("verified"))
    grade = lambda good: F.when(F.col(good) == 1, "authentic").otherwise("weak")
    records = b.join(lab.withColumnRenamed("doc_id", "item_id"), "item_id", "left").select(F.col("item_id").cast("string").alias("id"), "text", F.when(F.col("quality").isNotNull(), F.array_distinct(F.array(grade("quality"), F.when(F.col("item_id") % 3 == 0, "weak").otherwise(grade("quality"))))).alias("classes"), (F.col("item_id") % 7 != 0).alias("verified"))
    search = lambda index: lambda q, k: retrieval.ranked_with_phrases(index, q, "claim", k)
    return verdicts.Corpus(verses, records, search(retrieval.build_index(verses, "id")), search(retrieval.build_index(records, "id")), T.LATIN)


@query()
def verdicts_end_to_end(spark, d):
    """Posts in twelve forms to claims, both corpora searched and aligned, the rules with their notes, and what is shown of each claim."""
    claims = extract.extract_claims(_posts(spark, d), ["post"]).select(F.concat_ws("#", "post", F.col("claim_id").cast("string")).alias("claim"), "text", "hint", "level", "context_after", "request")
    out = verdicts.judge_claims(claims, _corpus(spark, d), th=rules.Thresholds(require_verified=True))
    return out.select("claim", "verdict", "level", "kind", "source_id", "closest_id", F.col("evidence.claim_coverage").alias("coverage"), F.size("diff").alias("n_diff"), F.size("alternatives").alias("n_alternatives"), F.array_join("notes", ",").alias("notes"))


_WIDE = """w AS (SELECT o_orderkey AS id, ['A', 'B', 'C', 'D'][o_orderkey % 4 + 1] AS level, ['quran', 'hadith', 'unknown', 'unknown', 'unknown'][o_custkey % 5 + 1] AS hint, o_orderkey % 3 = 0 AS question, (o_custkey % 5 + 1)::INTEGER AS n_words,
CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 13) / 12::DOUBLE END AS v_coverage, CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 13) / 12::DOUBLE END AS v_content, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 13 = 12 END AS v_exact, o_custkey % 2 = 0 AS v_whole,
CASE WHEN o_orderkey % 13 <> 0 THEN (o_custkey % 9) / 8::DOUBLE END AS h_content, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 9 >= 7 END AS h_exact, o_custkey % 4 = 0 AS h_whole,
['VERIFIED', 'NOT_AUTHENTIC', 'DISPUTED', 'NEEDS_REVIEW'][o_custkey % 4 + 1] AS h_verdict, o_custkey % 6 <> 0 AS source_verified, ['', '', '', 'question', 'evidence', 'evidence_ref'][o_orderkey % 6 + 1] AS request FROM orders),
x AS (SELECT *, coalesce(v_exact, false) AS ve, coalesce(h_exact, false) AS he, n_words >= 3 AS long, coalesce(h_content, 0) AS hc FROM w),
r AS (SELECT *, CASE WHEN hc < 0.6 THEN 'NO_ORIGIN/' WHEN hc < 0.75 OR NOT he THEN 'NEEDS_REVIEW/hadith' ELSE h_verdict || '/hadith' END AS rec FROM x),
j AS (SELECT *, CASE WHEN request = 'evidence_ref' THEN 'NO_ORIGIN/'
WHEN level = 'D' THEN CASE WHEN NOT question AND ve AND v_coverage = 1 AND long THEN 'VERIFIED/quran' ELSE 'REFER/' END
WHEN hint = 'quran' THEN CASE WHEN coalesce(v_coverage, 0) < 0.6 THEN 'NO_ORIGIN/' WHEN ve THEN 'VERIFIED/quran' WHEN n_words < 3 THEN 'NEEDS_REVIEW/quran' ELSE 'ALTERED/quran' END
WHEN hint = 'hadith' THEN CASE WHEN ve AND long THEN 'VERIFIED/quran' ELSE rec END
WHEN ve AND long THEN 'VERIFIED/quran' WHEN long AND hc >= 0.75 THEN rec WHEN long AND coalesce(v_coverage, 0) >= 0.6 THEN 'NEEDS_REVIEW/quran' WHEN level = 'C' THEN 'DISPUTED/'
WHEN long THEN 'NO_ORIGIN/' WHEN he AND h_whole THEN rec WHEN ve AND v_whole AND n_words = 2 THEN 'VERIFIED/quran' WHEN ve AND (n_words = 2 OR v_whole) THEN 'NEEDS_REVIEW/quran' WHEN he AND n_words = 2 THEN 'NEEDS_REVIEW/hadith' ELSE 'NO_ORIGIN/' END AS a FROM r),
g AS (SELECT *, string_split(a, '/')[2] AS b0, CASE WHEN string_split(a, '/')[2] <> '' AND NOT source_verified THEN 'NEEDS_REVIEW' ELSE string_split(a, '/')[1] END AS v0 FROM j),
q AS (SELECT id, CASE WHEN request = 'question' AND v0 = 'NO_ORIGIN' THEN 'OUT_OF_SCOPE' WHEN request = 'evidence' AND v0 NOT IN ('VERIFIED', 'NOT_AUTHENTIC', 'DISPUTED', 'IN_SOURCE') THEN 'NO_ORIGIN' ELSE v0 END AS verdict,
CASE WHEN (request = 'question' AND v0 = 'NO_ORIGIN') OR (request = 'evidence' AND v0 NOT IN ('VERIFIED', 'NOT_AUTHENTIC', 'DISPUTED', 'IN_SOURCE')) THEN NULL ELSE nullif(b0, '') END AS basis FROM g)"""


def _wide(spark, d) -> DataFrame:
    """Rows of every combination of levels, marks, coverages, grades and requests, from the numbers of orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    share, grade = F.when(k % 11 != 0, (c % 13) / F.lit(12.0)), F.when(k % 13 != 0, (c % 9) / F.lit(8.0))
    return table(spark, d, "orders").select(k.alias("id"), of("ABCD", k % 4).alias("level"), of(["quran", "hadith", "unknown", "unknown", "unknown"], c % 5).alias("hint"), (k % 3 == 0).alias("question"), (c % 5 + 1).cast("int").alias("n_words"),
                                            share.alias("v_coverage"), share.alias("v_content"), F.when(k % 11 != 0, c % 13 == 12).alias("v_exact"), (c % 2 == 0).alias("v_whole"), grade.alias("h_content"), F.when(k % 13 != 0, c % 9 >= 7).alias("h_exact"), (c % 4 == 0).alias("h_whole"),
                                            of(["VERIFIED", "NOT_AUTHENTIC", "DISPUTED", "NEEDS_REVIEW"], c % 4).alias("h_verdict"), (c % 6 != 0).alias("source_verified"), of(["", "", "", "question", "evidence", "evidence_ref"], k % 6).alias("request"))


@query(f"WITH {_WIDE} SELECT id, verdict, basis FROM q")
def verdict_rules(spark, d):
    """The whole rule tree with the source gate and the request rule over rows of every kind."""
    return rules.apply_request(rules.decide(_wide(spark, d), rules.Thresholds(require_verified=True))).select("id", "verdict", "basis")


@query(f"WITH {_WIDE}, codes AS (SELECT unnest({list(rules.VERDICTS)!r}) AS verdict) SELECT verdict, (SELECT count(*) FROM q WHERE q.verdict = codes.verdict) AS n FROM codes")
def verdict_counts(spark, d):
    return rules.zero_filled(verdict_rules(spark, d))


@query()
def extract_claims(spark, d):
    return extract.extract_claims(table(spark, d, "conversations"), ["conv_id", "turn"])


@query()
def rate_limit_admit(spark, d):
    return folds.rate_limit(table(spark, d, "events"), "user_id", "event_id", "ts", limit=2, window=3600.0)


@query()
def ttl_cache_hits(spark, d):
    return folds.cache(table(spark, d, "events"), "user_id", "event_id", "ts", "event_type", size=2, ttl=86400.0)
