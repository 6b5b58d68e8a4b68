"""From claims to verdicts: candidates of both corpora, their alignment, the best of each kind, the rules, and what is shown of it.

Every step is a DataFrame with a row for each claim or for each claim and candidate, so all claims of all posts go through together. The search is
passed in, as it may be any ranking of (query, record).
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from provena.functions import text as T
from provena.operators import align, rules
from provena.sources.tables import stored

#: Verses that a candidate may go on for, alternatives that are shown, and what a shown alternative may lack of the best coverage.
MAX_EXTRA, TIED, NEAR, LEAST_NEAR, NEAR_GAP = 3, 4, 5, 0.5, 0.34
#: The phrase that may open a quotation of the verse after it, in wording form.
OPENING = ("بسم", "الله", "الرحمن", "الرحيم")
#: Lookups of a request, verdicts that a live lookup may improve, words that make one worth while.
MAX_LOOKUPS, MARKED_WORDS, UNMARKED_WORDS = 4, 3, 5

#: (queries (query id, text), number of results) -> query id, id, rank, score
Search = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Corpus:
    """verses: id, grp, ord, text, verified. records: id, text, classes array<string>, verified. Each with its search."""
    verses: DataFrame
    records: DataFrame
    find_verses: Search
    find_records: Search
    profile: T.Profile = T.ARABIC


def without_opening(claims: DataFrame, profile: T.Profile = T.ARABIC) -> DataFrame:
    """claims with `opening`, and `text` without the opening phrase where more than its words are there and the claim is neither marked as a record's nor personal."""
    words = T.display_tokens(F.col("text"), profile)
    opens = (F.col("hint") != "hadith") & (F.col("level") != "D") & (F.size(words) > len(OPENING)) & (F.slice(T.wording_tokens(F.col("text"), profile), 1, len(OPENING)) == F.array(*map(F.lit, OPENING)))
    out = claims.withColumn("opening", F.coalesce(opens, F.lit(False)))
    return out.withColumn("text", F.when(F.col("opening"), F.array_join(F.slice(words, len(OPENING) + 1, F.greatest(F.size(words), F.lit(1))), " ")).otherwise(F.col("text")))


def surface(doc: Column, claim: Column, profile: T.Profile, whole_words: bool = True) -> Column:
    """Whether a claim's wording, before stemming, stands in a text: as a run of words, or of the normal form."""
    if whole_words:
        needle = F.array_join(T.wording_tokens(claim, profile), " ")
        return (needle != "") & T.contains_words(F.array_join(T.wording_tokens(doc, profile), " "), needle)
    return T.contains_words(T.normalize(doc, profile), T.normalize(claim, profile))


def residue(added: Column, keys: Column) -> Column:
    """How closely the unmatched words echo words of the source: the mean over them of the best likeness of letter pairs; 1 if none is unmatched. Both as arrays of pairs."""
    best = F.transform(added, lambda w: F.coalesce(F.array_max(F.transform(keys, lambda k: T.jaccard(w, k))), F.lit(0.0)))
    return F.when(F.size(added) == 0, 1.0).otherwise(F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(added))


def verse_candidates(claims: DataFrame, hits: DataFrame, corpus: Corpus) -> DataFrame:
    """claim, hit, id, grp, ord, ord_end (null for one verse), verified, source: each hit, and the runs that start at it or one verse before.

    claims: claim, text. hits: claim, id, rank, score. A run has up to MAX_EXTRA verses more, without a gap, and ends once it has as many words as the claim.
    """
    verses = corpus.verses.select("id", "grp", "ord", F.col("text").alias("source"), "verified", F.size(T.key_tokens(F.col("text"), corpus.profile)).alias("n"))
    first = hits.select("claim", F.col("id").alias("hit"), "rank", "score").join(verses.select(F.col("id").alias("hit"), "grp", "ord"), "hit")
    starts = first.withColumn("step", F.explode(F.array(F.lit(0), F.lit(-1)))).withColumn("extra", F.explode(F.sequence(F.lit(0), F.lit(MAX_EXTRA)))).where("extra > 0 or step = 0")
    starts = starts.withColumn("start", F.col("ord") + F.col("step"))
    members = starts.withColumn("at", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("extra")))).drop("ord")
    members = members.join(verses.withColumnRenamed("ord", "at"), ["grp", "at"])
    run = F.array_sort(F.collect_list(F.struct("at", "source", "n", "verified", "id")))
    runs = members.groupBy("claim", "hit", "rank", "score", "grp", "step", "start", "extra").agg(run.alias("run")).where(F.size("run") == F.col("extra") + 1)
    before = F.aggregate(F.slice("run", 1, F.col("extra")), F.lit(0), lambda n, x: n + x["n"])
    runs = runs.join(claims.select("claim", F.size(T.key_tokens(F.col("text"), corpus.profile)).alias("n_words")), "claim").where((F.col("extra") <= 1) | (before < F.col("n_words")))
    ident = F.when(F.col("extra") == 0, F.get("run", F.lit(0))["id"].cast("string")).otherwise(F.concat_ws(":", F.get("run", F.lit(0))["id"].cast("string"), F.col("extra").cast("string")))
    return runs.select("claim", "hit", "rank", "score", ident.alias("id"), "grp", F.col("start").alias("ord"), F.when(F.col("extra") > 0, F.col("start") + F.col("extra")).alias("ord_end"), "step",
                       F.forall("run", lambda x: x["verified"]).alias("verified"), F.array_join(F.transform("run", lambda x: x["source"]), " ").alias("source"))


def best_verses(claims: DataFrame, hits: DataFrame, corpus: Corpus) -> DataFrame:
    """claim and its best verse candidate: id, grp, ord, ord_end, verified, source, al, whole, ties, alternatives (array of ids).

    Most words found in order come first, then literal wording, then echoes of the unmatched words, the tighter span, the smaller verse. ties counts the verses of the
    same coverage and wording. Alternatives are those by verse (4), or for an inexact quotation the nearest single verses that share most of its words (5).
    """
    c = F.col
    met = verse_candidates(claims, hits, corpus).join(claims.select("claim", "text"), "claim")
    al = stored(align.align_pairs(met, "text", "source", corpus.profile, stemmed=False, keep_negation=True), "verse-alignments")
    # one verse earlier counts only where the hit itself leaves words open
    own = al.where("step = 0 and ord_end is null").select("claim", "hit", F.col("al.claim_coverage").alias("_own"))
    al = al.join(own, ["claim", "hit"], "left").where("step = 0 or _own < 1").drop("_own")
    al = al.withColumns({"cover": F.round("al.claim_coverage", 3), "literal": surface(c("source"), c("text"), corpus.profile), "tight": F.round("al.span_coverage", 3), "alike": F.round("al.dice", 3)})
    # echoes only order what can be shown
    al = al.dropDuplicates(["claim", "id"]).withColumn("_top", F.max("cover").over(W.partitionBy("claim")))
    shows = (c("cover") == c("_top")) | (c("cover") >= F.greatest(F.lit(LEAST_NEAR), c("_top") - NEAR_GAP - 0.001))
    al = al.withColumn("_added", F.when(shows, F.transform(F.flatten("al.added"), T.letter_pairs))).withColumn("_keys", F.when(shows, F.transform(F.array_distinct(T.key_tokens(c("source"), corpus.profile)), T.letter_pairs)))
    al = al.withColumn("echo", F.when(shows, F.round(residue(c("_added"), c("_keys")), 3)).otherwise(0.0)).drop("_added", "_keys", "_top")
    order = [F.desc(x) for x in ("cover", "literal", "echo", "tight", "alike")] + [c("grp"), c("ord"), c("ord_end").asc_nulls_first(), c("id")]
    per = W.partitionBy("claim")
    al = al.withColumn("n", F.row_number().over(per.orderBy(*order)))
    best = al.where("n = 1").select("claim", *[c(x).alias(f"b_{x}") for x in ("cover", "literal", "grp", "ord")], c("al.exact").alias("b_exact"), c("al.claim_coverage").alias("b_coverage"))
    rest = al.join(best, "claim")
    verse = F.struct("grp", "ord")
    tied = (c("cover") == c("b_cover")) & (c("literal") == c("b_literal"))
    other = (c("grp") != c("b_grp")) | (c("ord") != c("b_ord"))
    near = other & c("ord_end").isNull() & (c("al.claim_coverage") >= F.greatest(F.lit(LEAST_NEAR), F.round(c("b_coverage") - NEAR_GAP, 3)))
    firsts = rest.groupBy("claim", "b_exact", "grp", "ord").agg(F.bool_or(tied).alias("tied"), F.bool_or(tied & other).alias("also"), F.min(F.when(near, F.struct("n", "id"))).alias("near"), F.min(F.when(tied & other, F.struct("n", "id"))).alias("same"))
    told = firsts.groupBy("claim", "b_exact").agg(F.count_if("tied").alias("ties"), F.array_sort(F.collect_list(F.when(c("also"), F.struct(verse.alias("v"), c("same.id").alias("id"))))).alias("same"), F.array_sort(F.collect_list("near")).alias("near"))
    shown = F.when(c("b_exact"), F.slice(c("same.id"), 1, TIED)).otherwise(F.slice(c("near.id"), 1, NEAR))
    whole = c("ord_end").isNull() & (T.wording_tokens(c("text"), corpus.profile) == T.wording_tokens(c("source"), corpus.profile))
    return al.where("n = 1").select("claim", "id", "hit", "rank", "score", "grp", "ord", "ord_end", "verified", "source", "al", whole.alias("whole")).join(told.select("claim", "ties", shown.alias("alternatives")), "claim")


def best_records(claims: DataFrame, hits: DataFrame, corpus: Corpus) -> DataFrame:
    """claim and its best record: id, verified, classes, source, al, whole. Content words count most, then all words, wording, likeness, the fused score and its rank."""
    c = F.col
    met = hits.join(corpus.records.withColumnRenamed("text", "source"), "id").join(claims.select("claim", "text"), "claim")
    al = align.align_pairs(met, "text", "source", corpus.profile, stemmed=False, keep_negation=True, leading_conjunction=True)
    al = stored(al.withColumn("literal", surface(c("source"), c("text"), corpus.profile, False)), "record-alignments")
    order = [F.desc(F.round("al.content_coverage", 3)), F.desc(F.round("al.claim_coverage", 3)), F.desc("literal"), F.desc("al.dice"), F.desc("score"), c("rank").asc_nulls_last(), c("id")]
    whole = T.wording_tokens(c("text"), corpus.profile) == T.wording_tokens(c("source"), corpus.profile)
    return al.withColumn("n", F.row_number().over(W.partitionBy("claim").orderBy(*order))).where("n = 1").select("claim", "id", "rank", "score", "verified", "classes", "source", "al", whole.alias("whole"))


def merged_phrases(altered: DataFrame, corpus: Corpus, k: int = 5) -> DataFrame:
    """claim, at, last, other: for each unmatched run of two words or more, the first other verse that a search finds and that contains it.

    altered: claim, id (of its candidate), added (runs of key words).
    """
    runs = altered.select("claim", "id", F.size("added").alias("n"), F.posexplode("added").alias("at", "run")).where(F.size("run") >= 2)
    asked = stored(runs.withColumn("query", F.concat_ws("/", F.col("claim").cast("string"), F.col("at").cast("string"))), "merged-runs")
    hits = corpus.find_verses(asked.select(F.col("query").alias("claim"), F.array_join("run", " ").alias("text")), k)
    hits = hits.select(F.col("claim").alias("query"), F.col("id").alias("other"), "rank").join(asked, "query")
    verses = corpus.verses.select(F.col("id").alias("other"), T.key_tokens(F.col("text"), corpus.profile).alias("keys"))
    hits = hits.where(F.col("other").cast("string") != F.col("id")).join(verses, "other").where(T.contains_run(F.col("keys"), F.col("run")))
    return hits.groupBy("claim", "at", (F.col("at") == F.col("n") - 1).alias("last")).agg(F.min_by("other", F.struct(F.col("rank").isNull(), "rank", "other")).alias("other"))


def judge_claims(claims: DataFrame, corpus: Corpus, k: int = 8, th: rules.Thresholds = rules.Thresholds(), complete: bool = True) -> DataFrame:
    """A row for each claim: claim, verdict, level, kind and id of the source it rests on, closest_id, evidence, diff, alternatives, ties, notes.

    claims: claim (unique), text, hint, level, context_after, request. notes are codes. A request that names no text is never searched.
    """
    c = F.col
    asked = stored(without_opening(claims, corpus.profile).withColumn("n_words", F.size(T.key_tokens(c("text"), corpus.profile))), "claims")
    search = asked.where("request != 'evidence_ref'").select("claim", "text")
    pick = lambda t, p, more: t.select("claim", *[c(x).alias(f"{p}_{x.split('.')[-1]}") for x in ("id", "source", "verified", "al", "whole", "rank", "score", *more)])
    verse = pick(best_verses(search, corpus.find_verses(search, k), corpus), "v", ("grp", "ord", "ord_end", "ties", "alternatives"))
    record = pick(best_records(search, corpus.find_records(search, k), corpus), "h", ("classes",))
    rows = asked.join(verse, "claim", "left").join(record, "claim", "left")
    rows = rows.withColumns({"question": F.contains("text", F.lit("؟")) | F.contains("text", F.lit("?")), "v_coverage": c("v_al.claim_coverage"), "v_content": c("v_al.content_coverage"), "v_exact": c("v_al.exact"),
                             "h_content": c("h_al.content_coverage"), "h_exact": c("h_al.exact"), "h_verdict": rules.graded(c("h_classes"))})
    rows = stored(rules.decide(rows, th), "decided")
    merged = merged_phrases(rows.where("verdict = 'ALTERED'").select("claim", c("v_id").alias("id"), c("v_al.added").alias("added")), corpus)
    merged = merged.groupBy("claim").agg(F.bool_or("last").alias("merged_tail"), F.array_sort(F.collect_list(F.struct("at", "other"))).alias("merged"))
    rows = rows.join(merged, "claim", "left").withColumn("merged_tail", F.coalesce("merged_tail", F.lit(False)))
    al = F.when(c("basis") == "quran", c("v_al")).when(c("basis") == "hadith", c("h_al"))
    rows = rows.withColumn("al", al)
    # unmatched words at the end that no other verse has stand for the words that follow in the source
    last = F.try_element_at("al.diff", F.lit(-1))
    swaps = c("basis").eqNullSafe("quran") & c("verdict").isin("ALTERED", "NEEDS_REVIEW") & (c("n_words") >= th.min_words_altered) & last["op"].eqNullSafe("added") & (c("al.tail_source") != "") & ~c("merged_tail")
    changed = F.struct(F.lit("changed").alias("op"), F.lit(None).cast("string").alias("text"), last["claim"].alias("claim"), c("al.tail_source").alias("source"))
    diff = F.when(c("al.exact"), F.slice("al.diff", 1, 0)).when(swaps, F.concat(F.slice("al.diff", 1, F.greatest(F.size("al.diff") - 1, F.lit(0))), F.array(changed))).otherwise(c("al.diff"))
    rows = rules.apply_request(rows)
    shown = c("basis").isNotNull()
    used = lambda v, h: F.when(c("basis") == "quran", v).when(c("basis") == "hadith", h)
    evidence = F.when(shown, F.struct(*[F.round(f"al.{x}", 3).alias(x) for x in ("claim_coverage", "content_coverage", "span_coverage", "dice")], F.round(used(c("v_score"), c("h_score")), 5).alias("score"), used(c("v_rank"), c("h_rank")).alias("rank")))
    own_verse = (c("level") == "D") & (c("verdict") == "VERIFIED") & (c("basis") == "quran")
    partial = F.array(F.lit("partial_index"))
    notes = F.concat(F.when(c("opening") & (c("basis") == "quran"), F.array(F.lit("opening_phrase"))).otherwise(F.array().cast("array<string>")), "notes",
                     F.transform(F.coalesce("merged", F.array().cast("array<struct<at:int,other:string>>")), lambda m: F.concat(F.lit("merged:"), m["other"].cast("string"))),
                     F.when((c("basis") == "quran") & (F.size("v_alternatives") > 0), F.array(F.when(c("verdict") == "VERIFIED", "repeated").otherwise("shared_words"))).otherwise(F.array().cast("array<string>")),
                     F.when(F.lit(not complete) & c("verdict").isin("ALTERED", "NO_ORIGIN") & ((c("hint") == "quran") | (c("basis") == "quran")), partial).otherwise(F.array().cast("array<string>")))
    return rows.select("claim", "verdict", F.when(shown & (c("level") == "B") | own_verse, "A").otherwise(c("level")).alias("level"), c("basis").alias("kind"), used(c("v_id").cast("string"), c("h_id").cast("string")).alias("source_id"),
                       F.when(c("closest") == "quran", c("v_id").cast("string")).when(c("closest") == "hadith", c("h_id").cast("string")).alias("closest_id"), evidence.alias("evidence"),
                       F.when(shown, diff).alias("diff"), F.when(c("basis") == "quran", c("v_alternatives")).alias("alternatives"), F.when(c("basis") == "quran", c("v_ties")).alias("ties"), notes.alias("notes"), "n_words", "hint", "request")


def lookups(judged: DataFrame, post: str, order: str, most: int = MAX_LOOKUPS) -> DataFrame:
    """judged with `lookup`: whether a claim is worth a live lookup and among the first `most` such claims of its post."""
    c = F.col
    worth = (c("verdict") == "NO_ORIGIN") & ~F.array_contains("notes", "one_word") & (c("level") != "D") & ~c("request").isin("question", "evidence_ref")
    worth &= ((c("hint") == "hadith") & (c("n_words") >= MARKED_WORDS)) | ((c("hint") == "unknown") & (c("n_words") >= UNMARKED_WORDS))
    n = F.sum(worth.cast("int")).over(W.partitionBy(post).orderBy(order))
    return judged.withColumn("lookup", worth & (n <= most))

