"""Batch evaluation: rank metrics by group, sampling, mutations, corpus comparison, constraints, digests."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from provena.functions.text import LATIN, NEGATIONS, Profile, contains_run, normalize, wording_tokens

#: Marks of a quoted verse, a sign that vocalises nothing, the word that negates.
MARKED, VOWEL, NOT = ("﴿", "﴾"), "َ", "لا"


def first_relevant(ranked: DataFrame, query_id: str, relevant: Column, k: int = 8) -> DataFrame:
    """query_id, rank of its first relevant result within k, null if none."""
    return ranked.groupBy(query_id).agg(F.min(F.when(relevant & (F.col("rank") <= k), F.col("rank"))).alias("rank"))


def hit_metrics(rank: str = "rank") -> list[Column]:
    r = F.col(rank)
    hit = lambda k: F.avg(F.when(r <= k, 1.0).otherwise(0.0))
    return [F.count("*").alias("n"), F.round(hit(1), 6).alias("hit_1"), F.round(hit(3), 6).alias("hit_3"), F.round(hit(8), 6).alias("hit_8"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr_8")]


def grouped_metrics(ranks: DataFrame, groups: list[str], rank: str = "rank") -> DataFrame:
    """hit@1/3/8 and MRR for all rows and by each group column, in one pass over grouping sets."""
    return ranks.groupingSets([[], *[[g] for g in groups]], *groups).agg(*hit_metrics(rank))


def hash_sample(rows: DataFrame, group: str, key: str, seed: str, total: int | None = None) -> DataFrame:
    """The row of each group with the least sha256(seed:key); of these the `total` least by another seed. Reproducible in any engine."""
    h = lambda s: F.sha2(F.concat(F.lit(f"{s}:"), F.col(key).cast("string")), 256)
    best = rows.groupBy(group).agg(F.min_by(key, h(seed)).alias(key))
    return best if total is None else best.orderBy(h(seed + "-all"), key).limit(total)


def drop_letter(word: Column) -> Column:
    half = F.floor(F.length(word) / 2).cast("int")
    return F.concat(F.substring(word, F.lit(1), half), F.substring(word, half + 2, F.length(word)))


def swap_letters(word: Column) -> Column:
    """The middle letter and the one before it trade places; if equal one is dropped."""
    i = F.floor(F.length(word) / 2).cast("int")
    a, b = F.substring(word, i, F.lit(1)), F.substring(word, i + 1, F.lit(1))
    return F.when(a != b, F.concat(F.substring(word, F.lit(1), i - 1), b, a, F.substring(word, i + 2, F.length(word)))).otherwise(drop_letter(word))


def longest_first(words: Column) -> Column:
    """Positions (from 0) of words by falling length, then position."""
    return F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i")))), lambda s: s["i"])


def replace_at(words: Column, at: Column, change) -> Column:
    return F.transform(words, lambda w, i: F.when(i == at, change(w)).otherwise(w))


def typo_mutations(records: DataFrame, id_col: str, text_col: str = "text", profile: Profile = LATIN) -> DataFrame:
    """id, family, query, intended: exact, letter_dropped, letters_swapped, two_words_typos and excerpt_with_typo where they apply."""
    r = records.select(F.col(id_col), wording_tokens(F.col(text_col), profile).alias("w")).where(F.size("w") > 0)
    r = r.withColumn("o", longest_first(F.col("w"))).withColumn("a", F.get("o", F.lit(0))).withColumn("b", F.get("o", F.lit(1)))
    r = r.withColumn("ex", F.when(F.size("w") >= 9, F.slice("w", F.floor((F.size("w") - 5) / 2).cast("int") + 1, F.lit(5))))
    r = r.withColumn("x", F.get(longest_first(F.col("ex")), F.lit(0)))
    size = lambda words, at: F.length(F.get(words, at))
    w, join = F.col("w"), lambda c: F.array_join(c, " ")
    long1, long2, long3 = size(w, F.col("a")) >= 4, size(w, F.col("b")) >= 4, size(F.col("ex"), F.col("x")) >= 4
    rows = [F.struct(F.lit("exact").alias("family"), join(w).alias("query"), join(w).alias("intended")),
            F.when(long1, F.struct(F.lit("letter_dropped").alias("family"), join(replace_at(w, F.col("a"), drop_letter)).alias("query"), join(w).alias("intended"))),
            F.when(long1, F.struct(F.lit("letters_swapped").alias("family"), join(replace_at(w, F.col("a"), swap_letters)).alias("query"), join(w).alias("intended"))),
            F.when((F.size(w) >= 4) & long2, F.struct(F.lit("two_words_typos").alias("family"), join(replace_at(replace_at(w, F.col("a"), drop_letter), F.col("b"), drop_letter)).alias("query"), join(w).alias("intended"))),
            F.when(long3, F.struct(F.lit("excerpt_with_typo").alias("family"), join(replace_at(F.col("ex"), F.col("x"), drop_letter)).alias("query"), join(F.col("ex")).alias("intended")))]
    return r.select(id_col, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("m")).select(id_col, "m.*")


def transposed(words: Column) -> Column:
    """words as a text with the middle letters of the longest word of 4 letters or more changed places; null if there is none."""
    at = F.get(longest_first(words), F.lit(0))
    return F.when(F.length(F.get(words, at)) >= 4, F.array_join(replace_at(words, at, swap_letters), " "))


def text_mutations(records: DataFrame, id_col: str, text_col: str = "text", profile: Profile = LATIN, negations: tuple[str, ...] = NEGATIONS) -> DataFrame:
    """id, family, query, anchor: verbatim, punctuation_spacing, upper_case, vowel_noise, letter_folding, decomposed, five_word_excerpt and its transposition (8 words or more), else the transposition of a word, negation_added and negation_removed.

    Families that change nothing are left out. Decomposition has no built-in and is a pandas UDF.
    """
    r = records.select(F.col(id_col), F.col(text_col).alias("t"), wording_tokens(F.col(text_col), profile).alias("w")).where(F.size("w") > 0)
    r = r.withColumn("ex", F.when(F.size("w") >= 8, F.slice("w", F.floor((F.size("w") - 5) / 2).cast("int") + 1, F.lit(5))))
    r = r.withColumn("plain", F.array_join("w", " ")).withColumn("no", F.filter(F.transform("w", lambda w, i: F.when(w.isin(*negations), i)), lambda i: i.isNotNull()))
    w, plain, excerpt = F.col("w"), F.col("plain"), F.array_join("ex", " ")
    make = lambda name, q, a: F.struct(F.lit(name).alias("family"), q.alias("query"), a.alias("anchor"))
    changed = lambda name, q: F.when(q != plain, make(name, q, plain))
    vowels = F.array_join(F.transform(w, lambda x: F.concat(F.substring(x, 1, 1), F.lit(VOWEL), F.substring(x, 2, 1 << 20))), " ")
    without = F.array_join(F.filter(w, lambda x, i: i != F.get("no", F.lit(0))), " ")
    rows = [make("verbatim", F.col("t"), plain), make("punctuation_spacing", F.concat(F.lit("« "), F.array_join("w", " ،  "), F.lit(" »")), plain), make("upper_case", F.upper(plain), plain), make("vowel_noise", vowels, plain),
            changed("letter_folding", F.translate(plain, "أإآٱ", "اااا")), changed("decomposed", decomposed(plain)), F.when(F.col("ex").isNotNull(), make("five_word_excerpt", excerpt, excerpt)),
            F.when(F.col("ex").isNotNull() & transposed(F.col("ex")).isNotNull(), make("five_word_excerpt_transposition", transposed(F.col("ex")), excerpt)), F.when(F.col("ex").isNull() & transposed(w).isNotNull(), make("single_word_transposition", transposed(w), plain)),
            make("negation_added", F.concat(F.lit(NOT + " "), plain), plain), F.when((F.size("no") > 0) & (F.size("w") > 2), make("negation_removed", without, plain))]
    return r.select(id_col, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("m")).select(id_col, "m.*")


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


def verse_forms(records: DataFrame, id_col: str, text_col: str = "text", profile: Profile = LATIN) -> DataFrame:
    """id, form, query, expected: marked as it is, plain with noise, and marked without its middle word (6 words or more)."""
    r = records.select(F.col(id_col), F.col(text_col).alias("t"), wording_tokens(F.col(text_col), profile).alias("w")).where(F.size("w") > 0)
    r = r.withColumn("at", F.get(longest_first(F.col("w")), F.lit(0)))
    stretch = lambda x: F.when(F.length(x) >= 3, F.concat(F.substring(x, 1, 2), F.lit("ـ"), F.substring(x, 3, 1 << 20))).otherwise(x)
    noisy = F.transform(replace_at(F.col("w"), F.col("at"), stretch), lambda x, i: F.when((i == 1) & (F.size("w") >= 3), F.concat(x, F.lit("،"))).otherwise(x))
    noisy = F.concat(F.get(noisy, F.lit(0)), F.lit("  "), F.array_join(F.slice(noisy, 2, F.greatest(F.size("w"), F.lit(1))), " "), F.lit("."))
    middle = F.floor(F.size("w") / 2).cast("int")
    mark = lambda x: F.concat(F.lit(MARKED[0]), x, F.lit(MARKED[1]))
    rows = [F.struct(F.lit("marked").alias("form"), mark(F.col("t")).alias("query"), F.lit("VERIFIED").alias("expected")), F.struct(F.lit("noisy").alias("form"), noisy.alias("query"), F.lit("VERIFIED").alias("expected")),
            F.when(F.size("w") >= 6, F.struct(F.lit("word_missing").alias("form"), mark(F.array_join(F.filter("w", lambda x, i: i != middle), " ")).alias("query"), F.lit("ALTERED").alias("expected")))]
    return r.select(id_col, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("m")).select(id_col, "m.*")


def question_forms(records: DataFrame, id_col: str, text_col: str = "text", forms: dict[str, str] | None = None) -> DataFrame:
    """id, form, query: each text in each template ({} is the text)."""
    forms = forms or {"quoted": "قال رسول الله ﷺ: «{}»", "what_is_its_grade": "ما صحة حديث {}؟", "heard_that": "سمعت أن النبي قال {}، صحيح؟"}
    rows = [F.struct(F.lit(k).alias("form"), F.concat(*[F.lit(p) if i == 0 else F.concat(F.col(text_col), F.lit(p)) for i, p in enumerate(v.split("{}"))]).alias("query")) for k, v in forms.items()]
    return records.select(id_col, F.explode(F.array(*rows)).alias("m")).select(id_col, "m.*")


def padded_corpus(records: DataFrame, columns: list[str], profile: Profile = LATIN) -> DataFrame:
    """p: the normal form of each text between blanks, a row for each of the columns that has one; what an exact search looks in."""
    rows = records.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("t")).where("t is not null")
    return rows.select(F.concat(F.lit(" "), normalize(F.col("t"), profile), F.lit(" ")).alias("p")).where("p != '  '")


def exact_sufficient(expected: Column, in_verses: Column, in_records: Column) -> Column:
    """Whether finding a text or not is all that an expected verdict takes."""
    return F.when(expected == "VERIFIED", in_verses).when(expected == "NO_ORIGIN", ~in_verses & ~in_records).otherwise(False)


def engine_sufficient(expected: Column, got: Column, source: Column, expected_source: Column) -> Column:
    """Whether a verdict is the expected one, with the expected source where one is named, and with any where the verdict rests on one."""
    rests = expected.isin("VERIFIED", "NOT_AUTHENTIC", "DISPUTED", "IN_SOURCE", "ALTERED")
    return F.coalesce(got == expected, F.lit(False)) & F.when(expected_source.isNotNull(), source.eqNullSafe(expected_source)).when(rests, source.isNotNull()).otherwise(True)


def expected_against_actual(cases: DataFrame, case: str, expected: str, claims: DataFrame, actual: str, order: str) -> DataFrame:
    """case, ordinal (from 0), expected, actual: each expected verdict with the claim of its place, null where there is none."""
    want = cases.select(case, F.posexplode(expected).alias("ordinal", "expected"))
    got = claims.withColumn("ordinal", F.row_number().over(W.partitionBy(case).orderBy(order)) - 1).select(case, "ordinal", F.col(actual).alias("actual"))
    return want.join(got, [case, "ordinal"], "left")


def repeated(cases: DataFrame, times: int) -> DataFrame:
    """cases with `run`: each as often as it is to be tried."""
    return cases.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(times))))


def benefit(rows: DataFrame, groups: list[str], exact: str, engine: str) -> DataFrame:
    """items, sums and rates of two methods for all rows and by each group; rates are null without items."""
    out = rows.groupingSets([[], *[[g] for g in groups]], *groups).agg(F.count("*").alias("items"), F.count_if(F.col(exact)).alias("n_exact"), F.count_if(F.col(engine)).alias("n_engine"))
    return out.withColumns({"exact_rate": F.round(F.try_divide("n_exact", "items"), 4), "engine_rate": F.round(F.try_divide("n_engine", "items"), 4)})


def by_expected(rows: DataFrame, expected: str, exact: str, matches: str) -> DataFrame:
    return rows.groupBy(expected).agg(F.count("*").alias("claims"), F.count_if(F.col(exact)).alias("exact_sufficient"), F.count_if(F.col(matches)).alias("matches"))


def members_of(ids: DataFrame, id_col: str) -> DataFrame:
    """ids with grp and ord of every row that an id names: `g:n`, or a run `g:a-b`. Other ids name none."""
    part = lambda k: F.regexp_extract(F.col(id_col), r"^(\d+):(\d+)(?:-(\d+))?$", k)
    first, last = part(2).try_cast("int"), F.coalesce(F.nullif(part(3), F.lit("")).try_cast("int"), part(2).try_cast("int"))
    rows = ids.where(F.rlike(id_col, F.lit(r"^\d+:\d+(-\d+)?$"))).withColumn("grp", part(1).try_cast("int"))
    return rows.where(first <= last).withColumn("ord", F.explode(F.sequence(first, last)))


def holds(results: DataFrame, id_col: str, intended: str, verses: DataFrame, words: str) -> DataFrame:
    """id, intended, holds: whether the rows that an id names, put together, contain the intended words as a run. verses: grp, ord, words."""
    named = members_of(results.select(id_col, intended).distinct(), id_col).join(verses.select("grp", "ord", F.col(words).alias("_w")), ["grp", "ord"])
    whole = named.groupBy(id_col, intended).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_w"))), lambda x: x["_w"])).alias("_hay"))
    return results.select(id_col, intended).distinct().join(whole, [id_col, intended], "left").select(id_col, intended, F.coalesce(contains_run(F.col("_hay"), F.col(intended)), F.lit(False)).alias("holds"))


def failures(rows: DataFrame, kind: str, right: Column, source: Column, code: str) -> DataFrame:
    """kind, category, code, n of results that aren't what was asked for: the right source with another verdict, no source, or another one."""
    category = F.when(right, "right_source_other_verdict").when(source.isNull() | (source == ""), "no_source").otherwise("other_source")
    return rows.groupBy(kind, category.alias("category"), code).agg(F.count("*").alias("n"))


def repeated_total(hits: DataFrame, claims: DataFrame, claim_id: str, ties: str) -> DataFrame:
    """claim_id, total: how many records contain a claim (its phrase hits), at least the ties that were found."""
    n = hits.groupBy(claim_id).agg(F.count("*").alias("_n"))
    return claims.join(n, claim_id, "left").select(claim_id, F.greatest(F.coalesce("_n", F.lit(0)), F.col(ties)).alias("total"))


def consistency(results: DataFrame, case: str, run: str, version: str, value: str, runs: int) -> DataFrame:
    """case, problem: cases that weren't run as often as due, that mix versions, or whose runs differ."""
    per = results.groupBy(case).agg(F.count_distinct(run).alias("n"), F.count_distinct(version).alias("versions"), F.count_distinct(value).alias("values"))
    rules = [("runs", F.col("n") != runs), ("versions", F.col("versions") > 1), ("differs", F.col("values") > 1)]
    return per.select(case, F.explode(F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules]), lambda x: x.isNotNull())).alias("problem"))


def beats(rows: DataFrame, group: str, method: str, value: str, a: str, b: str) -> DataFrame:
    """One row: groups, and in how many of them the mean of method a is above that of method b."""
    mean = lambda m: F.avg(F.when(F.col(method) == m, F.col(value)))
    return rows.groupBy(group).agg(mean(a).alias("_a"), mean(b).alias("_b")).agg(F.count("*").alias("groups"), F.count_if(F.col("_a") > F.col("_b")).alias("a_beats_b"))


def sample_in_forms(records: DataFrame, group: str, id_col: str, text_col: str, seed: str, least: int = 4, profile: Profile = LATIN) -> DataFrame:
    """group, id, form, query, expected, accept: of each group a row by hash, of those with `least` words if there are any, in three forms; accept has the ids of all rows of its wording."""
    r = records.select(group, F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array_join(wording_tokens(F.col(text_col), profile), " ").alias("wording"))
    short = F.size(F.split("wording", " ")) < least
    picked = r.groupBy(group).agg(F.min_by("id", F.struct(short.alias("s"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"))).alias("id"))
    same = r.groupBy("wording").agg(F.array_sort(F.collect_set("id")).alias("accept"))
    chosen = picked.join(r, [group, "id"]).dropDuplicates([group, "id"]).join(same, "wording")
    return verse_forms(chosen, "id", "text", profile).join(chosen.select(group, "id", "accept"), "id")


def compare(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, status: equal, differs, missing (only in ours) or extra (only in theirs)."""
    a, b = ours.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ina")), theirs.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    status = F.when(F.col("_inb").isNull(), "missing").when(F.col("_ina").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("differs")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def adjacent_runs(rows: DataFrame, group: str, order: str, text: str, extra: int) -> DataFrame:
    """group, order, text of each row joined with the next `extra` by consecutive order; none if one of them is missing."""
    w = W.partitionBy(group).orderBy(order).rangeBetween(0, extra)
    run = rows.select(group, order, F.collect_list(F.struct(order, text)).over(w).alias("_r"))
    return run.where(F.size("_r") == extra + 1).select(group, order, F.array_join(F.array_sort("_r")[text], " ").alias("text"))


def constraint_report(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """One row per constraint with the number of violations: unique key, and each required column present."""
    row = df.agg((F.count("*") - F.count_distinct(key)).alias("unique"), *[F.count_if(F.col(c).isNull()).alias(f"present_{c}") for c in required])
    names = ["unique", *[f"present_{c}" for c in required]]
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in names])).alias("r")).select("r.*")


def content_digest(df: DataFrame, key: str, columns: list[str], width: int = 1000, levels: int = 2) -> DataFrame:
    """digest of a corpus with numbered rows: sha256 of each row, then of the ordered digests of each `width` neighbours, in `levels` steps, then of what is left.

    No row holds more than `width` digests, as long as the numbers are below width ** (levels + 1); more levels make room for more.
    """
    row = F.sha2(F.concat_ws("|", F.col(key).cast("string"), *[F.col(c) for c in columns]), 256)
    part = df.select(F.col(key).cast("long").alias("k"), row.alias("h"))
    gathered = F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("k", "h")))["h"], ""), 256)
    for _ in range(levels):
        part = part.groupBy(F.floor(F.col("k") / width).alias("up")).agg(gathered.alias("h")).select(F.col("up").alias("k"), "h")
    return part.agg(gathered.alias("digest"))


def keep_first(rows: DataFrame, partition: list[str], key: list[str], order: str, cap: int) -> DataFrame:
    """The first row of each key within a partition, then the first `cap` rows of the partition."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(*partition, *key).orderBy(order))).where("_n = 1").drop("_n")
    return first.withColumn("_n", F.row_number().over(W.partitionBy(*partition).orderBy(order))).where(F.col("_n") <= cap).drop("_n")
