"""Verdict rules and ruling aggregates as Column expressions over wide candidate rows."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from provena.functions.text import ARABIC, normalize, split_words

# Verdict codes, grade classes and the words that the ruling classifier reads.
VERDICTS = ("VERIFIED", "ALTERED", "NOT_AUTHENTIC", "DISPUTED", "NEEDS_REVIEW", "NO_ORIGIN", "REFER", "OUT_OF_SCOPE", "IN_SOURCE")
KNOWN_CLASSES = ("authentic", "weak", "very_weak", "fabricated", "baseless", "unverified")
FABRICATED = ("موضوع", "باطل", "كذب", "مختلق", "مختلقه", "المختلقه", "اباطيل", "الاباطيل")
BASELESS = ("لا اصل له", "ليس له اصل", "لا اصل", "ليس لهذا الحديث اصل", "لم يرد", "ليس حديثا", "ليس بحديث", "بلا اسناد", "لا اسناد له")
WEAK = ("ضعيف", "ضعيفه", "ضعف", "ضعفه", "منكر", "واه", "متروك", "خطا", "اخطا", "لا يصح", "لم يصح", "غير صحيح", "ليس بصحيح", "وليس صحيح", "لم يثبت", "لا يثبت", "شاذ", "معلول", "مرسل")
AUTHENTIC = ("صحيح", "صحيحه", "حسن", "ثابت", "ثبت", "جيد", "قوي", "ثقات", "محفوظ", "صحاح", "صحته", "الصحه")
CHAIN = ("اسناد", "الاسناد", "اسناده", "اسنادها", "اسانيده", "باسناد", "الوجه", "طريق", "طرقه", "اللفظ")
JOINED_LETTERS = ("و", "ف", "ب")
RULING_AFTER = r"(?U)\b(لا يجوز|يجوز|حرام|حلال|واجب|لا يحل)\b"
#: Verdicts that rest on a text on record.
FOUND = ("VERIFIED", "NOT_AUTHENTIC", "DISPUTED", "IN_SOURCE")


@dataclass(frozen=True)
class Thresholds:
    hadith_review_min: float = 0.6
    quran_altered_min: float = 0.6
    quran_unknown_min: float = 0.8
    hadith_match_min: float = 0.75
    closest_min: float = 0.6
    min_words_altered: int = 3
    require_verified: bool = False


def has_words(text: Column, words) -> Column:
    """Whether one of words stands in text: single words whole, phrases anywhere."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    out = F.lit(False)
    for w in words:
        out = out | (F.contains(text, F.lit(w)) if " " in w else F.contains(padded, F.lit(f" {w} ")))
    return out


def ruling_class(grade: Column, compose: bool = False) -> Column:
    """Class of a ruling from its plain wording; the harsher wins. A joined letter before a word of over 3 letters is also read without."""
    t = normalize(grade, ARABIC, compose)
    joined = F.array_join(F.transform(split_words(t), lambda w: F.when((F.length(w) > 3) & w.substr(1, 1).isin(*JOINED_LETTERS), F.substring(w, 2, 1 << 20)).otherwise(w)), " ")
    either = lambda words: has_words(t, words) | has_words(joined, words)
    return F.when(either(FABRICATED), "fabricated").when(has_words(t, BASELESS), "baseless").when(either(WEAK), "weak").when(either(AUTHENTIC), "authentic").otherwise("unclassified")


def chain_only(grade: Column, compose: bool = False) -> Column:
    t = normalize(grade, ARABIC, compose)
    return has_words(t, CHAIN) & ~has_words(t, BASELESS)


def rulings_verdict(n: Column, accept: Column, against: Column, reject: Column) -> Column:
    """From counts of rulings: all, accepting, against it, against the text itself."""
    return (F.when((accept > 0) & (reject > 0), "DISPUTED").when((accept > 0) & (against == 0) & (accept * 2 >= n), "VERIFIED")
            .when((accept == 0) & (reject >= 2) & (reject * 2 >= n), "NOT_AUTHENTIC").otherwise("IN_SOURCE"))


def rulings_by(grades: DataFrame, key: str, grade: str = "grade") -> DataFrame:
    """key, n, accept, against, reject, verdict: partial counts combine before the shuffle."""
    c = grades.select(key, ruling_class(F.col(grade), True).alias("c"), chain_only(F.col(grade), True).alias("chain"))
    bad = F.col("c").isin("weak", "fabricated", "baseless")
    out = c.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("c") == "authentic").alias("accept"), F.count_if(bad).alias("against"), F.count_if(bad & ~F.col("chain")).alias("reject"))
    return out.withColumn("verdict", rulings_verdict(F.col("n"), F.col("accept"), F.col("against"), F.col("reject")))


def grade_verdict(rows: DataFrame, key: str, grade_class: str) -> DataFrame:
    """key, verdict from the set of a record's classes: none or unknown ones need review, mixed ones are disputed."""
    c = F.col(grade_class)
    agg = rows.groupBy(key).agg(F.count(c).alias("n"), F.count_if(~F.coalesce(c.isin(*KNOWN_CLASSES), F.lit(True))).alias("odd"), F.bool_or(c == "authentic").alias("good"), F.bool_or(c != "authentic").alias("bad"))
    v = F.when((F.col("n") == 0) | (F.col("odd") > 0), "NEEDS_REVIEW").when(F.col("good") & F.col("bad"), "DISPUTED").when(F.col("good"), "VERIFIED").otherwise("NOT_AUTHENTIC")
    return agg.select(key, v.alias("verdict"))


def graded(classes: Column) -> Column:
    """Verdict from the array of a record's grade classes: none, a null or an unknown one needs review, mixed ones are disputed."""
    n = F.size(F.coalesce(classes, F.array().cast("array<string>")))
    good = F.exists(classes, lambda x: x == "authentic")
    bad = F.exists(classes, lambda x: x != "authentic")
    known = F.forall(classes, lambda x: F.coalesce(x.isin(*KNOWN_CLASSES), F.lit(False)))
    return F.when(n == 0, "NEEDS_REVIEW").when(~known, "NEEDS_REVIEW").when(good & bad, "DISPUTED").when(good, "VERIFIED").otherwise("NOT_AUTHENTIC")


def _answer(verdict, basis: str | None = None, closest: Column | None = None, notes: tuple[str, ...] = ()) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return F.struct(text(verdict).alias("verdict"), text(basis).alias("basis"), text(closest).alias("closest"), F.array(*map(F.lit, notes)).cast("array<string>").alias("notes"))


def _verse_rules(c: dict, exact: Column, th: Thresholds) -> Column:
    """A text that is marked as a verse."""
    record_near = F.coalesce(c["h_content"], F.lit(0.0)) >= th.hadith_match_min
    return (F.when(F.coalesce(c["v_coverage"], F.lit(0.0)) >= th.quran_altered_min,
                   F.when(exact, _answer("VERIFIED", "quran")).when(c["n_words"] < th.min_words_altered, _answer("NEEDS_REVIEW", "quran", None, ("too_short",))).otherwise(_answer("ALTERED", "quran")))
            .when(record_near, _answer("NO_ORIGIN", None, F.lit("hadith"), ("nearest_is_record", "no_verse_found")))
            .otherwise(_answer("NO_ORIGIN", None, F.when(c["v_content"] >= th.closest_min, "quran"), ("no_verse_found",))))


def _record_rules(c: dict, exact: Column, th: Thresholds) -> Column:
    """A text that is held against records."""
    content = F.coalesce(c["h_content"], F.lit(0.0))
    return (F.when(content < th.hadith_review_min, _answer("NO_ORIGIN", None, F.when(content >= th.closest_min, "hadith"), ("not_found",)))
            .when((content < th.hadith_match_min) | ~exact, _answer("NEEDS_REVIEW", "hadith", None, ("wording_differs",)))
            .when(c["h_verdict"].isin("DISPUTED", "NEEDS_REVIEW"), _answer(c["h_verdict"], "hadith", None, ("grades_open",))).otherwise(_answer(c["h_verdict"], "hadith")))


def _short_rules(c: dict, v_exact: Column, h_exact: Column, th: Thresholds) -> Column:
    """Unmarked text of one or two words; null where the policy has no say."""
    v_whole, h_whole, two = F.coalesce(c["v_whole"], F.lit(False)), F.coalesce(c["h_whole"], F.lit(False)), c["n_words"] == 2
    return (F.when(h_exact & h_whole, _record_rules(c, h_exact, th)).when(v_exact & v_whole & two, _answer("VERIFIED", "quran", None, ("whole_verse",)))
            .when(v_exact & (two | v_whole), _answer("NEEDS_REVIEW", "quran", None, ("short_phrase",))).when(h_exact & two, _answer("NEEDS_REVIEW", "hadith", None, ("short_phrase",)))
            .when(c["n_words"] == 1, _answer("NO_ORIGIN", None, None, ("one_word",))))


def decide(rows: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """rows with verdict, basis (corpus of the source that it rests on, or null), closest (corpus of the nearest text that is only shown) and notes (codes).

    Needs: level, hint, question, n_words, v_coverage, v_content, v_exact, v_whole, h_content, h_exact, h_whole, h_verdict; request and
    context_after if there are any; source_verified, or v_verified and h_verified, for the source gate. Null coverages mean no candidate. In order: requests that
    name no text, personal matters, marked texts, unmarked ones; then the gate, which only touches verdicts that rest on a source.
    """
    c = {k: F.col(k) for k in rows.columns}
    v_exact, h_exact = F.coalesce(c["v_exact"], F.lit(False)), F.coalesce(c["h_exact"], F.lit(False))
    long = c["n_words"] >= 3
    record = _record_rules(c, h_exact, th)
    nearest = F.when(F.coalesce(c["v_content"], F.lit(-1.0)) >= F.coalesce(c["h_content"], F.lit(-1.0)), F.when(c["v_content"] >= th.closest_min, "quran")).otherwise(F.when(c["h_content"] >= th.closest_min, "hadith"))
    nothing = _answer("NO_ORIGIN", None, nearest, ("not_found",))
    free = (F.when(v_exact & long, _answer("VERIFIED", "quran")).when(long & (c["h_content"] >= th.hadith_match_min), record).when(long & (c["v_coverage"] >= th.closest_min), _answer("NEEDS_REVIEW", "quran", None, ("resembles_verse",)))
            .when(c["level"] == "C", _answer("DISPUTED", None, None, ("open_question",))).when(~long, F.coalesce(_short_rules(c, v_exact, h_exact, th), nothing)).otherwise(nothing))
    after = F.rlike(normalize(c["context_after"], ARABIC), F.lit(RULING_AFTER)) if "context_after" in c else F.lit(False)
    personal = F.when(F.coalesce(after, F.lit(False)), _answer("REFER", None, None, ("personal", "ruling_after"))).otherwise(_answer("REFER", None, None, ("personal",)))
    pointed = c["request"] == "evidence_ref" if "request" in c else F.lit(False)
    out = (F.when(pointed, _answer("NO_ORIGIN", None, None, ("no_text_named",))).when((c["level"] == "D") & ~c["question"] & v_exact & (c["v_coverage"] == 1) & long, _answer("VERIFIED", "quran", None, ("verse_not_question",)))
           .when(c["level"] == "D", personal).when(c["hint"] == "quran", _verse_rules(c, v_exact, th))
           .when(c["hint"] == "hadith", F.when(v_exact & long, _answer("VERIFIED", "quran", None, ("wrong_attribution",))).otherwise(record)).otherwise(free))
    rows = rows.withColumn("_answer", out)
    a = F.col("_answer")
    if th.require_verified:
        verified = c["source_verified"] if "source_verified" in c else F.when(a["basis"] == "quran", c["v_verified"]).otherwise(c["h_verified"])
        held = a["basis"].isNotNull() & ~F.coalesce(verified, F.lit(True))
        rows = rows.withColumn("_answer", F.when(held, F.struct(F.lit("NEEDS_REVIEW").alias("verdict"), a["basis"].alias("basis"), a["closest"].alias("closest"), F.concat(a["notes"], F.array(F.lit("source_unreviewed"))).alias("notes"))).otherwise(a))
    return rows.select("*", "_answer.*").drop("_answer")


def judge(rows: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """rows with `verdict` alone, from the columns of decide; v_content may be missing, as only the nearest text hangs on it."""
    content = {} if "v_content" in rows.columns else {"v_content": F.col("v_coverage")}
    return decide(rows.withColumns(content) if content else rows, th).select(*rows.columns, "verdict")


def apply_request(rows: DataFrame) -> DataFrame:
    """What a request makes of verdict, basis, closest and notes: a general question is out of scope where nothing is found; evidence is given only if it is on record."""
    c = F.col
    question = (c("request") == "question") & (c("verdict") == "NO_ORIGIN")
    evidence = c("request") == "evidence"
    found = c("verdict").isin(*FOUND)
    note = lambda x: F.array(F.lit(x))
    return rows.withColumns({
        "verdict": F.when(question, "OUT_OF_SCOPE").when(evidence & ~found, "NO_ORIGIN").otherwise(c("verdict")), "closest": F.when(question, None).when(evidence & ~found, F.coalesce("basis", "closest")).otherwise(c("closest")),
        "basis": F.when(question | evidence & ~found, None).otherwise(c("basis")),
        "notes": F.when(question, note("general_question")).when(evidence & found, F.concat(note("found_on_request"), "notes")).when(evidence, note("nothing_made_up")).otherwise(c("notes"))})


def others(count: Column) -> Column:
    """How further places are counted in words; empty for none."""
    return F.when(count <= 0, "").when(count == 1, "، وفي موضع آخر").when(count == 2, "، وفي موضعين آخرين").when(count <= 10, F.format_string("، وفي %d مواضع أخرى", count)).otherwise(F.format_string("، وفي %d موضعاً آخر", count))


def zero_filled(counts: DataFrame, code: str = "verdict") -> DataFrame:
    """verdict, n for all codes, 0 where there is none."""
    codes = counts.sparkSession.createDataFrame([(v,) for v in VERDICTS], f"{code} string")
    return codes.join(counts.groupBy(code).agg(F.count("*").alias("n")), code, "left").select(code, F.coalesce("n", F.lit(0)).alias("n"))
