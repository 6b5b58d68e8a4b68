"""What is shown of a verdict: source, explanation, outcome, differences in words, labels, the response as one JSON object."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Order and looks of verdicts, looks of grades, words that grades are shown with as they are.
VERDICT_ORDER = ("VERIFIED", "NOT_AUTHENTIC", "ALTERED", "NO_ORIGIN", "DISPUTED", "IN_SOURCE", "REFER", "NEEDS_REVIEW", "OUT_OF_SCOPE")
TONES = ("verified", "weak", "altered", "noorigin", "disputed", "review", "refer", "review", "refer")
GRADE_TONES = {"sahih": "verified", "hasan": "hasan", "weak": "weak", "fabricated": "fabricated", "baseless": "fabricated", "unverified": "weak"}
SOUND = "صحيح"


def verse_place(name: Column, first: Column, last: Column) -> Column:
    """`name n` or `name n-m`; empty without a name."""
    return F.when(name.isNull(), "").when(last.isNull(), F.concat_ws(" ", name, first.cast("string"))).otherwise(F.concat(name, F.lit(" "), first.cast("string"), F.lit("–"), last.cast("string")))


def source_url(url: Column, kind: Column, template: str, **parts: Column) -> Column:
    """A source's own URL, else for a verse the template with its {parts} filled in, else empty."""
    made = F.lit(template)
    for name, value in parts.items():
        made = F.replace(made, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.coalesce(url, F.lit("")) != "", url).when(kind == "quran", made).otherwise("")


def grade_kind(classes: Column, grades: Column) -> Column:
    """The strongest class of a record's grades: sahih or hasan if all are authentic, else the worst there is; null without grades."""
    has = lambda *names: F.exists(classes, lambda x: x.isin(*names))
    only = F.forall(classes, lambda x: x == "authentic")
    return (F.when(F.size(classes) == 0, None).when(only, F.when(F.exists(grades, lambda g: F.contains(g, F.lit(SOUND))), "sahih").otherwise("hasan"))
            .when(has("fabricated"), "fabricated").when(has("baseless"), "baseless").when(has("weak", "very_weak"), "weak").otherwise("unverified"))


def tone(verdict: Column, kind: Column) -> Column:
    """Look of a verdict; that of the grade for records that are verified or not authentic."""
    plain = F.create_map(*[F.lit(x) for pair in zip(VERDICT_ORDER, TONES) for x in pair])[verdict]
    graded = F.create_map(*[F.lit(x) for pair in GRADE_TONES.items() for x in pair])[kind]
    return F.when(verdict.isin("VERIFIED", "NOT_AUTHENTIC"), F.coalesce(graded, plain)).otherwise(plain)


def verdict_rank(verdict: Column) -> Column:
    """Place of a verdict in the order of display, from 1."""
    return F.array_position(F.array(*map(F.lit, VERDICT_ORDER)), verdict)


def grade_line(grades: Column, most: int = 2) -> Column:
    """The first grades: `grade — scholar، source (place)`, joined."""
    line = lambda g: F.concat(g["grade"], F.lit(" — "), g["muhaddith"], F.lit("، "), g["source"], F.when(F.coalesce(g["ref"], F.lit("")) != "", F.concat(F.lit(" ("), g["ref"], F.lit(")"))).otherwise(""))
    return F.array_join(F.transform(F.slice(grades, 1, most), line), "؛ ")


def difference(diff: Column, kind: Column, most: int = 4) -> Column:
    """The first differences of a text in words; empty where there are none."""
    verse = kind == "quran"
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])
    one = lambda o: (F.when((o["op"] == "changed") & verse, said("في «", o["claim"], "»، والصحيح «", o["source"], "»")).when(o["op"] == "changed", said("في «", o["claim"], "»، ولفظ المصدر «", o["source"], "»"))
                     .when(o["op"] == "added", said("بزيادة «", o["claim"], "»")).when(o["op"] == "missing", said("بنقص «", o["source"], "»")))
    return F.array_join(F.slice(F.filter(F.transform(diff, one), lambda x: x.isNotNull()), 1, most), "، و")


def explanation(verdict: Column, kind: Column, place: Column, grades: Column) -> Column:
    """kind of explanation that a verdict gets: match, grades, differs, referral, nothing; null for others."""
    graded = verdict.isin("VERIFIED", "NOT_AUTHENTIC", "DISPUTED", "IN_SOURCE") & (F.size(F.coalesce(grades, F.array().cast("array<string>"))) > 0)
    return (F.when((verdict == "VERIFIED") & (kind == "quran"), F.concat(F.lit("match:"), place)).when(graded, F.concat(F.lit("grades:"), F.array_join(grades, "؛ ")))
            .when((verdict == "ALTERED") & kind.isNotNull(), F.concat(F.lit("differs:"), place)).when(verdict == "REFER", "referral").when(verdict == "NO_ORIGIN", "nothing"))


def shown_notes(notes: Column, hidden: tuple[str, ...]) -> Column:
    """Notes that a card shows: those that don't start like one of the hidden ones."""
    return F.filter(notes, lambda n: ~F.reduce(F.array(*map(F.lit, hidden)), F.lit(False), lambda s, h: s | F.startswith(n, h)))


def response(judged: DataFrame, post: str, order: str, columns: list[str]) -> DataFrame:
    """post, json: the claims of a post in order, and the number of each verdict, zeros included."""
    claim = F.struct(F.col(order).alias("_o"), F.to_json(F.struct(*columns)).alias("j"))
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICT_ORDER]
    out = judged.groupBy(post).agg(F.array_sort(F.collect_list(claim)).alias("c"), *counts)
    summary = F.concat_ws(",", *[F.concat(F.lit(f'"{v}":'), F.col(v).cast("string")) for v in VERDICT_ORDER])
    return out.select(post, F.concat(F.lit('{"claims":['), F.array_join(F.transform("c", lambda x: x["j"]), ","), F.lit('],"summary":{'), summary, F.lit("}}")).alias("json"))
