"""Text scalars as Column expressions: normal forms, tokens, stems, n-grams. A Profile holds what depends on the language."""
from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Letters, words and prefixes of the Arabic profile.
MARKS = r"[ؐ-ًؚ-ٰٟۖ-ۭـ]"
ALEFS, PLAIN_ALEF = "أإآٱ", "ا"
FOLD_FROM, FOLD_TO = "أإآٱىةؤئ", "اااايهوي"
WORDING_FROM, WORDING_TO = "أإآٱىة", "اااايه"
DIVINE_NAME = "الله"
DIVINE_FORMS = ("الله", "لله", "بالله", "والله", "تالله", "فالله", "اللهم")
CONJUNCTIONS = ("و", "ف")
ARTICLES = ("بال", "كال", "لل", "ال")
NEGATIONS = ("لا", "لم", "لن", "ما", "ليس", "ليست", "لست", "لسنا", "ليسوا", "لستم", "لستن", "لسن")
STOP_WORDS = ("من", "في", "علي", "الي", "عن", "ما", "لا", "ان", "انما", "او", "ثم", "قد", "هو", "هي", "كل", "لم", "لن", "لو", "ولو", "مع", "حتي", "الا", "اذا", "اذ", "يا",
              "ذلك", "هذا", "هذه", "التي", "الذي", "الذين", "تي", "ذي", "ذين", "له", "لها", "لهم", "به", "بها", "فيه", "فيها", "منه", "كان", "قال")
SPELLINGS = {"الزنا": "الزني", "حسرتا": "حسرتي", "ويلتا": "ويلتي"}
JOINED_WORD, SPLIT_WORD = "بعدما", "بعد ما"

VARIANTS = ("آأإٱةىیک", "ااااهييك")
INVISIBLE = "[\ufeff\u200b-\u200f\u2060\u00ad]"

#: What is not a word: anything but letters, letter and other numbers, and white space.
NOT_WORD = r"[^\p{L}\p{Nl}\p{No}\s]"


@dataclass(frozen=True)
class Profile:
    """What a language adds to the common steps. lower: fold case; marks: pattern of marks to drop; fold: letters to translate."""
    name: str
    lower: bool = False
    marks: str | None = None
    fold: tuple[str, str] = ("", "")
    wording: tuple[str, str] = ("", "")
    stem: bool = False
    negations: frozenset = field(default_factory=frozenset)
    stop_words: frozenset = field(default_factory=frozenset)


LATIN = Profile("latin", lower=True)
ARABIC = Profile("arabic", marks=MARKS, fold=(FOLD_FROM, FOLD_TO), wording=(WORDING_FROM, WORDING_TO), stem=True,
                 negations=frozenset(NEGATIONS) | {c + n for c in CONJUNCTIONS for n in NEGATIONS}, stop_words=frozenset(STOP_WORDS))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def strip_marks(text: Column, profile: Profile = LATIN, compose: bool = False) -> Column:
    """Without the profile's marks; the joined word is split. compose: bring decomposed input into composed form first (a pandas UDF)."""
    if compose:
        text = nfc(text)
    if profile.marks:
        text = F.regexp_replace(text, profile.marks, "")
        text = F.regexp_replace(text, rf"(?<!\S)([{''.join(CONJUNCTIONS)}]?){JOINED_WORD}(?!\S)", f"$1{SPLIT_WORD}")
    return text


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize(text: Column, profile: Profile = LATIN, compose: bool = False) -> Column:
    """Marks dropped, letters folded, punctuation and digits to spaces, white space squeezed."""
    text = strip_marks(text, profile, compose)
    if profile.lower:
        text = F.lower(text)
    if profile.fold[0]:
        text = F.translate(text, *profile.fold)
    return squeeze(F.regexp_replace(text, NOT_WORD, " "))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def display_tokens(text: Column, profile: Profile = LATIN, compose: bool = False) -> Column:
    return split_words(F.regexp_replace(strip_marks(text, profile, compose), NOT_WORD, " "))


def light_stem(word: Column) -> Column:
    """One leading conjunction of words of 4 letters or more, then one article that leaves 2 letters; divine-name forms become one word."""
    bare = F.when((F.length(word) >= 4) & word.substr(1, 1).isin(*CONJUNCTIONS), F.substring(word, 2, 1 << 20)).otherwise(word)
    out = bare
    for article in reversed(ARTICLES):
        out = F.when(F.startswith(bare, F.lit(article)) & (F.length(bare) >= len(article) + 2), F.substring(bare, len(article) + 1, 1 << 20)).otherwise(out)
    return F.when(word.isin(*DIVINE_FORMS) | bare.isin(*DIVINE_FORMS) & (bare != word), F.lit(DIVINE_NAME)).otherwise(out)


def _spelling(word: Column) -> Column:
    out = word
    for a, b in SPELLINGS.items():
        out = F.when(word == a, F.lit(b)).otherwise(out)
    return out


def key_tokens(text: Column, profile: Profile = LATIN, compose: bool = False) -> Column:
    """Words for retrieval."""
    words = split_words(normalize(text, profile, compose))
    return F.transform(words, lambda w: light_stem(_spelling(w))) if profile.stem else words


def wording_tokens(text: Column, profile: Profile = LATIN, compose: bool = False) -> Column:
    """Words for judging a quotation's wording: particles and most letters stay."""
    words = display_tokens(text, profile, compose)
    if profile.wording[0]:
        words = F.transform(words, lambda w: _spelling(F.translate(w, *profile.wording)))
    return F.transform(words, F.lower) if profile.lower else words


def split_particles(words: Column, vocabulary: Column, prefixes=("لا", "ولا", "فلا", "يا")) -> Column:
    """Words with a joined particle are split where the joined form is unknown and the rest is known. vocabulary: array of words."""
    def parts(w: Column) -> Column:
        out = F.array(w)
        for p in prefixes:
            rest = F.substring(w, len(p) + 1, 1 << 20)
            out = F.when(F.startswith(w, F.lit(p)) & (F.length(rest) >= 2) & ~F.array_contains(vocabulary, w) & F.array_contains(vocabulary, rest), F.array(F.lit(p), rest)).otherwise(out)
        return out

    return F.flatten(F.transform(words, parts))


def split_joined(rows: DataFrame, words: str, vocabulary: DataFrame, prefixes=("لا", "ولا", "فلا", "يا")) -> DataFrame:
    """rows with the words of an array column split as by split_particles, the known words (column term) in a table of any size.

    Only words that begin with a particle are joined with the vocabulary; rows without such words keep theirs as they are.
    """
    known = vocabulary.select("term").distinct()
    df = rows.withColumn("_row", F.monotonically_increasing_id())
    cuts = [F.when(F.startswith("w", F.lit(p)) & (F.length("w") >= len(p) + 2), F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.substring("w", len(p) + 1, 1 << 20).alias("rest"))) for k, p in enumerate(prefixes)]
    each = df.select("_row", F.posexplode(words).alias("i", "w")).select("_row", "i", "w", F.explode(F.filter(F.array(*cuts), lambda c: c.isNotNull())).alias("c"))
    each = each.join(known.withColumnRenamed("term", "w"), "w", "left_anti").select("_row", "i", "c.*").join(known.withColumnRenamed("term", "rest"), "rest", "left_semi")
    best = each.groupBy("_row", "i").agg(F.max(F.struct("k", "p", "rest")).alias("b")).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("i", F.array("b.p", "b.rest").alias("v")))).alias("_m"))
    out = df.join(best, "_row", "left")
    split = F.flatten(F.transform(words, lambda w, i: F.coalesce(F.col("_m")[i], F.array(w))))
    return out.withColumn(words, F.when(F.col("_m").isNull(), F.col(words)).otherwise(split)).select(*rows.columns)


def contains_words(text: Column, needle: Column) -> Column:
    """Whether needle occurs in text as whole words; both single-spaced."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def contains_run(hay: Column, needle: Column) -> Column:
    """Whether array needle (not empty) is a contiguous run of array hay."""
    n = F.size(needle)
    starts = F.when(F.size(hay) >= n, F.sequence(F.lit(1), F.size(hay) - n + 1)).otherwise(F.array().cast("array<int>"))
    return (n > 0) & F.exists(starts, lambda i: F.slice(hay, i, n) == needle)


def letter_pairs(word: Column) -> Column:
    """The set of a word's letter pairs, or the word itself if it has one letter."""
    n = F.length(word)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(word, i, F.lit(2))))).otherwise(F.array(word))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def word_ngrams(words: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams within words padded by a space on either side, repeats included. A padded word of fewer characters than n gives none of that n, as it is given once by its own length."""
    def grams(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(p))), lambda n: F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, n))))

    return F.flatten(F.transform(words, grams))


def text_key(text: Column) -> Column:
    """Key of a quotation: marks and the stretching sign dropped, punctuation to spaces; letters and their order stay. White space is squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(text, r"[\p{M}ـ]", ""), r"\p{P}", " "))


def comparable(text: Column) -> Column:
    """Form in which two editions are compared: invisible signs and marks dropped, letter variants folded, Persian letters among them."""
    bare = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), MARKS, "")
    return squeeze(F.translate(bare, *VARIANTS))


def first_of_group(text: Column, group: Column, order: Column, opening: str, own: tuple[int, ...] = (1,)) -> Column:
    """text without an opening phrase that editions put before the first row of a group; groups in `own` have it as a row of theirs."""
    cut = (order == 1) & ~group.isin(*own) & F.startswith(text, F.lit(opening + " "))
    return F.when(cut, F.substring(text, len(opening) + 2, 1 << 20)).otherwise(text)


def quote_url(text: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def unit(vector: Column) -> Column:
    """L2-normalised array of doubles; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
