"""Captured lookups to records, and the checks that records and their evidence must pass: reject tables instead of exceptions."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from provena.functions import text as T
from provena.sources.readers import plain_text

# Labels of a result, the pattern of a result block, rulings of the closed vocabulary by their key.
LABELS = {"الراوي": "narrator", "المحدث": "muhaddith", "المصدر": "source", "الصفحة أو الرقم": "ref", "خلاصة حكم المحدث": "grade"}
BLOCK = r'(?s)<div class="hadith"[^>]*>(.*?)</div>\s*<div class="hadith-info">(.*?)</div>'
RULINGS = {"صحيح": "authentic", "حسن": "authentic", "حسن صحيح": "authentic", "صحيح لغيره": "authentic", "حسن لغيره": "authentic", "ضعيف": "weak", "ضعيف جدا": "very_weak", "منكر": "very_weak", "موضوع": "fabricated",
           "باطل": "fabricated", "كذب": "fabricated", "لا أصل له": "baseless", "إسناده حسن": "authentic", "إسناده فيه ضعف": "weak", "منكر لا أصل له": "very_weak", "لا أصل له مرفوعا": "baseless", "لا يصح": "unverified", "لا يصح من جميع الوجوه": "unverified"}
_ANY_LABEL = "|".join(LABELS)


def label_values(info: Column) -> list[Column]:
    """The text after each label up to the next one or the end, blanks and bars trimmed; empty where a label is missing."""
    value = lambda label: F.regexp_extract(info, rf"(?s)(?:^|\s|\|){label}\s*:(.*?)(?=(?:\s|\|)(?:{_ANY_LABEL})\s*:|$)", 1)
    return [F.regexp_replace(value(label), r"^[ |]+|[ |]+$", "").alias(name) for label, name in LABELS.items()]


def result_records(captures: DataFrame, id_col: str, body: str) -> DataFrame:
    """id, pos, text, narrator, muhaddith, source, ref, grade: the records of a JSON response whose ahadith.result is an HTML fragment.

    Numbers before and stops after a text go; rows without text, grade or scholar go; a narrator that is '-' is empty. A body that isn't JSON, or has no
    result, gives no rows.
    """
    html = F.coalesce(F.get_json_object(body, "$.ahadith.result"), F.lit(""))
    part = lambda k: F.regexp_extract_all(html, F.lit(BLOCK), F.lit(k))
    blocks = captures.select(id_col, F.posexplode(F.arrays_zip(part(1).alias("text"), part(2).alias("info"))).alias("pos", "b"))
    plain = blocks.select(id_col, "pos", plain_text("b.text").alias("t"), plain_text("b.info").alias("info"))
    text = F.trim(F.regexp_replace(F.trim(F.regexp_replace("t", r"^\s*\d+\s*[-–.]\s*", "")), r"(\s*\.)+\s*$", ""))
    out = plain.select(id_col, "pos", text.alias("text"), *label_values(F.col("info")))
    out = out.where("text != '' and grade != '' and muhaddith != ''")
    bare = F.regexp_replace("narrator", r"^[\[\] ]+|[\[\] ]+$", "")
    return out.withColumn("narrator", F.when(bare == "-", "").otherwise(bare))


def strict_result(fragments: DataFrame, fragment: str) -> DataFrame:
    """fragments with original_text, the five labelled fields and error: null where exactly the five labels stand once each and nothing is empty."""
    df = fragments.withColumn("_plain", plain_text(fragment))
    found = F.regexp_extract_all("_plain", F.lit(rf"({_ANY_LABEL})\s*:"), F.lit(1))
    original = F.regexp_replace(F.regexp_replace(F.regexp_extract("_plain", rf"(?s)^(.*?)(?:{_ANY_LABEL})\s*:", 1), r"^\s*\d+\s*[-–.]\s*", ""), r"^[ |]+|[ |]+$", "")
    df = df.withColumn("_found", found).withColumn("original_text", original).withColumns(dict(zip(LABELS.values(), label_values(F.col("_plain")))))
    whole = (F.size("_found") == len(LABELS)) & (F.size(F.array_distinct("_found")) == len(LABELS))
    empty = F.exists(F.array(*[F.col(n) for n in LABELS.values()]), lambda x: x == "")
    return df.withColumn("error", F.when(~whole, "labels").when(F.col("original_text") == "", "no_text").when(empty, "empty_field")).drop("_plain", "_found")


def ruling_of(grade: Column) -> Column:
    """Class of a ruling in the closed vocabulary; null for one that isn't in it."""
    return F.create_map(*[F.lit(x) for pair in RULINGS.items() for x in pair])[T.text_key(grade)]


def grade_violations(records: DataFrame, id_col: str, grades: str) -> DataFrame:
    """id, grade_index, problem of an array of grades (muhaddith, source, ref, grade, class): missing, incomplete or classed otherwise than the closed vocabulary."""
    none = records.where(F.size(F.coalesce(F.col(grades), F.array())) == 0).select(id_col, F.lit(None).cast("int").alias("grade_index"), F.lit("no_grades").alias("problem"))
    each = records.select(id_col, F.posexplode(grades).alias("grade_index", "g"))
    blank = F.lit(False)
    for k in ("muhaddith", "source", "ref", "grade", "class"):
        blank = blank | (F.trim(F.coalesce(F.col(f"g.{k}"), F.lit(""))) == "")
    known = ruling_of(F.col("g.grade"))
    return none.unionByName(each.withColumn("problem", F.when(blank, "incomplete").when(known.isNull(), "unknown_ruling").when(known != F.col("g.class"), "other_class")).where("problem is not null").select(id_col, "grade_index", "problem"))


def evidence_violations(records: DataFrame, evidence: DataFrame, id_col: str, grades: str) -> DataFrame:
    """id, grade_index, problem: each grade needs one piece of evidence of its index, equal to it field by field, reviewed no earlier than it was captured.

    evidence: id, grade_index, muhaddith, source, ref, grade, reviewed_at, retrieved_at.
    """
    each = records.select(id_col, F.posexplode(grades).alias("grade_index", "g"))
    per = evidence.groupBy(id_col, "grade_index").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("muhaddith", "source", "ref", "grade", "reviewed_at", "retrieved_at")])
    j = each.join(per, [id_col, "grade_index"], "full_outer")
    differs = F.lit(False)
    for k in ("muhaddith", "source", "ref", "grade"):
        differs = differs | ~T.squeeze(F.col(f"g.{k}")).eqNullSafe(T.squeeze(F.col(k)))
    problem = F.when(F.col("n").isNull(), "no_evidence").when(F.col("g").isNull(), "no_grade").when(F.col("n") > 1, "repeated").when(differs, "differs").when(~F.coalesce(reviewed_after(F.col("reviewed_at"), F.col("retrieved_at")), F.lit(False)), "reviewed_too_early")
    return j.withColumn("problem", problem).where("problem is not null").select(id_col, "grade_index", "problem")


def iso_date(c: Column) -> Column:
    """The date of an ISO date or time stamp, null if it is none."""
    return F.try_to_date(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1), "yyyy-MM-dd")


def reviewed_after(reviewed: Column, retrieved: Column) -> Column:
    return iso_date(reviewed) >= iso_date(retrieved)


def has_zone(c: Column) -> Column:
    """Whether an ISO time stamp names its offset."""
    return F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"))


def quotation_of(text: Column, source: Column) -> Column:
    """Whether a text is a continuous part of its source, word for word; a joined one-letter conjunction may stand before it."""
    needle, hay = F.concat(T.text_key(text), F.lit(" ")), F.concat(F.lit(" "), T.text_key(source), F.lit(" "))
    return F.contains(hay, F.concat(F.lit(" "), needle)) | F.contains(hay, F.concat(F.lit(" و"), needle)) | F.contains(hay, F.concat(F.lit(" ف"), needle))


def seed_violations(records: DataFrame, id_col: str = "id", legacy: tuple[str, ...] = (), endpoint: str = "https://") -> DataFrame:
    """id, problem of seed records (id, text, verified, method, endpoint, query, retrieved_at, reviewed_at, source_text, n_evidence): one row for each rule that a record breaks."""
    c = F.col
    blank = lambda x: F.trim(F.coalesce(c(x), F.lit(""))) == ""
    old, told = c(id_col).cast("string").isin(*legacy) if legacy else F.lit(False), c("method") == "assisted_api_transcript"
    told = F.coalesce(told, F.lit(False)) & ~old
    missing = F.lit(False)
    for k in ("endpoint", "query", "retrieved_at", "reviewed_at"):
        missing = missing | blank(k)
    rules = [("no_id", blank(id_col) if dict(records.dtypes)[id_col] == "string" else c(id_col).isNull()), ("no_text", blank("text")), ("not_reviewed", ~F.coalesce(c("verified"), F.lit(False))), ("provenance", told & missing),
             ("endpoint", told & ~F.coalesce(F.startswith("endpoint", F.lit(endpoint)), F.lit(False))), ("dates", told & (iso_date(c("retrieved_at")).isNull() | iso_date(c("reviewed_at")).isNull())),
             ("not_quoted", told & ~F.coalesce(quotation_of(c("text"), c("source_text")), F.lit(False))), ("no_evidence", ~old & ~told & (F.coalesce(c("n_evidence"), F.lit(0)) == 0))]
    own = records.select(F.col(id_col), F.explode(F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules]), lambda x: x.isNotNull())).alias("problem"))
    twice = records.groupBy(id_col).count().where("count > 1").select(id_col, F.lit("duplicate_id").alias("problem"))
    return own.unionByName(twice)


def strings(raw: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """raw with path and value of every string at any depth of a JSON text; with key only below it. Text that is no JSON gives no rows."""
    def walk(x, path, inside):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, f"{path}.{k}", inside or k == key)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]", inside)
        elif isinstance(x, str) and inside:
            yield {"path": path, "value": x}

    def one(text):
        try:
            return list(walk(json.loads(text), "$", key is None))
        except (TypeError, ValueError):
            return []

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return raw.select("*", F.explode(find(column)).alias("_s")).select(*raw.columns, "_s.path", "_s.value")


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks; null for what is no JSON."""
    def one(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def gated(df: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """df if it has exactly so many rows and as many different keys; else ValueError. Two counts, no data to the driver."""
    n, distinct = df.agg(F.count("*"), F.count_distinct(*keys)).first()
    if (n, distinct) != (rows, rows):
        raise ValueError(f"{n} rows and {distinct} keys where {rows} are due")
    return df


def sensitive_name(path: Column) -> Column:
    """Whether a file's name speaks of secrets or local state."""
    return F.rlike(F.lower(path), F.lit(r"(^|/)(\.env(\..*)?|id_rsa.*|.*\.(pem|key|p12|pfx)|credentials.*|secrets?(\..*)?)$"))
