"""Sources and sinks: delimited text, nested dumps, schema-tolerant JSON, HTML records, request gates, saved indexes."""
from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

INVISIBLE = r"[​-‏‪-‮⁠﻿]"
#: Bytes of a request's body and characters of its text that are accepted.
MAX_BODY, MAX_TEXT = 32 * 1024, 8_000


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that the path's own file system has."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """grp, ord, text of lines `number|number|text`; other lines are skipped."""
    line = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", r"^(\d+)\|(\d+)\|(.+)$", i)
    return line.where(F.col("value").rlike(r"^\d+\|\d+\|.+$")).select(part(1).cast("int").alias("grp"), part(2).cast("int").alias("ord"), F.trim(part(3)).alias("text"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the `records` array of a JSON document; .gz is read as it is."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")


def nested_groups(df: DataFrame, groups: str, members: str, group_no: str, member_no: str, text: str) -> DataFrame:
    """grp, ord, text of a two-level dump, invisible characters removed."""
    g = df.select(F.explode(groups).alias("g")).select(F.col(f"g.{group_no}").cast("int").alias("grp"), F.explode(f"g.{members}").alias("m"))
    return g.select("grp", F.col(f"m.{member_no}").cast("int").alias("ord"), F.trim(F.regexp_replace(F.col(f"m.{text}"), INVISIBLE, "")).alias("text"))


def tolerant_records(raw: DataFrame, column: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Every object at any depth of a JSON text that has, for each field, one of its alias keys; the first present counts."""
    fields = list(aliases)

    def walk(x):
        if isinstance(x, dict):
            yield x
            for v in x.values():
                yield from walk(v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v)

    @F.pandas_udf(f"array<struct<{','.join(f'{f}:string' for f in fields)}>>")
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                top = json.loads(text)
            except (TypeError, ValueError):
                return []
            out = []
            for d in walk(top):
                got = {f: next((d[k] for k in aliases[f] if d.get(k) is not None and not isinstance(d[k], (dict, list))), None) for f in fields}
                if all(v is not None for v in got.values()):
                    out.append({f: str(v) for f, v in got.items()})
            return out

        return texts.map(one)

    return raw.select(F.posexplode(find(F.col(column))).alias("pos", "r")).select("pos", "r.*")


def with_links(docs: DataFrame, links: DataFrame, id_col: str, items: str, urls: str) -> DataFrame:
    """docs with each item of `items` given the URL at its place in `urls`; null beyond the end or without a row of links."""
    j = docs.join(links.select(id_col, urls), id_col, "left")
    return j.withColumn(items, F.transform(items, lambda g, i: F.struct(g.alias("item"), F.get(urls, i).alias("url")))).drop(urls)


def search_words(text: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def todo(candidates: DataFrame, captured: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` candidates that have not been captured, by key."""
    return candidates.join(captured.select(key).distinct(), key, "left_anti").orderBy(key).limit(limit)


def accepted(posts: DataFrame, text: str = "text") -> DataFrame:
    """posts with `gate`: accepted, too_short (under 2 characters trimmed), too_long (characters) or too_large (bytes)."""
    t = F.coalesce(F.trim(F.col(text)), F.lit(""))
    return posts.withColumn("gate", F.when(F.octet_length(F.coalesce(F.col(text), F.lit(""))) > MAX_BODY, "too_large").when(F.length(t) > MAX_TEXT, "too_long").when(F.length(t) < 2, "too_short").otherwise("accepted"))


@F.pandas_udf(StringType())
def plain_text(markup: pd.Series) -> pd.Series:
    """Text of HTML without scripts, styles, comments and tags; entities decoded, white space squeezed."""
    drop = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    return markup.map(lambda m: None if m is None else " ".join(html.unescape(drop.sub(" ", m)).split()))


def page_title(markup: Column) -> Column:
    return F.regexp_extract(markup, r"(?s)<title>(.*?)</title>", 1)


def link_rows(pages: DataFrame, id_col: str, markup: str) -> DataFrame:
    """id, href, label of the anchors of a page."""
    a = F.regexp_extract_all(F.col(markup), F.lit(r"<a href=\"([^\"]*)\">"), F.lit(1))
    b = F.regexp_extract_all(F.col(markup), F.lit(r"<a href=\"[^\"]*\">([^<]*)</a>"), F.lit(1))
    return pages.select(id_col, F.explode(F.arrays_zip(a.alias("href"), b.alias("label"))).alias("l")).select(id_col, "l.href", "l.label")


def capture(df: DataFrame, body: str, url: str) -> DataFrame:
    """df with the body's digest; check_capture tells whether a stored one still holds."""
    return df.withColumn("sha256", F.sha2(F.col(body), 256)).withColumn("valid_url", F.col(url).rlike(r"^https?://"))


def check_capture(df: DataFrame, body: str) -> DataFrame:
    return df.withColumn("intact", F.sha2(F.col(body), 256) == F.col("sha256"))


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below path; Spark's commit makes each appear whole or not at all."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
