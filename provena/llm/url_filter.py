"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes, confirmed by full digests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from provena.llm.common import if_small

#: verdict, host, path
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What a URL gets that no rule fits.
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where it is null or has no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return host, path


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, short_bytes: int = 4) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict. rules: host, path, verdict.

    A rule fits its host and the host's subdomains where the URL's path starts with the rule's path. The longest
    host + path wins; of one host and path with both verdicts, block wins. A URL that none fits gets default
    (rule null), so do null, empty and malformed ones. Rules with a null or empty host or a null path fit nothing.
    Repeated rows and ids each get their answer; an empty table gives no rows. Other columns are ignored.

    Hosts are cut at the label counts and paths at the lengths that the rules have, so the number of expressions of a URL is bounded by
    the rules and not by its length. Equal URLs are judged once. Expressions meet rules on the first bytes of their
    SHA-256, then the whole digest decides. Rules, and the answers, are broadcast only if counted and small.
    """
    rules = rules.where("host != '' and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    listed = rules.select(F.col("verdict"), F.concat("host", "path").alias("rule"), digest(F.col("host"), F.col("path")).alias("full"))
    listed, _ = if_small(listed.withColumn("short", F.substring("full", 1, 2 * short_bytes)))
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    parts = F.split("host", r"\.")
    ends = F.filter(F.array(*[F.lit(n) for n in sorted(shape["labels"])]).cast("array<int>"), lambda n: n <= F.size(parts))
    cuts = F.filter(F.array(*[F.lit(n) for n in sorted(shape["lengths"])]).cast("array<int>"), lambda n: n <= F.length("path"))
    urls = rows.where("host != ''").select("host", "path").distinct()
    tried = urls.select("host", "path", F.explode(F.transform(ends, lambda n: F.array_join(F.slice(parts, -n, n), "."))).alias("_suffix"))
    tried = tried.select("host", "path", "_suffix", F.explode(F.transform(cuts, lambda n: F.substring("path", 1, n))).alias("_prefix"))
    tried = tried.select("host", "path", digest(F.col("_suffix"), F.col("_prefix")).alias("_full")).withColumn("short", F.substring("_full", 1, 2 * short_bytes))
    hits = tried.join(listed, "short").where("_full = full")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    out = rows.where("host != ''").join(best, ["host", "path"], "left")
    out = out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    none = rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))  # however many, they meet no rule and no join
    return out.unionByName(none)


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
