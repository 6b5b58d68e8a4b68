"""Verdicts from the records of a live lookup: rulings of all records that hold the text, shown with the shortest of them."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from provena.functions import text as T
from provena.operators import align, rules

#: Fixed value: rulings that are shown of a text.
MAX_GRADES = 12


def judge_live(claims: DataFrame, records: DataFrame, claim: str, profile: T.Profile = T.ARABIC, th: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """claim, verdict, pos (of the record shown), text, n_grades, accept, reject: a row for each claim that a record is close enough to.

    claims: claim, text. records: claim, pos (order of the results), text, muhaddith, source, ref, grade. Rulings of records that hold the whole claim count, the first
    of each scholar, source and place, MAX_GRADES at most; the shortest such record is shown. Else the nearest record needs review.
    """
    c = F.col
    met = records.withColumnRenamed("text", "record").join(claims.select(claim, "text"), claim)
    al = align.align_pairs(met, "text", "record", profile, stemmed=False, keep_negation=True, leading_conjunction=True)
    al = al.withColumn("holds", c("al.exact") & (c("al.claim_coverage") == 1))
    own = W.partitionBy(claim, "muhaddith", "source", "ref").orderBy("pos")
    each = al.where("holds").withColumn("_n", F.row_number().over(own)).where("_n = 1").withColumn("_m", F.row_number().over(W.partitionBy(claim).orderBy("pos"))).where(c("_m") <= MAX_GRADES)
    kind = rules.ruling_class(c("grade"), True)
    bad = c("_class").isin("weak", "fabricated", "baseless")
    told = each.withColumn("_class", kind).withColumn("_chain", rules.chain_only(c("grade"), True)).groupBy(claim).agg(
        F.count("*").alias("n_grades"), F.count_if(c("_class") == "authentic").alias("accept"), F.count_if(bad).alias("against"), F.count_if(bad & ~c("_chain")).alias("reject"))
    shown = al.where("holds").groupBy(claim).agg(F.min(F.struct(F.length("record").alias("n"), "pos", "record")).alias("s"))
    whole = told.join(shown, claim).select(claim, rules.rulings_verdict(c("n_grades"), c("accept"), c("against"), c("reject")).alias("verdict"), c("s.pos").alias("pos"), c("s.record").alias("text"), "n_grades", "accept", "reject")
    best = F.max(F.struct(F.round("al.content_coverage", 3).alias("a"), c("al.claim_coverage").alias("b"), (-c("pos")).alias("p"), "record", c("al.content_coverage").alias("content"))).alias("s")
    near = al.join(shown.select(claim), claim, "left_anti").groupBy(claim).agg(best).where(c("s.content") >= th.hadith_review_min)
    near = near.select(claim, F.lit("NEEDS_REVIEW").alias("verdict"), (-c("s.p")).cast("int").alias("pos"), c("s.record").alias("text"), F.lit(1).cast("long").alias("n_grades"), F.lit(0).cast("long").alias("accept"), F.lit(0).cast("long").alias("reject"))
    return whole.withColumn("pos", c("pos").cast("int")).unionByName(near)
