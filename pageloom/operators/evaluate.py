"""Extraction accuracy: precision, recall and F1 over sets of words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    sorted(
        "all and are been boy but can day did down for from get had has have her him his how into its may more new not now old one only our out see some such than that the them then they this two was were what when who will with you your".split()
    )
)
#: Bands of F1 by their lowest value, the best first.
TIERS = ((0.95, "excellent"), (0.85, "good"), (0.70, "fair"))


def tokens(text: Column) -> Column:
    """The set of words of over two characters that aren't stop words."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s]", " ")
    return F.array_distinct(F.filter(F.split(flat, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def f1(extracted: Column, truth: Column) -> Column:
    """struct(precision, recall, f1_score, extracted_words, ground_truth_words, common_words) of two token sets."""
    e, g, c = (F.size(x).cast("double") for x in (extracted, truth, F.array_intersect(extracted, truth)))
    p, r = F.when(e > 0, c / e).otherwise(F.lit(0.0)), F.when(g > 0, c / g).otherwise(F.lit(0.0))
    score = F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), score.alias("f1_score"), e.cast("long").alias("extracted_words"), g.cast("long").alias("ground_truth_words"), c.cast("long").alias("common_words"))


def evaluate(df: DataFrame, extracted: str, truth: str) -> DataFrame:
    """``df`` with the six figures; token sets are computed once a row."""
    sets = df.withColumns({"_e": tokens(F.col(extracted)), "_g": tokens(F.col(truth))})
    return sets.withColumn("_f", f1(F.col("_e"), F.col("_g"))).select(*df.columns, "_f.*")


def tier(score: Column) -> Column:
    out = F.when(score > TIERS[0][0], TIERS[0][1])
    for least, name in TIERS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("poor")


def summary(scores: DataFrame) -> DataFrame:
    """Macro averages over all rows, with the number of them."""
    return scores.agg(F.count("*").alias("n"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"))


def tiers(scores: DataFrame) -> DataFrame:
    return scores.groupBy(tier(F.col("f1_score")).alias("tier")).agg(F.count("*").alias("n"))


def title_match(a: Column, b: Column) -> Column:
    plain = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"[^\w\s]", "")
    return plain(a) == plain(b)
