"""Data-quality screening and gold derivation (rephrasing set and two-source ratings)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairjudge.functions import text as T


def add_broken_flags(df: DataFrame, original: str, rewrite: str) -> DataFrame:
    return df.withColumn("broken_row_reason", T.broken_reasons(original, rewrite)) \
             .withColumn("broken_row_flag", F.col("broken_row_reason") != "")


def add_gold_increment(df: DataFrame, raw: str) -> DataFrame:
    return df.withColumn("increment_score", T.increment_score(raw)) \
             .withColumn("gold", T.gold_from_increment(raw))


def eligible(df: DataFrame, drop_broken: bool = True) -> DataFrame:
    """Gold-positive rows (increment >= 4), without broken rows unless disabled.

    The screening columns are constant on the kept rows and are dropped: the optimizer inlines
    the (text-heavy) flag expression into the filter, and not projecting it again afterwards
    keeps the screening to a single evaluation per row."""
    cond = F.col("gold") == 1
    if drop_broken:
        cond = cond & ~F.col("broken_row_flag")
        return df.where(cond).drop("broken_row_flag", "broken_row_reason")
    return df.where(cond)


def screen_report(df: DataFrame, drop_broken: bool = True) -> DataFrame:
    """Funnel counts in one aggregation: all, unparseable increment, gold-positive, broken among
    gold-positive, used."""
    pos = F.col("gold") == 1
    used = pos & ~F.col("broken_row_flag") if drop_broken else pos
    return df.agg(F.count(F.lit(1)).alias("rows_all"),
                  F.count_if(F.col("gold").isNull()).alias("rejected"),
                  F.count_if(pos).alias("gold_positive"),
                  F.count_if(pos & F.col("broken_row_flag")).alias("broken"),
                  F.count_if(used).alias("used"))


def average_scores(ratings: DataFrame, target: str = "ChatGPT", other: str = "Physician") -> DataFrame:
    """Long ratings -> one row per (item, dimension): both source averages (non-numeric scores
    skipped), absolute difference and the gold source ('Tie' when equal or a mean is missing)."""
    s = F.col("score_raw").try_cast("double")
    s = F.when(F.isnan(s), F.lit(None).cast("double")).otherwise(s)
    g = ratings.groupBy("item_id", "dimension").agg(
        F.avg(F.when(F.col("source") == other, s)).alias("physician_avg"),
        F.avg(F.when(F.col("source") == target, s)).alias("chatgpt_avg"))
    c, p = F.col("chatgpt_avg"), F.col("physician_avg")
    return g.select("item_id", "dimension", "physician_avg", "chatgpt_avg",
                    F.abs(c - p).alias("diff_abs"),
                    F.when(c > p, F.lit(target)).when(p > c, F.lit(other)).otherwise(F.lit("Tie")).alias("gold_source"),
                    (c.isNull() | p.isNull()).alias("missing_avg"))


def ratings_report(gold: DataFrame, keys: list[str] | None = None, margin: float = 1.0) -> DataFrame:
    """Funnel of the two-source ratings in one aggregation: all, missing means, ties, used, and of those
    with a mean difference of ``margin`` or more."""
    tie = F.col("gold_source") == "Tie"
    return gold.groupBy(*(keys or ["dimension"])).agg(
        F.count(F.lit(1)).alias("rows_all"), F.count_if("missing_avg").alias("missing"), F.count_if(tie).alias("ties"),
        F.count_if(~tie).alias("used"), F.count_if(~tie & (F.col("diff_abs") >= margin)).alias("clear_margin"))
