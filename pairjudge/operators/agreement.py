"""Paired-rater statistics: 2x2 cells, McNemar, Cohen's kappa, Wilson, length statistics.

Every statistic is computed from a handful of counts per group: one aggregation (map-side partial,
then a tiny shuffle) per report, closed-form columns afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairjudge.functions import stats as ST
from pairjudge.operators.assign import join_null_safe


def cells(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """n11, n10, n01, n00, n and the two positive totals of binary raters ``a`` and ``b``."""
    ca, cb = F.col(a), F.col(b)
    return df.groupBy(*keys).agg(
        F.count_if((ca == 1) & (cb == 1)).alias("n11"), F.count_if((ca == 1) & (cb == 0)).alias("n10"),
        F.count_if((ca == 0) & (cb == 1)).alias("n01"), F.count_if((ca == 0) & (cb == 0)).alias("n00"),
        F.count(F.lit(1)).alias("n"),
        F.sum(ca).cast("bigint").alias("sum_a"), F.sum(cb).cast("bigint").alias("sum_b"))


def mcnemar(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    c = cells(df, a, b, keys)
    return c.select(*keys, "n", "sum_a", "sum_b", "n10", "n01",
                    ST.mcnemar_statistic("n10", "n01").alias("statistic"),
                    ST.mcnemar_p("n10", "n01").alias("p"))


def kappa_from_cell_frame(c: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n").cast("double")
    rate_a, rate_b = F.col("sum_a") / n, F.col("sum_b") / n
    k = ST.kappa_from_cells("n11", "n10", "n01", "n00")
    return c.select(
        *keys, "n", ((F.col("n11") + F.col("n00")) / n).alias("pct_agree"), k.alias("kappa"),
        F.when(ST.degenerate(rate_a, rate_b), F.lit("degenerate: base rate ~constant"))
         .otherwise(ST.kappa_strength(k)).alias("strength"),
        ST.degenerate(rate_a, rate_b).alias("degenerate"))


def cohen_kappa(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    return kappa_from_cell_frame(cells(df, a, b, keys), keys)


def cohen_kappa_labels(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Kappa for any label set, from the sparse contingency table: one row per (a, b) that occurs, its two margins
    aggregated and joined by label, so no group is gathered in one row, however many labels it has."""
    label = [F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")]
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, *label).agg(F.count(F.lit(1)).alias("c"))
    whole = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("c")).otherwise(0)).alias("agree"))
    of_a = cells.groupBy(*keys, F.col("_a").alias("_label")).agg(F.sum("c").alias("_ra"))
    of_b = cells.groupBy(*keys, F.col("_b").alias("_label")).agg(F.sum("c").alias("_rb"))
    both = join_null_safe(of_a, of_b, [*keys, "_label"])  # a label that only one rater gives adds nothing
    chance = both.groupBy(*keys).agg(F.sum(F.col("_ra").cast("double") * F.col("_rb")).alias("_both"))
    n = F.col("n").cast("double")
    x = join_null_safe(whole, chance, keys, "left") if keys else whole.crossJoin(chance)  # a row each
    x = x.withColumn("pe", F.coalesce("_both", F.lit(0.0)) / n / n)
    po = F.col("agree") / n
    k = (po - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))
    return x.select(*keys, "n", po.alias("pct_agree"), k.alias("kappa"), ST.kappa_strength(k).alias("strength"))


def wilson_table(df: DataFrame, flag: str, keys: list[str], k_name: str = "k") -> DataFrame:
    g = df.groupBy(*keys).agg(F.sum(F.col(flag)).cast("bigint").alias(k_name),
                              F.count(F.lit(1)).alias("n"))
    return g.select(*keys, k_name, "n", (F.col(k_name) / F.col("n").cast("double")).alias("rate"),
                    ST.wilson_low(k_name, "n").alias("ci_low"), ST.wilson_high(k_name, "n").alias("ci_high"))
