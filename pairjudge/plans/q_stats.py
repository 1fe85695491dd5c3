"""Registered queries: intervals, agreement, significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairjudge.operators import agreement as AG
from pairjudge.plans.common import OUTCOME_CTES, outcomes
from pairjudge.plans.oracle_fx import with_fx
from pairjudge.plans.registry import register
from pairjudge.sources import tables as S

def wilson_sql(k: str, n: str = "n") -> tuple[str, str]:
    """DuckDB form of the Wilson interval (z = 1.96) over count columns ``k`` and ``n``."""
    z2 = "(CAST(1.96 AS DOUBLE) * CAST(1.96 AS DOUBLE))"
    p = f"(CAST({k} AS DOUBLE) / {n})"
    d = f"(1 + {z2} / {n})"
    c = f"(({p} + {z2} / (2 * {n})) / {d})"
    h = f"(CAST(1.96 AS DOUBLE) * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})) / {d})"
    return f"CASE WHEN {n} > 0 THEN {c} - {h} END", f"CASE WHEN {n} > 0 THEN {c} + {h} END"


def _fp_raters(spark, sf):
    r = S.fx_raters(spark, sf)
    return r.withColumn("fp", ((F.col("preserved") == 1) & (F.col("unsupported") == 0)).cast("int"))


_lo, _hi = wilson_sql("fp")


@register("category_pass", with_fx(f"""
SELECT category, fp, n, CAST(fp AS DOUBLE) / n AS rate, {_lo} AS ci_low, {_hi} AS ci_high
FROM (SELECT category, CAST(sum(CASE WHEN preserved = 1 AND unsupported = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             count(*) AS n FROM fx_raters GROUP BY category)""", "fx_raters"))
def category_pass(spark, sf):
    """Factual pass (preserved and no unsupported addition) per category with a Wilson interval."""
    return AG.wilson_table(_fp_raters(spark, sf), "fp", ["category"], k_name="fp")


@register("wilson_ci", with_fx(f"""
SELECT judge, fp, n, CAST(fp AS DOUBLE) / n AS rate, {_lo} AS ci_low, {_hi} AS ci_high
FROM (SELECT judge, CAST(sum(fp) AS BIGINT) AS fp, count(*) AS n FROM ox_outcomes GROUP BY judge)""",
      "fx_pairs", "fx_verdicts", extra=OUTCOME_CTES))
def wilson_ci(spark, sf):
    """Wilson interval of the factual-pass rate per judge over all edited items."""
    return AG.wilson_table(outcomes(spark, sf), "fp", ["judge"], k_name="fp")
