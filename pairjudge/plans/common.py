"""Shared derived frames for the registered queries (Spark side) and their oracle CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairjudge.functions import text as T
from pairjudge.operators import assign, verdicts as V
from pairjudge.sources import tables as S

SEED = 42


def pairs_order(spark: SparkSession, sf: str) -> DataFrame:
    """fx_pairs with the balanced hash order (seed 42): generated answer is the target."""
    return assign.balanced_ab_hash(S.fx_pairs(spark, sf), SEED)


def long_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed verdicts joined to the order: item_id, category, judge, dimension, raw_response,
    verdict, gold_choice, sentence_a_source, sentence_b_source, pred_source."""
    v = V.parse_verdicts(S.fx_verdicts(spark, sf))
    return V.with_sources(v, pairs_order(spark, sf))


def outcomes(spark: SparkSession, sf: str, unanswered: str = "fail") -> DataFrame:
    """Per (judge, item): 0/1 outcomes plus category and word counts."""
    lv = long_verdicts(spark, sf).withColumn(
        "val", F.when(F.col("dimension").isin(*V.PREFERENCE_DIMS), F.col("pred_source"))
                .otherwise(F.col("verdict")))
    wide = V.wide_view(lv, ["judge", "item_id"], "val")
    p = S.fx_pairs(spark, sf).select(
        "item_id", "category", T.word_count("generated_answer").alias("gen_wc"),
        T.word_count("original_answer").alias("orig_wc"))
    return V.derive_outcomes(wide.join(p, "item_id"), ["judge", "item_id"], unanswered)


# --- oracle CTEs (DuckDB) -------------------------------------------------------------------
NORM = "regexp_replace(regexp_replace(coalesce({x}, ''), '\\r\\n?', '\n', 'g'), '^\\s+|\\s+$', '', 'g')"


def norm(x: str) -> str:
    return NORM.format(x=x)


def wc(x: str) -> str:
    t = norm(x)
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, '\\s+')) END)"


def choice_sql(x: str) -> str:
    return f"nullif(regexp_extract(upper({norm(x)}), '\\b([AB])\\b', 1), '')"


def yes_no_sql(x: str) -> str:
    w = f"regexp_extract(lower({norm(x)}), '\\b(yes|no)\\b', 1)"
    return f"(CASE {w} WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' END)"


OX_ORDER = ("ox_order", """
SELECT *, rn <= n // 2 AS target_is_a,
  CASE WHEN rn <= n // 2 THEN 'A' ELSE 'B' END AS gold_choice,
  CASE WHEN rn <= n // 2 THEN 'Generated_A__Original_B' ELSE 'Original_A__Generated_B' END AS response_order,
  CASE WHEN rn <= n // 2 THEN 'Generated' ELSE 'Original' END AS sentence_a_source,
  CASE WHEN rn <= n // 2 THEN 'Original' ELSE 'Generated' END AS sentence_b_source
FROM (SELECT p.*, row_number() OVER (ORDER BY md5(concat_ws('||', '42', item_id)), item_id) AS rn,
             count(*) OVER () AS n FROM fx_pairs p)""")

OX_LONG = ("ox_long", f"""
SELECT v.item_id, v.category, v.judge, v.dimension, v.raw_response, v.verdict, o.gold_choice,
  o.response_order, o.sentence_a_source, o.sentence_b_source,
  CASE WHEN v.dimension IN ('empathy', 'quality') THEN
    CASE v.verdict WHEN 'A' THEN o.sentence_a_source WHEN 'B' THEN o.sentence_b_source END END AS pred_source
FROM (SELECT *, CASE WHEN dimension IN ('empathy', 'quality') THEN {choice_sql('raw_response')}
                     ELSE {yes_no_sql('raw_response')} END AS verdict FROM fx_verdicts) v
LEFT JOIN ox_order o ON o.item_id = v.item_id""")

OX_OUTCOMES = ("ox_outcomes", f"""
SELECT w.judge, w.item_id, p.category,
  coalesce(CAST(w.empathy = 'Generated' AS INTEGER), 0) AS emp_gen,
  coalesce(CAST(w.quality = 'Generated' AS INTEGER), 0) AS qual_gen,
  coalesce(CAST(w.preservation = 'Yes' AS INTEGER), 0) AS pres,
  coalesce(CAST(w.unsupported_addition = 'No' AS INTEGER), 0) AS nounsupp,
  coalesce(CAST(w.preservation = 'Yes' AS INTEGER), 0) * coalesce(CAST(w.unsupported_addition = 'No' AS INTEGER), 0) AS fp,
  coalesce(CAST(w.quality = 'Generated' AS INTEGER), 0) * coalesce(CAST(w.preservation = 'Yes' AS INTEGER), 0)
    * coalesce(CAST(w.unsupported_addition = 'No' AS INTEGER), 0) AS sqi,
  {wc('p.generated_answer')} AS gen_wc, {wc('p.original_answer')} AS orig_wc
FROM (SELECT judge, item_id,
        first(CASE WHEN dimension = 'empathy' THEN pred_source END) FILTER (WHERE dimension = 'empathy') AS empathy,
        first(pred_source) FILTER (WHERE dimension = 'quality') AS quality,
        first(verdict) FILTER (WHERE dimension = 'preservation') AS preservation,
        first(verdict) FILTER (WHERE dimension = 'unsupported_addition') AS unsupported_addition
      FROM ox_long GROUP BY judge, item_id) w
JOIN fx_pairs p ON p.item_id = w.item_id""")

OUTCOME_CTES = [OX_ORDER, OX_LONG, OX_OUTCOMES]

OX_WIDE = ("ox_wide", """
SELECT judge, item_id, first(gold_choice) AS gold_choice, first(response_order) AS response_order,
  first(verdict) FILTER (WHERE dimension = 'empathy') AS empathy_v,
  first(pred_source) FILTER (WHERE dimension = 'empathy') AS empathy_src,
  first(verdict) FILTER (WHERE dimension = 'quality') AS quality_v,
  first(pred_source) FILTER (WHERE dimension = 'quality') AS quality_src,
  first(verdict) FILTER (WHERE dimension = 'preservation') AS preservation_v,
  first(verdict) FILTER (WHERE dimension = 'unsupported_addition') AS unsupported_addition_v
FROM ox_long GROUP BY judge, item_id""")
WIDE_CTES = [OX_ORDER, OX_LONG, OX_WIDE]


def wide_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Per (judge, item): verdict (``<dim>_v``) and predicted source (``<dim>_src``) per
    dimension, with the item's gold letter and order label."""
    lv = long_verdicts(spark, sf)
    w = lv.groupBy("judge", "item_id", "gold_choice", "response_order").pivot("dimension", V.ALL_DIMS).agg(
        F.first("verdict").alias("v"), F.first("pred_source").alias("src"))
    return w.drop(*[f"{d}_src" for d in V.FACTUAL_DIMS])
