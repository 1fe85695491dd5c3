"""Registered queries: screening, gold derivation from ratings, A/B order assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairjudge.functions import text as T
from pairjudge.operators import assign as A
from pairjudge.operators import screen as SC
from pairjudge.plans.common import SEED, OX_ORDER
from pairjudge.plans.oracle_fx import with_fx
from pairjudge.plans.q_text import strip_sql
from pairjudge.plans.registry import register
from pairjudge.operators.scoring import materialize
from pairjudge.sources import tables as S

# --- screening (rephrasing set) ---------------------------------------------------------------
_TERMS = "[" + ", ".join("'" + t + "'" for t in T.ENGLISH_TERMS) + "]"


def incomplete_sql(x: str) -> str:
    s = strip_sql(x)
    return f"(length({s}) < 25 OR regexp_matches({s}, '[:,]$'))"


def english_sql(x: str) -> str:
    padded = f"(' ' || lower({strip_sql(x)}) || ' ')"
    return f"len(list_filter({_TERMS}, lambda t: instr({padded}, t) > 0))"


def shrunk_sql(o: str, r: str) -> str:
    n, m = f"length({strip_sql(o)})", f"length({strip_sql(r)})"
    return f"({n} >= 120 AND {m} < greatest(CAST(60 AS DOUBLE), {n} * CAST(0.45 AS DOUBLE)))"


def artifact_sql(*xs: str) -> str:
    re_ = T.PROMPT_ARTIFACT_RE.replace("\\", "\\")
    return "(" + " OR ".join(f"regexp_matches({strip_sql(x)}, '{re_}')" for x in xs) + ")"


BROKEN_SQL = f"""concat_ws(';',
  CASE WHEN {incomplete_sql('normal_answer')} THEN 'original_incomplete' END,
  CASE WHEN {incomplete_sql('empathy_answer')} THEN 'empathy_incomplete' END,
  CASE WHEN {shrunk_sql('normal_answer', 'empathy_answer')} THEN 'empathy_much_shorter_than_original' END,
  CASE WHEN {english_sql('normal_answer')} >= 4 THEN 'original_english_heavy' END,
  CASE WHEN {english_sql('empathy_answer')} >= 4 THEN 'empathy_english_heavy' END,
  CASE WHEN {artifact_sql('normal_answer', 'empathy_answer')} THEN 'prompt_artifact' END)"""

SCREENED_SQL = f"""
SELECT *, reason <> '' AS broken_row_flag,
  CAST(CAST(nullif(regexp_extract(increment_raw, '([1-5])', 1), '') AS INTEGER) >= 4 AS INTEGER) AS gold
FROM (SELECT *, {BROKEN_SQL} AS reason FROM fx_rephrase)"""


def screened(spark, sf):
    r = S.fx_rephrase(spark, sf)
    r = SC.add_broken_flags(r, "normal_answer", "empathy_answer")
    return SC.add_gold_increment(r, "increment_raw")


@register("looks_incomplete", with_fx(f"""
SELECT item_id, {incomplete_sql('normal_answer')} AS original_incomplete,
  {incomplete_sql('empathy_answer')} AS empathy_incomplete FROM fx_rephrase""", "fx_rephrase"))
def looks_incomplete(spark, sf):
    r = S.fx_rephrase(spark, sf)
    return r.select("item_id", T.looks_incomplete("normal_answer").alias("original_incomplete"),
                    T.looks_incomplete("empathy_answer").alias("empathy_incomplete"))


@register("english_signal", with_fx(f"""
SELECT item_id, {english_sql('normal_answer')} AS original_terms, {english_sql('empathy_answer')} AS empathy_terms
FROM fx_rephrase""", "fx_rephrase"))
def english_signal(spark, sf):
    r = S.fx_rephrase(spark, sf)
    return r.select("item_id", T.english_signal("normal_answer").alias("original_terms"),
                    T.english_signal("empathy_answer").alias("empathy_terms"))


@register("shrunk_rewrite", with_fx(f"""
SELECT item_id, {shrunk_sql('normal_answer', 'empathy_answer')} AS shrunk FROM fx_rephrase""", "fx_rephrase"))
def shrunk_rewrite(spark, sf):
    r = S.fx_rephrase(spark, sf)
    return r.select("item_id", T.shrunk_rewrite("normal_answer", "empathy_answer").alias("shrunk"))


@register("prompt_artifact", with_fx(f"""
SELECT item_id, {artifact_sql('normal_answer', 'empathy_answer')} AS artifact FROM fx_rephrase""", "fx_rephrase"))
def prompt_artifact(spark, sf):
    r = S.fx_rephrase(spark, sf)
    return r.select("item_id", T.prompt_artifact("normal_answer", "empathy_answer").alias("artifact"))


@register("broken_flags", with_fx(f"""
SELECT item_id, reason <> '' AS broken_row_flag, reason AS broken_row_reason
FROM (SELECT item_id, {BROKEN_SQL} AS reason FROM fx_rephrase)""", "fx_rephrase"))
def broken_flags(spark, sf):
    r = SC.add_broken_flags(S.fx_rephrase(spark, sf), "normal_answer", "empathy_answer")
    return r.select("item_id", "broken_row_flag", "broken_row_reason")


@register("screen_report", with_fx("""
SELECT count(*) AS rows_all, count(*) FILTER (WHERE gold IS NULL) AS rejected,
  count(*) FILTER (WHERE gold = 1) AS gold_positive,
  count(*) FILTER (WHERE gold = 1 AND broken_row_flag) AS broken,
  count(*) FILTER (WHERE gold = 1 AND NOT broken_row_flag) AS used
FROM screened""", "fx_rephrase", extra=[("screened", SCREENED_SQL)]))
def screen_report(spark, sf):
    return SC.screen_report(screened(spark, sf))


@register("eligible_rows", with_fx("""
SELECT item_id, lang FROM screened WHERE gold = 1 AND NOT broken_row_flag""",
                                   "fx_rephrase", extra=[("screened", SCREENED_SQL)]))
def eligible_rows(spark, sf):
    return SC.eligible(screened(spark, sf)).select("item_id", "lang")


# --- ratings -> gold source -------------------------------------------------------------------
GOLD_SQL = """
SELECT item_id, dimension, physician_avg, chatgpt_avg, abs(chatgpt_avg - physician_avg) AS diff_abs,
  CASE WHEN chatgpt_avg > physician_avg THEN 'ChatGPT' WHEN physician_avg > chatgpt_avg THEN 'Physician' ELSE 'Tie' END AS gold_source,
  chatgpt_avg IS NULL OR physician_avg IS NULL AS missing_avg
FROM (SELECT item_id, dimension,
        avg(CASE WHEN source = 'Physician' THEN TRY_CAST(score_raw AS DOUBLE) END) AS physician_avg,
        avg(CASE WHEN source = 'ChatGPT' THEN TRY_CAST(score_raw AS DOUBLE) END) AS chatgpt_avg
      FROM fx_ratings GROUP BY item_id, dimension)"""


def gold_table(spark, sf):
    return SC.average_scores(S.fx_ratings(spark, sf))


@register("evaluator_mean", with_fx("""
SELECT item_id, source, dimension, avg(TRY_CAST(score_raw AS DOUBLE)) AS avg_score
FROM fx_ratings GROUP BY item_id, source, dimension""", "fx_ratings"))
def evaluator_mean(spark, sf):
    r = S.fx_ratings(spark, sf)
    s = F.col("score_raw").try_cast("double")
    return r.groupBy("item_id", "source", "dimension").agg(
        F.avg(F.when(~F.isnan(s), s)).alias("avg_score"))


@register("gold_source", with_fx("SELECT * FROM gold", "fx_ratings", extra=[("gold", GOLD_SQL)]))
def gold_source(spark, sf):
    return gold_table(spark, sf)


@register("drop_ties", with_fx("SELECT item_id, dimension, gold_source FROM gold WHERE gold_source <> 'Tie'",
                               "fx_ratings", extra=[("gold", GOLD_SQL)]))
def drop_ties(spark, sf):
    return gold_table(spark, sf).where(F.col("gold_source") != "Tie").select("item_id", "dimension", "gold_source")


SHUFFLE_SQL = """
SELECT item_id, dimension, gold_source, diff_abs, j < n // 2 + CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END AS target_is_a,
  CASE WHEN j < n // 2 + CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END THEN 'A' ELSE 'B' END AS gold_choice,
  CASE WHEN j < n // 2 + CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END
       THEN concat(gold_source, '_A__', CASE WHEN gold_source = 'ChatGPT' THEN 'Physician' ELSE 'ChatGPT' END, '_B')
       ELSE concat(CASE WHEN gold_source = 'ChatGPT' THEN 'Physician' ELSE 'ChatGPT' END, '_A__', gold_source, '_B') END
    AS response_order
FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY substr(md5(concat('42:position:', CAST(i AS VARCHAR))), 1, 12), i) - 1 AS j
      FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY substr(md5(concat('42:', item_id)), 1, 12), item_id) - 1 AS i,
                   count(*) OVER (PARTITION BY dimension) AS n
            FROM gold WHERE gold_source <> 'Tie'))"""


def shuffled(spark, sf):
    nt = materialize(gold_table(spark, sf).where(F.col("gold_source") != "Tie"), "two-source-gold")  # a short row per item and dimension
    return A.balanced_ab_shuffle(nt, SEED, target_col="gold_source", keys=["dimension"])


@register("balanced_ab_shuffle", with_fx("SELECT item_id, dimension, gold_source, target_is_a, gold_choice, response_order FROM sh",
                                         "fx_ratings", extra=[("gold", GOLD_SQL), ("sh", SHUFFLE_SQL)]))
def balanced_ab_shuffle(spark, sf):
    """Two-source calibration order, balanced per dimension on the non-tied items."""
    return shuffled(spark, sf).select("item_id", "dimension", "gold_source", "target_is_a", "gold_choice", "response_order")


@register("ratings_screen_report", with_fx("""
SELECT dimension, count(*) AS rows_all, count(*) FILTER (WHERE missing_avg) AS missing, count(*) FILTER (WHERE gold_source = 'Tie') AS ties,
  count(*) FILTER (WHERE gold_source <> 'Tie') AS used, count(*) FILTER (WHERE gold_source <> 'Tie' AND diff_abs >= 1) AS clear_margin
FROM gold GROUP BY dimension""", "fx_ratings", extra=[("gold", GOLD_SQL)]))
def ratings_screen_report(spark, sf):
    """Two-source funnel per dimension: rows, missing means, ties, used, clear margin."""
    return SC.ratings_report(gold_table(spark, sf))


@register("margin_view", with_fx("SELECT item_id, dimension, gold_source, gold_choice, diff_abs FROM sh WHERE diff_abs >= 1",
                                 "fx_ratings", extra=[("gold", GOLD_SQL), ("sh", SHUFFLE_SQL)]))
def margin_view(spark, sf):
    """Clear-margin view (|avg diff| >= 1) filtered after the order is assigned on the full set."""
    return shuffled(spark, sf).where(F.col("diff_abs") >= 1).select(
        "item_id", "dimension", "gold_source", "gold_choice", "diff_abs")


# --- A/B order --------------------------------------------------------------------------------
@register("balanced_ab_hash", with_fx("""
SELECT item_id, target_is_a, gold_choice, response_order, sentence_a_source, sentence_b_source FROM ox_order""",
                                      "fx_pairs", extra=[OX_ORDER]))
def balanced_ab_hash(spark, sf):
    o = A.balanced_ab_hash(S.fx_pairs(spark, sf), SEED)
    return o.select("item_id", "target_is_a", "gold_choice", "response_order", "sentence_a_source", "sentence_b_source")


RANDOM_SQL = f"""
SELECT *, rn <= n // 2 AS target_is_a, CASE WHEN rn <= n // 2 THEN 'A' ELSE 'B' END AS gold_choice,
  CASE WHEN rn <= n // 2 THEN 'answer_with_empathy_A__answer_B' ELSE 'answer_A__answer_with_empathy_B' END AS response_order
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', item_id)), item_id) AS rn, count(*) OVER () AS n
      FROM screened WHERE gold = 1 AND NOT broken_row_flag)"""


def randomized(spark, sf):
    """Balanced order on the eligible set. That set comes out of text-heavy narrow screening: its ids
    alone are written to the shared scratch folder for the order, the texts stay where they are."""
    items = SC.eligible(screened(spark, sf)).select("item_id", "lang", "normal_answer", "empathy_answer",
                                                    "increment_raw", "increment_score", "gold")
    return A.balanced_ab_random(items, SEED, ids=materialize(items.select("item_id"), "eligible-ids"))


@register("balanced_ab_random", with_fx("SELECT item_id, target_is_a, gold_choice, response_order FROM rnd",
                                        "fx_rephrase", extra=[("screened", SCREENED_SQL), ("rnd", RANDOM_SQL)]))
def balanced_ab_random(spark, sf):
    """Rephrasing order on the eligible set: exactly floor(n/2) rewrites at A."""
    return randomized(spark, sf).select("item_id", "target_is_a", "gold_choice", "response_order")


@register("build_ab_pair", with_fx("""
SELECT item_id, md5(CASE WHEN target_is_a THEN empathy_answer ELSE normal_answer END) AS a_md5,
  md5(CASE WHEN target_is_a THEN normal_answer ELSE empathy_answer END) AS b_md5, response_order, gold_choice
FROM rnd""", "fx_rephrase", extra=[("screened", SCREENED_SQL), ("rnd", RANDOM_SQL)]))
def build_ab_pair(spark, sf):
    x = A.ab_sentences(randomized(spark, sf), "empathy_answer", "normal_answer")
    return x.select("item_id", F.md5("sentence_a").alias("a_md5"), F.md5("sentence_b").alias("b_md5"),
                    "response_order", "gold_choice")


@register("pick_response", with_fx("""
SELECT item_id, md5(CASE WHEN sentence_a_source = 'Generated' THEN generated_answer ELSE original_answer END) AS a_md5,
  md5(CASE WHEN sentence_b_source = 'Generated' THEN generated_answer ELSE original_answer END) AS b_md5
FROM ox_order""", "fx_pairs", extra=[OX_ORDER]))
def pick_response(spark, sf):
    o = A.balanced_ab_hash(S.fx_pairs(spark, sf), SEED)
    g, orig = F.col("generated_answer"), F.col("original_answer")
    return o.select("item_id", F.md5(A.pick_response(F.col("sentence_a_source"), g, orig)).alias("a_md5"),
                    F.md5(A.pick_response(F.col("sentence_b_source"), g, orig)).alias("b_md5"))


@register("balance_check", with_fx("""
SELECT 'hash' AS assignment, l.gold_choice, count(o.item_id) AS n
FROM (VALUES ('A'), ('B')) l(gold_choice) LEFT JOIN ox_order o ON o.gold_choice = l.gold_choice GROUP BY 1, 2
UNION ALL
SELECT 'random', l.gold_choice, count(o.item_id) FROM (VALUES ('A'), ('B')) l(gold_choice)
LEFT JOIN rnd o ON o.gold_choice = l.gold_choice GROUP BY 1, 2
UNION ALL
SELECT 'shuffle_' || d.dimension, l.gold_choice, count(o.item_id)
FROM (VALUES ('A'), ('B')) l(gold_choice) CROSS JOIN (SELECT DISTINCT dimension FROM sh) d
LEFT JOIN sh o ON o.gold_choice = l.gold_choice AND o.dimension = d.dimension GROUP BY 1, 2""",
                                   "fx_pairs", "fx_rephrase", "fx_ratings",
                                   extra=[OX_ORDER, ("screened", SCREENED_SQL), ("rnd", RANDOM_SQL),
                                          ("gold", GOLD_SQL), ("sh", SHUFFLE_SQL)]))
def balance_check(spark, sf):
    """Gold-letter counts of the three balanced assignments (zero-filled)."""
    h = A.balance_check(A.balanced_ab_hash(S.fx_pairs(spark, sf), SEED)).select(
        F.lit("hash").alias("assignment"), "gold_choice", "n")
    r = A.balance_check(randomized(spark, sf)).select(F.lit("random").alias("assignment"), "gold_choice", "n")
    s = A.balance_check(shuffled(spark, sf), ["dimension"]).select(
        F.concat(F.lit("shuffle_"), F.col("dimension")).alias("assignment"), "gold_choice", "n")
    return h.unionByName(r).unionByName(s)


@register("hash_sort", with_fx("""
SELECT item_id, row_number() OVER (ORDER BY md5(concat_ws('||', '42', item_id)), item_id) AS hash_rank FROM fx_pairs""",
                               "fx_pairs"))
def hash_sort(spark, sf):
    p = S.fx_pairs(spark, sf).select("item_id").withColumn("h", T.stable_hash(F.lit(42), "item_id"))
    return A.exact_rank(p, "h", ["item_id"], out="hash_rank").select("item_id", "hash_rank")


@register("exact_rank", with_fx("""
SELECT item_id, row_number() OVER (ORDER BY md5(item_id), item_id) AS rank FROM fx_raters_big""", "fx_raters_big"))
def exact_rank(spark, sf):
    """Global rank of every lineitem-sized rater row by md5(item_id) without a one-task window."""
    r = S.fx_raters_big(spark, sf).select("item_id").withColumn("h", F.md5("item_id"))
    return A.exact_rank(r, "h", ["item_id"]).select("item_id", "rank")
