"""Registered queries: prompt templates and rendering, batch scoring with retry, judging, factual
checks, explanations, generation, failure budget and resumable runs.

Scoring queries use the deterministic offline scorer (no model API here): its reply is a function of
the prompt's hash, so SQL that renders the same prompts knows the verdicts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from pairjudge.functions import prompts as P
from pairjudge.functions import text as T
from pairjudge.operators import prompts as PR
from pairjudge.operators import scoring as SC
from pairjudge.operators import verdicts as V
from pairjudge.plans.common import OX_ORDER, norm, pairs_order
from pairjudge.plans.oracle_fx import with_fx
from pairjudge.plans.q_runs import pending_rows_df
from pairjudge.plans.q_screen import randomized
from pairjudge.plans.registry import register
from pairjudge.sources import io as IO
from pairjudge.sources import tables as S


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _templates_sql() -> str:
    rows = ", ".join(f"({_sq(k)}, {_sq(key)}, {_sq(sy)}, {_sq(u)})" for k, key, sy, u in P.template_rows())
    return f"SELECT * FROM (VALUES {rows}) t(kind, key, system, user_template)"


@register("prompt_dimension", with_fx("""
SELECT v.item_id, v.judge, v.dimension, md5(t.system) AS system_md5, md5(t.user_template) AS template_md5
FROM fx_verdicts v JOIN tpl t ON t.kind = CASE WHEN v.dimension IN ('empathy', 'quality') THEN 'judge' ELSE 'factual' END
  AND t.key = v.dimension""", "fx_verdicts", extra=[("tpl", _templates_sql())]))
def prompt_dimension(spark, sf):
    """System + user template chosen per verdict row by (kind, dimension) from the template table."""
    v = S.fx_verdicts(spark, sf)
    x = PR.with_templates(v, PR.kind_of_dimension(F.col("dimension")), F.col("dimension"))
    return x.select("item_id", "judge", "dimension", F.md5("system").alias("system_md5"),
                    F.md5("user_template").alias("template_md5"))


def _judge_sql(dim: str) -> str:
    tpl = P.template("judge", dim)[1]
    a = f"CASE WHEN target_is_a THEN {norm('generated_answer')} ELSE {norm('original_answer')} END"
    b = f"CASE WHEN target_is_a THEN {norm('original_answer')} ELSE {norm('generated_answer')} END"
    return (f"replace(replace(replace({_sq(tpl)}, '{{question}}', {norm('question')}), '{{sentence_a}}', {a}), "
            f"'{{sentence_b}}', {b})")


def _ab(o):
    t = F.col("target_is_a")
    a = F.when(t, F.col("generated_answer")).otherwise(F.col("original_answer"))
    b = F.when(t, F.col("original_answer")).otherwise(F.col("generated_answer"))
    return a, b


@register("render_prompt", with_fx(f"""
SELECT item_id, 'empathy' AS dimension, md5({_judge_sql('empathy')}) AS prompt_md5 FROM ox_order
UNION ALL SELECT item_id, 'quality', md5({_judge_sql('quality')}) FROM ox_order""", "fx_pairs", extra=[OX_ORDER]))
def render_prompt(spark, sf):
    """Judge prompts filled in one pass (question, sentence A, sentence B by the balanced order)."""
    o = pairs_order(spark, sf)
    a, b = _ab(o)
    x = o.select("item_id", "question", a.alias("a"), b.alias("b"),
                 F.explode(F.array(F.lit("empathy"), F.lit("quality"))).alias("dimension"))
    _, user = PR.judge_prompt(F.col("dimension"), F.col("question"), F.col("a"), F.col("b"))
    return x.select("item_id", "dimension", F.md5(user).alias("prompt_md5"))


def _fact_sql(check: str) -> str:
    tpl = P.template("factual", check)[1]
    return (f"replace(replace(replace({_sq(tpl)}, '{{question}}', {norm('question')}), '{{original_answer}}', "
            f"{norm('original_answer')}), '{{generated_answer}}', {norm('generated_answer')})")


@register("prompt_join", with_fx(f"""
SELECT item_id, 'empathy' AS dimension, md5({_judge_sql('empathy')}) AS prompt_md5 FROM ox_order WHERE generated_answer <> ''
UNION ALL SELECT item_id, 'quality', md5({_judge_sql('quality')}) FROM ox_order WHERE generated_answer <> ''
UNION ALL SELECT item_id, 'preservation', md5({_fact_sql('preservation')}) FROM ox_order WHERE generated_answer <> ''
UNION ALL SELECT item_id, 'unsupported_addition', md5({_fact_sql('unsupported_addition')}) FROM ox_order WHERE generated_answer <> ''""",
                                 "fx_pairs", extra=[OX_ORDER]))
def prompt_join(spark, sf):
    """Each generated item expanded over its four judge prompts (explode of the dimension list, no
    join) and rendered with the matching template."""
    o = pairs_order(spark, sf).where(F.col("generated_answer") != "")
    a, b = _ab(o)
    x = o.select("item_id", "question", "original_answer", "generated_answer", a.alias("a"), b.alias("b"),
                 F.explode(F.array(*[F.lit(d) for d in V.ALL_DIMS])).alias("dimension"))
    _, user = PR.any_prompt(F.col("dimension"), F.col("question"), F.col("original_answer"),
                            F.col("generated_answer"), F.col("a"), F.col("b"))
    return x.select("item_id", "dimension", F.md5(user).alias("prompt_md5"))


# --- scoring -----------------------------------------------------------------------------------
def _user_sql(dim: str) -> str:
    return _judge_sql(dim) if dim in V.PREFERENCE_DIMS else _fact_sql(dim)


def _reply_sql(dim: str) -> str:
    """Offline reply to a rendered prompt ``u``."""
    first = f"substr(md5(concat({_sq(P.template('judge' if dim in V.PREFERENCE_DIMS else 'factual', dim)[0])}, chr(10), u)), 1, 1)"
    return f"CASE WHEN {first} < '8' THEN 'A' ELSE 'B' END" if dim in V.PREFERENCE_DIMS else f"CASE WHEN {first} < 'c' THEN 'Yes' ELSE 'No' END"


# Every generated item's four prompts with the offline reply.
SCORED_CTE = ("scored", " UNION ALL ".join(
    f"SELECT item_id, {_sq(d)} AS dimension, u, md5(u) AS user_md5, "
    f"md5(concat({_sq(P.template('judge' if d in V.PREFERENCE_DIMS else 'factual', d)[0])}, chr(10), u)) AS prompt_md5, {_reply_sql(d)} AS reply, "
    f"sentence_a_source, sentence_b_source FROM (SELECT *, {_user_sql(d)} AS u FROM ox_order WHERE generated_answer <> '')"
    for d in V.ALL_DIMS))


def scored_sql(sql: str) -> str:
    return with_fx(sql, "fx_pairs", extra=[OX_ORDER, SCORED_CTE])


def pending_sql(sql: str) -> str:
    """SQL over ``done``: the pending units of every judge with the offline reply and its source."""
    from pairjudge.plans.common import WIDE_CTES
    from pairjudge.plans.q_runs import PEND_SQL
    done = ("done", """
SELECT p.item_id, p.judge, p.dimension, s.reply, s.u, s.prompt_md5, s.user_md5,
  CASE WHEN p.dimension IN ('empathy', 'quality') THEN CASE s.reply WHEN 'A' THEN s.sentence_a_source ELSE s.sentence_b_source END END AS pred_source
FROM pend p JOIN scored s ON s.item_id = p.item_id AND s.dimension = p.dimension""")
    return with_fx(sql, "fx_pairs", "fx_verdicts", extra=[*WIDE_CTES, PEND_SQL, SCORED_CTE, done])


def _all_prompts(spark, sf):
    """Every generated item's four prompts."""
    o = pairs_order(spark, sf).where(F.col("generated_answer") != "")
    a, b = _ab(o)
    x = o.select("item_id", "question", "original_answer", "generated_answer", a.alias("a"), b.alias("b"),
                 F.explode(F.array(*[F.lit(d) for d in V.ALL_DIMS])).alias("dimension"))
    sys_, user = PR.any_prompt(F.col("dimension"), F.col("question"), F.col("original_answer"),
                               F.col("generated_answer"), F.col("a"), F.col("b"))
    return x.select("item_id", "dimension", sys_.alias("system"), user.alias("user"))


def _judge_units(spark, sf, dims):
    """Pending (item, judge, dimension) units, with everything needed to render prompts."""
    pend = pending_rows_df(spark, sf).where(F.col("dimension").isin(*dims))
    o = pairs_order(spark, sf)
    a, b = _ab(o)
    items = o.select("item_id", "question", "original_answer", "generated_answer", "gold_choice",
                     "sentence_a_source", "sentence_b_source", a.alias("a"), b.alias("b"))
    u = pend.join(items, "item_id")
    sys_, user = PR.any_prompt(F.col("dimension"), F.col("question"), F.col("original_answer"),
                               F.col("generated_answer"), F.col("a"), F.col("b"))
    return u.withColumn("system", sys_).withColumn("user", user)


KEEP = ["item_id", "judge", "dimension", "gold_choice", "sentence_a_source", "sentence_b_source"]


@register("score_rows", scored_sql("""
SELECT item_id, dimension, reply AS raw_response, CAST(0 AS INTEGER) AS error, CAST(1 AS INTEGER) AS attempts, prompt_md5 FROM scored"""))
def score_rows(spark, sf):
    """Every generated item's four prompts scored by the (offline) model in Arrow batches."""
    out = SC.score_rows(_all_prompts(spark, sf), keep=["item_id", "dimension"])
    return out.select("item_id", "dimension", "raw_response", "error", "attempts", "prompt_md5")


def flaky_scorer(options=SC.CallOptions()):
    """Offline scorer that fails the first call of some prompts and every call of others."""
    base = SC.offline_scorer(options)

    def score(systems, users, ctx):
        out = base(systems, users, ctx)
        for i, (u, attempt) in enumerate(zip(users, ctx["attempt"])):
            h = hashlib.md5(u.encode("utf-8")).hexdigest()
            if h[0] == "f":
                out[i] = SC.ScoringError("Rate limit reached. Too Many Requests", 429)
            elif h[0] in "01" and attempt == 1:
                out[i] = SC.ScoringError("upstream connect error", 503)
        return out
    return score


@register("score_with_retry", scored_sql("""
SELECT item_id, dimension, CAST(CASE WHEN substr(user_md5, 1, 1) IN ('0', '1', 'f') THEN 2 ELSE 1 END AS INTEGER) AS attempts,
  CAST(CASE WHEN substr(user_md5, 1, 1) = 'f' THEN 1 ELSE 0 END AS INTEGER) AS error,
  CASE WHEN substr(user_md5, 1, 1) = 'f' THEN NULL ELSE reply END AS raw_response,
  CASE WHEN substr(user_md5, 1, 1) = 'f' THEN 'Rate limit (ScoringError, HTTP 429): Rate limit reached. Too Many Requests' END AS error_text
FROM scored"""))
def score_with_retry(spark, sf):
    """Two attempts per row; rows still failing become error rows (message kept), never a failed task."""
    out = SC.score_rows(_all_prompts(spark, sf), keep=["item_id", "dimension"], factory=flaky_scorer, pause_s=0.01)
    return out.select("item_id", "dimension", "attempts", "error", "raw_response",
                      F.when(F.col("error") == 1, T.classify_error(F.col("error_status"), F.col("error_message"),
                                                                   F.col("error_type"))).alias("error_text"))


def _parsed(scored):
    v = scored.withColumn("verdict", F.when(F.col("dimension").isin(*V.PREFERENCE_DIMS),
                                            T.parse_choice("raw_response")).otherwise(T.parse_yes_no("raw_response")))
    v = v.withColumn("pred_source", F.when(F.col("dimension").isin(*V.PREFERENCE_DIMS), V.pred_source_from_columns(
        F.col("verdict"), F.col("sentence_a_source"), F.col("sentence_b_source"))))
    err = F.when(F.col("error") == 1, F.col("error_message")).when(
        F.col("verdict").isNull() & F.col("dimension").isin(*V.PREFERENCE_DIMS), F.lit("Could not parse A/B")).when(
        F.col("verdict").isNull(), F.lit("Could not parse Yes/No"))
    return v.withColumn("judge_error", err)


@register("judge_pairs", pending_sql("""
SELECT item_id, judge, dimension, reply AS verdict, pred_source, CAST(NULL AS VARCHAR) AS judge_error FROM done
WHERE dimension IN ('empathy', 'quality')"""))
def judge_pairs(spark, sf):
    """Pending empathy and quality units of every judge: render, score, parse, map back to sources."""
    u = _judge_units(spark, sf, V.PREFERENCE_DIMS)
    out = _parsed(SC.score_rows(u, keep=KEEP))
    return out.select("item_id", "judge", "dimension", "verdict", "pred_source", "judge_error")


@register("check_facts", pending_sql("""
SELECT item_id, judge, dimension, reply AS verdict, CAST(NULL AS VARCHAR) AS judge_error FROM done
WHERE dimension NOT IN ('empathy', 'quality')"""))
def check_facts(spark, sf):
    """Pending preservation and unsupported-addition checks of every judge (Yes/No parsing)."""
    u = _judge_units(spark, sf, V.FACTUAL_DIMS)
    out = _parsed(SC.score_rows(u, keep=KEEP))
    return out.select("item_id", "judge", "dimension", "verdict", "judge_error")


@register("judge_all", pending_sql("""
SELECT item_id, judge, dimension, reply AS verdict, pred_source, CAST(NULL AS VARCHAR) AS judge_error FROM done"""))
def judge_all(spark, sf):
    """Only the missing ones of the four prompts, for all items and judges, in one scoring job."""
    u = _judge_units(spark, sf, V.ALL_DIMS)
    out = _parsed(SC.score_rows(u, keep=KEEP))
    return out.select("item_id", "judge", "dimension", "verdict", "pred_source", "judge_error")


def _filled_sql(tpl: str, **values: str) -> str:
    out = _sq(tpl)
    for name, value in values.items():
        out = f"replace({out}, {_sq('{' + name + '}')}, {value})"
    return out


def _explained_sql(system: str, user: str) -> str:
    return f"concat('The rewrite reads as formulaic (', substr(md5(concat({_sq(system)}, chr(10), {user})), 1, 6), ').')"


def _gold_pairs_sql() -> str:
    from pairjudge.plans.q_screen import RANDOM_SQL, SCREENED_SQL
    sys_, tpl = P.template("calibration", "rephrase")
    esys, etpl = P.template("calibration_explain", "rephrase")
    first = _filled_sql(tpl, sentence_a="CASE WHEN target_is_a THEN empathy_answer ELSE normal_answer END",
                        sentence_b="CASE WHEN target_is_a THEN normal_answer ELSE empathy_answer END")
    second = _filled_sql(etpl, question="split_part(normal_answer, chr(10), 1)", normal_answer="normal_answer", empathy_answer="empathy_answer",
                         response_order="response_order", pred_choice="pred_choice", gold_choice="gold_choice")
    return with_fx(f"""
SELECT item_id, pred_choice, gold_choice, CAST(pred_choice = gold_choice AS INTEGER) AS is_match,
  CASE WHEN pred_choice <> gold_choice THEN {_explained_sql(esys, second)} END AS mismatch_explanation
FROM (SELECT *, CASE WHEN substr(md5(concat({_sq(sys_)}, chr(10), {first})), 1, 1) < '8' THEN 'A' ELSE 'B' END AS pred_choice FROM rnd)""",
                   "fx_rephrase", extra=[("screened", SCREENED_SQL), ("rnd", RANDOM_SQL)])


@register("judge_gold_pairs", _gold_pairs_sql())
def judge_gold_pairs(spark, sf):
    """Rephrasing calibration: balanced order on the eligible set, empathy judge, match vs gold;
    rows where the judge missed the gold get a second-stage explanation call in JSON mode (first stage
    materialised so it is not scored twice). The question is the first line of the plain answer."""
    r = randomized(spark, sf)
    t = F.col("target_is_a")
    a = F.when(t, F.col("empathy_answer")).otherwise(F.col("normal_answer"))
    b = F.when(t, F.col("normal_answer")).otherwise(F.col("empathy_answer"))
    sys_, tpl = P.template("calibration", "rephrase")
    user = P.render(tpl, sentence_a=a, sentence_b=b)
    x = r.select("item_id", "gold_choice", "response_order", "normal_answer", "empathy_answer",
                 F.lit(sys_).alias("system"), user.alias("user"))
    first = SC.score_rows(x, keep=["item_id", "gold_choice", "response_order", "normal_answer", "empathy_answer"])
    first = V.add_match(first.withColumn("pred_choice", T.parse_choice("raw_response")), "gold_choice", "pred_choice")
    first = SC.materialize(first, "gold-judge-stage")
    missed = first.where(F.col("is_match") == 0)
    esys, etpl = P.template("calibration_explain", "rephrase")
    euser = P.render(etpl, question=F.substring_index("normal_answer", "\n", 1), normal_answer=F.col("normal_answer"),
                     empathy_answer=F.col("empathy_answer"), response_order=F.col("response_order"),
                     pred_choice=F.col("pred_choice"), gold_choice=F.col("gold_choice"))
    second = SC.score_rows(missed.select("item_id", F.lit(esys).alias("system"), euser.alias("user")),
                           keep=["item_id"], options=SC.CallOptions(json_mode=True))
    expl = second.select("item_id", T.mismatch_explanation("raw_response").alias("mismatch_explanation"))
    return first.select("item_id", "pred_choice", "gold_choice", "is_match").join(expl, "item_id", "left")


def _explain_sql() -> str:
    arms = " ".join(
        f"WHEN {_sq(d)} THEN " + _explained_sql(P.EXPLAIN_SYSTEM, _filled_sql(
            P.template("explain", d)[1], question=norm("p.question"), original_answer=norm("p.original_answer"),
            generated_answer=norm("p.generated_answer"), raw_judge_response="d.reply")) for d in V.PREFERENCE_DIMS)
    return pending_sql(f"""
SELECT d.item_id, d.judge, d.dimension, CASE d.dimension {arms} END AS explanation, CAST(0 AS INTEGER) AS error
FROM done d JOIN fx_pairs p ON p.item_id = d.item_id WHERE d.pred_source = 'Original'""")


@register("explain_mismatches", _explain_sql())
def explain_mismatches(spark, sf):
    """Second-stage call only where a judge preferred the original; the first stage is
    materialised so it is not scored twice."""
    u = _judge_units(spark, sf, V.PREFERENCE_DIMS)
    first = SC.materialize(_parsed(SC.score_rows(u, keep=KEEP + ["question", "original_answer", "generated_answer"])), "judge_stage")
    lost = first.where(F.col("pred_source") == "Original")
    tpls = {d: P.template("explain", d)[1] for d in V.PREFERENCE_DIMS}
    user = PR.render_by_key(F.col("dimension"), tpls, question=T.normalize_text("question"),
                            original_answer=T.normalize_text("original_answer"),
                            generated_answer=T.normalize_text("generated_answer"),
                            raw_judge_response=T.normalize_text("raw_response"))
    x = lost.select("item_id", "judge", "dimension", F.lit(P.EXPLAIN_SYSTEM).alias("system"), user.alias("user"))
    out = SC.score_rows(x, keep=["item_id", "judge", "dimension"])
    return out.select("item_id", "judge", "dimension", T.mismatch_explanation("raw_response").alias("explanation"), "error")


@register("generate_rewrites", with_fx(f"""
SELECT item_id, md5({norm("concat('Capisco la sua preoccupazione. ', original_answer)")}) AS generated_md5, 'offline' AS generation_model,
  'v3_refined_clinical_editing' AS generation_prompt_variant, CAST(NULL AS VARCHAR) AS generation_error
FROM fx_pairs WHERE generated_answer = ''""", "fx_pairs"))
def generate_rewrites(spark, sf):
    """Items without an edited answer get one from the V3 prompt, stamped with model and variant."""
    p = S.fx_pairs(spark, sf).where(F.col("generated_answer") == "")
    sys_, tpl = P.template("generation", "v3_refined_clinical_editing")
    user = P.render(tpl, question=T.normalize_text("question"), original_answer=T.normalize_text("original_answer"))
    x = p.select("item_id", "original_answer", F.lit(sys_).alias("system"), user.alias("user"))
    out = SC.score_rows(x, keep=["item_id", "original_answer"])
    return out.select("item_id", F.md5(T.normalize_text("raw_response")).alias("generated_md5"),
                      F.lit("offline").alias("generation_model"),
                      F.lit("v3_refined_clinical_editing").alias("generation_prompt_variant"),
                      F.when(F.col("error") == 1, F.col("error_message")).alias("generation_error"))


WAVE_SIZE = 100
FAILURE_BUDGET = 10


@register("failure_policy", pending_sql(f"""
SELECT wave, CASE WHEN stopped THEN 0 ELSE n END AS scored, CASE WHEN stopped THEN 0 ELSE f END AS failed, stopped AS skipped
FROM (SELECT *, coalesce(sum(f) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > {FAILURE_BUDGET} AS stopped
      FROM (SELECT CAST((rk - 1) // {WAVE_SIZE} AS INTEGER) AS wave, count(*) AS n, CAST(sum(bad) AS BIGINT) AS f
            FROM (SELECT CASE WHEN substr(user_md5, 1, 1) = 'f' THEN 1 ELSE 0 END AS bad,
                    row_number() OVER (ORDER BY md5(concat_ws('|', item_id, judge, dimension)), concat_ws('|', item_id, judge, dimension)) AS rk FROM done)
            GROUP BY 1))"""))
def failure_policy(spark, sf):
    """Score all pending units in waves of 100 with a failure budget of 10: waves stop launching once
    the budget is spent."""
    u = _judge_units(spark, sf, V.ALL_DIMS).withColumn("unit_id", F.concat_ws("|", "item_id", "judge", "dimension"))
    store = IO.scratch_path(spark, "waves-store")

    def score(batch):
        return SC.score_rows(batch, keep=["unit_id", "item_id", "judge", "dimension", "wave"], factory=flaky_scorer,
                             pause_s=0.0)
    return SC.score_in_waves(u, "unit_id", WAVE_SIZE, FAILURE_BUDGET, score, store)


ROUND = 40


@register("incremental_run", pending_sql(f"""
SELECT item_id, judge, dimension, reply AS raw_response, CAST(0 AS INTEGER) AS error FROM done
ORDER BY item_id, judge, dimension LIMIT {2 * ROUND}"""))
def incremental_run(spark, sf):
    """Two resumable rounds of N = 40 pending units each; the second round continues exactly where
    the first stopped (no unit scored twice)."""
    u = _judge_units(spark, sf, V.ALL_DIMS)
    store = IO.scratch_path(spark, "incremental-store")
    keys = ["item_id", "judge", "dimension"]

    def score(batch):
        return SC.score_rows(batch, keep=keys)
    first = SC.incremental_run(u, keys, ROUND, score, store)
    return first.unionByName(SC.incremental_run(u, keys, ROUND, score, store)).select(*keys, "raw_response", "error")


def _cal_prompt_sql() -> str:
    from pairjudge.plans.q_metrics import CAL_CTES
    return with_fx("""
SELECT c.item_id, c.dimension, c.judge, v.variant, md5(t.system) AS system_md5, md5(t.user_template) AS template_md5
FROM cal c CROSS JOIN (VALUES ('paper_minimal'), ('paper_guided_editprompt')) v(variant)
JOIN tpl t ON t.kind = 'calibration' AND t.key = v.variant || ':' || lower(c.dimension)""",
                   "fx_ratings", extra=CAL_CTES + [("tpl", _templates_sql())])


@register("calibration_prompts", _cal_prompt_sql())
def calibration_prompts(spark, sf):
    """Two-source calibration rows expanded over the two prompt variants, each with its template
    chosen by (variant, dimension) from the template table."""
    from pairjudge.plans.q_metrics import cal_view
    v = cal_view(spark, sf).select("item_id", "dimension", "judge",
                                   F.explode(F.array(*[F.lit(x) for x in P.CAL_VARIANTS])).alias("variant"))
    x = PR.with_templates(v, F.lit("calibration"), F.concat(F.col("variant"), F.lit(":"), F.lower("dimension")))
    return x.select("item_id", "dimension", "judge", "variant", F.md5("system").alias("system_md5"),
                    F.md5("user_template").alias("template_md5"))
