"""Registered queries: run scope, keep-last, upsert, pending work, guards, views and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairjudge.operators import runs as R
from pairjudge.operators import verdicts as V
from pairjudge.plans.common import WIDE_CTES, wide_verdicts, long_verdicts, pairs_order
from pairjudge.plans.oracle_fx import with_fx
from pairjudge.plans.q_metrics import CAL_CTES, cal_view
from pairjudge.plans.q_screen import RANDOM_SQL, SCREENED_SQL, randomized
from pairjudge.plans.registry import register
from pairjudge.sources import tables as S

RUN_JUDGE = "click"          # the run being read / replaced in these queries
RUN_VARIANT = "paper_minimal"
KEYS = ["item_id", "judge_model", "prompt_variant"]
NEXT_N = 50
PREVIEW_MAX = 200


def stored(spark, sf):
    """Stored result rows with the variant normalised on read (blank -> default)."""
    r = S.fx_results(spark, sf)
    return r.withColumn("prompt_variant", R.normalized_variant(F.col("prompt_variant")))


def run_pred():
    return R.run_predicate("judge_model", RUN_JUDGE, "prompt_variant", RUN_VARIANT)


RES_SQL = ("res", """
SELECT item_id, judge_model, CASE WHEN trim(coalesce(prompt_variant, '')) = '' THEN 'paper_minimal' ELSE trim(prompt_variant) END AS prompt_variant,
  scored_at, seq, value FROM fx_results""")
LAST_SQL = ("last", """
SELECT item_id, judge_model, prompt_variant, seq, value FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, judge_model, prompt_variant ORDER BY scored_at DESC, seq DESC) AS rn FROM res)
WHERE rn = 1""")
IN_RUN = f"(judge_model = '{RUN_JUDGE}' AND prompt_variant = '{RUN_VARIANT}')"


def rs(sql: str, *more) -> str:
    return with_fx(sql, "fx_results", extra=[RES_SQL, LAST_SQL, *more])


@register("dedupe_keep_last", rs("SELECT * FROM last"))
def dedupe_keep_last(spark, sf):
    """Latest row per (item, judge, variant) by (scored_at, seq)."""
    d = R.dedupe_keep_last(stored(spark, sf), KEYS, ["scored_at", "seq"])
    return d.select(*KEYS, "seq", "value")


def scoped(spark, sf):
    """Stored rows with a seed (some without), a shot mode and a dimension."""
    r, seq = stored(spark, sf), F.col("seq")
    return (r.withColumn("seed", F.when(seq % 5 != 0, (F.lit(42) + seq % 2).cast("string")))
            .withColumn("shot_mode", F.when(seq % 7 == 0, F.lit("few-shot")).otherwise(F.lit("zero-shot")))
            .withColumn("dimension", F.when(seq % 3 == 0, F.lit("quality")).otherwise(F.lit("empathy"))))


SCOPED_SQL = ("scoped", """
SELECT *, CASE WHEN seq % 5 <> 0 THEN 42 + seq % 2 END AS seed, CASE WHEN seq % 7 = 0 THEN 'few-shot' ELSE 'zero-shot' END AS shot_mode,
  CASE WHEN seq % 3 = 0 THEN 'quality' ELSE 'empathy' END AS dimension FROM res""")


@register("run_scope", rs(f"""
SELECT item_id, seq, value FROM scoped WHERE judge_model = '{RUN_JUDGE}' AND prompt_variant = '{RUN_VARIANT}'
  AND coalesce(seed, 42) = 42 AND shot_mode = 'zero-shot' AND dimension = 'empathy'""", SCOPED_SQL))
def run_scope(spark, sf):
    """Rows of one run (judge, variant, seed, shot mode, dimension); a blank variant reads as the
    default, a missing seed as the current one."""
    run = R.run_predicate("judge_model", RUN_JUDGE, "prompt_variant", RUN_VARIANT, "seed", 42, "shot_mode", "zero-shot", "dimension", "empathy")
    return scoped(spark, sf).where(run).select("item_id", "seq", "value")


NEWVIEW = ("newview", f"""SELECT item_id, judge_model, prompt_variant, seq + 1000000000 AS seq, value * 2 AS value
FROM last WHERE {IN_RUN}""")


def _new_view(spark, sf):
    d = R.dedupe_keep_last(stored(spark, sf).where(run_pred()), KEYS, ["scored_at", "seq"])
    return d.select(*KEYS, (F.col("seq") + 1000000000).alias("seq"), (F.col("value") * 2).alias("value"))


@register("upsert_run", rs(f"""
SELECT item_id, judge_model, prompt_variant, seq, value FROM res WHERE NOT {IN_RUN}
UNION ALL SELECT * FROM newview""", NEWVIEW))
def upsert_run(spark, sf):
    """Replace one run's rows with a freshly scored view; other runs are kept as stored."""
    st = stored(spark, sf).select(*KEYS, "seq", "value")
    return R.upsert_run(st, run_pred(), _new_view(spark, sf))


@register("keep_other_runs", rs(f"SELECT item_id, judge_model, prompt_variant, seq, value FROM res WHERE NOT {IN_RUN}"))
def keep_other_runs(spark, sf):
    return R.keep_other_runs(stored(spark, sf), run_pred()).select(*KEYS, "seq", "value")


@register("reset_run", rs(f"""
SELECT item_id, judge_model, prompt_variant, seq, CASE WHEN {IN_RUN} THEN NULL ELSE value END AS value FROM res"""))
def reset_run(spark, sf):
    """Blank the results of one run, keep every other row."""
    st = stored(spark, sf)
    return st.select(*KEYS, "seq", F.when(run_pred(), F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"))


@register("delete_run", with_fx("""
SELECT v.item_id, v.judge, v.dimension FROM fx_verdicts v
WHERE NOT EXISTS (SELECT 1 FROM fx_pairs p WHERE p.item_id = v.item_id AND p.category = 'cat0')""", "fx_verdicts"))
def delete_run(spark, sf):
    """Drop one generation run (category cat0) and its downstream judge rows (anti join)."""
    gone = S.fx_pairs(spark, sf).where(F.col("category") == "cat0").select("item_id")
    return S.fx_verdicts(spark, sf).join(gone, "item_id", "left_anti").select("item_id", "judge", "dimension")


# --- pending work ------------------------------------------------------------------------------
def wanted(spark, sf):
    """Every (generated item x judge x dimension) that should have a verdict."""
    p = S.fx_pairs(spark, sf).where(F.col("generated_answer") != "")
    combos = F.array(*[F.struct(F.lit(j).alias("judge"), F.lit(d).alias("dimension"))
                       for j in S.JUDGES for d in V.ALL_DIMS])
    return p.select("item_id", F.explode(combos).alias("c")).select("item_id", "c.judge", "c.dimension")


def valid(spark, sf):
    return V.parse_verdicts(S.fx_verdicts(spark, sf)).where(F.col("verdict").isNotNull())


def pending_rows_df(spark, sf):
    return R.pending(wanted(spark, sf), valid(spark, sf), ["item_id", "judge", "dimension"])


PEND_SQL = ("pend", """
SELECT p.item_id, j.judge, d.dimension FROM fx_pairs p
CROSS JOIN (VALUES ('j1'), ('j2')) j(judge)
CROSS JOIN (VALUES ('empathy'), ('quality'), ('preservation'), ('unsupported_addition')) d(dimension)
WHERE p.generated_answer <> ''
  AND NOT EXISTS (SELECT 1 FROM ox_long l WHERE l.item_id = p.item_id AND l.judge = j.judge
                  AND l.dimension = d.dimension AND l.verdict IS NOT NULL)""")


def pend(sql: str) -> str:
    return with_fx(sql, "fx_pairs", "fx_verdicts", extra=WIDE_CTES + [PEND_SQL])


@register("pending_rows", pend("SELECT * FROM pend"))
def pending_rows(spark, sf):
    """Wanted (item x judge x dimension) work units without a valid verdict (left anti join)."""
    return pending_rows_df(spark, sf)


@register("next_n_pending", pend(f"SELECT * FROM pend ORDER BY judge, dimension, item_id LIMIT {NEXT_N}"))
def next_n_pending(spark, sf):
    """The next batch of N pending work units in a fixed order (the limit is the feature)."""
    return R.first_rows(pending_rows_df(spark, sf), NEXT_N, ["judge", "dimension", "item_id"])


@register("generation_pending", with_fx("SELECT item_id, category FROM fx_pairs WHERE trim(generated_answer) = ''", "fx_pairs"))
def generation_pending(spark, sf):
    """Items that still need an edited answer."""
    return R.generation_pending(S.fx_pairs(spark, sf), "generated_answer").select("item_id", "category")


@register("explanation_pending", with_fx("""
SELECT item_id, judge, dimension FROM ox_long WHERE dimension IN ('empathy', 'quality') AND pred_source = 'Original'
  AND substr(md5(concat(item_id, judge)), 1, 1) >= '4'""", "fx_pairs", "fx_verdicts", extra=WIDE_CTES))
def explanation_pending(spark, sf):
    """Preference verdicts for the original that have neither a stored explanation nor a stored error of one yet.

    A quarter is settled: half of it by an explanation, half by an error."""
    digit = F.substring(F.md5(F.concat("item_id", "judge")), 1, 1)
    lv = long_verdicts(spark, sf).where(F.col("dimension").isin(*V.PREFERENCE_DIMS)).withColumns({
        "explanation": F.when(digit < "2", F.lit("explained")), "explanation_error": F.when(digit.isin("2", "3"), F.lit("HTTP 503"))})
    return R.explanation_pending(lv, "pred_source", "explanation", error_col="explanation_error").select("item_id", "judge", "dimension")


@register("distinct_union", pend("""
SELECT item_id FROM pend WHERE dimension IN ('empathy', 'quality')
UNION SELECT item_id FROM pend WHERE dimension IN ('preservation', 'unsupported_addition')"""))
def distinct_union(spark, sf):
    """Items pending a preference verdict or a factual check, each once."""
    p = pending_rows_df(spark, sf)
    a = p.where(F.col("dimension").isin(*V.PREFERENCE_DIMS)).select("item_id")
    b = p.where(F.col("dimension").isin(*V.FACTUAL_DIMS)).select("item_id")
    return a.union(b).distinct()


@register("select_ids", with_fx("""
SELECT v.item_id, v.judge, v.dimension, v.raw_response FROM fx_verdicts v
WHERE v.item_id IN (SELECT item_id FROM fx_verdicts WHERE raw_response = 'cannot decide')""", "fx_verdicts"))
def select_ids(spark, sf):
    """All verdict rows of a chosen id list (here: items some judge could not decide), by semi join."""
    v = S.fx_verdicts(spark, sf)
    ids = v.where(F.col("raw_response") == "cannot decide").select("item_id")
    return v.join(ids, "item_id", "left_semi").select("item_id", "judge", "dimension", "raw_response")


@register("view_join", with_fx(f"""
SELECT r.item_id, r.gold_choice, r.response_order, coalesce(l.judge_model, '{RUN_JUDGE}') AS judge_model,
  coalesce(l.prompt_variant, '{RUN_VARIANT}') AS prompt_variant, l.seq, l.value
FROM rnd r LEFT JOIN (SELECT * FROM last WHERE {IN_RUN}) l ON l.item_id = r.item_id""",
                               "fx_rephrase", "fx_results",
                               extra=[("screened", SCREENED_SQL), ("rnd", RANDOM_SQL), RES_SQL, LAST_SQL]))
def view_join(spark, sf):
    """Items + gold + order left-joined with the latest results of one run; run constants filled."""
    items = randomized(spark, sf).select("item_id", "gold_choice", "response_order")
    last = R.dedupe_keep_last(stored(spark, sf).where(run_pred()), KEYS, ["scored_at", "seq"])
    j = items.join(last.select(*KEYS, "seq", "value"), "item_id", "left")
    return j.select("item_id", "gold_choice", "response_order",
                    F.coalesce("judge_model", F.lit(RUN_JUDGE)).alias("judge_model"),
                    F.coalesce("prompt_variant", F.lit(RUN_VARIANT)).alias("prompt_variant"), "seq", "value")


@register("attach_generation", with_fx("""
SELECT v.item_id, v.judge, v.dimension, md5(p.generated_answer) AS gen_md5, p.generated_answer = '' AS pending_generation
FROM fx_verdicts v LEFT JOIN fx_pairs p ON p.item_id = v.item_id""", "fx_verdicts"))
def attach_generation(spark, sf):
    """Judge rows refreshed from the generation master by id (never by row position)."""
    g = S.fx_pairs(spark, sf).select("item_id", "generated_answer")
    j = S.fx_verdicts(spark, sf).join(g, "item_id", "left")
    return j.select("item_id", "judge", "dimension", F.md5("generated_answer").alias("gen_md5"),
                    (F.col("generated_answer") == "").alias("pending_generation"))


GUARD_ROWS_SQL = ("guarded", """
SELECT v.item_id, v.judge, v.category, v.raw_response AS raw_judge_response,
  CASE WHEN v.category IN ('cat2', 'cat3') THEN '' ELSE p.generated_answer END AS generated_empathy_answer,
  CASE WHEN v.category IN ('cat0', 'cat1') THEN 'v1' ELSE 'v3' END AS generation_prompt_variant
FROM fx_verdicts v JOIN fx_pairs p ON p.item_id = v.item_id WHERE v.dimension = 'empathy'""")


def guarded_rows(spark, sf):
    """Result rows of 16 generation runs (categories): two made with another prompt variant, two
    without any generated answer."""
    p = S.fx_pairs(spark, sf).select("item_id", "generated_answer")
    v = S.fx_verdicts(spark, sf).where(F.col("dimension") == "empathy").join(p, "item_id")
    c = F.col("category")
    return v.select("item_id", "judge", "category", F.col("raw_response").alias("raw_judge_response"),
                    F.when(c.isin("cat2", "cat3"), F.lit("")).otherwise(F.col("generated_answer")).alias("generated_empathy_answer"),
                    F.when(c.isin("cat0", "cat1"), F.lit("v1")).otherwise(F.lit("v3")).alias("generation_prompt_variant"))


@register("variant_guard", with_fx("""
SELECT g.item_id, g.judge, CASE WHEN r.other = 1 OR r.made = 0 THEN '' ELSE g.raw_judge_response END AS raw_judge_response,
  md5(CASE WHEN r.other = 1 THEN '' ELSE g.generated_empathy_answer END) AS generated_md5,
  CASE WHEN r.other = 1 THEN '' ELSE g.generation_prompt_variant END AS generation_prompt_variant
FROM guarded g JOIN (SELECT category, max(CASE WHEN trim(generated_empathy_answer) <> '' AND generation_prompt_variant <> 'v3' THEN 1 ELSE 0 END) AS other,
    max(CASE WHEN trim(generated_empathy_answer) <> '' THEN 1 ELSE 0 END) AS made FROM guarded GROUP BY category) r ON r.category = g.category""",
    "fx_pairs", "fx_verdicts", extra=[GUARD_ROWS_SQL]))
def variant_guard(spark, sf):
    """Generation runs with a generated row of another variant lose all outputs; runs without a
    generated row lose their judge outputs."""
    g = R.variant_guard(guarded_rows(spark, sf), ["category"], "generated_empathy_answer", "generation_prompt_variant", "v3")
    return g.select("item_id", "judge", "raw_judge_response", F.md5("generated_empathy_answer").alias("generated_md5"), "generation_prompt_variant")


@register("blank_outputs", with_fx("""
SELECT 'all' AS mode, item_id, judge, '' AS raw_judge_response, md5('') AS generated_md5, '' AS generation_prompt_variant FROM guarded
UNION ALL
SELECT 'judge', item_id, judge, '', md5(generated_empathy_answer), generation_prompt_variant FROM guarded""",
    "fx_pairs", "fx_verdicts", extra=[GUARD_ROWS_SQL]))
def blank_outputs(spark, sf):
    """Output columns cleared in two modes: generation and judge columns, or judge columns only."""
    rows, out = guarded_rows(spark, sf), None
    for mode, generation in (("all", True), ("judge", False)):
        part = R.blank_outputs(rows, generation=generation).select(
            F.lit(mode).alias("mode"), "item_id", "judge", "raw_judge_response", F.md5("generated_empathy_answer").alias("generated_md5"),
            "generation_prompt_variant")
        out = part if out is None else out.unionByName(part)
    return out


@register("init_or_resume", with_fx("""
SELECT o.item_id, j.judge, o.gold_choice, o.response_order, w.empathy_v, w.quality_v
FROM ox_order o CROSS JOIN (VALUES ('j1'), ('j2')) j(judge) LEFT JOIN ox_wide w ON w.item_id = o.item_id AND w.judge = j.judge""",
                                    "fx_pairs", "fx_verdicts", extra=WIDE_CTES))
def init_or_resume(spark, sf):
    """Items initialised with their balanced order for every judge, resumed with any stored verdicts."""
    o = pairs_order(spark, sf).select("item_id", "gold_choice", "response_order",
                                      F.explode(F.array(*[F.lit(j) for j in S.JUDGES])).alias("judge"))
    w = wide_verdicts(spark, sf).select("item_id", "judge", "empathy_v", "quality_v")
    return o.join(w, ["item_id", "judge"], "left")


@register("run_summary", with_fx("""
SELECT judge, count(*) AS attempted,
  count(*) FILTER (WHERE dimension = 'empathy' AND verdict IS NOT NULL) AS done_empathy,
  count(*) FILTER (WHERE dimension = 'quality' AND verdict IS NOT NULL) AS done_quality,
  count(*) FILTER (WHERE dimension = 'preservation' AND verdict IS NOT NULL) AS done_preservation,
  count(*) FILTER (WHERE dimension = 'unsupported_addition' AND verdict IS NOT NULL) AS done_unsupported_addition,
  count(*) FILTER (WHERE verdict IS NULL) AS failed,
  arg_max(item_id, attempt) FILTER (WHERE verdict IS NULL) AS last_failed_id,
  arg_max(CASE WHEN dimension IN ('empathy', 'quality') THEN 'Could not parse A/B' ELSE 'Could not parse Yes/No' END, attempt)
    FILTER (WHERE verdict IS NULL) AS last_error
FROM (SELECT *, md5(concat_ws('|', 'at', item_id, judge, dimension)) AS attempt FROM ox_long) GROUP BY judge""", "fx_pairs", "fx_verdicts", extra=WIDE_CTES))
def run_summary(spark, sf):
    """Per judge: attempted, done per dimension, failed, and id and error of the latest failed attempt
    (attempts are timed by a hash here)."""
    lv = long_verdicts(spark, sf)
    ok = F.col("verdict").isNotNull()
    attempt = F.when(~ok, F.md5(F.concat_ws("|", F.lit("at"), "item_id", "judge", "dimension")))
    error = F.when(F.col("dimension").isin(*V.PREFERENCE_DIMS), F.lit("Could not parse A/B")).otherwise(F.lit("Could not parse Yes/No"))
    return lv.groupBy("judge").agg(
        F.count(F.lit(1)).alias("attempted"),
        *[F.count_if((F.col("dimension") == d) & ok).alias(f"done_{d}") for d in V.ALL_DIMS],
        F.count_if(~ok).alias("failed"), F.max_by("item_id", attempt).alias("last_failed_id"), F.max_by(error, attempt).alias("last_error"))


# --- row views ---------------------------------------------------------------------------------
def _inspect_base(spark, sf):
    w = wide_verdicts(spark, sf).join(S.fx_pairs(spark, sf).select("item_id", "generated_answer"), "item_id")
    err = "Could not parse verdict"
    for d in V.ALL_DIMS:
        w = w.withColumn(f"{d}_error", F.when(F.col(f"{d}_v").isNull(), F.lit(err)))
    for d in V.PREFERENCE_DIMS:
        w = w.withColumn(f"{d}_mismatch_explanation", F.lit(None).cast("string")) \
             .withColumn(f"{d}_mismatch_error", F.lit(None).cast("string"))
    return w.withColumn("generation_error", F.lit(None).cast("string"))


def _blank(c: str):
    return F.btrim(F.coalesce(F.col(c), F.lit(""))) == ""


def inspect_filters() -> dict:
    c = F.col
    gen_blank = _blank("generated_answer")
    both = c("empathy_v").isin("A", "B") & c("quality_v").isin("A", "B")
    p_ans, u_ans = F.coalesce(c("preservation_v"), F.lit("")), F.coalesce(c("unsupported_addition_v"), F.lit(""))
    complete = p_ans.isin("Yes", "No") & u_ans.isin("Yes", "No")
    passed = (p_ans == "Yes") & (u_ans == "No")
    es, qs = F.coalesce(c("empathy_src"), F.lit("")), F.coalesce(c("quality_src"), F.lit(""))
    return {
        "All": F.lit(True),
        "Pending generation": gen_blank,
        "Generated not judged for both": ~gen_blank & ~F.coalesce(both, F.lit(False)),
        "Judged for both": both,
        "Empathy preferred Generated": es == "Generated",
        "Empathy preferred Original": es == "Original",
        "Quality preferred Generated": qs == "Generated",
        "Quality preferred Original": qs == "Original",
        "Needs mismatch explanation": ((es == "Original") & _blank("empathy_mismatch_explanation") & _blank("empathy_mismatch_error"))
        | ((qs == "Original") & _blank("quality_mismatch_explanation") & _blank("quality_mismatch_error")),
        "Has mismatch explanation": ~_blank("empathy_mismatch_explanation") | ~_blank("quality_mismatch_explanation"),
        "Generation errors": ~_blank("generation_error"),
        "Empathy judge errors": ~_blank("empathy_error"),
        "Quality judge errors": ~_blank("quality_error"),
        "Factual checks complete": complete,
        "Factual pass": passed,
        "Factual fail": complete & ~passed,
        "Preservation failed": p_ans == "No",
        "Unsupported additions": u_ans == "Yes",
        "Factual check errors": ~_blank("preservation_error") | ~_blank("unsupported_addition_error"),
        "Mismatch explanation errors": ~_blank("empathy_mismatch_error") | ~_blank("quality_mismatch_error"),
    }


INSPECT_SQL = ("insp", """
SELECT w.*, p.generated_answer,
  CASE WHEN w.empathy_v IS NULL THEN 'x' END AS empathy_error, CASE WHEN w.quality_v IS NULL THEN 'x' END AS quality_error,
  CASE WHEN w.preservation_v IS NULL THEN 'x' END AS preservation_error,
  CASE WHEN w.unsupported_addition_v IS NULL THEN 'x' END AS unsupported_addition_error
FROM ox_wide w JOIN fx_pairs p USING (item_id)""")

INSPECT_FILTER_SQL = {
    "All": "true",
    "Pending generation": "trim(coalesce(generated_answer, '')) = ''",
    "Generated not judged for both": "trim(coalesce(generated_answer, '')) <> '' AND NOT (coalesce(empathy_v, '') IN ('A', 'B') AND coalesce(quality_v, '') IN ('A', 'B'))",
    "Judged for both": "coalesce(empathy_v, '') IN ('A', 'B') AND coalesce(quality_v, '') IN ('A', 'B')",
    "Empathy preferred Generated": "coalesce(empathy_src, '') = 'Generated'",
    "Empathy preferred Original": "coalesce(empathy_src, '') = 'Original'",
    "Quality preferred Generated": "coalesce(quality_src, '') = 'Generated'",
    "Quality preferred Original": "coalesce(quality_src, '') = 'Original'",
    "Needs mismatch explanation": "coalesce(empathy_src, '') = 'Original' OR coalesce(quality_src, '') = 'Original'",
    "Has mismatch explanation": "false",
    "Generation errors": "false",
    "Empathy judge errors": "empathy_error IS NOT NULL",
    "Quality judge errors": "quality_error IS NOT NULL",
    "Factual checks complete": "coalesce(preservation_v, '') IN ('Yes', 'No') AND coalesce(unsupported_addition_v, '') IN ('Yes', 'No')",
    "Factual pass": "coalesce(preservation_v, '') = 'Yes' AND coalesce(unsupported_addition_v, '') = 'No'",
    "Factual fail": "coalesce(preservation_v, '') IN ('Yes', 'No') AND coalesce(unsupported_addition_v, '') IN ('Yes', 'No') AND NOT (coalesce(preservation_v, '') = 'Yes' AND coalesce(unsupported_addition_v, '') = 'No')",
    "Preservation failed": "coalesce(preservation_v, '') = 'No'",
    "Unsupported additions": "coalesce(unsupported_addition_v, '') = 'Yes'",
    "Factual check errors": "preservation_error IS NOT NULL OR unsupported_addition_error IS NOT NULL",
    "Mismatch explanation errors": "false",
}


def insp(sql: str) -> str:
    return with_fx(sql, "fx_pairs", "fx_verdicts", extra=WIDE_CTES + [INSPECT_SQL])


@register("inspect_filter", insp("\nUNION ALL\n".join(
    f"SELECT '{n}' AS filter_name, judge, item_id FROM insp WHERE {p}" for n, p in INSPECT_FILTER_SQL.items())))
def inspect_filter(spark, sf):
    """All 20 named row filters of the answer-editing view, in one pass (filter_name, judge, item)."""
    return R.named_filters(_inspect_base(spark, sf), inspect_filters(), ["judge", "item_id"])


def state_filters() -> dict:
    c = F.col
    pc, gc = F.coalesce(c("pred_choice"), F.lit("")), c("gold_choice")
    ps, gs = F.coalesce(c("pred_source"), F.lit("")), c("gold_source")
    f = {"pending": c("raw_response").isNull(), "scored": pc.isin("A", "B"), "failed": ~pc.isin("A", "B"),
         "correct": pc.isin("A", "B") & (pc == gc), "mismatches": pc.isin("A", "B") & (pc != gc)}
    for g in ("A", "B"):
        for p in ("A", "B"):
            f[f"gold_{g}_pred_{p}"] = (gc == g) & (pc == p)
    for g in ("Physician", "ChatGPT"):
        for p in ("Physician", "ChatGPT"):
            f[f"gold_{g}_pred_{p}"] = (gs == g) & (ps == p)
    return f


STATE_SQL = {"pending": "raw_response IS NULL", "scored": "coalesce(pred_choice, '') IN ('A', 'B')",
             "failed": "coalesce(pred_choice, '') NOT IN ('A', 'B')",
             "correct": "coalesce(pred_choice, '') IN ('A', 'B') AND pred_choice = gold_choice",
             "mismatches": "coalesce(pred_choice, '') IN ('A', 'B') AND pred_choice <> gold_choice"}
for _g in ("A", "B"):
    for _p in ("A", "B"):
        STATE_SQL[f"gold_{_g}_pred_{_p}"] = f"gold_choice = '{_g}' AND pred_choice = '{_p}'"
for _g in ("Physician", "ChatGPT"):
    for _p in ("Physician", "ChatGPT"):
        STATE_SQL[f"gold_{_g}_pred_{_p}"] = f"gold_source = '{_g}' AND pred_source = '{_p}'"


@register("state_filter", with_fx("\nUNION ALL\n".join(
    f"SELECT '{n}' AS filter_name, judge, dimension, item_id FROM cal WHERE {p}" for n, p in STATE_SQL.items()),
    "fx_ratings", extra=CAL_CTES))
def state_filter(spark, sf):
    """Calibration-run row states and gold x predicted cells, all filters in one pass."""
    return R.named_filters(cal_view(spark, sf), state_filters(), ["judge", "dimension", "item_id"])


DISPLAY_COLS = ["item_id", "judge", "category", "question_word_count", "answer_word_count", "response_order", "gold_choice",
                "empathy_src", "quality_src", "preservation_v", "unsupported_addition_v",
                "empathy_mismatch_explanation", "quality_mismatch_explanation", "generation_error",
                "empathy_error", "quality_error"]


@register("preview_projection", insp("""
SELECT item_id, judge, coalesce(response_order, '') AS response_order, coalesce(gold_choice, '') AS gold_choice,
  coalesce(empathy_src, '') AS empathy_src, coalesce(quality_src, '') AS quality_src,
  coalesce(preservation_v, '') AS preservation_v, coalesce(unsupported_addition_v, '') AS unsupported_addition_v,
  '' AS empathy_mismatch_explanation, '' AS quality_mismatch_explanation, '' AS generation_error,
  coalesce(empathy_error, '') AS empathy_error, coalesce(quality_error, '') AS quality_error
FROM insp"""))
def preview_projection(spark, sf):
    """Fixed display columns of every judge's rows (absent columns skipped, NULL shown as '')."""
    b = _inspect_base(spark, sf)
    b = b.withColumn("empathy_error", F.when(F.col("empathy_error").isNotNull(), F.lit("x"))) \
         .withColumn("quality_error", F.when(F.col("quality_error").isNotNull(), F.lit("x")))
    return R.preview_projection(b, DISPLAY_COLS)


@register("preview_top", insp(f"""
SELECT judge, item_id, gold_choice, preservation_v, unsupported_addition_v
FROM (SELECT *, row_number() OVER (PARTITION BY judge ORDER BY item_id) AS rn FROM insp WHERE {INSPECT_FILTER_SQL['Factual fail']})
WHERE rn <= {PREVIEW_MAX}"""))
def preview_top(spark, sf):
    """First min(200, n) rows (by id) of each judge's factual failures (the limit is the feature)."""
    b = _inspect_base(spark, sf).where(inspect_filters()["Factual fail"])
    return R.first_rows(b, PREVIEW_MAX, ["item_id"], ["judge"]).select("judge", "item_id", "gold_choice", "preservation_v", "unsupported_addition_v")


@register("stream_keep_last", rs("SELECT * FROM last"))
def stream_keep_last(spark, sf):
    """The stored results replayed as a file stream (several micro-batches) into a keep-last
    upsert store; its state equals the batch keep-last."""
    from pairjudge.sources.io import scratch_path
    from pairjudge.streaming.upsert import read_upserted, start_upsert
    src = stored(spark, sf)
    incoming = scratch_path(spark, "stream-in")
    src.repartition(6, "item_id").write.mode("overwrite").parquet(incoming)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(incoming)
    store = scratch_path(spark, "stream-store")
    q = start_upsert(stream, store, KEYS, ["scored_at", "seq"], partition_cols=["judge_model"])
    q.awaitTermination()
    return read_upserted(spark, store, KEYS, ["scored_at", "seq"]).select(*KEYS, "seq", "value")
