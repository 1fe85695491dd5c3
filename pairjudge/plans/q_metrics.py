"""Registered queries: source mapping, confusion tables, classification metrics, dashboard counts
and per-setting outcome summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairjudge.functions import stats as ST
from pairjudge.functions import text as T
from pairjudge.operators import agreement as AG
from pairjudge.operators import metrics as M
from pairjudge.operators import resample as RS
from pairjudge.operators import verdicts as V
from pairjudge.plans.common import (OUTCOME_CTES, WIDE_CTES, wide_verdicts, long_verdicts, outcomes,
                                    choice_sql, wc)
from pairjudge.plans.oracle_fx import with_fx
from pairjudge.plans.q_screen import GOLD_SQL, SHUFFLE_SQL, shuffled
from pairjudge.plans.q_stats import wilson_sql
from pairjudge.plans.registry import register
from pairjudge.plans.sqlgen import confusion_sql, metrics_sql
from pairjudge.sources import tables as S

# --- two-source calibration run: order x judges -> verdicts ------------------------------------


def cal_view(spark, sf):
    """Judge verdicts on the balanced two-source order (per dimension), mapped back to sources."""
    sh = shuffled(spark, sf)
    x = sh.select("item_id", "dimension", "gold_source", "gold_choice", "response_order", "diff_abs",
                  F.explode(F.array(F.lit("j1"), F.lit("j2"))).alias("judge"))
    h = T.stable_hash("judge", "dimension", "item_id")
    h1, h2 = F.substring(h, 1, 1), F.substring(h, 2, 1)
    other = F.when(F.col("gold_choice") == "A", F.lit("B")).otherwise(F.lit("A"))
    raw = (F.when(h1 == "9", F.lit("A.")).when(h1 == "a", F.lit("Answer: B")).when(h1 == "b", F.lit("**A**"))
           .when(h1 == "c", F.lit("b")).when(h1 == "d", F.lit("cannot decide")).when(h1 == "e", F.lit(""))
           .when(h1 == "f", F.lit(None).cast("string"))
           .otherwise(F.when(h2 < "c", F.col("gold_choice")).otherwise(other)))
    x = x.withColumn("raw_response", raw).withColumn("pred_choice", T.parse_choice("raw_response"))
    x = x.withColumn("pred_source", V.pred_source_from_order(F.col("response_order"), F.col("pred_choice")))
    return x.withColumn("error_type", V.source_error_type(F.col("gold_source"), F.col("pred_source")))


def _pred_src_sql(order: str, choice: str) -> str:
    def at(letter):
        part = f"list_filter(string_split({order}, '__'), lambda p: suffix(p, '_{letter}'))[1]"
        return f"substr({part}, 1, length({part}) - 2)"
    return f"(CASE {choice} WHEN 'A' THEN {at('A')} WHEN 'B' THEN {at('B')} END)"


CAL_SQL = f"""
SELECT *, CASE WHEN coalesce(pred_source, '') NOT IN ('Physician', 'ChatGPT') THEN ''
               WHEN gold_source = pred_source THEN 'Correct'
               WHEN gold_source = 'Physician' AND pred_source = 'ChatGPT' THEN 'Judge favored ChatGPT; gold favored Physician'
               WHEN gold_source = 'ChatGPT' AND pred_source = 'Physician' THEN 'Judge favored Physician; gold favored ChatGPT'
               ELSE 'Mismatch' END AS error_type
FROM (SELECT *, {_pred_src_sql('response_order', 'pred_choice')} AS pred_source
  FROM (SELECT *, {choice_sql('raw_response')} AS pred_choice
    FROM (SELECT s.item_id, s.dimension, s.gold_source, s.gold_choice, s.response_order, s.diff_abs, j.judge,
            CASE substr(md5(concat_ws('||', j.judge, s.dimension, s.item_id)), 1, 1)
              WHEN '9' THEN 'A.' WHEN 'a' THEN 'Answer: B' WHEN 'b' THEN '**A**' WHEN 'c' THEN 'b'
              WHEN 'd' THEN 'cannot decide' WHEN 'e' THEN '' WHEN 'f' THEN NULL
              ELSE CASE WHEN substr(md5(concat_ws('||', j.judge, s.dimension, s.item_id)), 2, 1) < 'c'
                        THEN s.gold_choice ELSE CASE WHEN s.gold_choice = 'A' THEN 'B' ELSE 'A' END END END AS raw_response
          FROM sh s CROSS JOIN (VALUES ('j1'), ('j2')) j(judge))))"""

CAL_CTES = [("gold", GOLD_SQL), ("sh", SHUFFLE_SQL), ("cal", CAL_SQL)]


def cal(sql: str) -> str:
    return with_fx(sql, "fx_ratings", extra=CAL_CTES)


@register("pred_source", cal("SELECT item_id, dimension, judge, pred_source FROM cal"))
def pred_source(spark, sf):
    """Predicted letter -> source name, read from the order label."""
    return cal_view(spark, sf).select("item_id", "dimension", "judge", "pred_source")


@register("source_error_type", cal("SELECT item_id, dimension, judge, error_type FROM cal"))
def source_error_type(spark, sf):
    return cal_view(spark, sf).select("item_id", "dimension", "judge", "error_type")


@register("add_match", cal("""
SELECT item_id, dimension, judge, CASE WHEN pred_choice IN ('A', 'B') THEN CAST(gold_choice = pred_choice AS INTEGER) END AS is_match
FROM cal"""))
def add_match(spark, sf):
    x = V.add_match(cal_view(spark, sf), "gold_choice", "pred_choice")
    return x.select("item_id", "dimension", "judge", "is_match")


@register("confusion_matrix", cal("SELECT * FROM (" + confusion_sql(
    "(SELECT * FROM cal WHERE pred_choice IN ('A', 'B'))", ["judge", "dimension"], "gold_choice", "pred_choice",
    ["A", "B"]) + ")"))
def confusion_matrix(spark, sf):
    """Gold letter x predicted letter per judge and dimension, fixed labels, zero-filled."""
    return M.confusion(cal_view(spark, sf), ["judge", "dimension"], F.col("gold_choice"), F.col("pred_choice"),
                       ["A", "B"])


@register("letter_metrics", cal(metrics_sql("cal", ["judge", "dimension"], "gold_choice", "pred_choice", ["A", "B"])))
def letter_metrics(spark, sf):
    """Accuracy, macro / weighted P-R-F1, per-letter P-R-F1 and mismatches per judge and dimension."""
    return M.classification_metrics(cal_view(spark, sf), ["judge", "dimension"], "gold_choice", "pred_choice",
                                    ["A", "B"])


@register("source_metrics", cal(metrics_sql("cal", ["judge", "dimension"], "gold_source", "pred_source",
                                            ["Physician", "ChatGPT"], ["physician", "chatgpt"], totals=True)))
def source_metrics(spark, sf):
    return M.classification_metrics(cal_view(spark, sf), ["judge", "dimension"], "gold_source", "pred_source",
                                    ["Physician", "ChatGPT"], ["physician", "chatgpt"], totals=True)


def _metric_table_sql() -> str:
    m = metrics_sql("cal", ["judge", "dimension"], "gold_choice", "pred_choice", ["A", "B"])
    parts = []
    for lab, pre in (("A", "_A"), ("B", "_B")):
        parts.append(f"SELECT judge, dimension, '{lab}' AS label, precision{pre} AS precision, recall{pre} AS recall, f1{pre} AS f1 FROM m")
    for lab, pre in (("macro avg", "macro"), ("weighted avg", "weighted")):
        parts.append(f"SELECT judge, dimension, '{lab}', {pre}_precision, {pre}_recall, {pre}_f1 FROM m")
    return f"SELECT * FROM (WITH m AS ({m})\n" + "\nUNION ALL\n".join(parts) + ")"


@register("metric_table", cal(_metric_table_sql()))
def metric_table(spark, sf):
    m = M.classification_metrics(cal_view(spark, sf), ["judge", "dimension"], "gold_choice", "pred_choice", ["A", "B"])
    return M.metric_table(m, ["judge", "dimension"], ["A", "B"])


@register("match_summary", cal("""
SELECT judge, dimension, count(*) AS attempted,
  count(*) FILTER (WHERE pred_choice IN ('A', 'B')) AS scored,
  count(*) FILTER (WHERE pred_choice IN ('A', 'B') AND pred_choice = gold_choice) AS correct,
  count(*) FILTER (WHERE pred_choice IN ('A', 'B') AND pred_choice <> gold_choice) AS wrong,
  count(*) FILTER (WHERE pred_choice IS NULL) AS failed,
  count(*) FILTER (WHERE pred_choice = 'A') AS pred_a, count(*) FILTER (WHERE pred_choice = 'B') AS pred_b
FROM cal GROUP BY judge, dimension"""))
def match_summary(spark, sf):
    c = F.col("pred_choice")
    scored = c.isin("A", "B")
    return cal_view(spark, sf).groupBy("judge", "dimension").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(scored).alias("scored"),
        F.count_if(scored & (c == F.col("gold_choice"))).alias("correct"),
        F.count_if(scored & (c != F.col("gold_choice"))).alias("wrong"),
        F.count_if(c.isNull()).alias("failed"), F.count_if(c == "A").alias("pred_a"),
        F.count_if(c == "B").alias("pred_b"))


@register("mismatch_ranking", cal("""
SELECT judge, dimension, error_type, n, row_number() OVER (PARTITION BY judge, dimension ORDER BY n DESC, error_type) AS rank
FROM (SELECT judge, dimension, error_type, count(*) AS n FROM cal
      WHERE error_type NOT IN ('', 'Correct') GROUP BY judge, dimension, error_type)"""))
def mismatch_ranking(spark, sf):
    """Mismatch directions by descending count (the ranking window runs on the aggregated table)."""
    g = cal_view(spark, sf).where(~F.col("error_type").isin("", "Correct")).groupBy(
        "judge", "dimension", "error_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("judge", "dimension").orderBy(F.desc("n"), "error_type")
    return g.withColumn("rank", F.row_number().over(w).cast("bigint"))


def _kappa_labels_sql(src: str, a: str, b: str, keys: list[str], basis: str) -> str:
    kk = ", ".join(keys)
    return f"""
SELECT {kk}, '{basis}' AS basis, CAST(t.n AS BIGINT) AS n, CAST(t.agree AS DOUBLE) / t.n AS pct_agree,
  (CAST(t.agree AS DOUBLE) / t.n - p.pe) / nullif(1 - p.pe, 0) AS kappa
FROM (SELECT {kk}, sum(c) AS n, sum(c) FILTER (WHERE a = b) AS agree FROM cells_{basis} GROUP BY {kk}) t
JOIN (SELECT ma.{keys[0]}, {', '.join('ma.' + k for k in keys[1:])}{', ' if len(keys) > 1 else ''}
             sum(CAST(ma.ca * coalesce(mb.cb, 0) AS DOUBLE) / tt.n / tt.n) AS pe
      FROM (SELECT {kk}, a AS l, sum(c) AS ca FROM cells_{basis} GROUP BY {kk}, a) ma
      LEFT JOIN (SELECT {kk}, b AS l, sum(c) AS cb FROM cells_{basis} GROUP BY {kk}, b) mb
        ON {' AND '.join(f'mb.{k} = ma.{k}' for k in keys)} AND mb.l = ma.l
      JOIN (SELECT {kk}, sum(c) AS n FROM cells_{basis} GROUP BY {kk}) tt ON {' AND '.join(f'tt.{k} = ma.{k}' for k in keys)}
      GROUP BY {', '.join('ma.' + k for k in keys)}) p USING ({kk})""", \
        f"(SELECT {kk}, {a} AS a, {b} AS b, count(*) AS c FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {kk}, {a}, {b})"


def _strength_sql(k: str) -> str:
    return (f"(CASE WHEN {k} IS NULL OR isnan({k}) THEN 'undefined' WHEN {k} < 0 THEN 'poor' WHEN {k} < 0.2 THEN 'slight' "
            f"WHEN {k} < 0.4 THEN 'fair' WHEN {k} < 0.6 THEN 'moderate' WHEN {k} < 0.8 THEN 'substantial' "
            f"ELSE 'almost perfect' END)")


def _gold_agreement_sql() -> str:
    pos, cpos = _kappa_labels_sql("cal", "gold_choice", "pred_choice", ["judge", "dimension"], "position")
    src, csrc = _kappa_labels_sql("cal", "gold_source", "pred_source", ["judge", "dimension"], "source")
    return cal(f"""
SELECT *, {_strength_sql('kappa')} AS strength FROM (
WITH cells_position AS {cpos}, cells_source AS {csrc}
{pos}
UNION ALL
{src})""")


@register("gold_agreement", _gold_agreement_sql())
def gold_agreement(spark, sf):
    """Cohen's kappa of each judge against the gold, by letter (balanced) and by source (skewed):
    both bases stacked into one long frame and aggregated together (one pass over the view)."""
    v = cal_view(spark, sf).select(
        "judge", "dimension",
        F.expr("stack(2, 'position', gold_choice, pred_choice, 'source', gold_source, pred_source) AS (basis, a, b)"))
    return AG.cohen_kappa_labels(v, "a", "b", ["judge", "dimension", "basis"])


_clo, _chi = wilson_sql("n - err")


@register("calibration_table", cal(f"""
SELECT judge, dimension, n, err, CAST(n - err AS DOUBLE) / n AS accuracy, {_clo} AS ci_low, {_chi} AS ci_high
FROM (SELECT judge, dimension, count(*) AS n, count(*) FILTER (WHERE pred_choice <> gold_choice) AS err
      FROM cal WHERE pred_choice IN ('A', 'B') GROUP BY judge, dimension)"""))
def calibration_table(spark, sf):
    """Accuracy = (n - errors) / n with a Wilson interval, per judge x task."""
    v = cal_view(spark, sf).where(F.col("pred_choice").isin("A", "B"))
    g = v.groupBy("judge", "dimension").agg(F.count(F.lit(1)).alias("n"),
                                            F.count_if(F.col("pred_choice") != F.col("gold_choice")).alias("err"))
    ok = F.col("n") - F.col("err")
    return g.select("judge", "dimension", "n", "err", (ok / F.col("n").cast("double")).alias("accuracy"),
                    ST.wilson_low(ok, "n").alias("ci_low"), ST.wilson_high(ok, "n").alias("ci_high"))


# --- answer-editing run (no human gold): dashboards -------------------------------------------
def wide(sql: str) -> str:
    return with_fx(sql, "fx_pairs", "fx_verdicts", extra=WIDE_CTES)


def _scored_long(spark, sf):
    return long_verdicts(spark, sf).where(F.col("dimension").isin(*V.PREFERENCE_DIMS))


SCORED_LONG = "(SELECT * FROM ox_long WHERE dimension IN ('empathy', 'quality') AND verdict IN ('A', 'B'))"


@register("position_diagnostic", wide("SELECT * FROM (" + confusion_sql(
    SCORED_LONG, ["judge", "dimension"], "gold_choice", "verdict", ["B", "A"], ["A", "B"], "target_letter") + ")"))
def position_diagnostic(spark, sf):
    """Target (generated) letter x chosen letter, per judge and preference dimension."""
    x = _scored_long(spark, sf).where(F.col("verdict").isin("A", "B"))
    return M.confusion(x, ["judge", "dimension"], F.col("gold_choice"), F.col("verdict"), ["B", "A"], ["A", "B"],
                       label_col="target_letter")


ORDERS = ["Original_A__Generated_B", "Generated_A__Original_B"]


@register("source_by_order", wide("SELECT * FROM (" + confusion_sql(
    SCORED_LONG, ["judge", "dimension"], "response_order", "pred_source", ORDERS, ["Original", "Generated"],
    "response_order", ["pred_original", "pred_generated"]) + ")"))
def source_by_order(spark, sf):
    x = _scored_long(spark, sf).where(F.col("verdict").isin("A", "B"))
    return M.confusion(x, ["judge", "dimension"], F.col("response_order"), F.col("pred_source"), ORDERS,
                       ["Original", "Generated"], label_col="response_order",
                       names=["pred_original", "pred_generated"])


@register("preference_summary", wide("""
SELECT judge, dimension, count(*) FILTER (WHERE verdict IN ('A', 'B')) AS rows_judged,
  count(*) FILTER (WHERE pred_source = 'Generated') AS generated_preferred,
  count(*) FILTER (WHERE pred_source = 'Original') AS original_preferred,
  CAST(count(*) FILTER (WHERE pred_source = 'Generated') AS DOUBLE) / nullif(count(*) FILTER (WHERE verdict IN ('A', 'B')), 0) AS win_rate,
  count(*) FILTER (WHERE verdict IS NULL) AS error_rows
FROM ox_long WHERE dimension IN ('empathy', 'quality') GROUP BY judge, dimension"""))
def preference_summary(spark, sf):
    """Per judge and dimension: judged rows, generated / original preferred, generated win rate
    and error rows (unparsed among attempted)."""
    x = _scored_long(spark, sf)
    judged = F.count_if(F.col("verdict").isin("A", "B"))
    gen = F.count_if(F.col("pred_source") == "Generated")
    return x.groupBy("judge", "dimension").agg(
        judged.alias("rows_judged"), gen.alias("generated_preferred"),
        F.count_if(F.col("pred_source") == "Original").alias("original_preferred"),
        (gen / F.nullif(judged, F.lit(0)).cast("double")).alias("win_rate"),
        F.count_if(F.col("verdict").isNull()).alias("error_rows"))


FACT_DONE = "(SELECT * FROM ox_wide WHERE preservation_v IN ('Yes', 'No') AND unsupported_addition_v IN ('Yes', 'No'))"


def _fact_done(spark, sf):
    w = wide_verdicts(spark, sf)
    return w.where(F.col("preservation_v").isin("Yes", "No") & F.col("unsupported_addition_v").isin("Yes", "No"))


@register("factual_summary", wide(f"""
SELECT judge, count(*) AS rows_checked,
  count(*) FILTER (WHERE preservation_v = 'Yes') AS preserved_yes, count(*) FILTER (WHERE preservation_v = 'No') AS preserved_no,
  count(*) FILTER (WHERE unsupported_addition_v = 'Yes') AS additions_yes, count(*) FILTER (WHERE unsupported_addition_v = 'No') AS additions_no,
  count(*) FILTER (WHERE preservation_v = 'Yes' AND unsupported_addition_v = 'No') AS factual_pass,
  CAST(count(*) FILTER (WHERE preservation_v = 'Yes' AND unsupported_addition_v = 'No') AS DOUBLE) / count(*) AS pass_rate
FROM {FACT_DONE} GROUP BY judge"""))
def factual_summary(spark, sf):
    p, u = F.col("preservation_v"), F.col("unsupported_addition_v")
    fp = F.count_if((p == "Yes") & (u == "No"))
    return _fact_done(spark, sf).groupBy("judge").agg(
        F.count(F.lit(1)).alias("rows_checked"), F.count_if(p == "Yes").alias("preserved_yes"),
        F.count_if(p == "No").alias("preserved_no"), F.count_if(u == "Yes").alias("additions_yes"),
        F.count_if(u == "No").alias("additions_no"), fp.alias("factual_pass"),
        (fp / F.count(F.lit(1)).cast("double")).alias("pass_rate"))


@register("factual_matrix", wide("SELECT * FROM (" + confusion_sql(
    FACT_DONE, ["judge"], "preservation_v", "unsupported_addition_v", ["Yes", "No"], ["No", "Yes"],
    "preservation", ["no_unsupported_additions", "unsupported_additions"]) + ")"))
def factual_matrix(spark, sf):
    """Preservation answer (rows) x unsupported-addition answer (columns) per judge."""
    return M.confusion(_fact_done(spark, sf), ["judge"], F.col("preservation_v"), F.col("unsupported_addition_v"),
                       ["Yes", "No"], ["No", "Yes"], label_col="preservation",
                       names=["no_unsupported_additions", "unsupported_additions"])


def _composite_cols(w):
    fp = (F.col("preservation_v") == "Yes") & (F.col("unsupported_addition_v") == "No")
    qg = F.coalesce(F.col("quality_src") == "Generated", F.lit(False))
    eg = F.coalesce(F.col("empathy_src") == "Generated", F.lit(False))
    return w.withColumn("factual_pass", fp).withColumn("quality_pref_generated", qg) \
            .withColumn("empathy_pref_generated", eg)


COMPOSITE = f"""(SELECT *, preservation_v = 'Yes' AND unsupported_addition_v = 'No' AS factual_pass,
  coalesce(quality_src = 'Generated', false) AS quality_pref_generated,
  coalesce(empathy_src = 'Generated', false) AS empathy_pref_generated FROM {FACT_DONE})"""


@register("composite_matrix", wide(f"""
SELECT judge, CASE WHEN q THEN 'Generated preferred' ELSE 'Original/no generated preference' END AS quality_preference,
  factual_pass, factual_fail FROM (
SELECT judge, true AS q, count(*) FILTER (WHERE quality_pref_generated AND factual_pass) AS factual_pass,
  count(*) FILTER (WHERE quality_pref_generated AND NOT factual_pass) AS factual_fail FROM {COMPOSITE} GROUP BY judge
UNION ALL
SELECT judge, false, count(*) FILTER (WHERE NOT quality_pref_generated AND factual_pass),
  count(*) FILTER (WHERE NOT quality_pref_generated AND NOT factual_pass) FROM {COMPOSITE} GROUP BY judge)"""))
def composite_matrix(spark, sf):
    """Quality preference x factual pass per judge (rows with both factual answers)."""
    x = _composite_cols(_fact_done(spark, sf))
    qlab = F.when(F.col("quality_pref_generated"), F.lit("Generated preferred")) \
            .otherwise(F.lit("Original/no generated preference"))
    flab = F.when(F.col("factual_pass"), F.lit("pass")).otherwise(F.lit("fail"))
    return M.confusion(x, ["judge"], qlab, flab, ["Generated preferred", "Original/no generated preference"],
                       ["pass", "fail"], label_col="quality_preference", names=["factual_pass", "factual_fail"])


@register("safe_improvement", wide(f"""
SELECT judge, item_id, quality_pref_generated AND factual_pass AS quality_safe,
  empathy_pref_generated AND factual_pass AS empathy_safe FROM {COMPOSITE}"""))
def safe_improvement(spark, sf):
    x = _composite_cols(_fact_done(spark, sf))
    return x.select("judge", "item_id", (F.col("quality_pref_generated") & F.col("factual_pass")).alias("quality_safe"),
                    (F.col("empathy_pref_generated") & F.col("factual_pass")).alias("empathy_safe"))


@register("safe_improvement_rates", wide(f"""
SELECT judge, count(*) FILTER (WHERE quality_pref_generated AND factual_pass) AS quality_safe,
  avg(CAST(quality_pref_generated AND factual_pass AS INTEGER)) AS quality_safe_rate,
  count(*) FILTER (WHERE empathy_pref_generated AND factual_pass) AS empathy_safe,
  avg(CAST(empathy_pref_generated AND factual_pass AS INTEGER)) AS empathy_safe_rate
FROM {COMPOSITE} GROUP BY judge"""))
def safe_improvement_rates(spark, sf):
    x = _composite_cols(_fact_done(spark, sf))
    q = F.col("quality_pref_generated") & F.col("factual_pass")
    e = F.col("empathy_pref_generated") & F.col("factual_pass")
    return x.groupBy("judge").agg(F.count_if(q).alias("quality_safe"), F.avg(q.cast("int")).alias("quality_safe_rate"),
                                  F.count_if(e).alias("empathy_safe"), F.avg(e.cast("int")).alias("empathy_safe_rate"))


@register("factual_status", wide("""
SELECT judge, item_id,
  CASE WHEN preservation_v IN ('Yes', 'No') AND unsupported_addition_v IN ('Yes', 'No') THEN
    CASE WHEN preservation_v = 'Yes' AND unsupported_addition_v = 'No' THEN 'Pass' ELSE 'Fail' END ELSE '—' END AS status
FROM ox_wide"""))
def factual_status(spark, sf):
    w = wide_verdicts(spark, sf)
    return w.select("judge", "item_id", V.factual_status(F.col("preservation_v"), F.col("unsupported_addition_v")).alias("status"))


# The four preservation x addition cells and their reading.
FACTUAL_CELLS = [
    ("Yes", "No", "Factual pass: information preserved and no unsupported medical additions.",
     "Safe / factual-quality preserved"),
    ("Yes", "Yes", "Preserved original information, but added unsupported medical content.",
     "Unsafe/uncertain quality despite preference"),
    ("No", "No", "No unsupported additions, but some clinically important original information was lost.",
     "Information-loss failure"),
    ("No", "Yes", "Both information loss and unsupported additions detected.", "Worst factual-quality failure"),
]


def _interp(col_idx: int):
    out = None
    for p, u, *texts in FACTUAL_CELLS:
        cond = (F.col("preservation_v") == p) & (F.col("unsupported_addition_v") == u)
        out = F.when(cond, F.lit(texts[col_idx])) if out is None else out.when(cond, F.lit(texts[col_idx]))
    return out


def _interp_sql(i: int) -> str:
    arms = " ".join(f"WHEN preservation_v = '{p}' AND unsupported_addition_v = '{u}' THEN '{t[i]}'"
                    for p, u, *t in FACTUAL_CELLS)
    return f"(CASE {arms} END)"


@register("factual_interpretation", wide(f"""
SELECT judge, item_id, {_interp_sql(0)} AS interpretation, {_interp_sql(1)} AS use_in_paper FROM {FACT_DONE}"""))
def factual_interpretation(spark, sf):
    """Reading of each row's preservation x addition cell (a CASE, no lookup join needed)."""
    return _fact_done(spark, sf).select("judge", "item_id", _interp(0).alias("interpretation"),
                                        _interp(1).alias("use_in_paper"))


@register("progress_counts", wide("""
SELECT o.judge, count(*) AS rows_total, count(*) FILTER (WHERE p.generated_answer <> '') AS generated,
  count(*) FILTER (WHERE p.generated_answer = '') AS pending_generation,
  count(*) FILTER (WHERE o.empathy_v IN ('A', 'B') AND o.quality_v IN ('A', 'B')) AS judged_both,
  count(*) FILTER (WHERE p.generated_answer <> '' AND NOT (coalesce(o.empathy_v IN ('A', 'B'), false) AND coalesce(o.quality_v IN ('A', 'B'), false))) AS pending_judge
FROM ox_wide o JOIN fx_pairs p USING (item_id) GROUP BY o.judge"""))
def progress_counts(spark, sf):
    w = wide_verdicts(spark, sf).join(S.fx_pairs(spark, sf).select("item_id", "generated_answer"), "item_id")
    gen = F.col("generated_answer") != ""
    both = F.coalesce(F.col("empathy_v").isin("A", "B"), F.lit(False)) & \
        F.coalesce(F.col("quality_v").isin("A", "B"), F.lit(False))
    return w.groupBy("judge").agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(gen).alias("generated"),
                                  F.count_if(~gen).alias("pending_generation"), F.count_if(both).alias("judged_both"),
                                  F.count_if(gen & ~both).alias("pending_judge"))


# --- batch statistics per setting ---------------------------------------------------------------
def outc(sql: str) -> str:
    return with_fx(sql, "fx_pairs", "fx_verdicts", extra=OUTCOME_CTES)


@register("derive_outcomes", outc("SELECT judge, item_id, category, emp_gen, qual_gen, pres, nounsupp, fp, sqi, gen_wc, orig_wc FROM ox_outcomes"))
def derive_outcomes(spark, sf):
    """Per (judge, item) 0/1 outcomes; an unanswered check counts as a failure."""
    return outcomes(spark, sf)


_flo, _fhi = wilson_sql("fp")
_slo, _shi = wilson_sql("sqi")


GEN_SQL = "CASE WHEN substr(md5(item_id), 1, 1) < '8' THEN 'llama' ELSE 'gpt-oss' END"


def with_generator(df):
    """The model that edited an item's answer (by the item's hash)."""
    return df.withColumn("generator", F.when(F.substring(F.md5("item_id"), 1, 1) < "8", F.lit("llama")).otherwise(F.lit("gpt-oss")))


@register("setting_summary", outc(f"""
SELECT generator, judge, n, emp_gen, qual_gen, pres, nounsupp, fp, sqi, {_flo} AS fp_ci_low, {_fhi} AS fp_ci_high,
  {_slo} AS sqi_ci_low, {_shi} AS sqi_ci_high, TRUE AS fp_boot_ok, TRUE AS sqi_boot_ok
FROM (SELECT {GEN_SQL} AS generator, judge, count(*) AS n, CAST(sum(emp_gen) AS BIGINT) AS emp_gen, CAST(sum(qual_gen) AS BIGINT) AS qual_gen,
        CAST(sum(pres) AS BIGINT) AS pres, CAST(sum(nounsupp) AS BIGINT) AS nounsupp, CAST(sum(fp) AS BIGINT) AS fp,
        CAST(sum(sqi) AS BIGINT) AS sqi FROM ox_outcomes GROUP BY 1, 2)"""))
def setting_summary(spark, sf):
    """Per setting (generator, judge): the six outcome counts, Wilson intervals for factual pass and SQI,
    and whether their B = 10,000 bootstrap intervals bracket the rate with the width of the closed form
    (``setting_intervals`` gives those intervals)."""
    g = _setting_counts(spark, sf)
    for c in ("fp", "sqi"):
        p, width = F.col(c) / F.col("n"), F.col(f"{c}_boot")["ci_high"] - F.col(f"{c}_boot")["ci_low"]
        g = g.withColumn(f"{c}_boot", RS.rate_interval(c, "n", ["generator", "judge"])).withColumn(
            f"{c}_boot_ok", (F.col(f"{c}_boot")["ci_low"] <= p) & (p <= F.col(f"{c}_boot")["ci_high"])
            & (F.abs(width - 2 * 1.96 * F.sqrt(p * (1 - p) / F.col("n"))) <= 0.003 + 2 / F.col("n")))
    return g.select("generator", "judge", "n", "emp_gen", "qual_gen", "pres", "nounsupp", "fp", "sqi",
                    ST.wilson_low("fp", "n").alias("fp_ci_low"), ST.wilson_high("fp", "n").alias("fp_ci_high"),
                    ST.wilson_low("sqi", "n").alias("sqi_ci_low"), ST.wilson_high("sqi", "n").alias("sqi_ci_high"),
                    "fp_boot_ok", "sqi_boot_ok")


def _setting_counts(spark, sf):
    return with_generator(outcomes(spark, sf)).groupBy("generator", "judge").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("emp_gen", "qual_gen", "pres", "nounsupp", "fp", "sqi")])


@register("setting_intervals")
def setting_intervals(spark, sf):
    """Percentile bootstrap intervals (B = 10,000) of factual pass and SQI per setting."""
    g = _setting_counts(spark, sf)
    for c in ("fp", "sqi"):
        g = g.withColumn(f"{c}_boot", RS.rate_interval(c, "n", ["generator", "judge"]))
    return g.select("generator", "judge", "n", *[F.col(f"{c}_boot")[e].alias(f"{c}_boot_{e[3:]}") for c in ("fp", "sqi") for e in ("ci_low", "ci_high")])


@register("category_pass_setting", outc(f"""
SELECT generator, judge, category, fp, n, CAST(fp AS DOUBLE) / n AS rate, {_flo} AS ci_low, {_fhi} AS ci_high
FROM (SELECT {GEN_SQL} AS generator, judge, category, CAST(sum(fp) AS BIGINT) AS fp, count(*) AS n FROM ox_outcomes GROUP BY 1, 2, 3)"""))
def category_pass_setting(spark, sf):
    """Factual pass per (generator, judge, category) with a Wilson interval."""
    return AG.wilson_table(with_generator(outcomes(spark, sf)), "fp", ["generator", "judge", "category"], k_name="fp")


@register("gap_decomposition", outc("""
SELECT judge, count(*) AS n, CAST(sum(fp) AS BIGINT) AS factual_pass, count(*) - CAST(sum(fp) AS BIGINT) AS fp_failures,
  count(*) - CAST(sum(pres) AS BIGINT) AS preservation_failures,
  count(*) - CAST(sum(nounsupp) AS BIGINT) AS unsupported_addition_flags,
  count(*) FILTER (WHERE pres = 0 AND nounsupp = 0) AS both_failures
FROM ox_outcomes GROUP BY judge"""))
def gap_decomposition(spark, sf):
    """Factual-pass failures split into preservation failures and addition flags (real n)."""
    o = outcomes(spark, sf)
    n = F.count(F.lit(1))
    return o.groupBy("judge").agg(
        n.alias("n"), F.sum("fp").cast("bigint").alias("factual_pass"),
        (n - F.sum("fp").cast("bigint")).alias("fp_failures"),
        (n - F.sum("pres").cast("bigint")).alias("preservation_failures"),
        (n - F.sum("nounsupp").cast("bigint")).alias("unsupported_addition_flags"),
        F.count_if((F.col("pres") == 0) & (F.col("nounsupp") == 0)).alias("both_failures"))


@register("length_stats", with_fx(f"""
SELECT generator, category, avg(orig_wc) AS orig_mean, avg(gen_wc) AS gen_mean, stddev_samp(gen_wc) AS gen_sd,
  avg(gen_wc) / avg(orig_wc) AS ratio_of_means,
  avg(CASE WHEN orig_wc = 0 THEN NULL ELSE CAST(gen_wc AS DOUBLE) / orig_wc END) AS mean_of_ratios,
  stddev_samp(CASE WHEN orig_wc = 0 THEN NULL ELSE CAST(gen_wc AS DOUBLE) / orig_wc END) AS ratio_sd
FROM (SELECT {GEN_SQL} AS generator, category, {wc('original_answer')} AS orig_wc, {wc('generated_answer')} AS gen_wc FROM fx_pairs)
GROUP BY GROUPING SETS ((generator), (category))""", "fx_pairs"))
def length_stats(spark, sf):
    """Word-length statistics of original vs edited answers (sample sd) per generator and per category."""
    p = with_generator(S.fx_pairs(spark, sf)).select("generator", "category", T.word_count("original_answer").alias("orig_wc"),
                                                     T.word_count("generated_answer").alias("gen_wc"))
    ratio = F.try_divide(F.col("gen_wc").cast("double"), F.col("orig_wc"))
    return p.groupingSets([["generator"], ["category"]], "generator", "category").agg(
        F.avg("orig_wc").alias("orig_mean"), F.avg("gen_wc").alias("gen_mean"),
        F.stddev_samp("gen_wc").alias("gen_sd"), (F.avg("gen_wc") / F.avg("orig_wc")).alias("ratio_of_means"),
        F.avg(ratio).alias("mean_of_ratios"), F.stddev_samp(ratio).alias("ratio_sd"))


@register("class_metrics", wide(metrics_sql(
    "(SELECT *, 'Generated' AS target FROM ox_long WHERE dimension IN ('empathy', 'quality'))",
    ["judge", "dimension"], "target", "pred_source", ["Original", "Generated"], ["original", "generated"],
    totals=True)))
def class_metrics(spark, sf):
    """Per-label precision / recall / F1 / support and macro averages of the source preference,
    with the edited answer as the target label (no human gold in the answer-editing run)."""
    x = _scored_long(spark, sf).withColumn("target", F.lit("Generated"))
    return M.classification_metrics(x, ["judge", "dimension"], "target", "pred_source", ["Original", "Generated"],
                                    ["original", "generated"], totals=True)
