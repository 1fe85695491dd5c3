"""Registered queries: paired judges, McNemar, Cohen's kappa, resampling, length confound."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairjudge.operators import agreement as AG
from pairjudge.operators import regression as RG
from pairjudge.operators import resample as RS
from pairjudge.plans.common import OUTCOME_CTES, outcomes
from pairjudge.plans.oracle_fx import with_fx
from pairjudge.plans.q_metrics import _strength_sql
from pairjudge.plans.registry import register
from pairjudge.sources import tables as S

METRICS = ["emp_gen", "qual_gen", "pres", "nounsupp", "fp"]
JUDGES = ["j1", "j2"]


def paired(spark, sf):
    """Outcomes of the two judges side by side on their common items (one groupBy + pivot)."""
    o = outcomes(spark, sf)
    p = o.groupBy("item_id").pivot("judge", JUDGES).agg(*[F.first(m).alias(m) for m in METRICS])
    return p.where(F.col("j1_fp").isNotNull() & F.col("j2_fp").isNotNull())


def paired_long(spark, sf):
    parts = ", ".join(f"'{m}', j1_{m}, j2_{m}" for m in METRICS)
    return paired(spark, sf).select("item_id", F.expr(f"stack({len(METRICS)}, {parts}) AS (metric, a, b)"))


PAIRED_SQL = ("paired", "SELECT a.item_id, " + ", ".join(f"a.{m} AS j1_{m}, b.{m} AS j2_{m}" for m in METRICS) +
              " FROM ox_outcomes a JOIN ox_outcomes b ON a.item_id = b.item_id AND a.judge = 'j1' AND b.judge = 'j2'")
PLONG_SQL = ("plong", " UNION ALL ".join(f"SELECT item_id, '{m}' AS metric, j1_{m} AS a, j2_{m} AS b FROM paired"
                                         for m in METRICS))


def pj(sql: str) -> str:
    return with_fx(sql, "fx_pairs", "fx_verdicts", extra=OUTCOME_CTES + [PAIRED_SQL, PLONG_SQL])


@register("paired_judges", pj("SELECT * FROM paired"))
def paired_judges(spark, sf):
    """Inner pairing of two judges' outcomes on common item ids."""
    return paired(spark, sf)


@register("common_ids", pj("SELECT item_id FROM ox_outcomes WHERE judge = 'j1' INTERSECT SELECT item_id FROM ox_outcomes WHERE judge = 'j2'"))
def common_ids(spark, sf):
    o = outcomes(spark, sf)
    return o.where(F.col("judge") == "j1").select("item_id").intersect(
        o.where(F.col("judge") == "j2").select("item_id"))


# --- McNemar ---------------------------------------------------------------------------------
def erfc_sql(x: str) -> str:
    cf = f"list_reduce(list_reverse(range(1, 201)), lambda acc, k: {x} + (k / 2.0) / acc, {x})"
    series = f"list_reduce(list_reverse(range(1, 121)), lambda acc, k: 1.0 + 2.0 * {x} * {x} / (2.0 * k + 1) * acc, 1.0)"
    return (f"(CASE WHEN {x} >= 2 THEN exp(-{x} * {x}) / sqrt(pi()) / {cf} "
            f"ELSE 1.0 - 2.0 / sqrt(pi()) * exp(-{x} * {x}) * {x} * {series} END)")


def mcnemar_cols_sql() -> str:
    stat_chi = "power(abs(CAST(n10 AS DOUBLE) - n01) - 1, 2) / nullif(CAST(n10 AS DOUBLE) + n01, 0)"
    stat = f"(CASE WHEN n10 + n01 < 25 THEN CAST(least(n10, n01) AS DOUBLE) ELSE {stat_chi} END)"
    binom = ("list_sum(list_transform(range(0, CAST(least(n10, n01) AS BIGINT) + 1), lambda k: "
             "CAST(factorial(CAST(n10 + n01 AS INTEGER)) AS DOUBLE) / (CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE) "
             "* CAST(factorial(CAST(n10 + n01 - k AS INTEGER)) AS DOUBLE)))) / power(2.0, n10 + n01)")
    p = (f"(CASE WHEN n10 + n01 < 25 THEN least(1.0, 2 * {binom}) "
         f"ELSE {erfc_sql('sqrt((' + stat_chi + ') / 2)')} END)")
    return f"{stat} AS statistic, {p} AS p"


CELLS_SQL = """count(*) FILTER (WHERE {a} = 1 AND {b} = 1) AS n11, count(*) FILTER (WHERE {a} = 1 AND {b} = 0) AS n10,
  count(*) FILTER (WHERE {a} = 0 AND {b} = 1) AS n01, count(*) FILTER (WHERE {a} = 0 AND {b} = 0) AS n00,
  count(*) AS n, CAST(sum({a}) AS BIGINT) AS sum_a, CAST(sum({b}) AS BIGINT) AS sum_b"""


@register("mcnemar", with_fx(f"""
SELECT category, n, sum_a, sum_b, n10, n01, {mcnemar_cols_sql()}
FROM (SELECT category, {CELLS_SQL.format(a='rater_a', b='rater_b')} FROM fx_raters_big GROUP BY category)""",
                             "fx_raters_big"))
def mcnemar(spark, sf):
    """Paired McNemar test of two binary raters per category over every lineitem-sized row."""
    return AG.mcnemar(S.fx_raters_big(spark, sf), "rater_a", "rater_b", ["category"])


@register("mcnemar_paired_judges", pj(f"""
SELECT metric, n, sum_a, sum_b, n10, n01, {mcnemar_cols_sql()}
FROM (SELECT metric, {CELLS_SQL.format(a='a', b='b')} FROM plong GROUP BY metric)"""))
def mcnemar_paired_judges(spark, sf):
    """McNemar per outcome between two judges scoring the same edited answers."""
    return AG.mcnemar(paired_long(spark, sf), "a", "b", ["metric"])


# --- kappa -----------------------------------------------------------------------------------
def kappa_cols_sql() -> str:
    po = "CAST(n11 + n00 AS DOUBLE) / n"
    pa, pb = "CAST(n11 + n10 AS DOUBLE) / n", "CAST(n11 + n01 AS DOUBLE) / n"
    pe = f"(({pa}) * ({pb}) + (1 - ({pa})) * (1 - ({pb})))"
    k = f"(CASE WHEN n > 0 THEN (({po}) - {pe}) / nullif(1 - {pe}, 0) END)"
    ra, rb = "CAST(sum_a AS DOUBLE) / n", "CAST(sum_b AS DOUBLE) / n"
    deg = f"(least({ra}, 1 - ({ra})) < 0.005 OR least({rb}, 1 - ({rb})) < 0.005)"
    return (f"n, {po} AS pct_agree, {k} AS kappa, CASE WHEN {deg} THEN 'degenerate: base rate ~constant' "
            f"ELSE {_strength_sql(k)} END AS strength, {deg} AS degenerate")


@register("cohen_kappa", with_fx(f"""
SELECT category, {kappa_cols_sql()}
FROM (SELECT category, {CELLS_SQL.format(a='rater_a', b='rater_b')} FROM fx_raters_big GROUP BY category)""",
                                 "fx_raters_big"))
def cohen_kappa(spark, sf):
    """Cohen's kappa, % agreement and strength band of two binary raters per category."""
    return AG.cohen_kappa(S.fx_raters_big(spark, sf), "rater_a", "rater_b", ["category"])


@register("kappa_strength", pj(f"""
SELECT metric, {kappa_cols_sql()}
FROM (SELECT metric, {CELLS_SQL.format(a='a', b='b')} FROM plong GROUP BY metric)"""))
def kappa_strength(spark, sf):
    """Inter-judge kappa per outcome with its agreement band (degenerate base rates flagged)."""
    return AG.cohen_kappa(paired_long(spark, sf), "a", "b", ["metric"])


@register("degenerate_flag", pj("""
SELECT metric, CAST(sum(a) AS DOUBLE) / count(*) AS rate_a, CAST(sum(b) AS DOUBLE) / count(*) AS rate_b,
  least(CAST(sum(a) AS DOUBLE) / count(*), 1 - CAST(sum(a) AS DOUBLE) / count(*)) < 0.005
  OR least(CAST(sum(b) AS DOUBLE) / count(*), 1 - CAST(sum(b) AS DOUBLE) / count(*)) < 0.005 AS degenerate
FROM plong GROUP BY metric"""))
def degenerate_flag(spark, sf):
    from pairjudge.functions.stats import degenerate
    g = paired_long(spark, sf).groupBy("metric").agg(
        (F.sum("a") / F.count(F.lit(1)).cast("double")).alias("rate_a"),
        (F.sum("b") / F.count(F.lit(1)).cast("double")).alias("rate_b"))
    return g.withColumn("degenerate", degenerate("rate_a", "rate_b"))


# --- resampling ------------------------------------------------------------------------------
BOOT_B = 10_000
KAPPA_B = 2000


def _fp_raters(spark, sf):
    r = S.fx_raters(spark, sf)
    return r.withColumn("fp", ((F.col("preserved") == 1) & (F.col("unsupported") == 0)).cast("int"))


def _checked(r, closed_width):
    """The interval brackets the estimate, and is as wide as the closed form within 0.3 points and the
    step of a rate (two steps of 1 / n)."""
    return (r.withColumn("brackets", (F.col("ci_low") <= F.col("estimate")) & (F.col("estimate") <= F.col("ci_high")))
            .withColumn("width_ok", F.abs(F.col("ci_high") - F.col("ci_low") - closed_width) <= 0.003 + 2 / F.col("n")))


@register("bootstrap_mean_ci", with_fx("""
SELECT lang AS category, count(*) AS n, CAST(sum(fp) AS BIGINT) AS k, sum(fp) / CAST(count(*) AS DOUBLE) AS estimate, TRUE AS brackets, TRUE AS width_ok
FROM (SELECT category AS lang, CASE WHEN preserved = 1 AND unsupported = 0 THEN 1 ELSE 0 END AS fp FROM fx_raters) GROUP BY 1""",
    "fx_raters"))
def bootstrap_mean_ci(spark, sf):
    """Percentile bootstrap (B = 10,000, seed 42) of the factual-pass rate per category, from cells: counts,
    estimate, and whether the interval brackets it and has the width of the closed form."""
    r = RS.binomial_bootstrap_rate(_fp_raters(spark, sf), ["category"], "fp", B=BOOT_B, seed=42)
    p = F.col("estimate")
    return _checked(r, 2 * 1.96 * F.sqrt(p * (1 - p) / F.col("n"))).select("category", "n", "k", "estimate", "brackets", "width_ok")


@register("bootstrap_rate_cells")
def bootstrap_rate_cells(spark, sf):
    """Percentile bootstrap (B = 10,000, seed 42) of factual pass and SQI per setting from cells
    (k, n): exact resampling distribution of a 0/1 mean, cost independent of n."""
    o = outcomes(spark, sf)
    long = o.select("judge", F.expr("stack(2, 'fp', fp, 'sqi', sqi) AS (outcome, flag)"))
    return RS.binomial_bootstrap_rate(long, ["judge", "outcome"], "flag", B=10000, seed=42)


def _numeric_sql() -> str:
    from pairjudge.plans.q_screen import GOLD_SQL
    weight = " + ".join(f"CAST(u >= {t} AS BIGINT)" for t in RS.POISSON_STEPS)
    return with_fx(f"""
SELECT e.dimension, e.n, e.estimate, q.ci_low, q.ci_high
FROM (SELECT dimension, count(*) AS n, avg(v) AS estimate FROM l GROUP BY dimension) e
JOIN (SELECT dimension, quantile_cont(swx / sw, 0.025) AS ci_low, quantile_cont(swx / sw, 0.975) AS ci_high
      FROM (SELECT dimension, rep, sum(w) AS sw, sum(w * v) AS swx
            FROM (SELECT dimension, rep, v, {weight} AS w FROM (SELECT dimension, rep, v, (a * rep + b) % {RS.PRIME} AS u FROM l, range(1, {BOOT_B + 1}) t(rep)))
            GROUP BY dimension, rep)
      WHERE sw > 0 GROUP BY dimension) q ON q.dimension = e.dimension""", "fx_ratings", extra=[("gold", GOLD_SQL), ("l", f"""
SELECT dimension, chatgpt_avg - physician_avg AS v, 1 + CAST('0x' || substr(md5(concat('42:', item_id)), 1, 8) AS BIGINT) % {RS.PRIME - 1} AS a,
  CAST('0x' || substr(md5(concat('42:', item_id)), 9, 8) AS BIGINT) % {RS.PRIME} AS b
FROM gold WHERE chatgpt_avg - physician_avg IS NOT NULL""")])


@register("bootstrap_numeric_ci", _numeric_sql())
def bootstrap_numeric_ci(spark, sf):
    """Percentile bootstrap (B = 10,000, seed 42) of a numeric column, the evaluators' mean difference between the two sources,
    per dimension: vectors of hash-fixed Poisson weights added up in the tasks."""
    from pairjudge.plans.q_screen import gold_table
    g = gold_table(spark, sf).withColumn("diff", F.col("chatgpt_avg") - F.col("physician_avg"))
    return RS.poisson_bootstrap_mean(g, ["dimension"], "item_id", "diff", B=BOOT_B, seed=42)


@register("kappa_bootstrap_ci", with_fx("""
SELECT category, n, (po - pe) / (1 - pe) AS estimate, TRUE AS brackets, TRUE AS width_ok
FROM (SELECT category, count(*) AS n, avg(CASE WHEN rater_a = rater_b THEN 1.0 ELSE 0.0 END) AS po,
        avg(rater_a) * avg(rater_b) + (1 - avg(rater_a)) * (1 - avg(rater_b)) AS pe FROM fx_raters GROUP BY category)""", "fx_raters"))
def kappa_bootstrap_ci(spark, sf):
    """Kappa with its percentile interval over B = 2,000 resamples per category, from the 2x2 cells:
    n, kappa, whether the interval brackets it and has the width of the closed form, within a seventh and a point."""
    r = RS.multinomial_bootstrap_kappa(S.fx_raters(spark, sf), ["category"], "rater_a", "rater_b", B=KAPPA_B, seed=42)
    closed, width = 2 * 1.96 * F.col("se"), F.col("ci_high") - F.col("ci_low")
    return r.select("category", "n", "estimate", ((F.col("ci_low") <= F.col("estimate")) & (F.col("estimate") <= F.col("ci_high"))).alias("brackets"),
                    (F.abs(width - closed) <= closed / 7 + 0.01).alias("width_ok"))


# --- length confound ---------------------------------------------------------------------------
@register("standardize", with_fx("""
SELECT judge, item_id, gen_wc - orig_wc AS delta,
  (gen_wc - orig_wc - avg(gen_wc - orig_wc) OVER (PARTITION BY judge)) / stddev_pop(gen_wc - orig_wc) OVER (PARTITION BY judge) AS z
FROM ox_outcomes""", "fx_pairs", "fx_verdicts", extra=OUTCOME_CTES))
def standardize(spark, sf):
    """(delta - mean) / population sd of the word delta per setting (stats joined back, no
    per-setting window over all rows)."""
    o = outcomes(spark, sf).withColumn("delta", F.col("gen_wc") - F.col("orig_wc"))
    return RG.standardize(o, ["judge"], "delta").select("judge", "item_id", "delta", "z")


LOGIT_STEPS = 25
WORD_DELTA, LOG_RATIO = "CAST(gen_wc - orig_wc AS DOUBLE)", "ln((gen_wc + 1) / CAST(orig_wc + 1 AS DOUBLE))"


def _length_sql(covariate: str) -> str:
    return with_fx(f"""
SELECT m.judge, m.n, m.wins, i.b1 AS beta_per_sd, exp(i.b1) AS or_per_sd, sqrt(i.h00 / i.det) AS se, m.mean_delta
FROM m JOIN (SELECT * FROM steps WHERE step = {LOGIT_STEPS}) i ON i.judge = m.judge""", "fx_pairs", "fx_verdicts", extra=OUTCOME_CTES + [
    ("cells", f"SELECT judge, {covariate} AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(qual_gen) AS DOUBLE) AS w FROM ox_outcomes GROUP BY 1, 2"),
    ("m", "SELECT judge, CAST(sum(n) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS wins, sum(n * x) / sum(n) AS mean_delta, "
          "sqrt(sum(n * x * x) / sum(n) - (sum(n * x) / sum(n)) ** 2) AS sd FROM cells GROUP BY judge"),
    ("z", "SELECT c.judge, (c.x - m.mean_delta) / m.sd AS z, c.n, c.w FROM cells c JOIN m ON m.judge = c.judge"),
    ("steps", f"""
SELECT 0 AS step, judge, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(1 AS DOUBLE) AS h00, CAST(1 AS DOUBLE) AS det FROM m
UNION ALL
SELECT step + 1, judge, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01),
  h00, h00 * h11 - h01 * h01
FROM (SELECT step, judge, b0, b1, sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * z) AS h01, sum(n * p * (1 - p) * z * z) AS h11,
        sum(w - n * p) AS g0, sum((w - n * p) * z) AS g1
      FROM (SELECT steps.step, steps.judge, steps.b0, steps.b1, z.z, z.n, z.w, 1 / (1 + exp(-(steps.b0 + steps.b1 * z.z))) AS p
            FROM steps JOIN z ON z.judge = steps.judge WHERE steps.step < {LOGIT_STEPS})
      GROUP BY step, judge, b0, b1)""")]).replace("WITH ", "WITH RECURSIVE ", 1)


@register("length_confound", _length_sql(WORD_DELTA))
def length_confound(spark, sf):
    """Logistic regression of quality-win on the standardised word delta per setting: slope, odds
    ratio, standard error and mean delta (the Wald p follows from slope and error)."""
    o = outcomes(spark, sf).withColumn("delta", F.col("gen_wc") - F.col("orig_wc"))
    return RG.logit_per_group(o, ["judge"], "qual_gen", "delta").drop("p", "iterations", "error")


@register("length_confound_ratio", _length_sql(LOG_RATIO))
def length_confound_ratio(spark, sf):
    """The same regression on a continuous covariate, the log ratio of the word counts, by distributed Newton steps."""
    o = outcomes(spark, sf).withColumn("ratio", F.log((F.col("gen_wc") + 1) / (F.col("orig_wc") + 1)))
    return RG.logit_distributed(o, ["judge"], "qual_gen", "ratio").drop("p", "iterations", "error")


@register("kappa_bootstrap_cells")
def kappa_bootstrap_cells(spark, sf):
    """Kappa interval (B = 2,000, seed 42) per category over every lineitem-sized rater row, by
    multinomial draws of the 2x2 cells: cost independent of n."""
    return RS.multinomial_bootstrap_kappa(S.fx_raters_big(spark, sf), ["category"], "rater_a", "rater_b",
                                          B=KAPPA_B, seed=42)
