"""Template table, per-row template choice and prompt rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairjudge.functions import prompts as P
from pairjudge.functions.text import normalize_text

JUDGE_FIELDS = ("question", "sentence_a", "sentence_b")
FACTUAL_FIELDS = ("question", "original_answer", "generated_answer")


def template_table(spark: SparkSession, rows=None) -> DataFrame:
    """(kind, key, system, user_template); a fixed, small table (one row per template)."""
    return spark.createDataFrame(rows or P.template_rows(), "kind string, key string, system string, user_template string")


def kind_of_dimension(dim: Column) -> Column:
    return F.when(dim.isin("empathy", "quality"), F.lit("judge")).otherwise(F.lit("factual"))


def with_templates(df: DataFrame, kind: Column, key: Column) -> DataFrame:
    """Attach system / user template per row (unknown key -> the kind's default template).

    The template table has a fixed handful of rows, so broadcasting it is size-safe."""
    t = template_table(df.sparkSession)
    defaults = {"judge": "empathy", "explain": "empathy", "factual": "preservation", "generation": "v1",
                "calibration": "paper_minimal:empathy", "calibration_explain": "paper_minimal:empathy"}
    known_keys = {(k, key_) for k, key_, _, _ in P.template_rows()}
    kinds = sorted({k for k, _ in known_keys})
    resolved = None
    for k in kinds:
        ks = [key_ for kk, key_ in known_keys if kk == k]
        arm = F.when(key.isin(*ks), key).otherwise(F.lit(defaults[k]))
        resolved = F.when(kind == k, arm) if resolved is None else resolved.when(kind == k, arm)
    x = df.withColumn("_tpl_kind", kind).withColumn("_tpl_key", resolved)
    t = t.withColumnRenamed("kind", "_tpl_kind").withColumnRenamed("key", "_tpl_key")
    return x.join(F.broadcast(t), ["_tpl_kind", "_tpl_key"], "left").drop("_tpl_kind", "_tpl_key")


def render_by_key(key: Column, templates: dict[str, str], **cols) -> Column:
    """Render a per-row template chosen from a few known ones (one CASE, each arm single-pass)."""
    out = None
    for k, tpl in templates.items():
        r = P.render(tpl, **cols)
        out = F.when(key == k, r) if out is None else out.when(key == k, r)
    return out


def judge_prompt(dim: Column, question: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """(system, user) of the A/B judge prompt for a preference dimension."""
    tpls = {d: P.template("judge", d)[1] for d in ("empathy", "quality")}
    user = render_by_key(dim, tpls, question=normalize_text(question), sentence_a=normalize_text(a),
                         sentence_b=normalize_text(b))
    return F.lit(P.JUDGE_SYSTEM), user


def factual_prompt(check: Column, question: Column, original: Column, generated: Column) -> tuple[Column, Column]:
    tpls = {d: P.template("factual", d)[1] for d in ("preservation", "unsupported_addition")}
    user = render_by_key(check, tpls, question=normalize_text(question), original_answer=normalize_text(original),
                         generated_answer=normalize_text(generated))
    return F.lit(P.FACTUAL_SYSTEM), user


def any_prompt(dim: Column, question: Column, original: Column, generated: Column, a: Column,
               b: Column) -> tuple[Column, Column]:
    """System and user prompt for any of the four judge prompts of an item."""
    js, ju = judge_prompt(dim, question, a, b)
    fs, fu = factual_prompt(dim, question, original, generated)
    pref = dim.isin("empathy", "quality")
    return F.when(pref, js).otherwise(fs), F.when(pref, ju).otherwise(fu)
