"""Run-keyed result tables: keep-last, scope, upsert, pending work, guards and named filters.

Keep-last is a ``max_by`` aggregation rather than a ranking window: the partial (map-side)
aggregate keeps one row per key per partition, so a hot key holding a third of all rows never
lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairjudge.functions.text import strip_text
from pairjudge.operators.assign import join_null_safe

DEFAULT_VARIANT = "paper_minimal"


def normalized_variant(c: Column, default: str = DEFAULT_VARIANT) -> Column:
    """Blank / NULL prompt variant means the default variant (applied on every read)."""
    t = strip_text(c)
    return F.when(t == "", F.lit(default)).otherwise(t)


def dedupe_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order`` (later wins; ties impossible when ``order`` ends in a sequence)."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def run_predicate(judge_col: str, judge: str, variant_col: str | None = None, variant: str | None = None,
                  seed_col: str | None = None, seed: int | None = None, shot_col: str | None = None,
                  shot: str | None = None, dimension_col: str | None = None, dimension: str | None = None) -> Column:
    """Is a stored row part of this run? Blank variants mean the default one; a missing or unreadable
    seed means the current seed."""
    cond = F.col(judge_col) == judge
    if variant_col is not None:
        cond = cond & (normalized_variant(F.col(variant_col)) == normalized_variant(F.lit(variant)))
    if seed_col is not None:
        cond = cond & (F.coalesce(F.col(seed_col).cast("string").try_cast("double").cast("long"), F.lit(seed)) == seed)
    if shot_col is not None:
        cond = cond & (F.col(shot_col) == shot)
    if dimension_col is not None:
        cond = cond & (F.col(dimension_col) == dimension)
    return cond


def keep_other_runs(stored: DataFrame, run: Column) -> DataFrame:
    return stored.where(~F.coalesce(run, F.lit(False)))


def upsert_run(stored: DataFrame, run: Column, view: DataFrame) -> DataFrame:
    """Replace one run's rows by ``view``; rows of every other run are kept as stored."""
    return keep_other_runs(stored, run).unionByName(view, allowMissingColumns=True)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted work units without a valid result (anti join; a NULL key equals a NULL key)."""
    return join_null_safe(wanted, done.select(*keys).distinct(), keys, "left_anti")


# Output columns of a result row, in two sets.
GENERATION_COLS = ["generated_empathy_answer", "generation_model", "generation_prompt_variant", "generated_at", "generation_error"]
JUDGE_COLS = [f"{d}_{c}" for d in ("empathy", "quality")
              for c in ("pred_choice", "pred_source", "raw_judge_response", "judge_model", "judged_at", "judge_error")] \
    + [f"{d}_mismatch_{c}" for d in ("empathy", "quality") for c in ("explanation", "raw_response", "explained_at", "error")] \
    + [f"{d}_{c}" for d in ("factual_preservation", "unsupported_addition")
       for c in ("answer", "raw_response", "judged_at", "error", "judge_model")] \
    + ["pred_choice", "pred_source", "raw_judge_response", "judge_model", "judged_at", "judge_error"]


def blank_outputs(df: DataFrame, when: Column | None = None, generation: bool = True, judge: bool = True,
                  generation_cols: list[str] | None = None, judge_cols: list[str] | None = None) -> DataFrame:
    """Clear the output columns of a result table (those that it has): generation and judge columns, or
    one set alone; of the rows where ``when`` holds, or of all."""
    names = (generation_cols or GENERATION_COLS if generation else []) + (judge_cols or JUDGE_COLS if judge else [])
    out = {}
    for c in names:
        if c in df.columns:
            blank = F.lit("" if df.schema[c].dataType.simpleString() == "string" else None).cast(df.schema[c].dataType)
            out[c] = blank if when is None else F.when(F.coalesce(when, F.lit(False)), blank).otherwise(F.col(c))
    return df.withColumns(out) if out else df


def variant_guard(df: DataFrame, run_keys: list[str], generated_col: str, variant_col: str, expected: str,
                  generation_cols: list[str] | None = None, judge_cols: list[str] | None = None) -> DataFrame:
    """Whole-run guard before a run goes on: a run with a generated row of another prompt variant loses
    its generation and judge outputs; a run without any generated row loses its judge outputs."""
    generated = strip_text(F.col(generated_col)) != ""
    runs = df.groupBy(*run_keys).agg(
        F.max((generated & (normalized_variant(F.col(variant_col)) != expected)).cast("int")).alias("_other"),
        F.max(generated.cast("int")).alias("_some"))
    j = join_null_safe(df, runs, run_keys)
    other, none = F.col("_other") == 1, F.col("_some") == 0
    j = blank_outputs(j, other | none, generation=False, judge_cols=judge_cols)
    return blank_outputs(j, other, judge=False, generation_cols=generation_cols).drop("_other", "_some")


def generation_pending(df: DataFrame, generated_col: str) -> DataFrame:
    """Rows without a generated answer."""
    return df.where(strip_text(F.col(generated_col)) == "")


def explanation_pending(df: DataFrame, pred_source_col: str, explanation_col: str, lost: str = "Original",
                        error_col: str | None = None) -> DataFrame:
    """Rows whose verdict preferred ``lost`` and that have no explanation yet; a stored error of the explanation call
    (``error_col``) settles a row as well."""
    open_ = (F.col(pred_source_col) == lost) & (strip_text(F.col(explanation_col)) == "")
    return df.where(open_ if error_col is None else open_ & (strip_text(F.col(error_col)) == ""))


def first_rows(df: DataFrame, n: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by ``order``, of the table or of each ``keys`` group (the limit is the feature)."""
    if not keys:
        return df.orderBy(*order).limit(n)
    return (df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col("_rn") <= n).drop("_rn"))


def named_filters(df: DataFrame, filters: dict[str, Column], keys: list[str]) -> DataFrame:
    """All named row filters in one pass: each row emits one (filter_name, keys...) per filter it
    satisfies (an explode of the matching names; no union of N scans)."""
    names = F.array(*[F.when(F.coalesce(pred, F.lit(False)), F.lit(name)) for name, pred in filters.items()])
    return df.select(*keys, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("filter_name"))


def preview_projection(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fixed display columns (absent ones skipped), NULL shown as ''."""
    present = [c for c in cols if c in df.columns]
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in present])
