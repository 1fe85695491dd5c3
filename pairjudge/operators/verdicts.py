"""Verdict parsing, source mapping and per-item outcomes.

Long model: one row per (item, judge, dimension). The wide per-item view is a single
``groupBy(...).pivot(dimension, [fixed labels])`` — explicit labels avoid an extra distinct job
and fix the output schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairjudge.functions import text as T

PREFERENCE_DIMS = ["empathy", "quality"]
FACTUAL_DIMS = ["preservation", "unsupported_addition"]
ALL_DIMS = PREFERENCE_DIMS + FACTUAL_DIMS


def parse_verdicts(v: DataFrame, raw: str = "raw_response") -> DataFrame:
    """verdict = A/B for preference dimensions, Yes/No for factual checks, NULL if unparsed."""
    verdict = F.when(F.col("dimension").isin(*PREFERENCE_DIMS), T.parse_choice(raw)) \
               .otherwise(T.parse_yes_no(raw))
    return v.withColumn("verdict", verdict)


def pred_source_from_order(order: Column, choice: Column) -> Column:
    """Source name at the chosen letter, read from an order label 'X_A__Y_B' (the first
    '__'-separated part ending in '_<letter>', suffix removed)."""
    def at(letter: str) -> Column:
        part = F.try_element_at(F.filter(F.split(order, "__"), lambda p: p.endswith(f"_{letter}")), F.lit(1))
        return F.substring(part, F.lit(1), F.length(part) - 2)
    return F.when(choice == "A", at("A")).when(choice == "B", at("B"))


def pred_source_from_columns(choice: Column, a_src: Column, b_src: Column) -> Column:
    return F.when(choice == "A", a_src).when(choice == "B", b_src)


def source_error_type(gold: Column, pred: Column, sources=("Physician", "ChatGPT")) -> Column:
    s1, s2 = sources
    return (F.when(~F.coalesce(pred, F.lit("")).isin(s1, s2), F.lit(""))
            .when(gold == pred, F.lit("Correct"))
            .when((gold == s1) & (pred == s2), F.lit(f"Judge favored {s2}; gold favored {s1}"))
            .when((gold == s2) & (pred == s1), F.lit(f"Judge favored {s1}; gold favored {s2}"))
            .otherwise(F.lit("Mismatch")))


def add_match(df: DataFrame, gold: str = "gold_choice", pred: str = "verdict") -> DataFrame:
    """is_match (INT) on scored rows (pred in A/B), NULL elsewhere."""
    return df.withColumn("is_match", F.when(F.col(pred).isin("A", "B"),
                                            (F.col(gold) == F.col(pred)).cast("int")))


def with_sources(verdicts: DataFrame, order: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Join parsed verdicts to the A/B order and map letters back to sources."""
    o = order.select(id_col, "gold_choice", "response_order", "sentence_a_source", "sentence_b_source")
    j = verdicts.join(o, id_col, "left")
    return j.withColumn("pred_source", F.when(
        F.col("dimension").isin(*PREFERENCE_DIMS),
        pred_source_from_columns(F.col("verdict"), F.col("sentence_a_source"), F.col("sentence_b_source"))))


def wide_view(long: DataFrame, keys: list[str], value: str, dims=ALL_DIMS, agg=F.first) -> DataFrame:
    """One row per ``keys`` with one column per dimension."""
    return long.groupBy(*keys).pivot("dimension", list(dims)).agg(agg(value))


def derive_outcomes(wide: DataFrame, keys: list[str], unanswered: str = "fail") -> DataFrame:
    """``wide`` holds the predicted source per preference dimension (``empathy``, ``quality``)
    and the Yes/No answer per factual check. 0/1 outcomes per item: emp_gen, qual_gen, pres, nounsupp, fp (pres AND nounsupp), sqi
    (qual_gen AND fp). With ``unanswered='fail'`` a missing or unparsed answer counts 0 (batch
    statistics); ``'exclude'`` leaves it NULL so rates use answered rows only (dashboards)."""
    def flag(cond: Column, present: Column) -> Column:
        v = cond.cast("int")
        return F.coalesce(v, F.lit(0)) if unanswered == "fail" else F.when(present, F.coalesce(v, F.lit(0)))

    emp = flag(F.col("empathy") == "Generated", F.col("empathy").isNotNull())
    qual = flag(F.col("quality") == "Generated", F.col("quality").isNotNull())
    pres = flag(F.col("preservation") == "Yes", F.col("preservation").isNotNull())
    nouns = flag(F.col("unsupported_addition") == "No", F.col("unsupported_addition").isNotNull())
    x = wide.select(*keys, emp.alias("emp_gen"), qual.alias("qual_gen"), pres.alias("pres"),
                    nouns.alias("nounsupp"), *[c for c in wide.columns if c in ("gen_wc", "orig_wc", "category")])
    return x.withColumn("fp", F.col("pres") * F.col("nounsupp")) \
            .withColumn("sqi", F.col("qual_gen") * F.col("fp"))


def factual_status(pres: Column, unsupp: Column) -> Column:
    """'Pass' / 'Fail' when both checks answered, else '—'."""
    both = pres.isin("Yes", "No") & unsupp.isin("Yes", "No")
    return F.when(both & (pres == "Yes") & (unsupp == "No"), F.lit("Pass")) \
            .when(both, F.lit("Fail")).otherwise(F.lit("—"))
