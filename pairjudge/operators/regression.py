"""Standardisation and a per-group logistic regression (intercept + one covariate).

Word deltas are discrete, so :func:`logit_per_group` first aggregates the rows to (group, value)
cells of rows and wins; the Newton steps then run on a group's cells inside one task. Nothing is
collected and no job runs while the plan is built. For a continuous covariate, whose cells are as many as the rows,
:func:`logit_distributed` sums the information over the rows in every step instead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairjudge.functions import stats as ST
from pairjudge.operators.assign import join_null_safe
from pairjudge.sources.io import scratch_path


def standardize(df: DataFrame, keys: list[str], col: str, out: str = "z") -> DataFrame:
    """(x - mean) / population sd per group; group statistics are aggregated and joined back."""
    st = df.groupBy(*keys).agg(F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd"))
    return join_null_safe(df, st, keys).withColumn(out, (F.col(col) - F.col("_mu")) / F.col("_sd")).drop("_mu", "_sd")


RESULT_SCHEMA = ("n bigint, wins bigint, beta_per_sd double, or_per_sd double, se double, p double, "
                 "mean_delta double, iterations int, error string")
MAX_ITER = 50
TOL = 1e-10


def fit_cells(x: np.ndarray, n: np.ndarray, wins: np.ndarray, max_iter: int = MAX_ITER, tol: float = TOL) -> dict:
    """Newton-Raphson fit of logit(p) = b0 + b1 z over cells (covariate, rows, wins), z the covariate
    standardised over the rows; Wald test of the slope."""
    total, won = n.sum(), wins.sum()
    out = {"n": int(total), "wins": int(won), "beta_per_sd": None, "or_per_sd": None, "se": None, "p": None,
           "mean_delta": float((n * x).sum() / total) if total else None, "iterations": 0, "error": None}
    if not 0 < won < total:
        return out | {"error": "constant outcome (perfect separation)"}
    spread = math.sqrt((n * (x - out["mean_delta"]) ** 2).sum() / total)
    if not spread > 0:
        return out | {"error": "constant covariate"}
    z = (x - out["mean_delta"]) / spread
    b0 = b1 = 0.0
    for it in range(1, max_iter + 1):
        p = 1 / (1 + np.exp(-(b0 + b1 * z)))
        w, r = n * p * (1 - p), wins - n * p
        h00, h01, h11, g0, g1 = w.sum(), (w * z).sum(), (w * z * z).sum(), r.sum(), (r * z).sum()
        det = h00 * h11 - h01 * h01
        out["iterations"] = it
        if not (det > 0 and math.isfinite(det)):
            return out | {"error": "singular information matrix"}
        s0, s1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        b0, b1 = b0 + s0, b1 + s1
        if max(abs(s0), abs(s1)) < tol:
            break
    else:
        out["error"] = "did not converge"
    se = math.sqrt(h00 / det)
    return out | {"beta_per_sd": b1, "or_per_sd": math.exp(b1), "se": se, "p": math.erfc(abs(b1) / se / math.sqrt(2))}


def logit_per_group(df: DataFrame, keys: list[str], y: str, x: str, max_iter: int = MAX_ITER,
                    tol: float = TOL) -> DataFrame:
    """Logistic regression of the 0/1 column ``y`` on the standardised ``x`` in every group, planned
    lazily: one aggregation to cells (group, x value), then one small fit per group.

    The work of a fit grows with the distinct values of ``x``, not with the rows; ``x`` should be
    discrete (counts, word deltas). Rows with NULL y or x take no part. ``max_iter`` Newton steps
    without convergence are reported in ``error``."""
    cells = (df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x"))
             .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("double")).alias("_w")))
    fields = [f for f in df.select(*keys).schema.fields]
    schema = T.StructType(fields + list(T._parse_datatype_string(RESULT_SCHEMA).fields))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_x")
        out = fit_cells(pdf["_x"].to_numpy(float), pdf["_n"].to_numpy(float), pdf["_w"].to_numpy(float), max_iter, tol)
        return pd.DataFrame([dict(zip(keys, key)) | out], columns=[f.name for f in schema.fields])

    return cells.groupBy(*keys).applyInPandas(fit, schema)


def logit_distributed(df: DataFrame, keys: list[str], y: str, x: str, max_iter: int = MAX_ITER, tol: float = TOL) -> DataFrame:
    """The fit of :func:`logit_per_group` for a covariate of any kind and groups of any size: each Newton step is one
    aggregation of the rows to five sums a group, combined before the shuffle.

    The rows (keys, y, x) are written once, and the coefficients of the groups after every step, to the shared scratch folder, so
    a lost executor repeats one step at most; the driver only learns how many groups are not done. A group whose steps have become
    smaller than ``tol`` takes no part in further ones. ``keys`` may be NULL."""
    if not keys:
        raise ValueError("give at least one grouping key (use a literal column for a single group)")
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "newton")

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    rows = written(df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
                   .select(*keys, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x")), "rows")
    n, wins = F.count(F.lit(1)).alias("n"), F.sum("_y").cast("bigint").alias("wins")
    nothing = F.lit(None).cast("double")
    error = (F.when((F.col("wins") <= 0) | (F.col("wins") >= F.col("n")), F.lit("constant outcome (perfect separation)"))
             .when(~(F.col("_sd") > 0), F.lit("constant covariate")))
    groups = rows.groupBy(*keys).agg(n, wins, F.avg("_x").alias("mean_delta"), F.stddev_pop("_x").alias("_sd"))
    state = written(groups.select(*keys, "n", "wins", "mean_delta", "_sd", F.lit(0.0).alias("_b0"), F.lit(0.0).alias("_b1"), nothing.alias("_var"),
                                  F.lit(0).alias("iterations"), error.alias("error"), error.isNotNull().alias("_done")), "step=0")
    for step in range(1, max_iter + 1):
        z = (F.col("_x") - F.col("mean_delta")) / F.col("_sd")
        p = 1 / (1 + F.exp(-(F.col("_b0") + F.col("_b1") * z)))
        w, r = p * (1 - p), F.col("_y") - p
        open_ = state.where(~F.col("_done")).select(*keys, "mean_delta", "_sd", "_b0", "_b1")
        sums = join_null_safe(rows, open_, keys).groupBy(*keys).agg(
            F.sum(w).alias("_h00"), F.sum(w * z).alias("_h01"), F.sum(w * z * z).alias("_h11"), F.sum(r).alias("_g0"), F.sum(r * z).alias("_g1"))
        s = join_null_safe(state, sums, keys, "left").withColumn("_det", F.col("_h00") * F.col("_h11") - F.col("_h01") * F.col("_h01"))
        took = ~F.col("_done")
        fits = F.col("_det") > 0
        s = s.withColumns({"_s0": F.when(took & fits, (F.col("_h11") * F.col("_g0") - F.col("_h01") * F.col("_g1")) / F.col("_det")).otherwise(0.0),
                           "_s1": F.when(took & fits, (F.col("_h00") * F.col("_g1") - F.col("_h01") * F.col("_g0")) / F.col("_det")).otherwise(0.0)})
        small = F.greatest(F.abs("_s0"), F.abs("_s1")) < tol
        state = written(s.select(
            *keys, "n", "wins", "mean_delta", "_sd", (F.col("_b0") + F.col("_s0")).alias("_b0"), (F.col("_b1") + F.col("_s1")).alias("_b1"),
            F.when(took & fits, F.col("_h00") / F.col("_det")).otherwise(F.col("_var")).alias("_var"),
            F.when(took, step).otherwise(F.col("iterations")).alias("iterations"),
            F.when(took & ~F.coalesce(fits, F.lit(False)), F.lit("singular information matrix")).otherwise(F.col("error")).alias("error"),
            (F.col("_done") | ~F.coalesce(fits, F.lit(False)) | small).alias("_done")), f"step={step}")
        if state.where(~F.col("_done")).isEmpty():
            break
    found, se = F.col("iterations") > 0, F.sqrt("_var")
    found = found & ~F.coalesce(F.col("error") == "singular information matrix", F.lit(False))
    return state.select(
        *keys, "n", "wins", F.when(found, F.col("_b1")).alias("beta_per_sd"), F.when(found, F.exp("_b1")).alias("or_per_sd"), F.when(found, se).alias("se"),
        F.when(found, ST.erfc(F.abs("_b1") / se / math.sqrt(2))).alias("p"), "mean_delta", "iterations",
        F.coalesce("error", F.when(~F.col("_done"), F.lit("did not converge"))).alias("error"))
