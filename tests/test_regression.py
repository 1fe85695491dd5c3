"""Per-group logit against a direct Newton fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairjudge.operators import regression as RG


def _newton(x, y):
    z = (x - x.mean()) / x.std()
    X = np.column_stack([np.ones_like(z), z])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ b))
        W = p * (1 - p)
        H = X.T @ (X * W[:, None])
        step = np.linalg.solve(H, X.T @ (y - p))
        b += step
        if np.abs(step).max() < 1e-12:
            break
    se = np.sqrt(np.linalg.inv(H)[1, 1])
    return b[1], se


def test_logit_matches_newton(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in ("a", "b"):
        x = rng.normal(10, 5, 400).round()
        p = 1 / (1 + np.exp(-(0.3 + 0.08 * (x - 10))))
        y = (rng.random(400) < p).astype(int)
        rows += [(g, float(xi), int(yi)) for xi, yi in zip(x, y)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    out = {r["g"]: r for r in RG.logit_per_group(df, ["g"], "y", "x").collect()}
    for g in ("a", "b"):
        xs = np.array([r[1] for r in rows if r[0] == g])
        ys = np.array([r[2] for r in rows if r[0] == g])
        beta, se = _newton(xs, ys)
        assert out[g]["beta_per_sd"] == pytest.approx(beta, rel=1e-6)
        from math import erfc, sqrt
        assert out[g]["p"] == pytest.approx(erfc(abs(beta) / se / sqrt(2)), rel=1e-5)


def test_logit_constant_outcome_reports_error(spark):
    df = spark.range(50).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"), F.lit(1).alias("y"))
    r = RG.logit_per_group(df, ["g"], "y", "x").first()
    assert r["beta_per_sd"] is None and "separation" in r["error"]


def test_distributed_steps_equal_the_fit_on_cells(spark):
    import math
    import random

    from pairjudge.operators import regression as RG
    rnd = random.Random(4)
    rows = []
    for g, slope in (("a", 0.8), (None, -0.3), ("c", 2.5)):
        for _ in range(700):
            x = rnd.gauss(5, 3)
            rows.append((g, int(rnd.random() < 1 / (1 + math.exp(-(0.2 + slope * (x - 5) / 3)))), x))
    rows += [("all", 1, float(i)) for i in range(5)] + [("flat", i % 2, 1.0) for i in range(6)] + [("apart", int(i > 4), float(i)) for i in range(10)] + [("a", None, 1.0), ("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, y int, x double")
    a = {r["g"]: r for r in RG.logit_per_group(df, ["g"], "y", "x").collect()}
    b = {r["g"]: r for r in RG.logit_distributed(df, ["g"], "y", "x").collect()}
    assert a.keys() == b.keys()
    for g in a:
        assert (a[g]["n"], a[g]["wins"]) == (b[g]["n"], b[g]["wins"])
        if g in ("a", None, "c"):
            assert a[g]["error"] is None and b[g]["error"] is None
            assert all(math.isclose(a[g][c], b[g][c], rel_tol=1e-8, abs_tol=1e-12) for c in ("beta_per_sd", "or_per_sd", "se", "p", "mean_delta"))
        elif g != "apart":
            assert a[g]["error"] == b[g]["error"] and b[g]["beta_per_sd"] is None
        else:
            assert b[g]["error"]
