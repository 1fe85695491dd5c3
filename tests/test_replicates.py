"""Replicate vectors, sparse contingency tables, order statistics over generated positions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairjudge.operators import agreement as AG
from pairjudge.operators import assign as A
from pairjudge.operators import resample as RS


def test_replicate_vectors_equal_plain_weights(spark):
    rnd = random.Random(8)
    rows = [(f"i{i}", rnd.choice(["a", None, "b"]), rnd.gauss(3, 2) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, g string, v double")
    B, got = 500, {}
    for parts in (1, 7):
        got = {r["g"]: r for r in RS.poisson_bootstrap_mean(df.repartition(parts), ["g"], "id", "v", B=B, seed=5).collect()}
        assert len(got) == 3
        for g in ("a", None, "b"):
            swx, sw, values = np.zeros(B), np.zeros(B), []
            for i, k, v in rows:
                if k == g and v is not None:
                    h = hashlib.md5(f"5:{i}".encode()).hexdigest()
                    a, b = 1 + int(h[:8], 16) % (RS.PRIME - 1), int(h[8:16], 16) % RS.PRIME
                    w = np.array([sum((a * rep + b) % RS.PRIME >= t for t in RS.POISSON_STEPS) for rep in range(1, B + 1)])
                    sw, swx = sw + w, swx + w * v
                    values.append(v)
            low, high = np.quantile(swx[sw > 0] / sw[sw > 0], (0.025, 0.975))
            assert got[g]["n"] == len(values) and math.isclose(got[g]["estimate"], sum(values) / len(values))
            assert math.isclose(got[g]["ci_low"], low, rel_tol=1e-9) and math.isclose(got[g]["ci_high"], high, rel_tol=1e-9)


def test_weights_are_poisson_and_uncorrelated_between_replicates():
    rnd = np.random.default_rng(1)
    w = RS._weights(rnd.integers(1, RS.PRIME, 4000), rnd.integers(0, RS.PRIME, 4000), 300)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w.sum(axis=0)[:-1], w.sum(axis=0)[1:])[0, 1]) < 0.2
    assert np.abs(np.corrcoef(w.T)[np.triu_indices(300, 1)]).mean() < 0.02


def test_interval_has_the_width_of_the_closed_form(spark):
    df = spark.range(2000).select(F.col("id"), F.lit(1).alias("g"), F.expr("pmod(xxhash64(id), 1000) / 100.0").alias("v"))
    r = RS.poisson_bootstrap_mean(df, ["g"], "id", "v").first()
    sd = df.agg(F.stddev_pop("v")).first()[0]
    assert abs((r["ci_high"] - r["ci_low"]) / (2 * 1.96 * sd / math.sqrt(2000)) - 1) < 0.05


def test_many_groups_are_passed_on(spark, monkeypatch):
    df = spark.range(900).select("id", (F.col("id") % 300).alias("g"), F.col("id").cast("double").alias("v"))
    assert RS.poisson_bootstrap_mean(df, ["g"], "id", "v", B=20).count() == 300


def test_empty_input(spark):
    assert RS.poisson_bootstrap_mean(spark.createDataFrame([], "id string, g string, v double"), ["g"], "id", "v", B=20).count() == 0


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_kappa_of_labels_against_dense_table(spark, keys):
    rnd = random.Random(2)
    rows = [(rnd.choice(["x", None]), rnd.choice("abcde"), rnd.choice("abcxyz") if rnd.random() < 0.6 else "a") for _ in range(900)] + [("x", None, "a")]
    got = {r["g"] if keys else 0: r for r in AG.cohen_kappa_labels(spark.createDataFrame(rows, "g string, a string, b string"), "a", "b", keys).collect()}
    for g in ({"x", None} if keys else {0}):
        pairs = [(a, b) for k, a, b in rows if a and (not keys or k == g)]
        n = len(pairs)
        po = sum(a == b for a, b in pairs) / n
        labels = {x for p in pairs for x in p}
        pe = sum(sum(a == x for a, _ in pairs) * sum(b == x for _, b in pairs) for x in labels) / n / n
        assert got[g]["n"] == n and math.isclose(got[g]["kappa"], (po - pe) / (1 - pe), rel_tol=1e-12)


def test_kappa_of_100_000_labels(spark):
    df = spark.range(300_000).select((F.col("id") % 100_000).alias("a"), F.when(F.col("id") < 150_000, F.col("id") % 100_000).otherwise(F.col("id") % 99_991).alias("b"))
    r = AG.cohen_kappa_labels(df, "a", "b", []).first()
    i = np.arange(300_000)
    a, b = i % 100_000, np.where(i < 150_000, i % 100_000, i % 99_991)
    pe = (np.bincount(a, minlength=100_000).astype(float) @ np.bincount(b, minlength=100_000)) / 300_000 ** 2
    po = (a == b).mean()
    assert math.isclose(r["kappa"], (po - pe) / (1 - pe), rel_tol=1e-9)


@pytest.mark.parametrize("n,most", [(1, 10), (2, 10), (999, 10), (5000, 100), (5000, 10_000)])
def test_nth_position(spark, n, most):
    order = sorted((hashlib.md5(f"7:position:{i}".encode()).hexdigest()[:12], i) for i in range(n))
    for nth in {1, n // 2 or 1, n}:
        assert A.nth_position(spark, 7, n, nth, digits=1 if most < 1000 else 4, most=most) == order[nth - 1]


def test_two_source_order_runs_few_shuffles(spark):
    df = spark.range(4000).select(F.concat(F.lit("x"), "id").alias("item_id"), (F.col("id") % 2).alias("k"))
    out = A.balanced_ab_shuffle(df, 42, keys=["k"]).groupBy("k", "gold_choice").count()
    assert sorted(r["count"] for r in out.collect()) == [1000] * 4
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 2
