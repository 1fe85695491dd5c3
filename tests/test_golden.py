"""Golden numbers: statistics recomputed from the counts the evaluated study published."""

import pytest
from pyspark.sql import functions as F

from pairjudge.functions import stats as ST
from pairjudge.operators import agreement as AG
from pairjudge.operators import resample as RS

# (n10, n01, published p)
MCNEMAR = [(309, 12, 2.58599e-61), (6, 24, 0.00191078), (23, 15, 0.256145), (316, 0, 2.93211e-70),
           (39, 11, 0.000134333), (8, 123, 2.27544e-23), (3, 11, 0.057373), (40, 0, 6.98439e-10)]


def test_mcnemar_published(spark):
    df = spark.createDataFrame(MCNEMAR, "n10 long, n01 long, want double")
    rows = df.select("want", ST.mcnemar_p("n10", "n01").alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(r["want"], rel=1e-5)


# (n10, n01, sum_a, sum_b, published kappa), n = 1000
KAPPA = [(6, 24, 974, 992, 0.107), (23, 15, 977, 969, 0.277), (316, 0, 998, 682, 0.009),
         (309, 12, 975, 678, 0.03), (8, 123, 874, 989, 0.024), (3, 11, 988, 996, 0.12),
         (40, 0, 1000, 960, 0.0), (39, 11, 988, 960, 0.02)]


def _expand(spark, n10, n01, sa, n=1000):
    n11 = sa - n10
    n00 = n - n11 - n10 - n01
    rows = [(1, 1)] * n11 + [(1, 0)] * n10 + [(0, 1)] * n01 + [(0, 0)] * n00
    return spark.createDataFrame([(f"i{i}", "g", a, b) for i, (a, b) in enumerate(rows)],
                                 "item_id string, g string, a int, b int")


@pytest.mark.parametrize("n10,n01,sa,sb,want", KAPPA)
def test_kappa_published(spark, n10, n01, sa, sb, want):
    df = _expand(spark, n10, n01, sa)
    r = AG.cohen_kappa(df, "a", "b", ["g"]).first()
    assert r["n"] == 1000
    assert round(r["kappa"], 3) == pytest.approx(want, abs=1e-9)
    m = AG.mcnemar(df, "a", "b", ["g"]).first()
    assert (m["n10"], m["n01"], m["sum_a"], m["sum_b"]) == (n10, n01, sa, sb)


def test_kappa_undefined_when_both_constant(spark):
    df = _expand(spark, 0, 0, 1000)
    r = AG.cohen_kappa(df, "a", "b", ["g"]).first()
    assert r["kappa"] is None and r["pct_agree"] == 1.0
    assert r["strength"] == "degenerate: base rate ~constant"


# (successes, n, published low, published high) — calibration accuracy and category pass rates
WILSON = [(270, 276, 0.953, 0.990), (134, 147, 0.855, 0.948), (79, 110, 0.628, 0.794),
          (254, 276, 0.882, 0.947), (59, 100, 0.492, 0.681), (100, 100, 0.963, 1.000), (77, 100, 0.678, 0.842)]


def test_wilson_published(spark):
    df = spark.createDataFrame(WILSON, "k long, n long, lo double, hi double")
    for r in df.select("lo", "hi", ST.wilson_low("k", "n").alias("l"), ST.wilson_high("k", "n").alias("h")).collect():
        assert round(r["l"], 3) == pytest.approx(r["lo"], abs=1.5e-3)
        assert round(r["h"], 3) == pytest.approx(r["hi"], abs=1.5e-3)


def test_wilson_undefined_for_empty(spark):
    r = spark.range(1).select(ST.wilson_low(F.lit(0), F.lit(0)).alias("l")).first()
    assert r["l"] is None


# (passes, n, published CI in %) — B = 10,000 percentile bootstrap; draws differ, tolerance 0.3 pp
BOOT = [(975, 1000, 96.5, 98.4), (678, 1000, 64.9, 70.7), (950, 1000, 93.6, 96.3), (988, 1000, 98.1, 99.4),
        (673, 1000, 64.3, 70.2), (866, 1000, 84.5, 88.7)]


@pytest.mark.parametrize("k,n,lo,hi", BOOT)
def test_bootstrap_cells_published(spark, k, n, lo, hi):
    rows = [("s", 1)] * k + [("s", 0)] * (n - k)
    df = spark.createDataFrame(rows, "setting string, flag int")
    r = RS.binomial_bootstrap_rate(df, ["setting"], "flag", B=10000, seed=42).first()
    assert r["k"] == k and r["n"] == n
    assert abs(r["ci_low"] * 100 - lo) <= 0.3 + 1e-9
    assert abs(r["ci_high"] * 100 - hi) <= 0.3 + 1e-9


def test_hash_poisson_bootstrap_matches_published_interval(spark):
    """Hash-Poisson resampling (the SQL-checkable form) at k=678, n=1000, B=2000."""
    rows = [(f"i{i}", "s", 1 if i < 678 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "item_id string, setting string, flag int")
    r = RS.poisson_bootstrap_mean(df, ["setting"], "item_id", "flag", B=2000, seed=42).first()
    assert r["estimate"] == pytest.approx(0.678)
    assert abs(r["ci_low"] * 100 - 64.9) <= 0.5 and abs(r["ci_high"] * 100 - 70.7) <= 0.5


def test_kappa_strength_bands(spark):
    vals = [(-0.1, "poor"), (0.1, "slight"), (0.3, "fair"), (0.5, "moderate"), (0.7, "substantial"),
            (0.9, "almost perfect"), (None, "undefined")]
    df = spark.createDataFrame(vals, "k double, want string")
    for r in df.select("want", ST.kappa_strength(F.col("k")).alias("s")).collect():
        assert r["s"] == r["want"]


# (n10, n01, sum_a, published low, published high) — kappa B = 2,000 bootstrap, n = 1000
KAPPA_CI = [(6, 24, 974, -0.012, 0.258), (23, 15, 977, 0.111, 0.439), (316, 0, 998, 0.000, 0.022),
            (309, 12, 975, -0.001, 0.062), (8, 123, 874, -0.015, 0.074), (39, 11, 988, -0.023, 0.107)]


@pytest.mark.parametrize("n10,n01,sa,lo,hi", KAPPA_CI)
def test_kappa_bootstrap_cells_published(spark, n10, n01, sa, lo, hi):
    df = _expand(spark, n10, n01, sa)
    r = RS.multinomial_bootstrap_kappa(df, ["g"], "a", "b", B=2000, seed=42).first()
    assert abs(r["ci_low"] - lo) <= 0.03 and abs(r["ci_high"] - hi) <= 0.03


def test_hex_threshold_weight_equals_numeric_weight(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("i"))
    w1 = ST.poisson1_weight(ST.hash_uniform(F.lit(42), F.lit(7), F.col("i")))
    w2 = ST.poisson1_weight_hashed(F.lit(42), F.lit(7), F.col("i"))
    assert df.where(w1 != w2).count() == 0
    dist = {r["w"]: r["count"] for r in df.select(w2.alias("w")).groupBy("w").count().collect()}
    assert abs(dist[0] / 20000 - 0.3679) < 0.02 and abs(dist[1] / 20000 - 0.3679) < 0.02
