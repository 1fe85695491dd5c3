"""NULL keys and ids are kept; replies that are not JSON objects; full texts."""

import pytest
from pyspark.sql import functions as F

from pairjudge.functions import stats as ST
from pairjudge.functions import text as T
from pairjudge.operators import assign as A
from pairjudge.operators import regression as RG
from pairjudge.operators import resample as RS


def test_null_keys_and_ids_keep_their_rows(spark):
    rows = [(f"i{i}", k) for i in range(9) for k in ("a", "b", None)] + [(None, "a")]
    df = spark.createDataFrame(rows, "item_id string, k string")
    ranked = A.exact_rank(df.withColumn("h", F.md5(F.coalesce("item_id", F.lit("")))), "h", ["item_id"], keys=["k"])
    assert sorted(r["rank"] for r in ranked.where("k IS NULL").collect()) == list(range(1, 10)) and ranked.count() == len(rows)
    for assigned in (A.balanced_ab_hash(df, 42, keys=["k"]), A.balanced_ab_shuffle(df, 42, keys=["k"])):
        got = {r["k"]: (r["n"], r["a"]) for r in assigned.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("target_is_a").alias("a")).collect()}
        assert got["b"][0] == got[None][0] == 9 and got["a"] == (10, 5) and got["b"][1] in (4, 5) and got[None][1] in (4, 5)


def test_threshold_order_equals_ranking(spark):
    df = spark.range(999).select(F.concat(F.lit("x"), "id").alias("item_id"), (F.col("id") % 3).alias("k"), F.lit("text").alias("t"))
    for digits in (1, 4):
        x = df.withColumn("h", F.md5("item_id"))
        got = x.withColumn("a", A.among_smallest(x, "h", "item_id", lambda n: F.floor(n / 2), ["k"], digits))
        want = A.exact_rank(x, "h", ["item_id"], keys=["k"]).withColumn("w", F.col("rank") <= 166)
        assert got.join(want.select("item_id", "w"), "item_id").where("a <> w").count() == 0 and got.where("a").count() == 498


def test_balanced_order_shuffles_no_text(spark):
    df = spark.range(100).select(F.concat(F.lit("x"), "id").alias("item_id"), F.repeat(F.lit("long"), 50).alias("long_text"))
    out = A.balanced_ab_hash(df.select("item_id", F.concat("long_text", "item_id").alias("long_text")), 42)
    plan = out._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Window" not in main


def test_standardize_and_bootstrap_null_group(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), (None, 3, 5.0), (None, 4, 7.0)], "g string, i int, x double")
    assert RG.standardize(df, ["g"], "x").count() == 4
    assert RS.poisson_bootstrap_mean(df, ["g"], "i", "x", B=50).count() == 2
    rates = RS.binomial_bootstrap_rate(df.withColumn("f", F.lit(1)), ["g"], "f", B=100).collect()
    assert [(r["n"], r["ci_low"], r["ci_high"]) for r in rates] == [(2, 1.0, 1.0)] * 2


def test_resampling_weights_have_no_ceiling():
    assert len(ST.POISSON1_CDF) > 12 and ST.POISSON1_CDF[-1] < 1
    assert ST.POISSON1_CDF[:2] == pytest.approx([0.36787944117, 0.73575888234])


@pytest.mark.parametrize("reply,want", [
    ('"It is formulaic"', '"It is formulaic"'), ("[1, 2]", "[1, 2]"), ("7", "7"), ("true", "true"),
    ('{"mismatch_explanation": "a", "mismatch_explanation": "b"}', "b"), ('{"reason": "r"}', "r"), ('{"other": 1}', ""),
    ('Sure: {"reason": " x "} ok', "x"), ('{"reason": "x"} and {"reason": "y"}', '{"reason": "x"} and {"reason": "y"}'),
    ("z" * 700, "z" * 700), ("", ""), (None, "")])
def test_explanations(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(T.mismatch_explanation("r")).first()[0] == want


def test_error_text_is_whole_and_cut_for_display_only(spark):
    df = spark.createDataFrame([("m" * 2000,)], "m string").select(T.classify_error(F.lit(500), F.col("m"), F.lit("E")).alias("e"))
    assert len(df.first()["e"]) > 2000
    assert df.select(T.shown("e", 10)).first()[0].endswith("...")
