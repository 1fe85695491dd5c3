"""Run-table properties: keep-last, upsert idempotence, pending completeness, guards, filters."""

import hashlib

from pyspark.sql import functions as F

from pairjudge.operators import runs as R
from pairjudge.plans import QUERIES
from tests.conftest import SF_SMALL


def _stored(spark):
    rows = [("1", "j", "", 1, 10.0), ("1", "j", "paper_minimal", 2, 20.0), ("1", "j", "guided", 3, 30.0),
            ("2", "j", None, 4, 40.0), ("2", "k", "", 5, 50.0)]
    return spark.createDataFrame(rows, "item_id string, judge_model string, prompt_variant string, seq long, value double") \
        .withColumn("prompt_variant", R.normalized_variant(F.col("prompt_variant")))


def test_dedupe_keep_last(spark):
    d = R.dedupe_keep_last(_stored(spark), ["item_id", "judge_model", "prompt_variant"], ["seq"])
    got = sorted((r["item_id"], r["judge_model"], r["prompt_variant"], r["seq"]) for r in d.collect())
    assert got == [("1", "j", "guided", 3), ("1", "j", "paper_minimal", 2), ("2", "j", "paper_minimal", 4),
                   ("2", "k", "paper_minimal", 5)]


def test_dedupe_hot_key(spark):
    df = spark.range(30000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    r = R.dedupe_keep_last(df, ["k"], ["seq"]).first()
    assert r["seq"] == 29999 and r["v"] == 59998


def test_upsert_idempotent(spark):
    st = _stored(spark)
    run = R.run_predicate("judge_model", "j", "prompt_variant", "")
    view = spark.createDataFrame([("1", "j", "paper_minimal", 9, 90.0)], st.schema)
    once = R.upsert_run(st, run, view)
    twice = R.upsert_run(once, run, view)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert once.where(run).count() == 1


def test_pending_union_done_is_wanted(spark):
    from pairjudge.plans.q_runs import pending_rows_df, valid, wanted
    w = wanted(spark, SF_SMALL)
    p = pending_rows_df(spark, SF_SMALL)
    done = valid(spark, SF_SMALL).select("item_id", "judge", "dimension").join(w, ["item_id", "judge", "dimension"], "left_semi")
    assert p.unionByName(done).distinct().count() == w.count()
    assert p.join(done, ["item_id", "judge", "dimension"]).count() == 0


def test_variant_guard_blanks_whole_run(spark):
    rows = [("r1", "1", "text", "v1", "A"), ("r1", "2", "text", "v3", "B"),      # a generated row of another variant
            ("r2", "1", "", "v1", "A"), ("r2", "2", "text", "v3", "B"),           # another variant, but nothing generated there
            ("r3", "1", "", "v3", "A"), ("r3", "2", None, None, "B"),             # nothing generated at all
            (None, "1", "text", "v3", "A")]
    df = spark.createDataFrame(rows, "run string, item_id string, generated_empathy_answer string, generation_prompt_variant string, pred_choice string")
    g = R.variant_guard(df, ["run"], "generated_empathy_answer", "generation_prompt_variant", "v3")
    got = {(r["run"], r["item_id"]): (r["generated_empathy_answer"], r["pred_choice"]) for r in g.collect()}
    assert got == {("r1", "1"): ("", ""), ("r1", "2"): ("", ""), ("r2", "1"): ("", "A"), ("r2", "2"): ("text", "B"),
                   ("r3", "1"): ("", ""), ("r3", "2"): (None, ""), (None, "1"): ("text", "A")}


def test_run_scope_seed_and_shot(spark):
    rows = [("j", "", "42", "zero-shot"), ("j", None, None, "zero-shot"), ("j", "paper_minimal", "42.0", "zero-shot"),
            ("j", "", "43", "zero-shot"), ("j", "", "42", "few-shot"), ("k", "", "42", "zero-shot"), ("j", "", "x", "zero-shot")]
    df = spark.createDataFrame(rows, "judge string, variant string, seed string, shot string")
    run = R.run_predicate("judge", "j", "variant", "paper_minimal", "seed", 42, "shot", "zero-shot")
    assert sorted(str(r["seed"]) for r in df.where(run).collect()) == ["42", "42.0", "None", "x"]


def test_named_filters_single_pass(spark):
    df = spark.createDataFrame([(1, 5), (2, -1)], "id int, x int")
    out = R.named_filters(df, {"pos": F.col("x") > 0, "all": F.lit(True), "none": F.lit(None)}, ["id"])
    assert sorted((r["id"], r["filter_name"]) for r in out.collect()) == [(1, "all"), (1, "pos"), (2, "all")]


def test_next_n_pending_is_ordered_prefix(spark):
    from pairjudge.plans.q_runs import pending_rows_df
    first = [tuple(r) for r in QUERIES["next_n_pending"](spark, SF_SMALL).collect()]
    allp = sorted(tuple(r) for r in pending_rows_df(spark, SF_SMALL).select("item_id", "judge", "dimension").collect())
    assert sorted(first, key=lambda t: (t[1], t[2], t[0])) == sorted(allp, key=lambda t: (t[1], t[2], t[0]))[:len(first)]


def test_explanation_pending_is_whole(spark):
    from pairjudge.plans.common import long_verdicts
    lost = {(r["item_id"], r["judge"], r["dimension"]) for r in long_verdicts(spark, SF_SMALL).collect()
            if r["dimension"] in ("empathy", "quality") and r["pred_source"] == "Original"}
    open_ = {k for k in lost if hashlib.md5((k[0] + k[1]).encode()).hexdigest()[0] >= "4"}  # a quarter is settled, no more
    got = [tuple(r) for r in QUERIES["explanation_pending"](spark, SF_SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == open_ and 0 < len(open_) < len(lost)
