"""Run ledger: waves by unit key, half-written waves, NULL keys, attempts; rounds of an incremental run."""

import pytest
from pyspark.sql import functions as F

from pairjudge.operators import runs as R
from pairjudge.operators import scoring as SC
from pairjudge.operators.ledger import RunLedger
from pairjudge.sources import files
from pairjudge.sources.io import scratch_path


def units(spark, names):
    return spark.createDataFrame([(n, "only A or B", f"prompt {n}") for n in names], "uid string, system string, user string")


def scorer(bad=(), calls=None):
    def factory(options):
        def score(systems, users, ctx):
            if calls:
                with open(calls, "a") as f:
                    f.writelines(u + "\n" for u in users)
            return [SC.ScoringError("no", 500) if u in bad else "A" for u in users]
        return score

    def run(batch):
        return SC.score_rows(batch, keep=["uid", "wave"], factory=factory, partitions=4, pause_s=0.0, max_attempts=1)
    return run


def rows(spark, store):
    return sorted(((r["uid"], r["error"]) for r in spark.read.parquet(store).collect()), key=str)


def test_new_units_get_waves_of_their_own(spark):
    store = scratch_path(spark, "ledger-new")
    SC.score_in_waves(units(spark, [f"u{i}" for i in range(10)]), "uid", 10, 5, scorer(), store)
    stats = SC.score_in_waves(units(spark, [f"n{i}" for i in range(4)]), "uid", 10, 5, scorer(), store).orderBy("wave").collect()
    assert [(r["wave"], r["scored"]) for r in stats] == [(0, 10), (1, 4)]
    assert rows(spark, store) == sorted([(f"u{i}", 0) for i in range(10)] + [(f"n{i}", 0) for i in range(4)])
    assert SC.score_in_waves(units(spark, ["u1", "n1"]), "uid", 10, 5, scorer(), store).count() == 2
    assert spark.read.parquet(store).count() == 14


def test_wave_without_a_file_is_scored_again(spark):
    store = scratch_path(spark, "ledger-empty-wave")
    u = units(spark, [f"u{i}" for i in range(30)])
    SC.score_in_waves(u, "uid", 10, 0, scorer({f"prompt u{i}" for i in range(30)}), store)  # waves 1 and 2 are skipped
    files.touch(spark, f"{store}/wave=1/_temporary/0/part-00000")  # a wave that was cut short before any task was done
    stats = SC.score_in_waves(u, "uid", 10, 5, scorer(), store).orderBy("wave").collect()
    assert [(r["scored"], r["failed"], r["skipped"]) for r in stats] == [(10, 10, False), (10, 0, False), (10, 0, False)]
    assert spark.read.parquet(store).select("uid").distinct().count() == 30


def test_half_written_wave_keeps_its_replies(spark, tmp_path):
    store, calls = scratch_path(spark, "ledger-half"), str(tmp_path / "calls")
    u = units(spark, [f"u{i:02d}" for i in range(40)])

    def broken(batch):
        return scorer(calls=calls)(batch).withColumn("raw_response", F.when(F.col("uid") == "u07", F.raise_error(F.lit("lost"))).otherwise(F.col("raw_response")))

    with pytest.raises(Exception, match="lost"):
        SC.score_in_waves(u, "uid", 40, 5, broken, store)
    ledger = RunLedger(spark, store, ["uid"])
    kept = ledger.results()
    kept = set() if kept is None else {r["uid"] for r in kept.collect()}
    assert "u07" not in kept and not ledger._marked("wave")
    open(calls, "w").close()
    stats, = SC.score_in_waves(u, "uid", 40, 5, scorer(calls=calls), store).collect()
    sent = open(calls).read().split("\n")[:-1]
    assert sorted(sent) == [f"prompt u{i:02d}" for i in range(40) if f"u{i:02d}" not in kept]
    assert stats["scored"] == 40 and rows(spark, store) == [(f"u{i:02d}", 0) for i in range(40)]


def test_claims_without_a_mark_are_written_anew(spark):
    store = scratch_path(spark, "ledger-claims")
    spark.createDataFrame([("other", 7, 1)], "uid string, wave int, wave_attempt int").write.parquet(f"{store}-ledger/claims/batch=0")
    SC.score_in_waves(units(spark, ["a", "b"]), "uid", 10, 5, scorer(), store)
    assert [(r["uid"], r["wave"]) for r in RunLedger(spark, store, ["uid"]).claims().orderBy("uid").collect()] == [("a", 0), ("b", 0)]


def test_unit_that_its_wave_left_out_is_claimed_again(spark):
    store = scratch_path(spark, "ledger-left-out")
    u = units(spark, [f"u{i}" for i in range(20)])
    SC.score_in_waves(u, "uid", 10, 0, scorer({f"prompt u{i}" for i in range(20)}), store)  # wave 1 is claimed and skipped
    waiting = [r["uid"] for r in RunLedger(spark, store, ["uid"]).claims().where("wave = 1").orderBy("uid").collect()]
    SC.score_in_waves(u.where(F.col("uid").isin(waiting[:6])), "uid", 10, 5, scorer(), store)
    stats = SC.score_in_waves(u, "uid", 10, 5, scorer(), store).orderBy("wave").collect()
    assert [(r["wave"], r["scored"]) for r in stats] == [(0, 10), (1, 6), (2, 4)]
    assert spark.read.parquet(store).select("uid").distinct().count() == 20


def test_attempts_and_null_keys(spark):
    store = scratch_path(spark, "ledger-attempts")
    u = units(spark, [None, "a", "b", "c"])
    bad = {"prompt b"}
    for n in (4, 0, 0):
        before = spark.read.parquet(store).count() if files.has_data(spark, store) else 0
        SC.score_in_waves(u, "uid", 10, 5, scorer(bad), store)
        assert spark.read.parquet(store).count() - before == n
    SC.score_in_waves(u, "uid", 10, 5, scorer(bad), store, attempts=3)
    SC.score_in_waves(u, "uid", 10, 5, scorer(), store, attempts=3)
    SC.score_in_waves(u, "uid", 10, 5, scorer(), store, attempts=3)
    assert rows(spark, store) == sorted([(None, 0), ("a", 0), ("b", 1), ("b", 1), ("b", 0), ("c", 0)], key=str)


def test_pending_and_rounds_with_null_keys(spark):
    w = spark.createDataFrame([("a", "x"), (None, "x"), ("b", None), ("c", "x")], "uid string, k string")
    done = spark.createDataFrame([("a", "x"), (None, "x"), ("b", None)], "uid string, k string")
    assert [tuple(r) for r in R.pending(w, done, ["uid", "k"]).collect()] == [("c", "x")]
    store = scratch_path(spark, "rounds-null")
    u = units(spark, [None, "a", "b"])

    def score(batch):
        return SC.score_rows(batch, keep=["uid"], pause_s=0.0)
    assert [SC.incremental_run(u, ["uid"], 2, score, store).count() for _ in range(3)] == [2, 1, 0]
    files.touch(spark, f"{store}/round=3/_temporary/0/part-00000")
    assert SC.incremental_run(u, ["uid"], 2, score, store).count() == 0


def test_round_cut_short_keeps_its_replies(spark):
    store = scratch_path(spark, "rounds-cut")
    u = units(spark, [f"u{i:02d}" for i in range(12)])

    def score(batch):
        return SC.score_rows(batch, keep=["uid"], partitions=4, pause_s=0.0)

    def broken(batch):
        return score(batch).withColumn("raw_response", F.when(F.col("uid") == "u03", F.raise_error(F.lit("lost"))).otherwise(F.col("raw_response")))
    with pytest.raises(Exception, match="lost"):
        SC.incremental_run(u, ["uid"], 12, broken, store)
    SC.incremental_run(u, ["uid"], 12, score, store)
    got = [r["uid"] for r in spark.read.parquet(store).collect()]
    assert sorted(got) == [f"u{i:02d}" for i in range(12)]


def test_failed_explanation_is_not_pending(spark):
    df = spark.createDataFrame([(1, "Original", "", ""), (2, "Original", None, " HTTP 503"), (3, "Original", "why", ""), (4, "Generated", "", ""), (5, "Original", None, None)],
                               "i int, s string, e string, err string")
    assert [r["i"] for r in R.explanation_pending(df, "s", "e", error_col="err").orderBy("i").collect()] == [1, 5]
