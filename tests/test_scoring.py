"""Scoring with an injected scorer: error rows, retry counts, resumable runs, failure budget."""

from pyspark.sql import functions as F

from pairjudge.operators import scoring as SC
from pairjudge.sources.io import scratch_path


def _units(spark, n=60):
    return spark.range(n).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("uid"),
                                 F.lit("You are an AI judge. Follow the user instruction exactly and answer with only A or B.").alias("system"),
                                 F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("user"))


def failing_on(bad: set, flaky: set, calls: str | None = None):
    """Fails ``bad`` prompts always and ``flaky`` ones on the first attempt; notes every prompt sent."""
    def factory(options):
        def score(systems, users, ctx):
            out = []
            for u, attempt in zip(users, ctx["attempt"]):
                if calls:
                    with open(calls, "a") as f:
                        f.write(u + "\n")
                if u in bad:
                    out.append(SC.ScoringError("Rate limit | reached", 429))
                elif u in flaky and attempt == 1:
                    out.append(SC.ScoringError("server error", 500))
                else:
                    out.append("A")
            return out
        return score
    return factory


def test_two_calls_at_most_and_good_prompts_once(spark, tmp_path):
    calls = str(tmp_path / "calls")
    SC.score_rows(_units(spark), keep=["uid"], factory=failing_on({"prompt 3"}, {"prompt 5"}, calls), partitions=4, pause_s=0.0).collect()
    sent = open(calls).read().splitlines()
    assert {u: sent.count(u) for u in set(sent)} == {f"prompt {i}": 2 if i in (3, 5) else 1 for i in range(60)}


def test_short_or_missing_replies_are_errors(spark):
    def short(options):
        return lambda systems, users, ctx: ["A"] * (len(users) - 1)

    def none(options):
        return lambda systems, users, ctx: [None] * len(users)

    def broken(options):
        def score(systems, users, ctx):
            raise ValueError("down")
        return score

    for factory, text in ((short, "0 replies to 1 prompts"), (none, "no reply"), (broken, "down")):
        rows = SC.score_rows(_units(spark, 10), keep=["uid"], factory=factory, pause_s=0.0).collect()
        assert len(rows) == 10 and all(r["error"] == 1 and r["attempts"] == 2 and r["error_message"] == text for r in rows)


def test_failed_units_are_pending_again(spark):
    store = scratch_path(spark, "test-again")
    units = _units(spark, 10)
    bad = {"prompt 2", "prompt 4"}
    SC.incremental_run(units, ["uid"], 10, lambda b: SC.score_rows(b, keep=["uid"], factory=failing_on(bad, set()), pause_s=0.0), store)
    again = SC.incremental_run(units, ["uid"], 10, lambda b: SC.score_rows(b, keep=["uid"], pause_s=0.0), store)
    assert sorted(r["uid"] for r in again.collect()) == ["u2", "u4"]
    assert SC.incremental_run(units, ["uid"], 10, lambda b: SC.score_rows(b, keep=["uid"]), store).count() == 0


def test_waves_resume(spark):
    store = scratch_path(spark, "test-wave-resume")
    units = _units(spark, 100)
    bad = {f"prompt {i}" for i in range(0, 100, 2)}
    first = SC.score_in_waves(units, "uid", 25, 5, lambda b: SC.score_rows(b, keep=["uid", "wave"], factory=failing_on(bad, set()), pause_s=0.0), store)
    assert [r["skipped"] for r in first.orderBy("wave").collect()] == [False, True, True, True]
    rest = SC.score_in_waves(units, "uid", 25, 5, lambda b: SC.score_rows(b, keep=["uid", "wave"], pause_s=0.0), store).orderBy("wave").collect()
    assert [r["skipped"] for r in rest] == [False] * 4 and [r["failed"] for r in rest][1:] == [0, 0, 0] and rest[0]["failed"] > 5
    assert spark.read.parquet(store).count() == 100


def test_error_rows_and_retry(spark):
    bad = {"prompt 3", "prompt 17"}
    flaky = {"prompt 5"}
    out = SC.score_rows(_units(spark), keep=["uid"], factory=failing_on(bad, flaky), partitions=4, pause_s=0.0)
    rows = {r["uid"]: r for r in out.collect()}
    assert len(rows) == 60
    assert rows["u3"]["error"] == 1 and rows["u3"]["attempts"] == 2 and rows["u3"]["error_status"] == 429
    assert rows["u3"]["raw_response"] is None and rows["u3"]["error_message"] == "Rate limit | reached"
    assert rows["u5"]["error"] == 0 and rows["u5"]["raw_response"] == "A"
    assert sum(r["error"] for r in rows.values()) == 2


def test_incremental_resume_completes_exactly_the_rest(spark):
    store = scratch_path(spark, "test-incr")
    units = _units(spark, 50)

    def score(b):
        return SC.score_rows(b, keep=["uid"], pause_s=0.0)
    SC.incremental_run(units, ["uid"], 20, score, store)
    SC.incremental_run(units, ["uid"], 20, score, store)
    SC.incremental_run(units, ["uid"], 20, score, store)
    got = spark.read.parquet(store)
    assert got.count() == 50 and got.select("uid").distinct().count() == 50


def test_failure_budget_stops_waves(spark):
    store = scratch_path(spark, "test-waves")
    bad = {f"prompt {i}" for i in range(0, 200, 3)}
    units = _units(spark, 200)

    def score(b):
        return SC.score_rows(b, keep=["uid", "wave"], factory=failing_on(bad, set()), pause_s=0.0)
    stats = SC.score_in_waves(units, "uid", 50, 5, score, store).orderBy("wave").collect()
    assert len(stats) == 4
    assert stats[0]["skipped"] is False and stats[0]["failed"] > 5
    assert all(s["skipped"] for s in stats[1:])


def test_offline_scorer_is_deterministic(spark):
    a = SC.score_rows(_units(spark), keep=["uid"], partitions=3).select("uid", "raw_response")
    b = SC.score_rows(_units(spark), keep=["uid"], partitions=7).select("uid", "raw_response")
    assert a.exceptAll(b).count() == 0
