"""Batch model scoring as a Spark stage.

``score_rows`` runs an injected scorer inside ``mapInPandas``: the scorer (e.g. an HTTP client) is
built once per partition by a factory, receives Arrow batches of (system, user) prompts, and returns
a reply or an exception per row. Failed rows are sent once more, each by itself; what still fails
becomes an error record. A failed call never fails the task, so a retried task (executor loss)
simply re-scores its partition. Write the output before reusing it: a re-evaluated plan would call
the model again.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairjudge.operators.assign import join_null_safe
from pairjudge.operators.ledger import RunLedger, by_task
from pairjudge.sources import files

MAX_ATTEMPTS = 2
RETRY_PAUSE_S = 1.0
SCORE_SCHEMA = "raw_response string, error int, error_message string, attempts int, prompt_md5 string"


@dataclass(frozen=True)
class CallOptions:
    """What a model call is asked for besides the prompt."""

    temperature: float = 0.0
    max_tokens: int | None = None
    json_mode: bool = False


# A scorer answers a batch: (systems, users, context rows) -> a reply or an exception per row. The
# context holds the row's other columns and ``attempt``. Raising fails the whole call.
Scorer = Callable[[list[str], list[str], pd.DataFrame], list]
ScorerFactory = Callable[[CallOptions], Scorer]


class ScoringError(Exception):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status_code = status


def offline_scorer(options: CallOptions = CallOptions()) -> Scorer:
    """Deterministic stand-in for a model: the reply depends only on the prompt hash."""
    def score(systems, users, ctx):
        out = []
        for s, u in zip(systems, users):
            h = hashlib.md5((s + "\n" + u).encode("utf-8")).hexdigest()
            if options.json_mode or "Explain" in s:
                out.append('{"mismatch_explanation": "The rewrite reads as formulaic (' + h[:6] + ').", "reason": ""}')
            elif "only A or B" in s:
                out.append("A" if int(h[0], 16) < 8 else "B")
            elif "only Yes or No" in s:
                out.append("Yes" if int(h[0], 16) < 12 else "No")
            else:
                orig = str(ctx["original_answer"].iloc[len(out)]) if "original_answer" in ctx.columns else ""
                out.append("Capisco la sua preoccupazione. " + orig)
        return out
    return score


def _call(scorer: Scorer, systems: list[str], users: list[str], rows: pd.DataFrame) -> list:
    """One call; as many replies or exceptions as prompts, whatever the scorer does."""
    try:
        replies = list(scorer(systems, users, rows))
    except Exception as e:  # noqa: BLE001
        return [e] * len(users)
    if len(replies) != len(users):
        return [ScoringError(f"{len(replies)} replies to {len(users)} prompts")] * len(users)
    return [ScoringError("no reply") if r is None else r for r in replies]


def _score_partition(factory: ScorerFactory, options: CallOptions, sys_col: str, user_col: str, keep: list[str],
                     max_attempts: int, pause_s: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory(options)  # one client per partition
        for pdf in batches:
            systems = pdf[sys_col].fillna("").astype(str).tolist()
            users = pdf[user_col].fillna("").astype(str).tolist()
            replies = _call(scorer, systems, users, pdf.assign(attempt=1))
            attempts = [1] * len(pdf)
            for attempt in range(2, max_attempts + 1):
                failed = [i for i, r in enumerate(replies) if isinstance(r, Exception)]
                if failed and pause_s:
                    time.sleep(pause_s)
                for i in failed:  # by itself, so that a bad prompt cannot sink its neighbours again
                    replies[i] = _call(scorer, [systems[i]], [users[i]], pdf.iloc[[i]].assign(attempt=attempt))[0]
                    attempts[i] = attempt
            errors = [json.dumps({"type": type(r).__name__, "status": getattr(r, "status_code", None), "text": str(r)})
                      if isinstance(r, Exception) else None for r in replies]
            out = pdf[keep].copy()
            out["raw_response"] = [None if isinstance(r, Exception) else str(r) for r in replies]
            out["error"] = [int(e is not None) for e in errors]
            out["error_message"] = errors
            out["attempts"] = attempts
            out["prompt_md5"] = [hashlib.md5((s + "\n" + u).encode("utf-8")).hexdigest()
                                 for s, u in zip(systems, users)]
            yield out
    return run


def score_rows(df: DataFrame, system: str = "system", user: str = "user", keep: list[str] | None = None,
               factory: ScorerFactory = offline_scorer, partitions: int | None = None,
               max_attempts: int = MAX_ATTEMPTS, pause_s: float = RETRY_PAUSE_S,
               options: CallOptions = CallOptions()) -> DataFrame:
    """Score every row; returns ``keep`` columns + raw_response, error, error_message, attempts,
    prompt_md5 (the prompt text itself is dropped: it is wide and re-renderable).

    ``partitions`` is the number of calls under way at once; unless given, the rows are dealt to as
    many tasks as the cluster runs at a time."""
    keep = keep or [c for c in df.columns if c not in (system, user)]
    x = df.select(*keep, system, user).repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields if f.name in keep)
    out = x.mapInPandas(_score_partition(factory, options, system, user, keep, max_attempts, pause_s),
                        schema=f"{schema}, {SCORE_SCHEMA}")
    part = F.from_json("error_message", "type string, status int, text string")
    return out.withColumn("error_type", part["type"]).withColumn("error_status", part["status"]) \
              .withColumn("error_message", part["text"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's output to the shared scratch folder and read it back, so later stages never
    re-run (and re-bill) the model calls that produced it."""
    from pairjudge.sources.io import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if no task has written to it yet. A storage failure is raised."""
    return spark.read.parquet(path) if files.has_data(spark, path) else None


def score_in_waves(units: DataFrame, id_col: str | list[str], wave_size: int, failure_budget: int,
                   score: Callable[[DataFrame], DataFrame], store_path: str, attempts: int = 1) -> DataFrame:
    """Score in waves of ``wave_size`` units, each written to its own partition of ``store_path``; stop
    launching waves once the failures of the waves run here exceed ``failure_budget`` (a global "first
    failure" has no meaning across partitions). Returns one stats row per wave (scored, failed,
    skipped).

    Waves and attempts are kept by unit key in a ledger beside the store (:mod:`pairjudge.operators.ledger`), so a
    later call goes on whatever its units are: stored units are neither repeated nor counted again, new ones get new
    waves, skipped and half-written waves are completed. A unit whose row is an error is scored again, in a
    new wave, until it has had ``attempts`` attempts. One job per wave, reading that wave's units only."""
    spark = units.sparkSession
    ledger = RunLedger(spark, store_path, [id_col] if isinstance(id_col, str) else list(id_col))
    waves_path = _scratch(spark, "waves")
    ledger.claim(units.drop("wave", "wave_attempt"), wave_size, attempts).write.partitionBy("wave").parquet(waves_path)
    waves = stored(spark, waves_path)
    numbers = set() if waves is None else {r["wave"] for r in waves.select("wave").distinct().collect()}
    before = ledger.results()
    counts = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("error"), F.lit(0)).alias("f")]
    seen = {} if before is None else {r["wave"]: (r["n"], r["f"]) for r in before.groupBy("wave").agg(*counts).collect()}  # a row per wave
    failures, stats = 0, []
    for w in sorted(numbers | set(seen)):
        held, failed = seen.get(w, (0, 0))
        skipped = w in numbers and failures > failure_budget
        if w in numbers and not skipped:
            ledger.save(score(spark.read.parquet(f"{waves_path}/wave={w}").withColumn("wave", F.lit(w))).drop("wave"), w)
            r = spark.read.parquet(f"{ledger.store}/wave={w}").agg(*counts).first()
            failures += int(r["f"] - failed)
            held, failed = r["n"], r["f"]
        stats.append((w, int(held), int(failed), skipped))
    return spark.createDataFrame(stats, "wave int, scored long, failed long, skipped boolean")


def _scratch(spark: SparkSession, name: str) -> str:
    from pairjudge.sources.io import scratch_path
    return scratch_path(spark, name)


def incremental_run(units: DataFrame, keys: list[str], n: int, score: Callable[[DataFrame], DataFrame],
                    store_path: str, done_filter=None) -> DataFrame:
    """Score the next ``n`` units (by key order) that have no good stored result, add them to the store as its next
    ``round`` and return that round, read back. Re-running resumes exactly where the store ends; a unit whose
    stored rows are all errors is pending again; replies of a round that was cut short count as far as its tasks
    were done. Keys may be NULL. ``done_filter`` says which stored rows are good (unless given: those without an error)."""
    spark, store = units.sparkSession, store_path.rstrip("/")
    before = stored(spark, store)
    todo = units
    if before is not None:
        good = before.where(F.col("error") == 0 if done_filter is None else done_filter)
        todo = join_null_safe(units, good.select(*keys).distinct(), keys, "left_anti")
    rounds = [int(x[6:]) for x in files.names(spark, store) if x.startswith("round=")]
    path = f"{store}/round={max([-1, *rounds]) + 1}"
    by_task(score(todo.orderBy(*keys).limit(n)), path)
    return spark.read.parquet(path)
