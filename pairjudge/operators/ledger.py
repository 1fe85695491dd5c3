"""Run ledger: which wave and which attempt a unit of work belongs to, kept by unit key beside the results.

A result store is a folder with a partition ``wave=<n>`` for every wave. Its ledger, a folder of its own beside it,
holds the claims (unit key, wave, wave_attempt) in numbered batches, and marks: an empty file for each batch of claims and
each wave that is complete. What has no mark was cut short. An unmarked batch is written anew. An unmarked wave keeps the
rows that its finished tasks left (tasks commit one by one), and only the units without a row are scored.

So a unit's wave does not depend on what else is asked for today: units that were never claimed get new waves behind the last
one, a claimed unit stays in its wave until that is complete, and one that its wave left out (it was not among the units of that day)
is claimed again. A NULL key is a key like any other.

One driver at a time works on a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairjudge.operators.assign import exact_rank, join_null_safe
from pairjudge.sources import files


class RunLedger:
    def __init__(self, spark: SparkSession, store_path: str, keys: list[str]):
        self.spark, self.keys = spark, keys
        self.store = store_path.rstrip("/")
        self.path = f"{self.store}-ledger"

    def _marked(self, kind: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in files.names(self.spark, f"{self.path}/marks") if n.startswith(f"{kind}="))

    def _mark(self, kind: str, number: int) -> None:
        files.touch(self.spark, f"{self.path}/marks/{kind}={number}")

    def claims(self) -> DataFrame | None:
        """The last claim of every unit: keys, wave, wave_attempt."""
        paths = [f"{self.path}/claims/batch={n}" for n in self._marked("claims")]
        if not paths:
            return None
        last = F.max(F.struct("wave_attempt", "wave")).alias("_last")
        return self.spark.read.parquet(*paths).groupBy(*self.keys).agg(last).select(*self.keys, "_last.wave", "_last.wave_attempt")

    def results(self) -> DataFrame | None:
        """Stored rows of all waves, complete or not, with their wave."""
        done = set(self._marked("wave"))
        waves = [int(n[5:]) for n in files.names(self.spark, self.store) if n.startswith("wave=")]
        paths = [f"{self.store}/wave={w}" for w in waves if w in done or files.has_data(self.spark, f"{self.store}/wave={w}")]
        return self.spark.read.option("basePath", self.store).parquet(*paths) if paths else None

    def claim(self, units: DataFrame, wave_size: int, attempts: int = 1) -> DataFrame:
        """The rows of ``units`` that are to be scored, with wave and wave_attempt. A unit whose stored row is an error
        is claimed again until it has had ``attempts`` attempts."""
        ids = units.select(*self.keys)
        claims, results = self.claims(), self.results()
        state = ids.withColumns({"wave": F.lit(None).cast("int"), "wave_attempt": F.lit(None).cast("int")}) if claims is None \
            else join_null_safe(ids, claims, self.keys, "left")
        marked = self.spark.createDataFrame([(w, True) for w in self._marked("wave")], "_wave int, _marked boolean")
        state = state.join(marked, state["wave"] == marked["_wave"], "left").drop("_wave")
        if results is None:
            state = state.withColumn("_error", F.lit(None).cast("int"))
        else:
            got = results.groupBy(*self.keys, "wave").agg(F.min("error").alias("_error"))
            state = join_null_safe(state, got, [*self.keys, "wave"], "left")
        failed = (F.col("_error") != 0) & (F.col("wave_attempt") < attempts)
        left_out = F.col("_error").isNull() & F.col("_marked").isNotNull()
        again = F.coalesce(failed, F.lit(False))
        fresh = state.where(F.col("wave").isNull() | left_out | again).select(
            *self.keys, (F.coalesce("wave_attempt", F.lit(1)) + again.cast("int")).alias("wave_attempt"))
        waiting = state.where(F.col("wave").isNotNull() & F.col("_error").isNull() & F.col("_marked").isNull()).select(
            *self.keys, "wave", "wave_attempt")
        base = 0 if claims is None else claims.agg(F.max("wave")).first()[0] + 1  # a batch of claims is never empty
        new = self._claimed(fresh, base, wave_size)
        return join_null_safe(units, waiting if new is None else waiting.unionByName(new), self.keys)

    def _claimed(self, fresh: DataFrame, base: int, wave_size: int) -> DataFrame | None:
        key = F.col(self.keys[0]).cast("string") if len(self.keys) == 1 else F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})
        ranked = exact_rank(fresh.withColumn("_hash", F.md5(F.coalesce(key, F.lit("")))), "_hash", self.keys, out="_rank")
        batch = max([-1, *self._marked("claims")]) + 1
        path = f"{self.path}/claims/batch={batch}"
        wave = (F.lit(base) + F.floor((F.col("_rank") - 1) / wave_size)).cast("int")
        ranked.select(*self.keys, wave.alias("wave"), "wave_attempt").write.mode("overwrite").parquet(path)
        new = self.spark.read.parquet(path)
        if new.isEmpty():
            files.remove(self.spark, path)
            return None
        self._mark("claims", batch)
        return new

    def save(self, rows: DataFrame, wave: int) -> None:
        """Add rows to a wave, task by task, and mark it complete."""
        by_task(rows, f"{self.store}/wave={wave}")
        self._mark("wave", wave)


def by_task(rows: DataFrame, path: str) -> None:
    """Append rows to a folder; every task's file is there as soon as the task is done, also if the job is lost later. (A task
    that is run again writes the file of the same name.)"""
    rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
