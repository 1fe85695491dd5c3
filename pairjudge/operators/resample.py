"""Bootstrap intervals without materialising B x n draws in a shuffle.

* :func:`poisson_bootstrap_mean` — any numeric column: each (replicate, row) gets a Poisson(1)
  weight from a hash; a task keeps B running sums per group and adds a row's vector of weights at a time, so only
  B x groups partial sums per task are shuffled.
* :func:`binomial_bootstrap_rate` — 0/1 outcomes: aggregate to cells (k, n) first; a replicate's
  resampled count of ones is exactly Binomial(n, k/n); an Arrow-batched pandas UDF draws all
  replicates of a cell as one vector. Cost is B x groups, independent of n.
* :func:`multinomial_bootstrap_kappa` — kappa of two binary raters from the 2x2 cells, likewise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairjudge.functions import stats as ST
from pairjudge.operators.assign import join_null_safe


CI = T.StructType([T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType())])
#: Weights come from the line (a * replicate + b) mod PRIME, a and b from the row's hash: uniform for every row and replicate,
#: independent across rows, and pairwise independent across the replicates of a row.
PRIME = (1 << 31) - 1
#: Smallest values of the line for the Poisson(1) weights 1, 2, ...
POISSON_STEPS = [int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]
#: Groups whose vectors a task holds before it passes them on, rows added at a time, and parts that a group is merged in.
HELD_GROUPS, ROWS_AT_A_TIME, MERGE_PARTS = 256, 64, 32
VECTORS = [T.StructField(n, T.BinaryType()) for n in ("_sw", "_swx")]


def row_lines(seed: int, id_col: str) -> list[Column]:
    """``_la`` and ``_lb`` of a row, from the md5 of seed and id."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))

    def part(start: int) -> Column:
        return F.conv(F.substring(h, start, 8), 16, 10).cast("long")
    return [(1 + part(1) % (PRIME - 1)).alias("_la"), (part(9) % PRIME).alias("_lb")]


def _weights(a: np.ndarray, b: np.ndarray, B: int) -> np.ndarray:
    line = (a[:, None] * np.arange(1, B + 1, dtype=np.int64) + b[:, None]) % PRIME
    return np.searchsorted(POISSON_STEPS, line, side="right")


def _vectors(keys: list[str], B: int, add: Callable):
    """Task that keeps, by group, the B running sums of weights and of weighted values."""
    def emit(held):
        columns = [list(c) for c in zip(*held)] or [[] for _ in keys]
        out = pd.DataFrame(dict(zip(keys, columns)), columns=keys, dtype=object)
        out["_sw"], out["_swx"] = [v[0].tobytes() for v in held.values()], [v[1].tobytes() for v in held.values()]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key not in held and len(held) >= HELD_GROUPS:
                    yield emit(held)
                    held = {}
                sw, swx = held.setdefault(key, (np.zeros(B, dtype=np.int64), np.zeros(B)))
                add(rows, sw, swx)
        yield emit(held)
    return run


def poisson_bootstrap_mean(df: DataFrame, keys: list[str], id_col: str, value: str, B: int = 10_000,
                           seed: int = 42, probs=(0.025, 0.975)) -> DataFrame:
    """Percentile interval of the mean of any numeric column: n, estimate, ci_low, ci_high per group.

    Every row has a Poisson(1) weight in each of B replicates, fixed by the seed and its id. A task adds the row's vector of weights to its
    B running sums of each group; the sums are merged in two steps, so what is shuffled is B sums per group and task, never rows x replicates.
    Replicates without weight are left out. Rows without a value take no part; keys may be NULL."""
    if not keys:
        raise ValueError("give at least one grouping key (use a literal column for a single group)")
    x = df.where(F.col(value).isNotNull()).select(*keys, id_col, F.col(value).cast("double").alias("_v"))
    est = x.groupBy(*keys).agg(F.avg("_v").alias("estimate"), F.count(F.lit(1)).alias("n"))

    def add_rows(rows, sw, swx):
        a, b, v = (rows[c].to_numpy() for c in ("_la", "_lb", "_v"))
        for i in range(0, len(v), ROWS_AT_A_TIME):
            w = _weights(a[i:i + ROWS_AT_A_TIME], b[i:i + ROWS_AT_A_TIME], B)
            sw += w.sum(axis=0)
            swx += v[i:i + ROWS_AT_A_TIME] @ w

    def add_vectors(rows, sw, swx):
        for w, wx in zip(rows["_sw"], rows["_swx"]):
            sw += np.frombuffer(w, dtype=np.int64)
            swx += np.frombuffer(wx)

    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, *VECTORS])
    # A few rows are B times the work of their reading: dealt to all tasks by id.
    dealt = x.select(*keys, "_v", *row_lines(seed, id_col)).repartition("_la", "_lb")
    sums = dealt.mapInPandas(_vectors(keys, B, add_rows), schema).withColumn("_part", F.spark_partition_id() % MERGE_PARTS)
    sums = sums.repartition(*keys, "_part").drop("_part").mapInPandas(_vectors(keys, B, add_vectors), schema)

    def interval(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sw, swx = np.zeros(B, dtype=np.int64), np.zeros(B)
        add_vectors(pdf, sw, swx)
        return pd.DataFrame([(*key, *_quantiles(swx[sw > 0] / sw[sw > 0], probs))], columns=[*keys, "ci_low", "ci_high"])

    ci = sums.groupBy(*keys).applyInPandas(interval, T.StructType([*fields, *CI.fields]))
    return join_null_safe(est, ci, keys).select(*keys, "n", "estimate", "ci_low", "ci_high")




def _generator(seed: int, salt: str) -> np.random.Generator:
    """Generator of one cell, keyed by the seed and the 128-bit digest of its group's key: the same
    cell always gets the same draws, however rows are partitioned."""
    return np.random.Generator(np.random.Philox(key=(int(salt, 16) + int(seed)) % (1 << 128)))


def _salt(keys: list[str]):
    return F.md5(F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})) if keys else F.md5(F.lit(""))


def _quantiles(values: np.ndarray, probs) -> tuple[float, float]:
    return tuple(float(q) for q in np.quantile(values, probs)) if len(values) else (None, None)


def _intervals(draw, B: int, seed: int, probs):
    """Pandas UDF: cell counts and salt -> interval; all B draws of a cell are one vector."""
    def run(salt: pd.Series, *counts: pd.Series) -> pd.DataFrame:
        out = [_quantiles(draw(_generator(seed, s), B, *(int(c) for c in row)), probs)
               for s, *row in zip(salt, *counts)]
        return pd.DataFrame(out, columns=["ci_low", "ci_high"], dtype="float64")
    return run


def _draw_rate(g, B, k, n):
    return g.binomial(n, k / n, size=B) / n if n else np.empty(0)


def _draw_kappa(g, B, n11, n10, n01, n00):
    n = n11 + n10 + n01 + n00
    if not n:
        return np.empty(0)
    cells = g.multinomial(n, np.array([n11, n10, n01, n00]) / n, size=B) / n
    a, b = cells[:, 0] + cells[:, 1], cells[:, 0] + cells[:, 2]
    chance = a * b + (1 - a) * (1 - b)
    ok = chance < 1
    return (cells[ok, 0] + cells[ok, 3] - chance[ok]) / (1 - chance[ok])


def rate_interval(k: str, n: str, keys: list[str], B: int = 10000, seed: int = 42, probs=(0.025, 0.975)):
    """Column struct(ci_low, ci_high): percentile bootstrap interval of the rate k / n of each row, a group
    named by ``keys``."""
    @F.pandas_udf(CI)
    def interval(salt: pd.Series, k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return _intervals(_draw_rate, B, seed, probs)(salt, k, n)

    return interval(_salt(keys), F.col(k), F.col(n))


def binomial_bootstrap_rate(df: DataFrame, keys: list[str], flag: str, B: int = 10000, seed: int = 42,
                            probs=(0.025, 0.975)) -> DataFrame:
    """Percentile interval of a 0/1 rate from cells: one aggregation over the data, then B draws
    per group inside one vector (cost B x groups, independent of n)."""
    cells = df.groupBy(*keys).agg(F.sum(F.col(flag)).cast("bigint").alias("k"), F.count(flag).alias("n"))

    r = cells.select(*keys, F.coalesce("k", F.lit(0)).alias("k"), "n").withColumn("_q", rate_interval("k", "n", keys, B, seed, probs))
    return r.select(*keys, "k", "n", F.try_divide(F.col("k"), F.col("n")).alias("estimate"), "_q.ci_low", "_q.ci_high")


def multinomial_bootstrap_kappa(df: DataFrame, keys: list[str], a: str, b: str, B: int = 2000, seed: int = 42,
                                probs=(0.025, 0.975)) -> DataFrame:
    """Percentile interval of Cohen's kappa for two binary raters from the 2x2 cells: a resample
    of n paired items is exactly a Multinomial(n, cell shares) draw of the cells, so the cost is
    B x groups after one aggregation over the data. Undefined replicates are dropped."""
    ca, cb = F.col(a), F.col(b)
    cells = df.groupBy(*keys).agg(*[F.count_if((ca == i) & (cb == j)).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)])

    @F.pandas_udf(CI)
    def interval(salt: pd.Series, n11: pd.Series, n10: pd.Series, n01: pd.Series, n00: pd.Series) -> pd.DataFrame:
        return _intervals(_draw_kappa, B, seed, probs)(salt, n11, n10, n01, n00)

    counts = ["n11", "n10", "n01", "n00"]
    r = cells.withColumn("_q", interval(_salt(keys), *counts))
    return r.select(*keys, sum(F.col(c) for c in counts).alias("n"), ST.kappa_from_cells(*counts).alias("estimate"),
                    ST.kappa_se(*counts).alias("se"), "_q.ci_low", "_q.ci_high")
