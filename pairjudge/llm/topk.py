"""Exact top-k search by integer inner product over a pivot-distance index.

Vectors are turned into integers, component by component. With one more component,
sqrt(M^2 - |v|^2) for a vector and 0 for a query (M: the longest vector's length), the largest inner
products are the smallest Euclidean distances, so bounds from the triangle inequality hold.

Index: each vector is keyed by its nearest pivot and its distance to it; a pivot's vectors are cut
into annuli of equal width, and an annulus with many vectors into cells of about ``CELL`` by a hash
of the row's number, so that no row, however often it is repeated, makes a large cell. Rows hold
their integers in as few bytes as their largest takes.

Search: a query first looks into the cells of annuli nearest to its own distance, until they hold
k others; the k-th score there is a bound. Then it expands over the remaining annuli of all pivots,
and stops at those whose triangle-inequality bound cannot reach that score. Queries are dealt to blocks
of about ``QUERIES_PER_BLOCK``. A cell goes only to the blocks that hold a query routed to it; each
meeting of a cell and a block returns k rows per query at most.

Defined results: vectors that are null, or hold a null or non-finite component, take no part;
vectors are compared as if padded with zeros to the same length; equal scores go to the smaller
vec_id; rows that repeat a vec_id are candidates each, but not for a query of that id, and queries each;
null ids take no part; an empty table gives an empty result. Products of large components are taken in 64-bit or longer
integers; a component of more than 2^62 counts as that, a score that a long cannot hold as the nearest long. Columns other than vec_id
and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairjudge.llm.common import out_batch, written

K = 20
SCALE = 64
#: Reference vectors, those with the smallest hashes of their ids; a bounded sample.
PIVOTS = 16
#: Annuli between distance 0 and the largest distance.
ANNULI = 24
CELL = 2048
QUERIES_PER_BLOCK = 4096
LARGEST = float(1 << 62)

VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("dim", T.IntegerType()),
                       T.StructField("norm2", T.DoubleType())])
KEYED = T.StructType([*VECTOR.fields, T.StructField("pivot", T.IntegerType()), T.StructField("annulus", T.IntegerType())])
#: ``q`` is the row number of a query.
ROUTED = T.StructType([T.StructField("q", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("query", T.BinaryType()),
                       T.StructField("floor", T.DoubleType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
SCORED = T.StructType([T.StructField("q", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
                       T.StructField("score", T.LongType())])
RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), *SCORED.fields[2:]])


def packed(x: np.ndarray) -> bytes:
    """A row of integers in the narrowest type that holds them all, behind a byte that names its width."""
    most = int(np.abs(x).max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, floor(scale * x) as integers in bytes, their number, squared length."""

    def task(batches):
        for batch in batches:
            cols: dict[str, list] = {f.name: [] for f in VECTOR}
            for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                if vec_id is None or values is None or None in values:
                    continue
                x = np.asarray(values, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(scale * x), -LARGEST, LARGEST)
                cols["vec_id"].append(vec_id)
                cols["vector"].append(packed(x.astype(np.int64)))
                cols["dim"].append(len(x))
                cols["norm2"].append(float(x @ x))
            yield out_batch(VECTOR, cols)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(task, VECTOR)


def matrix(rows: list[bytes], dim: int, dtype=np.float64) -> np.ndarray:
    out = np.zeros((len(rows), dim), dtype=dtype)
    if len({(len(r), r[0]) for r in rows}) == 1:
        width = rows[0][0]
        whole = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)[:, 1:]
        part = np.ascontiguousarray(whole).view(f"<i{width}") if whole.size else whole
        out[:, : part.shape[1]] = part
    else:
        for i, r in enumerate(rows):
            out[i, : (len(r) - 1) // r[0]] = np.frombuffer(r, dtype=f"<i{r[0]}", offset=1)
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles where sums stay below 2^53, else in integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return q.astype(np.float64) @ x.T.astype(np.float64)
    if most < 1 << 62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Geometry:
    """What bounds need: pivots, longest length, width of an annulus, cells of each annulus."""

    def __init__(self, pivots: list[bytes], norms: list[float], longest2: float, dim: int):
        self.dim, self.longest2 = dim, longest2
        self.pivots = matrix(pivots, dim)
        self.pivot_norm2 = np.array(norms)
        self.lift = np.sqrt(np.maximum(0.0, longest2 - self.pivot_norm2))
        self.width = max(1e-9, 2 * np.sqrt(longest2) / ANNULI)
        self.cells: dict[tuple[int, int], tuple[int, int, int]] = {}  # (pivot, annulus): first cell, cells, vectors

    def to_pivots(self, x: np.ndarray, norm2: np.ndarray, stored: bool) -> np.ndarray:
        """Distances to all pivots, of stored vectors or of queries (whose added component is 0)."""
        d2 = norm2[:, None] + self.longest2 - 2 * (x @ self.pivots.T)
        if stored:
            lift = np.sqrt(np.maximum(0.0, self.longest2 - norm2))
            d2 = d2 + (self.longest2 - norm2)[:, None] - 2 * lift[:, None] * self.lift[None, :]
        else:
            d2 = d2  # |q|^2 + |p|^2 + lift_p^2 - 2 q.p, where |p|^2 + lift_p^2 = M^2
        return np.sqrt(np.maximum(0.0, d2))

    def annulus(self, distance: np.ndarray) -> np.ndarray:
        return np.floor(distance / self.width).astype(np.int32)


def keyed(vectors: DataFrame, geometry) -> DataFrame:
    """Nearest pivot and annulus of each vector."""

    def task(batches):
        g = geometry.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, norm2 = matrix(batch.column("vector").to_pylist(), g.dim), batch.column("norm2").to_numpy()
            d = g.to_pivots(x, norm2, stored=True)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)), pa.array(g.annulus(d[np.arange(len(d)), near]))],
                names=[f.name for f in KEYED])

    return vectors.mapInArrow(task, KEYED)


def first_cells(g: Geometry, d: np.ndarray, k: int) -> list[int]:
    """Cells to look into first: of the annuli whose bound is nearest, until they hold k others."""
    bounds = sorted((max(0.0, a * g.width - d[p], d[p] - (a + 1) * g.width), p, a) for p, a in g.cells)
    out, held = [], 0
    for _, p, a in bounds:
        first, many, vectors = g.cells[p, a]
        out.append(first)
        held += vectors // many // 2  # a cell may hold less than its share; counted by half
        if held > k:
            break
    return out


def meet(queries: DataFrame, cells: DataFrame, geometry, k: int) -> DataFrame:
    """k best of every (query, cell) that meet, leaving out scores under the query's floor."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        g = geometry.value
        cols: dict[str, list] = {f.name: [] for f in SCORED}
        if left.num_rows and right.num_rows:
            ids = right.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            x = matrix(right.column("vector").to_pylist(), g.dim, np.int64)[order]
            for start in range(0, left.num_rows, 512):
                part = left.slice(start, 512)
                numbers, q_ids, floors = (part.column(c).to_numpy() for c in ("q", "query_id", "floor"))
                scores = products(matrix(part.column("query").to_pylist(), g.dim, np.int64), x)
                floors = floors - np.abs(floors, where=np.isfinite(floors), out=np.zeros(len(floors))) * 2.0 ** -52  # a large floor is rounded
                for number, q, floor, row in zip(numbers.tolist(), q_ids.tolist(), floors.tolist(), scores):
                    at = np.flatnonzero((row >= floor) & (ids != q))
                    if len(at) > k:
                        # ids ascend, so a stable sort gives equal scores to the smaller id
                        worth = ~row[at].astype(np.int64)  # falls as the score rises
                        least = np.partition(worth, k - 1)[k - 1]
                        at = at[worth <= least]
                        at = at[np.argsort(~row[at].astype(np.int64), kind="stable")[:k]]
                    cols["q"] += [number] * len(at)
                    cols["query_id"] += [q] * len(at)
                    cols["vec_id"] += ids[at].tolist()
                    cols["score"] += row[at].astype(np.int64).tolist()
        return pa.Table.from_batches([out_batch(SCORED, cols)])

    return queries.groupBy("cell", "block").cogroup(cells.groupBy("cell", "block")).applyInArrow(task, SCORED)


def best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of every query row.

    ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = written(integers(vectors, scale), "vectors")
    total = rows.agg(F.max("norm2").alias("longest2"), F.max("dim").alias("dim")).first()
    if total["dim"] is None:
        return spark.createDataFrame([], RESULT)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    geometry = Geometry([bytes(r["vector"]) for r in chosen], [r["norm2"] for r in chosen], total["longest2"], total["dim"])

    index = written(keyed(rows, spark.sparkContext.broadcast(geometry)).withColumn("row", F.monotonically_increasing_id()), "index")
    at = 0
    for r in index.groupBy("pivot", "annulus").agg(F.count(F.lit(1)).alias("n")).orderBy("pivot", "annulus").collect():  # pivots x annuli at most
        many = -(-r["n"] // CELL)
        geometry.cells[r["pivot"], r["annulus"]] = (at, many, r["n"])
        at += many
    shared = spark.sparkContext.broadcast(geometry)

    found = index.where(is_query).select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.col("norm2").alias("query2"))
    blocks = max(1, -(-found.count() // QUERIES_PER_BLOCK))
    names = spark.createDataFrame([(p, a, first, many) for (p, a), (first, many, _) in geometry.cells.items()], "pivot int, annulus int, first int, many int")
    cells = (index.join(F.broadcast(names), ["pivot", "annulus"])  # pivots x annuli rows
             .select((F.col("first") + F.pmod(F.xxhash64("row"), F.col("many"))).cast("int").alias("cell"), "vec_id", "vector"))

    def route(begin: bool):
        def task(batches):
            g = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                raw = batch.column("query").to_pylist()
                norm2 = batch.column("query2").to_numpy()
                d = g.to_pivots(matrix(raw, g.dim), norm2, stored=False)
                floors = [-np.inf] * len(raw) if begin else [-np.inf if f is None else float(f) for f in batch.column("floor").to_pylist()]
                to = []
                for i, floor in enumerate(floors):
                    first = first_cells(g, d[i], k)
                    to.append(first if begin else needed(g, d[i], float(norm2[i]), floor, set(first)))
                yield out_batch(ROUTED, {"q": batch.column("q"), "query_id": batch.column("query_id"), "query": raw, "floor": floors, "cells": to})
        return task

    def searched(queries: DataFrame, begin: bool) -> DataFrame:
        """k best of every query in every cell that it is routed to."""
        routes = written(queries.mapInArrow(route(begin), ROUTED).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")), "routes")
        asked = routes.select(F.col("block").alias("to"), F.explode("cells").alias("cell")).distinct()
        sent = cells.join(asked, "cell").select("cell", F.col("to").alias("block"), "vec_id", "vector")
        return meet(routes.withColumn("cell", F.explode("cells")).drop("cells"), sent, shared, k)

    near = written(best(searched(found, True), k), "near")
    floor = near.where(F.col("rank") == k).select("q", F.col("score").cast("double").alias("floor"))
    far = searched(found.join(floor, "q", "left"), False)
    return best(far.unionByName(near.select(*SCORED.fieldNames())), k).select("query_id", "rank", "vec_id", "score")


def needed(g: Geometry, d: np.ndarray, norm2: float, floor: float, seen: set[int]) -> list[int]:
    """Cells whose annulus may hold a score of ``floor`` or more, but for those already seen.

    A vector v of the annulus lies at least |d(q, p) - d(v, p)| from q, and its score is
    (|q|^2 + M^2 - d(q, v)^2) / 2.
    """
    out = []
    slack = 1e-6 * (norm2 + g.longest2) + 1e-6
    for (p, a), (first, many, _) in g.cells.items():
        gap = max(0.0, a * g.width - d[p], d[p] - (a + 1) * g.width)
        if (norm2 + g.longest2 - gap * gap) / 2 + slack >= floor:
            out += [c for c in range(first, first + many) if c not in seen]
    return out
