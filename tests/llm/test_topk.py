import math
import random

import numpy as np
from pyspark.sql import functions as F

from pairjudge.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, query_id long"


def brute(rows, is_query, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if is_query(q):
            best = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q), key=lambda x: (-x[0], x[1]))[:k]
            out += [(q, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def check(spark, rows, k=20):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    found = K.top_k(frame, F.col("vec_id") % 20 == 0, k)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, lambda i: i % 20 == 0, k)


def test_matches_brute_force_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL", 32)
    monkeypatch.setattr(K, "QUERIES_PER_BLOCK", 8)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + (i % 7 == 0)) for _ in range(12)]) for i in range(600)]
    rows += [(1000 + i, [0.5] * 12) for i in range(150)]  # one vector again and again
    rows += [(2000, None), (2020, [1.0] * 11 + [None]), (2040, [math.inf] * 12), (2060, [math.nan] * 12), (None, [1.0] * 12), (2080, [0.0] * 12)]
    check(spark, rows)


def test_fewer_than_k_and_empty(spark):
    check(spark, [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (7, [-1.0, 0.25])])
    check(spark, [(0, [1.0])])
    assert K.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_far_annuli_are_left_out():
    g = K.Geometry([K.packed(np.array([64, 0]))], [4096.0], 4096.0, 2)
    g.cells = {(0, a): (a, 1, 100) for a in range(K.ANNULI)}
    d = g.to_pivots(np.array([[64.0, 0.0]]), np.array([4096.0]), stored=False)[0]
    near = K.needed(g, d, 4096.0, 4000.0, set())
    assert 0 in near and len(near) < K.ANNULI / 2


def test_large_components_are_ranked_too(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, [20_000.0, 1.0, 0.0, -3.0]), (101, [1e6, -1e6, 1e6, 0.5]), (102, [-1e6, 1e6, 1.0, 1.0]), (120, [3e7, 0.0, 2.0, 1.0])]
    check(spark, rows)
    huge = spark.createDataFrame([(0, [1e30, 0.0], 0, 0, 0), (1, [1e30, 1.0], 0, 0, 0), (2, [-1e30, 1.0], 0, 0, 0), (3, [0.0, 5.0], 0, 0, 0)], SCHEMA)
    got = [(r["vec_id"], r["score"]) for r in K.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2 ** 63 - 1), (3, 0), (2, -2 ** 63)]


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for size in (10, 1 << 24, 1 << 29, 1 << 40):
        q, x = (rng.integers(-size, size, (n, 5)) for n in (4, 7))
        want = [[max(-2 ** 63, min(2 ** 63 - 1, sum(int(a) * int(b) for a, b in zip(u, v)))) for v in x] for u in q]
        assert K.products(q, x).tolist() == want


def test_widths_and_lengths_meet_in_one_matrix():
    rows = [[1, -128], [127, 3], [300, 2, 5], [], [-40_000, 1], [1 << 40, -7]]
    held = [K.packed(np.array(r, dtype=np.int64)) for r in rows]
    assert [r[0] for r in held] == [2, 1, 2, 1, 4, 8]
    assert K.matrix(held, 3, np.int64).tolist() == [r + [0] * (3 - len(r)) for r in rows]
    assert K.matrix(held[1:2] * 3, 3).tolist() == [[127.0, 3.0, 0.0]] * 3 and K.matrix(held[3:4], 2).tolist() == [[0.0, 0.0]]


def test_repeated_rows_are_dealt_out_and_are_queries_each(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL", 16)
    monkeypatch.setattr(K, "QUERIES_PER_BLOCK", 8)
    met = []
    whole = K.meet

    def seen(queries, cells, geometry, k):
        cells = K.written(cells, "cells")
        met.append((cells.count(), cells.groupBy("cell", "block").count().agg(F.max("count")).first()[0]))
        return whole(queries, cells, geometry, k)

    monkeypatch.setattr(K, "meet", seen)
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(1, 200) if i % 20] + [(40, [1.0] * 6)] * 100
    frame = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    found = [tuple(r) for r in K.top_k(frame, F.col("vec_id") % 20 == 0, 5).select("query_id", "rank", "vec_id", "score").collect()]
    one = brute([r for r in rows if r[0] != 40] + rows[-1:], lambda i: i % 20 == 0, 5)
    assert sorted(found) == sorted(one * 100)
    assert all(largest <= 48 for _, largest in met)
