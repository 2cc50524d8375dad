from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.llm.neighbours import Forest, best_of, hashed_order, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(n, d=16, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    out = centres[rng.integers(0, 8, n)] + rng.standard_normal((n, d))
    return (out * rng.uniform(1, 1 + spread, (n, 1))).astype(np.float32)


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, [None if x is None else float(x) for x in v] if v is not None else None, 0) for k, v in enumerate(vectors)], SCHEMA)


def brute(ids, vectors, q, k=20):
    scores = vectors.astype(np.float64) @ vectors[q].astype(np.float64)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), scores[i]) for i in order]


@pytest.mark.parametrize(("n", "block_rows", "query_rows"), [(3000, 500, 40), (3000, 8192, 4096), (15, 8192, 4096)])
def test_recall_and_scores(spark, n, block_rows, query_rows):
    vectors, ids = made(n), np.arange(n)
    df = frame(spark, vectors.tolist())
    got = nearest_neighbours(df, df.where("vec_id % 20 = 0"), block_rows=block_rows, query_rows=query_rows).collect()
    hit = total = 0
    for q in range(0, n, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        want = brute(ids, vectors, q)
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        assert all(abs(r.score - vectors[r.vec_id].astype(np.float64) @ vectors[q].astype(np.float64)) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & {i for i, _ in want})
        total += len(want)
    assert hit / total >= 0.9


def test_recall_where_ids_follow_the_data(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 64)) * 4
    tight = centres[np.arange(2000) // 100] + rng.standard_normal((2000, 64)) * 0.1
    vectors = np.concatenate([tight, rng.standard_normal((6000, 64))]).astype(np.float32)
    df = frame(spark, vectors.tolist())
    got: dict[int, set] = {}
    for r in nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = {q: len(got[q] & {i for i, _ in brute(np.arange(8000), vectors, q)}) / 20 for q in range(0, 8000, 20)}
    assert sum(recall.values()) / len(recall) >= 0.95
    assert np.mean([x for q, x in recall.items() if q >= 2000]) >= 0.9


def test_hashed_order_spreads_ids():
    ids = np.arange(0, 100_000, 20)
    order = hashed_order(ids)
    assert sorted(order) == list(range(len(ids)))
    assert 0.35 < np.mean(order[:128] < len(ids) / 2) < 0.65
    assert hashed_order(np.empty(0, np.int64)).tolist() == []


def test_ties_bad_vectors_and_equal_rows(spark):
    same = [1.0, 2.0, 3.0]
    odd = [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [], [1.0, 2.0]]
    rows = [(k, same, 0) for k in range(60)] + [(100 + k, v, 0) for k, v in enumerate(odd)] + [(7, same, 0), (7, same, 1), (None, same, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x"))
    got = nearest_neighbours(df, df.where("vec_id % 20 = 0 or vec_id >= 100")).collect()
    assert {r.query_id for r in got} == {0, 20, 40}
    for q in (0, 20, 40):
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [k for k in range(21) if k != q][:20]
        assert {r.score for r in got} == {14.0}


def test_empty_sides(spark):
    df, none = frame(spark, made(30).tolist()), spark.createDataFrame([], SCHEMA)
    assert nearest_neighbours(df, none).count() == nearest_neighbours(none, df).count() == nearest_neighbours(none, none).count() == 0


def test_prefix_slices():
    vectors = made(200).astype(np.float64)
    forest = Forest(vectors, trees=3, bits=10)
    hashes = np.empty_like(forest.sorted)
    np.put_along_axis(hashes, forest.order, forest.sorted, axis=1)
    queries = vectors[:5] * 2
    asked = forest._hash(queries, np.zeros(5))
    first, last = forest.ranges(queries)
    for depth in range(11):
        for tree in range(3):
            for q in range(5):
                want = np.flatnonzero(hashes[tree] >> np.uint64(10 - depth) == asked[tree, q] >> np.uint64(10 - depth))
                assert sorted(forest.order[tree, first[depth, tree, q] : last[depth, tree, q]]) == want.tolist()
    depth = forest.depths(first, last, 30)
    held = (last - first).sum(axis=1)
    for q in range(5):
        assert held[depth[q], q] >= 30 and (depth[q] == 10 or held[depth[q] + 1, q] < 30)


def test_best_of():
    assert best_of(np.array([1.0, 3.0, 3.0, 2.0]), np.array([4, 9, 2, 1]), 2).tolist() == [2, 1]
    assert best_of(np.array([1.0]), np.array([4]), 2).tolist() == [0]
