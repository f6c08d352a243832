"""Top-k search against all inner products."""

import math

import numpy as np

from airtally.llm import topk


def brute(rows, queries, k=5):
    def whole(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    known = [(i, whole(v)) for i, v, *_ in rows if i is not None]
    known = [(i, v) for i, v in known if v]
    out = []
    for q, v in {(i, tuple(v)) for i, v in known if i in queries}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in known
                         if i != q and len(w) == len(v)))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=6)]) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(700, 760)]  # ties
    rows += [(800, None), (801, []), (802, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (803, [float("nan")] * 6),
             (804, [float("inf")] * 6), (805, [0.0] * 6), (806, [1.0, 2.0]), (810, [3.0, -1.0]), (None, [1.0] * 6),
             (850, [1e7] * 6), (900, [-1e-9] * 6)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                  "vec_id long, embedding array<double>, score string, dim int").repartition(4)
    want = brute(rows, set(range(0, 1000, 50)))
    for shard, block in ((10 ** 6, 1024), (60, 4), (1, 1024)):
        if shard == 1:
            shard = 300
        got = topk.top_k(frame, frame.filter("vec_id % 50 = 0"), shard_rows=shard, block_rows=block)
        assert sorted(map(tuple, got.collect())) == want


def test_query_ids_that_repeat(spark):
    tie = [5.0, 5.0]
    rows = [(50, tie)] * 30 + [(i, tie) for i in range(60, 65)] + [(i, [1.0, i / 100]) for i in range(10, 30)]
    tree = topk.BallTree(np.array([i for i, _ in rows]), np.array([v for _, v in rows]).astype(np.int64))
    assert tree.search(np.array([5, 5]), 50, 5, None) == [(50, -i) for i in range(60, 65)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for shard in (10 ** 6, 20):
        got = topk.top_k(frame, frame.filter("vec_id % 50 = 0"), shard_rows=shard, block_rows=4)
        assert sorted(map(tuple, got.collect())) == brute(rows, {50})


def test_large_numbers_are_exact():
    rows = np.array([[1 << 28, 3], [1 << 28, 4], [-5, 1]], dtype=np.int64)
    tree = topk.BallTree(np.array([7, 3, 9]), rows, leaf_rows=1)
    assert tree.search(np.array([(1 << 28) + 1, 1], dtype=np.int64), -1, 2, None) == [
        ((1 << 28) * ((1 << 28) + 1) + 4, -3), ((1 << 28) * ((1 << 28) + 1) + 3, -7)]


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(frame, frame).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, one).count() == 0
