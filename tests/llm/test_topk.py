"""The threshold algorithm: right rows, and how many it scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwater.llm.topk import Best, exact_topk, threshold_search


def brute(q, own, rows, ids, k):
    return sorted((-int(s), int(i)) for s, i in zip(rows @ q, ids, strict=True) if i != own)[:k]


def search(queries, rows, blocks, k=5):
    ids = np.random.default_rng(9).permutation(len(rows)).astype(np.int64)
    own = np.where(np.arange(len(queries)) % 2, ids[: len(queries)], -1)
    best = Best(queries, own, k)
    order = np.argsort(-np.linalg.norm(rows, axis=1), kind="stable")
    for part in np.array_split(order, blocks):
        threshold_search(best, rows[part], ids[part])
    assert best.found == [brute(q, i, rows, ids, k) for q, i in zip(queries, own, strict=True)]
    return best.scored / len(queries) / len(rows)


@pytest.mark.parametrize("blocks", [1, 7])
def test_share_scored(blocks):
    rng = np.random.default_rng(blocks)
    flat = rng.normal(size=(3000, 16))
    skewed = np.floor(256 * flat * rng.pareto(1.5, (3000, 1))).astype(np.int64)
    assert search(skewed[:20], skewed, blocks) < 0.25
    # lengths alike and directions at random: lists say next to nothing
    assert search(np.floor(256 * flat[:20]).astype(np.int64), np.floor(256 * flat).astype(np.int64), blocks) > 0.5
    sparse = np.where(rng.random((3000, 16)) < 0.1, skewed, 0)
    assert search(sparse[:20], sparse, blocks) < 0.5
    assert search(np.zeros((2, 16), np.int64), skewed, blocks) == 1.0


def test_ties_and_large_numbers():
    rows = np.array([[1, 1]] * 50 + [[2**61, 1]] * 3 + [[-(2**61), 5]] * 3, object)
    ids = np.arange(56)[::-1].astype(np.int64)
    best = Best(np.array([[1, 0], [2**61, 3], [0, 0]]), np.array([5, 900, 901]), 4)
    threshold_search(best, rows.astype(np.int64), ids, depth=2)
    assert best.found == [brute(q, own, rows, ids, 4) for q, own in zip(np.array([[1, 0], [2**61, 3], [0, 0]], object), (5, 900, 901), strict=True)]


def test_strands_and_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8 if i % 3 else 5) * rng.pareto(2)], 1) for i in range(400)]
    rows += [(400 + i, [0.5] * 8, 1) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in exact_topk(table, F.col("vec_id") % 10 == 0, block=256, query_block=256).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v, _ in rows}
    for q in range(0, 430, 10):
        same = [i for i in whole if len(whole[i]) == len(whole[q])]
        assert sorted(got[q]) == brute(whole[q], q, np.array([whole[i] for i in same]), same, 5)
