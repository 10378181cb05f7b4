"""Near vectors against brute force: copies, links and components, lengths and labels that share buckets; recall of the hashes."""

import numpy as np

from brightwater.llm import embeddings
from brightwater.llm.embeddings import cross_polytope, near_vectors


def brute(rows, threshold):
    known = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, *_ in rows}
    for i, a, p in known:
        for j, b, q in known:
            if i != j and p == q and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen) if i is not None else None, i is None or min(seen) == i)
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(600):
        v = centres[i % 40] + rng.normal(size=16) * 0.12 * (i % 5)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3))
    copy = rows[7][1]
    rows += [(1000 + i, copy, 1 if i % 4 else 2) for i in range(150)]
    rows += [(2000 + i, [float(2 * x) for x in copy], 1) for i in range(3)] + [(2010, [1 / 3] * 16, 1), (2011, [0.1] * 16, 1), (2012, [1.0] * 5, 1), (2013, [2.0] * 5, 1)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("inf")] * 16, 1), (3003, copy, None), (None, copy, 1)]
    want = brute(rows, 0.93)
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, key string, n int, id int")
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table).collect()} == want
    assert max(n for n, *_ in want.values()) > 100


def test_recall_at_the_threshold():
    """Pairs at a cosine of 0.93 in 64 dimensions: how many share no probed bucket in any table."""
    rng = np.random.default_rng(8)
    n = 20_000
    a = rng.normal(size=(n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = cross_polytope(a), cross_polytope(b)
    found = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any(axis=(1, 2))
    assert found.sum() >= n - 2


def test_vectors_stay_few_on_the_way(spark, monkeypatch):
    """No staged table has many rows for a vector (the driver and the disk follow the input); small blocks and several searches give the same."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(500, 32))
    rows = [(i, [float(x) for x in (centres[i % 500] + rng.normal(size=32) * 0.2).astype(np.float32)], 1) for i in range(700)]
    rows += [(1000 + i, [float(x) for x in (centres[0] + rng.normal(size=32) * 0.15).astype(np.float32)], 1) for i in range(40)]
    want = brute(rows, 0.93)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    staged, put = {}, embeddings.Scratch.put
    monkeypatch.setattr(embeddings.Scratch, "put", lambda self, name, df, *a: (out := put(self, name, df, *a), staged.update({name: out.count()}))[0])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table).collect()} == want
    assert staged and max(staged.values()) <= 4 * len(rows)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "AT_ONCE", 100, raising=False)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table).collect()} == want
    assert near_vectors(table.limit(0)).collect() == []
