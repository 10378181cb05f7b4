"""The graph queries over whole keys, against plain Python on a small fixture."""

from __future__ import annotations

from brightwater.operators import recursive
from brightwater.plans import registry

ORDERS = [(10, 1), (11, 1), (12, 2), (13, 45), (14, None)]
ITEMS = [(10, 100, 7), (10, 101, 7), (11, 100, 47), (12, 140, 7), (13, 101, 47), (13, 101, 47)]
SUPPLIERS, NATIONS = [(7, 3), (47, 4)], [(3, 0), (4, 1)]


def test_graphs_of_keys(spark, tmp_path):
    registry.load()
    for name, rows, columns in (("orders", ORDERS, "o_orderkey long, o_custkey long"), ("lineitem", ITEMS, "l_orderkey long, l_partkey long, l_suppkey long"), ("supplier", SUPPLIERS, "s_suppkey long, s_nationkey int"), ("nation", NATIONS, "n_nationkey int, n_regionkey int")):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    edges = {(f"c{c}", f"o{o}") for o, c in ORDERS if c} | {(f"o{o}", f"c{c}") for o, c in ORDERS if c}
    edges |= {(f"o{o}", f"p{p}") for o, p, _ in ITEMS} | {(f"o{o}", f"s{s}") for o, _, s in ITEMS} | {(f"s{s}", f"n{n}") for s, n in SUPPLIERS} | {(f"n{n}", f"r{r}") for n, r in NATIONS}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    run = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(run("graph_two_hop")) == sorted({(a, c) for a, b in edges for c in after.get(b, ())})

    reach = set()
    for start in {a for a, _ in edges if a[0] == "c"}:
        depth, frontier = {start: 0}, {start}
        for d in range(1, 7):
            frontier = {b for a in frontier for b in after.get(a, ())} - depth.keys()
            depth |= dict.fromkeys(frontier, d)
        reach |= {(start, n, d) for n, d in depth.items() if d}
    assert sorted(run("graph_reachable")) == sorted(reach)

    paths, rows = [], [("c1",)]
    for _ in range(4):
        rows = [(*p, b) for p in rows for b in after.get(p[-1], ()) if b not in p]
        paths += rows
    got = run("graph_paths")
    assert sorted(tuple(p) for *_, p in got) == sorted(paths) and all((s, n) == (p[0], p[-1]) for s, n, p in got)


def test_two_hops_shuffle_keys(spark, tmp_path):
    """Nodes get their names after the joins and the distinct: once a chain of kinds and side."""
    registry.load()
    for name, rows, columns in (("orders", ORDERS, "o_orderkey long, o_custkey long"), ("lineitem", ITEMS, "l_orderkey long, l_partkey long, l_suppkey long"), ("supplier", SUPPLIERS, "s_suppkey long, s_nationkey int"), ("nation", NATIONS, "n_nationkey int, n_regionkey int")):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = registry.QUERIES["graph_two_hop"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert len([x for x in lines if "concat(" in x]) == 6


def test_reachable_writes_edges_once(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    written, keep = [], recursive._written
    monkeypatch.setattr(recursive, "_written", lambda df: written.append(df.columns) or keep(df))
    monkeypatch.setattr(recursive, "FEW", 1)
    found = recursive.reachable(edges, edges.select("src"), 1, 2)
    assert written.count(["src", "dst"]) == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 1), (1, 3, 2), (2, 1, 2), (2, 3, 1), (2, 4, 2), (3, 1, 1), (3, 2, 2), (3, 4, 1)]
