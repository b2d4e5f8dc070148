"""Graph queries whose work follows the tables, against plain Python."""

import random

import pyarrow.parquet as pq
import pytest

from graphloom import tpch
from graphloom.operators import algorithms as alg

DATA = "/root/testdata/sf0.001"
SCORES = ["betweenness", "closeness"]


def column(table, *names):
    return list(zip(*(pq.read_table(f"{DATA}/{table}.parquet").column(n).to_pylist() for n in names), strict=True))


def test_var_length_all(spark):
    region = dict(column("nation", "n_nationkey", "n_regionkey"))
    want = {k: 1 + (region[n] is not None) for k, n in column("customer", "c_custkey", "c_nationkey") if n in region}
    got = {r.k: r.reached for r in tpch.queries()["g_var_length_all"](spark, DATA).collect()}
    assert got == want and len(got) == len(column("customer", "c_custkey"))


def graph(table, src, dst):
    """Undirected neighbours by (label's ordinal, key), over all nodes."""
    near = {(i + 1, k): set() for i, (t, key) in enumerate(tpch.LABELS.values()) for (k,) in column(t, key)}
    for a, b in column(table, src[1], dst[1]):
        near[src[0], a].add((dst[0], b))
        near[dst[0], b].add((src[0], a))
    return {(o << 40) + k: {(p << 40) + x for p, x in v} for (o, k), v in near.items()}


def depths(near, s):
    seen, front = {s: 0}, [s]
    while front:
        nxt = []
        for v in front:
            for w in near[v] - seen.keys():
                seen[w] = seen[v] + 1
                nxt.append(w)
        front = nxt
    return seen


def test_algorithms_on_growing_edges(spark):
    run = lambda name, col: {r.nodeId: r[col] for r in tpch.queries()[name](spark, DATA).collect()}
    near = graph("supplier", (4, "s_suppkey"), (2, "s_nationkey"))
    reach = {v: depths(near, v) for v in near}
    assert run("g_closeness_based_in", "score") == {v: round((len(d) - 1) / sum(d.values()), 6) if len(d) > 1 else 0.0 for v, d in reach.items()}
    # Every path between two suppliers of a nation leads through the nation.
    assert run("g_betweenness_based_in", "score") == {v: sum(1 for a in n for b in n if a < b) * 1.0 for v, n in near.items()}
    near = graph("orders", (3, "o_custkey"), (6, "o_orderkey"))
    assert run("g_wcc_placed", "c") == {v: min(depths(near, v)) for v in near}
    # Customers have no in-edges and orders no out-edges, so ranks have a closed form.
    base = 1 / (len(near) + 0.85 * sum(1 for v, n in near.items() if n and v >> 40 == 3))
    got = run("g_pagerank_placed", "score")
    want = {v: base * (1 + 0.85 * sum(1 / len(near[w]) for w in n if v >> 40 == 6)) for v, n in near.items()}
    assert got.keys() == want.keys() and all(abs(got[v] - x) < 1e-7 for v, x in want.items())


def brute(nodes, edges):
    """({node: closeness}, {node: betweenness}) over both directions by Brandes; parallel edges are as many ways."""
    ways = {v: {} for v in nodes}
    for a, b in edges:
        if a != b:
            ways[a][b] = ways[a].get(b, 0) + 1
            ways[b][a] = ways[b].get(a, 0) + 1
    close, between = {}, dict.fromkeys(nodes, 0.0)
    for s in nodes:
        deep = depths(ways, s)
        sigma, delta = {s: 1}, dict.fromkeys(deep, 0.0)
        for v in sorted(deep, key=deep.get):
            if v != s:
                sigma[v] = sum(sigma[u] * m for u, m in ways[v].items() if deep[u] == deep[v] - 1)
        for v in sorted(deep, key=deep.get, reverse=True):
            for u, m in ways[v].items():
                if deep[u] == deep[v] - 1:
                    delta[u] += sigma[u] * m / sigma[v] * (1 + delta[v])
            between[v] += delta[v] / 2 if v != s else 0
        close[s] = (len(deep) - 1) / sum(deep.values()) if len(deep) > 1 else 0.0
    return close, between


def agrees(spark, name, nodes, edges):
    g = spark.createDataFrame([(v,) for v in nodes], "id long").localCheckpoint(), spark.createDataFrame(edges, "src long, dst long").localCheckpoint()
    got = {r.nodeId: r.score for r in getattr(alg, name)(*g, lambda df: df.localCheckpoint()).collect()}
    want = brute(nodes, edges)[name == "betweenness"]
    return got.keys() == want.keys() and all(abs(got[v] - x) < 1e-9 for v, x in want.items())


@pytest.mark.parametrize("name", SCORES)
def test_trees_are_not_searched(spark, monkeypatch, name):
    """Stars, a pair, a path and a tree, beside lonely nodes: no search, however many nodes a batch may hold."""
    edges = [(0, i) for i in range(1, 9)] + [(10, 11), (11, 10)] + [(i, i + 1) for i in range(20, 26)] + [(30, 31), (31, 32), (31, 33), (30, 34), (34, 35), (34, 35), (35, 36)]
    nodes = [*range(0, 9), 10, 11, *range(20, 27), *range(30, 37), *range(50, 90)]
    monkeypatch.setattr(alg, "HELD", 10)
    monkeypatch.setattr(alg, "distances", lambda *_: pytest.fail("a tree was searched"))
    assert agrees(spark, name, nodes, edges)


@pytest.mark.parametrize("name", SCORES)
def test_folded_and_searched(spark, monkeypatch, name):
    """Cycles with trees on them, twin edges, loops and components of several kinds, in one batch and in several."""
    rng = random.Random(7)
    edges = [(rng.randrange(24), rng.randrange(24)) for _ in range(30)] + [(24, 25), (25, 26), (26, 24), (26, 27), (27, 28), (28, 29), (28, 30), (27, 28), (31, 32), (33, 33), (34, 35), (34, 36)]
    for held in (1 << 28, 60):
        monkeypatch.setattr(alg, "HELD", held)
        assert agrees(spark, name, range(40), edges)
