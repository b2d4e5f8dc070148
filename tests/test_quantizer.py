"""Product quantisation against brute force."""

import numpy as np
import pyarrow.parquet as pq

from graphloom import tpch
from graphloom.engine import GraphEngine
from graphloom.operators.quantizer import CODEWORDS, Codebook, kmeans, nearest_centre

DATA = "/root/testdata/sf0.01"


def distances(x, q, metric):
    if metric == "L2":
        return ((x - q) ** 2).sum(1)
    dot = x @ q
    return -dot if metric == "IP" else 1 - dot / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))


def test_kmeans():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in (0, 5, 10)])
    assert sorted(kmeans(x, 3).mean(1).round().tolist()) == [0, 5, 10]
    # No more centres than distinct rows, each of which is its own centre.
    few = np.array([[1.0, 2], [1, 2], [3, 4]])
    own, gap = nearest_centre(few, kmeans(few, 8))
    assert len(kmeans(few, 8)) == 2 and own[0] == own[1] != own[2] and np.allclose(gap, 0)


def test_codes_and_tables(spark):
    x = np.random.default_rng(4).normal(size=(300, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    book = Codebook(df, 10, "L2")
    code = {r["id"]: r["code"] for r in book.codes(df).collect()}
    assert [len(w) for w in book.words] == [CODEWORDS] * 3
    q = x[7] * 0.5
    table = np.array(book.table(q.tolist())).reshape(3, CODEWORDS)
    near = {}
    for i, v in enumerate(x):
        want = [int(((w - v[p]) ** 2).sum(1).argmin()) for p, w in zip(book.parts, book.words)]
        assert code[i] == want
        decoded = np.concatenate([w[c] for w, c in zip(book.words, want)])
        near[i] = sum(table[m, c] for m, c in enumerate(want))
        assert np.isclose(near[i], ((decoded - q) ** 2).sum())
    got = [r["id"] for r in book.shortlist(book.codes(df), q.tolist(), 20).collect()]
    assert set(got) == set(sorted(near, key=lambda i: (round(near[i], 9), i))[:20])


def test_recall_of_trained_indexes(spark):
    t = pq.read_table(f"{DATA}/embeddings.parquet")
    ids, x = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), float)
    for metric in ("IP", "L2", "Cosine"):
        e = GraphEngine(spark, tpch.tpch_graph(spark, DATA))
        e.cypher(f"CREATE VECTOR INDEX v ON :Vec(embedding) OPTIONS {{dimension: 64, metric: '{metric}'}}")
        assert e.procedure("db.index.vector.train", ["v"]).head()[0] == "Success"
        caught = 0
        for q in x[::125]:
            d = distances(x, q, metric)
            got = e.procedure("db.index.vector.queryNodes", ["v", 10, q.tolist()]).collect()
            assert len(got) == 10 and [r["score"] for r in got] == sorted(r["score"] for r in got)
            at = {int(i): s for i, s in zip(ids, d)}
            assert all(abs(at[r["node"] - (8 << 40)] - r["score"]) < 1e-6 for r in got)
            caught += len({r["node"] - (8 << 40) for r in got} & {int(i) for i in ids[np.argsort(d, kind="stable")[:10]]})
        assert caught / (10 * len(x[::125])) >= 0.9


def test_writes_and_unusable_vectors(spark):
    e = GraphEngine(spark)
    e.cypher("CREATE VECTOR INDEX v ON :T(p) OPTIONS {metric: 'L2'}")
    assert e.cypher("CALL db.index.vector.train('v') YIELD status RETURN status").head()[0] == "Skipped (Empty Data)"
    e.cypher("CREATE (:T {k: 1, p: [0.0, 0.0]}), (:T {k: 2, p: [3.0, 4.0]}), (:T {k: 3, p: [1.0, 0.0, 0.0]}), (:T {k: 4})")
    assert e.cypher("CALL db.index.vector.train('v') YIELD status RETURN status").head()[0] == "Success"
    find = lambda: [r["score"] for r in e.procedure("db.index.vector.queryNodes", ["v", 5, [3.0, 4.0]]).collect()]
    assert find() == [0.0, 25.0]
    # A node written after the training is found all the same.
    e.cypher("CREATE (:T {k: 5, p: [3.0, 5.0]})")
    assert find() == [0.0, 1.0, 25.0]
