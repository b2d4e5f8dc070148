import pytest

from graphloom.engine import GraphEngine
from graphloom.plans.parser import QueryError, parse
from graphloom.sources.graph import import_graph


@pytest.fixture(scope="module")
def engine(spark):
    e = GraphEngine(spark)
    e.cypher("CREATE (a:P {name:'A', age:30})-[:K {w:5.0}]->(b:P {name:'B', age:25})-[:K {w:1.0}]->(c:P {name:'C'}), (a)-[:K {w:3.0}]->(c)")
    return e


def rows(e, q, **p):
    return [tuple(r) for r in e.cypher(q, **p).collect()]


def test_precedence_and_literals(engine):
    assert rows(engine, "RETURN 1 + 2 * 3 AS a, 0x10 AS h, 'x' + 1 AS s, -2 ^ 2 AS p")[0][:3] == (7, 16, "x1")


@pytest.mark.parametrize("query,want", [
    ("MATCH (a:P)-[:K]->(b) RETURN a.name AS a, b.name AS b ORDER BY a, b", [("A", "B"), ("A", "C"), ("B", "C")]),
    ("MATCH (a:P {name:'A'})-[:K*1..2]->(b) RETURN b.name AS b, count(*) AS n ORDER BY b", [("B", 1), ("C", 2)]),
    ("MATCH (a:P) OPTIONAL MATCH (a)-[:K]->(b {name:'C'}) RETURN a.name AS a, b.name AS b ORDER BY a", [("A", "C"), ("B", "C"), ("C", None)]),
    ("MATCH (a:P) CALL { WITH a MATCH (a)-[:K]->(b) RETURN count(b) AS k } RETURN a.name AS a, k ORDER BY a", [("A", 2), ("B", 1), ("C", 0)]),
    ("MATCH (a:P) WHERE NOT exists((a)-[:K]->()) RETURN a.name AS a", [("C",)]),
    ("MATCH (a {name:'A'}), (c {name:'C'}) MATCH p = shortestPath((a)-[:K*]->(c)) RETURN length(p) AS n", [(1,)]),
    ("UNWIND $xs AS x RETURN sum(x) AS s, collect(x) AS c", [(6, [1, 2, 3])]),
    ("RETURN 1 AS x UNION RETURN 1 AS x", [(1,)]),
])
def test_reads(engine, query, want):
    assert rows(engine, query, xs=[1, 2, 3]) == want


def test_writes_constraints_and_transactions(spark):
    e = GraphEngine(spark)
    e.cypher("MERGE (x:U {k: 1}) ON CREATE SET x.v = 1 ON MATCH SET x.v = 2")
    e.cypher("MERGE (x:U {k: 1}) ON CREATE SET x.v = 1 ON MATCH SET x.v = 2")
    assert rows(e, "MATCH (x:U) RETURN x.k AS k, x.v AS v") == [(1, 2)]
    e.cypher("CREATE CONSTRAINT u FOR (n:U) REQUIRE n.k IS UNIQUE")
    with pytest.raises(QueryError):
        e.cypher("CREATE (:U {k: 1})")
    e.cypher("BEGIN")
    e.cypher("MATCH (x:U) DETACH DELETE x")
    e.cypher("ROLLBACK")
    assert rows(e, "MATCH (x:U) RETURN count(x) AS n") == [(1,)]


def test_algorithms(engine):
    engine.cypher("CALL gds.graph.project('t', 'P', 'K', 'w')")
    ids = {n: i for n, i in rows(engine, "MATCH (a:P) RETURN a.name AS n, id(a) AS i")}
    assert abs(sum(r[1] for r in rows(engine, "CALL gds.pageRank.stream('t', 3)")) - 1) < 1e-9
    path = engine.procedure("gds.shortestPath.dijkstra.stream", ["t", ids["A"], ids["C"]]).collect()
    assert [r.nodeId for r in path] == [ids["A"], ids["C"]] and path[0].totalCost == 3.0
    with pytest.raises(QueryError):
        engine.cypher("CALL gds.graph.project('t', 'P', 'K')")


def test_import(spark, tmp_path):
    (tmp_path / "n.csv").write_text(":ID,name,age:INT,:LABEL\n1,Ann,3,P\n2,Bo,4,P;Q\n")
    (tmp_path / "r.csv").write_text(":START_ID,:END_ID,:TYPE,w:FLOAT\n1,2,KNOWS,0.5\n")
    e = GraphEngine(spark, import_graph(spark, [str(tmp_path / "n.csv")], [str(tmp_path / "r.csv")]))
    assert rows(e, "MATCH (a:P)-[r:KNOWS]->(b:Q) RETURN a.name AS a, b.age AS g, r.w AS w") == [("Ann", 4, 0.5)]
    assert rows(e, "LOAD CSV WITH HEADERS FROM $f AS row RETURN row.name AS n ORDER BY n", f="file://" + str(tmp_path / "n.csv")) == [("Ann",), ("Bo",)]


def test_builder(spark):
    e = GraphEngine(spark)
    e.builder().create("(a:P {name: $n, age: 3})", "(b:P:Q {name: 'Bo', age: 4})", "(a)-[:K {w: 2}]->(b)", n="it's").run()
    got = lambda b: [tuple(r) for r in b.run().collect()]
    people = e.builder().match("(n:P)")
    assert got(people.where("n.age > $low AND n.age < $high", low=2, high=9).returns("n.name AS name").order_by("n.age DESC").page(1, after=1)) == [("it's",)]
    assert got(e.builder().match("(a:P)-[r:K]->(b:Q)", a={"name": "it's"}).returns("b.name AS b", "r.w AS w").check()) == [("Bo", 2)]
    e.builder().match("(n:Q)").assign("n", age=5).run()
    e.builder().match("(n:Q)").label("n", "R").run()
    e.builder().match("(n:Q)").forget("n", "name").run()
    assert rows(e, "MATCH (n:R) RETURN n.age AS a, n.name AS n") == [(5, None)]
    e.builder().match("(n:R)").delete("n", detach=True).run()
    assert got(people.returns("count(n) AS c")) == [(1,)]  # a builder is not changed by what follows from it
    assert got(e.builder().unwind([1, 2, 2], "x").returns("sum(DISTINCT x) AS s")) == [(3,)]
    e.builder().merge("(m:M {k: $k})", k=7).run()
    assert got(e.builder().match("(m:M)", optional=True).returns("m.k AS k", distinct=True)) == [(7,)]
    e.builder().call("dbms.setConfig", "k", "v").run()
    assert e.config["k"] == "v"
    with pytest.raises(QueryError):
        e.builder().match("(n)", **{"n`": {"k": 1}})
    with pytest.raises(QueryError):
        people.where("n.a = $x", x=1).where("n.b = $x", x=2)
    with pytest.raises(QueryError):
        e.builder().match("(n").check()


def test_durations(engine):
    got = rows(engine, "RETURN duration('P1Y2M1W3DT4H5M6S') AS d, date('2024-01-31') + duration('P1M') AS roll, duration({days: 3}) - duration('P1D') AS less, "
               "datetime({year: 2024, month: 3, day: 2, hour: 1}) - datetime('2024-03-01T00:00:00') AS gap, datetime('2024-03-01T00:00:00') - datetime({year: 2024, month: 3, day: 2, hour: 1}) AS back")[0]
    assert tuple(got[0]) == (14, 10, (4 * 3600 + 5 * 60 + 6) * 10**9) and str(got[1]) == "2024-03-02" and tuple(got[2]) == (0, 2, 0)
    assert tuple(got[3]) == (0, 1, 3600 * 10**9) and tuple(got[4]) == (0, -1, -3600 * 10**9)
    with pytest.raises(Exception, match="not a duration"):
        rows(engine, "UNWIND ['x'] AS s RETURN duration(s) AS d")


@pytest.mark.parametrize("bad", ["MATCH (a RETURN a", "RETURN", "RETURN 1 AS a, 2 AS a ORDER"])
def test_bad_syntax(bad):
    with pytest.raises(QueryError):
        parse(bad)


def test_parallel_relationships_have_identities(spark):
    e = GraphEngine(spark)
    e.cypher("CREATE (a:T)-[:R {w: 1}]->(b:T), (a)-[:R {w: 1}]->(b)")
    assert rows(e, "MATCH (:T)-[r:R]->(:T) RETURN count(DISTINCT id(r)) AS n") == [(2,)]
    e.cypher("MATCH (:T)-[r:R]->(:T) WITH r LIMIT 1 SET r.w = 2")
    assert rows(e, "MATCH (:T)-[r:R]->(:T) RETURN r.w AS w ORDER BY w") == [(1,), (2,)]
    e.cypher("MATCH (:T)-[r:R]->(:T) WHERE r.w = 2 DELETE r")
    assert rows(e, "MATCH (:T)-[r:R]->(:T) RETURN r.w AS w") == [(1,)]


@pytest.mark.parametrize("query,want", [
    ("RETURN [x IN ['a', 'b'] | x + '!'] AS l, reduce(s = '', x IN ['a', 'b'] | s + x) AS r, reduce(t = 0, x IN [1.5, 2.5] | t + x) AS u", [(["a!", "b!"], "ab", 4.0)]),
    ("RETURN 2147483647 + 1 AS a, [x IN [100000] | x * x] AS b", [(2147483648, [10**10])]),
    ("RETURN 1 < 2 < 3 AS a, 'a' < 1 AS b, 1 = 'a' AS c, null < 1 AS d", [(True, False, False, None)]),
    ("RETURN {a: 1}.b AS a, size({a: 1}) AS b, toInteger(1.0E10) AS c, duration('P1M') < duration('P31D') AS d", [(None, None, 10**10, True)]),
    ("UNWIND [1, 'a', true] AS x RETURN toString(x) AS s, x = 'a' AS a // the end", [("1", False), ("a", True), ("true", False)]),
    ("UNWIND $rows AS r RETURN r.a AS a, r.b AS b", [(1, "x"), (2, None)]),
    ("UNWIND [1, 1, 2, 4] AS x RETURN percentileCont(DISTINCT x, 0.5) AS c, percentileDisc(DISTINCT x, 0.5) AS d", [(2.0, 2)]),
])
def test_types(engine, query, want):
    assert rows(engine, query, rows=[{"a": 1, "b": "x"}, {"a": 2}]) == want


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning"), plan


def test_plans(spark):
    """A foreign key is no join with the table itself; exists is a semi join; no table is opened that isn't read."""
    from graphloom import tpch

    g = tpch.tpch_graph(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = GraphEngine(spark, g)
        n, plan = exchanges(e.cypher("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_name AS n, c.c_custkey AS k"))
        assert n == 2 and plan.split("== Initial Plan ==")[0].count("Scan parquet") == 2
        n, plan = exchanges(e.cypher("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS k, o.o_totalprice AS p"))
        assert n == 2 and plan.split("== Initial Plan ==")[0].count("Scan parquet") == 2
        n, plan = exchanges(e.cypher("MATCH (c:Customer) WHERE NOT exists((c)-[:PLACED]->(:Order {o_orderstatus: 'F'})) RETURN c.c_custkey AS k"))
        assert n == 2 and "LeftAnti" in plan and plan.split("== Initial Plan ==")[0].count("Scan parquet") == 2
        assert sum(isinstance(dict.__getitem__(g.nodes, k), type(spark.range(1))) for k in g.nodes) <= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paths_and_searches(spark):
    e = GraphEngine(spark)
    e.cypher("UNWIND range(1, 25) AS i CREATE (:C {i: i})")
    e.cypher("MATCH (a:C), (b:C) WHERE b.i = a.i + 1 CREATE (a)-[:N]->(b)")
    assert rows(e, "MATCH (a:C {i: 1}), (b:C {i: 25}) MATCH p = shortestPath((a)-[:N*]->(b)) RETURN length(p) AS n") == [(24,)]
    ids = dict(rows(e, "MATCH (a:C) RETURN a.i AS i, id(a) AS k"))
    assert e.get_shortest_path(ids[1], ids[4]).head().path == [ids[i] for i in (1, 2, 3, 4)] and e.get_shortest_path(ids[1], ids[25]).count() == 0
    assert e.bfs(ids[1]).count() == 25
    e.cypher("MATCH (a:C {i: 1}), (b:C {i: 3}) CREATE (a)-[:N]->(b)")
    assert sorted(r.path for r in e.find_all_paths(ids[1], ids[4]).collect()) == [[ids[i] for i in (1, 2, 3, 4)], [ids[i] for i in (1, 3, 4)]]
    e.cypher("CALL dbms.setConfig('query.max_hops', 2)")
    assert rows(e, "MATCH (a:C {i: 5})-[:N*]->(b) RETURN max(b.i) AS i") == [(7,)]


def test_searches_in_batches(spark, monkeypatch):
    from graphloom.operators import algorithms as alg

    e = GraphEngine(spark)
    e.cypher("CREATE (a:B {n: 1})-[:L]->(b:B {n: 2})-[:L]->(c:B {n: 3})-[:L]->(d:B {n: 4}), (b)-[:L]->(d), (:B {n: 5})")
    e.cypher("CALL gds.graph.project('g', 'B', 'L')")
    both = lambda: [sorted(rows(e, f"CALL gds.{x}.stream('g')")) for x in ("closeness", "betweenness")]
    whole = both()
    monkeypatch.setattr(alg, "HELD", 10)
    assert both() == whole and sorted(s for _, s in whole[1]) == [0, 0, 0, 0, 2.0]
    assert len(rows(e, "CALL gds.closeness.stream('g', 2)")) == 5


def test_constraint_violations(spark):
    e = GraphEngine(spark)
    e.cypher("CREATE (:U {a: 1, b: 'x'}), (:U {a: 2, b: 'y'})")
    for rule, bad in (("n.a IS UNIQUE", "CREATE (:U {a: 1, b: 'z'})"), ("n.b IS NOT NULL", "CREATE (:U {a: 9})"), ("(n.a, n.b) IS NODE KEY", "CREATE (:U {a: 1, b: 'x'})"), ("n.a IS :: INTEGER", "CREATE (:U {a: 'text', b: 'q'})")):
        e.cypher(f"CREATE CONSTRAINT c FOR (n:U) REQUIRE {rule}")
        with pytest.raises(QueryError):
            e.cypher(bad)
        assert e.scalar("MATCH (n:U) RETURN count(n) AS n") == 2
        e.cypher("DROP CONSTRAINT c")
    with pytest.raises(QueryError):
        e.cypher("MATCH (n:U {a: 1}), (m:U {a: 2}) CREATE (n)-[:R]->(m)") and e.cypher("MATCH (n:U) DELETE n")


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_created_edges_are_written_once(spark, monkeypatch):
    """One narrow table for the new relationships; distinct ids are counted without dealing out the ids."""
    e = GraphEngine(spark)
    e.cypher("UNWIND range(1, 6) AS i CREATE (:P {i: i, text: 'long'})")
    written, store = [], e.store
    monkeypatch.setattr(e, "store", lambda df: written.append(len(df.columns)) or store(df))
    monkeypatch.setattr(e, "settle", lambda df: pytest.fail("a checkpoint"))
    e.cypher("MATCH (a:P), (b:P) WHERE a.i < b.i CREATE (a)-[:Q {gap: b.i - a.i}]->(b)")
    assert written == [5]  # both ends, gap, and two columns for the ids
    got = e.cypher("MATCH (a:P)-[r:Q]->(b:P) RETURN a.i AS a, count(*) AS n, sum(r.gap) AS gap, count(DISTINCT id(r)) AS ids")
    assert sorted(tuple(r) for r in got.collect()) == [(i, 6 - i, (6 - i) * (7 - i) // 2, 6 - i) for i in range(1, 6)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "count(eid__" in plan
    assert rows(e, "MATCH (a:P)-[r:Q]-(b:P) RETURN count(*) AS n, count(DISTINCT id(r)) AS ids") == [(30, 15)]
    assert rows(e, "MATCH (a:P)-[r:Q]->(b:P), (c:P) RETURN count(*) AS n, count(DISTINCT id(r)) AS ids") == [(90, 15)]
    assert rows(e, "MATCH (a:P)-[r:Q]->(b:P)-[:Q]->(c:P) RETURN count(*) AS n, count(DISTINCT id(r)) AS ids") == [(20, 10)]
    assert rows(e, "MATCH (a:P)-[r:Q]->(b:P) UNWIND [1, 2] AS x RETURN count(DISTINCT id(r)) AS ids") == [(15,)]


def test_ids_of_twins_without_one(spark):
    from graphloom.sources.graph import PropertyGraph

    g = PropertyGraph(spark).with_nodes(("T",), spark.range(3)).with_rels("U", spark.createDataFrame([(0, 1, 5), (0, 1, 5), (0, 2, 5)], "src long, dst long, w long"))
    e = GraphEngine(spark, g)
    e.cypher("MATCH (a:T) WHERE id(a) = 0 MATCH (b:T) WHERE id(b) = 1 CREATE (a)-[:U {w: 5}]->(b), (a)-[:U {w: 5}]->(b)")
    assert rows(e, "MATCH (a:T)-[r:U]->(b:T) RETURN count(*) AS n, count(DISTINCT id(r)) AS ids") == [(5, 4)]


def test_ends_lose_their_label(spark):
    e = GraphEngine(spark)
    e.cypher("UNWIND range(1, 3) AS i CREATE (:V {i: i})")
    e.cypher("MATCH (a:V), (b:V) CREATE (a)-[:W]->(b)")
    assert rows(e, "MATCH (a:V)-[:W]->(b:V) RETURN count(*) AS n") == [(9,)]
    e.cypher("MATCH (a:V) WHERE a.i = 1 REMOVE a:V")
    assert rows(e, "MATCH (a:V)-[:W]->(b:V) RETURN count(*) AS n") == [(4,)]
