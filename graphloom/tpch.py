"""The relational test tables as a property graph, and the registered queries with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import GraphEngine
from .sources.graph import ForeignKey, PropertyGraph, import_graph

#: label -> (table, key); ids are ordinal * 2**40 + key.
LABELS = {
    "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"),
    "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey"), "Event": ("events", "event_id"), "Vec": ("embeddings", "vec_id"),
}


def node_id(label: str, key) -> Column:
    return F.lit((list(LABELS).index(label) + 1) << 40) + (F.col(key) if isinstance(key, str) else key).cast("long")


_opened: dict[tuple, DataFrame] = {}


def tpch_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Lazy views: node tables are the tables with an id, relationships are foreign keys. A table is opened when it is
    first read, and once in a session."""
    g = PropertyGraph(spark)

    def read(t: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), sf_dir, t)
        if key not in _opened:
            _opened[key] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        return _opened[key]

    def nodes(label: str, t: str, key: str) -> DataFrame:
        df = read(t)
        return df.select(node_id(label, key).alias("id"), *(F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes))

    for label, (t, key) in LABELS.items():
        g = g.with_nodes((label,), lambda label=label, t=t, key=key: nodes(label, t, key))

    def rel(name: str, t: str, a: tuple, b: tuple, props: list[str]) -> None:
        nonlocal g
        key = None
        for end, (own, far) in enumerate(((a, b), (b, a))):
            if LABELS[own[0]] == (t, own[1]) and not props:
                key = ForeignKey(own[0], end, (far[1],), lambda p, far=far: node_id(far[0], p[far[1]]))
        g = g.with_rels(name, lambda: read(t).select(node_id(*a).alias("src"), node_id(*b).alias("dst"), *props), (a[0], b[0]), key)

    rel("IN_REGION", "nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), [])
    rel("LIVES_IN", "customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), [])
    rel("BASED_IN", "supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), [])
    rel("PLACED", "orders", ("Customer", "o_custkey"), ("Order", "o_orderkey"), [])
    rel("CONTAINS", "lineitem", ("Order", "l_orderkey"), ("Part", "l_partkey"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    rel("DID", "events", ("Customer", "user_id"), ("Event", "event_id"), [])

    def supplies() -> DataFrame:
        pairs = read("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
        return pairs.select(node_id("Supplier", "l_suppkey").alias("src"), node_id("Part", "l_partkey").alias("dst"), "n")

    return g.with_rels("SUPPLIES", supplies, ("Supplier", "Part"))


#: name -> (query, SQL)
READS: dict[str, tuple[str, str]] = {
    "nation_customers": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE c.c_acctbal > 0 RETURN n.n_name AS nation, count(*) AS customers, round(sum(c.c_acctbal), 2) AS bal ORDER BY customers DESC, nation LIMIT 5",
        "SELECT n_name AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name ORDER BY customers DESC, nation LIMIT 5"),
    "scan_filter": ("MATCH (p:Part) WHERE p.p_size >= 10 AND p.p_size < 20 AND p.p_brand <> 'Brand#11' RETURN p.p_partkey AS k, p.p_name AS name",
        "SELECT p_partkey AS k, p_name AS name FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand <> 'Brand#11'"),
    "scan_property_equality": ("MATCH (o:Order {o_orderstatus: 'F'}) RETURN count(o) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    "between_in": ("MATCH (o:Order) WHERE o.o_totalprice BETWEEN 1000 AND 50000 AND o.o_orderpriority IN ['1-URGENT', '2-HIGH'] RETURN o.o_orderkey AS k",
        "SELECT o_orderkey AS k FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "distinct": ("MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS seg", "SELECT DISTINCT c_mktsegment AS seg FROM customer"),
    "order_skip_limit": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 20",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20 OFFSET 5"),
    "aggregates": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) AS n, count(DISTINCT o.o_custkey) AS cust, round(avg(o.o_totalprice), 2) AS a, min(o.o_totalprice) AS lo, max(o.o_totalprice) AS hi",
        "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS cust, round(avg(o_totalprice), 2) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY s"),
    "stdev_percentiles": ("MATCH (c:Customer) RETURN c.c_mktsegment AS s, round(stDev(c.c_acctbal), 3) AS sd, round(stDevP(c.c_acctbal), 3) AS sp, round(percentileCont(c.c_acctbal, 0.25), 3) AS pc, percentileDisc(c.c_acctbal, 0.9) AS pd",
        "SELECT c_mktsegment AS s, round(stddev_samp(c_acctbal), 3) AS sd, round(stddev_pop(c_acctbal), 3) AS sp, round(quantile_cont(c_acctbal, 0.25), 3) AS pc, list_sort(list(c_acctbal))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS pd FROM customer GROUP BY s"),
    "nested_aggregate": ("MATCH (c:Customer) RETURN c.c_nationkey AS k, count(*) * 2 + 1 AS x, sum(c.c_custkey) / count(*) AS m",
        "SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) * 2 + 1 AS x, CAST(sum(c_custkey) AS DOUBLE) / count(*) AS m FROM customer GROUP BY c_nationkey"),
    "having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.c_custkey AS k, count(o) AS n WHERE n > 12 RETURN k, n",
        "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "two_hops": ("MATCH (c:Customer)-[:LIVES_IN]->(:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(*) AS n",
        "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "rel_properties": ("MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 45 RETURN p.p_brand AS brand, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 1) AS rev",
        "SELECT p_brand AS brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 1) AS rev FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 GROUP BY brand"),
    "incoming": ("MATCH (p:Part)<-[s:SUPPLIES]-(x:Supplier) WHERE s.n > 1 RETURN x.s_suppkey AS k, count(p) AS parts, sum(s.n) AS n",
        "SELECT l_suppkey AS k, count(*) AS parts, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY k"),
    "undirected": ("MATCH (n:Nation)-[:IN_REGION]-(r:Region) RETURN r.r_name AS r, count(n) AS n", "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r"),
    "multi_type": ("MATCH (x)-[r:LIVES_IN|BASED_IN]->(n:Nation) RETURN n.n_name AS nation, type(r) AS t, count(*) AS c",
        "SELECT n_name AS nation, t, count(*) AS c FROM (SELECT c_nationkey AS k, 'LIVES_IN' AS t FROM customer UNION ALL SELECT s_nationkey, 'BASED_IN' FROM supplier) JOIN nation ON k = n_nationkey GROUP BY n_name, t"),
    "shared_variable": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN n.n_name AS nation, count(*) AS pairs",
        "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name"),
    "cartesian": ("MATCH (a:Region), (b:Nation) RETURN a.r_regionkey AS a, b.n_nationkey AS b", "SELECT CAST(r_regionkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b FROM region, nation"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS k, count(o) AS n, max(o.o_totalprice) AS hi",
        "SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_totalprice) AS hi FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY k"),
    "exists": ("MATCH (c:Customer) WHERE exists((c)-[:DID]->(:Event {event_type: 'purchase'})) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')"),
    "not_exists": ("MATCH (c:Customer) WHERE NOT exists((c)-[:PLACED]->(:Order {o_orderstatus: 'F'})) RETURN c.c_custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "pattern_comprehension": ("MATCH (r:Region) RETURN r.r_name AS r, size([(n:Nation)-[:IN_REGION]->(r) WHERE n.n_nationkey > 5 | n.n_name]) AS n, [(n:Nation)-[:IN_REGION]->(r) | n.n_name][0] AS first",
        "SELECT r_name AS r, count(*) FILTER (n_nationkey > 5) AS n, min(n_name) AS first FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r"),
    "collect_unwind": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n.n_name) AS names UNWIND names AS name RETURN r.r_name AS r, name", "SELECT r_name AS r, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "with_limit": ("MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10 MATCH (c)-[:PLACED]->(o:Order) RETURN c.c_custkey AS k, count(o) AS n",
        "SELECT c_custkey AS k, count(*) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) JOIN orders ON o_custkey = c_custkey GROUP BY k"),
    "union": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("MATCH (r:Region) RETURN r.r_name AS x UNION ALL MATCH (n:Nation) RETURN n.n_name AS x", "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation"),
    "call_subquery": ("MATCH (n:Nation) CALL { WITH n MATCH (c:Customer)-[:LIVES_IN]->(n) WHERE c.c_acctbal > 5000 RETURN count(c) AS rich } RETURN n.n_name AS nation, rich",
        "SELECT n_name AS nation, count(c_custkey) AS rich FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY n_name"),
    "call_subquery_limit": ("MATCH (n:Nation) CALL { WITH n MATCH (c:Customer)-[:LIVES_IN]->(n) RETURN c.c_custkey AS k ORDER BY k DESC LIMIT 2 } RETURN n.n_name AS nation, k",
        "SELECT n_name AS nation, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY c_custkey DESC) <= 2"),
    "case_expression": ("MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'medium' ELSE 'large' END AS c, CASE p.p_size WHEN 1 THEN 'one' ELSE 'more' END AS d, count(*) AS n",
        "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c, CASE p_size WHEN 1 THEN 'one' ELSE 'more' END AS d, count(*) AS n FROM part GROUP BY c, d"),
    "strings": ("MATCH (n:Nation) RETURN toUpper(n.n_name) AS u, toLower(n.n_name) AS l, substring(n.n_name, 1, 3) AS s, left(n.n_name, 2) AS lf, right(n.n_name, 2) AS rt, replace(n.n_name, 'A', '_') AS r, reverse(n.n_name) AS rv, size(n.n_name) AS z, trim('  ' + n.n_name + ' ') AS t, split(n.n_name, 'A')[0] AS sp",
        "SELECT upper(n_name) AS u, lower(n_name) AS l, substr(n_name, 2, 3) AS s, left(n_name, 2) AS lf, right(n_name, 2) AS rt, replace(n_name, 'A', '_') AS r, reverse(n_name) AS rv, length(n_name) AS z, n_name AS t, split_part(n_name, 'A', 1) AS sp FROM nation"),
    "string_predicates": ("MATCH (p:Part) WHERE p.p_name STARTS WITH 'P' OR p.p_name ENDS WITH '7' OR p.p_type CONTAINS 'BRASS' OR p.p_brand =~ 'Brand#1.' RETURN p.p_partkey AS k",
        "SELECT p_partkey AS k FROM part WHERE p_name LIKE 'P%' OR p_name LIKE '%7' OR p_type LIKE '%BRASS%' OR regexp_full_match(p_brand, 'Brand#1.')"),
    "math": ("MATCH (c:Customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a, ceil(c.c_acctbal) AS ce, floor(c.c_acctbal) AS f, sign(c.c_acctbal) AS s, c.c_custkey % 7 AS m, c.c_custkey / 4 AS d, round(sqrt(abs(c.c_acctbal)), 6) AS q, 1 + 2 * 3 AS p",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS ce, floor(c_acctbal) AS f, CAST(sign(c_acctbal) AS BIGINT) AS s, c_custkey % 7 AS m, c_custkey / 4.0::DOUBLE AS d, round(sqrt(abs(c_acctbal)), 6) AS q, 7::BIGINT AS p FROM customer"),
    "lists": ("UNWIND range(1, 20) AS x WITH x, [y IN range(1, x) WHERE y % 2 = 0 | y * y] AS sq RETURN x, size(sq) AS n, reduce(t = 0, y IN sq | t + y) AS total, all(y IN sq WHERE y > 0) AS every, any(y IN sq WHERE y = 16) AS some, head(range(1, x)) AS h, last(range(1, x)) AS l, x IN [1, 2, 3] AS isin",
        "SELECT x, len(sq) AS n, coalesce(list_sum(sq), 0)::BIGINT AS total, true AS every, list_contains(sq, 16) AS some, 1::BIGINT AS h, x AS l, x IN (1, 2, 3) AS isin FROM (SELECT x, [y * y FOR y IN range(1, x + 1) IF y % 2 = 0] AS sq FROM range(1, 21) t(x))"),
    "temporal": ("MATCH (o:Order) RETURN o.o_orderdate.year AS y, o.o_orderdate.month AS m, count(*) AS n", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY y, m"),
    "null_logic": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WITH c, count(o) AS n, max(o.o_totalprice) AS hi WHERE hi IS NULL OR n > 15 RETURN c.c_custkey AS k, n, coalesce(hi, -1.0) AS hi",
        "SELECT c_custkey AS k, count(o_orderkey) AS n, coalesce(max(o_totalprice), -1.0::DOUBLE) AS hi FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY k HAVING max(o_totalprice) IS NULL OR count(o_orderkey) > 15"),
    "var_length_all": ("MATCH (c:Customer)-[:LIVES_IN|IN_REGION*1..2]->(x) RETURN c.c_custkey AS k, count(*) AS reached",
        "SELECT c_custkey AS k, count(n_nationkey) + count(r_regionkey) AS reached FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY k"),
    "named_path": ("MATCH p = (s:Supplier)-[:BASED_IN]->(n)-[:IN_REGION]->(r:Region) RETURN s.s_suppkey AS k, length(p) AS hops, r.r_name AS r",
        "SELECT s_suppkey AS k, 2::BIGINT AS hops, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "shortest_path": ("MATCH (a:Supplier {s_suppkey: 1}), (b:Supplier) WHERE b.s_suppkey <> 1 MATCH p = shortestPath((a)-[:BASED_IN|IN_REGION*..6]-(b)) RETURN b.s_suppkey AS k, length(p) AS hops",
        "SELECT b.s_suppkey AS k, CASE WHEN a.s_nationkey = b.s_nationkey THEN 2::BIGINT ELSE 4 END AS hops FROM supplier a JOIN nation x ON x.n_nationkey = a.s_nationkey, supplier b JOIN nation y ON y.n_nationkey = b.s_nationkey WHERE a.s_suppkey = 1 AND b.s_suppkey <> 1 AND x.n_regionkey = y.n_regionkey"),
    "shortest_path_open": ("MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey MATCH p = shortestPath((a)-[:IN_REGION*]-(b)) RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(p) AS hops, size(nodes(p)) AS n, size(relationships(p)) AS r",
        "SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b, 2::BIGINT AS hops, 3::BIGINT AS n, 2::BIGINT AS r FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey"),
    "all_shortest_paths": ("MATCH (c:Customer), (p:Part {p_partkey: 7}) MATCH q = allShortestPaths((c)-[:PLACED|CONTAINS*..2]->(p)) RETURN c.c_custkey AS k, length(q) AS hops, count(*) AS n",
        "SELECT o_custkey AS k, 2::BIGINT AS hops, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey = 7 GROUP BY o_custkey"),
    "shortest_path_expression": ("MATCH (a:Supplier {s_suppkey: 1}), (b:Supplier) WHERE b.s_suppkey <> 1 RETURN b.s_suppkey AS k, coalesce(length(shortestPath((a)-[:BASED_IN|IN_REGION*..4]-(b))), -1) AS hops",
        "SELECT b.s_suppkey AS k, CASE WHEN a.s_nationkey = b.s_nationkey THEN 2 WHEN x.n_regionkey = y.n_regionkey THEN 4 ELSE -1 END::BIGINT AS hops FROM supplier a JOIN nation x ON x.n_nationkey = a.s_nationkey, supplier b JOIN nation y ON y.n_nationkey = b.s_nationkey WHERE a.s_suppkey = 1 AND b.s_suppkey <> 1"),
    "introspection": ("MATCH (n:Nation)-[r:IN_REGION]->() RETURN id(n) AS i, labels(n)[0] AS l, type(r) AS t, size(keys(n)) AS k",
        "SELECT n_nationkey + 2 * (1::BIGINT << 40) AS i, 'Nation' AS l, 'IN_REGION' AS t, 3::BIGINT AS k FROM nation"),
    "map_projection": ("MATCH (n:Nation) WITH n{.n_name, double: n.n_nationkey * 2} AS m RETURN m.n_name AS name, m.double AS d", "SELECT n_name AS name, n_nationkey * 2::BIGINT AS d FROM nation"),
    "full_scan": ("MATCH (n) RETURN labels(n)[0] AS l, count(*) AS n",
        "SELECT 'Region' AS l, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Vec', count(*) FROM embeddings"),
    "composite_scan": ("MATCH (o:Order {o_orderstatus: 'F', o_orderpriority: '1-URGENT'}) RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "return_star": ("MATCH (n:Nation) WITH n.n_name AS name, n.n_nationkey AS k // whatever is bound\n RETURN *, k + 1 AS next", "SELECT n_name AS name, n_nationkey::BIGINT AS k, n_nationkey + 1::BIGINT AS next FROM nation"),
    "default_names": ("MATCH (c:Customer) RETURN c.c_mktsegment, count(*), max(c.c_acctbal)", 'SELECT c_mktsegment AS "c.c_mktsegment", count(*) AS "count(*)", max(c_acctbal) AS "max(c.c_acctbal)" FROM customer GROUP BY c_mktsegment'),
    "call_in_transactions": ("MATCH (n:Nation) CALL { WITH n MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN max(s.s_acctbal) AS hi } IN TRANSACTIONS OF 10 ROWS RETURN n.n_name AS nation, hi",
        "SELECT n_name AS nation, max(s_acctbal) AS hi FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name"),
    "collect_distinct": ("MATCH (c:Customer) RETURN c.c_mktsegment AS s, size(collect(DISTINCT c.c_nationkey)) AS n, size(collect(c.c_nationkey)) AS m, reduce(t = 0, x IN collect(DISTINCT c.c_nationkey) | t + x) AS t",
        "SELECT c_mktsegment AS s, count(DISTINCT c_nationkey) AS n, count(*) AS m, sum(DISTINCT c_nationkey)::BIGINT AS t FROM customer GROUP BY s"),
    "distinct_aggregates": ("MATCH (p:Part) RETURN p.p_brand AS b, round(stDev(DISTINCT p.p_size), 6) AS sd, round(stDevP(DISTINCT p.p_size), 6) AS sp, percentileCont(DISTINCT p.p_size, 0.3) AS pc, percentileDisc(DISTINCT p.p_size, 0.7) AS pd, sum(DISTINCT p.p_size) AS s, round(avg(DISTINCT p.p_size), 6) AS a",
        "SELECT p_brand AS b, round(stddev_samp(DISTINCT p_size), 6) AS sd, round(stddev_pop(DISTINCT p_size), 6) AS sp, quantile_cont(DISTINCT p_size::DOUBLE, 0.3) AS pc, list_sort(list(DISTINCT p_size))[CAST(floor(0.7 * (count(DISTINCT p_size) - 1)) AS BIGINT) + 1]::BIGINT AS pd, sum(DISTINCT p_size)::BIGINT AS s, round(avg(DISTINCT p_size), 6) AS a FROM part GROUP BY b"),
    "wide_integers": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_custkey * 1000000007 AS x, 2147483647 + o.o_orderkey AS y, -2147483648 - o.o_custkey AS z", "SELECT o_orderkey AS k, o_custkey * 1000000007 AS x, 2147483647 + o_orderkey AS y, -2147483648 - o_custkey AS z FROM orders"),
    "dates": ("MATCH (o:Order) RETURN o.o_orderkey AS k, (o.o_orderdate + duration('P1M')).month AS m, (o.o_orderdate + duration('P1M')).day AS d, (o.o_orderdate - duration({days: 40})).year AS y, (o.o_orderdate - datetime('1995-01-01T00:00:00')).days AS gap",
        "WITH t AS (SELECT o_orderkey, o_orderdate, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)) AS n FROM orders) SELECT o_orderkey AS k, month(n) AS m, day(n) AS d, year(o_orderdate - INTERVAL 40 DAY) AS y, (epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01')) // 86400000 AS gap FROM t"),
    "dates_in_lists": ("MATCH (o:Order) WITH o.o_orderkey AS k, [d IN [o.o_orderdate, o.o_orderdate + duration('P1D')] | d.day] AS l RETURN k, l[0] AS a, l[1] AS b", "SELECT o_orderkey AS k, day(o_orderdate) AS a, day(o_orderdate + INTERVAL 1 DAY) AS b FROM orders"),
    "durations": ("UNWIND range(1, 70) AS x RETURN x, duration('P1M') < duration({days: x}) AS less, duration({months: 1, days: x}) >= duration('P2M') AS more, duration({days: x}) + duration('P1M') = duration({months: 1, days: x}) AS same",
        "SELECT x, 30 < x AS less, x >= 30 AS more, true AS same FROM range(1, 71) t(x)"),
    "duration_order": ("UNWIND ['P1M', 'P31D', 'P29D', 'PT5H', 'P1Y', 'P364D'] AS s WITH s, duration(s) AS d ORDER BY d DESC LIMIT 3 RETURN s", "SELECT unnest(['P364D', 'P1Y', 'P31D']) AS s"),
    "comparison_chains": ("MATCH (c:Customer) RETURN c.c_custkey AS k, 0 < c.c_nationkey < 3 AS a, c.c_nationkey > 5 > 1 AS b, c.c_nationkey = 3 = true AS c, c.c_mktsegment < c.c_custkey AS d, c.c_mktsegment <> 1 AS e",
        "SELECT c_custkey AS k, c_nationkey IS NOT NULL AS a, false AS b, c_nationkey = 3 AS c, false AS d, true AS e FROM customer"),
    "boolean_logic": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size > 25 XOR p.p_brand = 'Brand#11' AS x, NOT (p.p_size < 10 OR p.p_size > 40) AS y, p.p_brand =~ '.*1' AS z", "SELECT p_partkey AS k, (p_size > 25) <> (p_brand = 'Brand#11') AS x, p_size BETWEEN 10 AND 40 AS y, p_brand LIKE '%1' AS z FROM part"),
    "full_match": ("UNWIND ['ab', 'ab\\n', 'xab', 'abb'] AS s RETURN s, s =~ 'ab+' AS m", "SELECT s, m FROM (VALUES ('ab', true), ('ab' || chr(10), false), ('xab', false), ('abb', true)) t(s, m)"),
    "mixed_lists": ("MATCH (n:Nation) UNWIND [n.n_nationkey, n.n_name, n.n_nationkey > 4, 2.5, null] AS x RETURN n.n_name AS n, toString(x) AS s, coalesce(x = 3, false) AS three, x IN ['KENYA', 3] AS some",
        "SELECT n_name AS n, s, s = '3' AS three, s IN ('KENYA', '3') AS some FROM (SELECT n_name, unnest([n_nationkey::VARCHAR, n_name, (n_nationkey > 4)::VARCHAR, '2.5', 'null']) AS s FROM nation)"),
    "nested_lists": ("MATCH (n:Nation) WITH n.n_name AS n, [x IN [[1, 2], [n.n_nationkey], []] | size(x)] AS z, [x IN [n.n_name, 'b'] | x + '!'] AS s, [1, 2, 3, 4][1..3] AS mid, [1, 2, n.n_nationkey][-2..] AS last, tail([n.n_nationkey, 7]) AS t RETURN n, z[0] + z[1] * 10 + z[2] * 100 AS z, s[0] + s[1] AS s, size(mid) AS m, mid[0] * 10 + mid[1] AS mid, last[1] AS last, t[0] + size(t) AS t, [[1, 2], [3]][0][1] AS two, [1, 2][5] IS NULL AS past",
        "SELECT n_name AS n, 12::BIGINT AS z, n_name || '!b!' AS s, 2::BIGINT AS m, 23::BIGINT AS mid, n_nationkey::BIGINT AS last, 8::BIGINT AS t, 2::BIGINT AS two, true AS past FROM nation"),
    "folds": ("MATCH (n:Nation) RETURN n.n_name AS n, reduce(s = '', x IN split(n.n_name, '') | x + s) AS back, reduce(t = 0, x IN [1.5, n.n_nationkey] | t + x) AS total, none(x IN [1, n.n_nationkey] WHERE x > 20) AS none, single(x IN [1, 2, n.n_nationkey] WHERE x = 2) AS one",
        "SELECT n_name AS n, reverse(n_name) AS back, 1.5::DOUBLE + n_nationkey AS total, n_nationkey <= 20 AS none, n_nationkey <> 2 AS one FROM nation"),
    "maps": ("MATCH (n:Nation) WITH {name: n.n_name, k: n.n_nationkey} AS m, n RETURN m.name AS name, m.k + 1 AS k, m.absent IS NULL AS absent, size({a: 1}) IS NULL AS z, n{.n_name, up: toUpper(n.n_name), .nothing}.up AS u",
        "SELECT n_name AS name, n_nationkey + 1::BIGINT AS k, true AS absent, true AS z, upper(n_name) AS u FROM nation"),
    "path_functions": ("MATCH p = (s:Supplier)-[:BASED_IN]->(n)-[:IN_REGION]->(r:Region) RETURN s.s_suppkey AS k, size(nodes(p)) AS n, size(relationships(p)) AS m, relationships(p)[0].type AS t, nodes(p)[2] = id(r) AS ends",
        "SELECT s_suppkey AS k, 3::BIGINT AS n, 2::BIGINT AS m, 'BASED_IN' AS t, true AS ends FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "var_length_paths": ("MATCH p = (s:Supplier)-[:BASED_IN|IN_REGION*0..2]->(x) RETURN s.s_suppkey AS k, length(p) AS hops, labels(x)[0] AS l",
        "SELECT s_suppkey AS k, h::BIGINT AS hops, ['Supplier', 'Nation', 'Region'][h + 1] AS l FROM supplier, range(3) t(h)"),
    "conversions": ("MATCH (c:Customer) RETURN c.c_custkey AS k, toString(c.c_custkey) AS s, toInteger(c.c_acctbal) AS i, toInteger(1.0E10) AS big, toInteger(toString(c.c_custkey) + 'x') AS prefix, toFloat('2.5') + c.c_custkey AS f, toBoolean(c.c_nationkey) AS b, toBoolean('false') AS nope, toString(null) AS n",
        "SELECT c_custkey AS k, c_custkey::VARCHAR AS s, trunc(c_acctbal)::BIGINT AS i, 10000000000 AS big, c_custkey AS prefix, 2.5::DOUBLE + c_custkey AS f, c_nationkey <> 0 AS b, false AS nope, 'null' AS n FROM customer"),
    "more_strings": ("MATCH (n:Nation) RETURN n.n_name AS n, startsWith(n.n_name, 'A') AS a, endsWith(n.n_name, 'A') AS b, contains(n.n_name, 'AN') AS c, lTrim('  ' + n.n_name) AS l, rTrim(n.n_name + '  ') AS r, upper(n.n_name) AS u, lower(n.n_name) AS w, substring(n.n_name, -2) AS e, left(n.n_name, -1) IS NULL AS x, split(n.n_name, 'N')[1] AS p",
        "SELECT n_name AS n, n_name LIKE 'A%' AS a, n_name LIKE '%A' AS b, n_name LIKE '%AN%' AS c, n_name AS l, n_name AS r, upper(n_name) AS u, lower(n_name) AS w, right(n_name, 2) AS e, true AS x, string_split(n_name, 'N')[2] AS p FROM nation"),
    "logarithms": ("MATCH (p:Part) RETURN p.p_partkey AS k, round(log(p.p_size), 6) AS l, round(log10(p.p_size), 6) AS t, round(exp(p.p_size / 50), 6) AS e, pow(p.p_size, 2) AS q, p.p_size ^ 3 AS c, log(0) IS NULL AS none, sqrt(0 - p.p_size) IS NULL AS imaginary",
        "SELECT p_partkey AS k, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS t, round(exp(p_size / 50.0::DOUBLE), 6) AS e, pow(p_size, 2) AS q, pow(p_size, 3) AS c, true AS none, true AS imaginary FROM part"),
    "trigonometry": ("MATCH (p:Part) WITH p.p_partkey AS k, p.p_size / 50 AS x RETURN k, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(tan(x), 6) AS t, round(asin(x), 6) AS si, round(acos(x), 6) AS co, round(atan(x), 6) AS ta, round(atan2(x, 2), 6) AS t2, asin(2 + x) IS NULL AS none, round(pi() * e(), 6) AS pe, rand() < 1 AS r",
        "SELECT p_partkey AS k, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(tan(x), 6) AS t, round(asin(x), 6) AS si, round(acos(x), 6) AS co, round(atan(x), 6) AS ta, round(atan2(x, 2), 6) AS t2, true AS none, round(pi() * exp(1), 6) AS pe, true AS r FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part)"),
    "temporal_values": ("MATCH (n:Nation) RETURN n.n_name AS n, date('2024-02-' + toString(10 + n.n_nationkey % 10)).day AS d, date({year: 2024, month: 3, day: 1}).month AS m, datetime({year: 2024, month: 5, day: 6, hour: 7, minute: n.n_nationkey}).minute AS mi, duration('P1Y2M3W4DT5H').months AS mo, duration({weeks: 2, hours: 3}).days AS da, timestamp() > 1700000000000 AS now, size(randomUUID()) AS u",
        "SELECT n_name AS n, 10 + n_nationkey % 10::BIGINT AS d, 3::BIGINT AS m, n_nationkey::BIGINT AS mi, 14::BIGINT AS mo, 14::BIGINT AS da, true AS now, 36::BIGINT AS u FROM nation"),
}


def _cypher(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: GraphEngine(spark, tpch_graph(spark, d)).cypher(text)


def _on_graph(label: str, kind: str, call: str, weight: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = GraphEngine(spark, tpch_graph(spark, d))
        e.procedure("gds.graph.project", ["g", label, kind, *([weight] if weight else [])])
        return e.cypher(call)

    return run


def _vector(metric: str, train: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = GraphEngine(spark, tpch_graph(spark, d))
        e.cypher(f"CREATE VECTOR INDEX vec ON :Vec(embedding) OPTIONS {{dimension: 64, metric: '{metric}'}}")
        if train:
            e.procedure("db.index.vector.train", ["vec"])
        q = [1.0 if i % 2 == 0 else -0.5 for i in range(64)]
        return e.procedure("db.index.vector.queryNodes", ["vec", 10, q]).select((F.col("node") - F.lit(8 << 40)).alias("vec_id"), F.round("score", 6).alias("score"))

    return run


def _script(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """Statements one after another on one engine; the last gives the result."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e, out = GraphEngine(spark, tpch_graph(spark, d)), None
        for text in statements:
            out = e.cypher(text)
        return out

    return run


def _files(spark: SparkSession, e: GraphEngine) -> str:
    """A new folder beside the checkpoints, which every executor reads."""
    e.settle(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


def _load_csv(headers: bool) -> Callable[[SparkSession, str], DataFrame]:
    """Customers written as CSV and loaded again, by header names or as lists with another separator."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = GraphEngine(spark, tpch_graph(spark, d))
        path = _files(spark, e)
        rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat("c_mktsegment", F.lit(', "x"\ny')).alias("c_mktsegment"), "c_nationkey")
        rows.write.option("header", headers).option("sep", "," if headers else ";").option("escape", '"').option("quoteAll", True).csv(path)
        if headers:
            return e.cypher("LOAD CSV WITH HEADERS FROM $f AS r MATCH (n:Nation) WHERE n.n_nationkey = toInteger(r.c_nationkey) RETURN n.n_name AS n, count(*) AS c, max(toInteger(r.c_custkey)) AS k, max(size(r.c_mktsegment)) AS z", f=path)
        return e.cypher("LOAD CSV FROM $f AS r FIELDTERMINATOR ';' RETURN toInteger(r[0]) AS k, r[1] AS s", f=path)

    return run


def _import(kind: str, lenient: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """Suppliers and nations exported as bulk files, imported again and queried."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = _files(spark, GraphEngine(spark))
        read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
        sup, nat = read("supplier"), read("nation")
        sid, nid = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
        to = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
        if kind == "csv":
            bal = F.when(F.col("s_suppkey") % 2 == 0, F.lit("many")).otherwise(F.col("s_acctbal").cast("string")) if lenient else F.col("s_acctbal")
            sup.select(sid.alias(":ID"), F.lit("S;Firm").alias(":LABEL"), F.col("s_suppkey").alias("k:INT"), bal.alias("bal:FLOAT"), F.concat_ws("|", F.lit("1"), F.col("s_suppkey").cast("string")).alias("xs:INT[]")).write.option("header", True).csv(f"{path}/s")
            nat.select(nid.alias(":ID"), F.lit("N").alias(":LABEL"), F.col("n_name").alias("name")).write.option("header", True).csv(f"{path}/n")
            sup.select(sid.alias(":START_ID"), F.when(F.lit(not lenient) | (F.col("s_suppkey") % 3 > 0), to).alias(":END_ID"), F.lit("IN").alias(":TYPE"), F.col("s_suppkey").alias("w:INT")).write.option("header", True).csv(f"{path}/r")
        else:
            sup.select(sid.alias("id"), F.array(F.lit("S"), F.lit("Firm")).alias("labels"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.array(F.lit(1), "s_suppkey").alias("xs")).write.json(f"{path}/s")
            nat.select(nid.alias("id"), F.array(F.lit("N")).alias("labels"), F.col("n_name").alias("name")).write.json(f"{path}/n")
            sup.select(sid.alias("start"), to.alias("end"), F.lit("IN").alias("type"), F.col("s_suppkey").alias("w")).write.json(f"{path}/r")
        g = import_graph(spark, [f"{path}/s", f"{path}/n"], [f"{path}/r"], kind, "|", lenient)
        return GraphEngine(spark, g).cypher("MATCH (s:Firm:S)-[r:IN]->(n:N) RETURN n.name AS n, count(*) AS c, sum(r.w) AS w, sum(s.xs[1]) AS x, round(sum(s.bal), 2) AS bal")

    return run


def _native(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first search from a nation over where customers and suppliers are."""
    g = tpch_graph(spark, d)
    own = PropertyGraph(spark)
    for label in ("Region", "Nation", "Customer", "Supplier"):
        own = own.with_nodes((label,), g.nodes[(label,)])
    for kind in ("IN_REGION", "LIVES_IN", "BASED_IN"):
        own = own.with_rels(kind, g.rels[kind].df, g.rels[kind].ends)
    return GraphEngine(spark, own).bfs((2 << 40)).select("nodeId", F.col("depth").cast("long").alias("depth"), F.size("path").cast("long").alias("n"))


def _first_part(spark: SparkSession, d: str) -> tuple[int, int]:
    """Node ids of the first customer with orders, and of the least part that these contain."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    c = read("orders").join(read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.min("l_partkey").alias("p")).orderBy("o_custkey").head()
    return (3 << 40) + c["o_custkey"], (5 << 40) + c["p"]


def _dijkstra(spark: SparkSession, d: str) -> DataFrame:
    s, t = _first_part(spark, d)
    e = GraphEngine(spark, tpch_graph(spark, d))
    e.procedure("gds.graph.project", ["g", "", "", "l_quantity"])
    return e.cypher(f"CALL gds.shortestPath.dijkstra.stream('g', {s}, {t}) YIELD nodeId, node, cost, totalCost RETURN nodeId, node.labels[0] AS l, cost, totalCost")


def _all_paths(spark: SparkSession, d: str) -> DataFrame:
    s, t = _first_part(spark, d)
    return GraphEngine(spark, tpch_graph(spark, d)).find_all_paths(s, t, 2).select(F.array_join("path", " ").alias("path"), "length")


def _shortest(native: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = GraphEngine(spark, tpch_graph(spark, d))
        other = e.scalar("MATCH (a:Nation {n_nationkey: 0})-[:IN_REGION]->(r)<-[:IN_REGION]-(b:Nation) WHERE b.n_nationkey > 0 RETURN min(id(b)) AS b")
        if native:
            return e.get_shortest_path(2 << 40, other).select("nodeId", F.col("depth").cast("long").alias("depth"), F.array_join("path", " ").alias("path"))
        return e.cypher(f"CALL algo.shortestPath({2 << 40}, {other}) YIELD step, node, path_length RETURN step, node, path_length")

    return run


def _with_extensions(spark: SparkSession, d: str) -> DataFrame:
    """A function and a procedure of the user's."""
    e = GraphEngine(spark, tpch_graph(spark, d))
    e.register_function("initials", 1, 2, lambda s, n=None: F.left(s, F.lit(1) if n is None else n.cast("int")))
    e.register_procedure("my.regions", lambda least: spark.read.parquet(f"{d}/region.parquet").filter(F.col("r_regionkey") >= least).select(F.col("r_regionkey").cast("long").alias("k"), "r_name"))
    return e.cypher("CALL my.regions(1) YIELD k, r_name AS name RETURN k, initials(name) AS one, initials(name, 3) AS three")


def _api(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and relationships made and read by methods of the engine."""
    e = GraphEngine(spark)
    names = [r["r_name"] for r in spark.read.parquet(f"{d}/region.parquet").orderBy("r_regionkey").collect()]
    hub = e.create_node("Hub", name="hub")
    made = e.create_nodes(["Spoke", "Named"], [{"name": n, "at": i} for i, n in enumerate(names)]).collect()
    e.create_edges("TO", [(hub, r["id"], {"w": r["at"] * 2}) for r in made])
    e.create_edge(made[0]["id"], hub, "BACK")
    assert e.scalar("MATCH (n) RETURN count(n) AS n") == len(names) + 1 == e.single("MATCH (n) RETURN count(n) AS n")["n"] and len(e.fetchall("MATCH (n:Spoke) RETURN n.name AS n")) == len(e.to_df("MATCH (n:Named) RETURN n.at AS a"))
    e.begin()
    e.cypher("MATCH (n:Hub) DETACH DELETE n")
    e.rollback()
    return e.builder().match("(h:Hub)-[r:TO]->(s:Spoke)").where("r.w < $most", most=100).returns("s.name AS name", "r.w AS w").order_by("w DESC").run()


PROFILED = "PROFILE MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_name AS n, count(*) AS c"

#: name -> (statements, SQL of the last one's result)
WRITES: dict[str, tuple[list[str], str]] = {
    "create_node": (["MATCH (c:Customer) WHERE c.c_acctbal > 5000 CREATE (:Account {k: c.c_custkey, bal: c.c_acctbal * 2, s: c.c_mktsegment})", "MATCH (a:Account) RETURN a.k AS k, a.bal AS bal, a.s AS s"],
        "SELECT c_custkey AS k, c_acctbal * 2 AS bal, c_mktsegment AS s FROM customer WHERE c_acctbal > 5000"),
    "create_edge": (["MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > 5000 CREATE (s)-[:NEAR {gap: c.c_acctbal - s.s_acctbal}]->(c)", "MATCH (s:Supplier)-[r:NEAR]->(c:Customer) RETURN s.s_suppkey AS s, count(*) AS n, round(sum(r.gap), 2) AS gap, count(DISTINCT id(r)) AS ids"],
        "SELECT s_suppkey AS s, count(*) AS n, round(sum(c_acctbal - s_acctbal), 2) AS gap, count(*) AS ids FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal > 5000 GROUP BY s_suppkey"),
    "merge_node": (["CREATE (:Segment {name: 'BUILDING', old: true})", "MATCH (c:Customer) MERGE (s:Segment {name: c.c_mktsegment}) ON CREATE SET s.made = 1 ON MATCH SET s.seen = 2", "MATCH (s:Segment) RETURN s.name AS name, coalesce(s.old, false) AS old, coalesce(s.made, 0) AS made, coalesce(s.seen, 0) AS seen"],
        "SELECT DISTINCT c_mktsegment AS name, c_mktsegment = 'BUILDING' AS old, CASE WHEN c_mktsegment <> 'BUILDING' THEN 1::BIGINT ELSE 0 END AS made, CASE WHEN c_mktsegment = 'BUILDING' THEN 2::BIGINT ELSE 0 END AS seen FROM customer"),
    "merge_edge": (["MATCH (s:Supplier {s_suppkey: 1})-[:BASED_IN]->(n:Nation) CREATE (s)-[:SEATED]->(n)", "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) MERGE (s)-[r:SEATED]->(n) ON CREATE SET r.made = 1 ON MATCH SET r.seen = 1", "MATCH (s:Supplier)-[r:SEATED]->(n:Nation) RETURN s.s_suppkey AS k, n.n_name AS n, coalesce(r.made, 0) AS made, coalesce(r.seen, 0) AS seen"],
        "SELECT s_suppkey AS k, n_name AS n, CASE WHEN s_suppkey <> 1 THEN 1::BIGINT ELSE 0 END AS made, CASE WHEN s_suppkey = 1 THEN 1::BIGINT ELSE 0 END AS seen FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "set_properties": (["MATCH (c:Customer) WHERE c.c_acctbal < 0 SET c.debt = c.c_acctbal, c.c_acctbal = 0.0", "MATCH (c:Customer) WHERE c.c_nationkey = 3 SET c += {vip: true, c_name: 'x'}", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_acctbal AS bal, coalesce(c.vip, false) AS vip, coalesce(c.debt, 1.0) AS debt, c.c_name AS n"],
        "SELECT c_custkey AS k, greatest(c_acctbal, 0.0) AS bal, c_nationkey = 3 AS vip, CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE 1.0::DOUBLE END AS debt, CASE WHEN c_nationkey = 3 THEN 'x' ELSE c_name END AS n FROM customer"),
    "set_label": (["MATCH (c:Customer) WHERE c.c_acctbal > 8000 SET c:Rich", "MATCH (r:Customer:Rich)-[:LIVES_IN]->(n:Nation) RETURN n.n_name AS n, count(*) AS c, size(labels(r)) AS l"],
        "SELECT n_name AS n, count(*) AS c, 2::BIGINT AS l FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 8000 GROUP BY n_name".replace("GROUP BY n_name", "GROUP BY ALL")),
    "set_relationship": (["MATCH (s:Supplier)-[r:SUPPLIES]->(p:Part) WHERE r.n > 1 SET r.often = r.n * 10", "MATCH (:Supplier)-[r:SUPPLIES]->(p:Part) RETURN p.p_partkey AS k, count(*) AS n, coalesce(sum(r.often), 0) AS often"],
        "SELECT l_partkey AS k, count(*) AS n, coalesce(sum(CASE WHEN n > 1 THEN n * 10 END), 0)::BIGINT AS often FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_partkey"),
    "remove": (["MATCH (c:Customer) WHERE c.c_nationkey < 5 SET c:Near", "MATCH (c:Near) WHERE c.c_acctbal < 0 REMOVE c:Near, c.c_mktsegment", "MATCH (c:Customer) RETURN 'Near' IN labels(c) AS near, c.c_mktsegment IS NULL AS gone, count(*) AS n"],
        "SELECT c_nationkey < 5 AND c_acctbal >= 0 AS near, c_nationkey < 5 AND c_acctbal < 0 AS gone, count(*) AS n FROM customer GROUP BY ALL"),
    "delete_relationships": (["MATCH (s:Supplier)-[r:SUPPLIES]->(p:Part) WHERE p.p_size < 25 DELETE r", "MATCH (s:Supplier)-[r:SUPPLIES]->() RETURN s.s_suppkey AS k, count(r) AS n"],
        "SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 25 GROUP BY l_suppkey"),
    "detach_delete": (["MATCH (s:Supplier) WHERE s.s_acctbal < 2000 DETACH DELETE s", "MATCH (s:Supplier) OPTIONAL MATCH (s)-[:BASED_IN]->(n:Nation) OPTIONAL MATCH (s)-[r:SUPPLIES]->(:Part) RETURN s.s_suppkey AS k, n.n_name AS n, count(r) AS parts"],
        "SELECT s_suppkey AS k, n_name AS n, count(DISTINCT l_partkey) AS parts FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_acctbal >= 2000 GROUP BY ALL"),
    "delete_one_of_twins": (["MATCH (n:Nation) CREATE (n)-[:TWIN {w: 1}]->(n), (n)-[:TWIN {w: 1}]->(n)", "MATCH (n:Nation {n_nationkey: 0})-[r:TWIN]->() WITH r LIMIT 1 DELETE r", "MATCH (n:Nation)-[r:TWIN]->() RETURN n.n_nationkey AS k, count(r) AS n"],
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey = 0 THEN 1::BIGINT ELSE 2 END AS n FROM nation"),
    "foreach": (["MATCH (n:Nation) WITH n, [x IN range(1, 3) WHERE x <= n.n_nationkey] AS xs FOREACH (x IN xs | CREATE (:Step {at: x, of: n.n_name}))", "MATCH (s:Step) RETURN s.of AS n, count(*) AS c, sum(s.at) AS t"],
        "SELECT n_name AS n, least(3, n_nationkey)::BIGINT AS c, (least(3, n_nationkey) * (least(3, n_nationkey) + 1) / 2)::BIGINT AS t FROM nation WHERE n_nationkey > 0"),
    "rollback": (["BEGIN", "MATCH (n:Nation) DETACH DELETE n", "ROLLBACK", "BEGIN TRANSACTION", "MATCH (n:Nation) WHERE n.n_nationkey > 9 SET n.big = true", "COMMIT", "MATCH (n:Nation) RETURN coalesce(n.big, false) AS big, count(*) AS n"],
        "SELECT n_nationkey > 9 AS big, count(*) AS n FROM nation GROUP BY big"),
    "indexes": (["CREATE INDEX bal FOR (c:Customer) ON (c.c_acctbal)", "CREATE INDEX two FOR (o:Order) ON (o.o_orderstatus, o.o_custkey)", "CREATE INDEX ON :Part(p_size)", "CREATE VECTOR INDEX vec ON :Vec(embedding) OPTIONS {dim: 64, metric: 'L2'}", "CALL dbms.createLabelIndex('lab')", "DROP INDEX ON :Part(p_size)", "SHOW INDEXES"],
        "SELECT name, type, label, properties FROM (VALUES ('bal', 'property', 'Customer', 'c_acctbal'), ('two', 'composite', 'Order', 'o_orderstatus,o_custkey'), ('vec', 'vector', 'Vec', 'embedding'), ('lab', 'label', '', '')) t(name, type, label, properties)"),
    "dropped_indexes": (["CREATE INDEX bal FOR (c:Customer) ON (c.c_acctbal)", "DROP INDEX bal", "CALL dbms.createLabelIndex('lab')", "CALL dbms.dropLabelIndex('lab')", "SHOW INDEXES"], "SELECT '' AS name, '' AS type, '' AS label, '' AS properties WHERE false"),
    "constraints": (["CREATE CONSTRAINT a FOR (c:Customer) REQUIRE c.c_custkey IS UNIQUE", "CREATE CONSTRAINT b FOR (o:Order) REQUIRE o.o_orderdate IS NOT NULL", "CREATE CONSTRAINT c FOR (p:Part) REQUIRE p.p_size IS :: INTEGER", "CREATE CONSTRAINT d FOR (n:Nation) REQUIRE (n.n_nationkey, n.n_name) IS NODE KEY", "CREATE CONSTRAINT e FOR ()-[r:SUPPLIES]-() REQUIRE r.n IS NOT NULL", "CREATE CONSTRAINT f FOR (p:Part) REQUIRE p.p_name IS :: STRING", "DROP CONSTRAINT f", "DROP CONSTRAINT g IF EXISTS", "SHOW CONSTRAINTS"],
        "SELECT name, type, entity, label, properties FROM (VALUES ('a', 'unique', 'node', 'Customer', 'c_custkey'), ('b', 'not null', 'node', 'Order', 'o_orderdate'), ('c', 'type INTEGER', 'node', 'Part', 'p_size'), ('d', 'key', 'node', 'Nation', 'n_nationkey,n_name'), ('e', 'not null', 'relationship', 'SUPPLIES', 'n')) t(name, type, entity, label, properties)"),
    "explain": (["EXPLAIN MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE c.c_acctbal > 0 RETURN n.n_name AS n, count(*) AS c ORDER BY c DESC SKIP 1 LIMIT 5", "EXPLAIN MATCH (c:Customer) WHERE c.c_acctbal > 0 CREATE (:Copy {k: c.c_custkey})"],
        "SELECT operator, details FROM (VALUES ('NodeScan', '(c:Customer)'), ('Filter', 'c'), ('CreateNode', '(:Copy k)')) t(operator, details)"),
    "config": (["CALL dbms.setConfig('query.max_hops', 1)", "MATCH (c:Customer)-[:LIVES_IN|IN_REGION*1..2]->(x) RETURN labels(x)[0] AS l, count(*) AS n"], "SELECT 'Nation' AS l, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "config_values": (["CALL dbms.setConfig('own.key', 'v')", "CALL dbms.listConfig() YIELD key, value RETURN key, value"], "SELECT key, value FROM (VALUES ('own.key', 'v'), ('plan_cache.size', '128'), ('query.max_hops', '50')) t(key, value)"),
    "config_value": (["CALL dbms.getConfig('query.max_hops') YIELD key, value RETURN key, value"], "SELECT 'query.max_hops' AS key, '50' AS value"),
    "stats": (["MATCH (n:Nation) RETURN count(n) AS n", "CALL dbms.resetStats()", "MATCH (n:Nation) RETURN count(n) AS n", "MATCH (n:Nation) RETURN count(n) AS n", "CALL dbms.showStats() YIELD category, metric, value RETURN category, metric, value"],
        "SELECT category, metric, value FROM (VALUES ('engine', 'queries', '3'), ('engine', 'writes', '0'), ('engine', 'cache_hits', '2')) t(category, metric, value)"),
    "vector_train": (["CREATE VECTOR INDEX vec ON :Nothing(v) OPTIONS {dimension: 2, metric: 'L2'}", "CALL db.index.vector.train('vec') YIELD status RETURN status"], "SELECT 'Skipped (Empty Data)' AS status"),
    "vector_trained": (["CREATE VECTOR INDEX vec ON :Vec(embedding) OPTIONS {dimension: 64, metric: 'L2'}", "CALL db.index.vector.train('vec') YIELD status RETURN status"], "SELECT 'Success' AS status"),
    "drop_projection": (["CALL gds.graph.project('g', 'Supplier', 'BASED_IN')", "CALL gds.graph.drop('g') YIELD name RETURN name"], "SELECT 'g' AS name"),
    "projection": (["CALL gds.graph.project('g', '', 'PLACED') YIELD name, nodeCount, edgeCount RETURN name, nodeCount, edgeCount"],
        "SELECT 'g' AS name, (SELECT sum(n) FROM (SELECT count(*) AS n FROM region UNION ALL SELECT count(*) FROM nation UNION ALL SELECT count(*) FROM customer UNION ALL SELECT count(*) FROM supplier UNION ALL SELECT count(*) FROM part UNION ALL SELECT count(*) FROM orders UNION ALL SELECT count(*) FROM events UNION ALL SELECT count(*) FROM embeddings))::BIGINT AS nodeCount, (SELECT count(*) FROM orders) AS edgeCount"),
    "load_rows": (["UNWIND [{k: 1, name: 'a'}, {k: 2}, {k: 3, name: 'c', extra: 1.5}] AS row CREATE (:Row {k: row.k, name: row.name, extra: row.extra})", "MATCH (r:Row), (n:Region) WHERE n.r_regionkey = r.k RETURN r.k AS k, coalesce(r.name, '') AS name, coalesce(r.extra, 0.0) AS extra, n.r_name AS region"],
        "SELECT k, name, extra, r_name AS region FROM (VALUES (1::BIGINT, 'a', 0.0::DOUBLE), (2, '', 0.0), (3, 'c', 1.5)) t(k, name, extra) JOIN region ON r_regionkey = k"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"g_{k}": _cypher(q) for k, (q, _) in READS.items()} | {f"g_{k}": _script(*q) for k, (q, _) in WRITES.items()}
    # Edges whose number follows the tables; label '' projects both of their ends.
    out["g_closeness_based_in"] = _on_graph("", "BASED_IN", "CALL gds.closeness.stream('g') YIELD nodeId, score RETURN nodeId, round(score, 6) AS score")
    out["g_betweenness_based_in"] = _on_graph("", "BASED_IN", "CALL gds.betweenness.stream('g') YIELD nodeId, score RETURN nodeId, round(score, 6) AS score")
    out["g_wcc_placed"] = _on_graph("", "PLACED", "CALL gds.wcc.stream('g') YIELD nodeId, componentId RETURN nodeId, componentId AS c")
    out["g_pagerank_placed"] = _on_graph("", "PLACED", "CALL gds.pageRank.stream('g') YIELD nodeId, score RETURN nodeId, score")
    out["g_pagerank_settled"] = _on_graph("", "PLACED", "CALL gds.pageRank.stream('g', 100) YIELD nodeId, score RETURN nodeId, round(score * 1000000, 1) AS score")
    out |= {"g_dijkstra": _dijkstra, "g_find_all_paths": _all_paths, "g_algo_shortest_path": _shortest(False), "g_get_shortest_path": _shortest(True), "g_bfs": _native}
    out |= {"g_vector_topk": _vector("IP"), "g_vector_l2": _vector("L2"), "g_vector_cosine": _vector("Cosine")}
    out |= {f"g_vector_quantized_{m.lower()}": _vector(m, True) for m in ("IP", "L2", "Cosine")}
    out |= {"g_load_csv": _load_csv(True), "g_load_csv_lists": _load_csv(False), "g_import_csv": _import("csv"), "g_import_jsonl": _import("jsonl"), "g_import_lenient": _import("csv", True)}
    out |= {"g_extensions": _with_extensions, "g_api": _api}
    out["g_profile"] = lambda spark, d: _script(PROFILED)(spark, d).select("phase", (F.col("total_time_ms") >= 0).alias("timed"), F.col("calls").cast("long").alias("calls"))
    return out


def oracle_sql() -> dict[str, str]:
    out = {f"g_{k}": s for k, (_, s) in (READS | WRITES).items()}
    ids = " UNION ALL ".join(f"SELECT {k} + {i + 1} * (1::BIGINT << 40) AS id FROM {t}" for i, (t, k) in enumerate(LABELS.values()))
    star = "SELECT s_suppkey + 4 * (1::BIGINT << 40) AS id, count(*) OVER (PARTITION BY s_nationkey) AS k, false AS hub FROM supplier UNION ALL SELECT s_nationkey + 2 * (1::BIGINT << 40), count(*), true FROM supplier GROUP BY s_nationkey"
    out["g_closeness_based_in"] = f"SELECT id AS nodeId, round(coalesce(CASE WHEN hub THEN 1.0::DOUBLE ELSE k / (2 * k - 1.0::DOUBLE) END, 0.0), 6) AS score FROM ({ids}) LEFT JOIN ({star}) USING (id)"
    out["g_betweenness_based_in"] = f"SELECT id AS nodeId, round(coalesce(CASE WHEN hub THEN k * (k - 1) / 2.0::DOUBLE ELSE 0.0 END, 0.0), 6) AS score FROM ({ids}) LEFT JOIN ({star}) USING (id)"
    out["g_wcc_placed"] = f"SELECT id AS nodeId, coalesce(c, id) AS c FROM ({ids}) LEFT JOIN (SELECT o_orderkey + 6 * (1::BIGINT << 40) AS id, o_custkey + 3 * (1::BIGINT << 40) AS c FROM orders) USING (id)"
    # Customers have no in-edges and orders no out-edges, so ranks have a closed form.
    out["g_pagerank_settled"] = (
        f"WITH v AS ({ids}), deg AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey), base AS (SELECT 1.0::DOUBLE / ((SELECT count(*) FROM v) + 0.85::DOUBLE * (SELECT count(*) FROM deg)) AS b) "
        "SELECT id AS nodeId, round(b * (1 + 0.85::DOUBLE * coalesce(1.0::DOUBLE / k, 0.0::DOUBLE)) * 1000000, 1) AS score FROM v, base LEFT JOIN (SELECT o_orderkey + 6 * (1::BIGINT << 40) AS id, k FROM orders JOIN deg USING (o_custkey)) USING (id)").replace("FROM v, base LEFT JOIN", "FROM base CROSS JOIN v LEFT JOIN")
    ends = "pick AS (SELECT o_custkey AS c, min(l_partkey) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey ORDER BY c LIMIT 1), via AS (SELECT o_orderkey AS o, min(l_quantity) AS q FROM pick, orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c AND l_partkey = p GROUP BY o_orderkey)"
    best = "best AS (SELECT o, q FROM via ORDER BY q, o LIMIT 1)"
    out["g_dijkstra"] = (
        f"WITH {ends}, {best} SELECT c + 3 * (1::BIGINT << 40) AS nodeId, 'Customer' AS l, 0.0::DOUBLE AS cost, q + 1.0::DOUBLE AS totalCost FROM pick, best "
        "UNION ALL SELECT o + 6 * (1::BIGINT << 40), 'Order', 1.0::DOUBLE, q + 1.0::DOUBLE FROM best UNION ALL SELECT p + 5 * (1::BIGINT << 40), 'Part', q + 1.0::DOUBLE, q + 1.0::DOUBLE FROM pick, best")
    out["g_find_all_paths"] = f"WITH {ends} SELECT concat_ws(' ', c + 3 * (1::BIGINT << 40), o + 6 * (1::BIGINT << 40), p + 5 * (1::BIGINT << 40)) AS path, 2::BIGINT AS length FROM pick, via"
    other = "other AS (SELECT min(b.n_nationkey) AS b, any_value(a.n_regionkey) AS r FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey = 0 AND b.n_nationkey > 0)"
    way = "[2 * (1::BIGINT << 40), r + (1::BIGINT << 40), b + 2 * (1::BIGINT << 40)]"
    out["g_algo_shortest_path"] = f"WITH {other} SELECT s::INTEGER AS step, {way}[s + 1] AS node, 3::BIGINT AS path_length FROM other, range(3) t(s)"
    out["g_get_shortest_path"] = f"WITH {other} SELECT b + 2 * (1::BIGINT << 40) AS nodeId, 2::BIGINT AS depth, array_to_string({way}, ' ') AS path FROM other"
    out["g_bfs"] = (
        "WITH home AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey = 0 THEN 0 ELSE 2 END AS d, n_regionkey AS r FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0)) "
        "SELECT id AS nodeId, d::BIGINT AS depth, d + 1::BIGINT AS n FROM (SELECT n + 2 * (1::BIGINT << 40) AS id, d FROM home UNION ALL SELECT DISTINCT r + (1::BIGINT << 40), 1 FROM home "
        "UNION ALL SELECT c_custkey + 3 * (1::BIGINT << 40), d + 1 FROM customer JOIN home ON n = c_nationkey UNION ALL SELECT s_suppkey + 4 * (1::BIGINT << 40), d + 1 FROM supplier JOIN home ON n = s_nationkey)")
    v, q = "embedding::DOUBLE[]", "[CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -0.5 END FOR i IN range(64)]"
    for name, score in (("topk", f"-list_inner_product({v}, {q})"), ("l2", f"list_sum([power(x[1] - x[2], 2) FOR x IN list_zip({v}, {q})])".replace("x[1]", "struct_extract_at(x, 1)").replace("x[2]", "struct_extract_at(x, 2)")), ("cosine", f"1 - list_cosine_similarity({v}, {q})")):
        out[f"g_vector_{name}"] = f"SELECT vec_id, round({score}, 6) AS score FROM embeddings ORDER BY {score}, vec_id LIMIT 10"
    out["g_load_csv"] = "SELECT n_name AS n, count(*) AS c, max(c_custkey) AS k, max(length(c_mktsegment) + 7)::BIGINT AS z FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"
    out["g_load_csv_lists"] = "SELECT c_custkey AS k, c_mktsegment || ', \"x\"' || chr(10) || 'y' AS s FROM customer"
    imported = "SELECT n_name AS n, count(*) AS c, sum(s_suppkey)::BIGINT AS w, sum(s_suppkey)::BIGINT AS x, round({bal}, 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey {where} GROUP BY n_name"
    out["g_import_csv"] = out["g_import_jsonl"] = imported.format(bal="sum(s_acctbal)", where="")
    out["g_import_lenient"] = imported.format(bal="sum(CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END)", where="WHERE s_suppkey % 3 > 0")
    out["g_extensions"] = "SELECT r_regionkey::BIGINT AS k, left(r_name, 1) AS one, left(r_name, 3) AS three FROM region WHERE r_regionkey >= 1"
    out["g_api"] = "SELECT r_name AS name, (row_number() OVER (ORDER BY r_regionkey) - 1) * 2 AS w FROM region"
    out["g_profile"] = "SELECT phase, true AS timed, 1::BIGINT AS calls FROM (VALUES ('parse'), ('plan'), ('execute')) t(phase)"
    return out
