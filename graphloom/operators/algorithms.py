"""Graph algorithms as iterated joins and aggregates. Every round is settled (checkpointed), so lineage stays short."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Settle = Callable[[DataFrame], DataFrame]


def pagerank(vertices: DataFrame, edges: DataFrame, settle: Settle, rounds: int = 20, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(nodeId, score), summing to 1: power iteration, rank of nodes without out-edges spread over all. Parallel edges
    count each; rounds end early once scores move less than ``tolerance`` in sum. Both sums of a round are one query."""
    n = vertices.count()
    if not n:
        return vertices.select(F.col("id").alias("nodeId"), F.lit(0.0).alias("score"))
    share = settle(edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src").groupBy("src", "dst").agg((F.count(F.lit(1)) / F.first("out")).alias("w")))
    leads = share.select(F.col("src").alias("id"), F.lit(True).alias("leads")).distinct()
    rank = settle(vertices.select("id").join(leads, "id", "left").select("id", F.lit(1.0 / n).alias("r"), F.col("leads").isNull().alias("sink")))
    lost = rank.agg(F.sum(F.when(F.col("sink"), F.col("r")))).head()[0] or 0.0
    for _ in range(rounds):
        got = share.join(rank, share["src"] == rank["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("r")).alias("got"))
        new = rank.join(got, "id", "left").select("id", "sink", "r", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("new"))
        new = settle(new)
        moved, lost = new.agg(F.sum(F.abs(F.col("new") - F.col("r"))), F.coalesce(F.sum(F.when(F.col("sink"), F.col("new"))), F.lit(0.0))).head()
        rank = new.select("id", F.col("new").alias("r"), "sink")
        if moved < tolerance:
            break
    return rank.select(F.col("id").alias("nodeId"), F.col("r").alias("score"))


def connected(vertices: DataFrame, edges: DataFrame, settle: Settle) -> DataFrame:
    """(nodeId, componentId): the least id of the component, by label propagation with pointer jumping."""
    pairs = settle(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct())
    labels = settle(vertices.select("id", F.col("id").alias("c")))
    while True:
        near = pairs.join(labels, pairs["dst"] == labels["id"]).groupBy(F.col("src").alias("id")).agg(F.min("c").alias("near"))
        low = labels.join(near, "id", "left").select("id", "c", F.least("c", F.coalesce("near", "c")).alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("c").alias("up"))
        done = settle(low.join(up, "low").select("id", "c", F.least("low", "up").alias("new")))
        moved = not done.filter("new <> c").isEmpty()
        labels = done.select("id", F.col("new").alias("c"))
        if not moved:
            return labels.select(F.col("id").alias("nodeId"), F.col("c").alias("componentId"))


def distances(sources: DataFrame, pairs: DataFrame, settle: Settle) -> list[DataFrame]:
    """Levels of breadth-first searches from every source at once: (s, v, sigma) a level, sigma counting shortest paths.

    ``pairs`` (a, b, m): m parallel ways from a to b."""
    level = settle(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma")))
    levels, seen = [level], level.select("s", "v")
    while True:
        nxt = level.join(pairs, level["v"] == pairs["a"]).groupBy("s", F.col("b").alias("v")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        level = settle(nxt.join(seen, ["s", "v"], "left_anti"))
        if level.isEmpty():
            return levels
        levels.append(level)
        seen = settle(seen.unionByName(level.select("s", "v")))


def both_ways(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    return both.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("m"))


#: Rows that the searches of one batch of sources may hold together.
HELD = 1 << 28


def batches(sources: DataFrame, held: int, settle: Settle) -> list[DataFrame]:
    """The sources, whose searches hold ``held`` rows together, in batches of at most HELD."""
    parts = -(-held // HELD)
    if parts <= 1:
        return [sources.select("id")]
    sources = settle(sources.select("id", F.pmod(F.xxhash64(F.lit(43), "id"), F.lit(parts)).alias("part")))
    return [sources.filter(F.col("part") == p).select("id") for p in range(parts)]


def folded(pairs: DataFrame, settle: Settle) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Nodes of one neighbour folded into it, round by round: (rounds, rest, pairs between the rest).

    A round is (id, parent, w, down, squares), the rest (id, w, down, squares): w counts a node and what is folded into
    it, down sums the distances to these, squares sums the w squared of what was folded into the node itself. Of the
    rest only what lies on or between cycles has pairs. A node without an edge is in neither.
    """
    rest = settle(pairs.select(F.col("a").alias("id")).distinct().select("id", F.lit(1.0).alias("w"), F.lit(0.0).alias("down"), F.lit(0.0).alias("squares")))
    rounds: list[DataFrame] = []
    while True:
        ends = pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("parent"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("id", "parent")
        # Of two that have only each other the least stays.
        mutual = ends.select(F.col("parent").alias("id"), F.col("id").alias("parent")).filter("parent > id")
        leaves = settle(ends.join(mutual, ["id", "parent"], "left_anti").join(rest, "id"))
        if leaves.isEmpty():
            return rounds, rest, pairs
        rounds.append(leaves)
        gone = leaves.select("id")
        got = leaves.groupBy(F.col("parent").alias("id")).agg(F.sum("w").alias("gw"), F.sum(F.col("down") + F.col("w")).alias("gd"), F.sum(F.col("w") * F.col("w")).alias("gs"))
        add = lambda c, g: (F.col(c) + F.coalesce(g, F.lit(0.0))).alias(c)
        rest = settle(rest.join(gone, "id", "left_anti").join(got, "id", "left").select("id", add("w", "gw"), add("down", "gd"), add("squares", "gs")))
        pairs = settle(pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "m"))


def unfolded(rounds: list[DataFrame], rest: DataFrame, settle: Settle) -> DataFrame:
    """(id, w, squares, size, far) of all nodes with an edge, from the same columns of the rest: size counts a node's
    component, far sums its distances. From a parent to its leaf, w distances shrink by one and the others grow."""
    for leaves in reversed(rounds):
        parents = rest.select(F.col("id").alias("parent"), "size", F.col("far").alias("from"))
        new = leaves.join(parents, "parent").select("id", "w", "squares", "size", (F.col("from") + F.col("size") - 2 * F.col("w")).alias("far"))
        rest = settle(rest.unionByName(new))
    return rest


def core_batches(core: DataFrame, pairs: DataFrame, settle: Settle) -> list[DataFrame]:
    """All nodes of the core as sources, in batches: a search stays in its component."""
    n = core.count()
    if n * n <= HELD:
        return batches(core, n * n, settle)
    sizes = connected(core, pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), settle).groupBy("componentId").agg(F.count(F.lit(1)).alias("n"))
    return batches(core, int(sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).head()[0]), settle)


def sampled(vertices: DataFrame, pairs: DataFrame, samples: int, settle: Settle) -> list[DataFrame]:
    """``samples`` sources, by a seeded hash, in batches."""
    sources = vertices.orderBy(F.xxhash64(F.lit(42), "id")).limit(samples)
    return batches(sources, samples * pairs.select("a").distinct().count(), settle)


def dependencies(sources: DataFrame, pairs: DataFrame, weights: DataFrame, settle: Settle) -> tuple[DataFrame, DataFrame]:
    """(id, d) and (s, size): how much the shortest paths from the sources depend on a node, and what a source reaches;
    nodes count ``weights`` (id, w) times, as sources and as ends."""
    ends = weights.select(F.col("id").alias("v"), "w")
    levels = [settle(x.join(ends, "v")) for x in distances(sources, pairs, settle)]
    size = settle(_all(x.groupBy("s").agg(F.sum("w").alias("size")) for x in levels).groupBy("s").agg(F.sum("size").alias("size")))
    delta, out = None, []
    for far, near in zip(reversed(levels), reversed(levels[:-1]), strict=False):
        below = far.select("s", F.col("v").alias("x"), F.col("sigma").alias("sx"), F.col("w").alias("wx"))
        below = below.join(delta, ["s", "x"], "left") if delta is not None else below.withColumn("d", F.lit(0.0))
        step = near.select("s", "v", "sigma").join(pairs, F.col("v") == F.col("a")).withColumnRenamed("b", "x").join(below, ["s", "x"])
        step = settle(step.groupBy("s", "v").agg(F.sum(F.col("sigma") * F.col("m") / F.col("sx") * (F.col("wx") + F.coalesce("d", F.lit(0.0)))).alias("d")))
        delta = step.select("s", F.col("v").alias("x"), "d")
        out.append(step.filter("s <> v").join(weights.withColumnRenamed("id", "s"), "s").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("d") * F.col("w")).alias("d")))
    found = _all(out) if out else sources.select("id", F.lit(0.0).alias("d")).limit(0)
    return settle(found.groupBy("id").agg(F.sum("d").alias("d"))), size


def _all(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def betweenness(vertices: DataFrame, edges: DataFrame, settle: Settle, samples: int = 0) -> DataFrame:
    """(nodeId, score): Brandes over both directions, halved; reciprocal edges are two ways.

    Nodes of one neighbour are folded first: paths from and to what is folded into a node pass through it, which is
    counted, not searched. The core that is left is searched from every node, in batches, each weighing what is folded
    into it. With ``samples`` all is searched, from so many sources (by a seeded hash), and scaled up."""
    pairs = settle(both_ways(edges))
    if samples and samples < (n := vertices.count()):
        ones = vertices.select("id", F.lit(1.0).alias("w"))
        found = [dependencies(sources, pairs, ones, settle)[0] for sources in sampled(vertices, pairs, samples, settle)]
        scores = _all(found).groupBy("id").agg((F.sum("d") * (0.5 * n / samples)).alias("score"))
    else:
        rounds, rest, pairs = folded(pairs, settle)
        core = settle(rest.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi"))
        found = [dependencies(sources, pairs, core.select("id", "w"), settle) for sources in core_batches(core, pairs, settle)] if not core.isEmpty() else []
        rest = rest.select("id", "w", "squares", F.col("w").alias("size"), F.lit(0.0).alias("far"))
        if found:
            rest = rest.drop("size").join(_all(x for _, x in found).withColumnRenamed("s", "id"), "id", "left").withColumn("size", F.coalesce("size", "w"))
        below = F.col("w") - 1
        scores = unfolded(rounds, rest, settle).select("id", ((below * below - F.col("squares")) / 2 + below * (F.col("size") - F.col("w"))).alias("score"))
        if found:
            scores = scores.unionByName(_all(x for x, _ in found).select("id", (F.col("d") / 2).alias("score"))).groupBy("id").agg(F.sum("score").alias("score"))
    return vertices.join(scores, "id", "left").select(F.col("id").alias("nodeId"), F.coalesce("score", F.lit(0.0)).alias("score"))


def closeness(vertices: DataFrame, edges: DataFrame, settle: Settle, samples: int = 0) -> DataFrame:
    """(nodeId, score): reachable nodes over the sum of their distances, undirected; 0 for isolated nodes.

    Nodes of one neighbour are folded first, and get their sum from that neighbour's; the core that is left is searched
    from every node, in batches. With ``samples`` the searches start from so many nodes (by a seeded hash), and a
    node's score is estimated from its distances to those of them that reach it."""
    pairs = settle(both_ways(edges))
    if samples and samples < vertices.count():
        found = []
        for sources in sampled(vertices, pairs, samples, settle):
            levels = distances(sources, pairs, settle)[1:]
            found += [settle(_all(x.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(float(d))).alias("far")) for d, x in enumerate(levels, 1)))] if levels else []
        if not found:
            return vertices.select(F.col("id").alias("nodeId"), F.lit(0.0).alias("score"))
        scores = _all(found).groupBy("id").agg((F.sum("n") / F.sum("far")).alias("score"))
    else:
        rounds, rest, pairs = folded(pairs, settle)
        core = settle(rest.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi"))
        found = []
        for sources in core_batches(core, pairs, settle) if not core.isEmpty() else []:
            ends = core.select(F.col("id").alias("v"), "w", "down")
            levels = [x.join(ends, "v").groupBy("s").agg(F.sum("w").alias("size"), F.sum(F.col("w") * d + F.col("down")).alias("far")) for d, x in enumerate(distances(sources, pairs, settle))]
            found.append(settle(_all(levels).groupBy("s").agg(F.sum("size").alias("size"), F.sum("far").alias("far"))))
        if found:
            rest = rest.join(_all(found).withColumnRenamed("s", "id"), "id", "left").select("id", "w", "squares", F.coalesce("size", "w").alias("size"), F.coalesce("far", "down").alias("far"))
        else:
            rest = rest.select("id", "w", "squares", F.col("w").alias("size"), F.col("down").alias("far"))
        scores = unfolded(rounds, rest, settle).select("id", ((F.col("size") - 1) / F.col("far")).alias("score"))
    return vertices.join(scores, "id", "left").select(F.col("id").alias("nodeId"), F.coalesce("score", F.lit(0.0)).alias("score"))


def dijkstra(edges: DataFrame, source: int, target: int, settle: Settle) -> DataFrame:
    """(nodeId, cost, totalCost, step) along a cheapest directed path, by relaxing frontiers until nothing gets cheaper.
    What costs no less than a known way to the target goes no further. Ties go to the path of least nodes; no path
    gives no row."""
    spark = edges.sparkSession
    best = settle(spark.createDataFrame([(source, 0.0, [source], [0.0])], "v long, cost double, path array<bigint>, costs array<double>"))
    front, reached = best, best
    while source != target:
        step = front.join(edges, front["v"] == edges["src"]).select(F.col("dst").alias("v"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("dst")).alias("path"), F.concat("costs", F.array(F.col("cost") + F.col("weight"))).alias("costs"))
        step = step.groupBy("v").agg(F.min(F.struct("cost", "path", "costs")).alias("m")).select("v", "m.cost", "m.path", "m.costs")
        old = best.select("v", F.col("cost").alias("old"), F.col("path").alias("way"))
        front = settle(step.join(old, "v", "left").filter("old IS NULL OR cost < old OR cost = old AND path < way").drop("old", "way"))
        if front.isEmpty():
            break
        best = settle(best.unionByName(front).groupBy("v").agg(F.min(F.struct("cost", "path", "costs")).alias("m")).select("v", "m.cost", "m.path", "m.costs"))
        reached = best.filter(F.col("v") == target)
        bound = reached.agg(F.min("cost")).head()[0]
        front = front.filter((F.col("v") != target) & (F.lit(True) if bound is None else F.col("cost") <= bound))
    return best.filter(F.col("v") == target).select(F.posexplode(F.arrays_zip("path", "costs")).alias("step", "x"), F.col("cost").alias("totalCost")).select(
        F.col("x.path").alias("nodeId"), F.col("x.costs").alias("cost"), "totalCost", "step")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def bfs(edges: DataFrame, source: int, settle: Settle, max_depth: int | None = None, target: int | None = None) -> DataFrame:
    """(nodeId, depth, path): a shortest undirected path, of least nodes, to all that is within max_depth, if one is
    given. The search ends at the level where it meets ``target``."""
    ways = settle(undirected(edges))
    seen = settle(edges.sparkSession.createDataFrame([(source, 0, [source])], "nodeId long, depth int, path array<bigint>"))
    front, d = seen, 0
    while source != target and (max_depth is None or d < max_depth):
        d += 1
        nxt = front.join(ways, front["nodeId"] == ways["a"]).select(F.col("b").alias("nodeId"), F.concat("path", F.array("b")).alias("path"))
        nxt = nxt.join(seen.select("nodeId"), "nodeId", "left_anti").groupBy("nodeId").agg(F.min("path").alias("path"))
        front = settle(nxt.select("nodeId", F.lit(d).alias("depth"), "path"))
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front))
        if target is not None and not front.filter(F.col("nodeId") == target).isEmpty():
            break
    return seen


def all_paths(edges: DataFrame, source: int, target: int, settle: Settle, max_depth: int) -> DataFrame:
    """(path, length): every directed path of at most max_depth hops between two nodes that meets no node twice."""
    ways = settle(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    front = settle(edges.sparkSession.createDataFrame([(source, [source])], "at long, path array<bigint>"))
    found = front.filter(F.col("at") == target)
    front = front.filter(F.col("at") != target)
    for _ in range(max_depth):
        front = front.join(ways, front["at"] == ways["a"]).filter(~F.array_contains("path", F.col("b")))
        front = settle(front.select(F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path")))
        if front.isEmpty():
            break
        found = found.unionByName(front.filter(F.col("at") == target))
        front = front.filter(F.col("at") != target)
    return found.select("path", (F.size("path") - 1).cast("long").alias("length"))


def nearest(nodes: DataFrame, prop: str, query: list[float], k: int, metric: str) -> DataFrame:
    """(node, score): the k nearest nodes, exactly. Scores are distances: squared L2, minus the inner product, or 1 - cos."""
    v = F.transform(F.col(prop), lambda x: x.cast("double"))
    q = F.array(*(F.lit(float(x)) for x in query))
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(v, q, lambda x, y: x * y), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    score = {"L2": F.aggregate(F.zip_with(v, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), add), "IP": -dot, "COSINE": 1 - dot / (norm * size)}[metric.upper()]
    found = nodes.filter(F.col(prop).isNotNull() & (F.size(prop) == len(query)))
    return found.select(F.col("id").alias("node"), score.alias("score")).orderBy("score", "node").limit(k)
