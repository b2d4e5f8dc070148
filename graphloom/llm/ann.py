"""Approximate nearest neighbours by cross-polytope hashing.

Vectors go through fast Hadamard pseudo-rotations (random signs, then the transform, three times) and fall into the
bucket of their nearest signed axis, in several tables. The index is cut into blocks, each with its own tables; queries
go to every block once and probe there the signed axes of all tables that are nearest to them. A row's probed axes add
up to an estimate of its nearness; rows whose estimate an unrelated row reaches with a small probability only are
candidates, ranked exactly, in double precision, inside the block. Every vector is indexed, equal vectors once.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stash

#: Tables for the root of the padded dimension, and share of all signed axes that a query probes.
TABLES_ROOT, PROBE_SHARE = 4.0, 0.15
#: Share of unrelated rows that become candidates among so many vectors; it falls with the root of their number.
CANDIDATES, AMONG = 0.08, 2000
#: Vectors and queries in one block.
BLOCK, QUERY_BLOCK = 8192, 4096


def signs(dim: int, table: int) -> np.ndarray:
    return np.random.default_rng([dim, table, 977]).choice(np.array([-1.0, 1.0]), (3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    for s in signs(x.shape[1], table):
        x = hadamard(x * s)
    return x


def _unit(x: np.ndarray, top: float, lift: bool, query: bool) -> np.ndarray:
    """Unit vectors padded to a power of two; unless all norms agree, one more coordinate makes indexed norms equal."""
    norm2 = (x * x).sum(1)
    if lift:
        x = np.c_[x, np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, top * top - norm2))]
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.c_[x, np.zeros((len(x), d - x.shape[1]))]
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def candidate_share(n: int) -> float:
    return min(0.5, CANDIDATES * (AMONG / max(n, 1)) ** 0.5)


class Tables:
    """Cross-polytope tables of one block: for each table the rows in the order of their signed axes."""

    def __init__(self, x: np.ndarray, top: float, lift: bool):
        self.n, self.top, self.lift = len(x), top, lift
        u = _unit(x, top, lift, False)
        self.axes = 2 * u.shape[1]
        self.tables = math.ceil(TABLES_ROOT * math.sqrt(u.shape[1]))
        rows, first, size = [], [], []
        for t in range(self.tables):
            y = rotate(u, t)
            axis = np.concatenate([y, -y], 1).argmax(1)
            rows.append(np.argsort(axis, kind="stable"))
            size.append(np.bincount(axis, minlength=self.axes))
            first.append(t * self.n + np.cumsum(size[-1]) - size[-1])
        self.rows, self.first, self.size = np.concatenate(rows), np.concatenate(first), np.concatenate(size)

    def candidates(self, q: np.ndarray, share: float, probe: float = PROBE_SHARE):
        """For each query the rows to be ranked: those whose probed axes add up to what a share of unrelated rows reach."""
        u = _unit(q, self.top, self.lift, True)
        z = np.stack([np.concatenate([y, -y], 1) for y in (rotate(u, t) for t in range(self.tables))], 1)
        m = max(1, round(probe * self.tables * self.axes))
        bar = NormalDist().inv_cdf(1 - share)
        for near in z:
            flat = near.ravel()
            cells = np.argpartition(-flat, m - 1)[:m]
            probed = np.zeros_like(flat)
            probed[cells] = flat[cells]
            mean = probed.reshape(near.shape).mean(1)
            spread = math.sqrt(max(0.0, float((probed**2).sum() / self.axes - (mean**2).sum())))
            size = self.size[cells]
            at = np.repeat(self.first[cells] - np.cumsum(size) + size, size) + np.arange(size.sum())
            got = np.bincount(self.rows[at], np.repeat(flat[cells], size), self.n)
            yield np.flatnonzero(got >= mean.sum() + bar * spread)


def _vectors(t: pa.Table) -> np.ndarray:
    flat = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(t.num_rows, -1)


def _best(k: int, spread: dict[int, tuple[float, bool]], total: dict[int, int], exact: bool):
    """The k best classes of a block for each query of a block: of its candidates or, if exact, of all."""
    names = ["k1", "k2", "c1", "c2", "first", "score"]

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in names}
        if index.num_rows and queries.num_rows:
            index = index.sort_by("first")
            x, q = _vectors(index), _vectors(queries)
            dim = x.shape[1]
            keys = {c: index.column(c).to_numpy() for c in ("k1", "k2", "first")}
            asked = {c: queries.column(c).to_numpy() for c in ("k1", "k2")}
            every = np.arange(len(x))
            rows = (every for _ in q) if exact else Tables(x, *spread[dim]).candidates(q, candidate_share(total[dim]))
            for i, near in enumerate(rows):
                score = np.einsum("rd,d->r", x[near], q[i])
                if len(near) > k:  # ties at the edge go to the smaller id
                    edge = np.partition(score, len(near) - k)[len(near) - k]
                    near, score = near[score >= edge], score[score >= edge]
                top = np.argsort(-score, kind="stable")[:k]
                near, score = near[top], score[top]
                for c in ("k1", "k2"):
                    out[c].append(np.full(len(near), asked[c][i]))
                for c, s in (("c1", "k1"), ("c2", "k2"), ("first", "first")):
                    out[c].append(keys[s][near])
                out["score"].append(score)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, float if c == "score" else np.int64) for c, v in out.items()})

    return run


def _search(index: DataFrame, queries: DataFrame, k: int, spread: dict, total: dict, asked: int, exact: bool) -> DataFrame:
    """The k best classes of each query in every block of the index. Blocks are dealt by the vectors' hashes, so they
    are of one size; a block travels once for each block of queries, a query once for each block."""
    blocks = F.lit(1)
    for dim, n in total.items():
        blocks = F.when(F.size("vec") == dim, F.lit(math.ceil(n / BLOCK))).otherwise(blocks)
    parts = max(1, math.ceil(asked / QUERY_BLOCK))
    a = index.select(F.size("vec").alias("dim"), F.pmod("k1", blocks).cast("int").alias("bi"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("bq"), "k1", "k2", "first", "vec")
    b = queries.select(F.size("vec").alias("dim"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("bi"), F.pmod("k2", F.lit(parts)).cast("int").alias("bq"), "k1", "k2", "first", "vec")
    names = ["dim", "bi", "bq", "k1", "k2", "first", "vec"]
    a, b = a.toDF(*names), b.toDF(*names)  # aliased anew: both may come from one table
    cell = names[:3]
    return a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInArrow(_best(k, spread, total, exact), "k1 long, k2 long, c1 long, c2 long, first long, score double")


def _merge(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.desc("score"), "first", "c1", "c2"))
    return found.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for every row that is_query admits.

    Rows with a null id, or a vector null, empty, zero or holding null or non-finite components, take no part. Only
    vectors of one dimension are compared. Rows equal in id and vector count once; a query's own id is no candidate of
    its. Ties go to the smaller id. A query whose probes find fewer than k candidates is searched against all rows, in
    blocks. Of equal vectors only the k + 1 smallest ids can be in an answer, so no more are carried. Empty tables
    give none.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    kind = "float" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "double"
    v = F.transform(F.col(vec_col), lambda x: x.cast(kind))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), is_query.alias("is_query")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda x: fine(x) & (x != 0)))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind))).withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    least = W.partitionBy("k1", "k2").orderBy("id")
    ids = rows.dropDuplicates(["id", "k1", "k2"]).withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k + 1)
    classes = stash(ids.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("first", F.col("ids")[0]))
    asked = rows.filter(F.coalesce("is_query", F.lit(False))).select("id", "k1", "k2").distinct()
    queries = stash(classes.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = classes.groupBy(F.size("vec").alias("d")).agg(F.max(norm).alias("hi"), F.min(norm).alias("lo"), F.count(F.lit(1)).alias("n")).collect()
    spread, total = {r["d"]: (r["hi"], r["hi"] - r["lo"] > 1e-3 * r["hi"]) for r in sizes}, {r["d"]: r["n"] for r in sizes}
    found = stash(_merge(_search(classes, queries, k + 1, spread, total, queries.count(), False), k + 1))
    short = queries.select("k1", "k2").join(found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), ["k1", "k2"], "left").filter(F.coalesce("n", F.lit(0)) <= k).select("k1", "k2")
    short = stash(queries.join(short, ["k1", "k2"], "left_semi"))
    n_short = short.count()
    if n_short:
        again = _merge(_search(classes, short, k + 1, spread, total, n_short, True), k + 1)
        found = found.join(short.select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(again)
    named = found.join(classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "ids"), ["c1", "c2"])
    each = named.select("k1", "k2", "score", F.explode("ids").alias("vec_id"))
    top = each.withColumn("r", F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    out = asked.withColumnRenamed("id", "query_id").join(top, ["k1", "k2"]).filter(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.pmod("vec_id", F.lit(20)) == 0)
