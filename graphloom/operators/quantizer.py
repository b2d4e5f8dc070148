"""Product quantisation: vectors as one byte for each few dimensions, ranked by tables of distances to codewords.

A codebook is learned by k-means on a bounded sample, on the driver. Codes are made once, in Arrow batches, and written
beside the vectors in the order of ids. A search reads the column of codes, adds up table entries inside the JVM, and
ranks its shortlist exactly, reading vectors only from pages that hold one of its ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors that train a codebook, codewords of a part, dimensions of a part, rounds of k-means.
SAMPLE, CODEWORDS, WIDTH, ROUNDS = 5000, 256, 4, 25
#: Least shortlist of a search, and its least multiple of k.
SHORTLIST, PER_RESULT = 100, 20
#: Ids in one list of a filter: as many as Parquet readers are given one by one by default.
LISTED = 10


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """At most k centres of the rows of x; as many as there are distinct rows, if these are fewer.

    Starts are drawn in proportion to the squared distance from those drawn before. A centre that loses all its rows moves
    to the row that is furthest from its own.
    """
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        c = x[rng.choice(len(x), p=far / far.sum())]
        centres = np.concatenate([centres, c[None]])
        far = np.minimum(far, ((x - c) ** 2).sum(1))
    for _ in range(rounds):
        own, gap = nearest_centre(x, centres)
        size = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, column, k) for column in x.T], 1)
        moved = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], 0.0)
        empty = np.flatnonzero(size == 0)
        moved[empty] = x[np.argsort(-gap, kind="stable")[: len(empty)]]
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest centre, the first of equal ones."""
    gaps = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    own = gaps.argmin(1)
    return own, np.maximum(gaps[np.arange(len(x)), own], 0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def usable(nodes: DataFrame, prop: str, dim: int) -> DataFrame:
    """(id, vec) of the nodes whose vector has dim components, none null or non-finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kind = "float" if isinstance(nodes.schema[prop].dataType.elementType, T.FloatType) else "double"
    return nodes.select("id", F.transform(F.col(prop), lambda x: x.cast(kind)).alias("vec")).filter(F.col("vec").isNotNull() & (F.size("vec") == dim) & F.forall("vec", fine))


class Codebook:
    """Codewords of every part of the vectors of one dimension; under COSINE of the vectors' directions."""

    def __init__(self, vectors: DataFrame, dim: int, metric: str, sample: int = SAMPLE):
        self.dim, self.metric = dim, metric.upper()
        # The sample is that of the least hashes, so that it is the same in every run.
        rows = vectors.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(sample).collect()
        x = np.array([r["vec"] for r in rows], float).reshape(len(rows), dim)
        self.trained_on = len(x)
        x = _unit(x) if self.metric == "COSINE" else x
        self.parts = [slice(a, min(a + WIDTH, dim)) for a in range(0, dim, WIDTH)]
        self.words = [kmeans(x[:, p], CODEWORDS, seed=i) for i, p in enumerate(self.parts)] if len(x) else []

    def codes(self, vectors: DataFrame) -> DataFrame:
        """(id, code, vec): the number of the nearest codeword for every part of every vector."""
        dim, cosine, parts, words = self.dim, self.metric == "COSINE", self.parts, self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                x = _unit(x) if cosine else x
                own = np.stack([nearest_centre(x[:, p], w)[0] for p, w in zip(parts, words, strict=True)], 1).astype(np.int16)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(parts))
                code = pa.ListArray.from_arrays(offsets, pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), code, batch.column("vec")], names=["id", "code", "vec"])

        return vectors.mapInArrow(run, f"id long, code array<short>, vec {vectors.schema['vec'].dataType.simpleString()}")

    def write(self, vectors: DataFrame, path: str) -> DataFrame:
        """The codes, written in the order of ids."""
        self.codes(vectors).repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
        return vectors.sparkSession.read.parquet(path)

    def table(self, query: list[float]) -> list[float]:
        """What each codeword adds to the distance from the query, CODEWORDS entries a part."""
        q = np.array([query], float)
        q = (_unit(q) if self.metric == "COSINE" else q)[0]
        out = np.zeros((len(self.parts), CODEWORDS))
        for row, p, w in zip(out, self.parts, self.words, strict=True):
            row[: len(w)] = ((w - q[p]) ** 2).sum(1) if self.metric == "L2" else -(w @ q[p])
        return out.ravel().tolist()

    def shortlist(self, codes: DataFrame, query: list[float], n: int) -> DataFrame:
        """(id) of the n nearest by their codes; ties go to the smaller id."""
        table = F.from_json(F.lit(json.dumps(self.table(query))), "array<double>")
        terms = F.transform("code", lambda c, i: F.element_at(table, i * CODEWORDS + c + 1))
        return codes.select("id", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("d")).orderBy("d", "id").limit(n).select("id")

    def candidates(self, codes: DataFrame, query: list[float], k: int) -> DataFrame:
        """(id, vec) of a shortlist for the k nearest. Its ids come to the driver: PER_RESULT a result, SHORTLIST at least."""
        ids = sorted(r["id"] for r in self.shortlist(codes, query, max(SHORTLIST, PER_RESULT * k)).collect())
        wanted = F.lit(False)
        for a in range(0, len(ids), LISTED):
            wanted = wanted | F.col("id").isin(ids[a : a + LISTED])
        return codes.filter(wanted).select("id", "vec")
