"""N-gram Jaccard join by the chosen-path method.

Sets are the distinct shingles of five words. Equal sets are one class. Classes are split recursively on sampled
coordinates of a min-wise sketch - each is a shared token of similar sets - until buckets are small; at every level a
pair of the threshold's similarity shares one child in expectation, and runs repeat until the target recall, counted
for pairs whose buckets are split at every level.
Small buckets are compared by brute force on sketches, which yields candidate components; inside those every pair is
compared exactly, on whole sets, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, doc_key, small_batches, stash
from .components import components
from .textops import Words, as_bytes, buffers, mix, shingle_sets

THRESHOLD, RECALL, WORDS, SKETCH = 0.8, 0.9999, 5, 64
#: A bucket of more classes is split again, up to so many times.
BUCKET, LEVELS = 8192, 3
#: Classes in one block of an exact comparison, and in one bin of small components.
BLOCK, BIN = 2048, 512
_SEEDS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs_for(recall: float) -> int:
    """Runs that find a pair at the threshold with probability ``recall``, even if all its buckets are split LEVELS times.

    A coordinate is sampled with probability 1 / (threshold * SKETCH) and agrees with that of the threshold, so each of
    the SKETCH coordinates gives the pair a common child with probability 1 / SKETCH at every level.
    """
    kept = 1.0
    for _ in range(LEVELS + 1):
        kept = 1 - (1 - kept / SKETCH) ** SKETCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - kept)))


def agreements(threshold: float) -> int:
    """Agreeing coordinates that make a candidate: the threshold's mean less 4.4 deviations, missed by one pair in 10^5."""
    return max(2, math.floor(threshold * SKETCH - 4.4 * math.sqrt(SKETCH * threshold * (1 - threshold))))


def sketch(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[set, SKETCH] 32-bit min-wise values; set i is shingles[first[i]:first[i + 1]], none is empty."""
    out = np.empty((len(first) - 1, SKETCH), np.uint32)
    for j, s in enumerate(_SEEDS):
        h = (shingles ^ s) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        out[:, j] = (np.minimum.reduceat(h * (_SEEDS[-1 - j] | np.uint64(1)), first[:-1]) >> np.uint64(32)).astype(np.uint32)
    return out


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    texts = as_bytes(batch.column("text"))
    for lo, hi in buffers(texts):
        out += shingle_sets(Words(texts[lo:hi]), WORDS)
    return out


def _class(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], np.uint64).tobytes()


def _sketched(documents: DataFrame) -> DataFrame:
    """(doc, h, cls, n, sig, low) of every row, low the sketch's low bytes; cls is null where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch)
            full = [s for s in sets if len(s)]
            sigs = sketch(np.concatenate(full), np.concatenate([[0], np.cumsum([len(s) for s in full])])) if full else np.zeros((0, SKETCH), np.uint32)
            sigs = iter([(x.tobytes(), y.tobytes()) for x, y in zip(sigs, sigs.astype(np.uint8), strict=True)])
            rows = [(_class(s), len(s), *next(sigs)) if len(s) else (None, 0, None, None) for s in sets]
            cls, n, sig, low = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(low, pa.binary())], names=["doc", "h", "cls", "n", "sig", "low"])

    small_batches(documents.sparkSession)
    return _keyed(documents).mapInArrow(run, "doc long, h long, cls binary, n long, sig binary, low binary")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(doc_key(documents).alias("doc"), F.xxhash64("text").alias("h"), "text")


def _chosen(node: np.ndarray, threshold: float) -> np.ndarray:
    """[node, coordinate]: whether a node samples the coordinate, with probability 1 / (threshold * SKETCH)."""
    h = mix(node[:, None] ^ _SEEDS[None, :])
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) < 1.0 / (threshold * SKETCH)


def _split(rows: DataFrame, root: bool, threshold: float, runs: int) -> DataFrame:
    """(key, cls): the children that classes take from a node, or from the roots of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, SKETCH)
            cls = np.array(batch.column("cls").to_pylist(), object)
            if root:
                run_of, coord = np.nonzero(_chosen(roots, threshold))
                row = np.repeat(np.arange(len(sig)), len(coord))
                node, coord = np.tile(roots[run_of], len(sig)), np.tile(coord, len(sig))
            else:
                node = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                row, coord = np.nonzero(_chosen(node, threshold))
                node = node[row]
            key = mix(node * np.uint64(0x9E3779B97F4A7C15) ^ (coord.astype(np.uint64) << np.uint64(32)) ^ sig[row, coord].astype(np.uint64))
            for lo in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 50_000].view(np.int64)), pa.array(cls[row[lo : lo + 50_000]].tolist(), pa.binary())], names=["key", "cls"])

    return rows.mapInArrow(run, "key long, cls binary")


def _compare(rows: DataFrame, agree: int) -> DataFrame:
    """(a, b): links that connect what is similar, by sketch, in each bucket of (key, cls, low).

    Rows of a bucket are neighbours in a sorted partition; a batch compares rows 1, 2, ... apart, and leaves out links
    of what earlier ones connect.
    """

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = t.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buckets(batches):
            keys = t.column("key").to_numpy()
            sig = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(-1, SKETCH)
            label, left, right = np.arange(len(keys)), [], []
            for lag in range(1, len(keys)):
                a = np.flatnonzero(keys[:-lag] == keys[lag:])
                if not len(a):
                    break
                a = a[label[a] != label[a + lag]]
                a = a[(sig[a] == sig[a + lag]).sum(1) >= agree]
                if len(a):
                    left.append(a)
                    right.append(a + lag)
                    parent = np.arange(len(keys))
                    la, lb = label[a], label[a + lag]
                    np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
                    while (parent[parent] != parent).any():
                        parent = parent[parent]
                    label = parent[label]
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                label = np.arange(len(keys))
                while True:  # whole components of the batch's links; links to their least class make stars, not chains
                    new = label.copy()
                    np.minimum.at(new, a, label[b])
                    np.minimum.at(new, b, label[a])
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                a = np.flatnonzero(label != np.arange(len(keys)))
                cls = t.column("cls")
                a, b = cls.take(pa.array(a)), cls.take(pa.array(label[a]))
                yield pa.RecordBatch.from_arrays([pa.array(a.to_pylist(), pa.binary()), pa.array(b.to_pylist(), pa.binary())], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "cls").select("key", "cls", "low").mapInArrow(run, "a binary, b binary").distinct()


def _to_pivot(large: DataFrame, classes: DataFrame, agree: int) -> DataFrame:
    """(a, b): classes of large buckets (key, cls) that are similar, by sketch, to their bucket's least class."""
    pivots = large.groupBy("key").agg(F.min("cls").alias("b")).join(classes.select(F.col("cls").alias("b"), F.col("low").alias("low_b")), "b")
    pairs = large.join(classes.select("cls", "low"), "cls").join(pivots, "key").filter("cls <> b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("low", "low_b"))
            kept = batch.take(pa.array(np.flatnonzero((x == y).sum(1) >= agree)))
            yield pa.RecordBatch.from_arrays([kept.column("cls"), kept.column("b")], names=["a", "b"])

    return pairs.select("cls", "b", "low", "low_b").mapInArrow(run, "a binary, b binary").distinct()


def candidate_links(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(a, b) links whose components hold every pair the runs find; classes has (cls, sig, low).

    A large bucket all of one component holds no new link, so only mixed ones are split on.
    """
    runs, agree = runs_for(recall), agreements(threshold)
    links, rows = None, _split(classes.select("cls", "sig"), True, threshold, runs)
    for level in range(LEVELS + 1):
        rows = stash(rows.distinct() if level else rows)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = stash(rows.join(sizes.hint("merge"), "key"))  # one plan at every size
        small = sized.filter(F.col("n") <= BUCKET).select("key", "cls").join(classes.select("cls", "low"), "cls")
        found = _compare(small, agree)
        links = found if links is None else links.unionByName(found)
        large = sized.filter(F.col("n") > BUCKET).select("key", "cls")
        if large.isEmpty():
            return links
        links = stash(links.unionByName(_to_pivot(large, classes, agree)).distinct())
        known = large.join(components(links).withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        large = stash(large.join(mixed, "key", "left_semi"))
        if large.isEmpty():
            return links
        if level == LEVELS:  # what still shares every sampled token is one candidate group, to be compared exactly
            return links.unionByName(large.join(large.groupBy("key").agg(F.min("cls").alias("b")), "key").filter("cls <> b").select(F.col("cls").alias("a"), "b"))
        rows = _split(large.join(classes.select("cls", "sig"), "cls").select("key", "cls", "sig"), False, threshold, runs)
    return links


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float, slab: int = 4096) -> np.ndarray:
    """[i, j]: whether the Jaccard similarity of left[i] and right[j] reaches the threshold; exact."""
    na, nb = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    tokens, which = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = int(na.sum())
    row_a, row_b = np.repeat(np.arange(len(left)), na), np.repeat(np.arange(len(right)), nb)
    a, b = which[:cut], which[cut:]
    both = np.flatnonzero((np.bincount(a, minlength=len(tokens)) > 0) & (np.bincount(b, minlength=len(tokens)) > 0))
    code = np.full(len(tokens), -1)
    code[both] = np.arange(len(both))
    a, b = code[a], code[b]
    row_a, a, row_b, b = row_a[a >= 0], a[a >= 0], row_b[b >= 0], b[b >= 0]
    shared = np.zeros((len(left), len(right)), np.float32 if max(na.max(), nb.max()) < 1 << 24 else np.float64)
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, row_a, b, row_b = a[oa], row_a[oa], b[ob], row_b[ob]
    for lo in range(0, len(both), slab):
        hi = min(len(both), lo + slab)
        x, y = np.zeros((len(left), hi - lo), shared.dtype), np.zeros((len(right), hi - lo), shared.dtype)
        i, j = slice(*np.searchsorted(a, (lo, hi))), slice(*np.searchsorted(b, (lo, hi)))
        x[row_a[i], a[i] - lo] = 1
        y[row_b[j], b[j] - lo] = 1
        shared += x @ y.T
    return shared >= threshold * (na[:, None] + nb[None, :] - shared.astype(np.float64)) - 1e-9


def _verify(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        """One cell: a bin of whole small components, or two chunks (or one) of a large one."""
        comp = t.column("comp").to_pylist()
        cls, m, side = np.array(t.column("cls").to_pylist(), object), t.column("m").to_numpy(), t.column("side").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        groups: dict[bytes, list[int]] = {}
        seen = set()
        for i, c in enumerate(comp):
            if cls[i] not in seen:
                seen.add(cls[i])
                groups.setdefault(c, []).append(i)
        out = []
        for g in groups.values():
            g = np.array(sorted(g, key=lambda i: cls[i]))
            a, b = g[side[g] == 0], g[side[g] == 1]
            if len(a) and len(b):
                s = similar([sets[i] for i in a], [sets[i] for i in b], threshold)
                whole = np.zeros((len(g), len(g)), bool)
                ia, ib = np.flatnonzero(side[g] == 0), np.flatnonzero(side[g] == 1)
                whole[np.ix_(ia, ib)], whole[np.ix_(ib, ia)] = s, s.T
            elif len(g) > 1:
                whole = similar([sets[i] for i in g], [sets[i] for i in g], threshold)
                np.fill_diagonal(whole, False)
            else:
                continue
            links = whole @ m[g].astype(np.int64)
            label = np.arange(len(g))
            while True:
                new = np.minimum(label, np.where(whole, label[None, :], len(g)).min(1))
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
            out += [(cls[i], cls[g[k]], int(n)) for i, k, n in zip(g, label, links, strict=True) if n]
        a, b, n = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "links"])

    return run


def _with_sets(documents: DataFrame, members: DataFrame) -> DataFrame:
    """members (doc, h, cls, ...) with the shingles of their class, read from the texts once."""
    columns = members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch)
            same = [i for i, (s, c) in enumerate(zip(sets, batch.column("cls").to_pylist(), strict=True)) if len(s) and _class(s) == c]
            kept = batch.take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in columns), pa.array([sets[i].tobytes() for i in same], pa.binary())], names=[*columns, "shingles"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", shingles binary"
    joined = _keyed(documents).join(members.hint("shuffle_hash"), ["doc", "h"])
    return joined.select(*columns, "text").mapInArrow(run, schema)


def _classified(documents: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc, h, cls) of every row, and (cls, m, rep, least, links) of every class of equal sets.

    m: its rows; rep: its least (doc, h); least: that of all that links connect; links: other rows linked to each."""
    rows = stash(_sketched(documents))
    reps = stash(rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("doc", "h")).alias("rep"), F.count(F.lit(1)).alias("m"), F.min("sig").alias("sig"), F.min("low").alias("low")))
    comps = components(stash(candidate_links(reps, threshold, recall)))
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    members = reps.select("cls", "rep.doc", "rep.h", "m").join(comps.withColumnRenamed("id", "cls"), "cls").join(sizes, "comp").select("comp", "cls", "doc", "h", "m", "size")
    bins = F.greatest(F.lit(1), F.ceil(F.lit(comps.count() / BIN)))
    chunk = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / BLOCK)).cast("int")
    sets = _with_sets(documents, members).withColumn("chunk", chunk).withColumn("chunks", F.ceil(F.col("size") / BLOCK).cast("int"))
    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({
        "lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other"),
        "side": F.when(F.col("chunk") > F.col("other"), 1).otherwise(0),
        "bin": F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("comp"), bins)).otherwise(F.xxhash64("comp")),
        "single": F.col("chunks") == 1,
    })
    verified = stash(cells.select("single", "bin", "lo", "hi", "comp", "cls", "m", "side", "shingles").groupBy("single", "bin", "lo", "hi").applyInArrow(_verify(threshold), "a binary, b binary, links long"))
    linked = components(verified.select("a", "b"))
    first = linked.join(reps.select(F.col("cls").alias("id"), "rep"), "id")
    least = first.join(first.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select(F.col("id").alias("cls"), "least")
    links = verified.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    per = reps.select("cls", "m", "rep").join(least, "cls", "left").join(links, "cls", "left")
    per = per.select("cls", "m", "rep", F.coalesce("least", "rep").alias("least"), F.coalesce("links", F.lit(0)).alias("links"))
    # Written, so that the join of all rows is between plain exchanges, whose large partitions Spark splits: one class may have a third of the rows.
    return rows.select("doc", "h", "cls"), stash(per)


def join(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, rep_id, n_links) for every row of documents.

    n_links: how many other rows reach the threshold. class_id: least doc_id of all that links connect. rep_id: least
    doc_id with the same set. A text of fewer than five words, but not none, is one shingle of them; a text without
    words (null, empty) links to nothing and is its own class. Null ids come first and show as 0 in class_id and
    rep_id. Repeated rows link to each other. A set's classes are named by 128 hash bits. A pair at the threshold is
    found with probability ``recall``, a more similar one with more. Empty tables give none. doc_id is an integer.
    """
    rows, per = _classified(documents, threshold, recall)
    out = rows.join(per, "cls", "left")
    shown = lambda c: F.when(c == NO_ID, F.lit(0)).otherwise(c)
    return out.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), shown(F.coalesce("least.doc", "doc")).alias("class_id"), F.when(F.col("rep").isNull(), F.nullif("doc", F.lit(NO_ID))).otherwise(shown(F.col("rep.doc"))).alias("rep_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("m") - 1, F.lit(0))).cast("long").alias("n_links"))


def keep_one(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """documents' columns of one document of each group of near duplicates: the least doc_id, null first, ties by a hash
    of the text.

    Rows equal in doc_id and text are one document and stay once, as one of them. Different texts of one doc_id are
    different documents. Texts without words (null, empty) are no duplicates of each other. Column names are free. An
    empty table gives none.
    """
    rows, per = _classified(documents, threshold, recall)
    gone = rows.join(per.select("cls", "least"), "cls").filter(F.struct("doc", "h") != F.col("least")).select("doc", "h").distinct()
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), doc_key(documents).alias("doc"), F.xxhash64("text").alias("h"))
    return packed.join(gone, ["doc", "h"], "left_anti").dropDuplicates(["doc", "h"]).select("row.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(x.n) + any_value(y.n) - count(*)) - 1e-9),
c AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.id),
k AS (SELECT id, min(root) AS class_id FROM c GROUP BY id),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT documents.doc_id, class_id, coalesce(r.rep, documents.doc_id) AS rep_id, coalesce(n_links, 0) AS n_links
FROM documents JOIN k ON k.id = documents.doc_id LEFT JOIN l ON l.a = documents.doc_id
LEFT JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM n) r ON r.doc_id = documents.doc_id
"""
