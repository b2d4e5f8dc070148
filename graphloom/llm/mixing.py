"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Every document gets a place in its source's permutation: a hash of (seed, doc_id, text), cut into 4096 blocks.
2. Targets: each source's weight share of all words, stopped at ``max_repeats`` times its size (water filling).
3. A source's mix is so many whole passes of its permuted blocks, then blocks of one more pass until the target is
   filled; the block where that happens is cut document by document, the last document by words.
4. Block quotas are dealt to output shards by a binary tree: at each node the left half's share of every source is
   drawn from the multivariate hypergeometric distribution, so quotas add up exactly on every level. A shard then owns
   a disjoint run of each source's permuted blocks. Its rows are ordered by another hash: written parts hold the
   shards one after another, each in that order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, doc_key, workdir

SIZE = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARDS = 64
SEED = 20240607
#: Sources are broadcast when there are at most so many (a row of numbers and a name each).
BROADCAST_SOURCES = 10_000


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with i, the source's place in code-point order, null last: counted range by range, so no task holds them all."""
    order = [F.col("source").isNull(), F.col("source")]
    rows = sizes.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).checkpoint()
    before, first = 0, []
    for r in sorted(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a partition
        first += [F.lit(r["part"]), F.lit(before).cast("long")]
        before += r["n"]
    place = F.element_at(F.create_map(*first), F.col("part")) + F.col("at") if first else F.lit(0).cast("long")
    return rows.withColumn("i", place).drop("part", "at")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: float = 3.0) -> DataFrame:
    """(source key, source_size, target) from (key, source, source_size), one row a source.

    Sources take weights in code-point order, null last, repeating. A source whose share would pass max_repeats times
    its size stops there and the rest is shared again by weight. Each round works out the common level from sums over
    all sources and stops those that it fills; it only rises, so a few rounds settle it.
    """
    weight = F.lit(float(weights[-1]))
    for k, x in list(enumerate(weights))[:-1]:
        weight = F.when(F.col("i") % len(weights) == k, F.lit(float(x))).otherwise(weight)
    ranked = _ranked(sizes).withColumn("w", weight).withColumn("stop", F.col("source_size") * max_repeats)
    level = -1.0
    while True:
        full = F.col("stop") < F.lit(level) * F.col("w")
        got = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("stop"))).alias("stopped"), F.sum(F.when(~full, F.col("w"))).alias("w")).head()
        if not got["all"] or not got["w"]:
            level = 0.0 if not got["all"] else float("inf")
            break
        new = (got["all"] - (got["stopped"] or 0.0)) / got["w"]
        if new <= level:
            break
        level = new
    target = F.col("stop") if math.isinf(level) else F.least(F.col("stop"), F.lit(level) * F.col("w"))
    return ranked.select("key", "source_size", target.cast("double").alias("target"))


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def _bounded(df: DataFrame, many: bool) -> DataFrame:
    return df if many else F.broadcast(df)


def _decide(base: DataFrame, weights: tuple, max_repeats: float, seed: int) -> DataFrame:
    """(doc_id, h, key, size, source_size, target, block, whole, taken, copies) for every row.

    taken = words the mix takes of the row; copies = times it is taken, a cut one counted; block = its permuted block.
    Texts don't move: sizes are read once into a narrow checkpoint that the rest works on. Null text has size 0 and
    gives nothing; a null source is a source; repeated rows are separate rows; ties of the permutation go by doc_id,
    then text hash. doc_id is an integer or null.
    """
    workdir(base.sparkSession)
    docs = base.select(
        doc_key(base).alias("doc_id"), F.xxhash64("text", "source", "doc_id").alias("h"), _key("source").alias("key"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(SIZE)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "h")).checkpoint()
    sizes = docs.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats).checkpoint()
    many = targets.count() > BROADCAST_SOURCES
    docs = docs.join(_bounded(targets, many), "key").withColumn("block", F.shiftrightunsigned("place", 52).cast("int"))
    # Whole passes, and words still wanted of one more.
    docs = docs.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    docs = docs.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    # At most 4096 blocks a source: their running sums find the block that fills the target, then again inside it.
    first = _edge(docs, ["key"], "block")
    inside = docs.join(_bounded(first.withColumnRenamed("edge", "block"), many), ["key", "block"]).withColumn("cell", F.shiftrightunsigned(F.shiftleft("place", 12), 52).cast("int")).withColumn("rest", F.col("left"))
    inside = inside.drop("left")
    second = _edge(inside, ["key"], "cell")
    leaf = inside.join(_bounded(second.withColumnRenamed("edge", "cell"), many), ["key", "cell"])
    run = W.partitionBy("key").orderBy(F.shiftleft("place", 24), "doc_id", "h", "size")
    rows = W.partitionBy("doc_id", "h").orderBy("size")
    docs = docs.drop("rest")
    cut = (
        leaf.withColumn("before", F.coalesce(F.sum("size").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before"))))
        .groupBy("doc_id", "h").agg(F.sum("part").alias("part"), F.count(F.lit(1)).alias("n"))
    )
    edges = first.select("key", F.col("edge").alias("b1")).join(second.select("key", F.col("edge").alias("b2")), "key", "left")
    docs = docs.join(_bounded(edges, many), "key", "left").withColumn("cell", F.shiftrightunsigned(F.shiftleft("place", 12), 52).cast("int"))
    at_leaf = (F.col("block") == F.col("b1")) & (F.col("cell") == F.col("b2"))
    more = F.when(F.col("b1").isNull() | (F.col("block") < F.col("b1")), F.col("size")).when((F.col("block") == F.col("b1")) & (F.col("b2").isNull() | (F.col("cell") < F.col("b2"))), F.col("size")).otherwise(F.lit(0))
    cut = cut.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), (F.col("part") / F.col("n")).alias("part"))
    docs = docs.withColumn("leaf", F.coalesce(at_leaf, F.lit(False)))
    out = docs.join(cut, docs["leaf"] & (docs["doc_id"] == cut["_d"]) & (docs["h"] == cut["_h"]), "left")
    extra = F.when(F.col("leaf"), F.floor(F.coalesce("part", F.lit(0.0)))).otherwise(more).cast("long")
    taken = (F.col("whole") * F.col("size") + extra).cast("long")
    return out.select("doc_id", "h", "key", "size", "source_size", "target", "block", "whole", taken.alias("taken"), (F.col("whole") + (extra > 0).cast("long")).alias("copies"))


def _edge(docs: DataFrame, by: list[str], cell: str) -> DataFrame:
    """For each source the cell where its running size passes rest, and what is left to take there; none if never."""
    sums = docs.groupBy(*by, cell).agg(F.sum("size").alias("s"), F.max("rest").alias("rest"))
    upto = F.sum("s").over(W.partitionBy(*by).orderBy(cell))
    passed = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
    return passed.groupBy(*by).agg(F.min(F.struct(F.col(cell).alias("edge"), (F.col("rest") - F.col("upto") + F.col("s")).alias("left"))).alias("m")).select(*by, "m.edge", "m.left")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def draw_hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``total`` are among the ``marked`` ones, by inversion of u in [0, 1).

    Terms are built by their ratio from 12 deviations below the mean to 12 above, which holds all but 1e-30 of the mass.
    """

    def bounds(a: Column) -> Column:
        t, m, d = a["t"], a["m"], a["d"]
        mean = F.when(t > 0, d * m / t).otherwise(F.lit(0.0))
        spread = F.sqrt(F.when(t > 1, mean * (1 - m / t) * (t - d) / (t - 1)).otherwise(F.lit(0.0))) * 12 + 2
        lo = F.greatest(F.lit(0.0), d - (t - m), F.floor(mean - spread)).cast("long")
        hi = F.least(d, m, F.ceil(mean + spread)).cast("long")
        return F.struct(t.alias("t"), m.alias("m"), d.alias("d"), a["u"].alias("u"), lo.alias("lo"), hi.alias("hi"))

    def invert(b: Column) -> Column:
        ratio = lambda k: (b["m"] - k) * (b["d"] - k) / ((k + 1.0) * (b["t"] - b["m"] - b["d"] + k + 1.0))
        steps = F.when(b["hi"] > b["lo"], F.sequence(b["lo"], b["hi"] - 1)).otherwise(F.array().cast("array<bigint>"))
        one = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))
        grow = lambda a, k: _let(a["p"] * ratio(k), lambda p: F.struct(p.alias("p"), (a["sum"] + p).alias("sum")))
        whole = F.aggregate(steps, one, grow)["sum"]

        def seek(goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), b["lo"].alias("k"))
            step = lambda a, k: F.when(a["sum"] > goal, a).otherwise(
                _let(a["p"] * ratio(k), lambda p: F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), (k + 1).alias("k"))))
            return F.aggregate(steps, start, step)["k"]

        return _let(whole * b["u"], seek)

    args = F.struct(total.cast("double").alias("t"), marked.cast("double").alias("m"), drawn.cast("double").alias("d"), u.alias("u"))
    return _let(_let(args, bounds), invert)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, key, first, n): how many of each source's blocks every shard gets, and from which of its permutation on.

    ``quotas`` holds (key, blocks). Every source's n add up to its blocks, and shards differ by one block at most
    in all. A node of the tree is one row with its sources' counts, so splitting needs no shuffle.
    """
    node = quotas.groupBy(F.lit(0).alias("lo"), F.lit(shards).alias("hi")).agg(
        F.sum("blocks").cast("long").alias("total"),
        F.sort_array(F.collect_list(F.struct("key", F.col("blocks").cast("long").alias("n"), F.lit(0).cast("long").alias("first")))).alias("s"))
    size, level = shards, 0
    while size > 1:
        mid = F.expr("(lo + hi) div 2").cast("int")
        share = F.expr("(total * ((lo + hi) div 2 - lo) + hi - lo - 1) div (hi - lo)").cast("long")

        def step(a: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(level), F.col("lo"), x["key"]), F.lit(1 << 40)) / float(1 << 40)  # noqa: B023
            return _let(draw_hypergeometric(a["total"], x["n"], a["left"], u), lambda k: F.struct(
                (a["total"] - x["n"]).alias("total"), (a["left"] - k).alias("left"), F.concat(a["got"], F.array(k)).alias("got")))

        start = F.struct(F.col("total").alias("total"), F.col("left").alias("left"), F.array().cast("array<bigint>").alias("got"))
        split = node.withColumns({"mid": mid, "left": share}).withColumn("got", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("s", start, step)["got"]))
        half = lambda n, first: F.zip_with("s", "got", lambda x, k: F.struct(x["key"].alias("key"), n(x, k).alias("n"), first(x, k).alias("first")))
        halves = F.array(
            F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("total"), half(lambda x, k: k, lambda x, k: x["first"]).alias("s")),
            F.struct(F.col("mid").alias("lo"), "hi", (F.col("total") - F.col("left")).alias("total"), half(lambda x, k: x["n"] - k, lambda x, k: x["first"] + k).alias("s")))
        whole = F.array(F.struct("lo", "hi", "total", "s"))
        node = split.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(whole)).alias("y")).select("y.*")
        size, level = (size + 1) // 2, level + 1
    return node.select(F.col("lo").alias("shard"), F.explode("s").alias("x")).select("shard", "x.key", "x.first", "x.n")


def draw(decided: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Narrow rows (doc_id, h, copy, words, shard, place), one for every copy the mix takes of a row of _decide.

    Block (copy, block) of a source is one quota; split_quotas says how many each shard gets, and a shard owns the
    run of the source's permuted blocks from ``first`` on, so shards are disjoint. place orders a shard's rows.
    """
    copies = decided.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    copies = copies.withColumn("words", F.when(F.col("copy") < F.col("whole"), F.col("size")).otherwise(F.col("taken") - F.col("whole") * F.col("size")))
    blocks = copies.groupBy("key", "copy", "block").agg(F.sum("words").alias("block_words"))
    ranked = blocks.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("copy", "block")) - 1)
    split = split_quotas(ranked.groupBy("key").agg(F.count(F.lit(1)).alias("blocks")), shards, seed).withColumnRenamed("key", "_k")
    owner = ranked.join(split, (F.col("key") == F.col("_k")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))).select("key", "copy", "block", "shard")
    out = copies.join(owner, ["key", "copy", "block"])
    return out.select("doc_id", "h", "copy", "words", "shard", F.xxhash64(F.lit(seed + 2), "shard", "doc_id", "h", "copy").alias("place"))


def deal(documents: DataFrame, shards: int = SHARDS, weights: tuple = WEIGHTS, max_repeats: float = 3.0, seed: int = SEED) -> DataFrame:
    """The mix itself: documents' rows once for every copy taken, with copy, words (of it), shard and place added.

    A row with words below its size is cut there by the caller. Texts move once, in the join with what was drawn; each
    partition then holds its rows by shard, and in a shard by place, a hash, so a shard's rows are shuffled. Rows equal
    in doc_id, text and source are taken alike, each by itself, with one shard and place for a copy of all. Null text has
    no words and isn't drawn; a null source is a source; null ids are one id. Input columns of an added name are
    replaced, other names are free. An empty table gives an empty mix.
    """
    added = ("copy", "words", "shard", "place")
    drawn = draw(_decide(documents, weights, max_repeats, seed), shards, seed).groupBy(F.col("doc_id").alias("d"), "h", "copy").agg(F.max("words").alias("words"), F.min("shard").alias("shard"), F.min("place").alias("place"))
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.drop(*added).columns)).alias("row"), doc_key(documents).alias("d"), F.xxhash64("text", "source", "doc_id").alias("h"))
    return packed.join(drawn, ["d", "h"]).sortWithinPartitions("shard", "place").select("row.*", *added)


def report(documents: DataFrame) -> DataFrame:
    """taken is what the shards' draws add up to. Rows equal in doc_id, text and source are drawn alike, each by itself."""
    decided = _decide(documents.select("doc_id", "text", "source"), WEIGHTS, 3.0, SEED).checkpoint()
    got = draw(decided).groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "copy").agg(F.max("words").alias("w")).groupBy("_d", "_h").agg(F.sum("w").alias("drawn"))
    out = decided.join(got, (F.col("doc_id") == F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "size", "source_size", "target", F.coalesce("drawn", F.lit(0)).cast("long").alias("taken"))
