"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Links whose labels one task and one file hold.
ROWS = 100_000


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in links (a, b): comp is the least id of its component.

    Each round takes the least label among neighbours, then the label's own label, so chains shorten by powers of two.
    Labels stay a distributed table, written in the shared folder each round, in as many files as the links call for:
    every file costs a task and, where Hadoop has no native library, processes that the executor starts.
    """
    pairs = stash(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parts = max(1, -(-pairs.count() // ROWS))
    labels = stash(pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp")).coalesce(parts))
    while True:
        near = pairs.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "id").select("id", "comp", F.least("comp", "near").alias("low"))
        jump = low.alias("x").join(labels.select(F.col("id").alias("low"), F.col("comp").alias("up")), "low").select("id", "comp", F.least("low", "up").alias("new"))
        done = stash(jump.coalesce(parts))
        changed = not done.filter(F.col("new") != F.col("comp")).isEmpty()
        labels = done.select("id", F.col("new").alias("comp"))
        if not changed:
            return labels
