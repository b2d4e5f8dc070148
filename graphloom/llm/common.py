"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII word pattern of every operator that counts words; bytes from 0x80 up are word bytes.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workdir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local master, which shares everything, gets a
    temporary folder where none is named; on a cluster that raises."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        named = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


#: The folder of each written table.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stash(df: DataFrame, sort_by: list[str] | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there and survives lost executors.

    The table is removed when the driver ends, or by discard.
    """
    spark = df.sparkSession
    path = f"{workdir(spark)}/graphloom-{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    out.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that stash returned and that nothing reads any more: all made from them has been written itself."""
    for t in tables:
        _remove(t.sparkSession, _written.pop(t))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already  # noqa: BLE001
        pass


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows and the bytes of an Arrow batch, so that a batch of very long texts fits in a Python worker.

    Plans read these settings when they run, after the operator has returned, so they stay set in the session.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: What a null doc_id is in comparisons: before every other.
NO_ID = -(1 << 63)


def doc_key(documents: DataFrame) -> Column:
    """doc_id as a long, null as NO_ID. Ids are integers of any width; a column of another type is refused."""
    kind = documents.schema["doc_id"].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"doc_id must be an integer column, not {kind.simpleString()}")
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def temp_name(columns: list[str], stem: str) -> str:
    """A column name that no column of the input has, whatever its case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def keyed_labels(documents: DataFrame, labels: DataFrame, label: str, keep: Column, wanted: int) -> DataFrame:
    """A bounded, deterministic sample of labelled texts: (doc_id, text, y).

    About ``wanted`` rows of each class; which ones follows from a hash of doc_id, so reruns agree. A doc_id with
    contradictory labels counts once, as its largest label; rows without an id or a label teach nothing.
    """
    known = (
        labels.filter(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, wanted / max(n, 1)))).otherwise(share)
    picked = known.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    picked = stash(picked.select("doc_id", "y"))
    few = picked.count() <= 4 * wanted  # holds unless the hash fails badly: then the sample is joined by a shuffle
    return documents.select("doc_id", "text").join(F.broadcast(picked) if few else picked, "doc_id")
