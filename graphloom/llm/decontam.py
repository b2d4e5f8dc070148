"""Benchmark decontamination: broadcast hash sets of normalised test n-grams, scanned over the documents' word windows."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, temp_name
from .textops import Words, as_bytes, buffers

#: Words of benchmark text in one broadcast block; a larger benchmark is scanned block after block.
BLOCK_WORDS = 400_000


def _block(items: list[tuple[str, bytes]], n: int) -> dict:
    """Windows by length: sorted hashes to scan for, and the exact window texts with their items."""
    found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    hashes: dict[int, set[int]] = defaultdict(set)
    for item, text in items:
        w = Words([text])
        size = min(n, len(w.start))
        if size:
            for i, h in enumerate(w.grams(size).tolist()):
                found[size][w.text(i, size)].add(item)
                hashes[size].add(h)
    return {k: (np.array(sorted(hashes[k]), np.uint64), {t: sorted(s) for t, s in v.items()}) for k, v in found.items()}


def benchmark_blocks(benchmark: DataFrame, n: int, block_words: int = BLOCK_WORDS) -> list:
    """Broadcasts of at most about block_words words each, read as a stream: the driver never holds the whole benchmark."""
    sc, out, items, size = benchmark.sparkSession.sparkContext, [], [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        if r[1]:
            items.append((r[0], r[1].encode()))
            size += len(r[1]) // 2 + 1
            if size >= block_words:
                out.append(sc.broadcast(_block(items, n)))
                items, size = [], 0
    if items:
        out.append(sc.broadcast(_block(items, n)))
    return out


def _scan(w: Words, blocks: list, n_texts: int) -> tuple[np.ndarray, list[set[str]]]:
    """For each word whether a window hits it; for each text the items with occurring windows."""
    delta = np.zeros(len(w.start) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n_texts)]
    grams: dict[int, np.ndarray] = {}
    for b in blocks:
        for size, (keys, exact) in b.value.items():
            if size not in grams:
                grams[size] = w.grams(size)
            g = grams[size]
            if not len(g):
                continue
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == g)
            text = np.searchsorted(w.first, hit, side="right") - 1
            inside = hit + size <= w.first[text + 1]
            for i, t in zip(hit[inside].tolist(), text[inside].tolist(), strict=True):
                known = exact.get(w.text(i, size))
                if known:
                    delta[i] += 1
                    delta[i + size] -= 1
                    items[t].update(known)
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)  # the next read loads it from disk again
    return np.cumsum(delta[:-1]) > 0, items


def _cut(text: bytes, w: Words, base: int, a: int, hit: np.ndarray) -> bytes:
    """The text without its runs of hit words, and without what stands between words of a run."""
    out, at, k = [], 0, 0
    while k < len(hit):
        if hit[k]:
            j = k
            while j + 1 < len(hit) and hit[j + 1]:
                j += 1
            out.append(text[at : w.start[a + k] - base])
            at, k = w.end[a + j] - base, j
        k += 1
    return b"".join([*out, text[at:]])


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, remove: str | None = None, prefix: str = "") -> DataFrame:
    """Every row of documents with n_words, n_hit, n_items, items_sha256 and contaminated added (names take ``prefix``).

    ``remove``: None leaves texts alone; "spans" cuts hit words out and drops documents left without a word;
    "documents" drops contaminated documents. Null and empty texts have no words and hit nothing; repeated rows are
    judged alike; an empty benchmark hits nothing; null item ids count as ''. A column of the input with the name of
    an added one is replaced. No shuffle: one scan, with the benchmark in bounded broadcast blocks.
    """
    spark = documents.sparkSession
    small_batches(spark)
    blocks = benchmark_blocks(benchmark, n)
    added = [prefix + c for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    base = documents.drop(*added)
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, t) for c, t in zip(added, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            n_words, n_hit, n_items, sha, cut = [], [], [], [], []
            for lo, hi in buffers(texts):
                w = Words(texts[lo:hi])
                hits, items = _scan(w, blocks, hi - lo)
                total = np.concatenate([[0], np.cumsum(hits)])
                for i in range(hi - lo):
                    a, b = w.first[i], w.first[i + 1]
                    n_words.append(int(b - a))
                    n_hit.append(int(total[b] - total[a]))
                    n_items.append(len(items[i]))
                    sha.append(hashlib.sha256(",".join(sorted(items[i])).encode()).hexdigest())
                    if remove == "spans":
                        t = texts[lo + i]
                        cut.append(_cut(t, w, w.base[i], a, hits[a:b]) if n_hit[-1] else t)
            cols = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            if remove == "spans":
                null = batch.column("text").is_null().to_pylist()
                cols["text"] = pa.array([None if z else c.decode(errors="ignore") for z, c in zip(null, cut, strict=True)], pa.string())
            cols |= dict(zip(added, (pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha), pa.array([x > 0 for x in n_hit])), strict=True))
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    out = base.mapInArrow(run, schema)
    if remove == "documents":
        out = out.filter(~F.col(added[4]))
    elif remove == "spans":
        out = out.filter(~F.col(added[4]) | (F.col(added[1]) < F.col(added[0])))
    return out


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return decontaminate(documents.select("doc_id", "text"), benchmark).select(*cols)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents' columns, whatever their names: hit words cut out of the texts, n_chars counted anew where a text changed.

    A document left without a word goes with its row; one that had none before, null and empty texts too, stays as it is.
    Null ids and repeated rows are treated like others, an empty benchmark changes nothing, an empty table gives none.
    """
    stem = temp_name(documents.columns, "_leak") + "_"
    # Arrow's operator looks columns up by name, where a dot or a backtick would be read as syntax.
    plain = [f"{stem}{i}" if set(c) & set(".`") else c for i, c in enumerate(documents.columns)]
    out = decontaminate(documents.toDF(*plain), benchmark, remove="spans", prefix=stem)
    if "n_chars" in documents.columns:
        changed = F.when(F.col(stem + "contaminated"), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(documents.schema["n_chars"].dataType))
    return out.select(*plain).toDF(*documents.columns)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
b2 AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM b2, unnest(range(1, len(w) - n + 2)) AS t(i)),
ns AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, dwin.n, i, item FROM dwin JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
