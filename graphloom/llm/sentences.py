"""Substring dedup by sliding sentence spans: every run of SPAN consecutive sentences is hashed and joined globally.

A sentence ends with a newline, with . ! ? or an ellipsis (and closing quotes or brackets) before white space, or with a
full-width stop. The white space that follows belongs to it. Sentences are compared with their white space folded to
single blanks; what is only white space is no sentence and always stays. A text of fewer sentences has no span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, small_batches, stash

SPAN = 3
#: Rows of spans in one Arrow batch.
ROWS = 1 << 15
_END = re.compile("(?:(?<![.!?…])[.!?…]++[\"'”’»)\\]]*+(?=\\s)|[。！？]++[\"'”’」』）]*+|\n)\\s*+")


def split(text: str) -> list[tuple[int, int, str]]:
    """(start, end, folded) of each sentence; with what is only white space they make up the text."""
    cuts = [m.end() for m in _END.finditer(text)]
    out, at = [], 0
    for e in [*cuts, len(text)]:
        folded = " ".join(text[at:e].split())
        if folded:
            out.append((at, e, folded))
        at = e
    return out


def _spans(documents: DataFrame) -> DataFrame:
    """(a, b, doc, h, i): two halves of a 128-bit hash of the span from each sentence i on."""
    names = ["a", "b", "doc", "h", "i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[int]] = [[] for _ in names]
        for batch in batches:
            for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "h", "text")), strict=True):
                s = [hashlib.blake2b(x.encode(), digest_size=16).digest() for _, _, x in split(text or "")]
                for i in range(len(s) - SPAN + 1):
                    d = hashlib.blake2b(b"".join(s[i : i + SPAN]), digest_size=16).digest()
                    for c, v in zip(cols, (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), doc, h, i), strict=True):
                        c.append(v)
                    if len(cols[0]) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
                        cols = [[] for _ in names]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return documents.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def repeated(documents: DataFrame) -> DataFrame:
    """(doc, h, later): for each text with repeated spans the sentences where such a span starts.

    ``documents`` has (doc, h, text).
    """
    small_batches(documents.sparkSession)
    places = stash(_spans(documents))
    # Written, so that both sides of the join are plain exchanges, whose large partitions Spark splits.
    first = F.min(F.struct("doc", "h", "i")).alias("f")
    often = stash(places.groupBy("a", "b").agg(first, F.count(F.lit(1)).alias("c")).filter("c > 1").select("a", "b", "f"))
    later = places.join(often, ["a", "b"]).filter(F.struct("doc", "h", "i") != F.col("f"))
    return later.groupBy("doc", "h").agg(F.collect_set("i").alias("later"))


def cut(text: str, later: list[int]) -> tuple[str, int, int, int]:
    """(kept, sentences, bytes removed, runs removed) of a text, without the sentences of the spans from ``later`` on."""
    found = split(text)
    gone = {k for i in later for k in range(i, i + SPAN)}
    kept, at, removed = [], 0, 0
    for k in sorted(gone):
        start, end, _ = found[k]
        kept.append(text[at:start])
        removed += len(text[start:end].encode())
        at = end
    return "".join([*kept, text[at:]]), len(found), removed, sum(k - 1 not in gone for k in gone)


def dedup(documents: DataFrame) -> DataFrame:
    """documents' rows with kept (text left), n_bytes, n_sentences, n_removed (bytes) and n_spans (runs removed) added.

    Every sentence of a span that also starts earlier - in a smaller doc_id, or before in the same text - is removed;
    spans are judged on the input. Null text counts as empty and keeps ''. Null doc_ids come first. Rows equal in doc_id
    and text are one document, each returned alike; different texts under one doc_id go by a hash of the text. An empty
    table gives none. Added names replace the input's columns of the same names.
    """
    added = ["kept", "n_bytes", "n_sentences", "n_removed", "n_spans"]
    columns = documents.drop(*added).columns
    keyed = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), doc_key(documents).alias("doc"), F.xxhash64("text").alias("h"), "text")
    later = repeated(keyed.select("doc", "h", "text"))
    joined = keyed.join(later, ["doc", "h"], "left").select("row", "text", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in added]
            for text, x in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist(), strict=True):
                kept, sentences, removed, runs = cut(text or "", x or [])
                for c, v in zip(cols, (kept, len((text or "").encode()), sentences, removed, runs), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["row", *added])

    schema = f"row {keyed.schema['row'].dataType.simpleString()}, kept string, n_bytes long, n_sentences long, n_removed long, n_spans long"
    return joined.mapInArrow(run, schema).select("row.*", *added)


def report(documents: DataFrame) -> DataFrame:
    out = dedup(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_sentences", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s).*?(?:[.!?…]+["''”’»)\]]*WS+|[。！？]+["”’」』）]*WS*|\nWS*|$)') AS p FROM documents),
parts AS MATERIALIZED (SELECT doc_id, i, p[i] AS raw, trim(regexp_replace(p[i], 'WS+', ' ', 'g')) AS f FROM d, unnest(range(1, len(p) + 1)) AS u(i)),
sent AS MATERIALIZED (SELECT doc_id, i, f, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM parts WHERE f <> ''),
span AS (SELECT doc_id, k, md5(f) AS a, md5(lead(f, 1) OVER w) AS b, md5(lead(f, 2) OVER w) AS c FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
later AS (SELECT doc_id, k FROM span WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, k + o AS k FROM later, range(3) AS r(o)),
cut AS (SELECT sent.doc_id, i, NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = sent.doc_id AND g.k = sent.k - 1) AS starts FROM sent JOIN gone ON gone.doc_id = sent.doc_id AND gone.k = sent.k),
per AS (SELECT doc_id, string_agg(raw, '' ORDER BY i) FILTER (starts IS NULL) AS kept, sum(strlen(raw)) FILTER (starts IS NOT NULL) AS n_removed, count(*) FILTER (starts) AS n_spans, count(*) FILTER (f <> '') AS n_sentences
  FROM parts LEFT JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(strlen(t) AS BIGINT) AS n_bytes, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
""".replace("WS", r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
