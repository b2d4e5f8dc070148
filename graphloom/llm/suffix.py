"""Suffix-array dedup of 100-byte strings, by column-wise construction over a collection of pieces.

Pieces. A window is WINDOW consecutive bytes of a text; its anchor is its least GRAM-byte substring under a hash,
leftmost if equal. Windows in a row with one anchor make a piece, so equal windows lie in pieces with equal anchors.
Anchors that occur once can't hold a repeat; equal pieces are merged before anything else is compared.

Columns. The distinct pieces of repeated anchors are a collection of short documents. Each round inserts one more symbol
of every piece, from its end on, into the Burrows-Wheeler transform of all suffixes so far and updates the common
prefixes; both live in external files that a round reads and writes in sequence, of a collection that is bounded but for
the pieces of one anchor. At the end suffixes in a run of common prefixes of WINDOW bytes are equal windows, and all but
the first in (doc_id, position) are repeats. Equal pieces, named by 128 hash bits, enter the collection once: a window
of a later copy is a repeat because its piece is.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_key, small_batches, stash
from .textops import as_bytes, buffers, mix, prefix_hash, rolling_hash, span_hash

WINDOW, GRAM = 100, 24
#: Bytes of pieces that one collection takes.
COLLECTION = 1 << 20
_LOW = np.uint64((1 << 31) - 1)
#: What dedup adds.
ADDED = ("kept", "n_bytes", "n_removed", "n_spans")


def anchors(buf: np.ndarray, base: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the texts packed in buf (text i is buf[base[i]:base[i + 1] - 1]): text, start, windows, anchor hash."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(np.uint64)
    grams = rolling_hash(prefix, GRAM)
    coded = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span = WINDOW - GRAM + 1
    windows = n - WINDOW + 1
    # Sliding minimum: each stretch of ``span`` is the end of one block and the start of the next.
    pad = -len(coded) % span
    blocks = np.concatenate([coded, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & _LOW
    least = least.astype(np.int64)
    text = np.repeat(np.arange(len(base) - 1), np.diff(base))[:windows]
    inside = np.arange(windows) + WINDOW <= base[1:][text] - 1
    new = np.empty(windows, bool)
    new[0] = inside[0]
    new[1:] = inside[1:] & (~inside[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1]))
    start = np.flatnonzero(new)
    piece = np.cumsum(new)[inside] - 1
    return text[start], start, np.bincount(piece, minlength=len(start)), grams[least[start]]


def _pieces(documents: DataFrame) -> DataFrame:
    """(anchor, piece, doc, h, start, n) of every piece; piece is a hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            doc, h = batch.column("doc").to_numpy(), batch.column("h").to_numpy()
            for lo, hi in buffers(texts):
                buf = np.frombuffer(b"\n".join(texts[lo:hi]) + b"\n", np.uint8)
                base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[lo:hi]])]).astype(np.int64)
                prefix = prefix_hash(buf)
                text, start, n, anchor = anchors(buf, base, prefix)
                if len(start):
                    piece = mix(span_hash(prefix, start, start + n + WINDOW - 1) + np.uint64(7))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(doc[lo + text]), pa.array(h[lo + text]),
                        pa.array(start - base[text]), pa.array(n.astype(np.int16))], names=["anchor", "piece", "doc", "h", "start", "n"])

    return documents.mapInArrow(run, "anchor long, piece long, doc long, h long, start long, n short")


class _File:
    """An array kept in an external file, read and written in sequence."""

    def __init__(self, folder: str, dtype):
        self.file, self.dtype = tempfile.TemporaryFile(dir=folder), np.dtype(dtype)

    def write(self, parts) -> None:
        self.file.seek(0)
        self.file.truncate()
        for p in parts:
            self.file.write(memoryview(np.ascontiguousarray(p, self.dtype)).cast("B"))

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.dtype)

    def close(self) -> None:
        self.file.close()


def equal_windows(pieces: list[bytes], folder: str | None = None, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, class) of every width-byte window: windows of one class, and no others, are equal.

    Column-wise: in round j the suffixes of length j of all pieces enter the transform. A suffix's place follows from
    the place of the one it extends: symbols before it in the transform, counted by a stable sort. The common prefix with
    its neighbour is one more than the least between the two suffixes they extend, and is kept up to ``width``.
    """
    m = len(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum(size)
    files = _File(folder, np.uint8), _File(folder, np.uint8), _File(folder, np.uint32), _File(folder, np.bool_)
    transform, common, name, over = files
    # Symbols that nothing precedes in the transform are marked in ``over``.
    first = np.where(size > 0, data[np.maximum(end - 1, 0)] if len(data) else 0, 0).astype(np.uint8)
    transform.write([first])
    common.write([np.zeros(m, np.uint8)])
    name.write([np.arange(m, dtype=np.uint32) << np.uint32(8)])
    over.write([size == 0])
    fresh = np.ones(m, bool)
    for j in range(1, int(size.max(initial=0)) + 1):
        b, lcp, ids, ended = transform.read(), common.read(), name.read(), over.read()
        live = np.flatnonzero(~ended)
        order = live[np.argsort(b[live], kind="stable")]
        # What was fresh (length j - 1) is extended now; the rest already has its extension in the transform.
        new = np.concatenate([np.zeros(m, bool), fresh[order]])
        total = len(new)
        owner = ids[order[new[m:]]] >> np.uint32(8)
        at = end[owner] - j - 1
        done = size[owner] <= j
        nb, nl, ni, no = np.empty(total, np.uint8), np.empty(total, np.uint8), np.empty(total, np.uint32), np.empty(total, bool)
        nb[new], nb[~new] = data[np.maximum(at, 0)], b
        ni[new], ni[~new] = (owner << np.uint32(8)) | np.uint32(min(j, 255)), ids
        no[new], no[~new] = done, ended
        nl[~new] = lcp
        # Common prefixes change where either neighbour is new.
        touched = np.flatnonzero(new | np.concatenate([[False], new[:-1]]))
        touched = touched[touched >= m]
        low, high = order[np.maximum(touched - m - 1, 0)], order[touched - m]
        extends = (touched > m) & (b[low] == b[high])
        nl[touched] = 0
        if extends.any():
            nl[touched[extends]] = np.minimum(_least(lcp, low[extends] + 1, high[extends]).astype(np.int32) + 1, width)
        transform.write([nb])
        common.write([nl])
        name.write([ni])
        over.write([no])
        fresh = new
    lcp, ids = common.read(), name.read()
    run = np.cumsum(lcp < width)
    length = (ids & np.uint32(255)).astype(np.int64)
    whole = length >= width
    owner = (ids[whole] >> np.uint32(8)).astype(np.int64)
    for f in files:
        f.close()
    return owner, size[owner] - length[whole], run[whole]


def _least(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int = 32) -> np.ndarray:
    """Minimum of a[lo:hi + 1] for each pair: by columns of block minima and their sparse table."""
    n = -(-len(a) // block)
    padded = np.full(n * block, 255, np.uint8)
    padded[: len(a)] = a
    table = [padded.reshape(n, block).min(1)]
    out = np.full(len(lo), 255, np.uint8)
    short = hi - lo < 2 * block
    # Short ranges: step through them together.
    i, p, q = np.flatnonzero(short), lo[short].copy(), hi[short]
    while len(i):
        out[i] = np.minimum(out[i], padded[p])
        p = p + 1
        more = p <= q
        i, p, q = i[more], p[more], q[more]
    i = np.flatnonzero(~short)
    if len(i):
        l, h = lo[i], hi[i]
        lb, hb = l // block + 1, h // block - 1
        column = np.arange(block)
        head = padded[np.minimum(l[:, None] + column, len(padded) - 1)]
        tail = padded[np.maximum(h[:, None] - column, 0)]
        out[i] = np.minimum(head.min(1), tail.min(1))
        inner = lb <= hb
        i, lb, hb = i[inner], lb[inner], hb[inner]
        if len(i):
            k = np.log2(hb - lb + 1).astype(np.int64)
            for level in range(int(k.max()) + 1):
                if level:
                    t, d = table[-1], 1 << (level - 1)
                    table.append(np.minimum(t, np.concatenate([t[d:], np.full(min(d, len(t)), 255, np.uint8)])[: len(t)]))
                s = k == level
                if s.any():
                    t = table[level]
                    out[i[s]] = np.minimum(out[i[s]], np.minimum(t[lb[s]], t[hb[s] - (1 << level) + 1]))
    return out


def _contents(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (anchor, piece, doc, h, start, n) with the pieces' bytes.

    Repeated rows meet in one task, where all but the first are passed over; a task that Spark splits may give a piece
    once for each part.
    """
    per = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("anchor", "piece", "start", "n")).alias("p"))
    joined = documents.join(per.hint("shuffle_hash"), ["doc", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = list(zip(batch.column("doc").to_pylist(), batch.column("h").to_pylist(), strict=True))
            rows = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    rows.append(i)
            if not rows:
                continue
            texts = as_bytes(batch.column("text").take(pa.array(rows)))
            lists = batch.column("p").take(pa.array(rows))
            p, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
            start, n = p.field("start").to_numpy(), p.field("n").to_numpy().astype(np.int64)
            first = np.concatenate([[0], np.cumsum(count)])
            doc, h = (np.repeat(batch.column(c).to_numpy()[rows], count) for c in ("doc", "h"))
            # Pieces overlap, so what a batch holds is let out in parts of a few MB.
            cuts = np.flatnonzero(np.diff(np.cumsum(np.bincount(np.repeat(np.arange(len(rows)), count), n + WINDOW, len(rows))) // COLLECTION)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                u, v = int(first[lo]), int(first[hi])
                ends = (start[u:v] + n[u:v] + WINDOW - 1).tolist()
                own = np.repeat(np.arange(lo, hi), count[lo:hi]).tolist()
                found = [texts[o][x:y] for o, x, y in zip(own, start[u:v].tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    p.field("anchor").slice(u, v - u), p.field("piece").slice(u, v - u), pa.array(doc[u:v]), pa.array(h[u:v]), pa.array(start[u:v]),
                    pa.array(found, pa.binary())], names=["anchor", "piece", "doc", "h", "start", "bytes"])

    return joined.select("doc", "h", "text", "p").mapInArrow(run, "anchor long, piece long, doc long, h long, start long, bytes binary")


def shared_span(pieces: list[bytes], anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of what of each piece, around its anchor, may lie in a window that another piece holds too.

    A window holds its anchor, so on either side it reaches no further than the longest context that the piece shares
    with another of its anchor. These are found by hashes of growing contexts. Pieces are distinct, and none holds one
    window twice (equal windows have their anchor at one distance).
    """
    n, size = len(pieces), np.array([len(p) for p in pieces], np.int64)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum(size)
    start = end - size
    prefix = prefix_hash(buf)
    owner = np.repeat(np.arange(n), size)
    gram = rolling_hash(prefix, GRAM)
    hit = np.flatnonzero(gram == anchor[owner[: len(gram)]])
    hit = hit[hit + GRAM <= end[owner[hit]]]
    who, first = np.unique(owner[hit], return_index=True)
    at = np.full(n, -1, np.int64)
    at[who] = hit[first]
    assert (at >= 0).all(), "a piece without its anchor"
    reach = []
    for room, span in ((at - start, lambda i, k: (at[i] - k, at[i] + GRAM)), (end - at - GRAM, lambda i, k: (at[i], at[i] + GRAM + k))):
        best = np.zeros(n, np.int64)

        def spread(i: np.ndarray, k: np.ndarray, best=best, span=span) -> np.ndarray:
            """Those of pieces i that share a context of length k with another; best goes up to k."""
            _, back, count = np.unique(span_hash(prefix, *span(i, k)), return_inverse=True, return_counts=True)
            i = i[count[back] > 1]
            best[i] = np.maximum(best[i], k[count[back] > 1] if len(k) else 0)
            return i

        live = np.arange(n)
        for k in range(4, WINDOW - GRAM + 1, 4):
            live = live[room[live] >= k]
            if not len(live):
                break
            live = spread(live, np.full(len(live), k))
        for k in range(1, WINDOW - GRAM + 1):
            if k % 4:
                i = np.flatnonzero((best >= k - k % 4) & (best < k) & (best + 4 > k) & (room >= k))
                # Pieces that reach further share this length too, so they are counted along.
                j = np.flatnonzero((best >= k) & (room >= k))
                if len(i):
                    spread(np.concatenate([i, j]), np.full(len(i) + len(j), k))
        reach.append(best)
    return at - start - reach[0], at - start + GRAM + reach[1]


def _judged(contents: DataFrame) -> DataFrame:
    """(anchor, piece, gone): a bit for each window of the piece's first place, set if an equal window is earlier.

    A partition's pieces are one collection after another, each of whole anchors while they fit COLLECTION bytes.
    """

    def judge(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("anchor").to_numpy(), rows.column("piece").to_numpy()
        again = (key[0][1:] == key[0][:-1]) & (key[1][1:] == key[1][:-1])
        if again.any():
            rows = rows.take(np.flatnonzero(np.concatenate([[True], ~again])))
        doc, h, start = (rows.column(c).to_numpy() for c in ("doc", "h", "start"))
        data = rows.column("bytes").to_pylist()
        lo, hi = shared_span(data, rows.column("anchor").to_numpy().view(np.uint64))
        # Of equal spans the first place stands for all; every window of the others is a repeat.
        members = np.flatnonzero(hi - lo >= WINDOW)
        members = members[np.lexsort(((start + lo)[members], h[members], doc[members]))]
        heads: dict[bytes, int] = {}
        flags = [np.zeros(len(d) - WINDOW + 1, np.uint8) for d in data]
        for i in members.tolist():
            if heads.setdefault(data[i][lo[i] : hi[i]], i) != i:
                flags[i][lo[i] : hi[i] - WINDOW + 1] = 1
        with tempfile.TemporaryDirectory() as folder:
            piece, offset, cls = equal_windows(list(heads), folder)
        piece = np.array(list(heads.values()), np.int64)[piece]
        offset = offset + lo[piece]
        at = start[piece] + offset
        order = np.lexsort((at, h[piece], doc[piece], cls))
        later = np.concatenate([[False], cls[order][1:] == cls[order][:-1]]) if len(order) else np.zeros(0, bool)
        first = np.concatenate([[0], np.cumsum([len(f) for f in flags])])
        flat = np.concatenate(flags)
        hit = order[later]
        flat[first[piece[hit]] + offset[hit]] = 1
        bits = [np.packbits(flat[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.RecordBatch.from_arrays([rows.column("anchor").combine_chunks(), rows.column("piece").combine_chunks(), pa.array(bits, pa.binary())], names=["anchor", "piece", "gone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size >= COLLECTION and held[0].column("anchor")[0] != batch.column("anchor")[batch.num_rows - 1]:
                t = pa.Table.from_batches(held)
                keys = t.column("anchor").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                yield judge(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                size = sum(b.column("bytes").nbytes for b in held)
        if held:
            yield judge(pa.Table.from_batches(held))

    return contents.repartition("anchor").sortWithinPartitions("anchor", "piece").mapInArrow(run, "anchor long, piece long, gone binary")


def repeated(documents: DataFrame) -> DataFrame:
    """(doc, h, spans): for each text with repeated windows their runs, array<struct<start, n windows, gone>>.

    ``documents`` has (doc, h, text). gone is null where every window of the run is a repeat.
    """
    small_batches(documents.sparkSession)
    every = stash(_pieces(documents))
    # Written, so that both sides of the join are plain exchanges, whose large partitions Spark splits: one anchor may have a third of the rows.
    often = stash(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"))
    places = stash(every.join(often, "anchor", "left_semi"))
    discard(every, often)
    merged = stash(places.groupBy("anchor", "piece").agg(F.min(F.struct("doc", "h", "start", "n")).alias("f"), F.count(F.lit(1)).alias("c")).select("anchor", "piece", "f.*", "c"))
    several = stash(merged.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor"))
    judged = stash(_judged(_contents(documents, merged.join(several, "anchor", "left_semi").drop("c"))))
    discard(several)
    kept = F.regexp_replace(F.hex("gone"), "0", "") != ""
    first = merged.join(judged.filter(kept), ["anchor", "piece"]).select("doc", "h", "start", "n", "gone")
    again = merged.filter("c > 1").select("anchor", "piece", F.struct("doc", "h", "start").alias("f"))
    rest = places.join(again, ["anchor", "piece"]).filter(F.struct("doc", "h", "start") != F.col("f")).select("doc", "h", "start", "n", F.lit(None).cast("binary").alias("gone"))
    return first.unionByName(rest).groupBy("doc", "h").agg(F.collect_set(F.struct("start", "n", "gone")).alias("spans"))


def removed_bytes(base: np.ndarray, spans: pa.ListArray) -> np.ndarray:
    """Whether each byte of some texts in a row (text i from base[i] to base[i + 1]) is in a repeated window."""
    delta = np.zeros(int(base[-1]) + 1, np.int32)
    s = spans.flatten()
    if len(s):
        text = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
        start, n = base[text] + s.field("start").to_numpy(), s.field("n").to_numpy().astype(np.int64)
        gone = s.field("gone")
        whole = gone.is_null().to_numpy(zero_copy_only=False)
        np.add.at(delta, start[whole], 1)
        np.add.at(delta, (start + n + WINDOW - 1)[whole], -1)
        part = np.flatnonzero(~whole)
        if len(part):
            bits = gone.take(pa.array(part)).to_pylist()
            end = np.cumsum([8 * len(x) for x in bits])
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)))
            of = np.searchsorted(end, hit, "right")
            at = start[part[of]] + hit - (end[of] - 8 * ((n[part[of]] + 7) // 8))
            np.add.at(delta, at, 1)
            np.add.at(delta, at + WINDOW, -1)
    return np.cumsum(delta[:-1], dtype=np.int32) > 0


def dedup(documents: DataFrame) -> DataFrame:
    """documents' rows with kept (bytes left), n_bytes, n_removed and n_spans added.

    Every byte covered by a WINDOW-byte string that also starts earlier - in a smaller doc_id, or before in the same
    text - is removed; strings are judged on the input. Null text counts as empty and keeps ''. Null doc_ids come
    first. Rows equal in doc_id and text are one document, each returned alike; different texts under one doc_id go
    by a hash of the text. An empty table gives none. Added names replace the input's columns of the same names.
    """
    return _dedup(documents, documents.drop(*ADDED).columns).select("row.*", *ADDED)


def _dedup(documents: DataFrame, columns: list[str]) -> DataFrame:
    """(row, kept, n_bytes, n_removed, n_spans), row a struct of ``columns``."""
    keyed = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), doc_key(documents).alias("doc"), F.xxhash64("text").alias("h"), "text")
    spans = repeated(keyed.select("doc", "h", "text"))
    joined = keyed.join(spans, ["doc", "h"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, spans = as_bytes(batch.column("text")), batch.column("row"), batch.column("spans")
            for lo, hi in buffers(texts):
                size = np.array([len(t) for t in texts[lo:hi]], np.int64)
                base = np.concatenate([[0], np.cumsum(size)])
                gone = removed_bytes(base, spans.slice(lo, hi - lo))
                left = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)[~gone]
                removed = np.searchsorted(np.flatnonzero(gone), base)
                # A run opens where the byte before is left or belongs to another text.
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                opens[base[:-1][size > 0]] = gone[base[:-1][size > 0]]
                runs = np.searchsorted(np.flatnonzero(opens), base)
                kept = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((base - removed).astype(np.int32)), pa.py_buffer(left)])
                yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), kept, pa.array(size), pa.array(np.diff(removed)), pa.array(np.diff(runs))], names=["row", *ADDED])

    schema = f"row {keyed.schema['row'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long"
    return joined.mapInArrow(run, schema)


def report(documents: DataFrame) -> DataFrame:
    out = dedup(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(documents: DataFrame) -> DataFrame:
    """documents' columns, whatever their names: texts without repeated bytes (parts of a cut character go too), n_chars
    counted anew where there is one.

    Texts without a repeated byte, null and empty ones too, stay as they are; a text of which nothing is left goes with
    its row. Repeated rows, null ids and empty tables are as in dedup.
    """
    cut = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    out = _dedup(documents, documents.columns).withColumn("text", F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(cut))
    new = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(documents.schema["n_chars"].dataType)
    out = out.filter((F.col("n_removed") == 0) | (F.length("text") > 0))
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns))
