import hashlib
import random

import numpy as np
import pyarrow as pa

from graphloom.llm import common, suffix


def brute(rows, width=100):
    """{(doc_id, text): kept_sha256}; rows equal in both are one document."""
    seen, out = set(), {}
    for key in sorted(set(rows)):
        b = key[1].encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if b[k : k + width] in seen:
                gone[k : k + width] = [True] * width
            seen.add(b[k : k + width])
        out[key] = hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


def test_repeated_rows_with_near_copies(spark):
    rng = random.Random(6)
    a, b = (" ".join("".join(rng.choices("abcdef", k=6)) for _ in range(60)) for _ in range(2))
    near = a[:200] + "X" + a[201:]
    rows = [(1, a), (1, a), (1, a), (2, near), (2, near), (3, b[:150] + a[:180]), (4, b), (4, b)]
    out = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    assert {(r.doc_id, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out} == {(d, sha) for (d, _), sha in want.items()}
    assert all(r.n_removed == 0 for r in out if r.doc_id == 1)


def test_runs_end_with_their_text():
    """Texts that lie side by side in a buffer, the first removed up to its end and the next from its start."""
    spans = pa.array([[{"start": 0, "n": 1, "gone": None}], None, [{"start": 0, "n": 3, "gone": bytes([0b10100000])}], []],
                     pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int16()), ("gone", pa.binary())])))
    base = np.cumsum([0, 100, 0, 105, 7])
    for at, want in ((0, [True] * 100 + [True] * 102 + [False] * 10), (1, [True] * 102 + [False] * 10)):
        gone = suffix.removed_bytes(base[at:] - base[at], spans.slice(at))
        assert gone.tolist() == want


def test_discarded_tables_are_gone(spark):
    t = common.stash(spark.range(3))
    path = common._written[t]
    assert t.count() == 3
    common.discard(t)
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
