import hashlib
import random

from graphloom.llm import sentences
from graphloom.llm.queries import queries


def brute(rows, span=3):
    """{(doc_id, text): (n_removed, kept_sha256)} by a plain scan of sentences in (doc_id, place)."""
    seen, out = set(), {}
    for key in sorted(set(rows)):
        found, start, text = [], 0, key[1]
        for k, c in enumerate(text):
            if c == "\n" or (c in ".!?" and k + 1 < len(text) and text[k + 1] == " "):
                found.append(text[start : k + 1])
                start = k + 1
        found.append(text[start:])
        found = [x for x in found if x.strip()]
        gone = [False] * len(found)
        for i in range(len(found) - span + 1):
            s = tuple(x.strip() for x in found[i : i + span])
            if s in seen:
                gone[i : i + span] = [True] * span
            seen.add(s)
        left = "".join(x.strip() for x, g in zip(found, gone, strict=True) if not g)
        out[key] = (sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def test_sentence_spans(spark):
    assert "op4_sentence_spans" in queries()
    rng = random.Random(4)
    rows = []
    for d in range(60):
        words = [f"s{rng.randrange(9)} ü" + rng.choice(".!?") for _ in range(rng.randrange(14))]
        rows.append((d, "".join(w + rng.choice([" ", "\n"]) for w in words)))
    rows += [rows[7], rows[7], (61, rows[9][1]), (62, "A b. " * 40), (63, ""), (64, "no end"), (65, "One. Two.")]
    out = sentences.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert len(out) == len(rows) and any(n for n, _ in want.values())
    for r in out:
        n, sha = want[r.doc_id, r.text]
        kept = sentences.split(r.kept)
        assert r.n_sentences - len(kept) == n and hashlib.sha256("".join(x for _, _, x in kept).encode()).hexdigest() == sha
        assert r.n_removed == len(r.text.encode()) - len(r.kept.encode()) and r.n_bytes == len(r.text.encode())


def test_sentence_edges(spark):
    docs = spark.createDataFrame([(None, "A. B. C."), (1, "A. B.\n\n C.  D."), (2, None), (2, "x"), (3, "甲。乙！丙？甲。乙！丙？")], "doc_id long, text string")
    got = {(r.doc_id, r.text): (r.kept, r.n_sentences) for r in sentences.dedup(docs).collect()}
    assert got[None, "A. B. C."] == ("A. B. C.", 3) and got[1, "A. B.\n\n C.  D."] == ("D.", 4)
    assert got[2, None] == ("", 0) and got[2, "x"] == ("x", 1) and got[3, "甲。乙！丙？甲。乙！丙？"] == ("甲。乙！丙？", 6)
    assert sentences.report(docs.limit(0)).count() == 0
    assert "".join(t[a:b] for t in [" . ...) x?! y…\n\nz"] for a, b, _ in sentences.split(t)) == " . ...) x?! y…\n\nz"
