import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, chat, decontam, jaccard, langid, mixing, quality, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, row int"
TEXT = " ".join(f"word{i} other{i * 7 % 31}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, ties, repeated rows, a long text, and columns whose names clash with the operators'."""
    data = [(1, TEXT), (2, TEXT), (2, TEXT), (3, TEXT + " tail"), (4, None), (5, ""), (6, "short"), (None, "no id here"), (7, "aaaa " * 20000), (8, "ümlaut wörter " * 30)]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "fr", None if i == 4 else "s", 1, "x", 0, 0) for i, t in data], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, 0, 1), (6, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def brute_suffix(rows, width=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                gone[k : k + width] = True
            seen.add(w)
        out[i] = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    return out


def test_suffix(docs):
    got = {r.doc_id: r.kept_sha256 for r in suffix.report(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    want = brute_suffix([(r.doc_id, r.text) for r in docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()])
    assert got == want
    assert suffix.report(docs).count() == docs.count() and suffix.report(docs.limit(0)).count() == 0


def test_equal_windows():
    rng = np.random.default_rng(0)
    base = bytes(rng.integers(97, 100, 300).astype(np.uint8))
    pieces = [base[a : a + 20] for a in rng.integers(0, 280, 25)] + [b"aaaaaaaaaaaaaaa"]
    got, want = {}, {}
    for i, j, c in zip(*suffix.equal_windows(pieces, None, 8), strict=True):
        got.setdefault(c, set()).add((int(i), int(j)))
    for i, p in enumerate(pieces):
        for j in range(len(p) - 7):
            want.setdefault(p[j : j + 8], set()).add((i, j))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_jaccard(docs):
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in jaccard.join(docs).collect())
    assert got == [(0, 0, 0), (1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([("b1", " ".join(TEXT.split()[10:25])), ("b2", "short"), (None, None), ("b3", "")], "item_id string, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in decontam.report(docs, bench).collect()}
    assert got[1, 120] == (15, 1) and got[6, 1] == (1, 1) and got[4, 0] == (0, 0)
    assert decontam.decontaminate(docs, bench, remove="spans").count() == docs.count() - 1
    assert decontam.report(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert sorted(map(tuple, decontam.decontaminate(docs.select("doc_id", "text"), bench).drop("text").collect()), key=str) == sorted(map(tuple, decontam.report(docs, bench).collect()), key=str)


def test_chat(spark):
    data = [(1, 0, "user", "[INST] a </s>"), (1, 1, "assistant", r"[\INST] b"), (1, 2, "odd] role%", None), (2, 0, None, "x"), (None, 0, "system", ""), (1, 1, "assistant", "twin")]
    conv = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(conv).collect()
    assert all(r.round_trip for r in out) and {r.conv_id: len(r.turns) for r in out} == {1: 4, 2: 1, None: 1}
    assert {r.conv_id: r.escaped for r in out}[1] and chat.report(conv.limit(0)).count() == 1


def test_mixing(spark, docs):
    got = mixing.report(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    for _, source in {(r.source_size, r.target) for r in got}:
        assert abs(sum(r.taken for r in got if r.target == source) - source) <= 2
    assert mixing.report(docs.limit(0)).count() == 0
    q = spark.createDataFrame([("a", 40), ("b", 25)], "key string, blocks long")
    split = mixing.split_quotas(q, 7).groupBy("key").sum("n").collect()
    assert {r[0]: r[1] for r in split} == {"a": 40, "b": 25}


def test_langid(spark):
    rows = [(i, ("the cat and dog run %d " if i % 2 else "le chat et chien vont %d ") % i * 5, "en" if i % 2 else "fr") for i in range(40)] + [(90, None, "en"), (91, "123", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.report(docs).collect()}
    assert all(got[i] == ("en" if i % 2 else "fr") for i in range(40)) and got[90] == got[91] == "und"
    assert {r.lang_pred for r in langid.identify(docs, []).collect()} == {"und"}


def test_classifiers(docs, labels):
    for f in (quality, toxicity):
        got = f.report(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert {r.score for r in f.report(docs, labels.limit(0)).collect()} == {0.5} and f.report(docs.limit(0), labels).count() == 0
    assert toxicity.fold("1dі0T!".encode()) == " idiot "
    a = toxicity._automaton({" idio": 2.0, " scum ": 1.0}, frozenset({"no idiot here"}))
    assert toxicity.matched(" idiot scum scumbag ", a) == 3.0 and toxicity.matched(" no idiot here ", a) == 0.0


def test_ann(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, x[0].tolist()), (301, None), (302, [0.0] * 16), (303, [float("nan")] * 16), (None, x[1].tolist()), (5, x[5].tolist())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.report(e).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    full = np.r_[x, x[:1]]
    hit = total = 0
    for q in range(0, 301, 20):
        s = full @ full[q]
        want = [i for i in np.lexsort((np.arange(301), -s)) if i != q][:20]
        assert len(got[q]) == 20 and sorted(r for r, *_ in got[q]) == list(range(1, 21))
        hit, total = hit + len(set(want) & {v for _, v, _ in got[q]}), total + 20
    assert hit / total >= 0.9 and ann.report(e.limit(0)).count() == 0
    assert ann.report(spark.createDataFrame(rows[:3], e.schema)).count() == 2


def test_clean_keeps_rows_and_columns(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"before {item} after", 5, "x"), (1, f"before {item} after", 5, "x"), (2, item, 5, "x"), (None, "left alone", 99, None), (3, None, None, "y"), (4, "", 0, "z"), (5, "?!", 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, `a.b` string").withColumn("contaminated", F.lit("mine"))
    benchmark = spark.createDataFrame([(None, item), ("q", None)], "item_id string, text string")
    got = decontam.clean(docs, benchmark)
    assert got.columns == docs.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    cut = next(r[1] for r in kept if r[0] == 1)
    assert cut.split() == ["before", "after"]
    assert kept == sorted([(1, cut, len(cut), "x", "mine")] * 2 + [(None, "left alone", 99, None, "mine"), (3, None, None, "y", "mine"), (4, "", 0, "z", "mine"), (5, "?!", 2, "z", "mine")], key=str)
    assert sorted(map(tuple, decontam.clean(docs, benchmark.limit(0)).collect()), key=str) == sorted((r + ("mine",) for r in rows), key=str)
    assert decontam.clean(docs.limit(0), benchmark).count() == 0
