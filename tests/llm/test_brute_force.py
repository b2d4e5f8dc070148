"""Operators without SQL against plain versions of what they do."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import ann, chat, jaccard, langid, mixing, quality, sentences, suffix, toxicity


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    w = words(text)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar_pairs(texts, threshold):
    s = [shingles(t) for t in texts]
    return {(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]) - 1e-9}


def groups(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def near_copies(rng, n, changes):
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 90))]
        for c in changes:
            t = list(base)
            for _ in range(c):
                t[rng.randrange(len(t))] = f"x{rng.randrange(400)}"
            out.append(" ".join(t))
    return out


def test_jaccard_at_other_thresholds(spark):
    texts = near_copies(random.Random(5), 25, (0, 1, 2, 3, 5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.5, 0.8):
        pairs = similar_pairs(texts, threshold)
        links = [sum(i in p for p in pairs) for i in range(len(texts))]
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs, threshold).collect()}
        assert pairs and got == {i: (g, links[i]) for i, g in enumerate(groups(len(texts), pairs))}


def test_recall_bounds():
    assert jaccard.runs_for(0.9999) > jaccard.runs_for(0.99) and jaccard.agreements(0.8) > jaccard.agreements(0.5)
    kept = 1 - math.exp(-1)
    for _ in range(jaccard.LEVELS):
        kept = 1 - math.exp(-kept)
    assert 1 - (1 - kept) ** jaccard.runs_for(0.9999) > 0.999


def test_keep_one_edges(spark):
    t = " ".join(f"a{i}" for i in range(30))
    near, other = t + " tail", " ".join(f"b{i}" for i in range(30))
    rows = [(0, t), (0, t), (3, near), (None, other), (None, "lone text of no one else at all"), (5, other), (7, t), (7, "of the same id but another text"), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, _gone int, h int")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in jaccard.keep_one(docs).collect()))
    want = {(0, t), (None, other), (None, rows[4][1]), (7, rows[7][1]), (8, None), (9, "")}
    assert got == sorted((i is not None, i or 0, x or "") for i, x in want)
    assert jaccard.keep_one(docs).columns == docs.columns and jaccard.keep_one(docs.limit(0)).count() == 0


def test_cut_repeats_keeps_foreign_columns(spark):
    rng = random.Random(2)
    a = " ".join(f"u{rng.randrange(999)}" for _ in range(60))
    docs = spark.createDataFrame([(1, a, 5, "h1", "k"), (2, "start#" + a[20:260] + "#end", 6, "h2", "k"), (3, a, 7, "h3", "k"), (4, None, 8, "h4", "k"), (5, "", 9, "h5", "k")], "doc_id long, text string, n_bytes int, _h string, kept string")
    got = {r.doc_id: r for r in suffix.cut_repeats(docs).collect()}
    assert suffix.cut_repeats(docs).columns == docs.columns and set(got) == {1, 2, 4, 5}
    assert got[1].text == a and got[4].text is None and got[5].text == "" and got[2].text == "start##end"
    assert [(got[i].n_bytes, got[i]._h, got[i].kept) for i in (1, 2, 4)] == [(5, "h1", "k"), (6, "h2", "k"), (8, "h4", "k")]
    assert {r._h for r in sentences.dedup(docs).collect()} == {f"h{i}" for i in range(1, 6)}


def naive_phrases(text, train):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in train:
            k += 1
        i, n = i + max(1, k - 1), n + 1
    return n


def test_phrases_of_whole_texts():
    trained = [("a", "the cat and the dog ran over the hill and the cat sat down "), ("b", "le chat et le chien vont sur la colline et le chat dort 𐐨 "), ("c", "中文也行的")]
    rng = random.Random(1)
    texts = ["".join(rng.choice("the catdogr lchinsuoe𐐨z中文") for _ in range(rng.choice([0, 1, 5, 255, 256, 257, 600, 3000]))) for _ in range(40)]
    texts += [" ".join(rng.choice(["the cat and the", "le chat", "dog ran over", "xyz"]) for _ in range(300)), trained[0][1] * 20]
    got = langid.count_phrases([np.array([ord(c) for c in t], np.uint32) for t in texts], trained)
    assert got.tolist() == [[naive_phrases(t, x) for _, x in trained] for t in texts]


def test_letters_beyond_the_first_plane(spark):
    assert [len(langid.letters(x.encode())) for x in ("😀😀", "123 !", "𐐀𐐁", "")] == [0, 0, 2, 0]
    docs = spark.createDataFrame([(0, "😀😀", None), (1, "abab", "x"), (3, "cdcd", "y"), (2, "𐐨c", None), (2, "𐐨c", None)], "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(docs, [("x", "abab"), ("y", "cd𐐨cd")]).collect())
    assert got == [(0, "und"), (1, "x"), (2, "y"), (2, "y"), (3, "y")]


def test_folding():
    for x in ("1dі0T!", "𝐢𝐝𝐢𝐨𝐭", "ｉｄｉｏｔ", "ídiót", "i.d.i.o.t", "i d i o t", "ⓘⓓⓘⓞⓣ", "🅸🅳🅸🅾🆃", "İdiot", "ɪᴅɪᴏᴛ", "i​diot", "ιδ".replace("δ", "d") + "iot"):
        assert toxicity.fold(x.encode()) == " idiot ", x
    assert [toxicity.fold(x.encode()) for x in ("", "!!", "a b", "ﬁsh łódź")] == ["  ", "  ", " a b ", " fish lodz "]


def test_lexicon_scan(spark):
    rng = random.Random(3)
    lexicon = {" idio": 2.0, " idiot ": 3.0, " scum ": 1.5, " dum": 0.5}
    exempt = frozenset({"no idiot here", "idiot here now", "the scum"})
    texts = [" ".join(rng.choice(["idiot", "idi0ts", "no", "here", "now", "the", "scum", "dumb", "fine"]) for _ in range(rng.randrange(40))) for _ in range(50)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def plain(text):
        t, total = toxicity.fold((text or "").encode()), 0.0
        free = [(m, m + len(e) + 1) for e in exempt for m in range(len(t)) if t.startswith(f" {e} ", m)]
        for p in range(len(t)):
            hits = [w for e, w in lexicon.items() if t.startswith(e, p)]
            if hits and not any(a <= p < b for a, b in free):
                total += max(hits)
        return total

    got = {r.doc_id: (r.hit, r.n_words) for r in toxicity.hits(docs, lexicon, exempt, ["doc_id"]).collect()}
    assert any(h for h, _ in got.values()) and got == {i: (plain(t), len(toxicity.fold((t or "").encode()).split())) for i, t in enumerate(texts)}


def plain_statistics(text):
    t = text or ""
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if x]
    per_char, per_word = max(1, len(t)), max(1, len(w))
    upper, letter = lambda c: c.isupper(), lambda c: c.isalpha() or c.isnumeric()
    return [
        math.log1p(len(w)), math.log1p(len(t)), len(t) / per_word, sum(map(upper, t)) / per_char,
        sum(not letter(c) and c not in " \t\n\x0b\f\r.,;:!?'\"()-" for c in t) / per_char, t.count("!") / per_char, sum(c in "0123456789" for c in t) / per_char,
        len(set(w)) / per_word, sum(a == b for a, b in zip(w, w[1:], strict=False)) / per_word, t.count("\n") / per_word, len(re.findall(r"[.!?](?=[ \t\n\x0b\f\r]|$)", t)) / per_word]


def test_rules_as_columns(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["word ", "Word. ", "!! ", "12 ", "\n", "~# ", "é ", "same same "]) for _ in range(rng.randrange(60))) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    x = np.array([plain_statistics(t) for t in texts])
    got = quality.with_statistics(docs, ["doc_id"]).orderBy("doc_id").toPandas()[list(quality.FEATURES)].to_numpy(float)
    assert np.allclose(got, x)
    labels = spark.createDataFrame([(i, int("!!" not in (t or "!!"))) for i, t in enumerate(texts)], "doc_id long, quality int")
    intercept, rules = quality.fit(docs, labels)
    assert rules and all(1 <= len(r) <= quality.DEPTH for _, r in rules)
    margin = intercept + sum(w * np.all([(x[:, f] <= c) if below else (x[:, f] > c) for f, below, c in rule], 0) for w, rule in rules)
    score = {r.doc_id: r.score for r in quality.score(docs, (intercept, rules), ["doc_id"]).collect()}
    assert np.allclose([score[i] for i in range(len(texts))], 1 / (1 + np.exp(-margin)))
    kept = quality.drop_rejected(docs.withColumn("_score", F.lit("mine")).withColumn("a.b", F.lit(1)).withColumn("_row", F.lit(2)), labels)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if score[i] >= quality.THRESHOLD] and kept.columns == ["doc_id", "text", "_score", "a.b", "_row"]


def plain_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left = {}, set(names)
    rest = float(sum(sizes.values()))
    while left:
        full = {s for s in left if most * sizes[s] < rest * w[s] / sum(w[x] for x in left)}
        if not full:
            return out | {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        for s in full:
            out[s] = most * sizes[s]
        rest, left = rest - sum(out[s] for s in full), left - full
    return out


def test_targets_by_enumeration(spark):
    rng = random.Random(4)
    for n in (1, 3, 40):
        sizes = {f"s{rng.randrange(10**6)}": rng.choice([0, 1, 7, 100, 5000]) for _ in range(n)} | {None: 11, "é": 3}
        df = spark.createDataFrame([("=" + s if s is not None else "null", s, z) for s, z in sizes.items()], "key string, source string, source_size long")
        got = {r.key: r.target for r in mixing.source_targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == {"=" + s if s is not None else "null" for s in want} and all(math.isclose(got["=" + s if s is not None else "null"], t, rel_tol=1e-9, abs_tol=1e-9) for s, t in want.items())
    assert mixing.source_targets(df.limit(0)).count() == 0


def test_mix_adds_up(spark):
    rng = random.Random(9)
    rows = [(i if i % 9 else None, " ".join(["w"] * rng.randrange(30)) if i % 11 else None, rng.choice(["a", "a", "a", "b", None]), "mine") for i in range(300)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _d string")
    got = mixing.report(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source_size, round(r.target, 6)] = by.get((r.source_size, round(r.target, 6)), 0) + r.taken
    assert all(abs(by[sizes[s], round(want[s], 6)] - want[s]) <= 3 for s in want) and len(got) == len(rows)
    dealt = mixing.deal(docs)
    assert dealt.columns == [*docs.columns, "copy", "words", "shard", "place"]
    seen = {}
    for r in dealt.collect():
        seen[r.source] = seen.get(r.source, 0) + r.words
        assert r._d == "mine" and 0 < r.words <= size(r.text) and 0 <= r.shard < mixing.SHARDS
    assert all(abs(seen[s] - want[s]) <= 3 for s in want)


def test_chat_escapes_every_control_string(spark):
    rng = random.Random(7)
    marks = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[ROLE", "[/ROLE]", "\\", "[\\INST]", "<\\\\s>", "<", "[", "]", " ", "ok", "%5D", "\n", "s>", "INST]"]
    rows = [(i, t, rng.choice(["user", "assistant", "system", "tool", "a]b%<s>", None, "ROLE"]), "".join(rng.choice(marks) for _ in range(rng.randrange(8)))) for i in range(80) for t in range(rng.randrange(1, 4))]
    rows += [(-5, 0, "user", "hello [INST] evil <s> x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(conv).withColumn("spans", chat.loss_spans(F.col("formatted"))).collect()}
    control = re.compile(r"[<\[]/?(?:s>|INST\]|SYS\]|ROLE)")
    frame = {"user": 2, "assistant": 2, "system": 2}
    for c, r in out.items():
        src = [((role or ""), text) for i, t, role, text in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in r.turns] == src and r.round_trip
        assert len(control.findall(r.formatted)) == sum(frame.get(role, 2) for role, _ in src), r.formatted
        unescape = lambda s: re.sub(r"([<\[])\\(\\*)(/?(?:s>|INST\]|SYS\]|ROLE))", r"\1\2\3", s)
        assert [unescape(r.formatted[s.start : s.start + s.length]) for s in r.spans] == [t for role, t in src if role == "assistant"]
    assert out[-5].escaped and "[\\INST] evil <\\s>" in out[-5].formatted


def test_candidates_and_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:40]
    score = q @ x.T
    found = [np.flatnonzero(score[i] >= np.sort(score[i])[-21]) for i in range(len(q))]
    share = recall = 0.0
    for i, near in enumerate(ann.Tables(x, 1.0, False).candidates(q, ann.candidate_share(len(x)))):
        share, recall = share + len(near) / len(x) / len(q), recall + np.isin(found[i], near).mean() / len(q)
    assert recall >= 0.9 and share <= 0.2
