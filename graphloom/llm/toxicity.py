"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding homoglyphs and digit substitutions."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keyed_labels, small_batches
from .quality import lasso_logistic
from .textops import CodeMap, as_bytes, single_spaces

#: Labelled rows of each class that may be sampled: a bound, and so one for the lexicon and the phrases, which are theirs.
SAMPLE = 3000
STEMS = (4, 5, 6)
THRESHOLD = 0.5
#: Look-alikes of Latin letters in other scripts (what is Latin by name follows from the name), and digits and signs
#: written for letters.
LOOKS = {
    "а": "a", "в": "b", "г": "r", "е": "e", "з": "e", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ь": "b",
    "ѕ": "s", "і": "i", "ј": "j", "ѡ": "w", "ѵ": "v", "ү": "y", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ԍ": "g", "ꙅ": "s",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ռ": "n", "գ": "q", "զ": "q", "ց": "g", "յ": "j", "ա": "w", "տ": "s", "ք": "p",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ȷ": "j", "ɩ": "i", "ʋ": "v", "ɯ": "w", "ɾ": "r", "ʟ": "l", "ƽ": "s", "ſ": "s", "ʀ": "r",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "¢": "c", "€": "e", "£": "l"}
_LATIN = re.compile(r"(?:LATIN (?:SMALL|CAPITAL) LETTER|LATIN LETTER SMALL CAPITAL|REGIONAL INDICATOR SYMBOL LETTER|(?:NEGATIVE )?(?:CIRCLED|SQUARED) LATIN CAPITAL LETTER) ([A-Z])(?: WITH .*)?")
_automata: dict[str, object] = {}


def fold_char(c: str) -> str:
    """A character as the letters it is or stands for, lower-case and without marks; '' for a mark, else a space."""
    if c in SIGNS:
        return SIGNS[c]
    out = ""
    for x in unicodedata.normalize("NFKD", c):
        if unicodedata.category(x) in ("Mn", "Me", "Cf"):
            continue
        x = x.lower()
        named = _LATIN.fullmatch(unicodedata.name(x, "")) if len(x) == 1 and not x.isascii() else None
        for y in named[1].lower() if named else x:
            if unicodedata.category(y) not in ("Mn", "Me"):
                out += LOOKS.get(y, y) if y.isalpha() else SIGNS.get(y, " ")
    return out


_fold = CodeMap(fold_char)


def fold(text: bytes) -> str:
    """Lower-case, look-alikes and digit substitutions as the letters they stand for, the rest as single spaces.

    Compatibility forms count as what they stand for, accents and invisible characters go, and three or more single
    letters in a row are one word.
    """
    s = single_spaces(np.concatenate([[np.uint32(32)], _fold(text), [np.uint32(32)]]).astype(np.uint32))
    between = np.zeros(len(s), bool)
    if len(s) > 4:
        between[2:-2] = (s[2:-2] == 32) & (s[:-4] == 32) & (s[4:] == 32)
        beside = np.zeros(len(s), bool)
        beside[2:] |= between[:-2]
        beside[:-2] |= between[2:]
        s = s[~(between & beside)]
    return s.tobytes().decode("utf-32-le") if len(s) > 1 else "  "


def _tokens(text: bytes) -> set[str]:
    """Whole words as ' w ', stems as ' w', of a folded text."""
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


def learn_lexicon(sample: DataFrame, sizes: dict[int, int]) -> dict[str, float]:
    """Entry -> weight from sampled (text, y): words and stems at least 8 times as frequent in toxic texts.

    Document frequencies are counted on the executors; all frequent, telling entries come to the driver. An entry is in
    a hundredth of the sampled toxic texts, so there are at most a hundred times the entries of one such text.
    """
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    least = max(3, math.ceil(0.01 * bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(as_bytes(batch.column("text")), batch.column("y").to_pylist(), strict=True):
                got = sorted(_tokens(text))
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([int(y > 0)] * len(got), pa.int32())], names=["entry", "y"])

    small_batches(sample.sparkSession)
    counted = sample.select("text", "y").mapInArrow(run, "entry string, y int").groupBy("entry").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    weight = F.ln((F.col("a") + 0.5) / (bad + 1.0)) - F.ln((F.col("b") + 0.5) / (good + 1.0))
    kept = counted.filter(F.col("a") >= least).withColumn("w", weight).filter(F.col("w") > math.log(8))
    return {r["entry"]: float(r["w"]) for r in kept.collect()}


def _automaton(lexicon: dict[str, float], exceptions: frozenset[str]):
    import ahocorasick

    key = repr((sorted(lexicon.items()), sorted(exceptions)))
    if key not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for e, w in lexicon.items():
            a.add_word(e, (len(e), w, False))
        for e in exceptions:
            a.add_word(f" {e} ", (len(e) + 2, 0.0, True))
        if len(a):
            a.make_automaton()
        _automata[key] = a
    return _automata[key]


def matched(text: str, automaton) -> float:
    """Sum over words of the largest weight that matches at the word, none inside an exception phrase."""
    at: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    if len(automaton):
        for end, (n, w, exempt) in automaton.iter(text):
            start = end - n + 1
            if exempt:
                free.append((start, end))
            else:
                at[start] = max(w, at.get(start, 0.0))
    total, k, reach = 0.0, 0, -1
    free.sort()
    for p in sorted(at):  # the spans that start up to p reach as far as the furthest of them
        while k < len(free) and free[k][0] <= p:
            reach = max(reach, free[k][1])
            k += 1
        if p >= reach:
            total += at[p]
    return total


def hits(docs: DataFrame, lexicon: dict[str, float], exceptions: frozenset[str], keep: list[str]) -> DataFrame:
    """``keep`` columns with hit (sum of weights) and n_words of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, exceptions))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(*shared.value)
        for batch in batches:
            folded = [fold(t) for t in as_bytes(batch.column("text"))]
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([matched(t, a) for t in folded], pa.float64()), pa.array([len(t.split()) for t in folded], pa.int64())], names=[*keep, "hit", "n_words"])

    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, hit double, n_words long")


def _features(hit, n_words, log1p):
    """Strength of the matches, and the same normalised by length."""
    return log1p(hit), log1p(hit * 1000.0 / (n_words + 1.0))


def fit(documents: DataFrame, labels: DataFrame, keep: Column | None = None, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> dict:
    """Lexicon, exception phrases and the weights of the length-normalised score, from labels.toxic of admitted rows.

    ``exceptions`` are phrases (folded) inside which nothing counts; phrases of a matching word and its neighbours that
    only clean sampled texts use, twice at least, are added. Without both classes the score is constant.
    """
    known = keyed_labels(documents, labels, "toxic", F.lit(True) if keep is None else keep, sample).checkpoint()
    sizes = {int(r["y"] > 0): r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = learn_lexicon(known, sizes)
    exempt = frozenset(fold(e.encode()).strip() for e in exceptions) | (_learn_exceptions(known, lexicon) if lexicon else frozenset())
    if not lexicon:
        p = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return {"lexicon": {}, "exceptions": exempt, "weights": (math.log(p / (1 - p)) if not sizes.get(1) or not sizes.get(0) else -2.0, 0.0, 0.0)}
    got = hits(known, lexicon, exempt, ["y"]).toPandas()
    z = np.stack(_features(got["hit"].to_numpy(), got["n_words"].to_numpy(), np.log1p), 1)
    y = (got["y"].to_numpy() > 0).astype(float)
    b, beta = lasso_logistic(z, y, np.ones(len(y)), 0.0, 3000)
    return {"lexicon": lexicon, "exceptions": exempt, "weights": (b, *map(float, beta))}


def _learn_exceptions(known: DataFrame, lexicon: dict[str, float]) -> frozenset[str]:
    """Three-word phrases around a match that two or more clean sampled texts use and no toxic one."""
    whole = {e.strip() for e in lexicon if e.endswith(" ")}
    stems = tuple(e.strip() for e in lexicon if not e.endswith(" "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(as_bytes(batch.column("text")), batch.column("y").to_pylist(), strict=True):
                w = fold(text).split()
                got = sorted({" ".join(w[max(0, i - 1) : i + 2]) for i, x in enumerate(w) if x in whole or x.startswith(stems)})
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([int(y > 0)] * len(got), pa.int32())], names=["phrase", "y"])

    counted = known.select("text", "y").mapInArrow(run, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    return frozenset(r["phrase"] for r in counted.filter("a = 0 AND n >= 2").collect())


def score(documents: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns, score in (0, 1), hit and n_words of every row.

    Null and empty texts hit nothing and score as the least hit does; repeated rows score alike. No shuffle: one scan,
    with a lexicon of bounded size sent to the executors.
    """
    got = hits(documents, model["lexicon"], model["exceptions"], keep)
    b, w1, w2 = model["weights"]
    f1, f2 = _features(F.col("hit"), F.col("n_words"), F.log1p)
    return got.select(*keep, (1 / (1 + F.exp(-(F.lit(b) + w1 * f1 + w2 * f2)))).alias("score"), "hit", "n_words")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(documents, fit(documents, labels, crc_mod("doc_id", 5) != 0), ["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
