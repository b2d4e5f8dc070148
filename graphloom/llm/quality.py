"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Column expressions. Boosted shallow trees over a bounded labelled sample give paths; each path
is a conjunctive rule; a lasso logistic regression keeps few of them; what is kept becomes one Column expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keyed_labels

#: Rows of each class that may be sampled for the fit (a bound, in expectation), and trees and depth of the ensemble.
SAMPLE, TREES, DEPTH = 4000, 40, 3
#: Strength of the lasso penalty, a row.
LASSO = 0.002
THRESHOLD = 0.7

FEATURES = ("log_words", "log_chars", "word_length", "upper", "symbols", "bangs", "digits", "distinct", "repeats", "lines", "stops")


def statistics(text: str = "text") -> dict[str, Column]:
    """The features, by name, of a text column; null counts as empty. Shares are of characters, or of words."""
    t = F.coalesce(F.col(text), F.lit(""))
    chars = F.length(t)
    per_char, per_word = (lambda n: n / F.greatest(chars, F.lit(1))), (lambda n: n / F.greatest(F.size("_w"), F.lit(1)))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "log_words": F.log1p(F.size("_w").cast("double")), "log_chars": F.log1p(chars.cast("double")),
        "word_length": per_word(chars.cast("double")), "upper": per_char(count(r"\p{Lu}")),
        "symbols": per_char(count(r"[^\p{L}\p{N}\s.,;:!?'\"()\-]")), "bangs": per_char(count("!")), "digits": per_char(count("[0-9]")),
        "distinct": per_word(F.size(F.array_distinct("_w"))), "repeats": per_word(F.size(F.filter("_w", lambda x, i: F.coalesce(x == F.get("_w", i - 1), F.lit(False))))),
        "lines": per_word(count("\n")), "stops": per_word(count("[.!?](?=\\s|$)")),
    }


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    base = docs.select(*keep, "text", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "").alias("_w"))
    return base.select(*keep, *(c.cast("double").alias(k) for k, c in statistics().items()))


Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], step: np.ndarray, feats: np.ndarray) -> None:
    """One tree by Newton gain; every node but the root is a rule; leaves' steps go to ``step``."""
    if path:
        rules.append(path)
    best = (1e-6, None)
    gs, hs = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 10:
        for f in feats:
            v = x[rows, f]
            for c in cuts[f]:
                left = v <= c
                n = int(left.sum())
                if min(n, len(rows) - n) < 3:
                    continue
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                if gain > best[0]:
                    best = (gain, (f, c, left))
    if best[1] is None:
        step[rows] = -gs / (hs + 1)
        return
    f, c, left = best[1]
    _grow(x, cuts, g, h, rows[left], depth - 1, (*path, (int(f), True, float(c))), rules, step, feats)
    _grow(x, cuts, g, h, rows[~left], depth - 1, (*path, (int(f), False, float(c))), rules, step, feats)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, below, c in rule:
        ok &= (x[:, f] <= c) if below else (x[:, f] > c)
    return ok


def lasso_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and coefficients by accelerated proximal gradient steps."""
    n, m = z.shape
    w = weight / weight.sum()
    b, beta, prev_b, prev, t = 0.0, np.zeros(m), 0.0, np.zeros(m), 1.0
    rate = 4.0 / max(1e-9, float(np.linalg.norm(np.sqrt(w)[:, None] * np.c_[np.ones(n), z], 2) ** 2))
    for _ in range(rounds):
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vb, v = b + (t - 1) / t2 * (b - prev_b), beta + (t - 1) / t2 * (beta - prev)
        r = w * (1 / (1 + np.exp(-np.clip(vb + z @ v, -30, 30))) - y)
        prev_b, prev, t = b, beta, t2
        b = vb - rate * r.sum()
        s = v - rate * (z.T @ r)
        beta = np.sign(s) * np.maximum(np.abs(s) - rate * penalty, 0)
    return float(b), beta


def fit(documents: DataFrame, labels: DataFrame, keep: Column | None = None, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, [(weight, rule)]) from labels.quality of the rows ``keep`` admits. Without both classes: no rules.

    Only statistics of the sampled rows come to the driver.
    """
    known = keyed_labels(documents, labels, "quality", F.lit(True) if keep is None else keep, sample)
    got = with_statistics(known, ["doc_id", "y"]).toPandas().sort_values(["doc_id", *FEATURES])
    x, y = np.nan_to_num(got[list(FEATURES)].to_numpy(float)), (got["y"].to_numpy(float) > 0).astype(float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return math.log(p / (1 - p)), []
    rng = np.random.default_rng(7)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))) for f in range(x.shape[1])]
    rules: list[Rule] = []
    margin = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = rng.choice(len(y), max(10, min(len(y), int(len(y) * 0.6))), replace=len(y) < 10)
        feats, step = rng.choice(len(FEATURES), 6, replace=False), np.zeros(len(y))
        _grow(x, cuts, p - y, p * (1 - p), np.unique(rows), depth, (), rules, step, feats)
        margin += 0.3 * step
    rules = list(dict.fromkeys(rules))
    z = np.stack([_holds(r, x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    support = z.mean(0) if len(rules) else np.zeros(0)
    use = (support > 0.005) & (support < 0.995)
    rules, z = [r for r, u in zip(rules, use, strict=True) if u], z[:, use]
    if not rules:
        p = (y.sum() + 1) / (len(y) + 2)
        return math.log(p / (1 - p)), []
    b, beta = lasso_logistic(z, y, np.ones(len(y)), penalty)
    return b, [(float(w), r) for w, r in zip(beta, rules, strict=True) if abs(w) > 1e-4]


def compile_rules(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """Score in (0, 1) as a Column over the statistics' columns."""
    total = F.lit(float(intercept))
    for w, rule in rules:
        ok = F.lit(True)
        for f, below, c in rule:
            ok = ok & ((F.col(FEATURES[f]) <= c) if below else (F.col(FEATURES[f]) > c))
        total = total + F.when(ok, F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score(documents: DataFrame, model: tuple, keep: list[str]) -> DataFrame:
    """``keep`` columns and score of every row. Null and empty texts score as empty; ties and repeated rows score alike.

    No shuffle and no Python: statistics and rules run inside the scan's stage.
    """
    return with_statistics(documents, keep).select(*keep, compile_rules(*model).alias("score"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(documents, fit(documents, labels, crc_mod("doc_id", 4) != 2), ["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_rejected(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents' columns, whatever their names, of the rows scoring at least ``threshold``.

    Null and empty texts score as empty ones do, repeated rows alike; null ids have no label and are scored like others.
    An empty table gives none; without labels of both classes all rows get one score, the smoothed share of label 1.
    """
    model = fit(documents, labels)
    cols = [F.col(f"`{c}`") for c in documents.columns]
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "")
    packed = documents.select(F.struct(*cols).alias("_row"), "text", words.alias("_w"))
    # A generator of one row is a barrier: else the optimizer would copy the statistics into every rule of the predicate.
    made = F.inline(F.array(F.struct(*(c.cast("double").alias(k) for k, c in statistics().items()))))
    scored = packed.select("_row", made).select("_row", compile_rules(*model).alias("_score"))
    return scored.filter(F.col("_score") >= threshold).select("_row.*")
