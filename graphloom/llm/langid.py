"""Language ID by cross-parsing entropy.

A text is cut, language by language, into the longest phrases that occur in that language's training text, found by
walking a suffix automaton; a symbol that doesn't occur there is a phrase. The language needing the fewest phrases wins.
Texts are walked in segments side by side; where a segment starts inside a phrase, its first symbols are walked again
from there until both walks meet, so the phrases are those of the whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches
from .textops import CodeMap, as_bytes, single_spaces

#: Symbols of training text for each language, and rows it is drawn from: bounds of the labelled sample, whose last text
#: is cut where the symbols are reached.
TRAIN_SYMBOLS, TRAIN_ROWS = 40_000, 64
SEGMENT = 256
_SPACE = np.uint32(32)
_models: dict[int, tuple] = {}


def fold_char(c: str) -> str:
    """A letter in lower case, whatever plane it is in; a space for any other character."""
    return (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "


_fold = CodeMap(fold_char)


def letters(text: bytes) -> np.ndarray:
    """Lower-case code points of a text, runs of other characters as one space."""
    s = single_spaces(_fold(text))
    return s[1:] if len(s) and s[0] == _SPACE else s


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Automaton:
    """Sparse transitions: state s goes on symbol c to target[base[s] + c], if owner[base[s] + c] is s.

    Symbols are 1..width; 0 is a symbol that no text taught. The last state has no way on; a walk is there at
    a text's start, and after a symbol that the root doesn't know.
    """

    def __init__(self, symbols: np.ndarray, width: int):
        states = suffix_automaton(symbols)
        self.dead = len(states)
        base = np.zeros(len(states) + 1, np.int32)
        room = sum(map(len, states)) * 2 + 2 * width + 4
        taken, owner, target = bytearray(room), np.full(room, -1, np.int32), np.zeros(room, np.int32)
        free = width + 1  # slots before it, from width + 1 on, are taken
        open_ = free  # where states of several symbols look first; what they leave free, states of one symbol fill
        for s in sorted(range(len(states)), key=lambda s: -len(states[s])):
            if not states[s]:
                continue
            want = sorted(states[s])
            at, far = (free, 0) if len(want) == 1 else (max(free, open_), 0)
            while any(taken[at - want[0] + c] for c in want):
                at, far = at + 1, far + 1
            if far > 32:
                open_ = at
            base[s] = at - want[0]
            for c in want:
                slot = base[s] + c
                taken[slot] = 1
                owner[slot], target[slot] = s, states[s][c]
            while taken[free]:
                free += 1
            if room - max(free, open_) < 2 * width + 64:
                taken += bytes(room)
                owner, target = np.concatenate([owner, np.full(room, -1, np.int32)]), np.concatenate([target, np.zeros(room, np.int32)])
                room = len(taken)
        self.base, self.owner, self.target = base, owner, target
        self.root = np.full(width + 1, self.dead, np.int32)
        for c, to in states[0].items():
            self.root[c] = to

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, whether a phrase ended before c)."""
        slot = self.base[state] + c
        lost = self.owner[slot] != state
        return np.where(lost, self.root[c], self.target[slot]), lost


def fit(documents: DataFrame, keep: Column | None = None, train_symbols: int = TRAIN_SYMBOLS, train_rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """(language, training text), by name: a bounded, deterministic sample of rows with text and lang.

    About train_rows rows of a language (by a hash of doc_id), of which whole texts are taken until train_symbols
    symbols are there. A language whose rows have no letters teaches nothing.
    """
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if keep is None else keep))
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_003))
    share = F.lit(0.0)
    for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect():
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 2 * train_rows / r["n"]))).otherwise(share)
    rows = known.filter(place < share * 1_000_003).select("lang", F.col("doc_id").cast("string").alias("d"), place.alias("p"), "text")
    texts: dict[str, list[np.ndarray]] = {}
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r["lang"], r["p"], r["d"] or "", r["text"])):
        got = texts.setdefault(r["lang"], [])
        if sum(map(len, got)) < train_symbols and len(s := letters(r["text"].encode())) > 1:
            got.append(s)
    return [(lang, np.concatenate(got)[:train_symbols].tobytes().decode("utf-32-le")) for lang, got in sorted(texts.items()) if got]


def _model(trained: list[tuple[str, str]]) -> tuple:
    """(code of each code point, automata), built once in a Python worker. Every trained character has a code."""
    key = zlib.crc32(repr(trained).encode())
    if key not in _models:
        _models.clear()
        alphabet = sorted(set("".join(t for _, t in trained)))
        code = np.zeros(0x110000, np.int32)
        code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        _models[key] = code, [Automaton(code[np.frombuffer(t.encode("utf-32-le"), np.uint32)], len(alphabet)) for _, t in trained]
    return _models[key]


def count_phrases(texts: list[np.ndarray], trained: list[tuple[str, str]]) -> np.ndarray:
    """[text, language]: phrases a text is cut into."""
    code, autos = _model(trained)
    sizes = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
    total = int(sizes.sum())
    out = np.zeros((len(texts), len(autos)))
    if not total:
        return out
    flat, valid = np.zeros(total * SEGMENT, np.int32), np.zeros(total * SEGMENT, bool)
    first = np.concatenate([[0], np.cumsum(sizes)])
    for t, at in zip(texts, first * SEGMENT, strict=False):
        flat[at : at + len(t)] = code[t]
        valid[at : at + len(t)] = True
    sym, ok = np.ascontiguousarray(flat.reshape(total, SEGMENT).T), np.ascontiguousarray(valid.reshape(total, SEGMENT).T)
    owner = np.repeat(np.arange(len(texts)), sizes)
    later = np.ones(total, bool)
    later[first[:-1][sizes > 0]] = False
    for j, a in enumerate(autos):
        walk, ends = np.empty((SEGMENT, total), np.int32), np.empty((SEGMENT, total), bool)
        state = np.full(total, a.dead, np.int32)
        for i in range(SEGMENT):
            state, lost = a.step(state, sym[i])
            walk[i], ends[i] = state, lost & ok[i]
        # A later segment goes on from its predecessor's last state, until it is where it would be anyway.
        todo, end = np.flatnonzero(later), state.copy()
        while len(todo):
            col, now = todo, end[todo - 1]
            for i in range(SEGMENT):
                now, lost = a.step(now, sym[i, col])
                same = walk[i, col] == now
                walk[i, col], ends[i, col] = now, lost & ok[i, col]
                if same.any():
                    col, now = col[~same], now[~same]
                if not len(col):
                    break
            end[col] = now  # those that never met their old walk: what follows them starts elsewhere
            todo = col[col + 1 < total] + 1
            todo = todo[later[todo]]
        out[:, j] = np.bincount(owner, ends.sum(0), len(texts))
    return out


def identify(documents: DataFrame, trained: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, lang_pred, score, phrases) for every row of documents, from its text alone.

    ``und`` with score 0 where text is null or has no letter, or nothing was learned. Ties go to the first language by
    name. score is the winner's share of exp(-phrases) at a fixed rate a symbol. Empty tables give none.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = shared.value
        names = [k for k, _ in trained]
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            pred, score, best = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
            at, group, size = 0, [], 0
            for i, t in enumerate(texts):
                group.append(letters(t))
                size += len(group[-1])
                if size < 2_000_000 and i + 1 < len(texts):
                    continue
                if trained:
                    n = count_phrases(group, trained)
                    for k, s in enumerate(group):
                        if (s != _SPACE).any():
                            j = int(np.argmin(n[k]))
                            w = np.exp(-(n[k] - n[k, j]) * (60.0 / max(60, len(s))))
                            pred[at + k], score[at + k], best[at + k] = names[j], float(w[j] / w.sum()), int(n[k, j])
                at, group, size = i + 1, [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.int64())], names=["doc_id", "lang_pred", "score", "phrases"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, phrases long")


def report(documents: DataFrame) -> DataFrame:
    out = identify(documents, fit(documents, crc_mod("doc_id", 3) != 1))
    return out.withColumn("held_out", crc_mod("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "phrases")
