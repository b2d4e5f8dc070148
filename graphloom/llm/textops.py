"""Vectorised word and shingle hashing over batches of texts, in the bytes of UTF-8.

Word bytes are the ASCII letters and digits and every byte from 0x80 up; A-Z are lower-cased. A word's hash depends on
its bytes alone. Texts are packed into buffers of bounded size, so memory doesn't follow the batch.
"""

from __future__ import annotations

import numpy as np

_B = np.arange(256, dtype=np.uint8)
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
IS_WORD = ((_B >= 48) & (_B <= 57)) | ((_B >= 97) & (_B <= 122)) | ((_B >= 65) & (_B <= 90)) | (_B >= 128)
_R = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_R), -1, 1 << 64))
BUFFER = 1 << 19
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, BUFFER + 65536), base, np.uint64)
        p[0] = 1
        have = _powers[name] = np.multiply.accumulate(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums P with hash(buf[s:e]) = (P[e] - P[s]) / R**s, modulo 2**64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_R, "r", len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inv = _power(_INV, "i", len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def buffers(texts: list[bytes], limit: int = BUFFER):
    """Runs (first, last) of consecutive texts of about ``limit`` bytes together; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def rolling_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    """span_hash of every stretch of n bytes."""
    return mix((prefix[n:] - prefix[:-n]) * _power(_INV, "i", len(prefix) - n) + np.uint64(n))


class Words:
    """The words of some texts: start, end (in buf), text index, hash; ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, texts: list[bytes]):
        self.buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        self.base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        inside = np.concatenate([[False], IS_WORD[self.buf], [False]]).astype(np.int8)
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.base)
        self.hash = span_hash(prefix_hash(self.buf), self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; runs over the end of a text are the caller's to leave out."""
        h, m = self.hash, len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(m, np.uint64(n))
        for k in range(n):
            out = out * _R + h[k : k + m]
        return mix(out)

    def text(self, i: int, n: int) -> bytes:
        """The n words from word i on, lower-cased, one space between."""
        return b" ".join(self.buf[self.start[k] : self.end[k]].tobytes() for k in range(i, i + n))


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; a shorter text with words is one shingle."""
    g, out = words.grams(n), []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for k in range(a, b):
                h = np.uint64((int(h) * int(_R) + int(words.hash[k])) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class CodeMap:
    """Code points through a function to short strings, worked out once for each code point that occurs."""

    GONE, UNSEEN = 0, 0xFFFFFFFF

    def __init__(self, of):
        self.of, self.longer = of, []
        self.table = np.full(0x110000, self.UNSEEN, np.uint32)

    def __call__(self, text: bytes) -> np.ndarray:
        """The mapped code points of a UTF-8 text; ill-formed bytes count as U+FFFD."""
        u = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        s = self.table[u]
        new = s == self.UNSEEN
        if new.any():
            for c in np.unique(u[new]).tolist():
                to = self.of(chr(c))
                if len(to) > 1:
                    self.longer.append(np.array([ord(x) for x in to], np.uint32))
                self.table[c] = self.GONE if not to else ord(to) if len(to) == 1 else 0x110000 + len(self.longer) - 1
            s = self.table[u]
        if len(self.longer) and (s >= 0x110000).any():
            at = np.flatnonzero(s >= 0x110000)
            parts, last = [], 0
            for i in at.tolist():
                parts += [s[last:i], self.longer[int(s[i]) - 0x110000]]
                last = i + 1
            s = np.concatenate([*parts, s[last:]])
        return s[s != self.GONE]


def single_spaces(s: np.ndarray) -> np.ndarray:
    """Code points with runs of spaces as one."""
    space = s == 32
    return s[~(space & np.concatenate([[False], space[:-1]]))] if len(s) else s
