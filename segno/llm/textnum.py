"""Words and word shingles of many texts at once, as numpy arrays; used inside Arrow tasks.

A word is a maximal run of letters, digits and combining marks, compared without case.
Hashes are 64-bit and the same on every machine. Offsets count code points.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Characters handled at once: bounds the arrays; a longer text is handled alone.
CHUNK_CHARS = 1 << 20
_BASE, _BASE_INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
#: Code points from here on are not looked up; they count as other characters.
_LAST = 0x33480


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any of their bits can serve as a hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def fold_table() -> np.ndarray:
    """Per code point: its lower-case form if it belongs in a word, else 0."""
    out = np.zeros(_LAST + 1, np.uint64)
    for i in range(_LAST):
        c = chr(i)
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list[str], most: int = CHUNK_CHARS):
    """Ranges (from, to) of consecutive texts that hold about `most` characters together (under 2**20 texts)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > most or i - start >= 1 << 19):
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters, each text closed by a line end, and the offset of each text (one more at the end)."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))


@dataclass
class Words:
    h: np.ndarray  # hash of each word
    doc: np.ndarray  # index of its text
    start: np.ndarray  # offsets in its text
    end: np.ndarray
    first: np.ndarray  # index of the first word of each text, one more at the end


def words(cp: np.ndarray, off: np.ndarray) -> Words:
    f = fold_table()[np.minimum(cp, _LAST)]
    inside = np.zeros(len(f) + 2, np.int8)
    inside[1:-1] = f != 0
    edges = np.flatnonzero(np.diff(inside))
    s, e = edges[0::2], edges[1::2]
    up, down = powers(len(f) + 1)
    total = np.zeros(len(f) + 1, np.uint64)
    np.cumsum(f * up[:-1], out=total[1:])
    h = mix((total[e] - total[s]) * down[s])
    first = np.searchsorted(s, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(h, doc, s - off[doc], e - off[doc], first)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of each run of k words; a text of fewer words is one shingle."""
    n = len(w.h)
    out = w.h * _STEP[0]
    same = np.ones(n, bool)
    for j in range(1, k):
        same = np.zeros(n, bool)
        same[: max(0, n - j)] = w.doc[j:] == w.doc[: max(0, n - j)]
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - j)] = w.h[j:]
        out += np.where(same, ahead * _STEP[j % 5] + np.uint64(j), np.uint64(0))
    opens = np.zeros(n, bool)
    opens[w.first[:-1][np.diff(w.first) > 0]] = True
    at = np.flatnonzero(same | opens)
    return mix(out[at]), at


def runs(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of each run of k words, for any k in one pass; shorter texts have none."""
    n = len(w.h)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w.h * up[:-1], out=total[1:])
    at = np.arange(max(0, n - k + 1))
    at = at[w.doc[at] == w.doc[at + k - 1]]
    return mix((total[at + k] - total[at]) * down[at] + np.uint64(k)), at


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, h), in that order, and how often each occurs; of h only the upper 44 bits are kept."""
    if not len(h):
        return doc[:0], h[:0], np.zeros(0, np.int64)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    kept = key[new]
    return (kept >> np.uint64(44)).astype(np.int64), kept << np.uint64(20), np.diff(np.concatenate((new, [len(key)])))
