"""Words of many texts at once, as NumPy arrays over one UTF-8 buffer.

Separators are ASCII bytes, so words are found on the bytes: no code point of more
than one byte holds an ASCII byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, U), np.ones(1, U)
HASHED_BYTES = 1 << 19


def _table(separators: Sequence[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(separators)] = True
    return t


#: White space between words: space and 09-0D.
SPACE = _table([0x20, *range(0x09, 0x0E)])
#: All ASCII but digits and letters.
PUNCT = _table([c for c in range(0x80) if not chr(c).isalnum()])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (in place on a new array)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        if size > 4 * HASHED_BYTES:  # a very long word: don't keep tables of its length
            return out[0], out[1]
        _powers = out[0], out[1]
    return _powers


@dataclass
class Words:
    """Words of a run of texts; ``bounds[i]:bounds[i+1]`` are those of text i."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits of each word, equal for equal bytes: a polynomial over the bytes from prefix sums.

        Runs of words of HASHED_BYTES are hashed at a time; where a word stands doesn't matter to its hash.
        """
        out = np.empty(len(self.starts), U)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + HASHED_BYTES, "right")))
            first, last = int(self.starts[i]), int(self.ends[i:j].max())
            p, q = _power_tables(last - first + 1)
            s = np.zeros(last - first + 1, U)
            np.cumsum((self.buf[first:last].astype(U) + U(1)) * p[: last - first], out=s[1:])
            at, to = self.starts[i:j] - first, self.ends[i:j] - first
            out[i:j] = mix((s[to] - s[at]) * q[at] + (to - at).astype(U) * U(0xD6E8FEB86659FD93))
            i = j
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def ends_of_docs(self) -> np.ndarray:
        """For each word, the index one past the last word of its text."""
        return np.repeat(self.bounds[1:], self.counts())


def find_words(texts: Sequence[bytes | None], separators: np.ndarray, lower: bool = False) -> Words:
    texts = [t or b"" for t in texts]
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    if lower:
        buf = LOWER[buf]
    word = ~separators[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    return Words(buf, starts, ends, np.searchsorted(starts, at))


def chunks(texts: Sequence[bytes | None], size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes together, never splitting a text."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if total and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def window_hash(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of h[i : i+width] for every i at which it fits."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, seed, U)
    for k in range(width):
        out *= U(0xD1342543DE82EF95)
        out += h[k : k + n]
        out ^= out >> U(29)
    return mix(out)
