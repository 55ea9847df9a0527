"""Words and word shingles of a text as hashes, by numpy over its bytes."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
FOLD = np.arange(256, dtype=np.uint64)
FOLD[65:91] += np.uint64(32)  # A-Z as a-z
STEPS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE^i and INVERSE^i for i < n, mod 2^64."""
    if len(_powers[0]) < n:
        for k, x in enumerate((BASE, INVERSE)):
            out = np.full(max(n, 1 << 16), x, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return [p[:n] for p in _powers]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes, and where each word [^\\x20\\x09-\\x0D]+ starts and ends."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edges[::2], edges[1::2]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: the sum of one scrambled
    number for each byte and its place in the word. No power series is in it, so
    words made of repeated patterns do not meet."""
    data, start, end = words_of(text)
    if not len(start):
        return np.zeros(0, np.uint64)
    n = end - start
    first = np.cumsum(n) - n  # of each word among the bytes of all words
    place = np.arange(int(n.sum()))
    letters = FOLD[data[place + np.repeat(start - first, n)]]
    place -= np.repeat(first, n)
    return mix(np.add.reduceat(mix((place.astype(np.uint64) << np.uint64(8) | letters) * np.uint64(BASE)), first) + n.astype(np.uint64))


def exact_sets(texts: list[str], words: int) -> list[np.ndarray] | None:
    """The sets of shingles of some texts by numbers that stand for the words
    themselves; None if the texts' word hashes tell all their words apart."""
    numbers: dict[bytes, int] = {}
    each, hashes = [], []
    for text in texts:
        found = text.encode("utf-8", "replace").lower().split()  # ASCII letters and spaces only
        each.append([numbers.setdefault(w, len(numbers)) for w in found])
        hashes.append(word_hashes(text))
    if not numbers or len(np.unique(np.concatenate(hashes))) == len(numbers):
        return None
    names: dict[tuple[int, ...], int] = {}
    out = []
    for found in each:
        k = min(words, len(found))
        own = {names.setdefault(tuple(found[i : i + k]), len(names)) for i in range(len(found) - k + 1)} if k else set()
        out.append(np.array(sorted(own), np.uint64))
    return out


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of fewer words, the
    whole sequence is the one shingle; without words there is none."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * STEPS[i]
    return np.unique(mix(out))
