"""Hashes of the words of a text and of its word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
_KNOWN_WORDS = 1 << 16


class Hashes(dict):
    """word: hash, for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 64:
            self[word] = value
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the shingles, with repeats, of a text whose words hash to ``h``."""
    words = min(words, len(h))
    if not words:
        return h
    n = len(h) - words + 1
    # the number of words is part of it: a short text is not the shingle of a longer one
    total = np.full(n, words, np.uint64)
    for k in range(words):
        total = total * ODD + h[k : n + k]
    return mixed(total)


def word_hashes(text: str | None, known: dict | None = None) -> np.ndarray:
    """Of words between ASCII white space, A-Z in lower case."""
    found = (text or "").encode().lower().split()
    known = Hashes() if known is None else known
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def shingle_set(h: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(_shingles(h, words))


def shingle_bytes(words: int):
    """A function from a text to its set as bytes, for ``inplace.joined``."""

    def make():
        known = Hashes()
        return lambda text: shingle_set(word_hashes(text, known), words).tobytes()

    return make


_COLUMNS = 4096
# multiplications that take as long as one comparison of two sets
_WORTH = 300_000


def _shared(rows: np.ndarray, i: np.ndarray, j: np.ndarray, of, most: int) -> np.ndarray | None:
    """The shingles that all of rows i and all of rows j have in common, as a table.

    Products of 0/1 matrices over the shingles that occur more than once. None where that
    takes more than ``most`` multiplications.
    """
    sets = [of(k) for k in rows.tolist()]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in sets])
    _, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    if int((many > 1).sum()) * len(i) * len(j) > most:
        return None
    column = np.cumsum(many > 1) - 1
    several = many[code] > 1
    owner, column = owner[several], column[code[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    at_i, at_j = np.searchsorted(rows, i), np.searchsorted(rows, j)
    both = np.zeros((len(i), len(j)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (start, start + _COLUMNS))
        has = np.zeros((len(rows), _COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        both += (has[at_i] @ has[at_j].T).astype(np.int64)
    return both


def similar_sets(sets, percent: int):
    """linked(i, j) by the Jaccard similarity of the sets, an Arrow array of bytes."""
    size = pc.binary_length(sets).to_numpy(zero_copy_only=False).astype(np.int64) // 8

    def of(k: int) -> np.ndarray:
        return np.frombuffer(sets[k].as_buffer(), np.uint64)

    def one_by_one(i, j):
        both = np.zeros(len(i), np.int64)
        for k, (a, b) in enumerate(zip(map(of, i.tolist()), map(of, j.tolist()), strict=True)):
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both[k] = (large[at] == small).sum()
        return both

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # sets of very different sizes are never similar
        ok = np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent
        ok &= np.minimum(size[i], size[j]) > 0
        a, b = i[ok], j[ok]
        if not len(a):
            return ok
        rows_a, at_a = np.unique(a, return_inverse=True)
        rows_b, at_b = np.unique(b, return_inverse=True)
        rows, table = np.union1d(rows_a, rows_b), None
        # many pairs of few rows
        if len(a) > 4 * len(rows):
            table = _shared(rows, rows_a, rows_b, of, _WORTH * len(a))
        both = one_by_one(a, b) if table is None else table[at_a, at_b]
        ok[ok] = both * 100 >= (size[a] + size[b] - both) * percent
        return ok

    return linked
