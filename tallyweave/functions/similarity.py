"""Similarity of names: token-set and weighted ratios over longest common subsequences, in Arrow batches.

``Block`` compares one name with many at once: letters of the one are bits of a number, and each step of the common
subsequence is taken for all others together. Which names need that at all follows from an upper bound on the score.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (|a| + |b|), with the rows of the LCS table as bits of an integer."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with a part of the longer one."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """100 if one name's words are among the other's; else the best ratio of common words and both completed."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (not x - y or not y - x):
        return 100.0
    left = " ".join(filter(None, [both, *sorted(x - y)]))
    right = " ".join(filter(None, [both, *sorted(y - x)]))
    best = ratio(left, right)
    return max(best, ratio(both, left), ratio(both, right)) if both else best


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    long, short = max(len(a), len(b)), min(len(a), len(b))
    plain = ratio(a, b)
    if long < 1.5 * short:
        return max(plain, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.6 if long > 8 * short else 0.9
    words = max(_partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 100.0 if set(a.split()) & set(b.split()) else 0.0)
    return max(plain, scale * _partial(a, b), scale * 0.95 * words)


@lru_cache(maxsize=100_000)
def _best(a: str, b: str) -> float:
    return max(token_set_ratio(a, b), weighted_ratio(a, b))


def hopeless(a: pd.Series, b: pd.Series, least: float) -> np.ndarray:
    """Pairs without a common word whose letters, in whatever order, can't give a token-set ratio of ``least``."""
    codes, found = pd.factorize(pd.concat([a, b], ignore_index=True))
    words = [set(name.split()) for name in found]
    letters = [np.frombuffer(" ".join(sorted(w)).encode("utf-32-le"), "<u4").astype(np.int64) for w in words]
    bags = np.array([np.bincount(x % 64, minlength=64) for x in letters], dtype=np.int32).reshape(-1, 64)
    size, (i, j) = bags.sum(axis=1), (codes[: len(a)], codes[len(a) :])
    low = 200.0 * np.minimum(bags[i], bags[j]).sum(axis=1) < least * (size[i] + size[j]) - 1e-6
    low[low] = [words[x].isdisjoint(words[y]) for x, y in zip(i[low], j[low], strict=True)]
    return low


def token_set(least: float) -> Callable[..., Column]:
    """The token-set ratio of two names; null where it is known to be below ``least`` without working it out.

    Declared as not deterministic, so that a filter on the score doesn't make Spark work it out twice.
    """

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.fillna(""), b.fillna("")
        return pd.Series([None if low else token_set_ratio(x, y) for x, y, low in zip(a, b, hopeless(a, b, least), strict=True)], dtype="float64")

    return score.asNondeterministic()


@F.pandas_udf(T.DoubleType())
def best(a: pd.Series, b: pd.Series) -> pd.Series:
    """The higher of the token-set and the weighted ratio."""
    return pd.Series([_best(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


#: Letters of a name that fit the bits of a number; longer names are compared one by one.
BITS = 63


def _bag(codes: np.ndarray) -> np.ndarray:
    return np.bincount(codes % 64, minlength=64).astype(np.int16)


def _codes(name: str) -> np.ndarray:
    return np.frombuffer(name.encode("utf-32-le"), "<u4").astype(np.int64)


class _Texts:
    """Texts as rows of letters, and what one text has in common with them."""

    def __init__(self, texts: list[str]):
        rows = [_codes(t) for t in texts]
        self.length = np.array([len(r) for r in rows], np.int64)
        self.letters = np.zeros((len(rows), int(self.length.max(initial=0))), np.int64)
        for i, r in enumerate(rows):
            self.letters[i, : len(r)] = r
        self.ascii = bool(self.letters.max(initial=0) < 128)

    def masks(self, a: str, at: np.ndarray) -> np.ndarray:
        """For each letter of the rows ``at`` the places, as bits, where ``a`` has it."""
        codes = _codes(a)
        known = np.unique(codes)
        bits = np.array([sum(1 << int(i) for i in np.flatnonzero(codes == c)) for c in known], np.uint64)
        letters = self.letters[at]
        if self.ascii:
            table = np.zeros(128, np.uint64)
            table[known[known < 128]] = bits[known < 128]
            return table[letters]
        k = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        return np.where(known[k] == letters, bits[k], np.uint64(0))

    @staticmethod
    def _common(masks: np.ndarray, full: np.uint64, within: np.ndarray | np.uint64) -> np.ndarray:
        row = np.full(len(masks), full, np.uint64)
        for column in masks.T:
            hit = row & column & within
            row = ((row + hit) | (row - hit)) & full
        return np.bitwise_count(~row & within).astype(np.int64)

    def common(self, a: str, at: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of ``a`` and each of the rows ``at``."""
        full = np.uint64((1 << len(a)) - 1)
        return self._common(self.masks(a, at), full, full)

    def ratio(self, a: str, at: np.ndarray) -> np.ndarray:
        """``ratio`` of ``a`` with each of the rows ``at``."""
        return 200.0 * self.common(a, at) / (len(a) + self.length[at])

    def partial(self, a: str, at: np.ndarray) -> np.ndarray:
        """``_partial`` of ``a`` with each of the rows ``at``."""
        n, masks, length, full = len(a), self.masks(a, at), self.length[at], np.uint64((1 << len(a)) - 1)
        best = np.zeros(len(at))
        rows = np.flatnonzero(length >= n)
        if len(rows):  # parts of the others: beginnings, one letter more each time, then parts from each letter on
            row = np.full(len(rows), full, np.uint64)
            for j in range(n - 1):
                hit = row & masks[rows, j]
                row = ((row + hit) | (row - hit)) & full
                best[rows] = np.maximum(best[rows], 200.0 * np.bitwise_count(~row & full) / (n + j + 1))
        for i in range(int(length[rows].max(initial=0))):
            own = rows[length[rows] > i]
            part = np.minimum(length[own], i + n) - i
            best[own] = np.maximum(best[own], 200.0 * self._common(masks[own, i : i + n], full, full) / (n + part))
        rows = np.flatnonzero(length < n)
        widest = int(length[rows].max(initial=0))
        one = np.uint64(1)
        for i in range(1 - widest, n):  # parts of ``a``
            own = rows[1 - length[rows] <= i]
            lo, hi = np.full(len(own), max(0, i)), np.minimum(i + length[own], n)
            within = ((one << hi.astype(np.uint64)) - one) ^ ((one << lo.astype(np.uint64)) - one)
            best[own] = np.maximum(best[own], 200.0 * self._common(masks[own, :widest], full, within) / (length[own] + hi - lo))
        return best


def _is_odd(name: str, words: list[str]) -> bool:
    """Whether a name is very long, repeats a word or isn't its words with single spaces."""
    return len(name) > BITS or len(set(words)) < len(words) or not words or name != " ".join(words)


class _Words:
    """Names as sets of words, and their token-set ratios with one name's words.

    The words that two names share come first in both of the completed texts, so only what is left of them is compared;
    what is left of the names that hold some words is kept for the next name that shares these.
    """

    def __init__(self, names: list[str]):
        words = [n.split() for n in names]
        self.odd = np.array([_is_odd(n, w) for n, w in zip(names, words, strict=True)], bool)
        self.words = [set(w) for w in words]
        having: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for x in w:
                having.setdefault(x, []).append(i)
        self.having = {w: np.array(rows) for w, rows in having.items()}
        self.plain = _Texts(["" if o else n for n, o in zip(names, self.odd, strict=True)])
        self.sorted = _Texts(["" if o else " ".join(sorted(w)) for w, o in zip(words, self.odd, strict=True)])
        self.bags = np.ascontiguousarray(np.array([_bag(_codes(n)) for n in names], np.int16).reshape(-1, 64).T)
        self.rest: dict[frozenset[str], tuple[np.ndarray, _Texts]] = {}

    def letters(self, name: str) -> np.ndarray:
        """How many letters each name has in common with ``name``, in whatever order."""
        bag = _bag(_codes(name))
        own = np.flatnonzero(bag)
        return np.minimum(self.bags[own], bag[own, None]).sum(axis=0, dtype=np.int64)

    def shared(self, words: list[str]) -> np.ndarray:
        """The words that each name shares, as bits."""
        out = np.zeros(len(self.words), np.uint64)
        for i, w in enumerate(words):
            if w in self.having:
                out[self.having[w]] |= np.uint64(1 << i)
        return out

    def _rest(self, both: frozenset[str]) -> tuple[np.ndarray, _Texts]:
        if both not in self.rest:
            if len(self.rest) > 4096:
                self.rest.clear()
            rows = None
            for w in both:
                rows = self.having[w] if rows is None else np.intersect1d(rows, self.having[w], assume_unique=True)
            rows = rows[~self.odd[rows]]
            self.rest[both] = rows, _Texts([" ".join(sorted(self.words[i] - both)) for i in rows.tolist()])
        return self.rest[both]

    def token_set(self, words: list[str], at: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """``token_set_ratio`` with the rows ``at``, none odd, that share the words ``shared``, at least one each."""
        n, length = sum(map(len, words)) + len(words) - 1, self.plain.length[at]
        out = np.zeros(len(at))
        for mask in np.unique(shared):
            own = np.flatnonzero(shared == mask)
            both = frozenset(w for i, w in enumerate(words) if int(mask) >> i & 1)
            left, size = " ".join(sorted(set(words) - both)), sum(map(len, both)) + len(both) - 1
            if not left:
                out[own] = 100.0
                continue
            rows, texts = self._rest(both)
            k = np.searchsorted(rows, at[own])
            best = np.maximum(200.0 * (size + 1 + texts.common(left, k)) / (n + length[own]), 200.0 * size / (size + np.minimum(n, length[own])))
            out[own] = np.where(texts.length[k] == 0, 100.0, best)
        return out


class Block(_Words):
    """Names of which the most similar ones to a name are sought.

    The score can't be above what the letters that both have, in whatever order, and the words that both have would give.
    Names are scored by falling bound, first those with a common word, until the bound is below the k-th best score. Very
    long names, those that repeat a word and those with other than single spaces have no bound.
    """

    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names
        self.odd_rows = np.flatnonzero(self.odd)
        self.scored = 0

    def _bounds(self, name: str, at: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most that names without a word of ``name`` can score, and the most that a part of them can."""
        n, length, common = len(name), self.plain.length[at], common[at]
        short, long = np.minimum(n, length), np.maximum(n, length)
        whole = 200.0 * common / (n + length)
        part = np.where(long > 8 * short, 0.6, 0.9) * 200.0 * common / (short + np.minimum(common, short)) + 1e-9
        part[long < 1.5 * short] = 0.0
        return np.maximum(whole + 1e-9, part), part

    def _bounds_shared(self, name: str, at: np.ndarray, common: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for names whose words in common with ``name`` have ``shared`` letters, spaces between them too."""
        n, length = len(name), self.plain.length[at]
        short, long = np.minimum(n, length), np.maximum(n, length)
        words = np.where(long >= 1.5 * short, np.where(long > 8 * short, 0.6, 0.9) * 95.0, 0.0)
        bound, part = self._bounds(name, at, common)
        return np.maximum(np.maximum(bound, words), 200.0 * shared / (shared + short)) + 1e-9, part

    def _scores(self, name: str, at: np.ndarray, part: np.ndarray, least: float, shared: np.ndarray | None = None) -> np.ndarray:
        """``_best`` of names; where it is below ``least``, anything below that. ``shared``: the words that all of them share."""
        words = name.split()
        tidy = " ".join(sorted(words))
        out, aligned = self.plain.ratio(name, at), self.sorted.ratio(tidy, at)
        n, length = len(name), self.plain.length[at]
        short, long = np.minimum(n, length), np.maximum(n, length)
        scale = np.where(long > 8 * short, 0.6, 0.9)
        parts = [(self.plain, name, scale, part), (self.sorted, tidy, scale * 0.95, part * 0.95 + 1e-9)]
        if shared is None:
            out = np.maximum(out, aligned)
        else:
            out = np.maximum(out, self.token_set(words, at, shared))
            out = np.maximum(out, np.where(long < 1.5 * short, 0.95 * aligned, scale * 0.95 * 100.0))
            parts = parts[:1]  # a common word is as good as the best part of the words in order
        for texts, word, weight, most in parts:
            own = np.flatnonzero((most > out) & (most >= least))
            if len(own):
                out[own] = np.maximum(out[own], weight[own] * texts.partial(word, at[own]))
        return out

    def top(self, name: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all names that are at least as similar as the k-th."""
        words = name.split()
        if _is_odd(name, words):
            self.scored += len(self.names)
            full = np.array([_best(name, n) for n in self.names])
            at = np.flatnonzero(full >= (np.partition(full, len(full) - k)[-k] if len(full) > k else 0))
            return at, full[at]
        bits, common = self.shared(words), self.letters(name)
        bits[self.odd_rows] = 0
        near, rest = np.flatnonzero(bits), np.flatnonzero((bits == 0) & ~self.odd)
        weight = np.array([len(w) + 1 for w in words])
        sizes = ((bits[near, None] >> np.arange(len(words), dtype=np.uint64)) & np.uint64(1)).astype(np.int64) @ weight
        found, scores = [self.odd_rows], [np.array([_best(name, self.names[i]) for i in self.odd_rows])]
        kth = -1.0
        for rows, (bound, part), own in ((near, self._bounds_shared(name, near, common, sizes - 1), bits), (rest, self._bounds(name, rest, common), None)):
            have = np.concatenate(scores)
            kth = np.partition(have, len(have) - k)[-k] if len(have) >= k else kth
            keep = np.flatnonzero(bound >= kth)
            keep = keep[np.argsort(-bound[keep], kind="stable")]
            rows, bound, part = rows[keep], bound[keep], part[keep]
            lo, step = 0, 64
            while True:
                hi = min(lo + step, int(np.searchsorted(-bound, -kth, side="right")))
                if hi <= lo:
                    break
                at = rows[lo:hi]
                found.append(at)
                scores.append(self._scores(name, at, part[lo:hi], kth, None if own is None else own[at]))
                lo, step, have = hi, 2 * step, np.concatenate(scores)
                kth = np.partition(have, len(have) - k)[-k] if len(have) >= k else kth
        at, have = np.concatenate(found), np.concatenate(scores)
        self.scored += len(at)
        keep = have >= kth
        return at[keep], have[keep]


class Alike(_Words):
    """Names of which those are sought whose token-set ratio with a name reaches a threshold."""

    def of(self, name: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the names whose ratio with ``name`` is at least ``least``."""
        words = name.split()
        if _is_odd(name, words):
            full = np.array([token_set_ratio(name, " ".join(w)) for w in self.words])
            at = np.flatnonzero(full >= least)
            return at, full[at]
        bits, length = self.shared(words), self.plain.length
        ok = 200.0 * self.letters(name) >= least * (len(name) + length) - 1e-6
        rest = np.flatnonzero(ok & (bits == 0) & ~self.odd)
        near, odd = np.flatnonzero((bits != 0) & ~self.odd), np.flatnonzero(self.odd)
        weight = np.array([len(w) + 1 for w in words])
        sizes = ((bits[near, None] >> np.arange(len(words), dtype=np.uint64)) & np.uint64(1)).astype(np.int64) @ weight - 1
        near = near[ok[near] | (200.0 * sizes >= least * (sizes + np.minimum(len(name), length[near])) - 1e-6)]
        found = [rest, near, odd]
        tidy = " ".join(sorted(words))
        scores = [self.sorted.ratio(tidy, rest), self.token_set(words, near, bits[near]), np.array([token_set_ratio(name, " ".join(self.words[i])) for i in odd])]
        at, have = np.concatenate(found).astype(np.int64), np.concatenate(scores)
        return at[have >= least], have[have >= least]
