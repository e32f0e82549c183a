"""An FM-index over integer symbols, with numpy arrays and batched searches."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling. The last symbol must be the only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    bits = max(1, int(text.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):  # as many symbols at once as fit into 62 bits
        key = (key << bits) | np.concatenate([text[k:], np.zeros(min(k, n), text.dtype)])[:n].astype(np.int64)
    order = np.argsort(key, kind="stable")
    # The rank of a group of ties is the place of its first suffix.
    place = np.arange(n)
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    k = step
    while not fresh.all():
        # Only suffixes that are still tied are sorted again.
        at = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
        s = order[at]
        nxt = np.where(s + k < n, rank[np.minimum(s + k, n - 1)] + 1, 0)
        sub = np.lexsort((nxt, rank[s]))
        s, nxt = s[sub], nxt[sub]
        order[at] = s
        old = rank[s]
        new = np.ones(len(s), bool)
        new[1:] = (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])
        fresh[at] = new
        rank[s] = np.maximum.accumulate(np.where(new, at, 0))
        k *= 2
    return order


class FMIndex:
    """Backward search by ranks in a wavelet matrix; every ``sample``-th text position is kept to locate."""

    def __init__(self, text: np.ndarray, sample: int = 16) -> None:
        n = self.n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.size = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bits: list[np.ndarray] = []
        level = bwt
        for b in range(self.levels - 1, -1, -1):
            bit = ((level >> b) & 1).astype(bool)
            self.bits.append(bit)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate([level[~bit], level[bit]])
        # Where the block of each symbol begins at the bottom of the matrix.
        self.block = self._down(np.arange(self.size), np.zeros(self.size, np.int64))
        marked = sa % sample == 0
        self.marked = marked
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)])
        self.kept = sa[marked]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1
            r = self.ones[k][i]
            i = np.where(one == 1, self.zeros[k] + r, i - r)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i of the transform."""
        return self._down(symbol, i) - self.block[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases of equal length, one per row; all at once from their last symbol back."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        known = (phrases < self.size).all(axis=1)
        hi[~known] = 0
        live = np.flatnonzero(known)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(lo, hi)

    def _back(self, i: np.ndarray) -> np.ndarray:
        """The suffix that begins one symbol earlier."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            bit = self.bits[k][i]
            r = self.ones[k][i]
            symbol = (symbol << 1) | bit
            i = np.where(bit, self.zeros[k] + r, i - r)
        return self.first[symbol] + i - self.block[symbol]

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, text position) of every occurrence."""
        n = hi - lo
        phrase = np.repeat(np.arange(len(lo)), n)
        i = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out = np.empty(len(i), np.int64)
        todo, steps = np.arange(len(i)), 0
        while todo.size:
            found = self.marked[i]
            out[todo[found]] = self.kept[self.mark_rank[i[found]]] + steps
            todo, i = todo[~found], i[~found]
            if todo.size:
                i = self._back(i)
            steps += 1
        return phrase, out
