"""A compressed FM-index over integer symbols and matching statistics by backward search, in NumPy.

The Burrows-Wheeler transform is kept as a wavelet matrix: one packed bit vector a level with the ones before each
word of 64 bits. All searches of a shard advance together, one symbol a step, as vectors."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 * 64 + 64
        padded = np.zeros(n, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])
        self.n = len(bits)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((ONE << (i & 63).astype(np.uint64)) - ONE))


class FMIndex:
    """Over text, of symbols 0 (a separator) to size - 1. Patterns of up to depth symbols can be counted."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        self.n, self.size = len(text), size
        order = self._order(text, depth)
        self._matrix(text[order - 1])  # at 0 the last symbol, a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])  # rows of smaller symbols
        self.zero = self._down(np.arange(size), np.zeros(size, np.int64))

    @staticmethod
    def _order(text: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes ordered by their first depth symbols at least, by doubling."""
        rank, h = text.astype(np.int64), 1
        while True:
            nxt = np.zeros_like(rank)
            nxt[:-h] = rank[h:] + 1
            pair = rank * (int(rank.max()) + 2) + nxt
            order = np.argsort(pair, kind="stable")
            p = pair[order]
            new = np.concatenate([[0], np.cumsum(p[1:] != p[:-1])])
            h *= 2
            if h >= depth or new[-1] == len(text) - 1:
                return order
            rank = np.empty_like(rank)
            rank[order] = new

    def _matrix(self, bwt: np.ndarray) -> None:
        self.levels, self.shifts = [], list(reversed(range(max(1, int(self.size - 1).bit_length()))))
        for s in self.shifts:
            bits = (bwt >> s & 1).astype(np.uint8)
            self.levels.append(Bits(bits))
            bwt = np.concatenate([bwt[bits == 0], bwt[bits == 1]])

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for s, level in zip(self.shifts, self.levels):
            ones = level.rank(i)
            i = np.where(symbol >> s & 1, level.n - level.ones + ones, i - ones)
        return i

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of symbol + pattern, from those of pattern."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.first[symbol] - self.zero[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]


def repeated_stretches(index: FMIndex, text: np.ndarray, start: np.ndarray, length: np.ndarray, least: int, twice: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, from, to) of stretches of at least `least` symbols that the index has `twice` times or more; every such stretch lies in one of them.

    Streams are text[start : start + length]. From a stream's end the match is extended to the left while it occurs often
    enough. Where it fails, at p, a short string from p on that is too rare by itself is looked for (1, 2, 4, ... symbols):
    no stretch across it can count, so the next match ends before the string does."""
    k = len(start)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(length >= least)
    end = length.astype(np.int64).copy()
    at = end.copy()  # the next symbol to take is at - 1
    low, high = np.zeros(k, np.int64), np.full(k, index.n, np.int64)
    probing = np.zeros(k, bool)
    fail, width = np.zeros(k, np.int64), np.zeros(k, np.int64)
    while len(live):
        at[live] -= 1
        lo, hi = index.back(text[start[live] + at[live]], low[live], high[live])
        low[live], high[live] = lo, hi
        often = hi - lo >= twice
        done = []
        # extending
        e = live[~probing[live]]
        ok = often[~probing[live]]
        whole = e[ok & (at[e] == 0)]
        if len(whole):
            hit = whole[end[whole] >= least]
            out.append((hit, np.zeros(len(hit), np.int64), end[hit].copy()))
            done.append(whole)
        bad = e[~ok]
        if len(bad):
            hit = bad[end[bad] - at[bad] - 1 >= least]
            out.append((hit, at[hit] + 1, end[hit].copy()))
            over = end[bad] - 1 < least
            done.append(bad[over])
            go = bad[~over]
            probing[go], fail[go], width[go] = True, at[go], 1
            at[go] += 1
            low[go], high[go] = 0, index.n
        # probing: the string from fail on, of width symbols
        p = live[probing[live]]
        p = p[~np.isin(p, bad, assume_unique=True)] if len(bad) else p
        ok = high[p] - low[p] >= twice
        longer = p[ok & (at[p] == fail[p])]
        if len(longer):
            width[longer] = np.minimum(2 * width[longer], end[longer] - fail[longer])
            at[longer] = fail[longer] + width[longer]
            low[longer], high[longer] = 0, index.n
        rare = p[~ok]
        if len(rare):
            end[rare] = np.minimum(fail[rare] + width[rare], end[rare]) - 1
            at[rare] = end[rare]
            probing[rare] = False
            low[rare], high[rare] = 0, index.n
            done.append(rare[end[rare] < least])
        if done and any(map(len, done)):
            live = np.setdiff1d(live, np.concatenate(done), assume_unique=True)
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]
