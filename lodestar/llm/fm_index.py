"""An FM-index over word ids: suffix order, wavelet-matrix ranks, sampled suffix positions.

The text is an array of word ids in which 0 parts segments; it ends with 0. Every 0 is a
symbol of its own, so no match crosses one. Searches and walks take arrays of queries.
"""

from __future__ import annotations

import numpy as np

#: Every so many words of a segment, from its first on, a suffix position is kept.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions by suffix: doubling prefixes, sorting anew only what is still tied."""
    n = len(text)
    narrow = text.astype(np.uint16) if text.max(initial=0) < 1 << 16 else text
    order = np.argsort(narrow, kind="stable")
    sorted_text = text[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_text[1:] != sorted_text[:-1]) | (sorted_text[1:] == 0)
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    step = 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = order[tied]
        key = rank[at] * n + rank[at + step]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class Bits:
    """A bit vector with ranks: 64 bits a word and the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_order(text)
        n = len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        places = np.arange(n)
        opened = np.concatenate(([0], np.maximum.accumulate(np.where(text == 0, places + 1, 0))[:-1]))
        kept = ((places - opened) % SAMPLE == 0)[order]
        self.kept, self.samples = Bits(kept), order[kept]
        self.levels = max(1, (symbols - 1).bit_length())
        self.tree: list[tuple[Bits, int]] = []
        seq = text[order - 1].astype(np.uint16 if symbols < 1 << 16 else np.int32)
        for level in range(self.levels):
            bits = (seq >> (self.levels - 1 - level)) & 1 == 1
            self.tree.append((Bits(bits), n - int(np.count_nonzero(bits))))
            seq = np.concatenate((seq[~bits], seq[bits]))
        self.begin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(self.tree):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.levels - 1 - level)) & 1 == 1, zeros + ones, at - ones)
        return at

    def occ(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        return self._down(symbol, at) - self.begin[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the suffixes that begin with each phrase, by backward search.

        A phrase is a row of symbols from the left; ``lengths`` tells how many count.
        """
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        live = np.arange(len(phrases))
        last = phrases[live, lengths - 1]
        low[live], high[live] = self.first[last], self.first[last + 1]
        for back in range(2, int(lengths.max(initial=1)) + 1):
            live = live[low[live] < high[live]]
            now = live[lengths[live] >= back]
            if not len(now):
                break
            symbol = phrases[now, lengths[now] - back]
            low[now] = self.first[symbol] + self.occ(symbol, low[now])
            high[now] = self.first[symbol] + self.occ(symbol, high[now])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: each walks back until a sampled one."""
        rows = rows.copy()
        steps, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live := live[~self.kept.get(rows[live])]):
            at, symbol = rows[live], np.zeros(len(live), np.int64)
            for bits, zeros in self.tree:
                one, ones = bits.get(at), bits.rank(at)
                at = np.where(one, zeros + ones, at - ones)
                symbol = symbol * 2 + one
            rows[live] = self.first[symbol] + at - self.begin[symbol]
            steps[live] += 1
        return self.samples[self.kept.rank(rows)] + steps
