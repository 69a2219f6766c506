"""FM-index over word numbers, in numpy: Burrows-Wheeler transform, wavelet
matrix for ranks, sampled suffix positions. Searches run for many phrases at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed[: (n + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])
        self.size = n

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class WaveletMatrix:
    """Access and rank over a sequence of symbols below 2 ** levels."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[Bits] = []
        for level in range(self.levels - 1, -1, -1):
            one = (symbols >> level) & 1 == 1
            self.bits.append(Bits(one))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before place i."""
        start = np.zeros_like(i)
        for k, b in enumerate(self.bits):
            one = (c >> (self.levels - 1 - k)) & 1 == 1
            zeros = b.size - b.ones
            ri, rs = b.rank(i), b.rank(start)
            i, start = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rs, start - rs)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for b in self.bits:
            one = b.get(i)
            r = b.rank(i)
            c = (c << 1) | one
            i = np.where(one, b.size - b.ones + r, i - r)
        return c


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        if step < n:
            second[:-step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(key[1:] != key[:-1])
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Index of a text of word numbers from 1; 0 parts the documents."""

    def __init__(self, text: np.ndarray, sample: int = 32):
        text = np.append(text, -1) + 1  # the end is the smallest symbol
        self.size = len(text)
        self.sigma = int(text.max()) + 1
        order = suffix_array(text)
        bwt = text[order - 1]
        self.first = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.sigma), out=self.first[1:])
        self.wavelet = WaveletMatrix(bwt, self.sigma)
        kept = order % sample == 0
        self.sampled, self.positions = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase, read
        backward; phrases: one row each, words from 1, all of one length. A
        word that the text lacks has the number -1."""
        known = ((phrases >= 1) & (phrases + 1 < self.sigma)).all(axis=1)
        symbols = np.where(known[:, None], phrases + 1, 0)
        low, high = np.zeros(len(phrases), np.int64), np.where(known, self.size, 0)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = symbols[:, k]
            low, high = self.first[c] + self.wavelet.rank(c, low), self.first[c] + self.wavelet.rank(c, high)
        return low, np.where(known, np.maximum(low, high), low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text: from each row back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        at, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(at):
            hit = self.sampled.get(rows)
            out[at[hit]] = self.positions[self.sampled.rank(rows[hit])] + steps
            at, rows = at[~hit], rows[~hit]
            c = self.wavelet.access(rows)
            rows = self.first[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out % self.size
