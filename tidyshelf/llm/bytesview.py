"""Vectorised views of texts inside Arrow batches: byte n-grams and word hashes without a Python object a word.

Work goes over stretches of about CHUNK bytes, so memory does not follow the length of a text: a longer text is taken in
stretches that overlap (n-grams) or end at a separator (words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Odd, so that powers have inverses modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def content(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string array without nulls, and the n + 1 offsets into them."""
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type)
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def stretches(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``most`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def separators(keep_only_alphanumeric: bool) -> np.ndarray:
    """Which bytes end a word: ASCII white space, or every ASCII character but letters and digits."""
    table = np.zeros(256, bool)
    if keep_only_alphanumeric:
        table[:128] = [not chr(i).isalnum() for i in range(128)]
    else:
        table[[32, 9, 10, 11, 12, 13]] = True
    return table


class WordHasher:
    """64-bit hashes of the words of each text: a polynomial over scrambled bytes, by differences of running sums."""

    def __init__(self, separator: np.ndarray, prefixes: tuple[int, ...] = ()):
        """prefixes: lengths in bytes; longer words also give the hashes of their first bytes."""
        self.separator, self.prefixes = separator, prefixes
        self.values = mixed(np.arange(1, 257, dtype=np.uint64))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK + 1)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            for name, factor in (("up", BASE), ("down", inverse)):
                x = np.full(n, factor, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]

    def hashed(self, raw: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of consecutive texts: the hash of each word, and the words before each text (n + 1); the same for prefixes."""
        n = len(raw)
        if n == 0:
            return [(np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))]
        word = ~self.separator[raw]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        before[bounds[:-1][bounds[:-1] < n]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        up, down = self.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[raw] * up[:n], dtype=np.uint64, out=sums[1:])
        found = [(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds))]
        for k in self.prefixes:
            at = starts[ends - starts > k]
            found.append((mixed((sums[at + k] - sums[at]) * down[at] + np.uint64(k << 32)), np.searchsorted(at, bounds)))
        return found

    def pieces(self, raw: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
        """A long text in stretches that end at separators (or at the text's end)."""
        while end - start > CHUNK:
            stop = start + CHUNK
            gaps = np.flatnonzero(self.separator[raw[start:stop]])
            while not len(gaps) and stop < end:  # one very long word
                gaps, stop = np.flatnonzero(self.separator[raw[stop : stop + CHUNK]]) + (stop - start), stop + CHUNK
            if not len(gaps):
                break
            yield start, start + int(gaps[-1]) + 1
            start += int(gaps[-1]) + 1
        yield start, end

    def runs(self, a: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, word hashes, words before each text) for runs of rows; without prefixes."""
        raw, offsets = content(a)
        for first, last in stretches(offsets, CHUNK):
            lo, hi = int(offsets[first]), int(offsets[last])
            if hi - lo > CHUNK:
                h = np.concatenate([self.hashed(raw[s:e], np.array([0, e - s]))[0][0] for s, e in self.pieces(raw, lo, hi)])
                yield first, last, h, np.array([0, len(h)])
            else:
                yield first, last, *self.hashed(raw[lo:hi], offsets[first : last + 1] - lo)[0]

    def texts(self, a: pa.Array) -> Iterator[np.ndarray]:
        """The word hashes of each text, in order (then those of its prefixes)."""
        raw, offsets = content(a)
        for first, last in stretches(offsets, CHUNK):
            lo, hi = int(offsets[first]), int(offsets[last])
            if hi - lo > CHUNK:
                parts = [self.hashed(raw[s:e], np.array([0, e - s])) for s, e in self.pieces(raw, lo, hi)]
                yield np.concatenate([h for kinds in zip(*parts, strict=True) for h, _ in kinds])
                continue
            kinds = self.hashed(raw[lo:hi], offsets[first : last + 1] - lo)
            for i in range(last - first):
                own = [h[at[i] : at[i + 1]] for h, at in kinds]
                yield own[0] if len(own) == 1 else np.concatenate(own)


def gram_counts(a: pa.Array, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, counts) for runs of rows: how often each hashed byte n-gram occurs in each row, 2**bits columns."""
    raw, offsets = content(a)
    keep = np.full(256, 32, np.uint8)
    keep[97:123], keep[128:] = np.arange(97, 123), np.arange(128, 256)
    keep[65:91] = np.arange(97, 123)
    width, shift = 1 << bits, np.uint32(32 - bits)

    def add(b: np.ndarray, row: np.ndarray, rows: int, starts: int) -> np.ndarray:
        out = np.zeros(rows * width, np.int64)
        b = keep[b].astype(np.uint32)
        for n in sizes:
            m = min(starts, len(b) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h = (h ^ b[i : i + m]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            h = (h * np.uint32(0x85EBCA6B)) >> shift
            whole = (row[:m] == row[n - 1 : n - 1 + m]) & ~((b[:m] == 32) & (b[1 : 1 + m] == 32) if n > 1 else b[:m] == 32)
            out += np.bincount(row[:m][whole] * width + h[whole], minlength=rows * width)
        return out

    for first, last in stretches(offsets, CHUNK >> 2):
        lo, hi = int(offsets[first]), int(offsets[last])
        if hi - lo > CHUNK:
            total = np.zeros(width, np.int64)
            for s in range(lo, hi, CHUNK):
                b = raw[s : min(hi, s + CHUNK + max(sizes) - 1)]
                total += add(b, np.zeros(len(b), np.int64), 1, CHUNK)
            yield first, last, total.reshape(1, width)
        else:
            for f in range(first, last, 512):  # rows are few even where texts are tiny
                g = min(last, f + 512)
                b = raw[offsets[f] : offsets[g]]
                row = np.repeat(np.arange(g - f), np.diff(offsets[f : g + 1]))
                yield f, g, add(b, row, g - f, len(b)).reshape(g - f, width)
