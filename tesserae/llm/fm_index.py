"""An FM-index in numpy: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix, backward search.

Searches run in lockstep: a step extends every open search by one symbol, with two ranks a level of the wavelet
matrix for all of them at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a text of small integers whose last symbol, 0, occurs once."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    first = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(first):
        key <<= bits
        if j < n:
            key[: n - j] |= text[j:]
    sa = np.argsort(key)
    k = key[sa]
    new = np.r_[True, k[1:] != k[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    single = new & np.r_[new[1:], True]
    open_ = np.flatnonzero(~single)
    h = first
    while len(open_):
        s = sa[open_]
        k = rank[s] * (n + 1) + rank[np.minimum(s + h, n - 1)]
        order = np.argsort(k)
        s, k = s[order], k[order]
        sa[open_] = s
        new = np.r_[True, k[1:] != k[:-1]]
        rank[s] = open_[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        open_ = open_[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector a level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n = len(sequence)
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = packed.view(np.uint64)
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.words.append(words)
            self.before.append(before)
            on = bit.astype(bool)
            self.zeros.append(int(n - on.sum()))
            sequence = np.concatenate([sequence[~on], sequence[on]])
        self.start = self._down(np.zeros(symbols, np.int64), np.arange(symbols))

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(at, symbol) - self.start[symbol]


class FMIndex:
    """Backward search over a text whose last symbol, 0, occurs once; positions: whether least and most need an answer."""

    def __init__(self, text: np.ndarray, symbols: int, positions: bool = False):
        sa = suffix_array(text)
        self.n = len(text)
        self.before = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols), out=self.before[1:])
        self.bwt = WaveletMatrix(text[sa - 1], symbols)
        self.least = RangeMin(sa) if positions else None
        self.most = RangeMin(-sa) if positions else None

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns that have `symbol` before those of the ranges [low, high); symbol -1 is nowhere."""
        known = np.maximum(symbol, 0)
        both = self.bwt.rank(np.concatenate([low, high]), np.concatenate([known, known]))
        base = self.before[known]
        low, high = base + both[: len(low)], base + both[len(low) :]
        return low, np.where(symbol < 0, low, high)


class RangeMin:
    """Minima of ranges of an array: prefix and suffix minima of blocks, and a sparse table over the blocks."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        b = self.BLOCK
        n = len(values)
        full = np.full((-(-n // b), b), np.iinfo(np.int32).max, np.int32)
        full.ravel()[:n] = values
        self.values = full.ravel()
        self.prefix = np.minimum.accumulate(full, 1).ravel()
        self.suffix = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [full.min(1)]
        span = 1
        while span * 2 <= len(self.table[0]):
            t = self.table[-1]
            self.table.append(np.minimum(t[:-span], t[span:]))
            span *= 2

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum of values[low:high] for ranges that aren't empty."""
        last = high - 1
        a, z = low // self.BLOCK, last // self.BLOCK
        out = np.minimum(self.suffix[low], self.prefix[last])
        inside = a == z
        if inside.any():
            i, j = low[inside], last[inside]
            m = self.values[i]
            for step in range(1, self.BLOCK):
                m = np.minimum(m, self.values[np.minimum(i + step, j)])
            out[inside] = m
        far = np.flatnonzero(z - a > 1)
        if len(far):
            i, j = a[far] + 1, z[far]
            level = np.frexp(j - i)[1] - 1
            m = np.empty(len(far), np.int32)
            for k in np.unique(level):
                here = level == k
                t = self.table[k]
                m[here] = np.minimum(t[i[here]], t[j[here] - (1 << int(k))])
            out[far] = np.minimum(out[far], m)
        return out


class Matcher:
    """Stretches of streams that occur in a text of segments at least `length` symbols long.

    Two indexes, of the text and of the text read backwards: a window of `length` symbols is read from its end
    backward, and where it breaks off no window over that place can occur, so the next one starts behind it; a
    window that does occur is lengthened forward as far as its matching statistic goes.
    """

    def __init__(self, segments: list[np.ndarray] | tuple[np.ndarray, np.ndarray], length: int, positions: bool = False):
        words, offsets = segments
        self.length, self.positions = length, positions
        self.symbols, dense = np.unique(words, return_inverse=True)
        m = len(offsets) - 1
        n = len(words) + m + 1
        # 0 ends the text, 1 parts the segments, words are from 2
        at = np.arange(len(words)) + np.repeat(np.arange(m), np.diff(offsets))
        text = np.ones(n, np.int64)
        text[at] = dense + 2
        text[-1] = 0
        self.starts = offsets[:-1] + np.arange(m)
        self.size = n
        self.back = FMIndex(text, len(self.symbols) + 2, positions)
        self.ahead = FMIndex(np.r_[text[-2::-1], 0], len(self.symbols) + 2, positions)

    def dense(self, words: np.ndarray) -> np.ndarray:
        if not len(self.symbols):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.symbols, words), len(self.symbols) - 1)
        return np.where(self.symbols[at] == words, at + 2, -1)

    def stretches(self, words: np.ndarray, offsets: np.ndarray, others: np.ndarray, bound: np.ndarray | None = None, moves: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stream, start, end) of the streams' stretches that match.

        A stretch matches if it occurs more than `others` times (1 for a stream that is itself a segment, else 0).
        With `bound` it matches if its first occurrence starts before bound, plus for `moves` the stretch's place in
        the stream: for a segment its own place in the text, for others the place where they would stand.
        """
        w, length = self.dense(words), self.length
        base, size = offsets[:-1], np.diff(offsets)
        n = len(size)
        start = np.zeros(n, np.int64)  # of the window that is read now
        at = np.full(n, length)  # backward: the first symbol read; forward: the end of what matches
        forward = np.zeros(n, bool)
        low, high = np.zeros(n, np.int64), np.full(n, self.size)
        open_ = np.flatnonzero(size >= length)
        found = []
        while len(open_):
            fwd = forward[open_]
            b, f = open_[~fwd], open_[fwd]
            done = []
            if len(b):
                lo, hi = self.back.extend(low[b], high[b], w[base[b] + at[b] - 1])
                p = at[b] - 1
                ok = self._matches(self.back, lo, hi, p, start[b] + length, b, others, bound, moves)
                good, bad = b[ok], b[~ok]
                low[good], high[good], at[good] = lo[ok], hi[ok], at[good] - 1
                full = good[at[good] == start[good]]
                # windows over the place where it broke off are none: the next starts behind it
                start[bad] = at[bad]
                at[bad] = start[bad] + length
                low[bad], high[bad] = 0, self.size
                done.append(bad[at[bad] > size[bad]])
                if len(full):  # read again forward, to lengthen it: the index of the reversed text takes it from its start
                    forward[full] = True
                    at[full] = start[full]
                    low[full], high[full] = 0, self.size
            if len(f):
                lo, hi = self.ahead.extend(low[f], high[f], w[base[f] + np.minimum(at[f], size[f] - 1)])
                ok = (at[f] < size[f]) & self._matches(self.ahead, lo, hi, start[f], at[f] + 1, f, others, bound, moves)
                good, bad = f[ok], f[~ok]
                low[good], high[good] = lo[ok], hi[ok]
                at[good] += 1
                if len(bad):
                    found.append((bad, start[bad].copy(), at[bad].copy()))
                    # the next window that isn't known yet ends one symbol later
                    start[bad] = at[bad] + 1 - length
                    at[bad] += 1
                    low[bad], high[bad] = 0, self.size
                    forward[bad] = False
                    done.append(bad[at[bad] > size[bad]])
            if done and sum(map(len, done)):
                closed = np.zeros(n, bool)
                closed[np.concatenate(done)] = True
                open_ = open_[~closed[open_]]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _matches(self, index, lo, hi, start, end, which, others, bound, moves):
        if bound is None:
            return hi - lo > others[which]
        ok = hi > lo
        if ok.any():
            i = np.flatnonzero(ok)
            if index is self.back:
                first = index.least.of(lo[i], hi[i])
            else:
                first = self.size - 1 - (end - start)[i] + index.most.of(lo[i], hi[i])
            ok[i] = first < (bound[which] + moves[which] * start)[i]
        return ok
