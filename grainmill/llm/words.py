"""Hashes of the words of whole columns of texts, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once: the arrays of a block take about 60 MB.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted. numpy.unique hashes them, which takes many times as long as its sort."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


class WordHasher:
    """64-bit hashes of words: runs of bytes other than ASCII white space, A-Z taken as a-z.

    A word's hash is a polynomial over a random number for each byte, from differences of running sums, so a block is a few
    array operations. Equal words have equal hashes in every process; the chance that two given words collide is about 2^-60.
    """

    def __init__(self):
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * MULT)
        self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self._powers(BLOCK)

    def _powers(self, n: int) -> None:
        base = 0xD6E8FEB86659FD93
        for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words on end, where each text's words end). Null is no words."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        t = texts.cast(pa.large_string())
        if not len(t):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        off = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
        n = int(off[-1] - off[0])
        if not n:
            return np.empty(0, np.uint64), np.zeros(len(t), np.int64)
        data = np.frombuffer(t.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        hashes, starts, at = [], [], 0
        while at < n:
            end = self._end(data, off, at, n)
            d = data[at:end]
            word = ~self.space[d]
            fresh = np.zeros(len(d), bool)  # a text begins here
            fresh[off[np.searchsorted(off, at) : np.searchsorted(off, end)] - at] = True
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1] | fresh[1:]
            last[:-1] &= ~word[1:] | fresh[1:]
            s, e = np.nonzero(first)[0], np.nonzero(last)[0]
            if len(d) > len(self.up):
                self._powers(len(d))
            run = self.value[d]
            run *= self.up[: len(d)]
            np.cumsum(run, out=run)
            h = run[e]
            h[s > 0] -= run[s[s > 0] - 1]
            h *= self.down[s]
            hashes.append(mix(h ^ (e - s + 1).astype(np.uint64) * MULT))
            starts.append(s + at)
            at = end
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off[1:])

    def _end(self, data: np.ndarray, off: np.ndarray, at: int, n: int) -> int:
        """Where a block from `at` on ends: behind a white-space character or a text."""
        end = at + BLOCK
        if end >= n:
            return n
        gaps = np.nonzero(self.space[data[at:end]])[0]
        best = max(at + int(gaps[-1]) + 1 if len(gaps) else at, int(off[np.searchsorted(off, end, "right") - 1]))
        while best <= at:  # one word fills the block
            gaps = np.nonzero(self.space[data[end : end + BLOCK]])[0]
            text = int(off[np.searchsorted(off, end)])
            near = end + int(gaps[0]) + 1 if len(gaps) else end + BLOCK
            if len(gaps) or text <= near or near >= n:
                best = min(near, text, n)
            end = near
        return best

    def split(self, texts: pa.Array) -> list[np.ndarray]:
        """The hashes of each text's words."""
        h, ends = self(texts)
        return np.split(h, ends[:-1]) if len(ends) else []

    def one(self, text: str | None) -> np.ndarray:
        return self(pa.array([text], pa.string()))[0]
