"""MD5 of many short texts at once, as arrays; the first 64 bits of each.

A text is one of some heads followed by one of some tails, and fits one block of 64 bytes (others go one by one).
"""

from __future__ import annotations

import math

import numpy as np

try:  # the interpreter's own md5 takes two thirds of the time of hashlib's, which goes through another library
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Texts hashed at a time: arrays near a core's cache, and long enough for the calls on them; fewer than FEW go one by one.
LANES, FEW = 32768, 400
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [np.uint32(x) for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for x in row]


def _first64(words: list, n: int) -> np.ndarray:
    """Of ``n`` padded blocks, as 16 little-endian words; a number stands for a word that all have."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(64):
            if i < 16:
                k = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                k = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                k = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                k = 7 * i % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            if isinstance(words[k], np.ndarray):
                f += words[k]
                f += _ADD[i]
            else:
                f += _ADD[i] + words[k]
            np.left_shift(f, _TURN[i], out=g)
            f >>= np.uint32(32) - _TURN[i]
            f |= g
            f += b
            a, d, c, b, f = d, c, b, f, a
        a += _START[0]
        b += _START[1]
    out = np.empty((n, 2), "<u4")
    out[:, 0], out[:, 1] = a, b
    return out.view(">u8")[:, 0].astype(np.uint64)


class Heads:
    """The beginnings of texts."""

    def __init__(self, heads: list[bytes]):
        self.heads = heads
        size = np.array([len(h) for h in heads], np.int64)
        order = np.argsort(size, kind="stable")
        self.back, self.longest = np.argsort(order), int(size.max(initial=0))
        self.sorted = bool((order == np.arange(len(heads))).all())
        #: (length, first, last) of the heads in order of length, and their words.
        self.runs, self.words = [], np.zeros((16, len(heads)), np.uint32)
        if self.longest < 56:
            self.words[:] = np.frombuffer(b"".join([heads[i].ljust(64, b"\0") for i in order.tolist()]), "<u4").reshape(-1, 16).T
            sizes = size[order]
            self.runs = [(k, int(np.searchsorted(sizes, k)), int(np.searchsorted(sizes, k, "right"))) for k in np.unique(sizes).tolist()]

    def first64(self, tails: list[bytes]) -> np.ndarray:
        """(tails, heads): the first 64 bits of md5(head + tail)."""
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(tails):
            by_length.setdefault(len(t), []).append(i)
        if len(by_length) == 1:
            return self._of(tails, len(tails[0]))
        out = np.empty((len(tails), len(self.heads)), np.uint64)
        for length, places in by_length.items():
            out[places] = self._of([tails[i] for i in places], length)
        return out

    def _of(self, tails: list[bytes], length: int) -> np.ndarray:
        """Of tails of one length: the words behind the longest text are those of all."""
        n = len(self.heads)
        if self.longest + length > 55 or len(tails) * n < FEW:
            return np.frombuffer(b"".join([md5(h + t).digest() for t in tails for h in self.heads]), ">u8")[::2].reshape(-1, n).astype(np.uint64)
        used = (self.longest + length) // 4 + 1
        ends = []
        for size, _, _ in self.runs:
            before, after = b"\0" * size, b"\x80".ljust(4 * used - size - length, b"\0")
            ends.append(np.frombuffer(b"".join([before + t + after for t in tails]), "<u4").reshape(-1, used).T)
        bits = [np.uint32(8 * (size + length)) for size, _, _ in self.runs]
        out, many = np.empty((len(tails), n), np.uint64), max(1, LANES // n)
        for i in range(0, len(tails), many):
            m = min(many, len(tails) - i)
            words = [np.uint32(0)] * 14 + [bits[0], np.uint32(0)]
            held = np.empty((used, m, n), np.uint32)
            for end, (_, first, last) in zip(ends, self.runs, strict=True):
                np.bitwise_or(end[:, i : i + m, None], self.words[:used, None, first:last], out=held[:, :, first:last])
            words[:used] = held.reshape(used, -1)
            if len(bits) > 1:
                words[14] = np.tile(np.repeat(np.array(bits, np.uint32), [last - first for _, first, last in self.runs]), m)
            # one tail with very many heads
            found = [_first64([w[j : j + LANES] if isinstance(w, np.ndarray) else w for w in words], min(LANES, m * n - j)) for j in range(0, m * n, LANES)]
            out[i : i + m] = (found[0] if len(found) == 1 else np.concatenate(found)).reshape(m, n)
        return out if self.sorted else out[:, self.back]
