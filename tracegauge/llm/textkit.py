"""Vectorised reading of whole texts: words, lines and hashes of many texts at once with numpy.

Texts are handled in chunks of about CHUNK_BYTES (a longer text is a chunk of its own), so memory is
bounded by the Arrow batch and the longest single text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map

CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch that are handled, and given out, at a time.
SLICE_ROWS = 1000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_UNDO = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_FOLDED = _VALUES[FOLD]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _UNDO)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


class Chunk:
    """Some texts side by side.  ``starts``/``ends``: byte spans of runs outside ``separator``."""

    def __init__(self, texts: list[bytes], fold: bool = True, separator: np.ndarray = SPACE):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        self.end = self.begin + sizes
        power, self._undo = _power_tables(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            self._sum = np.concatenate([[np.uint64(0)], np.cumsum((_FOLDED if fold else _VALUES)[self.buf] * power[: len(self.buf)])])
        inside = ~separator[self.buf]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.word_at = np.searchsorted(self.starts, self.begin)  # each text's first word
        self.words = np.diff(np.append(self.word_at, len(self.starts)))
        self.doc = np.repeat(np.arange(self.n), self.words)

    def hash_of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sum[ends] - self._sum[starts]) * self._undo[starts] + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hash_of(self.starts, self.ends)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many of its bytes are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.end] - total[self.begin]

    def mean_over(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Per text, the mean of values[first:last] (0 where there is none)."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        n = np.maximum(last - first, 0)
        return np.where(n > 0, (total[np.maximum(last, first)] - total[first]) / np.maximum(n, 1), 0.0)

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each k adjacent words of one text, and the place of the first word."""
        if len(h) < k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[: len(h) - k + 1] == self.doc[k - 1 :])
        with np.errstate(over="ignore"):
            x = h[at]
            for i in range(1, k):
                x = mix(x * np.uint64(0xD6E8FEB86659FD93) + h[at + i])
        return x, at


def add_columns(
    docs: DataFrame, kernel: Callable[[], Callable[[list[bytes]], dict]], fields: list[T.StructField], keep: list[str], text: str = "text"
) -> DataFrame:
    """``keep`` columns of every row plus ``fields`` computed from its whole text (null: empty).

    ``kernel`` is called once in each task and gives the function for a list of texts.
    """
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(schema)
    source = docs.select(*[docs[c] for c in keep], *([] if text in keep else [docs[text].alias("__text")]))
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        f = kernel()
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(i, SLICE_ROWS)
                texts = [b"" if x is None else x for x in batch.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()]
                new = f(texts)
                arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                arrays += [pa.array(new[x.name], arrow.field(x.name).type) for x in fields]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return arrow_map(source, run, schema)


def by_chunk(f: Callable[[Chunk], dict], fold: bool = True, separator: np.ndarray = SPACE) -> Callable[[list[bytes]], dict]:
    def run(texts: list[bytes]) -> dict:
        parts = [f(Chunk(c, fold, separator)) for c in chunks(texts or [b""])]
        return {k: np.concatenate([p[k] for p in parts])[: len(texts)] for k in parts[0]}

    return run
