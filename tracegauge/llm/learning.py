"""Training on bounded samples of labelled rows; models are small numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, target: str, bound: int, fold: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents, chosen by a hash of doc_id.

    ``fold`` (m, r): rows whose crc32(doc_id as text) mod m is r are never learnt from.  A doc_id labelled
    twice counts once, with its larger label.  Labels move by a broadcast of at most ``bound`` rows.
    """
    rows = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    if fold:
        rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] != fold[1])
    chosen = (
        rows.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def minimise(f, x: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; ``f`` gives value and gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y, r in reversed(past):
            alphas.append(a := r * (s @ q))
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(alphas), strict=True):
            q += (a - r * (y @ q)) * s
        slope, t = grad @ q, 1.0 if past else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12))
        for _ in range(30):
            new = x - t * q
            v, g = f(new)
            if v <= value - 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = new - x, g - grad
        if (sy := s @ y) > 1e-12:
            past = [*past[-(memory - 1) :], (s, y, 1 / sy)]
        done = abs(value - v) < 1e-8 * max(1.0, abs(value))
        x, value, grad = new, v, g
        if done:
            break
    return x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Sparse:
    """Rows of (index, value) pairs, 12 bytes a pair; products go PART pairs at a time."""

    PART = 1 << 19

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.width, self.n = width, len(rows)
        sizes = np.array([len(i) for i, _ in rows], np.int64)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.index = np.empty(len(self.row), np.int32)
        self.value = np.empty(len(self.row), np.float32)
        at = 0
        for i, v in rows:
            self.index[at : at + len(i)], self.value[at : at + len(i)] = i, v
            at += len(i)

    def _parts(self):
        return (slice(i, i + self.PART) for i in range(0, len(self.row), self.PART))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for p in self._parts():
            out += np.bincount(self.row[p], self.value[p] * w[self.index[p]], self.n)
        return out

    def tdot(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for p in self._parts():
            out += np.bincount(self.index[p], self.value[p] * r[self.row[p]], self.width)
        return out


def fit_logistic(x: Sparse, y: np.ndarray, l2: float, steps: int = 100) -> tuple[np.ndarray, float]:
    def loss(p):
        w, b = p[:-1], p[-1]
        z = x.dot(w) + b
        r = (sigmoid(z) - y) / len(y)
        return (
            np.logaddexp(0, -(2 * y - 1) * z).mean() + 0.5 * l2 * (w @ w),
            np.append(x.tdot(r) + l2 * w, r.sum()),
        )

    if x.n == 0:
        return np.zeros(x.width), 0.0
    start = np.zeros(x.width + 1)
    p = minimise(loss, start, steps)
    return p[:-1], float(p[-1])


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic link from scores to probabilities (with smoothed targets)."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(p):
        z = p[0] * score + p[1]
        q = sigmoid(z)
        r = (q - target) / max(1, len(y))
        return (np.logaddexp(0, z) - target * z).mean() + 1e-6 * (p @ p), np.array([r @ score, r.sum()]) + 2e-6 * p

    if not len(y):
        return 1.0, 0.0
    a, b = minimise(loss, np.array([1.0, 0.0]), 50)
    return float(a), float(b)


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = y.sum()
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * (len(y) - n1)))
