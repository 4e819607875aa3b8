"""Quality classifier: a sparse rule ensemble over text statistics.

Small boosted trees on statistics of at most TRAIN_ROWS labelled documents give paths; each path is a
conjunctive rule; a lasso logistic regression weights the rules, most of them with 0; the rest are compiled
into one Spark column expression over the statistics, which are computed from whole texts in Arrow batches.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; labels with a null
are not learnt from; with no labels or one class only, every score is the share of label 1 (0.5 without
labels); a doc_id labelled twice counts with its larger label; repeated rows are scored each; of splits and
penalties that tie the first is taken; texts of any length are read whole; an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import labelled, sigmoid
from .quality_rules import base_counts
from .textkit import SPACE, Chunk, add_columns, by_chunk

TRAIN_ROWS = 20_000
#: Fixed threshold.
GOOD_AT = 0.3
#: Rows whose crc32(doc_id as text) mod 5 is 0 are held out.
FOLD = (5, 0)
TREES, DEPTH, CUTS, LEAF = 30, 3, 32, 20


def _class(*spans: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in spans:
        t[a:b] = True
    return t


#: Byte classes whose shares of a text are statistics.
CLASSES = {
    "upper": _class((65, 91)),
    "lower": _class((97, 123)),
    "digit": _class((48, 58)),
    "wide": _class((128, 256)),
    "stop": _class((33, 34), (46, 47), (63, 64)),
    "comma": _class((44, 45), (58, 60)),
    "bar": _class((124, 125)),
    "symbol": _class((35, 39), (42, 43), (60, 61), (62, 63), (124, 125)),
    "mark": _class((34, 35), (39, 42), (43, 44), (45, 46), (47, 48), (61, 62), (64, 65), (91, 97), (123, 127)),
}
STATISTICS = [
    "log_words", "word_length", "log_lines", "words_per_line", "dup_lines", "repeat_words", "distinct_words", "top_word",
    *[f"share_{k}" for k in CLASSES],
]
FIELDS = [T.StructField(s, T.DoubleType()) for s in STATISTICS]


def statistics(c: Chunk) -> dict:
    base = base_counts(c)
    words = np.maximum(c.words, 1)
    size = np.maximum(c.end - c.begin - c.count(SPACE[c.buf]), 1)
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = c.count(newline[c.buf]) + 1
    h = c.word_hashes()
    order = np.lexsort((h, c.doc))
    d, new = c.doc[order], np.ones(len(h), bool)
    if len(h):
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(d) != 0)
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    most = np.zeros(c.n)
    np.maximum.at(most, d[at], runs)
    out = {
        "log_words": np.log1p(c.words), "word_length": base["word_chars"] / words, "log_lines": np.log1p(lines),
        "words_per_line": c.words / lines, "dup_lines": base["n_dup_lines"] / lines, "repeat_words": base["n_repeat_words"] / words,
        "distinct_words": np.bincount(d[at], minlength=c.n) / words, "top_word": most / words,
    }
    return {k: np.round(v, 9) for k, v in (out | {f"share_{k}": c.count(t[c.buf]) / size for k, t in CLASSES.items()}).items()}


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    return add_columns(docs, lambda: by_chunk(statistics, fold=False), FIELDS, keep)


#: A rule: conditions (statistic number, cut, above) that all hold.
Rule = tuple[tuple[int, float, bool], ...]


def grow(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, depth: int, path: Rule, out: list[Rule], fitted: np.ndarray) -> None:
    """A regression tree by least squares; adds every path and writes each leaf's mean into ``fitted``."""
    y, best = target[rows], (1e-9, None)
    if depth and len(rows) >= 2 * LEAF:
        total, n = y.sum(), len(rows)
        for j in columns:
            if not len(cuts[j]):
                continue
            b = np.searchsorted(cuts[j], x[rows, j], "left")  # b > i exactly where x > cuts[i]
            m = np.cumsum(np.bincount(b, minlength=len(cuts[j]) + 1))[:-1]
            s = np.cumsum(np.bincount(b, y, len(cuts[j]) + 1))[:-1]
            ok = (m >= LEAF) & (n - m >= LEAF)
            gain = np.where(ok, s**2 / np.maximum(m, 1) + (total - s) ** 2 / np.maximum(n - m, 1) - total**2 / n, 0)
            if gain.max() > best[0]:
                best = (float(gain.max()), (j, float(cuts[j][gain.argmax()])))
    if best[1] is None:
        fitted[rows] = y.mean() if len(y) else 0.0
        return
    j, cut = best[1]
    above = x[rows, j] > cut
    for side in (False, True):
        sub = (*path, (int(j), cut, side))
        out.append(sub)
        grow(x, target, cuts, rows[above == side], columns, depth - 1, sub, out, fitted)


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 1) -> list[Rule]:
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])]
    z, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(TREES):
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        columns = rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]
        residual, fitted, found = y - sigmoid(z), np.zeros(len(y)), []
        grow(x, residual, cuts, rows, columns, DEPTH, (), found, fitted)
        rules += found
        leaves = [r for r in found if not any(o[: len(r)] == r and len(o) > len(r) for o in found)]
        for r in leaves:
            on = holds(x, r)
            inside = np.intersect1d(rows, np.flatnonzero(on))
            if len(inside):
                z[on] += 2.0 * fitted[inside[0]]
    seen, kept = set(), []
    for r in rules:
        on = holds(x, r)
        if 0 < on.sum() < len(on) and (key := on.tobytes()) not in seen:
            seen |= {key, (~on).tobytes()}
            kept.append(r)
    return kept


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, j] > cut) == above for j, cut, above in rule])


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n = len(y)
    step = 4.0 / max(1e-9, np.linalg.norm(np.c_[x, np.ones(n)], 2) ** 2 / n)
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    u, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = (sigmoid(x @ u + c) - y) / n
        w2 = u - step * (x.T @ r)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2, t2 = c - step * r.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    if len(set(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return {"rules": [], "weights": np.zeros(0), "shift": float(np.log(p / (1 - p)))}
    rules = extract_rules(x, y)
    on = np.stack([holds(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    held, best = np.arange(len(y)) % 4 == 3, None
    for penalty in (3e-2, 1e-2, 3e-3, 1e-3):
        w, b = lasso(on[~held], y[~held], penalty)
        z = on[held] @ w + b
        loss = np.logaddexp(0, -(2 * y[held] - 1) * z).mean()
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    w, b = lasso(on, y, best[1])
    used = np.flatnonzero(w)
    return {"rules": [rules[i] for i in used], "weights": w[used], "shift": b}


def train(docs: DataFrame, labels: DataFrame, fold=FOLD, bound: int = TRAIN_ROWS) -> dict:
    rows = with_statistics(labelled(docs, labels, "quality", bound, fold), ["doc_id", "y"])
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", *STATISTICS)).alias("r")).orderBy("doc_id").select("r.*").collect()
    x = np.array([[r[s] for s in STATISTICS] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r["y"] for r in rows], float))


def compiled(model: dict) -> Column:
    """The score as one expression over the statistics."""
    z = F.lit(float(model["shift"]))
    for rule, w in zip(model["rules"], model["weights"], strict=True):
        on = reduce(lambda a, b: a & b, [(F.col(STATISTICS[j]) > cut) if above else (F.col(STATISTICS[j]) <= cut) for j, cut, above in rule])
        z = z + F.when(on, F.lit(float(w))).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-z))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = with_statistics(docs, ["doc_id"]).withColumn("score", compiled(model))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD[0] == FOLD[1]).alias("held_out"),
        "score",
        (F.col("score") >= GOOD_AT).cast("int").alias("predicted"),
    )
