"""Quality rules: base counts, then a hashed n-gram logistic regression against fixed thresholds.

Features are hashed words, word pairs and character 4-grams, each as a share of the text's total, so a
score is the sum of three mean weights and a text of any length is read whole.  The model is fitted on at
most TRAIN_ROWS labelled documents, a fifth of which calibrate its probability; texts are scored in Arrow
batches.

Defined cases: a null or empty text has all counts 0 and fails the base rules; labels with a null are not
learnt from; without both classes among the labels the model keeps everything that passes the base rules;
a doc_id labelled twice counts with its larger label; repeated rows are scored each; there is nothing to tie;
texts of any length are read whole; an empty table gives an empty result; further columns are ignored by the
scores, and ``keep_good`` returns them as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import Sparse, calibrate, fit_logistic, labelled, sigmoid
from .textkit import SPACE, Chunk, add_columns, by_chunk

BITS = 14
WIDTH = 1 << BITS
TRAIN_ROWS = 3000
#: Fixed thresholds.
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_AT = 50, 50, 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True

COUNTS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def base_counts(c: Chunk) -> dict:
    """The five counts, of a chunk that isn't case-folded."""
    h = c.word_hashes()
    out = {
        "n_words": c.words,
        "word_chars": c.count(~SPACE[c.buf] & ((c.buf & 0xC0) != 0x80)),
        "n_symbols": c.count(SYMBOLS[c.buf]),
    }
    # lines: spans between newlines; the byte after each text is a newline
    breaks = np.flatnonzero(c.buf == 10)
    first = np.concatenate([[0], breaks[:-1] + 1])
    if len(c.starts):
        word = np.searchsorted(c.starts, first)
        has_word = (word < len(c.starts)) & (np.append(c.starts, len(c.buf))[word] < breaks)
    else:
        has_word = np.zeros(len(breaks), bool)
    first, last = first[has_word], breaks[has_word]
    of = np.searchsorted(c.begin, first, "right") - 1
    out["n_dup_lines"] = np.bincount(of, minlength=c.n) - _distinct(of, c.hash_of(first, last), c.n)
    x, at = c.windows(h, 3)
    covered = np.zeros(len(h) + 2, bool)
    if len(x):
        order = np.lexsort((x, c.doc[at]))
        same = (np.diff(x[order]) == 0) & (np.diff(c.doc[at][order]) == 0)
        twice = np.zeros(len(x), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i in range(3):
            covered[at[twice] + i] = True
    total = np.concatenate([[0], np.cumsum(covered[: len(h)], dtype=np.int64)])
    out["n_repeat_words"] = total[c.word_at + c.words] - total[c.word_at]
    return out


def _distinct(of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(of[order]) != 0)
    return np.bincount(of[order][new], minlength=n)


def _grams(c: Chunk):
    """Buckets of words, word pairs and character 4-grams, each with the span of every text."""
    shift = np.uint64(64 - BITS)
    h = c.word_hashes()
    pairs, at = c.windows(h, 2)
    n_pairs = np.maximum(c.words - 1, 0)
    pair_at = np.cumsum(n_pairs) - n_pairs
    b = c.buf.astype(np.uint32)
    with np.errstate(over="ignore"):
        g = b[:-3] * np.uint32(0x9E3779B1) + b[1:-2] * np.uint32(0x85EBCA6B) + b[2:-1] * np.uint32(0xC2B2AE35) + b[3:] * np.uint32(0x27D4EB2F)
        g = ((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    return (
        ((h >> shift).astype(np.int64), c.word_at, c.word_at + c.words),
        ((pairs >> shift).astype(np.int64), pair_at, pair_at + n_pairs),
        (g, c.begin, np.maximum(c.end - 3, c.begin)),
    )


def features(c: Chunk) -> dict:
    """Per text, its hashed n-grams as sparse rows: at most 3 x WIDTH of them."""
    index, value = [], []
    parts = _grams(c)
    for d in range(c.n):
        i, v = [], []
        for k, (bucket, first, last) in enumerate(parts):
            if (n := last[d] - first[d]) > 0:
                u, m = np.unique(bucket[first[d] : last[d]], return_counts=True)
                i.append(u.astype(np.int32) + k * WIDTH)
                v.append((m / n).astype(np.float32))
        index.append(np.concatenate(i).tobytes() if i else b"")
        value.append(np.concatenate(v).tobytes() if v else b"")
    return {"index": np.array(index, object), "value": np.array(value, object)}


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = TRAIN_ROWS) -> dict:
    rows = add_columns(
        labelled(docs, labels, target, bound), lambda: by_chunk(features, fold=False),
        [T.StructField("index", T.BinaryType()), T.StructField("value", T.BinaryType())], ["doc_id", "y"],
    )
    # a doc_id that is there many times gives one row, so that at most ``bound`` rows reach the driver
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", "index", "value")).alias("r")).orderBy("doc_id").select("r.*").collect()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return {"weights": np.zeros(3 * WIDTH, np.float32), "shift": 0.0, "a": 0.0, "b": 4.0}
    held = np.arange(len(y)) % 5 == 4
    pairs = lambda which: [(np.frombuffer(rows[i]["index"], np.int32), np.frombuffer(rows[i]["value"], np.float32)) for i in np.flatnonzero(which)]
    fitted, rest = Sparse(pairs(~held), 3 * WIDTH), Sparse(pairs(held), 3 * WIDTH)
    del rows
    fitted.value *= SCALE
    w, shift = fit_logistic(fitted, y[~held], 1e-4)
    w *= SCALE
    score = rest.dot(w) + shift
    a, b = calibrate(score, y[held])
    return {"weights": w.astype(np.float32), "shift": shift, "a": a, "b": b}


#: Shares of single n-grams are small; this brings them near 1 for the penalty.
SCALE = 20.0


def score_columns(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus the five counts and the calibrated probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 x WIDTH floats

    def kernel():
        m = shared.value

        def run(c: Chunk) -> dict:
            z = np.full(c.n, m["shift"])
            for k, (bucket, first, last) in enumerate(_grams(c)):
                z += c.mean_over(m["weights"][k * WIDTH : (k + 1) * WIDTH][bucket], first, last)
            return base_counts(c) | {"p_good": sigmoid(m["a"] * z + m["b"])}

        return by_chunk(run, fold=False)

    return add_columns(docs, kernel, [*COUNTS, T.StructField("p_good", T.DoubleType())], keep, text)


def verdict(scored: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= KEEP_AT))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = verdict(score_columns(docs, train(docs, labels), ["doc_id"]))
    return scored.select("doc_id", *[c.name for c in COUNTS], "base_failed", "kept", F.col("p_good").alias("quality_score"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that pass, with all their columns; a row's own columns of clashing names stay."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    scored = verdict(score_columns(docs.toDF(*names), train(docs, labels), names, names[docs.columns.index("text")]))
    return scored.where("kept").select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)])
