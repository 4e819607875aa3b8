"""Substring dedup against all windows, and the interiors of windows against their surroundings."""

import hashlib
import random
import re

import numpy as np
import pytest

from tracegauge.llm import recompression

FIELDS = "doc_id long, text string"


def _brute(rows, window):
    texts = [(2**63 - 1 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for d, words in texts:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for (doc_id, _), (d, words) in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def _texts(seed, words, window):
    """Texts over few words, with passages of about a window's length in many of them, runs and periods."""
    r = random.Random(seed)
    word = lambda: r.choice(words)
    passages = [[word() for _ in range(window + k)] for k in (-1, 0, 1, 3, 20)] + [[words[0]] * (2 * window), [words[0], words[1]] * window, ["a", "b", "a"] * window]
    out = []
    for _ in range(40):
        t = []
        for _ in range(r.randrange(0, 5)):
            t += r.choice(passages) if r.random() < 0.5 else [word() for _ in range(r.randrange(0, 2 * window))]
        out.append(r.choice([" ", "\n", " \t"]).join(t))
    return out


def _got(df, **how):
    return sorted((tuple(x) for x in recompression.substring_dedup(df, **how).collect()), key=repr)


@pytest.mark.parametrize(("seed", "window", "vocabulary"), [(1, 50, 2000), (2, 50, 3), (3, 7, 2), (4, 7, 40)])
def test_against_all_windows(spark, seed, window, vocabulary):
    texts = _texts(seed, [f"w{i}é" for i in range(vocabulary)], window)
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, texts[4]), (5, texts[6]), (7, texts[7]), (7, texts[7]), (-1, texts[9]), (100, None), (101, ""), (102, " \n")]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 as d", "'x' as name", "2 as key", "3 as at", "4 as rep")
    assert _got(df, window=window) == _brute(rows, window)


def test_long_texts_and_words(spark):
    r = random.Random(5)
    words = [str(r.randrange(10**6)) for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, "new " * 60 + " ".join(words[1000:150_000]) + " end"), (3, "y" * 1_300_000), (4, "\n" * 1_200_000), (5, "same " * 250_000), (6, "same " * 55)]
    assert _got(spark.createDataFrame(rows, FIELDS)) == _brute(rows, 50)


def test_empty_table(spark):
    out = recompression.substring_dedup(spark.createDataFrame([], FIELDS))
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("vocabulary", [2, 5, 1000])
def test_anchor_depends_on_window_only(vocabulary):
    r = np.random.default_rng(vocabulary)
    for _ in range(200):
        inner = r.integers(1, vocabulary + 1, 30).astype(np.uint64)
        seen = set()
        for _ in range(5):
            before, after = (r.integers(1, vocabulary + 1, r.integers(0, 20)).astype(np.uint64) for _ in range(2))
            place, length, name = recompression.anchors(np.concatenate([before, inner, after]), np.array([len(before)]), 30)
            seen.add((int(place[0]) - len(before), int(length[0]), int(name[0])))
        assert len(seen) == 1
