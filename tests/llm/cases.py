"""Small documents that hold every odd case, and brute-force readings of them."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rows(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randint(2, 8))) for _ in range(150)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    out = [text(rng.randint(1, 120)) for _ in range(n)]
    long = text(90)
    out += [long] * 12 + [long.replace(" ", "\n", 3), long.upper(), long + " x", long.replace(" ", "\t\t")]
    out += [" ".join([*long.split()[:k], "zz", *long.split()[k + 1 :]]) for k in range(5, 80, 9)]
    out += [None, None, "", " ", "\n\n", "one", "one two", "One TWO", "a a a a a a", "x\n\nx\nx\n y\n y", "#*$ %&| <>", "\x1c\x1d a\x85b c d", "l'été n'est", "don't SAY it's 12ab34 %%%", "a" * 3000, "ab " * 4000, "日本語 テスト", "<|endoftext|> x <|ENDOFTEXT|>", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"]
    data = [(i * 7 % 1009, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), len(t) if t and rng.random() < 0.9 else None) for i, t in enumerate(out)]
    return data + [data[0], data[0], (None, "no id", "en", "s0", 5), (None, long, "en", "s0", 5)]


def documents(spark, extra=False, data=None):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    if extra:  # columns whose names operators use themselves
        for c in ("uid", "name", "score", "kept", "n_words", "size", "shard", "block", "class", "set", "key", "_h", "p_good", "__text", "width", "pos"):
            df = df.withColumn(c, F.lit("x"))
    return df


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def base_counts(text):
    w = words(text)
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=3):
    w = words(fold(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(data, k=3, percent=85):
    """row index -> component, by comparing all pairs; rows with one doc_id are one node only if they are linked."""
    sets = [shingles(r[1], k) for r in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(data)):
        groups.setdefault(root(i), []).append(i)
    out = {}
    for members in groups.values():
        ids = [data[i][0] for i in members if data[i][0] is not None]
        for i in members:
            out[i] = (data[i][0], len(sets[i]), min(ids) if ids else None)
    return out
