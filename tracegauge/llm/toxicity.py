"""Toxicity: a factorization machine over hashed terms.

Terms are runs of letters and digits, whole and as their first 4 to 8 bytes (which catch inflected
forms).  A document has each term once, and a second time as "twice or more" if it repeats.  Two passes over at most TRAIN_ROWS labelled documents: the first
counts, for every bucket, in how many toxic and other documents it lies (added up on the executors) and
picks the FEATURES buckets that tell the classes apart best; the second brings those features of the sample
to the driver, at most TRAIN_ROWS x FEATURES small numbers.  The machine adds to linear weights the inner products
of RANK-sized factors for every pair of terms, so that pairs count that are harmless apart.

Defined cases: a null or empty text has no terms and gets the score of the shift alone; labels with a null
are not learnt from; with labels of one class only, or without a term that MIN_ROWS labelled texts have, every
score is the smoothed share of label 1, and without any labels it is 0; a doc_id labelled twice counts with its
larger label; repeated rows are scored each; terms that tie are taken in order of their buckets; texts of any
length are read whole; an empty table gives an empty result; further columns are ignored by the scores, and
``keep_clean`` returns them as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map
from .learning import Sparse, labelled, sigmoid
from .textkit import Chunk, add_columns, by_chunk, chunks, mix

BITS = 20
TRAIN_ROWS = 20_000
FEATURES = 2048
MIN_ROWS = 3
RANK = 8
#: Fixed threshold.
TOXIC_AT = 0.3
STEMS = (4, 5, 6, 7, 8)
#: Rows whose crc32(doc_id as text) mod 4 is 2 are held out.
FOLD = (4, 2)
SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[65:91] = SEPARATOR[97:123] = SEPARATOR[128:] = False


def buckets(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every term, repeats included."""
    shift = np.uint64(64 - BITS)
    of, found = [c.doc], [c.word_hashes() >> shift]
    size = c.ends - c.starts
    for k in STEMS:
        long = np.flatnonzero(size >= k)
        with np.errstate(over="ignore"):
            h = mix(c.hash_of(c.starts[long], c.starts[long] + k) + np.uint64(k))
        of.append(c.doc[long])
        found.append(h >> shift)
    return np.concatenate(of), np.concatenate(found).astype(np.int64)


def _unique(of: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature); a bucket met twice gives a second feature, 1 << BITS further on."""
    key, times = np.unique((of.astype(np.int64) << BITS) | b, return_counts=True)
    of, b = key >> BITS, key & ((1 << BITS) - 1)
    more = times > 1
    return np.concatenate([of, of[more]]), np.concatenate([b, b[more] + (1 << BITS)])


def _term_counts(batches):
    counts = np.zeros((2, 2 << BITS), np.int32)
    for batch in batches:
        texts = [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]
        y, at = np.array(batch.column("y").to_pylist(), int), 0
        for part in chunks(texts):
            c = Chunk(part, separator=SEPARATOR)
            of, b = _unique(*buckets(c))
            for k in (0, 1):
                counts[k] += np.bincount(b[y[at + of] == k], minlength=2 << BITS).astype(np.int32)
            at += c.n
    some = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some].astype(np.int64)), pa.array(counts[1, some].astype(np.int64))], ["bucket", "n0", "n1"])


def select_terms(sample: DataFrame) -> np.ndarray:
    n = {int(r["y"]): r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return np.empty(0, np.int64)
    counts = arrow_map(sample.select("text", "y"), _term_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    total, seen = float(n[0] + n[1]), a + b
    chi = total * F.pow(a * n[0] - b * n[1], 2) / (seen * (total - seen + 1.0) * float(n[0]) * float(n[1]))
    best = counts.where(seen >= MIN_ROWS).orderBy(chi.desc(), "bucket").limit(FEATURES).select("bucket").collect()
    return np.array(sorted(r[0] for r in best), np.int64)


def _place(terms: np.ndarray) -> np.ndarray:
    place = np.full(2 << BITS, -1, np.int16)
    place[terms] = np.arange(len(terms))
    return place


def _active(c: Chunk, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of, b = buckets(c)
    on = (place[: 1 << BITS][b] >= 0) | (place[1 << BITS :][b] >= 0)
    of, b = _unique(of[on], b[on])
    at = place[b].astype(np.int64)
    return of[at >= 0], at[at >= 0]


def train(docs: DataFrame, labels: DataFrame, fold=FOLD, bound: int = TRAIN_ROWS, seed: int = 1) -> dict:
    sample = labelled(docs, labels, "toxic", bound, fold)
    terms = select_terms(sample)
    if not len(terms):  # nothing to tell texts apart by: the smoothed share of label 1
        n, n1 = sample.select("doc_id", "y").distinct().agg(F.count(F.lit(1)), F.sum("y")).first()
        shift = float(np.log(((n1 or 0) + 0.5) / (n - (n1 or 0) + 0.5))) if n else -35.0
        return {"terms": terms, "shift": shift, "linear": np.zeros(0), "factors": np.zeros((0, RANK))}
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most FEATURES numbers

    def kernel():
        place = _place(shared.value)

        def run(c: Chunk) -> dict:
            of, at = _active(c, place)
            order = np.argsort(of, kind="stable")
            of, at = of[order], at[order]
            cut = np.searchsorted(of, np.arange(c.n + 1))
            return {"on": np.array([at[i:j].astype(np.int16).tobytes() for i, j in zip(cut, cut[1:], strict=False)], object)}

        return by_chunk(run, separator=SEPARATOR)

    rows = add_columns(sample, kernel, [T.StructField("on", T.BinaryType())], ["doc_id", "y"])
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", "on")).alias("r")).orderBy("doc_id").select("r.*").collect()
    y = np.array([r["y"] for r in rows], float)
    on = [np.frombuffer(r["on"], np.int16) for r in rows]
    return fit(Sparse([(i, np.ones(len(i))) for i in on], len(terms)), y, seed) | {"terms": terms}


def fit(x: Sparse, y: np.ndarray, seed: int = 1, steps: int = 300, l2: float = 1e-4, rate: float = 0.1) -> dict:
    """Full-batch AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    shift = float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)))
    w, v = np.zeros(x.width), rng.normal(0, 0.01, (x.width, RANK))
    gw, gv, gs = np.full(x.width, 1e-8), np.full((x.width, RANK), 1e-8), 1e-8
    for _ in range(steps):
        s = np.stack([x.dot(v[:, f]) for f in range(RANK)], 1)
        z = shift + x.dot(w) + 0.5 * (s**2).sum(1) - 0.5 * x.dot((v**2).sum(1))
        r = (sigmoid(z) - y) / len(y)
        own = x.tdot(r)
        dw = own + l2 * w
        dv = np.stack([x.tdot(r * s[:, f]) for f in range(RANK)], 1) - v * own[:, None] + l2 * v
        ds = r.sum()
        gw += dw**2
        gv += dv**2
        gs += ds**2
        w -= rate * dw / np.sqrt(gw)
        v -= 0.3 * rate * dv / np.sqrt(gv)
        shift -= rate * ds / np.sqrt(gs)
    return {"shift": shift, "linear": w, "factors": v}


def logits(x: Sparse, model: dict) -> np.ndarray:
    v = model["factors"]
    s = np.stack([x.dot(v[:, f]) for f in range(RANK)], 1)
    return model["shift"] + x.dot(model["linear"]) + 0.5 * (s**2).sum(1) - 0.5 * x.dot((v**2).sum(1))


def score_columns(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        m = shared.value
        place, v = _place(m["terms"]), m["factors"]
        square = (v**2).sum(1)

        def run(c: Chunk) -> dict:
            of, at = _active(c, place)
            z = np.full(c.n, m["shift"])
            if len(at):
                z += np.bincount(of, m["linear"][at] - 0.5 * square[at], c.n)
                for f in range(RANK):
                    z += 0.5 * np.bincount(of, v[at, f], c.n) ** 2
            return {"score": sigmoid(z)}

        return by_chunk(run, separator=SEPARATOR)

    return add_columns(docs, kernel, [T.StructField("score", T.DoubleType())], keep, text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_columns(docs, train(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD[0] == FOLD[1]).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows below the threshold, with all their columns."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    scored = score_columns(docs.toDF(*names), train(docs, labels), names, names[docs.columns.index("text")])
    return scored.where(F.col("score") < TOXIC_AT).select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)])
