"""Resampling tests of constraints.

A replicate leaves the traces, or their activities, alone; so what a case adds to a pattern is known where the case is, for
all replicates at once.  Tasks draw for their own cases and add up vectors, one for each pattern with a place for each
replicate (:mod:`replicates`); only vectors are shuffled, and, for label permutations, the few draws that lie so close to
a replicate's cut that they have to be ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import templates as tp
from ..shared import shared_folder
from ..shipping import ensure
from . import replicates
from .hashes import LANES, Heads, md5

KEYS = replicates.KEYS
#: Draws that are handed out at a time.
BATCH = 20_000
_DRAWN = "outer int, ctype string, a string, b string, sums binary, rep int, h binary, case_id string, trace array<string>, below array<long>"


def _label_parts(cases: DataFrame, names: list[str], unary: list[str], count: int, seed: int, low: int, high: int) -> DataFrame:
    """One pass over the cases, with their draws against a band: a task's vectors [applicable, satisfied] of [all cases,
    positive ones, and each replicate's positives], as far as they lie below the band; every draw in the band with its
    trace; and how many of a task's draws are below it."""

    def run(batches):
        names_out = [c.split()[0] for c in _DRAWN.split(", ")]
        types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
        rows = lambda n, **given: pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names_out, types, strict=True)], names_out)
        sums = lambda: (rows(b.num_rows, **{c: b.column(c) for c in ("outer", *KEYS, "sums")}) for b in held.rows())
        held, below = replicates.Products(count + 2, names, unary), np.zeros(count, np.int64)
        texts = [f"{seed}|{r}|".encode() for r in range(count)]
        heads, many = Heads(texts), max(1, 4 * LANES // count)
        waiting, size = [], 0

        def in_band():
            reps, digests, ids, traces = zip(*waiting, strict=True)
            of = np.repeat(np.arange(len(ids)), [len(x) for x in reps])
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(of), [None, pa.py_buffer(b"".join(digests))])
            return rows(len(of), rep=np.concatenate(reps), h=raw.cast(pa.binary()), case_id=pa.array(ids, pa.string()).take(pa.array(of)), trace=pa.array(traces, pa.list_(pa.string())).take(pa.array(of)))

        for batch in batches:
            ids, outcomes, traces = (batch.column(c).to_pylist() for c in ("case_id", "outcome", "trace"))
            draws = (h for i in range(0, len(ids), many) for h in heads.first64([c.encode() for c in ids[i : i + many]]))
            for case_id, outcome, trace, h in zip(ids, outcomes, traces, draws, strict=True):
                under = h < low
                below += under
                of = held.of(trace)
                of[0] += 1
                of[1] += outcome
                of[2:] += under
                near = np.flatnonzero(~under & (h <= high))
                if len(near):
                    digests = b"".join([md5(texts[k] + case_id.encode()).digest() for k in near.tolist()])
                    waiting.append((near, digests, case_id, trace))
                    size += len(near)
                if size >= BATCH:
                    yield in_band()
                    waiting, size = [], 0
                if held.full():
                    yield from sums()
        if waiting:
            yield in_band()
        yield from sums()
        yield rows(1, below=[below])

    ensure(cases.sparkSession)
    return cases.mapInArrow(run, _DRAWN)


def label_sums(traces: DataFrame, cands: DataFrame, count: int, seed: int) -> DataFrame:
    """Candidates' vectors [applicable, satisfied] of [all cases, positive ones, the positives of ``count`` permutations].

    A replicate's positives are its n1 smallest draws.  Draws are uniform, so all below a band around n1 / n are positive
    and all above it aren't; those in the band, some sqrt(n) of them, are ranked.  Should a replicate's cut lie outside
    the band, everything is ranked.
    """
    spark, cands = traces.sparkSession, replicates.stored(cands)
    names, unary = replicates.templates(cands)
    n, n1 = traces.agg(F.count(F.lit(1)), F.sum("outcome")).first()
    n1 = n1 or 0
    share = n1 / max(n, 1)
    half = replicates.BAND * (share * (1 - share) / max(n, 1)) ** 0.5
    cases = replicates.dealt(traces.select("case_id", "outcome", "trace"), n, "case_id")
    for low, high in ((max(0.0, share - half), min(1.0, share + half)), (0.0, 1.0)):
        folder = shared_folder(spark, "labels")
        _label_parts(cases, names, unary, count, seed, *(min(int(x * 2.0**64), 2**64 - 1) for x in (low, high))).write.parquet(folder)
        drawn = spark.read.schema(_DRAWN).parquet(folder)
        below = drawn.where("below is not null").select(F.posexplode("below").alias("rep", "c")).groupBy("rep").agg(F.sum("c").alias("c"))
        near = drawn.where("rep is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("m"))
        left = [(r["rep"], n1 - r["c"], r["m"] or 0) for r in below.join(near, "rep", "left").collect()]  # one row for each replicate
        if all(0 <= k <= m for _, k, m in left):
            break
    quota = spark.createDataFrame([(r, k) for r, k, _ in left], "rep int, quota long")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("h", "case_id"))
    more = drawn.where("rep is not null").select("rep", "h", "case_id", "trace").join(F.broadcast(quota), "rep").withColumn("rank", rank).where("rank <= quota")
    more = more.groupBy("trace", "rep").agg(F.count(F.lit(1)).alias("k")).groupBy("trace").agg(F.collect_list("rep").alias("reps"), F.collect_list("k").alias("ks"))

    def add(batches):
        held = replicates.Products(count + 2, names, unary)
        for batch in batches:
            reps, ks = (batch.column(c) for c in ("reps", "ks"))
            cut = np.append(0, np.cumsum(reps.value_lengths().to_numpy(zero_copy_only=False)))
            reps, ks = (c.flatten().to_numpy(zero_copy_only=False) for c in (reps, ks))
            for i, trace in enumerate(batch.column("trace").to_pylist()):
                held.of(trace)[2 + reps[cut[i] : cut[i + 1]]] += ks[cut[i] : cut[i + 1]]
                if held.full():
                    yield from held.rows()
        yield from held.rows()

    parts = drawn.where("sums is not null").select("outer", *KEYS, "sums").unionByName(more.mapInArrow(add, replicates.PARTIAL))
    return replicates.by_candidate(replicates.added(parts), cands, 1)


def label_permutation(traces: DataFrame, cands: DataFrame, count: int, seed: int = 42, keep_null: bool = False) -> DataFrame:
    """Per pattern that applies somewhere: observed prevalences and their difference, one- and two-sided p-values, null
    mean and deviation.

    With ``keep_null`` also ``null``: the statistic of every replicate.
    """

    def statistics(batches):
        share = lambda x, n: np.divide(x, n, out=np.zeros(len(x)), where=n > 0)
        for pdf in batches:
            out = []
            for *key, both, x, y, every in zip(*[pdf[c] for c in (*KEYS, "both", "x", "y", "every")], strict=True):
                app, sat = replicates.total((both, x, y, every), 2 * (count + 2)).reshape(2, -1)
                if not app[0]:
                    continue
                own = share(np.array([sat[0] - sat[1], sat[1]]), np.array([app[0] - app[1], app[1]]))
                stat = np.round(share(sat[1:], app[1:]) - share(sat[0] - sat[1:], app[0] - app[1:]), 12)
                null, seen = stat[1:], stat[0]
                mean = null.sum() / count
                one = int((null >= seen).sum() if seen >= 0 else (null <= seen).sum())
                out.append((*key, *own, seen, int((np.abs(null) >= abs(seen)).sum()), one, mean, max(0.0, (null**2).sum() / count - mean * mean) ** 0.5, null if keep_null else np.zeros(0)))
            yield pd.DataFrame(out, columns=[*KEYS, "prev0", "prev1", "delta", "exceed_two", "exceed_one", "null_mean", "null_std", "null"])

    found = label_sums(traces, cands, count, seed).mapInPandas(
        statistics, "ctype string, a string, b string, prev0 double, prev1 double, delta double, exceed_two long, exceed_one long, null_mean double, null_std double, null array<double>")
    return found.withColumn("p_two", (1 + F.col("exceed_two")) / F.lit(count + 1.0)).withColumn("p_one", (1 + F.col("exceed_one")) / F.lit(count + 1.0))


def difference_test(traces: DataFrame, cands: DataFrame, count: int, alpha: float = 0.05, seed: int = 42, least_difference: float = 0.0, least_interest: float = 0.0) -> DataFrame:
    """The unsigned permutation test of confidences: the observed log counts as one replicate (C starts at 1)."""
    out = label_permutation(traces, cands, count, seed).select(
        *KEYS, F.col("prev0").alias("conf0"), F.col("prev1").alias("conf1"), F.abs("delta").alias("ediff"), (1 + F.col("exceed_two")).alias("count_c"),
    )
    out = out.where((F.col("ediff") >= least_difference) & (F.greatest("conf0", "conf1") >= least_interest))
    p = F.col("count_c") / F.lit(float(count))
    return out.withColumn("p", p).withColumn("p_plus", F.col("count_c") / F.lit(count + 1.0)).withColumn("significant", p <= alpha).withColumn(
        "direction", F.when(F.col("conf1") >= F.col("conf0"), "positive").otherwise("negative"))


def structural_permutation(traces: DataFrame, cands: DataFrame, count: int, seed: int = 42, negative=tp.NEGATIVE) -> DataFrame:
    """Per pattern that applies somewhere: prevalence of one class against logs whose traces are shuffled.

    Even replicates screen, odd ones test.  Upper tail; for negative templates twice the smaller tail.  How many cases a
    pattern applies to doesn't depend on their orders, so counts of satisfied cases stand for prevalences.
    """
    sums = replicates.order_counts(traces, cands, count, seed)

    def tails(batches):
        for pdf in batches:
            rows = []
            for ctype, a, b, *parts in zip(*[pdf[c] for c in ("ctype", "a", "b", "both", "x", "y", "every")], strict=True):
                v = replicates.total(parts, count + 2)
                if v[0] > 0:
                    p = [replicates.tail_p(v[2 + k :: 2], v[1], ctype in negative) for k in (0, 1)]
                    rows.append((ctype, a, b, round(v[1] / v[0], 12), *p))
            yield pd.DataFrame(rows, columns=["ctype", "a", "b", "prev", "p_screen", "p_struct"])

    return sums.mapInPandas(tails, "ctype string, a string, b string, prev double, p_screen double, p_struct double")
