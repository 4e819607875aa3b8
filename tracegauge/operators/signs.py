"""Which constraints hold in the cases of very many double-null logs, as bits, and the trees of all logs from class sums of these bits.

A constraint's sign in a case is 1 (satisfied), -1 (violated) or 0 (vacuous).  It is vacuous by the case's activities alone, which no order
changes; so a row has many cases of one set of activities in one log: the constraints that apply to the set, and a bit for each
case and constraint that is satisfied.  A level of the trees is one pass over these rows: a task finds the nodes of its cases from the splits
so far and adds up, by node and class, how many satisfy a constraint.  Rows of a log lie together, so a task holds the sums of one log.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ensure
from . import cells, replicates, rules

BITS = "rep int, app binary, y binary, sat binary"
SUMS = "rep int, node long, f int, app0 long, app1 long, sat0 long, sat1 long"
#: Cases of a row; bytes of a row's bits, unpacked.
ROW, UNPACKED = 512, 16 << 20


class Set:
    """The candidates (ctype, a, b) in cases of one set of activities."""

    def __init__(self, acts: list[str], cands: list[tuple], names: list[str]):
        self.names, self.size = names, len(cands)
        place, name = {a: i for i, a in enumerate(acts)}, {t: i for i, t in enumerate(names)}
        self.k, self.app = len(acts), np.zeros(len(cands), bool)
        pairs, alone, ends = [], [], []
        for f, (t, a, b) in enumerate(cands):
            if t not in name:
                self.app[f] = True
                if a in place:
                    ends.append((f, 0 if t == "Init" else -1, place[a]))
            elif a in place and b in place:
                self.app[f] = True
                pairs.append((f, name[t], place[a], place[b]))
            elif (t in replicates.X_LED and a in place) or (t in replicates.Y_LED and b in place):
                self.app[f] = True
                if t == "NotPrecedence" or t.startswith("Alternate"):
                    alone.append((f, t == "NotPrecedence", place[a if t in replicates.X_LED else b]))
        self.pairs, self.alone, self.ends = np.array(pairs, np.int64).reshape(-1, 4).T, alone, ends

    def satisfied(self, codes: np.ndarray) -> np.ndarray:
        """(traces, candidates): which hold and aren't vacuous; ``codes``: a trace, of all activities of the set, in a row."""
        n, length = codes.shape
        out = np.zeros((n, self.size), bool)
        if self.pairs.size:
            f, t, x, y = self.pairs
            if length <= 62:
                out[:, f] = replicates.mask_verdicts(replicates.masks(codes.T, self.k), length, self.names)[t, x, y].T
            else:
                out[:, f] = replicates.pair_verdicts(codes, self.k, self.names)[t, :, x, y].T
        for f, always, a in self.alone:
            out[:, f] = always or (codes == a).sum(1) <= 1
        for f, end, a in self.ends:
            out[:, f] = codes[:, end] == a
        return out


def ordered(cands: DataFrame) -> list[tuple]:
    """The candidates (ctype, a, b) that traces satisfy or violate, in order."""
    own = cands.where(F.col("ctype").isin(*replicates.tp.TRACE_BINARY, *replicates.tp.UNARY)).select("ctype", "a", "b")
    return sorted((tuple(r) for r in own.collect()), key=str)


def null_bits(traces: DataFrame, cands: list[tuple], count: int, seed: int) -> DataFrame:
    """The rows of ``count`` double-null logs, as :func:`resampling.double_null` draws them, and of the log as it is (number ``count``)."""
    change = cells.DoubleNull(traces, count, seed)
    log, found = change.log, {t for t, _, _ in cands}
    names = [t for t in replicates.tp.TRACE_BINARY if t in found]
    columns = ["case_id", "outcome", "trace"] + ([] if log is None else ["under", "near"])
    most = max(1, min(ROW, UNPACKED // max(1, len(cands))))

    def run(batches):
        heads, sets = replicates.Heads([f"{seed + 1}|{r}|".encode() for r in range(count)]), {}
        waiting: dict[tuple, list] = {}

        def rows(acts: tuple):
            y, sat = (np.concatenate(x, axis=1) for x in zip(*waiting.pop(acts), strict=True))
            app = np.packbits(sets[acts].app).tobytes()
            for low in range(0, y.shape[1], most):
                some = slice(low, low + most)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(count + 1, dtype=np.int32)), pa.array([app] * (count + 1), pa.binary()),
                    pa.array([x.tobytes() for x in y[:, some]], pa.binary()), pa.array([x.tobytes() for x in sat[:, some]], pa.binary()),
                ], ["rep", "app", "y", "sat"])

        for batch in batches:
            ids, outcomes, seqs, *draws = (batch.column(c).to_pylist() for c in columns)
            groups: dict[tuple, list[int]] = {}
            for i, t in enumerate(seqs):
                groups.setdefault((tuple(sorted(set(t))), len(t)), []).append(i)
            for (acts, length), places in groups.items():
                if acts not in sets:
                    sets[acts] = Set(list(acts), cands, names)
                code = {a: k for k, a in enumerate(acts)}
                step = max(1, min(replicates.EVENTS // (length * (count + 1)), 4 * UNPACKED // ((count + 1) * max(1, len(cands)))))
                for some in (places[i : i + step] for i in range(0, len(places), step)):
                    own, names_of = np.array([[code[a] for a in seqs[i]] for i in some], np.int64), [ids[i] for i in some]
                    labels = change.labels.drawn(names_of, *[[d[i] for i in some] for d in draws]) if draws else change.labels.many(names_of, 0, count)
                    y = np.concatenate([labels.astype(np.uint8), np.array([[outcomes[i]] for i in some], np.uint8)], 1)
                    null = np.broadcast_to(own[:, None], (len(some), count, length)) if len(acts) == 1 else np.take_along_axis(own[:, None], replicates.drawn_orders(heads, names_of, length), 2)
                    sat = sets[acts].satisfied(np.concatenate([null, own[:, None]], 1).reshape(-1, length))
                    waiting.setdefault(acts, []).append((y.T, np.packbits(sat, axis=1).reshape(len(some), count + 1, -1).transpose(1, 0, 2)))
                    if sum(x.shape[1] for x, _ in waiting[acts]) >= most:
                        yield from rows(acts)
        for acts in list(waiting):
            yield from rows(acts)

    ensure(traces.sparkSession)
    drawn = replicates.dealt((traces if log is None else log).select(*columns), traces.count(), "case_id", most=replicates.MANY_CASES).mapInArrow(run, BITS)
    return rules.stored(drawn.sortWithinPartitions("rep"), "bits")


class Nodes:
    """The splits found so far: of each log, features (-1: none) and thresholds by node."""

    def __init__(self, count: int, depth: int):
        self.feature, self.threshold = np.full((count, 2**depth), -1, np.int32), np.zeros((count, 2**depth))

    def of(self, rep: int, sat: np.ndarray, app: np.ndarray, level: int) -> np.ndarray:
        """The node of each case at ``level``; 0 if it has come to a leaf before."""
        node, rows = np.ones(len(sat), np.int64), np.arange(len(sat))
        for _ in range(level):
            f = self.feature[rep][node]
            value = np.where(sat[rows, f], 1.0, np.where(app[f], -1.0, 0.0))
            node = np.where(f >= 0, 2 * node + (value > self.threshold[rep][node]), 0)
        return node


def class_sums(bits: DataFrame, size: int, nodes: Nodes, level: int, columns: list[np.ndarray] | None = None) -> DataFrame:
    """(rep, node, f, app0, app1, sat0, sat1) at a level: cases by class to which candidate ``f`` (those of ``columns``, by log) applies, and that
    satisfy it; with ``f`` -1 the cases of the node."""
    every = np.arange(size, dtype=np.int64)

    def run(batches):
        def rows(rep, held):
            kept = np.flatnonzero(held.sum((1, 2)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), rep, np.int32)), pa.array(kept + 2**level), pa.array([held[i].tobytes() for i in kept.tolist()], pa.binary())], ["rep", "node", "sums"])

        now, held = None, None
        for batch in batches:
            for rep, app, y, sat in zip(*[batch.column(c).to_pylist() for c in ("rep", "app", "y", "sat")], strict=True):
                of = every if columns is None else columns[rep]
                if rep != now:
                    if held is not None:
                        yield rows(now, held)
                    now, held = rep, np.zeros((2**level, 2, 1 + 2 * len(of)), np.int64)
                y = np.frombuffer(y, np.uint8)
                app, sat = np.unpackbits(np.frombuffer(app, np.uint8), count=size), np.unpackbits(np.frombuffer(sat, np.uint8).reshape(len(y), -1), axis=1, count=size)
                node = nodes.of(rep, sat, app, level)
                there = np.flatnonzero(node)
                cell = np.zeros((2 ** (level + 1), len(there)), np.float32)
                cell[(node[there] - 2**level) * 2 + y[there], np.arange(len(there))] = 1
                n = cell.sum(1)[:, None]
                whole = np.concatenate([n, n * app[of], cell @ sat[there][:, of].astype(np.float32)], 1)
                held += np.rint(whole).astype(np.int64).reshape(held.shape)
        if held is not None:
            yield rows(now, held)

    def add(batches):
        """The parts of a node's sums come one after another."""

        def row(key, total):
            of = every if columns is None else columns[key[0]]
            total = total.reshape(2, -1)
            n, app, sat = total[:, :1], total[:, 1 : 1 + len(of)], total[:, 1 + len(of) :]
            m, counts = len(of) + 1, [*np.concatenate([n, app], 1), *np.concatenate([n, sat], 1)]
            arrays = [pa.array(np.full(m, key[0], np.int32)), pa.array(np.full(m, key[1], np.int64)), pa.array(np.append(-1, of).astype(np.int32)), *[pa.array(x) for x in counts]]
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SUMS.split(", ")])

        now, total = None, None
        for batch in batches:
            for rep, node, part in zip(*[batch.column(c).to_pylist() for c in ("rep", "node", "sums")], strict=True):
                if (rep, node) != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = (rep, node), np.frombuffer(part, np.int64).copy()
                else:
                    total += np.frombuffer(part, np.int64)
        if now is not None:
            yield row(now, total)

    ensure(bits.sparkSession)
    parts = bits.mapInArrow(run, "rep int, node long, sums binary")
    tasks = bits.sparkSession.sparkContext.defaultParallelism
    return rules.stored(parts.repartition(tasks, "rep").sortWithinPartitions("rep", "node").mapInArrow(add, SUMS), "sums")


def grow(bits: DataFrame, first: DataFrame, names: list[str], chosen: DataFrame, count: int, depth: int) -> DataFrame:
    """The trees of :func:`rules.grow` on the ``chosen`` (rep, f) constraints of the logs up to ``count``; ``first``: the class sums of level 0,
    ``names``: the features' names."""
    columns, nodes, out = [np.zeros(0, np.int64)] * count, Nodes(count, depth), None
    for r in chosen.groupBy("rep").agg(F.array_sort(F.collect_list("f")).alias("f")).collect():  # what coverage selects of each log
        columns[r["rep"]] = np.array(r["f"], np.int64)
    group = ["rep", "node"]
    for level in range(depth + 1):
        sums = first if level == 0 else class_sums(bits, len(names), nodes, level, columns if level < depth else [np.zeros(0, np.int64)] * count)
        size = sums.where("f = -1").select(*group, F.col("app0").alias("n0"), F.col("app1").alias("n1"))
        if level == depth:
            found, best = size.withColumn("feature", F.lit(None).cast("string")).withColumn("threshold", F.lit(None).cast("double")), None
        else:
            held = sums.join(F.broadcast(chosen), ["rep", "f"]).withColumn("feature", F.element_at(F.lit(names), F.col("f") + 1))
            signs = [(0, -1.0, F.col("app0") - F.col("sat0"), F.col("app1") - F.col("sat1")), (1, 1.0, F.col("sat0"), F.col("sat1"))]
            bars = F.array(*[F.struct(F.lit(b).alias("bin"), c0.alias("c0"), c1.alias("c1"), F.lit(v).alias("low"), F.lit(v).alias("high")) for b, v, c0, c1 in signs])
            hist = held.select(*group, "feature", F.explode(bars).alias("h")).select(*group, "feature", "h.*").where("c0 + c1 > 0")
            best = rules.stored(rules.best_of(hist, size.where("n0 > 0 and n1 > 0"), group).select(*group, "feature", "threshold"), "splits")
            found = size.join(best, group, "left")
        out = found if out is None else out.unionByName(found)
        split = [] if best is None else best.collect()  # 2 ** level for each log at most
        if not split:
            break
        place = {name: i for i, name in enumerate(names)}
        for r in split:
            nodes.feature[r["rep"], r["node"]], nodes.threshold[r["rep"], r["node"]] = place[r["feature"]], r["threshold"]
    return rules.stored(out.select(*group, "n0", "n1", "feature", "threshold"), "tree")
