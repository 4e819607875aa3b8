"""The dual-axis protocol: which constraints separate two classes of cases, under false-discovery control."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import templates as tp
from ..operators import counted as counted_draws, replicates, rules, significance, tests_of_difference
from ..operators.hashes import LANES, Heads
from ..shipping import ensure

KEYS = ["ctype", "a", "b"]
#: Cases of one multiset of activities that are taken together.
TOGETHER = 64


@dataclass(frozen=True)
class Budget:
    """Replicates and levels; the axis weights follow from the replicates."""

    label: int = 1500
    order: int = 2000
    outer: int = 200
    inner_label: int = 75
    inner_order: int = 75
    alpha: float = 0.05
    seed: int = 42


def _joined(x: DataFrame, y: DataFrame, extra: list[str] = (), how: str = "inner") -> DataFrame:
    """Join on the pattern keys, null-safe (b is null for unary templates), and on ``extra``; y's other columns
    are added to x's."""
    keys = [*extra, *KEYS]
    renamed = y.select(*[F.col(k).alias(f"_y_{k}") for k in keys], *[c for c in y.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_y_{k}"))
    return x.join(renamed, cond, how).drop(*[f"_y_{k}" for k in keys])


def axes(traces: DataFrame, cands: DataFrame, n_label: int, n_order: int, seed: int) -> DataFrame:
    """Per pattern: prevalences, label p-value, and order p-values (screen and test) of either class."""
    label = tests_of_difference.label_permutation(traces, cands, n_label, seed)
    out = label.select(*KEYS, "delta", F.col("p_two").alias("p_disc"))
    for k in (0, 1):
        s = tests_of_difference.structural_permutation(traces.where(F.col("outcome") == k), cands, n_order, seed + 1)
        s = s.select(*KEYS, F.col("prev").alias(f"prev{k}"), F.col("p_screen").alias(f"p_screen{k}"), F.col("p_struct").alias(f"p_struct{k}"))
        out = _joined(out, s, how="left").na.fill({f"prev{k}": 0.0, f"p_screen{k}": 1.0, f"p_struct{k}": 1.0})
    return out


def dominant(tested: DataFrame, w_order: float, w_label: float) -> DataFrame:
    """Adds the dominant class, its order p-value and the combined statistic."""
    one = F.col("prev1") >= F.col("prev0")
    out = tested.withColumn("dominant", one.cast("int")).withColumn("p_struct", F.when(one, F.col("p_struct1")).otherwise(F.col("p_struct0")))
    return out.withColumn("t", significance.combined_statistic("p_struct", "p_disc", w_order, w_label))


class Group:
    """The cases of one multiset of activities in a block of ``many`` outer replicates: their labels by null order, and their numbers by
    class and order."""

    def __init__(self, held: replicates.Vectors, acts: list[str], names: list[str], unary: list[str], many: int, labels_to: int, orders: int, counted: bool = False):
        self.held, self.labels_to, self.many, self.counted = held, labels_to, many, counted
        self.t = replicates.Trace(acts, names, unary)
        self.step = max(1, replicates.EVENTS // (orders * len(acts) * self.t.k**2))
        # numbers of cases come by order; cases have to be found among the orders
        self.found = (replicates.distinct_orders(self.t.codes, counted_draws.ORDERS), None) if counted else replicates.places(self.t.codes, self.t.k)
        if self.found:
            self.step = many
            self.labels = np.zeros((len(self.found[0]), many, labels_to))
            self.orders = np.zeros((len(self.found[0]), many, 2, orders))

    def together(self, inner_labels: int, orders: int) -> int:
        """Cases whose draws are made at a time."""
        return max(1, 4 * LANES // (self.step * max(inner_labels, orders * len(self.t.codes)))) if self.found else 1

    def add(self, low: int, high: int, drawn: np.ndarray, codes: np.ndarray) -> None:
        """Labels (cases, replicates, inner and as labelled) and codes (cases, replicates, as ordered and inner, places) in the
        replicates from ``low`` up to ``high`` of the block."""
        if self.found:
            rows, at, orders = np.arange(high - low), self.found[1].of(codes), self.orders.shape[3]
            for label, place in zip(drawn, at[:, :, 0], strict=True):
                self.labels[place, rows] += label
            cell = ((at * self.step + rows[:, None]) * 2 + drawn[:, :, -1:]) * orders + np.arange(orders)
            self.orders += np.bincount(cell.reshape(-1), minlength=self.orders.size).reshape(self.orders.shape)
            return
        for label, code in zip(drawn, codes, strict=True):
            verdicts = self.t.verdicts(code.reshape(-1, code.shape[2])).reshape(-1, *code.shape[:2])
            y = np.stack([1 - label[:, -1], label[:, -1]], 1)
            self.put(slice(low, high), label, y, verdicts[:, :, :1] * label, verdicts[:, :, None] * y[:, :, None])

    def put(self, rows: slice, drawn, classes, satisfied, ordered) -> None:
        at, app, app_to = self.held.at(self.t.keys), self.t.app[:, None, None], 2 * self.labels_to
        v = self.held.values
        v[at, rows, : self.labels_to] += app * drawn
        v[at, rows, self.labels_to : app_to] += satisfied
        v[at, rows, app_to : app_to + 2] += app * classes
        v[at, rows, app_to + 2 :] += ordered.reshape(len(at), ordered.shape[1], -1)

    def close(self) -> None:
        if self.found:
            whole = lambda x: np.rint(x).astype(np.int64)
            verdicts = self.t.verdicts(self.found[0]).astype(float)
            classes = self.orders[:, :, :, 0].sum(0)
            self.put(slice(0, self.many), whole(self.labels.sum(0)), whole(classes), whole(np.tensordot(verdicts, self.labels, 1)), whole(np.tensordot(verdicts, self.orders, 1)))


def null_statistics(traces: DataFrame, cands: DataFrame, b: Budget, w_order: float, w_label: float, negative=tp.NEGATIVE, counted: bool = False) -> DataFrame:
    """(outer, ctype, a, b, p_label, p_order, t): p-values and combined statistic on double-null logs, all outer
    replicates in one job.

    A double-null log has a null label and a null trace for each case, inner labels for the log and inner orders for its traces.  They are
    drawn by the hash of each case (:func:`hashed`), as SQL does, or, if ``counted``, as numbers of cases (:func:`counts`): the law is
    the same, the draws are others, and the work doesn't grow with the cases of a multiset of activities.  A vector of a
    pattern holds, for one outer replicate, [applicable and satisfied positives, by inner labels and as labelled; applicable cases by class; satisfied
    cases by class, as ordered and by inner orders].  Only vectors are shuffled.  The outer replicate is part of every draw, so
    replicates are independent.
    """
    cands = replicates.stored(cands)
    tests = range(1, b.inner_order, 2)  # even ones screen, which calibration has no use for
    labels_to, app_to, orders = b.inner_label + 1, 2 * (b.inner_label + 1), len(tests) + 1
    width = app_to + 2 + 2 * orders
    n, n1 = traces.agg(F.count(F.lit(1)), F.sum("outcome")).first()
    ensure(traces.sparkSession)
    parts = (counts if counted and n < counted_draws.MOST else hashed)(traces, cands, b, n, n1 or 0, tests, width)

    def statistics(batches):
        share = lambda x, n: np.divide(x, n, out=np.zeros(len(x)), where=n > 0)
        for pdf in batches:
            out = []
            for o, ctype, x, y, *vectors in zip(*[pdf[c] for c in ("outer", *KEYS, "both", "x", "y", "every")], strict=True):
                v = replicates.total(vectors, width)
                app, sat = v[app_to : app_to + 2], v[app_to + 2 :].reshape(2, orders)
                if not app.sum():
                    continue
                app1, sat1 = v[:labels_to], v[labels_to:app_to]
                d = np.round(share(sat1, app1) - share(sat[:, 0].sum() - sat1, app.sum() - app1), 12)
                p_label = (1 + int((np.abs(d[:-1]) >= abs(d[-1])).sum())) / labels_to
                prev = np.round(share(sat[:, 0], app), 12)
                k = int(prev[1] >= prev[0])
                p_order = replicates.tail_p(sat[k, 1:], sat[k, 0], ctype in negative) if app[k] else 1.0
                out.append((o, ctype, x, y, p_label, p_order, -2 * (w_order * np.log(p_order) + w_label * np.log(p_label))))
            yield pd.DataFrame(out, columns=["outer", *KEYS, "p_label", "p_order", "t"])

    return replicates.by_candidate(replicates.added(parts), cands, b.outer).mapInPandas(
        statistics, "outer int, ctype string, a string, b string, p_label double, p_order double, t double")


def hashed(traces: DataFrame, cands: DataFrame, b: Budget, n: int, n1: int, tests: range, width: int) -> DataFrame:
    """Vectors of tasks, of draws by the hash of each case.

    A case is handed to as many tasks as there are blocks of outer replicates.  For each of them the task draws the case's
    null label and null trace, the inner labels of that log and the inner orders of that trace.  Cases of one multiset of
    activities come one after another: their labels are added up by distinct null trace, and their inner orders are
    counted by distinct trace, and a product with the verdicts on these traces gives the vectors of the patterns (where a
    multiset has too many distinct traces, each case is evaluated).
    """
    names, unary = replicates.templates(cands)
    labels_to, orders = b.inner_label + 1, len(tests) + 1
    texts = [f"{b.seed + 100}|{o}|" for o in range(b.outer)] + [f"{b.seed + 200}|{o}|{r}|" for o in range(b.outer) for r in range(b.inner_label)]
    labels = replicates.Labels(texts, replicates.label_cuts(traces, texts, n, n1))
    size = max(1, min(b.outer, replicates.HELD_BYTES // (8 * width * max(1, cands.count()))))
    blocks = -(-b.outer // size)

    heads = lambda seed, o, *r: Heads([f"{seed}|{'|'.join(map(str, x))}|".encode() for x in itertools.product(o, *r)])

    def draws(ids: list[str], own: np.ndarray, low: int, high: int, null_heads, inner_heads):
        """Cases of one multiset of activities, with their traces' codes (rows), in the outer replicates from ``low`` up to ``high``: labels
        (cases, replicates, inner and as labelled) and codes (cases, replicates, as ordered and inner, places)."""
        many, (m, n) = high - low, own.shape
        drawn = labels.many(ids, b.outer + low * b.inner_label, b.outer + high * b.inner_label).reshape(m, many, -1)
        drawn = np.concatenate([drawn, labels.many(ids, low, high)[:, :, None]], 2)
        if (own == own[0, 0]).all():
            return drawn, np.broadcast_to(own[:, None, None], (m, many, orders, n))
        null = np.take_along_axis(own[:, None], replicates.drawn_orders(null_heads, ids, n), 2)[:, :, None]
        inner = replicates.drawn_orders(inner_heads, ids, n).reshape(m, many, len(tests), -1)
        return drawn, np.concatenate([null, np.take_along_axis(null, inner, 3)], 2)

    def run(batches):
        held, group, now, made = replicates.Vectors((size, width)), None, None, {}

        def heads_of(low, high):
            if (low, high) not in made:
                if len(made) > b.outer:
                    made.clear()
                made[low, high] = heads(b.seed + 101, range(low, high)), heads(b.seed + 300, range(low, high), tests)
            return made[low, high]

        def begun(acts: list[str], block: int) -> Group:
            return Group(held, acts, names, unary, min(b.outer, (block + 1) * size) - block * size, labels_to, orders)

        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("block", "acts", "case_id", "trace")], strict=True)
            for (k, acts), some in itertools.groupby(rows, key=lambda r: r[:2]):
                if (k, acts) != now:
                    if group:
                        group.close()
                        if k != now[0] or held.full():
                            yield from held.rows(range(now[0] * size, (now[0] + 1) * size))
                    group, now = begun(acts, k), (k, acts)
                _, _, ids, traces = zip(*some, strict=True)
                for i in range(0, len(ids), TOGETHER):
                    if held.full():
                        group.close()
                        yield from held.rows(range(k * size, (k + 1) * size))
                        group = begun(acts, k)
                    own, many = np.searchsorted(group.t.acts, traces[i : i + TOGETHER]), group.together(b.inner_label, orders)
                    for low in range(0, group.many, group.step):
                        high = min(low + group.step, group.many)
                        first = k * size + low, k * size + high
                        for j in range(0, len(own), many):
                            group.add(low, high, *draws(ids[i + j : min(i + j + many, i + TOGETHER)], own[j : j + many], *first, *heads_of(*first)))
        if group:
            group.close()
            yield from held.rows(range(now[0] * size, (now[0] + 1) * size))

    # cases of one multiset of activities come one after another
    rows = traces.select("case_id", "trace", F.array_sort("trace").alias("acts"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return replicates.dealt(rows, n * blocks, "block", "case_id").sortWithinPartitions("block", "acts").mapInArrow(run, replicates.PARTIAL).where(F.col("outer") < b.outer)


def counts(traces: DataFrame, cands: DataFrame, b: Budget, n: int, n1: int, tests: range, width: int) -> DataFrame:
    """Vectors of tasks, of draws as numbers of cases (:mod:`..operators.counted`).

    A task has some multisets of activities, with their numbers of cases, in a block of outer replicates.  Of each it draws how many cases are positive, and
    how many of either class each of its orders gets; a product with the verdicts on these orders gives the vectors.  Multisets of too many
    orders for their cases are drawn case by case, in slices.
    """
    names, unary = replicates.templates(cands)
    labels_to, orders, size = b.inner_label + 1, len(tests) + 1, counted_draws.BLOCK
    groups = rules.stored(counted_draws.leaves(traces), "leaves")
    count = max(1, -(-groups.count() // counted_draws.LEAVES))
    groups = counted_draws.parted(groups, count)
    sizes = dict(groups.groupBy("part").agg(F.sum("cases")).collect())  # a number for each part
    shares, blocks = counted_draws.Shares([sizes.get(i, 0) for i in range(count)]), -(-b.outer // size)

    def run(batches):
        held = replicates.Vectors((size, width))
        rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in ("block", "part", "acts", "slice", "cases")], strict=True))
        for (block, part), some in itertools.groupby(rows, key=lambda r: r[:2]):
            some, many = list(some), min(b.outer, (block + 1) * size) - block * size
            positive = shares.of(part, np.full((many, labels_to), n1, np.int64), b.seed + 100, "parts", block)
            split = counted_draws.split(counted_draws.generator(b.seed + 100, "part", block, part), [r[4] for r in some], positive)
            for (_, _, acts, slice_, cases), own in zip(some, split, strict=True):
                g = counted_draws.generator(b.seed + 101, "group", block, slice_, *acts)
                group = Group(held, acts, names, unary, many, labels_to, orders, counted_draws.as_counts(counted_draws.orders_of(acts), cases))
                if group.counted:
                    group.labels, group.orders = (x.astype(float) for x in counted_draws.group_counts(g, cases, own, len(group.found[0]), orders))
                else:
                    step = group.together(b.inner_label, orders)
                    for low in range(0, many, group.step):
                        high = min(low + group.step, many)
                        left = own[low:high].copy()
                        for i in range(0, cases, step):
                            group.add(low, high, *counted_draws.case_draws(g, min(step, cases - i), cases - i, left, group.t.codes, orders))
                group.close()
                if held.full():
                    yield from held.rows(range(block * size, (block + 1) * size))
            yield from held.rows(range(block * size, (block + 1) * size))

    rows = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = min(blocks * count, max(4 * traces.sparkSession.sparkContext.defaultParallelism, -(-blocks * count // 16)))
    return rows.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "acts", "slice").mapInArrow(run, replicates.PARTIAL).where(F.col("outer") < b.outer)


def calibrated(tested: DataFrame, null: DataFrame, outer: int) -> DataFrame:
    """Adds p_emp: the share of null statistics of the same pattern that reach the observed one."""
    met = _joined(tested.select(*KEYS, "t"), null.select(*KEYS, F.col("t").alias("t_null")), how="left")
    reach = met.groupBy(*KEYS).agg(F.count_if(F.round("t_null", 9) >= F.round("t", 9)).alias("reach"))
    return _joined(tested, reach).withColumn("p_emp", (1 + F.col("reach")) / F.lit(outer + 1.0)).drop("reach")


def run(traces: DataFrame, cands: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Every pattern with its p-values, q-value, verdict and category; patterns out of scope have no q."""
    b = budget
    w_order, w_label = significance.weights(b.label, b.order)
    cands = replicates.stored(cands)
    tested = dominant(axes(traces, cands, b.label, b.order, b.seed), w_order, w_label).cache()
    rho = significance.log_p_correlation(tested, "p_struct", "p_disc").first()["rho"]
    c, f = significance.moment_match(rho, w_order, w_label)
    tested = significance.analytic_p(tested, "t", c, f)
    full = calibrated(tested, null_statistics(traces, cands, b, w_order, w_label, counted=True), b.outer).cache()
    scope = F.least("p_screen0", "p_screen1") <= b.alpha
    inside = full.where(scope)
    pi0 = significance.pi0_adaptive(inside, "p_emp", b.alpha).first()["pi0"]
    q = significance.q_values(inside, "p_emp", KEYS, pi0).select(*KEYS, "q")
    out = _joined(full, q, how="left")
    out = out.withColumn("significant", F.coalesce(F.col("q") <= b.alpha, F.lit(False)))
    return out.withColumn("category", significance.taxonomy()).withColumn("pi0", F.lit(float(pi0)))
