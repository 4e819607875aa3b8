"""Many changed logs at once: every case goes through all changes where it is, and only counts leave its task.

A change is an object whose ``many(case ids, outcomes, traces)`` yields (first cell, distinct changed traces, each
case's number among them in that cell and those after it, its outcome there), as arrays; each part has some of the cases.  Draws
are those of :mod:`resampling`, so a cell's log is the one that its column expressions give; where a change has ranked label
draws, it keeps them with the log (``log``) and is given them (``drawn``).  A task counts its distinct
changed traces by cell and class; a matrix product with their patterns gives all cells' sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ensure
from . import replicates
from .replicates import md5

KEYS = replicates.KEYS
COUNTS = ["n_app0", "n_sat0", "n_app1", "n_sat1"]


def _uniform(heads: list[str], case_ids: list[str]) -> np.ndarray:
    """(cases, heads): the first 32 bits of md5(head + case), in [0, 1)."""
    return (replicates.Heads([h.encode() for h in heads]).first64([c.encode() for c in case_ids]) >> np.uint64(32)) / 4294967296.0


def _places(seed: int, case_id: str, n: int) -> list[int]:
    """0 to n - 1 in drawn order."""
    return sorted(range(n), key=lambda i: (md5(f"{seed}|{case_id}|{i}".encode()).digest(), i))


def _two_places(heads: list[str], n: int) -> np.ndarray:
    """(heads, 2): the first two of the places 0 to n - 1 in the order of md5(head + place)."""
    h = replicates.Heads([b""]).first64([f"{x}{i}".encode() for x in heads for i in range(n)]).reshape(-1, n)
    first = np.argsort(h, axis=1, kind="stable")
    ordered = np.take_along_axis(h, first, 1)
    for k in np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(1)).tolist():
        first[k] = sorted(range(n), key=lambda i: (md5(f"{heads[k]}{i}".encode()).digest(), i))
    return first[:, :2]


def with_order_noise(case_id: str, trace: tuple[str, ...], rho: float, seed: int) -> tuple[str, ...]:
    k = round(rho * (len(trace) - 1))
    if len(trace) < 2 or k < 1:
        return trace
    out = list(trace)
    for i in sorted(_places(seed, case_id, len(trace) - 1)[:k]):
        out[i], out[i + 1] = out[i + 1], out[i]
    return tuple(out)


class Book(dict):
    """Numbers of traces, in order of appearance."""

    def number(self, trace: tuple[str, ...]) -> int:
        return self.setdefault(trace, len(self))


class Change:
    log: DataFrame | None = None
    labels: replicates.Labels

    def ranked(self, traces: DataFrame, heads: list[str], n: int, wanted: list[int]) -> None:
        """Draws labels: of each head the ``wanted`` cases that come first."""
        found = replicates.label_draws(traces, heads, n, wanted)
        if found:
            self.log, cuts = found
        else:
            by_head: dict[str, tuple[bytes, str]] = {}
            for k in set(wanted):
                own = [h for h, w in zip(heads, wanted, strict=True) if w == k]
                by_head |= dict(zip(own, replicates.label_cuts(traces, own, n, k), strict=True))
            cuts = [by_head[h] for h in heads]
        self.labels = replicates.Labels(heads, cuts)

    def __getstate__(self) -> dict:
        """Tasks get a change without its table."""
        return {k: v for k, v in self.__dict__.items() if k != "log"}

    def of(self, case_id: str, outcome: int, trace: list[str]) -> Iterator[tuple]:
        """(cell, outcome, trace) of one case."""
        for first, distinct, at, y in self.many([case_id], np.array([outcome], np.int64), [tuple(trace)]):
            for cell, (i, label) in enumerate(zip(at[0].tolist(), y[0].tolist(), strict=True), first):
                yield cell, label, list(distinct[i])


class NoiseGrid(Change):
    """Label noise eps (columns) after order noise rho (rows); cell = row * columns + column."""

    def __init__(self, eps, rho, seed: int):
        self.eps, self.rho, self.seed, self.cells = tuple(eps), tuple(rho), seed, len(eps) * len(rho)

    def many(self, ids: list[str], outcomes: np.ndarray, traces: list[tuple], drawn: np.ndarray | None = None) -> Iterator[tuple]:
        flipped = outcomes[:, None] ^ (_uniform([f"{self.seed + j}|" for j in range(len(self.eps))], ids) < np.array(self.eps))
        book = Book()
        at = np.array([[book.number(with_order_noise(c, t, rho, self.seed + 1000 * i)) for i, rho in enumerate(self.rho)] for c, t in zip(ids, traces, strict=True)])
        yield 0, list(book), np.repeat(at, len(self.eps), 1), np.tile(flipped, len(self.rho))


class Perturbations(Change):
    """Cells (family, eps, seed): swapped events, exactly flipped labels, or truncated traces."""

    def __init__(self, traces: DataFrame, cells: list[tuple[str, float, int]]):
        self.what, self.cells = cells, len(cells)
        n = traces.count()
        self.heads = [f"{seed}|" for _, _, seed in cells]
        self.exact = [i for i, (f, _, _) in enumerate(cells) if f != "order"]
        if self.exact:
            self.ranked(traces, [self.heads[i] for i in self.exact], n, [max(1, round(n * cells[i][1])) for i in self.exact])

    def many(self, ids: list[str], outcomes: np.ndarray, traces: list[tuple], drawn: np.ndarray | None = None) -> Iterator[tuple]:
        book = Book()
        own = np.array([book.number(t) for t in traces])
        originals = list(book)
        at, y = np.repeat(own[:, None], self.cells, 1), np.repeat(outcomes[:, None], self.cells, 1)
        if self.exact and drawn is None:
            drawn = self.labels.many(ids, 0, len(self.exact))
        for k, i in enumerate(self.exact):
            family, eps, _ = self.what[i]
            rows = drawn[:, k].astype(bool)
            if family == "labels":
                y[rows, i] ^= 1
                continue
            some, back = np.unique(own[rows], return_inverse=True)
            keep = [max(1, math.ceil(round((1.0 - eps) * len(originals[t]), 9))) for t in some.tolist()]
            at[rows, i] = np.array([book.number(originals[t][:m]) for t, m in zip(some.tolist(), keep, strict=True)], np.int64)[back]
        order = [i for i, (family, _, _) in enumerate(self.what) if family == "order"]
        if order:
            swapped = _uniform([self.heads[i] for i in order], ids) < np.array([self.what[i][1] for i in order])
            size = np.array([len(t) for t in traces])
            swapped[size < 2] = False
            case, cell = np.nonzero(swapped)
            heads = [f"{self.what[i][2] + 1}|" for i in order]
            for length in np.unique(size[case]).tolist():
                step = max(1, replicates.EVENTS // (8 * length))
                of_length = np.flatnonzero(size[case] == length)
                for some in (of_length[k : k + step] for k in range(0, len(of_length), step)):
                    j, i = case[some], cell[some]
                    ends = _two_places([f"{heads[b]}{ids[a]}|" for a, b in zip(j.tolist(), i.tolist(), strict=True)], length)
                    kinds, back = np.unique((own[j] * length + ends.min(1)) * length + ends.max(1), return_inverse=True)
                    changed = []
                    for kind in kinds.tolist():
                        (t, p), q = divmod(kind // length, length), kind % length
                        trace = list(originals[t])
                        trace[p], trace[q] = trace[q], trace[p]
                        changed.append(book.number(tuple(trace)))
                    at[j, np.array(order)[i]] = np.array(changed, np.int64)[back]
        yield 0, list(book), at, y


class DoubleNull(Change):
    """``count`` logs with permuted labels and permuted traces."""

    def __init__(self, traces: DataFrame, count: int, seed: int):
        self.cells, self.seed = count, seed
        n, n1 = traces.agg(F.count(F.lit(1)), F.sum("outcome")).first()
        self.orders = []
        self.ranked(traces, [f"{seed}|{r}|" for r in range(count)], n, [n1 or 0] * count)

    def many(self, ids: list[str], outcomes: np.ndarray, traces: list[tuple], drawn: np.ndarray | None = None) -> Iterator[tuple]:
        if not self.orders:
            self.orders.append(replicates.Heads([f"{self.seed + 1}|{r}|".encode() for r in range(self.cells)]))

        def labels(some: list[int]) -> np.ndarray:
            return self.labels.many([ids[i] for i in some], 0, self.cells) if drawn is None else drawn[some]

        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(traces):
            by_length.setdefault(len(t) if len(set(t)) > 1 else 1, []).append(i)
        for length, places in by_length.items():
            step = max(1, replicates.EVENTS // (2 * length * self.cells))
            for some in (places[i : i + step] for i in range(0, len(places), step)):
                if length == 1:  # one activity: every order is the same
                    book = Book()
                    at = np.array([book.number(traces[i]) for i in some])
                    yield 0, list(book), np.repeat(at[:, None], self.cells, 1), labels(some)
                    continue
                acts = sorted({a for i in some for a in traces[i]})
                place = {a: k for k, a in enumerate(acts)}
                own = np.array([[place[a] for a in traces[i]] for i in some], np.int64)
                codes = replicates.drawn_codes(self.orders[0], [ids[i] for i in some], own).reshape(length, -1)
                rows, at = replicates.numbered(codes, len(acts))
                yield 0, [tuple(acts[e] for e in r) for r in rows.tolist()], at.reshape(len(some), -1), labels(some)


class Unchanged(Change):
    cells = 1

    def many(self, ids: list[str], outcomes: np.ndarray, traces: list[tuple], drawn: np.ndarray | None = None) -> Iterator[tuple]:
        book = Book()
        at = np.array([book.number(t) for t in traces])
        yield 0, list(book), at[:, None], outcomes[:, None]


class Together(Change):
    """The cells of several changes, one after another."""

    def __init__(self, *changes):
        self.changes, self.cells = changes, sum(c.cells for c in changes)
        self.first = next((c for c in changes if c.log is not None), None)  # others draw again
        if self.first is not None:
            self.log, self.labels = self.first.log, self.first.labels

    def many(self, ids: list[str], outcomes: np.ndarray, traces: list[tuple], drawn: np.ndarray | None = None) -> Iterator[tuple]:
        first = 0
        for c in self.changes:
            yield from ((first + own, *part) for own, *part in c.many(ids, outcomes, traces, drawn if c is self.first else None))
            first += c.cells


def confidences(traces: DataFrame, cands: DataFrame, change) -> DataFrame:
    """(cell, pattern, conf0, conf1, n_app0, n_sat0, n_app1, n_sat1) of every candidate in every cell."""
    cands = replicates.stored(cands)
    names, unary = replicates.templates(cands)
    cells, log = change.cells, change.log
    columns = ["case_id", "outcome", "trace"] + ([] if log is None else ["under", "near"])

    def run(batches):
        held = replicates.Products(2 * cells, names, unary)
        step = max(1, replicates.EVENTS // (4 * cells))
        for batch in batches:
            ids, outcomes, traces, *draws = (batch.column(c).to_pylist() for c in columns)
            for i in range(0, len(ids), step):
                drawn = change.labels.drawn(ids[i : i + step], *[d[i : i + step] for d in draws]) if draws else None
                for first, distinct, at, y in change.many(ids[i : i + step], np.array(outcomes[i : i + step], np.int64), [tuple(t) for t in traces[i : i + step]], drawn):
                    column = 2 * (first + np.arange(at.shape[1])) + y
                    yield from held.add(distinct, at.reshape(-1), column.reshape(-1))
        yield from held.rows()

    def split(batches):
        for pdf in batches:
            sums = [replicates.total(v, 4 * cells) for v in zip(*[pdf[c] for c in ("both", "x", "y", "every")], strict=True)]
            app, sat = np.stack(sums).reshape(len(pdf), 2, cells, 2).transpose(1, 0, 2, 3).reshape(2, -1, 2) if len(pdf) else np.zeros((2, 0, 2), np.int64)
            conf = np.divide(sat, app, out=np.zeros(sat.shape), where=app > 0)
            out = pd.DataFrame({"cell": np.tile(np.arange(cells, dtype=np.int32), len(pdf))})
            for c in KEYS:
                out[c] = np.repeat(pdf[c].to_numpy(object), cells)
            for k in (0, 1):
                out[f"conf{k}"], out[f"n_app{k}"], out[f"n_sat{k}"] = conf[:, k], app[:, k], sat[:, k]
            yield out

    ensure(traces.sparkSession)
    parts = replicates.dealt((traces if log is None else log).select(*columns), traces.count(), "case_id", most=replicates.MANY_CASES).mapInArrow(run, replicates.PARTIAL)
    whole = replicates.by_candidate(replicates.added(parts), cands, 1)
    return whole.mapInPandas(split, "cell int, ctype string, a string, b string, conf0 double, n_app0 long, n_sat0 long, conf1 double, n_app1 long, n_sat1 long")
