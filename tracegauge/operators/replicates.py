"""Statistics of very many permuted logs, computed inside tasks: no permuted trace or label leaves one.

A trace keeps its activities when its order is drawn anew, so a replicate is a row of small integers.  A task draws the
orders of its own cases (by md5, as everywhere), evaluates all templates of all of a case's replicates at once from
arrays of first and last places, neighbours and gaps, and adds up vectors: one for each pattern, with a place for each
replicate.  What is shuffled are those vectors.

Sums are kept by key (ctype, a, b): traces with both activities; (ctype, a, null) and (ctype, null, b): all traces with
one of them, as if the other were absent; (*, null, null): all traces.  The first key's vector is what traces with both
add to the others, so a candidate's vector is the sum of its keys', and pairs that never meet cost nothing.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import templates as tp
from ..shared import shared_folder
from ..shipping import ensure
from .hashes import LANES, Heads, md5

KEYS = ["ctype", "a", "b"]
#: Templates with a verdict for traces that have only the first, or only the second, activity.
X_LED, Y_LED = ("Response", "AlternateResponse", "ChainResponse"), ("Precedence", "AlternatePrecedence", "ChainPrecedence", "NotPrecedence")
#: Bytes of a task's vectors, or distinct traces whose cases are counted; events of replicates that are evaluated at a time; cases of a task.
HELD_BYTES, HELD_TRACES, EVENTS, CASES = 64 << 20, 20_000, 2_000_000, 5_000
#: Cases of a task that counts distinct traces: what it adds up hardly grows with its cases.
MANY_CASES = 20_000
#: Traces of no more distinct orders, found by a table of no more entries, are counted by order before their templates are evaluated.
DISTINCT, TABLE = 200, 1 << 20


# ---- one trace under many orders -----------------------------------------------------------------------


def drawn_orders(heads: Heads, cases: list[str], length: int) -> np.ndarray:
    """(cases, heads, length): the places of a case's trace in the order of md5(head, case, place)."""
    h = heads.first64([f"{c}|{i}".encode() for c in cases for i in range(length)]).reshape(len(cases), length, -1).transpose(0, 2, 1)
    if length == 2:
        first = (h[:, :, 1] < h[:, :, 0]).astype(np.int64)
        return np.stack([first, 1 - first], 2)
    return np.argsort(h, axis=2, kind="stable")


@functools.cache
def exchanges(n: int) -> list[tuple[int, int]]:
    """Pairs of places that, put in order one after another, sort ``n`` values (odd-even merges)."""
    out, p = [], 1
    while p < n:
        k = p
        while k:
            for j in range(k % p, n - k, 2 * k):
                out += [(i + j, i + j + k) for i in range(min(k, n - j - k)) if (i + j) // (2 * p) == (i + j + k) // (2 * p)]
            k //= 2
        p *= 2
    return out


def drawn_codes(heads: Heads, cases: list[str], own: np.ndarray) -> np.ndarray:
    """(places, cases, heads): the codes of cases (rows of ``own``) in the order of md5(head, case, place).

    Codes stand in the last bits of the draws, which are exchanged as arrays; should two draws be equal but for these bits,
    the orders are taken from the draws alone.
    """
    n, length = own.shape
    if length == 1:
        return np.broadcast_to(own.T[:, :, None], (1, n, len(heads.heads)))
    h = heads.first64([f"{c}|{i}".encode() for c in cases for i in range(length)]).reshape(n, length, -1).transpose(1, 0, 2)
    bits = max(1, int(own.max()).bit_length())
    if bits <= 8 and length <= 64:
        low = np.uint64((1 << bits) - 1)
        s = [(h[i] & ~low) | own[:, i, None].astype(np.uint64) for i in range(length)]
        for i, j in exchanges(length):
            s[i], s[j] = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
        if not any(((x ^ y) <= low).any() for x, y in zip(s, s[1:], strict=False)):
            return np.stack([(x & low).astype(np.uint8) for x in s])
    return np.take_along_axis(own.T[:, :, None], np.argsort(h, axis=0, kind="stable"), 0)


def numbered(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct traces, a row each; each trace's number among them) of the codes, below ``k``, of traces (columns)."""
    length = len(codes)
    if length * max(1, (k - 1).bit_length()) > 62:
        rows, at = np.unique(codes.T, axis=0, return_inverse=True)
        return rows, at.reshape(-1)
    key = np.zeros(codes.shape[1], np.int64)
    for c in codes:
        key *= k
        key += c
    if k**length <= TABLE:
        seen = np.zeros(k**length, bool)
        seen[key] = True
        found, at = np.flatnonzero(seen), (np.cumsum(seen) - 1)[key]
    else:
        found, at = np.unique(key, return_inverse=True)
    return found[:, None] // k ** np.arange(length - 1, -1, -1, dtype=np.int64) % k, at


def distinct_orders(codes: np.ndarray, most: int) -> np.ndarray | None:
    """The different orders of a trace's codes, a row each; None where there are over ``most``."""
    rows = [((), tuple(np.bincount(codes).tolist()))]
    for _ in range(len(codes)):
        rows = [((*done, e), (*left[:e], left[e] - 1, *left[e + 1 :])) for done, left in rows for e in range(len(left)) if left[e]]
        if len(rows) > most:
            return None
    return np.array([done for done, _ in rows], np.int64)


class Places:
    """Finds orders of a trace among its distinct ones."""

    def __init__(self, orders: np.ndarray, k: int):
        self.powers = k ** np.arange(orders.shape[1], dtype=np.int64)
        self.table = np.zeros(k ** orders.shape[1], np.int32)
        self.table[orders @ self.powers] = np.arange(len(orders))

    def of(self, orders: np.ndarray) -> np.ndarray:
        return self.table[orders @ self.powers]


def places(codes: np.ndarray, k: int) -> tuple[np.ndarray, Places] | None:
    """The distinct orders of a trace and their finder, where both are small."""
    orders = distinct_orders(codes, DISTINCT) if k ** len(codes) <= TABLE else None
    return None if orders is None else (orders, Places(orders, k))


def masks(codes, k: int) -> np.ndarray:
    """(k, traces): the places of each activity as bits; ``codes``: for each place (up to 62), those of all traces."""
    out = np.zeros((k, len(codes[0])), np.uint32 if len(codes) <= 30 else np.uint64)
    for p, c in enumerate(codes):
        for a in range(k):
            out[a] |= (c == a).astype(out.dtype) << out.dtype.type(p)
    return out


def mask_verdicts(m: np.ndarray, length: int, names: list[str]) -> np.ndarray:
    """(names, k, k, traces): whether a template holds of activities x and y, which all traces have."""
    one, whole = m.dtype.type(1), m.dtype.type((1 << length) - 1)
    x, y = m[:, None], m[None]
    low = m & (~m + one)  # the first place
    after = (m << one)[:, None]
    adjacent = after & y
    none, held = adjacent == 0, {}

    def alternates():
        # from each x, across places of neither, to the next place of either; it must not be x
        union = x | y
        gap = ~union & whole
        start = np.broadcast_to(after, union.shape) & whole
        return (((gap + (start & gap)) & union) | (start & union)) & x == 0

    def get(t: str):
        if t not in held:
            held[t] = tests[t]()
        return held[t]

    tests = {
        "Response": lambda: y > x, "AlternateResponse": alternates, "ChainResponse": lambda: adjacent == after,
        "Precedence": lambda: low[:, None] < low[None], "AlternatePrecedence": lambda: get("AlternateResponse").transpose(1, 0, 2), "ChainPrecedence": lambda: adjacent == y,
        "NotResponse": lambda: y < low[:, None], "NotChainResponse": lambda: none, "NotPrecedence": lambda: low[:, None] > y, "NotChainPrecedence": lambda: none,
        "Succession": lambda: get("Response") & get("Precedence"), "AlternateSuccession": lambda: get("AlternateResponse") & get("AlternatePrecedence"),
        "ChainSuccession": lambda: get("ChainResponse") & get("ChainPrecedence"), "NotSuccession": lambda: get("NotResponse"), "NotChainSuccession": lambda: none,
    }
    return np.stack([get(t) for t in names]) if names else np.zeros((0, len(m), *m.shape), bool)


def pair_verdicts(codes: np.ndarray, k: int, names: list[str]) -> np.ndarray:
    """(names, traces, k, k): whether a template holds of activities x and y, which all traces (rows) have."""
    n, length = codes.shape
    rows = np.arange(n)
    first, last = np.zeros((n, k), np.int32), np.zeros((n, k), np.int32)
    count = np.zeros((n, k), np.int32)
    adjacent, gaps = np.zeros((n, k, k), np.int32), np.zeros((n, k, k), np.int32)
    between, met = np.zeros((n, k, k), bool), np.zeros((n, k), bool)
    for p in range(length):
        e = codes[:, p]
        first[rows, e] = np.where(met[rows, e], first[rows, e], p)
        last[rows, e] = p
        count[rows, e] += 1
        gaps[rows, e] += between[rows, e]  # y seen since the last e
        between[rows, e] = False
        met[rows, e] = True
        between[rows, :, e] |= met
        if p + 1 < length:
            adjacent[rows, e, codes[:, p + 1]] += 1
    x, y = (lambda v: v[:, :, None]), (lambda v: v[:, None, :])
    every_x, every_y = gaps == x(count) - 1, gaps.transpose(0, 2, 1) == y(count) - 1
    tests = {
        "Response": lambda: y(last) > x(last), "AlternateResponse": lambda: every_x, "ChainResponse": lambda: adjacent == x(count),
        "Precedence": lambda: x(first) < y(first), "AlternatePrecedence": lambda: every_y, "ChainPrecedence": lambda: adjacent == y(count),
        "NotResponse": lambda: y(last) < x(first), "NotChainResponse": lambda: adjacent == 0, "NotPrecedence": lambda: x(first) > y(last), "NotChainPrecedence": lambda: adjacent == 0,
        "Succession": lambda: (y(last) > x(last)) & (x(first) < y(first)), "AlternateSuccession": lambda: every_x & every_y,
        "ChainSuccession": lambda: (adjacent == x(count)) & (adjacent == y(count)), "NotSuccession": lambda: y(last) < x(first), "NotChainSuccession": lambda: adjacent == 0,
    }
    return np.stack([tests[t]() for t in names]) if names else np.zeros((0, n, k, k), bool)


class Trace:
    """The patterns of one trace: keys, how they apply, and their verdicts under given orders."""

    def __init__(self, trace: list[str], names: list[str], unary: list[str]):
        self.acts = sorted(set(trace))
        place = {a: i for i, a in enumerate(self.acts)}
        self.codes = np.array([place[a] for a in trace], np.int64)
        self.k, self.names, self.unary = len(self.acts), names, unary
        count = np.bincount(self.codes, minlength=self.k)
        keys, app, fixed = [("*", None, None)], [1], [0]
        alone: dict[tuple, int] = {}
        for led, key in ((X_LED, lambda t, a: (t, a, None)), (Y_LED, lambda t, a: (t, None, a))):
            for t in (t for t in names if t in led):
                for a, c in zip(self.acts, count.tolist(), strict=True):
                    alone[key(t, a)] = int(t == "NotPrecedence" or (t.startswith("Alternate") and c <= 1))
        keys += alone
        app += [1] * len(alone)
        fixed += alone.values()
        self.steady = len(keys)
        pairs = [(t, x, y) for t in names for x in self.acts for y in self.acts if x != y]
        sides = [[s for s in ((t, x, None), (t, None, y)) if s in alone] for t, x, y in pairs]
        keys += pairs
        app += [1 - len(s) for s in sides]
        fixed += [-sum(alone[k] for k in s) for s in sides]
        ends = [(t, a, None) for t in unary for a in self.acts]
        self.keys, self.app, self.fixed = keys + ends, np.array(app + [0] * len(ends), np.int64), np.array(fixed + [0] * len(ends), np.int64)
        off = ~np.eye(self.k, dtype=bool)
        self.pick = np.flatnonzero(off.reshape(-1))

    def verdicts(self, orders: np.ndarray) -> np.ndarray:
        """(keys, orders): what each key adds to the satisfied cases; ``orders``: codes, one order in a row."""
        out = np.repeat(self.fixed[:, None], len(orders), 1)
        at = self.steady
        if self.k > 1 and self.names:
            if orders.shape[1] <= 62:
                held = mask_verdicts(masks(orders.T, self.k), orders.shape[1], self.names).reshape(len(self.names), -1, len(orders))[:, self.pick]
            else:
                held = pair_verdicts(orders, self.k, self.names).reshape(len(self.names), len(orders), -1)[:, :, self.pick].transpose(0, 2, 1)
            held = held.reshape(-1, len(orders))
            out[at : at + len(held)] += held
            at += len(held)
        for t in self.unary:
            end = orders[:, 0 if t == "Init" else -1]
            for a in range(self.k):
                out[at] = end == a
                at += 1
        return out


# ---- sums ----------------------------------------------------------------------------------------------


class Vectors:
    """A task's vectors by pattern key."""

    def __init__(self, shape: tuple[int, ...]):
        self.shape, self.index = shape, {}
        self.values = np.zeros((0, *shape), np.int64)

    def at(self, keys: list[tuple]) -> np.ndarray:
        places = np.array([self.index.setdefault(k, len(self.index)) for k in keys])
        if len(self.index) > len(self.values):
            more = max(len(self.index) - len(self.values), len(self.values) // 2 + 16)
            self.values = np.concatenate([self.values, np.zeros((more, *self.shape), np.int64)])
        return places

    def full(self) -> bool:
        return len(self.index) * 8 * int(np.prod(self.shape)) > 2 * HELD_BYTES

    def rows(self, outer: list[int]):
        """A row for each key and entry of the first axis, numbered by ``outer``; forgets them."""
        keys = list(self.index)
        for i in range(0, len(keys), 64):
            some = keys[i : i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.array(outer, np.int32), len(some)))]
                + [pa.array([k[j] for k in some for _ in outer], pa.string()) for j in range(3)]
                + [pa.array([self.values[i + m, o].tobytes() for m in range(len(some)) for o in range(len(outer))], pa.binary())],
                ["outer", *KEYS, "sums"],
            )
        self.__init__(self.shape)


class Products:
    """Vectors [applicable, satisfied] x ``columns`` as a matrix product: the patterns of distinct traces by how many cases
    of a trace each column counts.  Distinct traces are held up to HELD_TRACES, or as many as fit HELD_BYTES."""

    def __init__(self, columns: int, names: list[str], unary: list[str]):
        self.names, self.unary = names, unary
        self.vectors = Vectors((1, 2 * columns))
        self.most = max(1_000, min(HELD_TRACES, HELD_BYTES // (8 * columns)))
        self.cases = np.zeros((self.most, columns))
        self.index: dict[tuple, int] = {}

    def of(self, trace: list[str]) -> np.ndarray:
        """A trace's counts, to be added to; ``rows`` must have been called when there are ``full`` traces."""
        return self.cases[self.index.setdefault(tuple(trace), len(self.index))]

    def add(self, traces: list[tuple], at: np.ndarray, column: np.ndarray):
        """Counts one case for each entry of ``at`` (numbers of ``traces``) and ``column``; yields what is full."""
        n = self.cases.shape[1]
        for low in range(0, len(traces), 1_000):
            some = traces[low : low + 1_000]
            if len(self.index) + len(some) > self.most:
                yield from self.rows()
            own = slice(None) if len(traces) <= 1_000 else (at >= low) & (at < low + 1_000)
            counts = np.bincount((at[own] - low) * n + column[own], minlength=len(some) * n)
            self.cases[[self.index.setdefault(t, len(self.index)) for t in some]] += counts.reshape(len(some), n)

    def full(self) -> bool:
        return len(self.index) >= self.most

    def rows(self):
        groups: dict[tuple, list[tuple]] = {}
        for t in self.index:
            groups.setdefault(tuple(sorted(t)), []).append(t)
        for acts, some in groups.items():
            t = Trace(list(acts), self.names, self.unary)
            at, held = self.vectors.at(t.keys), self.cases[[self.index[x] for x in some]]
            place = {a: i for i, a in enumerate(t.acts)}
            verdicts = t.verdicts(np.array([[place[a] for a in x] for x in some], np.int64)).astype(float)
            sums = np.concatenate([np.outer(t.app, held.sum(0)), verdicts @ held], 1)
            self.vectors.values[at, 0] += np.rint(sums).astype(np.int64)
            if self.vectors.full():
                yield from self.vectors.rows([0])
        self.cases[: len(self.index)] = 0
        self.index.clear()
        yield from self.vectors.rows([0])


PARTIAL = "outer int, ctype string, a string, b string, sums binary"


def added(parts: DataFrame) -> DataFrame:
    """Vectors added by (outer, key): a group has one row for each task, or for each time that it was full."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s, np.int64) for s in pdf["sums"]], 0)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in ("outer", *KEYS)}, "sums": [total.tobytes()]})

    return parts.groupBy("outer", *KEYS).applyInPandas(add, PARTIAL)


def by_candidate(sums: DataFrame, cands: DataFrame, outer: int) -> DataFrame:
    """(outer, ctype, a, b, both, x, y, every): the vectors that make up a candidate's; absent ones are null."""
    rows = cands.select(*KEYS).crossJoin(F.broadcast(cands.sparkSession.range(outer).select(F.col("id").cast("int").alias("outer"))))
    two = F.col("b").isNotNull()
    wanted = {
        "both": (F.col("ctype"), F.col("a"), F.col("b")), "x": (F.when(two, F.col("ctype")), F.col("a"), F.lit(None)),
        "y": (F.when(two, F.col("ctype")), F.lit(None), F.col("b")), "every": (F.when(~two, F.lit("*")), F.lit(None), F.lit(None)),
    }
    # a key as one string that is never null where it is wanted
    text = lambda t, a, b: F.to_json(F.struct(t.alias("t"), a.cast("string").alias("a"), b.cast("string").alias("b")))
    keyed = sums.select("outer", text(F.col("ctype"), F.col("a"), F.col("b")).alias("key"), "sums")
    for name, (t, a, b) in wanted.items():
        own = keyed.select("outer", F.col("key").alias("_key"), F.col("sums").alias(name))
        rows = rows.withColumn("_key", F.when(t.isNotNull(), text(t, a, b))).join(own, ["outer", "_key"], "left").drop("_key")
    return rows


def total(row, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for part in row:
        if part is not None:
            out += np.frombuffer(part, np.int64)
    return out


def dealt(cases: DataFrame, n: int, *by: str, most: int = CASES) -> DataFrame:
    """The ``n`` cases over as many tasks as there are cores twice, and more where they would hold over ``most`` cases."""
    tasks = max(2 * cases.sparkSession.sparkContext.defaultParallelism, -(-n // most))
    return cases.repartition(tasks, *by)


def stored(cands: DataFrame) -> DataFrame:
    """Candidates written once: they come from the log, which would be read again for each of their uses."""
    folder = shared_folder(cands.sparkSession, "candidates")
    cands.select(*KEYS).write.parquet(folder)
    return cands.sparkSession.read.schema("ctype string, a string, b string").parquet(folder)


def templates(cands: DataFrame) -> tuple[list[str], list[str]]:
    found = {r[0] for r in cands.select("ctype").distinct().collect()}  # names of templates
    return [t for t in tp.TRACE_BINARY if t in found], [t for t in tp.UNARY if t in found]


class OrderSums:
    """Verdicts on drawn orders of the cases of one set of activities: how many hold in each replicate, in single bytes."""

    def __init__(self, t: Trace, count: int):
        self.t, self.count, self.cases = t, count, 0
        self.fixed = np.zeros(len(t.fixed), np.int64)
        self.pairs = np.zeros((len(t.names), t.k, t.k, count), np.uint8)
        self.ends = np.zeros((len(t.unary), t.k, count), np.uint8)

    def add(self, t: Trace, codes: np.ndarray, low: int) -> None:
        """A case's codes (places, replicates from ``low``)."""
        some, m = slice(low, low + codes.shape[1]), masks(codes, t.k)
        self.pairs[..., some] += mask_verdicts(m, len(codes), t.names).view(np.uint8)
        for i, name in enumerate(t.unary):
            self.ends[i, :, some] += (codes[0 if name == "Init" else -1] == np.arange(t.k)[:, None]).view(np.uint8)

    def done(self, t: Trace, held: Vectors) -> None:
        """A case has gone through all replicates."""
        self.fixed += t.fixed
        self.cases += 1
        if self.cases == 255:
            self.close(held)

    def close(self, held: Vectors) -> None:
        at, t = held.at(self.t.keys), self.t
        drawn = np.concatenate([self.pairs.reshape(len(t.names), -1, self.count)[:, t.pick].reshape(-1, self.count), self.ends.reshape(-1, self.count)])
        held.values[at, 0, 2:] += self.fixed[:, None]
        held.values[at[t.steady :], 0, 2:] += drawn
        self.cases = 0
        for x in (self.fixed, self.pairs, self.ends):
            x[:] = 0


def order_counts(traces: DataFrame, cands: DataFrame, count: int, seed: int) -> DataFrame:
    """(outer, candidate's vectors): applicable cases, then satisfied ones as observed and in ``count`` drawn orders."""
    cands = stored(cands)
    names, unary = templates(cands)

    def run(batches):
        held, heads, every = Vectors((1, count + 2)), Heads([f"{seed}|{r}|".encode() for r in range(count)]), np.arange(count)
        sets: dict[tuple, OrderSums] = {}

        def add(acts, group):
            """The cases of one multiset of activities, by trace: counts of their distinct orders, where these are few."""
            t, length = Trace(acts, names, unary), len(acts)
            at, found = held.at(t.keys), places(t.codes, t.k)
            seen = np.zeros((len(found[0]) if found else 0, count))
            many, step = max(1, 4 * LANES // (count * length)), max(1, EVENTS // (length * t.k * t.k))
            for trace, ids in group.items():
                own = np.searchsorted(t.acts, trace)
                held.values[at, 0, 0] += t.app * len(ids)
                held.values[at, 0, 1] += t.verdicts(own[None])[:, 0] * len(ids)
                if t.k == 1:
                    held.values[at, 0, 2:] += t.verdicts(own[None]) * len(ids)
                    continue
                if not found and length <= 62:
                    if (sums := sets.get(tuple(t.acts))) is None:
                        sums = sets[tuple(t.acts)] = OrderSums(t, count)
                    for i in range(0, len(ids), many):
                        drawn = drawn_codes(heads, ids[i : i + many], np.repeat(own[None], len(ids[i : i + many]), 0))
                        for codes in drawn.transpose(1, 0, 2):
                            for j in range(0, count, step):
                                sums.add(t, codes[:, j : j + step], j)
                            sums.done(t, held)
                    continue
                for i in range(0, len(ids), many):
                    for orders in drawn_orders(heads, ids[i : i + many], length):
                        if found:
                            seen[found[1].of(own[orders]), every] += 1
                            continue
                        for j in range(0, count, step):
                            held.values[at, 0, 2 + j : 2 + j + step] += t.verdicts(own[orders[j : j + step]])
            if found and t.k > 1:
                held.values[at, 0, 2:] += np.rint(t.verdicts(found[0]).astype(float) @ seen).astype(np.int64)

        for batch in batches:
            groups: dict[tuple, dict[tuple, list[str]]] = {}
            for case_id, trace in zip(batch.column("case_id").to_pylist(), batch.column("trace").to_pylist(), strict=True):
                groups.setdefault(tuple(sorted(trace)), {}).setdefault(tuple(trace), []).append(case_id)
            for acts, group in groups.items():
                add(list(acts), group)
                if held.full() or 8 * sum(x.pairs.size for x in sets.values()) > 4 * HELD_BYTES:
                    for x in sets.values():
                        x.close(held)
                    sets.clear()
                    yield from held.rows([0])
        for x in sets.values():
            x.close(held)
        yield from held.rows([0])

    ensure(traces.sparkSession)
    parts = dealt(traces.select("case_id", "trace"), traces.count(), "case_id").mapInArrow(run, PARTIAL)
    return by_candidate(added(parts), cands, 1)


def tail_p(drawn: np.ndarray, seen: int, negative: bool) -> float:
    """The upper tail with the observed value as one of the draws; for negative templates twice the smaller tail."""
    upper = (1 + int((drawn >= seen).sum())) / (len(drawn) + 1)
    if not negative:
        return upper
    return min(1.0, 2 * min(upper, (1 + int((drawn <= seen).sum())) / (len(drawn) + 1)))


# ---- label draws ---------------------------------------------------------------------------------------

#: Half of the band around a replicate's expected cut, in standard deviations.
BAND = 6.0


def label_cuts(cases: DataFrame, heads: list[str], n: int, n1: int) -> list[tuple[bytes, str]]:
    """For every head, the n1-th smallest (md5(head, case_id), case_id): cases up to it are positive.

    Draws are uniform, so the cut is in a narrow band around n1 / n; a task counts those below it, and only those in the
    band, about sqrt(n) for each head, are ranked.  What comes to the driver is one cut for each head.
    """
    if not 0 < n1 < n:
        return [(b"", "") if n1 <= 0 else (b"\xff" * 17, "")] * len(heads)
    share = n1 / n
    half = BAND * (share * (1 - share) / n) ** 0.5
    coded = [h.encode() for h in heads]
    for low, high in ((max(0.0, share - half), min(1.0, share + half)), (0.0, 1.0)):
        a, b = (min(int(x * 2.0**64), 2**64 - 1) for x in (low, high))

        def run(batches, a=a, b=b):
            held, below, names = Heads(coded), np.zeros(len(coded), np.int64), ["head", "h", "case_id", "below"]
            many = max(1, 4 * LANES // len(coded))
            for batch in batches:
                ids = batch.column("case_id").to_pylist()
                for i in range(0, len(ids), many):
                    some = ids[i : i + many]
                    h = held.first64([c.encode() for c in some])
                    under = h < a
                    below += under.sum(0)
                    case, near = np.nonzero(~under & (h <= b))
                    if len(near):
                        digests = [md5(coded[k] + some[c].encode()).digest() for c, k in zip(case.tolist(), near.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(digests, pa.binary()), pa.array(some, pa.string()).take(pa.array(case)), pa.nulls(len(near), pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(coded), dtype=np.int32)), pa.nulls(len(coded), pa.binary()), pa.nulls(len(coded), pa.string()), pa.array(below)], names)

        ensure(cases.sparkSession)
        rows = dealt(cases.select("case_id"), n, "case_id").mapInArrow(run, "head int, h binary, case_id string, below long")
        # the sums of what lies below sort first and are carried along
        w = Window.partitionBy("head").orderBy(F.col("h").isNotNull(), "h", "case_id")
        placed = rows.withColumn("rank", F.sum(F.when(F.col("h").isNotNull(), 1).otherwise(F.col("below"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        found = {r["head"]: (bytes(r["h"]), r["case_id"]) for r in placed.where((F.col("rank") == n1) & F.col("h").isNotNull()).select("head", "h", "case_id").collect()}
        if len(found) == len(heads):
            return [found[i] for i in range(len(heads))]
    raise ValueError("case ids are not unique")


def label_draws(cases: DataFrame, heads: list[str], n: int, wanted: list[int]) -> tuple[DataFrame, list[tuple[bytes, str]]] | None:
    """The log with its label draws, made once, and for every head the ``wanted``-th smallest as :func:`label_cuts` finds it.

    (case_id, outcome, trace, under, near): a bit for each head under whose band the case lies, and the numbers of heads in whose
    band it does; these alone, about sqrt(n) for each head, are ranked.  None where a cut is outside its band.
    """
    if not all(0 < k < n for k in wanted):
        return None
    share = np.array(wanted) / n
    half = BAND * np.sqrt(share * (1 - share) / n)
    a, b = (np.array([min(int(x * 2.0**64), 2**64 - 1) for x in np.clip(v, 0.0, 1.0).tolist()], np.uint64) for v in (share - half, share + half))
    coded = [h.encode() for h in heads]
    schema = "case_id string, outcome int, trace array<string>, under binary, near array<int>, below array<long>"
    kinds = {"case_id": pa.string(), "outcome": pa.int32(), "trace": pa.list_(pa.string()), "under": pa.binary(), "near": pa.list_(pa.int32()), "below": pa.list_(pa.int64())}

    def run(batches):
        held, below, many = Heads(coded), np.zeros(len(coded), np.int64), max(1, 4 * LANES // len(coded))
        for batch in batches:
            ids = batch.column("case_id").to_pylist()
            for i in range(0, len(ids), many):
                some = ids[i : i + many]
                h = held.first64([c.encode() for c in some])
                under = h < a
                below += under.sum(0)
                case, near = np.nonzero(~under & (h <= b))
                at = np.searchsorted(case, np.arange(len(some) + 1)).astype(np.int32)
                own = [batch.column(c).slice(i, many).cast(kinds[c]) for c in ("case_id", "outcome", "trace")]
                bits = pa.array([x.tobytes() for x in np.packbits(under, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*own, bits, pa.ListArray.from_arrays(at, near.astype(np.int32)), pa.nulls(len(some), kinds["below"])], list(kinds))
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds.values()][:-1], pa.array([below.tolist()], kinds["below"])], list(kinds))

    ensure(cases.sparkSession)
    folder = shared_folder(cases.sparkSession, "draws")
    dealt(cases.select("case_id", "outcome", "trace"), n, "case_id", most=MANY_CASES).mapInArrow(run, schema).write.parquet(folder)
    rows = cases.sparkSession.read.schema(schema).parquet(folder)
    log = rows.where(F.col("under").isNotNull()).drop("below")
    # a row for each head
    below = rows.where(F.col("below").isNotNull()).select(F.posexplode("below").alias("head", "below")).groupBy("head").agg(F.sum("below").alias("below"))
    of = lambda values: F.element_at(F.lit(values), F.col("head") + 1)
    near = log.select("case_id", F.explode("near").alias("head")).join(F.broadcast(below), "head").withColumn("h", F.md5(F.concat(of(heads), "case_id")))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy("h", "case_id")))
    found = {r["head"]: (bytes.fromhex(r["h"]), r["case_id"]) for r in near.where(F.col("rank") + F.col("below") == of(wanted)).select("head", "h", "case_id").collect()}
    return (log, [found[i] for i in range(len(heads))]) if len(found) == len(heads) else None


class Labels:
    """Labels of a case under every head, from the cuts."""

    def __init__(self, heads: list[str], cuts: list[tuple[bytes, str]]):
        self.heads, self.cuts = [h.encode() for h in heads], cuts
        self.first = np.array([int.from_bytes(c[:8].ljust(8, b"\0"), "big") for c, _ in cuts], np.uint64)
        self.held: dict[tuple[int, int], Heads] = {}

    def many(self, case_ids: list[str], low: int, high: int) -> np.ndarray:
        """(cases, heads): 0 or 1 for the heads from ``low`` up to ``high``."""
        if (low, high) not in self.held:
            self.held[low, high] = Heads(self.heads[low:high])
        h, cut = self.held[low, high].first64([c.encode() for c in case_ids]), self.first[low:high]
        y = (h < cut).astype(np.int64)
        for c, i in zip(*[x.tolist() for x in np.nonzero(h == cut)], strict=True):
            y[c, i] = (md5(self.heads[low + i] + case_ids[c].encode()).digest(), case_ids[c]) <= self.cuts[low + i]
        return y

    def of(self, case_id: str, low: int, high: int) -> np.ndarray:
        return self.many([case_id], low, high)[0]

    def drawn(self, case_ids: list[str], under: list[bytes], near: list[list[int]]) -> np.ndarray:
        """(cases, heads): 0 or 1, from the draws of :func:`label_draws`."""
        y = np.unpackbits(np.frombuffer(b"".join(under), np.uint8).reshape(len(case_ids), -1), axis=1, count=len(self.heads))
        for c, heads in enumerate(near):
            for i in heads:
                y[c, i] = (md5(self.heads[i] + case_ids[c].encode()).digest(), case_ids[c]) <= self.cuts[i]
        return y
