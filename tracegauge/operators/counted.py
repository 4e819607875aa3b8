"""Null labels and null orders drawn as counts, for statistics that cases enter only by how many of them have a label and an order.

When all labels are permuted, the positive cases among those of a group are hypergeometric, given what the other groups got; when
each trace of a group is permuted, the cases that its distinct orders get are multinomial.  Drawing these counts is drawing
the labels and orders of all cases, one by one, and adding up: the law is the same, and the work is that of the groups and
replicates, not of the cases.  A draw depends on the seed, the block of replicates and the group, not on how Spark deals them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashes import md5

#: Replicates whose draws are made together; groups of a part, about; cases of a group that is drawn case by case.
BLOCK, LEAVES, SLICE = 10, 32, 2_000
#: Labels of more cases can't be drawn as counts (a limit of numpy's hypergeometric draws).
MOST = 10**9
#: A group is drawn as counts if it has no more distinct orders, and this many times as many cases.
ORDERS, TIMES = 200, 14


def generator(*key) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(md5("|".join(map(str, key)).encode()).digest(), "big")))


def orders_of(acts: list[str]) -> int:
    """How many different orders a trace of these activities has."""
    return math.factorial(len(acts)) // math.prod(math.factorial(int(n)) for n in np.unique(acts, return_counts=True)[1])


def as_counts(distinct: int, cases: int) -> bool:
    return distinct == 1 or (distinct <= ORDERS and cases > TIMES * distinct)


def leaves(traces: DataFrame) -> DataFrame:
    """(acts, slice, cases): cases by multiset of activities; a group that is drawn case by case comes in slices."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for acts, n in zip(pdf["acts"], pdf["cases"].tolist(), strict=True):
                step = n if as_counts(orders_of(list(acts)), n) else SLICE
                rows += [(acts, i, min(step, n - i * step)) for i in range(-(-n // step))]
            yield pd.DataFrame(rows, columns=["acts", "slice", "cases"])

    groups = traces.select(F.array_sort("trace").alias("acts")).groupBy("acts").agg(F.count(F.lit(1)).alias("cases"))
    return groups.mapInPandas(cut, "acts array<string>, slice int, cases long")


def parted(groups: DataFrame, count: int) -> DataFrame:
    return groups.withColumn("part", F.pmod(F.crc32(F.to_json(F.struct("acts", "slice"))), F.lit(count)).cast("int"))


class Shares:
    """Splits the positive cases of permuted labels between parts, by halves; each task finds its own parts' numbers."""

    def __init__(self, sizes: list[int]):
        self.upto = np.append(0, np.cumsum(np.array(sizes, np.int64)))

    def of(self, part: int, positive: np.ndarray, *key) -> np.ndarray:
        low, high = 0, len(self.upto) - 1
        while high - low > 1:
            mid = (low + high) // 2
            left = generator(*key, low, high).hypergeometric(int(self.upto[mid] - self.upto[low]), int(self.upto[high] - self.upto[mid]), positive)
            low, high, positive = (low, mid, left) if part < mid else (mid, high, positive - left)
        return positive


def split(g: np.random.Generator, sizes: list, positive: np.ndarray):
    """Yields the positive cases in one group after another, of ``sizes`` (numbers, or arrays that go with ``positive``)."""
    rest = sum(sizes)
    for size in sizes:
        rest = rest - size
        own = g.hypergeometric(size, rest, positive)
        positive = positive - own
        yield own


def group_counts(g: np.random.Generator, cases: int, positive: np.ndarray, distinct: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a group whose positive cases are given (replicates, inner labels and as labelled): positive cases (distinct orders, replicates,
    inner labels and as labelled) by null order, and cases (distinct orders, replicates, class, as ordered and inner orders)."""
    own = positive[:, -1]
    classes = np.stack([cases - own, own], 1)
    if distinct == 1:
        return positive[None], np.repeat(classes[None, :, :, None], orders, 3)
    drawn = g.multinomial(np.repeat(classes[:, :, None], orders, 2), np.full(distinct, 1 / distinct)).transpose(3, 0, 1, 2)
    null = drawn[:, :, :, 0]
    inner = np.stack(list(split(g, list(null.sum(2)[:, :, None]), positive[:, :-1])))
    return np.concatenate([inner, null[:, :, 1, None]], 2), drawn


def case_draws(g: np.random.Generator, cases: int, left: int, positive: np.ndarray, codes: np.ndarray, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels (cases, replicates, inner labels and as labelled) and orders (cases, replicates, as ordered and inner, places) of the next ``cases`` of
    a group's ``left``, among which ``positive`` are; what is left of these is kept there."""
    labels = np.empty((cases, *positive.shape), np.int64)
    for i in range(cases):
        labels[i] = g.random(positive.shape) * (left - i) < positive
        positive -= labels[i]
    return labels, g.permuted(np.broadcast_to(codes, (cases, len(positive), orders, len(codes))).copy(), axis=3)
