"""Draws as arrays against hashlib, and the distinct orders of a trace."""

import hashlib
import itertools

import numpy as np
import pytest

from tracegauge.operators import hashes, replicates


@pytest.mark.parametrize("heads", [1, 700, 20_000])
def test_first64_equals_hashlib(heads):
    h = [f"42|{i}|{'x' * (i % 3)}".encode() for i in range(heads)]
    for tails in ([b"", b"c|0"], [b"a" * n for n in (1, 30, 44, 45, 46, 70)], ["äö|7".encode()] * 2):
        want = [[int.from_bytes(hashlib.md5(x + t).digest()[:8], "big") for x in h] for t in tails]
        assert (hashes.Heads(h).first64(tails) == np.array(want, np.uint64)).all()


def test_drawn_orders_of_many_cases():
    heads, cases = [f"7|{r}|".encode() for r in range(500)], ["u|1", "u|22"]
    for length in (2, 3, 12):
        got = replicates.drawn_orders(hashes.Heads(heads), cases, length)
        for i, c in enumerate(cases):
            for j in (0, 99, 499):
                assert got[i, j].tolist() == sorted(range(length), key=lambda p: hashlib.md5(heads[j] + f"{c}|{p}".encode()).digest())


def test_distinct_orders_are_found():
    codes = np.array([0, 2, 1, 1])
    orders, places = replicates.places(codes, 3)
    assert sorted(map(tuple, orders.tolist())) == sorted(set(itertools.permutations(codes.tolist())))
    drawn = codes[np.array(list(itertools.permutations(range(4))))]
    assert (orders[places.of(drawn)] == drawn).all()
    assert replicates.places(np.arange(8), 8) is None and replicates.places(np.array([0] * 50 + [1]), 2) is None
