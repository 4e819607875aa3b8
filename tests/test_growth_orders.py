"""Templates of many orders as bits, against places one by one."""

import numpy as np
import pytest

from tracegauge.functions import templates as tp
from tracegauge.operators import replicates


@pytest.mark.parametrize("k, length", [(2, 2), (3, 7), (5, 15), (4, 31), (6, 62)])
def test_masks_equal_places(k, length):
    g, names = np.random.default_rng(k), list(tp.TRACE_BINARY)
    base = np.concatenate([np.arange(k), g.integers(0, k, length - k)])
    codes = np.stack([g.permutation(base) for _ in range(500)])
    off = ~np.eye(k, dtype=bool)
    want = replicates.pair_verdicts(codes, k, names)
    assert (replicates.mask_verdicts(replicates.masks(codes.T, k), length, names).transpose(0, 3, 1, 2)[:, :, off] == want[:, :, off]).all()
    heads = replicates.Heads([f"7|{r}|".encode() for r in range(30)])
    drawn, order = replicates.drawn_codes(heads, ["a", "b"], np.stack([base, base])), replicates.drawn_orders(heads, ["a", "b"], length)
    assert (drawn.transpose(1, 2, 0) == base[order]).all()


def test_sums_of_more_cases_than_a_byte_holds():
    names, unary = ["Response", "NotPrecedence", "AlternateSuccession"], ["Init", "End"]
    held, want = replicates.Vectors((1, 7 + 2)), {}
    sums, g = None, np.random.default_rng(3)
    for i in range(300):
        t = replicates.Trace(list("aabbc" if i % 2 else "abccc"), names, unary)
        sums = sums or replicates.OrderSums(t, 7)
        codes = np.stack([g.permutation(t.codes) for _ in range(7)])
        sums.add(t, codes[:4].T, 0)
        sums.add(t, codes[4:].T, 4)
        sums.done(t, held)
        for key, row in zip(t.keys, t.verdicts(codes), strict=True):
            want[key] = want.get(key, 0) + row
    sums.close(held)
    assert all((held.values[held.index[k], 0, 2:] == v).all() for k, v in want.items())
