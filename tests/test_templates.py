"""Every trace of up to six events over three letters, by position definitions."""

import itertools

import pytest
from pyspark.sql import functions as F

from tracegauge.functions import templates as tp
from tracegauge.operators import measures
from tracegauge.operators.automata import build, entails
from tracegauge.functions.catalogues import ENTAILMENT, SUBSUMPTION, TRANSITIVITY

TRACES = ["".join(t) for k in range(1, 7) for t in itertools.product("abc", repeat=k)]


def holds(name, t, x="a", y="b"):
    """1, 0 or None (vacuous)."""
    px, py = [i for i, e in enumerate(t) if e == x], [i for i, e in enumerate(t) if e == y]
    between = lambda ps, qs: all(any(p < q < r for q in qs) for p, r in itertools.pairwise(ps))
    chain = sum(p + 1 in py for p in px)
    both = bool(px and py)
    rule = {
        "Init": (True, t[0] == x), "End": (True, t[-1] == x),
        "Response": (px, bool(px) and any(q > px[-1] for q in py)), "AlternateResponse": (px, between(px, py)), "ChainResponse": (px, chain == len(px)),
        "Precedence": (py, bool(py) and any(p < py[0] for p in px)), "AlternatePrecedence": (py, between(py, px)), "ChainPrecedence": (py, chain == len(py)),
        "NotResponse": (both, both and py[-1] < px[0]), "NotChainResponse": (both, chain == 0), "NotChainPrecedence": (both, chain == 0),
        "NotPrecedence": (py, not px or bool(py) and px[0] > py[-1]), "Succession": (both, both and py[-1] > px[-1] and px[0] < py[0]),
        "AlternateSuccession": (both, between(px, py) and between(py, px)), "ChainSuccession": (both, chain == len(px) == len(py)),
        "NotSuccession": (both, both and py[-1] < px[0]), "NotChainSuccession": (both, chain == 0),
    }[name]
    return int(bool(rule[1])) if rule[0] else None


def event(name, t, x="a", y="b"):
    """(activations, fulfilled)."""
    px, py = [i for i, e in enumerate(t) if e == x], [i for i, e in enumerate(t) if e == y]
    after, before = sum(any(q > p for q in py) for p in px), sum(any(p < q for p in px) for q in py)
    gaps = lambda ps, qs: sum(any(p < q < r for q in qs) for p, r in itertools.pairwise(ps))
    chain, n, m = sum(p + 1 in py for p in px), len(px), len(py)
    less = lambda k: max(k - 1, 0)
    return {
        "RespondedExistence": (n, n if m else 0), "NotRespondedExistence": (n, 0 if m else n), "Response": (n, after), "AlternateResponse": (less(n), gaps(px, py)),
        "ChainResponse": (n, chain), "Precedence": (m, before), "AlternatePrecedence": (less(m), gaps(py, px)), "ChainPrecedence": (m, chain),
        "NotResponse": (n, n - after) if m else (0, 0), "NotChainResponse": (n, n - chain), "NotPrecedence": (m, m - before), "NotChainPrecedence": (m, m - chain),
        "Succession": (n + m, after + before), "AlternateSuccession": (less(n) + less(m), gaps(px, py) + gaps(py, px)), "ChainSuccession": (n + m, 2 * chain),
        "NotSuccession": (n + m, n - after + m - before), "NotChainSuccession": (n + m, n + m - 2 * chain) if n and m else (0, 0),
    }[name]


@pytest.fixture(scope="module")
def traces(spark):
    return spark.createDataFrame([(t, list(t)) for t in TRACES], "case_id string, trace array<string>").repartition(8).cache()


@pytest.fixture(scope="module")
def cands(spark):
    rows = [(n, "a", "b") for n in tp.BINARY] + [("Init", "a", None), ("End", "a", None)]
    return spark.createDataFrame(rows, "ctype string, a string, b string")


def test_holds(traces, cands):
    got = {(r["case_id"], r["ctype"]): r["sat"] for r in measures.holds(traces, cands, ["case_id"]).collect()}
    want = {(t, n): h for t in TRACES for n in ("Init", "End", *tp.TRACE_BINARY) if (h := holds(n, t)) is not None}
    assert got == want


def test_sums_of_both_semantics(traces, cands):
    v = traces.select("trace", F.expr("1L + abs(xxhash64(case_id)) % 3").alias("w"), "case_id").cache()
    weight = {r["case_id"]: r["w"] for r in v.collect()}
    trace = {r["ctype"]: r for r in measures.pattern_sums(v, cands, "trace", ["w"]).collect()}
    for n in ("Init", "End", *tp.TRACE_BINARY):
        h = [(weight[t], holds(n, t)) for t in TRACES]
        assert trace[n]["w_app"] == sum(w for w, x in h if x is not None), n
        assert trace[n]["w_sat"] == sum(w for w, x in h if x), n
        assert trace[n]["w_all"] == sum(weight.values())
    ev = {r["ctype"]: r for r in measures.pattern_sums(v, cands, "event", ["w"]).collect()}
    for n in tp.BINARY:
        e = [(weight[t], *event(n, t)) for t in TRACES]
        assert (ev[n]["w_on"], ev[n]["w_ful"]) == (sum(w * a for w, a, _ in e), sum(w * f for w, _, f in e)), n
        assert ev[n]["w_t_act"] == sum(w for w, a, _ in e if a), n
        assert ev[n]["w_t_sat"] == sum(w for w, a, f in e if a and a == f), n


def test_candidates_that_never_meet_are_zero(spark, traces):
    c = spark.createDataFrame([("Response", "a", "z"), ("Precedence", "z", "a"), ("Succession", "y", "z"), ("NotPrecedence", "z", "a")], "ctype string, a string, b string")
    v = traces.select("trace", F.lit(1).cast("long").alias("w"))
    got = {r["ctype"]: (r["w_app"], r["w_sat"]) for r in measures.pattern_sums(v, c, "trace", ["w"]).collect()}
    n = sum("a" in t for t in TRACES)
    assert got == {"Response": (n, 0), "Precedence": (n, 0), "Succession": (0, 0), "NotPrecedence": (n, n)}


def test_automata_agree_with_words():
    for n in ("Init", "End", "Response", "ChainResponse", "Precedence", "ChainPrecedence", "NotResponse", "NotChainResponse", "RespondedExistence", "Succession", "ChainSuccession"):
        a = build(n, "a", None if n in ("Init", "End") else "b", "abc")
        for t in TRACES:
            if n == "RespondedExistence":
                want = "a" not in t or "b" in t
            elif n in ("NotResponse", "NotChainResponse"):
                want = not any(t[i] == "a" and "b" in (t[i + 1 :] if n == "NotResponse" else t[i + 1 : i + 2]) for i in range(len(t)))
            elif n in ("Succession", "ChainSuccession"):
                p = n.removesuffix("Succession")
                want = all(holds(p + h, t) in (1, None) for h in ("Response", "Precedence"))
            else:
                want = holds(n, t) in (1, None)
            assert a.accepts(t) == want, (n, t)


def test_catalogues_by_automata():
    """Subsumption and transitivity are language facts (alternation is stricter here than pairwise counting)."""
    for strong, weak in SUBSUMPTION:
        if "Not" in strong:
            continue
        assert entails([(strong, "a", "b")], (weak, "a", "b")), (strong, weak)
    for family, entailed in TRANSITIVITY:
        for t in family:
            assert entails([(t, "a", "b"), (t, "b", "c")], (entailed, "a", "c")), t
    assert entails([("Response", "a", "b"), ("Precedence", "a", "b")], ("Succession", "a", "b"))
    assert not entails([("Response", "a", "b")], ("Response", "b", "a"))
    assert len(ENTAILMENT) == 20
