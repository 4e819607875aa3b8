"""Candidates, measures, holds and prevalences.

Sums over cases are taken on variants.  A candidate's sum has three parts: traces with both activities, and
traces with one of them, taken as all traces with it less those that have both.  So a pair of activities
that never meet costs nothing, there is no candidate x case product, and one pass over the variants with one
pre-aggregated shuffle serves all templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates as tp
from .statistics import MERGED_SQL, PAIR_SQL, activities, opposite_direction


def candidates(alphabet: DataFrame, binary=tp.ENABLED, unary=tp.UNARY, exclude_opposite: bool = True) -> DataFrame:
    """(ctype, a, b) for every activity and ordered pair of different activities."""
    acts = alphabet.select("act")
    one = acts.select(F.explode(F.array(*[F.lit(t) for t in unary])).alias("ctype"), F.col("act").alias("a"), F.lit(None).cast("string").alias("b"))
    pairs = acts.select(F.col("act").alias("a")).join(F.broadcast(acts.select(F.col("act").alias("b"))), F.col("a") != F.col("b"))
    if exclude_opposite:
        pairs = pairs.where(~opposite_direction())
    two = pairs.select(F.explode(F.array(*[F.lit(t) for t in binary])).alias("ctype"), "a", "b")
    return one.unionByName(two)


def _counts(name: str, semantics: str, missing: dict | None = None) -> dict[str, str]:
    """Additive counts of one trace, as SQL."""
    if semantics == "trace":
        app, sat = tp.holds(name, missing)
        return {"app": f"int({app})", "sat": f"int(({app}) and {sat})"}
    act, ful = tp.event(name, missing)
    return {"on": act, "ful": ful, "t_act": f"int({act} > 0)", "t_sat": f"int({act} > 0 and ({ful}) = ({act}))"}


def _facts(variants: DataFrame, weights: list[str]) -> DataFrame:
    """(x, y, statistics, weights) for every pair of activities of a trace; y null: x alone; x null: y alone;
    both null: the trace itself (``_len`` events).  One pass, no shuffle."""
    rows = activities(variants, weights).selectExpr(*weights, "size(trace) as _len", "array_append(acts, null) as acts")
    rows = rows.selectExpr(*weights, "_len", "acts", "explode(acts) as p").selectExpr(*weights, "_len", "p", "explode(acts) as q")
    rows = rows.where("not (p.act <=> q.act) or (p is null and q is null)").selectExpr(*weights, "_len", "p.act as x", "q.act as y", "p.at as px", "q.at as py")
    return rows.selectExpr("*", MERGED_SQL).selectExpr(*weights, "_len", "x", "y", *PAIR_SQL)


def pattern_sums(variants: DataFrame, cands: DataFrame, semantics: str, weights: list[str], binary=tp.BINARY) -> DataFrame:
    """Weighted sums of a template's counts for each candidate; 0 where nothing applies.  Also ``w_all`` and
    ``w_events``, the sums over all traces.

    ``binary``: the templates that the candidates may have; others aren't evaluated.
    """
    values = ["app", "sat"] if semantics == "trace" else ["on", "ful", "t_act", "t_sat"]
    names = [n for n in binary if n in (tp.TRACE_BINARY if semantics == "trace" else tp.BINARY)]

    def entry(name: str, counts: dict[str, str]) -> str:
        return f"named_struct('ctype', '{name}', " + ", ".join(f"'{v}', bigint({counts[v]})" for v in values) + ")"

    both, alone_x, alone_y = ([], [], [])
    for name in names:
        full, x0, y0 = (_counts(name, semantics, m) for m in (None, tp.X_ONLY, tp.Y_ONLY))
        both.append(entry(name, {v: f"({full[v]}) - ({x0[v]}) - ({y0[v]})" for v in values}))
        alone_x.append(entry(name, x0))
        alone_y.append(entry(name, y0))
    hit = {v: "1" for v in values}
    for name, test in (("Init", "fx = 0"), ("End", "lx = _len - 1")):
        # all traces are applicable; what is added up here is the satisfied ones
        alone_x.append(entry(name, {v: f"int({test})" if v in ("sat", "ful", "t_sat") else "0" for v in values}))
    stack = f"""explode(case when x is null and y is null then array({entry("*", {v: "0" for v in hit})})
        when y is null then array({", ".join(alone_x)}) when x is null then array({", ".join(alone_y)})
        else array({", ".join(both)}) end) as t"""
    rows = _facts(variants, weights).selectExpr(*weights, "x", "y", "_len", stack)
    sums = [f"sum({w} * t.{v}) as {w}_{v}" for w in weights for v in values]
    sums += [f"sum(if(t.ctype = '*', {w}, 0)) as {w}_all" for w in weights] + [f"sum(if(t.ctype = '*', {w} * _len, 0)) as {w}_events" for w in weights]
    facts = rows.groupBy(F.col("t.ctype").alias("f_ctype"), F.col("x").alias("f_x"), F.col("y").alias("f_y")).agg(*[F.expr(e) for e in sums])
    parts = """explode(array(named_struct('k', ctype, 'x', a, 'y', b), named_struct('k', if(b is null, null, ctype), 'x', a, 'y', string(null)),
        named_struct('k', if(b is null, null, ctype), 'x', string(null), 'y', b), named_struct('k', '*', 'x', string(null), 'y', string(null)))) as key"""
    keys = cands.selectExpr("ctype", "a", "b", parts).where("key.k is not null")
    names_out = [e.rsplit(" as ", 1)[1] for e in sums]
    met = keys.join(facts, F.expr("key.k = f_ctype and key.x <=> f_x and key.y <=> f_y"), "left")
    out = met.groupBy("ctype", "a", "b").agg(*[F.expr(f"bigint(coalesce(sum({c}), 0))").alias(c) for c in names_out])
    first = [f"{w}_{v}" for w in weights for v in values if v in ("app", "on", "t_act")]
    return out.selectExpr("ctype", "a", "b", *[f"if(b is null, {c.split('_')[0]}_all, {c}) as {c}" if c in first else c for c in names_out])


def class_prevalence(variants: DataFrame, cands: DataFrame, binary=tp.BINARY) -> DataFrame:
    """Per candidate: applicable and satisfied cases, prevalence in either class, and their difference."""
    s = pattern_sums(variants, cands, "trace", ["n0", "n1"], binary)
    share = lambda k: f"coalesce(try_divide(double(n{k}_sat), n{k}_app), 0d)"
    return s.selectExpr(
        "ctype", "a", "b", "n0_app as n_app0", "n0_sat as n_sat0", "n1_app as n_app1", "n1_sat as n_sat1",
        f"{share(0)} as prev0", f"{share(1)} as prev1", f"{share(1)} - {share(0)} as delta",
    )


def support_confidence(variants: DataFrame, cands: DataFrame, binary=tp.BINARY) -> DataFrame:
    """Support (satisfied / all cases) and confidence (satisfied / applicable) in either class."""
    s = pattern_sums(variants, cands, "trace", ["n0", "n1"], binary)
    share = lambda k, whole: f"coalesce(try_divide(double(n{k}_sat), n{k}_{whole}), 0d)"
    return s.selectExpr(
        "ctype", "a", "b", f"{share(0, 'all')} as supp0", f"{share(1, 'all')} as supp1", f"{share(0, 'app')} as conf0", f"{share(1, 'app')} as conf1",
        "n0_app as n_app0", "n1_app as n_app1", "n0_sat as n_sat0", "n1_sat as n_sat1",
    )


def measures(variants: DataFrame, cands: DataFrame, weight: str, binary=tp.BINARY) -> DataFrame:
    """Event- and trace-based confidence, coverage and support with their raw counts, for one class."""
    s = pattern_sums(variants, cands, "event", [weight], binary)
    part = lambda n, d: f"{weight}_{n} / double(greatest(1, {weight}_{d}))"
    return s.selectExpr(
        "ctype", "a", "b", f"{part('ful', 'on')} as econf", f"{part('on', 'events')} as ecov", f"{part('ful', 'events')} as esupp",
        f"{part('t_sat', 't_act')} as tconf", f"{part('t_act', 'all')} as tcov", f"{part('t_sat', 'all')} as tsupp",
        f"{weight}_on as n_act", f"{weight}_ful as n_ful", f"{weight}_t_act as t_act", f"{weight}_t_sat as t_sat", f"{weight}_events as n_events", f"{weight}_all as n_traces",
    )


def passes(econf: float = 0, esupp: float = 0, tconf: float = 0, tsupp: float = 0) -> Column:
    """The threshold filter; all 0 lets everything through."""
    return (F.col("econf") >= econf) & (F.col("esupp") >= esupp) & (F.col("tconf") >= tconf) & (F.col("tsupp") >= tsupp)


def holds(traces: DataFrame, cands: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, ctype, a, b, sat): three-valued satisfaction in long form; vacuous rows are absent.

    For cases or variants.  A candidate meets only traces with one of its activities; candidates number
    templates x activities^2 and are broadcast.
    """
    entry = lambda n, m=None: "named_struct('ctype', '{}', 'app', {}, 'sat', {})".format(n, *tp.holds(n, m))
    # one activity alone: only templates whose activation needs no partner
    x_led, y_led = ("Response", "AlternateResponse", "ChainResponse"), ("Precedence", "AlternatePrecedence", "ChainPrecedence", "NotPrecedence")
    rows = _facts(traces.withColumn("_acts", F.array_distinct("trace")), [*keep, "_acts"]).where("x is not null or y is not null")
    stack = f"""explode(case when y is null then array({", ".join([entry(n, tp.X_ONLY) for n in x_led] + ["named_struct('ctype', 'Init', 'app', true, 'sat', fx = 0)", "named_struct('ctype', 'End', 'app', true, 'sat', lx = _len - 1)"])})
        when x is null then array({", ".join(entry(n, tp.Y_ONLY) for n in y_led)})
        else array({", ".join(entry(n) for n in tp.TRACE_BINARY)}) end) as t"""
    rows = rows.selectExpr(*keep, "_acts", "x", "y", stack).where("t.app").selectExpr(*keep, "_acts", "x", "y", "t.ctype as ctype", "int(t.sat) as sat")
    two, one = cands.where("b is not null"), cands.where("b is null")
    met = rows.where("x is not null and y is not null").join(F.broadcast(two.select("ctype", F.col("a").alias("x"), F.col("b").alias("y"))), ["ctype", "x", "y"])
    unary = ("Init", "End")
    with_x = rows.where("y is null").join(F.broadcast(two.select("ctype", F.col("a").alias("x"), "b")), ["ctype", "x"]).where("not array_contains(_acts, b)").drop("y").withColumnRenamed("b", "y")
    with_y = rows.where("x is null").join(F.broadcast(two.select("ctype", "a", F.col("b").alias("y"))), ["ctype", "y"]).where("not array_contains(_acts, a)").drop("x").withColumnRenamed("a", "x")
    # Init and End are violated by every trace, also those without the activity
    ends = traces.select(*keep, "trace").join(F.broadcast(one)).where(F.col("ctype").isin(*unary)).selectExpr(
        *keep, "ctype", "a as x", "string(null) as y", "int(if(ctype = 'Init', element_at(trace, 1), element_at(trace, -1)) = a) as sat")
    cols = [*keep, "ctype", "x", "y", "sat"]
    out = met.select(*cols).unionByName(with_x.select(*cols)).unionByName(with_y.select(*cols)).unionByName(ends.select(*cols))
    return out.withColumnsRenamed({"x": "a", "y": "b"})
