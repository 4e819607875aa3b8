"""Pruning of logically related constraints: DataFrames of (ctype, a, b, econf, esupp, tconf, tsupp, ...).

The three rules that depend on order within one (a, b) are a fold over the rule list inside a row that holds
the pair's templates, at most 17 of them; the others are joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalogues as cat
from .ranks import Ordered

ORDER = ("econf", "esupp", "tconf", "tsupp")


def _leq(p, q):
    """All four measures of p are at most those of q."""
    return reduce(lambda x, y: x & y, [p[m] <= q[m] for m in ORDER])


def by_strength(constraints: DataFrame) -> DataFrame:
    """Adds place: by falling trace confidence, event confidence and trace support, then by name."""
    order = [F.desc(F.round(m, 12)) for m in ("tconf", "econf", "tsupp")]
    return Ordered(constraints, *order, "ctype", "a", F.asc_nulls_first("b")).rows.drop("part").withColumnRenamed("rank", "place")


def _folded(constraints: DataFrame, steps: list[tuple[str, str]], decide) -> DataFrame:
    """Drop what ``decide`` names; a step is skipped once either side is gone or absent."""
    groups = constraints.where("b is not null").groupBy("a", "b").agg(
        F.map_from_entries(F.collect_list(F.struct("ctype", F.struct(*ORDER)))).alias("m")
    )
    plan = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in steps])

    def step(gone, s):
        p, q = F.try_element_at(F.col("m"), s["p"]), F.try_element_at(F.col("m"), s["q"])
        skip = p.isNull() | q.isNull() | F.array_contains(gone, s["p"]) | F.array_contains(gone, s["q"])
        out = decide(p, q, s)
        return F.when(skip | out.isNull(), gone).otherwise(F.array_append(gone, F.coalesce(out, F.lit(""))))

    gone = groups.select("a", "b", F.explode(F.aggregate(plan, F.array().cast("array<string>"), step)).alias("ctype"))
    return constraints.join(gone, ["ctype", "a", "b"], "left_anti")


def subsumption(constraints: DataFrame) -> DataFrame:
    """A stronger constraint at least as good replaces the weaker; else it goes itself."""
    return _folded(constraints, cat.SUBSUMPTION, lambda strong, weak, s: F.when(_leq(weak, strong), s["q"]).otherwise(s["p"]))


def equivalence(constraints: DataFrame) -> DataFrame:
    """Of equal languages the better stays, on ties the first."""
    return _folded(constraints, cat.EQUIVALENCE, lambda p, q, s: F.when(_leq(q, p), s["q"]).otherwise(s["p"]))


def negation(constraints: DataFrame) -> DataFrame:
    """A side that is strictly dominated by its negation goes."""
    return _folded(
        constraints, cat.NEGATION,
        lambda p, q, s: F.when(_leq(q, p) & ~_leq(p, q), s["q"]).when(_leq(p, q) & ~_leq(q, p), s["p"]),
    )


def swapped_subsumption(constraints: DataFrame, relations: list[tuple[str, str]] = ()) -> DataFrame:
    """(strong(a, b), weak(b, a)) relations; the catalogue is empty, so by default nothing goes."""
    if not relations:
        return constraints
    spark = constraints.sparkSession
    rel = F.broadcast(spark.createDataFrame(list(relations), "strong string, weak string"))
    one = constraints.select(F.col("ctype").alias("strong"), F.col("a").alias("p"), F.col("b").alias("q"), F.struct(*ORDER).alias("ms"))
    two = constraints.select(F.col("ctype").alias("weak"), F.col("b").alias("p"), F.col("a").alias("q"), F.struct(*ORDER).alias("mw"))
    met = one.join(rel, "strong").join(two, ["weak", "p", "q"])
    better = _leq(F.col("mw"), F.col("ms"))
    gone = met.select(
        F.when(better, F.col("weak")).otherwise(F.col("strong")).alias("ctype"),
        F.when(better, F.col("q")).otherwise(F.col("p")).alias("a"), F.when(better, F.col("p")).otherwise(F.col("q")).alias("b"),
    )
    return constraints.join(gone.distinct(), ["ctype", "a", "b"], "left_anti")


def transitivity(constraints: DataFrame) -> DataFrame:
    """T1(a, b) and T2(b, c) of a family entail the family's basic template on (a, c), which goes."""
    out = constraints
    gone = None
    for family, entailed in cat.TRANSITIVITY:
        links = constraints.where(F.col("ctype").isin(*family) & F.col("b").isNotNull()).select("a", "b").distinct()
        via = links.select(F.col("a").alias("mid"), F.col("b").alias("c"))
        reach = links.join(via, F.col("b") == F.col("mid")).where("a <> c").select(F.lit(entailed).alias("ctype"), "a", F.col("c").alias("b")).distinct()
        gone = reach if gone is None else gone.union(reach)
    return out.join(gone, ["ctype", "a", "b"], "left_anti")


def entailment(constraints: DataFrame) -> DataFrame:
    """What two constraints on the same activities entail together goes."""
    spark = constraints.sparkSession
    rel = F.broadcast(spark.createDataFrame(cat.ENTAILMENT, "p string, q string, ctype string"))
    one = constraints.select(F.col("ctype").alias("p"), "a", "b").join(rel, "p")
    gone = one.join(constraints.select(F.col("ctype").alias("q"), "a", "b"), ["q", "a", "b"]).select("ctype", "a", "b").distinct()
    return constraints.join(gone, ["ctype", "a", "b"], "left_anti")


def collapse_warnings(constraints: DataFrame) -> DataFrame:
    """(family, a, b), a < b: pairs with a member of one family in both directions."""
    names = {"Response": ["Response", "AlternateResponse", "ChainResponse"], "Precedence": ["Precedence", "AlternatePrecedence", "ChainPrecedence"]}
    out = None
    for family, members in names.items():
        there = constraints.where(F.col("ctype").isin(*members)).select("a", "b").distinct()
        back = there.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = there.join(back, ["a", "b"], "left_semi").where("a < b").select(F.lit(family).alias("family"), "a", "b")
        out = both if out is None else out.union(both)
    return out


def prune(constraints: DataFrame) -> DataFrame:
    """The whole chain in its order.  Every step reads its input more than once, so inputs are kept (a specification has
    templates x activities^2 rows at most)."""
    out = constraints.persist()
    for step in (subsumption, swapped_subsumption, equivalence, negation, transitivity, entailment):
        out = step(out).persist()
    return out


def neighbourhood(constraints: DataFrame) -> DataFrame:
    """(ctype, a, b, n_neighbours): constraints that share an activity with each one."""
    each = constraints.select("ctype", "a", "b", F.explode(F.array_compact(F.array("a", "b"))).alias("act"))
    other = each.select(F.col("ctype").alias("o"), F.col("a").alias("oa"), F.col("b").alias("ob"), "act")
    met = each.join(other, "act").where(~(F.col("ctype").eqNullSafe(F.col("o")) & F.col("a").eqNullSafe(F.col("oa")) & F.col("b").eqNullSafe(F.col("ob"))))
    return met.select("ctype", "a", "b", "o", "oa", "ob").distinct().groupBy("ctype", "a", "b").agg(F.count(F.lit(1)).alias("n_neighbours"))
