"""Activity and pair statistics of traces, without a shuffle: both are unfolded inside the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Both activities' places in one order, doubled, and one more for the second's: from these the gaps are counted in one pass.
MERGED_SQL = "sort_array(concat(transform(px, p -> 2 * p), transform(py, p -> 2 * p + 1))) as both_at"
#: Gaps between consecutive places of one activity that hold the other: changes from the one to the other, less the last
#: if nothing of the one comes after it.
_GAPS = "coalesce(size(filter(transform(both_at, (e, i) -> e % 2 = {own} and get(both_at, i + 1) % 2 = {other}), t -> t)) - int(try_element_at(both_at, -1) % 2 = {other}), 0)"
#: The pair statistics from position arrays px and py (null: the activity is absent) and both_at.
PAIR_SQL = [
    "coalesce(size(px), 0) as cx", "coalesce(size(py), 0) as cy",
    "px[0] as fx", "try_element_at(px, -1) as lx", "py[0] as fy", "try_element_at(py, -1) as ly",
    "coalesce(size(array_intersect(transform(px, p -> p + 1), py)), 0) as b",
    _GAPS.format(own=0, other=1) + " as gx", _GAPS.format(own=1, other=0) + " as gy",
    "coalesce(size(filter(px, p -> p < try_element_at(py, -1))), 0) as xb",
    "coalesce(size(filter(py, p -> p > px[0])), 0) as ya",
]


def activities(traces: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each trace, with ``acts``: its activities and their 0-based positions."""
    return traces.selectExpr(
        *keep, "trace",
        "transform(array_distinct(trace), a -> named_struct('act', a, 'at', filter(transform(trace, (e, i) -> if(e = a, i, null)), p -> p is not null))) as acts",
    )


def act_stats(traces: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, act, cnt, first_pos, last_pos)."""
    return activities(traces, keep).selectExpr(*keep, "explode(acts) as x").selectExpr(
        *keep, "x.act as act", "size(x.at) as cnt", "element_at(x.at, 1) as first_pos", "element_at(x.at, -1) as last_pos"
    )


def pair_stats(traces: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, x, y, cx, ... ya) for every ordered pair of different activities of a trace."""
    rows = activities(traces, keep).selectExpr(*keep, "acts", "explode(acts) as p").selectExpr(*keep, "p", "explode(acts) as q").where("p.act <> q.act")
    return rows.selectExpr(*keep, "p.act as x", "q.act as y", "p.at as px", "q.at as py").selectExpr("*", MERGED_SQL).selectExpr(*keep, "x", "y", *PAIR_SQL)


def alphabet(traces: DataFrame, minimum: int = 1) -> DataFrame:
    """(act, n_events, n_cases) of activities with at least ``minimum`` events."""
    return (
        act_stats(traces.withColumn("w", F.lit(1)), ["w"]).groupBy("act")
        .agg(F.sum("cnt").alias("n_events"), F.count(F.lit(1)).alias("n_cases")).where(F.col("n_events") >= minimum)
    )


def opposite_direction(a: str = "a", b: str = "b", pairs=(("INCREASE", "DECREASE"), ("ENABLE", "DISABLE"))):
    """Whether two names differ in exactly one word, and there by opposite directions."""
    x, y = F.split(F.upper(a), "[ _]+"), F.split(F.upper(b), "[ _]+")
    different = F.filter(F.arrays_zip(x.alias("p"), y.alias("q")), lambda t: ~t["p"].eqNullSafe(t["q"]))
    one = F.try_element_at(different, F.lit(1))
    opposite = F.lit(False)
    for p, q in pairs:
        opposite = opposite | ((one["p"] == p) & (one["q"] == q)) | ((one["p"] == q) & (one["q"] == p))
    return (F.size(x) == F.size(y)) & (F.size(different) == 1) & F.coalesce(opposite, F.lit(False))
