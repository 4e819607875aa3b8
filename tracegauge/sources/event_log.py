"""Event logs: raw events -> ordered, labelled traces -> trace variants.

Everything is one shuffle by case; options cover the label and cleaning rules that analyses differ in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogOptions:
    """How raw events become traces.

    label: a column expression per event; a case takes its first non-null value in time order.
    positive: label values that mean outcome 1 (compared after trimming, and lower-cased if ``fold_label``).
    signal: an activity that marks a case as positive and is then taken out of the trace.
    keep_null_activity: null activities stay in the trace (as the text ``null_activity``).
    skip_unlabelled: cases without a label are left out (else they are negative).
    first / mode: attributes to carry, taken from the first event or as the most frequent value.
    """

    case: str = "case_id"
    activity: str = "activity"
    timestamp: str = "timestamp"
    ties: tuple[str, ...] = ()
    label: str | None = None
    positive: tuple[str, ...] = ("deviant",)
    negative: tuple[str, ...] = ()
    fold_label: bool = False
    signal: str | None = None
    keep_null_activity: bool = False
    null_activity: str = ""
    skip_unlabelled: bool = False
    first: tuple[str, ...] = ()
    mode: tuple[str, ...] = field(default=())


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema=None) -> DataFrame:
    """A CSV log; without a schema all columns are text (no inference pass)."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def _time(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.try_to_timestamp(F.col(f"`{name}`")) if kind == "string" else F.col(f"`{name}`")


def traces(events: DataFrame, o: LogOptions) -> DataFrame:
    """(case_id, outcome, trace, n_events, start_ts, end_ts, *attributes); cases with an empty trace go."""
    c = lambda x: F.col(f"`{x}`")
    rows = events.where(c(o.case).isNotNull()).select(
        c(o.case).cast("string").alias("case_id"),
        (F.coalesce(c(o.activity).cast("string"), F.lit(o.null_activity)) if o.keep_null_activity else c(o.activity).cast("string")).alias("act"),
        _time(events, o.timestamp).alias("ts"),
        *[c(t).alias(f"tie{i}") for i, t in enumerate(o.ties)],
        (F.trim(F.expr(o.label).cast("string")) if o.label else F.lit(None).cast("string")).alias("label"),
        *[c(a).cast("string").alias(f"attr_{a}") for a in (*o.first, *o.mode)],
    )
    event = F.struct("ts", *[f"tie{i}" for i in range(len(o.ties))], "act")
    ordered = F.array_sort(F.collect_list(F.when(F.col("act").isNotNull(), event)))
    key = F.struct("ts", *[f"tie{i}" for i in range(len(o.ties))])
    grouped = rows.groupBy("case_id").agg(
        ordered.alias("events"),
        F.min_by("label", F.when(F.col("label").isNotNull(), key)).alias("label"),
        *[F.min_by(f"attr_{a}", F.when(F.col(f"attr_{a}").isNotNull(), key)).alias(a) for a in o.first],
        *[F.mode(f"attr_{a}", True).alias(a) for a in o.mode],
    )
    label = F.lower("label") if o.fold_label else F.col("label")
    if o.signal is not None:
        outcome = F.exists("events", lambda e: e["act"] == o.signal).cast("int")
        events_kept = F.filter("events", lambda e: e["act"] != o.signal)
    else:
        if o.negative:
            outcome = F.when(label.isin(*o.negative), 0).when(label.isNotNull(), 1).otherwise(None if o.skip_unlabelled else 0)
        else:
            outcome = F.when(label.isin(*o.positive), 1).when(label.isNotNull(), 0).otherwise(None if o.skip_unlabelled else 0)
        events_kept = F.col("events")
    out = grouped.withColumn("outcome", outcome.cast("int")).withColumn("events", events_kept)
    return out.where((F.size("events") > 0) & F.col("outcome").isNotNull()).select(
        "case_id", "outcome", F.transform("events", lambda e: e["act"]).alias("trace"),
        F.size("events").alias("n_events"), F.element_at("events", 1)["ts"].alias("start_ts"), F.element_at("events", -1)["ts"].alias("end_ts"),
        *o.first, *o.mode,
    )


def unexpected_labels(events: DataFrame, label: str, expected: list[str]) -> DataFrame:
    """Label values outside the expected ones, with their number of events."""
    return (
        events.select(F.trim(F.expr(label)).alias("label")).where(F.col("label").isNotNull() & ~F.col("label").isin(expected))
        .groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    )


def variants(traces: DataFrame) -> DataFrame:
    """(trace, n0, n1): distinct traces with their numbers of cases in either class.

    Constraints depend on the trace alone, so all counting runs on variants, weighted by cases.
    """
    return traces.groupBy("trace").agg(
        F.count_if(F.col("outcome") == 0).alias("n0"), F.count_if(F.col("outcome") == 1).alias("n1")
    )


def split_by_class(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    return traces.where("outcome = 0"), traces.where("outcome = 1")


def age_bracket(column: str) -> Column:
    age = F.expr(f"try_cast({column} as double)")
    return (
        F.when(age.isNull() | F.isnan(age), "UNKNOWN").when(age < 40, "<40").when(age < 60, "40-59").when(age < 75, "60-74").otherwise("75+")
    )


def subgroups(traces: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """(subgroup, n_cases, case_ids): cases by prefixed attribute values; a case is in one for each attribute."""
    label = [
        F.when(F.col(a).isNotNull(), F.concat(F.lit(f"{p}_"), F.replace(F.col(a).cast("string"), F.lit(" "), F.lit("_"))))
        for a, p in attributes.items()
    ]
    return (
        traces.select("case_id", F.explode(F.array_compact(F.array(*label))).alias("subgroup"))
        .groupBy("subgroup").agg(F.count(F.lit(1)).alias("n_cases"), F.array_sort(F.collect_list("case_id")).alias("case_ids"))
    )
