"""Constraint monitoring over an event stream: cases are sessions, evaluated when they close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import measures


def closed_cases(events: DataFrame, case: str, activity: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(case_id, trace, start_ts, end_ts): a case's events until none comes for ``gap``; events more than
    ``late`` behind are dropped by the watermark, earlier ones are put in order."""
    rows = events.select(F.col(case).cast("string").alias("case"), F.col(activity).alias("act"), F.col(ts).cast("timestamp").alias("ts")).where("case is not null and act is not null")
    grouped = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "case").agg(F.array_sort(F.collect_list(F.struct("ts", "act"))).alias("e"))
    return grouped.select(
        F.concat_ws("|", "case", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSS")).alias("case_id"), F.transform("e", lambda x: x["act"]).alias("trace"),
        F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"),
    )


def verdicts(closed: DataFrame, cands: DataFrame) -> DataFrame:
    """Three-valued verdicts of every closed case, for a batch or a stream (joins with static candidates only)."""
    return measures.holds(closed, cands, ["case_id"])


def batch_sink(folder: str):
    """A sink that writes each micro-batch into its own partition, so that one which is run again doubles nothing."""

    def write(df: DataFrame, number: int) -> None:
        rows = df.withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return write


def monitor(events: DataFrame, cands: DataFrame, sink, checkpoint: str, case: str, activity: str, ts: str, **windows):
    """Start a query that hands every micro-batch's verdicts to ``sink(df, batch id)``."""
    closed = closed_cases(events, case, activity, ts, **windows)
    return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(verdicts(df, cands), i)).start()


def available_now(events: DataFrame, cands: DataFrame, sink, checkpoint: str, case: str, activity: str, ts: str, **windows) -> None:
    """Process what is there and stop; state and progress stay in the checkpoint for the next run."""
    closed = closed_cases(events, case, activity, ts, **windows)
    q = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: sink(verdicts(df, cands), i)).start()
    q.awaitTermination()
