"""How do each day's user sessions conform to the ordering rules?  Incremental: a run takes only new event files.

    python -m jobs.session_conformance --events FOLDER --out PATH --checkpoint PATH [--config FILE]

A file stream over the events folder closes a user's session when none of the user's events came for ``gap``, and drops
events that are more than ``late`` behind.  A run takes the files that came since the last one, and stops; open sessions
and the watermark stay in the checkpoint.  The job writes, under ``out``:

* ``sessions``: the traces of closed sessions, by the ``day`` of their start and the micro-batch that closed them;
* ``daily``: for every day, how many sessions each rule applies to and how many satisfy it, by ``day``.

Both are written with dynamic partition overwrite: a micro-batch that is run again after a failure overwrites the same
partitions, and a day's counts are made anew, from that day's sessions alone, whenever sessions of it close.  So a rerun,
a run without new files and a run after a crash all leave the same rows.  Events without a user, an activity or a
time are dropped.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.operators import measures
from tracegauge.plans.logs import CHECKS, ENABLED_SQL
from tracegauge.shared import shared_folder
from tracegauge.streaming import monitor

log = logging.getLogger("jobs.session_conformance")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "session_conformance.json")
EVENTS = "user_id long, event_type string, ts timestamp_ntz"
SESSIONS = "case_id string, trace array<string>, start_ts timestamp, end_ts timestamp, day date, batch long"
DAILY = "ctype string, a string, b string, applicable long, satisfied long, day date"


def read_config(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def daily_counts(sessions: DataFrame, cands: DataFrame) -> DataFrame:
    """(ctype, a, b, applicable, satisfied, day) over distinct traces of a day, weighted by their sessions."""
    weighted = sessions.groupBy("day", "trace").agg(F.count(F.lit(1)).alias("n"))
    held = measures.holds(weighted, cands, ["day", "n"])
    return held.groupBy("ctype", "a", "b", "day").agg(F.sum("n").alias("applicable"), F.sum(F.col("n") * F.col("sat")).alias("satisfied"))


def _overwrite(df: DataFrame, folder: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes what is new under ``events`` and returns the daily counts as they then stand."""
    config = config or read_config()
    cands = measures.candidates(spark.createDataFrame([(a,) for a in config["activities"]], "act string"))
    log.info("reading new files of %s; progress in %s", events, checkpoint)

    def close(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        _overwrite(batch.withColumn("day", F.to_date("start_ts")).withColumn("batch", F.lit(number).cast("long")), f"{out}/sessions", "day", "batch")
        # a run that failed after this line finds its sessions here again, under the same batch
        stored = session.read.schema(SESSIONS).parquet(f"{out}/sessions")
        days = [r["day"] for r in stored.where(F.col("batch") == number).select("day").distinct().collect()]  # calendar days of one batch
        if days:
            _overwrite(daily_counts(stored.where(F.col("day").isin(days)), cands), f"{out}/daily", "day")
        log.info("batch %d: wrote sessions of %d days to %s/sessions, their counts to %s/daily", number, len(days), out, out)

    live = spark.readStream.schema(EVENTS).parquet(events)
    closed = monitor.closed_cases(live, "user_id", "event_type", "ts", gap=config["gap"], late=config["late"])
    stream = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(close).start()
    stream.awaitTermination()
    read = sum(p["numInputRows"] for p in stream.recentProgress)
    log.info("read %d new events", read)
    return spark.read.schema(DAILY).parquet(f"{out}/daily")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job2")
    for _ in range(2):
        daily = run(spark, f"{sf_dir}/events.parquet*", f"{folder}/out", f"{folder}/progress")
    return daily.select("day", "ctype", "a", "b", "applicable", "satisfied")


#: Sessions by gaps; closed are those that end before the watermark (whole milliseconds of the latest event, less 1 hour).
SQL = f"""with e as (select user_id::varchar as u, event_type as act, ts from events where user_id is not null and event_type is not null and ts is not null),
b as (select *, case when ts <= lag(ts) over (partition by u order by ts, act) + interval 12 hours then 0 else 1 end as opens from e),
n as (select *, sum(opens) over (partition by u order by ts, act rows unbounded preceding) as session from b),
s as (select u, session, min(ts) as start_ts, max(ts) + interval 12 hours as end_ts, list(act order by ts, act) as t from n group by 1, 2),
tr as (select u || '|' || session as case_id, 0 as outcome, start_ts, t from s where end_ts <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from e)), {CHECKS}
select start_ts::date as day, ctype, a, b, count(*)::bigint as applicable, sum(sat::int)::bigint as satisfied from chk join (select case_id, start_ts from tr) using (case_id)
where app and ctype in {ENABLED_SQL} group by 1, 2, 3, 4"""


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m jobs.session_conformance", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--events", required=True, help="folder of Parquet files of user_id, event_type, ts")
    p.add_argument("--out", required=True, help="folder of the outputs")
    p.add_argument("--checkpoint", required=True, help="folder of the stream's progress")
    p.add_argument("--config", default=CONFIG, help="JSON file of the job's settings")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("session_conformance").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.events, a.out, a.checkpoint, read_config(a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
