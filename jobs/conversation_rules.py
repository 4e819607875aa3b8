"""Which ordering rules tell conversations with a system prompt from those without?

    python -m jobs.conversation_rules --conversations PATH --out PATH [--config FILE]

A conversation is a case, a message an event: its activity is its role with its length class (``user:short``).  A message
of the role ``signal`` marks its conversation as positive and is taken out of it.  The job writes, under ``out``:

* ``cases``: the labelled traces, by ``outcome``;
* ``rules``: every candidate rule with its prevalence in both classes, the p-value of a label permutation test and the
  verdict of a false discovery step-up, by template ``family``;
* ``positive.decl``, ``negative.decl``: the rules that hold in either class with at least ``least_confidence``.

All of it is overwritten by the next run, and draws are by hash, so a rerun of the same input gives the same rows, also
after a run that was cut off.  Rows without a conversation id are dropped; a null role or text counts as empty; a null
turn sorts first; messages of one turn are ordered by role and activity; an empty table gives empty outputs.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.functions import templates as tp
from tracegauge.operators import measures, significance, tests_of_difference
from tracegauge.operators.statistics import alphabet
from tracegauge.plans.logs import CHECKS, ENABLED_SQL
from tracegauge.shared import shared_folder
from tracegauge.sources import event_log, files

log = logging.getLogger("jobs.conversation_rules")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "conversation_rules.json")
KEYS = ["ctype", "a", "b"]
WORD = r"[^\x20\x09-\x0D]+"


def read_config(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def cases(conversations: DataFrame, config: dict) -> DataFrame:
    """(case_id, outcome, trace, n_events, start_ts, end_ts): start and end are turns."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    activity = F.when(role == config["signal"], role).otherwise(F.concat(role, F.when(words < config["long_words"], ":short").otherwise(":long")))
    events = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), activity.alias("activity"))
    return event_log.traces(events, event_log.LogOptions("conv_id", "activity", "turn", ("role",), signal=config["signal"]))


def rules(traces: DataFrame, config: dict) -> DataFrame:
    """Every candidate rule that applies somewhere, tested, with its family."""
    cands = measures.candidates(alphabet(traces))
    seen = measures.class_prevalence(event_log.variants(traces), cands, tp.ENABLED)
    null = tests_of_difference.label_permutation(traces, cands, config["permutations"], config["seed"]).select(*KEYS, F.col("p_two").alias("p"))
    both = seen.alias("s").join(null.alias("n"), (F.col("s.ctype") == F.col("n.ctype")) & (F.col("s.a") == F.col("n.a")) & F.col("s.b").eqNullSafe(F.col("n.b")))
    digits = lambda c: F.round(c, 9).alias(c)
    tested = both.select("s.*", "n.p").select(*KEYS, "n_app0", "n_sat0", "n_app1", "n_sat1", *[digits(c) for c in ("prev0", "prev1", "delta", "p")])
    ranked = significance.step_up(tested, "p", KEYS, config["alpha"]).drop("threshold")
    side = F.when(F.col("delta") > 0, "positive").when(F.col("delta") < 0, "negative").otherwise("neither")
    return ranked.withColumn("side", side).withColumn("family", tp.family())


def run(spark: SparkSession, conversations: str, out: str, config: dict | None = None) -> DataFrame:
    """Runs the job from path to path and returns the rules read back."""
    config = config or read_config()
    source = spark.read.parquet(conversations)
    log.info("read %s: %d messages", conversations, source.count())
    cases(source, config).write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/cases")
    # a schema is given, as a folder without rows has none
    traces = spark.read.schema("case_id string, trace array<string>, n_events int, start_ts long, end_ts long, outcome int").parquet(f"{out}/cases")
    counts = traces.agg(F.count(F.lit(1)), F.count_if(F.col("outcome") == 1)).first()
    log.info("wrote %s/cases: %d conversations, %d of them positive", out, *counts)
    found = rules(traces, config)
    found.write.mode("overwrite").partitionBy("family").parquet(f"{out}/rules")
    written = spark.read.schema(found.schema).parquet(f"{out}/rules")
    total, rejected = written.agg(F.count(F.lit(1)), F.count_if("reject")).first()
    log.info("wrote %s/rules: %d rules, %d of them significant", out, total, rejected)
    for side, k in (("positive", 1), ("negative", 0)):
        held = written.where((F.col(f"n_app{k}") > 0) & (F.col(f"prev{k}") >= config["least_confidence"]))
        files.write_decl(held, f"{out}/{side}.decl", f"rules of {side} conversations, confidence {config['least_confidence']} or more")
        log.info("wrote %s/%s.decl: %d rules", out, side, held.count())
    return written


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "job1")
    run(spark, f"{sf_dir}/conversations.parquet", out)
    return run(spark, f"{sf_dir}/conversations.parquet", out)


SQL = rf"""with ev as (select conv_id::varchar as case_id, turn, coalesce(role, '') as role, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as words from conversations where conv_id is not null),
ac as (select *, case when role = 'system' then role else role || if(words < 30, ':short', ':long') end as act from ev),
g as (select case_id, max((act = 'system')::int) as outcome, list(act order by turn nulls first, role, act) filter (where act <> 'system') as t from ac group by 1),
tr as (select case_id, outcome, t from g where t is not null and len(t) > 0), {CHECKS},
r as (select rep, case_id, row_number() over (partition by rep order by md5('42|' || rep || '|' || case_id), case_id) as k, sum(outcome) over (partition by rep) as n1 from tr, range(200) as g(rep)),
l as (select rep, case_id, (k <= n1)::int as y from r),
d as (select rep, ctype, a, b, round(coalesce(sum(sat::int * y) / nullif(sum(app::int * y), 0)::double, 0) - coalesce(sum(sat::int * (1 - y)) / nullif(sum(app::int * (1 - y)), 0)::double, 0), 12) as d
  from chk join l using (case_id) where ctype in {ENABLED_SQL} group by 1, 2, 3, 4),
q as (select ctype, a, b, coalesce(sum(app::int) filter (where outcome = 0), 0)::bigint as n_app0, coalesce(sum(sat::int) filter (where outcome = 0), 0)::bigint as n_sat0,
  coalesce(sum(app::int) filter (where outcome = 1), 0)::bigint as n_app1, coalesce(sum(sat::int) filter (where outcome = 1), 0)::bigint as n_sat1 from chk where ctype in {ENABLED_SQL} group by 1, 2, 3),
s as (select *, if(n_app0 > 0, n_sat0 / n_app0::double, 0) as p0, if(n_app1 > 0, n_sat1 / n_app1::double, 0) as p1 from q where n_app0 + n_app1 > 0),
t as (select s.*, (1 + (select count(*) from d where d.ctype = s.ctype and d.a = s.a and d.b is not distinct from s.b and abs(d.d) >= abs(round(p1 - p0, 12)))) / 201.0::double as p_raw from s),
o as (select *, row_number() over (order by round(p_raw, 9), ctype, a, b nulls first) as rank, count(*) over () as m, round(p_raw, 9) as p from t),
x as (select max(rank) filter (where p <= rank * 0.05::double / m) as last from o)
select ctype, a, b, n_app0, n_sat0, n_app1, n_sat1, round(p0, 9) as prev0, round(p1, 9) as prev1, round(p1 - p0, 9) as delta, p, rank::int as rank, coalesce(rank <= last, false) as reject,
  case when round(p1 - p0, 9) > 0 then 'positive' when round(p1 - p0, 9) < 0 then 'negative' else 'neither' end as side,
  case when ctype like 'Not%' then 'Negative' when ctype in ('Init','End') then 'Unary' when ctype like '%Succession' then 'Succession' else 'Response' end as family
from o, x"""


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m jobs.conversation_rules", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--conversations", required=True, help="Parquet table of conv_id, turn, role, text")
    p.add_argument("--out", required=True, help="folder of the outputs")
    p.add_argument("--config", default=CONFIG, help="JSON file of the job's settings")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("conversation_rules").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.conversations, a.out, read_config(a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
