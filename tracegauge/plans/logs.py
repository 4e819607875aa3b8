"""Logs over the provided tables, for Spark and as SQL text (a CTE chain that ends in ``tr``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from ..sources.event_log import LogOptions, traces


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(log: DataFrame) -> DataFrame:
    """A log's traces written once: a job that uses them several times would build them as often from the events."""
    folder = shared_folder(log.sparkSession, "traces")
    log.select("case_id", "outcome", "trace").write.parquet(folder)
    return log.sparkSession.read.schema("case_id string, outcome int, trace array<string>").parquet(folder)


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is a user's day; it is positive if it has an error, which is then taken out."""
    ev = read(spark, sf_dir, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("case_id"), F.col("event_type").alias("activity"), F.col("ts").alias("timestamp"), "event_id",
    )
    return traces(ev, LogOptions(ties=("event_id",), signal="error"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is a customer, an activity an order's priority; customers of one market segment are positive."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    ev = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey").join(c, "o_custkey")
    return traces(ev, LogOptions("o_custkey", "o_orderpriority", "o_orderdate", ("o_orderkey",), label="c_mktsegment", positive=("BUILDING",)))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is an order, an activity a line's return flag and status; urgent orders are positive."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    ev = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("activity"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
    ).join(o, "l_orderkey")
    return traces(ev, LogOptions("l_orderkey", "activity", "l_shipdate", ("l_linenumber", "l_partkey", "l_suppkey"), label="o_orderpriority", positive=("1-URGENT", "2-HIGH")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is a user; users whose mean value is above the overall mean are positive."""
    ev = read(spark, sf_dir, "events")
    mean = ev.agg(F.avg("value").alias("m"))
    high = ev.groupBy("user_id").agg(F.avg("value").alias("v")).crossJoin(F.broadcast(mean)).select("user_id", F.when(F.col("v") > F.col("m"), "high").otherwise("low").alias("level"))
    return traces(ev.select("user_id", "event_type", "ts", "event_id").join(high, "user_id"), LogOptions("user_id", "event_type", "ts", ("event_id",), label="level", positive=("high",)))


USER_DAYS = """
ev as (select user_id || '|' || strftime(ts, '%Y-%m-%d') as case_id, event_type as act, ts, event_id from events),
g as (select case_id, max((act = 'error')::int) as outcome, list(act order by ts, event_id) filter (where act <> 'error') as t from ev group by 1),
tr as (select case_id, outcome, t from g where t is not null and len(t) > 0)"""
CUSTOMER_ORDERS = """
tr as (select o_custkey::varchar as case_id, max((c_mktsegment = 'BUILDING')::int) as outcome,
  list(o_orderpriority order by o_orderdate, o_orderkey) as t from orders join customer on o_custkey = c_custkey group by 1)"""
ORDER_LINES = """
tr as (select l_orderkey::varchar as case_id, max((o_orderpriority in ('1-URGENT', '2-HIGH'))::int) as outcome,
  list(l_returnflag || l_linestatus order by l_shipdate, l_linenumber, l_partkey, l_suppkey) as t
  from lineitem join orders on l_orderkey = o_orderkey group by 1)"""
USERS = """
u as (select user_id, avg(value) > (select avg(value) from events) as high from events group by 1),
tr as (select e.user_id::varchar as case_id, max(high::int) as outcome, list(event_type order by ts, event_id) as t
  from events e join u on e.user_id = u.user_id group by 1)"""

#: Every template on every case and ordered pair of activities, by positions; ends in ``chk``.
CHECKS = """
al as (select distinct unnest(t) as act from tr),
pos as (select case_id, outcome, t, x.act as a, y.act as b,
    [i for i in range(1, len(t) + 1) if t[i] = x.act] as px, [i for i in range(1, len(t) + 1) if t[i] = y.act] as py
  from tr, al x, al y where x.act <> y.act),
st as (select *, len(px) as cx, len(py) as cy, px[1] as fx, px[-1] as lx, py[1] as fy, py[-1] as ly,
    len([p for p in px if t[p + 1] = b]) as nb,
    len([i for i in range(1, len(px)) if len([q for q in py if q > px[i] and q < px[i + 1]]) > 0]) as gx,
    len([i for i in range(1, len(py)) if len([q for q in px if q > py[i] and q < py[i + 1]]) > 0]) as gy,
    coalesce(len([p for p in px if p < py[-1]]), 0) as xb, coalesce(len([q for q in py if q > px[1]]), 0) as ya
  from pos),
chk as (select case_id, outcome, a, b, r.ctype, coalesce(r.app, false) as app, coalesce(r.app and r.sat, false) as sat, r.act, r.ful from (
  select *, unnest([
    {'ctype': 'Response', 'app': cx > 0, 'sat': cy > 0 and ly > lx, 'act': cx, 'ful': xb},
    {'ctype': 'AlternateResponse', 'app': cx > 0, 'sat': gx = greatest(cx - 1, 0), 'act': greatest(cx - 1, 0), 'ful': gx},
    {'ctype': 'ChainResponse', 'app': cx > 0, 'sat': nb = cx, 'act': cx, 'ful': nb},
    {'ctype': 'Precedence', 'app': cy > 0, 'sat': cx > 0 and fx < fy, 'act': cy, 'ful': ya},
    {'ctype': 'AlternatePrecedence', 'app': cy > 0, 'sat': gy = greatest(cy - 1, 0), 'act': greatest(cy - 1, 0), 'ful': gy},
    {'ctype': 'ChainPrecedence', 'app': cy > 0, 'sat': nb = cy, 'act': cy, 'ful': nb},
    {'ctype': 'NotResponse', 'app': cx > 0 and cy > 0, 'sat': ly < fx, 'act': if(cy > 0, cx, 0), 'ful': if(cy > 0, cx - xb, 0)},
    {'ctype': 'NotChainResponse', 'app': cx > 0 and cy > 0, 'sat': nb = 0, 'act': cx, 'ful': cx - nb},
    {'ctype': 'NotPrecedence', 'app': cy > 0, 'sat': cx = 0 or fx > ly, 'act': cy, 'ful': cy - ya},
    {'ctype': 'NotChainPrecedence', 'app': cx > 0 and cy > 0, 'sat': nb = 0, 'act': cy, 'ful': cy - nb},
    {'ctype': 'Succession', 'app': cx > 0 and cy > 0, 'sat': ly > lx and fx < fy, 'act': cx + cy, 'ful': xb + ya},
    {'ctype': 'AlternateSuccession', 'app': cx > 0 and cy > 0, 'sat': gx = cx - 1 and gy = cy - 1, 'act': greatest(cx - 1, 0) + greatest(cy - 1, 0), 'ful': gx + gy},
    {'ctype': 'ChainSuccession', 'app': cx > 0 and cy > 0, 'sat': nb = cx and nb = cy, 'act': cx + cy, 'ful': 2 * nb},
    {'ctype': 'NotSuccession', 'app': cx > 0 and cy > 0, 'sat': ly < fx, 'act': cx + cy, 'ful': (cx - xb) + (cy - ya)},
    {'ctype': 'NotChainSuccession', 'app': cx > 0 and cy > 0, 'sat': nb = 0, 'act': if(cx > 0 and cy > 0, cx + cy, 0), 'ful': if(cx > 0 and cy > 0, cx + cy - 2 * nb, 0)},
    {'ctype': 'RespondedExistence', 'app': null, 'sat': null, 'act': cx, 'ful': if(cy > 0, cx, 0)},
    {'ctype': 'NotRespondedExistence', 'app': null, 'sat': null, 'act': cx, 'ful': if(cy = 0, cx, 0)}
  ]) as r from st)
  union all
  select case_id, outcome, act, null, 'Init', true, t[1] = act, 1, (t[1] = act)::int from tr, al
  union all
  select case_id, outcome, act, null, 'End', true, t[-1] = act, 1, (t[-1] = act)::int from tr, al)"""

ENABLED_SQL = "('Init','End','Response','AlternateResponse','ChainResponse','NotResponse','Succession','AlternateSuccession','ChainSuccession','NotChainSuccession')"
