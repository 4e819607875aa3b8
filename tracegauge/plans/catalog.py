"""Registered event-log queries: a name, the Spark plan, and the same as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogues, templates as tp
from ..operators import comparison, measures, mining, pruning, resampling, rules, significance, tests_of_difference
from ..operators.statistics import act_stats, alphabet, opposite_direction, pair_stats
from ..shared import shared_folder
from ..sources import event_log, files
from . import logs
from .logs import CHECKS, CUSTOMER_ORDERS, ENABLED_SQL, ORDER_LINES, USER_DAYS, USERS

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prevalence_user_days(spark, sf_dir)


def _cands(traces: DataFrame, binary=tp.ENABLED, minimum: int = 1) -> DataFrame:
    # any activity that occurs has an event: places needn't be counted
    acts = traces.select(F.explode("trace").alias("act")).where(F.col("act").isNotNull()).distinct() if minimum <= 1 else alphabet(traces, minimum)
    return measures.candidates(acts, binary)


def _r(c: str | object, digits: int = 9):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---- logs and their statistics -------------------------------------------------------------------------


def _trace_query(make):
    def run(spark, sf_dir):
        return make(spark, sf_dir).select("case_id", "outcome", F.array_join("trace", ">").alias("trace"), F.col("n_events").cast("long").alias("n_events"))

    return run


for _name, _make, _cte in (
    ("traces_user_days", logs.user_days, USER_DAYS), ("traces_customer_orders", logs.customer_orders, CUSTOMER_ORDERS),
    ("traces_order_lines", logs.order_lines, ORDER_LINES), ("traces_users", logs.users, USERS),
):
    _QUERIES[_name] = _trace_query(_make)
    _SQL[_name] = f"with {_cte} select case_id, outcome, array_to_string(t, '>') as trace, len(t)::bigint as n_events from tr"


@query(f"with {CUSTOMER_ORDERS} select array_to_string(t, '>') as trace, count_if(outcome = 0)::bigint as n0, count_if(outcome = 1)::bigint as n1 from tr group by 1")
def variants_customer_orders(spark, sf_dir):
    v = event_log.variants(logs.customer_orders(spark, sf_dir))
    return v.select(F.array_join("trace", ">").alias("trace"), "n0", "n1")


@query(f"with {USERS} select act, count(*)::bigint as n_events, count(distinct case_id)::bigint as n_cases from (select case_id, unnest(t) as act from tr) group by 1")
def alphabet_users(spark, sf_dir):
    return alphabet(logs.users(spark, sf_dir)).select("act", F.col("n_events").cast("long").alias("n_events"), "n_cases")


@query(f"""with {USERS}, p as (select case_id, act, i from (select case_id, unnest(t) as act, unnest(range(len(t))) as i from tr))
select case_id, act, count(*)::bigint as cnt, min(i)::bigint as first_pos, max(i)::bigint as last_pos from p group by 1, 2""")
def activity_statistics(spark, sf_dir):
    s = act_stats(logs.users(spark, sf_dir), ["case_id"])
    return s.select("case_id", "act", *[F.col(c).cast("long").alias(c) for c in ("cnt", "first_pos", "last_pos")])


@query(f"""with {USERS}, {CHECKS} select case_id, a as x, b as y, cx::bigint as cx, cy::bigint as cy, (fx - 1)::bigint as fx, (lx - 1)::bigint as lx,
(fy - 1)::bigint as fy, (ly - 1)::bigint as ly, nb::bigint as b, gx::bigint as gx, gy::bigint as gy, xb::bigint as xb, ya::bigint as ya from st where cx > 0 and cy > 0""")
def pair_statistics(spark, sf_dir):
    s = pair_stats(logs.users(spark, sf_dir), ["case_id"])
    return s.select("case_id", "x", "y", *[F.col(c).cast("long").alias(c) for c in tp.STATS])


@query("""select p_name as name, p_type as other, false as opposite from part where false
union all select 'VALVE INCREASE A', 'VALVE DECREASE A', true union all select 'ENABLE X', 'DISABLE X', true
union all select 'INCREASE A', 'DECREASE B', false union all select 'OPEN A', 'CLOSE A', false union all select 'increase_a', 'decrease_a', true""")
def opposite_direction_pairs(spark, sf_dir):
    rows = [("VALVE INCREASE A", "VALVE DECREASE A"), ("ENABLE X", "DISABLE X"), ("INCREASE A", "DECREASE B"), ("OPEN A", "CLOSE A"), ("increase_a", "decrease_a")]
    return spark.createDataFrame(rows, "name string, other string").withColumn("opposite", opposite_direction("name", "other"))


@query("""select bracket, count(*)::bigint as n from (select case when c_acctbal is null then 'UNKNOWN' when c_acctbal / 100 < 40 then '<40'
when c_acctbal / 100 < 60 then '40-59' when c_acctbal / 100 < 75 then '60-74' else '75+' end as bracket from customer) group by 1""")
def age_brackets(spark, sf_dir):
    c = logs.read(spark, sf_dir, "customer").select((F.col("c_acctbal") / 100).alias("age"))
    return c.groupBy(event_log.age_bracket("age").alias("bracket")).agg(F.count(F.lit(1)).alias("n"))


@query("""select 'Segment_' || replace(c_mktsegment, ' ', '_') as subgroup, count(*)::bigint as n_cases, array_to_string(list(c_custkey::varchar order by c_custkey::varchar), ',') as cases from customer group by 1""")
def subgroup_cases(spark, sf_dir):
    c = logs.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), "c_mktsegment")
    s = event_log.subgroups(c, {"c_mktsegment": "Segment"})
    return s.select("subgroup", "n_cases", F.array_join("case_ids", ",").alias("cases"))


@query("select trim(o_orderpriority) as label, count(*)::bigint as n from orders where trim(o_orderpriority) not in ('1-URGENT', '2-HIGH', '5-LOW') group by 1")
def unexpected_labels(spark, sf_dir):
    return event_log.unexpected_labels(logs.read(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("""with a as (select distinct event_type as act from events),
c as (select t as ctype, act as a, null as b from a, (select unnest(['Init','End']) as t)
union all select t, x.act, y.act from a x, a y, (select unnest(['Response','AlternateResponse','ChainResponse','NotResponse','Succession','AlternateSuccession','ChainSuccession','NotChainSuccession']) as t) where x.act <> y.act)
select ctype, a, b from c""")
def candidate_constraints(spark, sf_dir):
    return _cands(logs.users(spark, sf_dir))


@query(f"""with {USERS}, {CHECKS} select case when ctype like 'Not%' then 'Negative' when ctype in ('Init','End') then 'Unary' when ctype like '%Succession' then 'Succession'
when ctype like '%Precedence' then 'Precedence' else 'Response' end as family, count(*)::bigint as n from (select distinct ctype, a, b from chk) group by 1""")
def template_families(spark, sf_dir):
    c = _cands(logs.users(spark, sf_dir), tp.BINARY)
    return c.groupBy(tp.family().alias("family")).agg(F.count(F.lit(1)).alias("n"))


# ---- measures and holds --------------------------------------------------------------------------------

_PREVALENCE = """select ctype, a, b, sum(app::int) filter (where outcome = 0)::bigint as n_app0, sum(sat::int) filter (where outcome = 0)::bigint as n_sat0,
sum(app::int) filter (where outcome = 1)::bigint as n_app1, sum(sat::int) filter (where outcome = 1)::bigint as n_sat1 from chk"""


def _prevalence_sql(cte: str, where: str) -> str:
    return f"""with {cte}, {CHECKS}, q as ({_PREVALENCE} where {where} group by 1, 2, 3),
s as (select *, if(n_app0 > 0, n_sat0 / n_app0::double, 0) as p0, if(n_app1 > 0, n_sat1 / n_app1::double, 0) as p1 from q)
select ctype, a, b, n_app0, n_sat0, n_app1, n_sat1, round(p0, 9) as prev0, round(p1, 9) as prev1, round(p1 - p0, 9) as delta from s"""


def _prevalence(traces: DataFrame, binary) -> DataFrame:
    p = measures.class_prevalence(event_log.variants(traces), _cands(traces, binary), binary)
    return p.select("ctype", "a", "b", "n_app0", "n_sat0", "n_app1", "n_sat1", _r("prev0").alias("prev0"), _r("prev1").alias("prev1"), _r("delta").alias("delta"))


@query(_prevalence_sql(USER_DAYS, f"ctype in {ENABLED_SQL}"))
def prevalence_user_days(spark, sf_dir):
    return _prevalence(logs.user_days(spark, sf_dir), tp.ENABLED)


@query(_prevalence_sql(CUSTOMER_ORDERS, "app is not null and ctype not in ('RespondedExistence','NotRespondedExistence')"))
def prevalence_customer_orders(spark, sf_dir):
    return _prevalence(logs.customer_orders(spark, sf_dir), tp.TRACE_BINARY)


@query(_prevalence_sql(ORDER_LINES, f"ctype in {ENABLED_SQL}"))
def prevalence_order_lines(spark, sf_dir):
    return _prevalence(logs.order_lines(spark, sf_dir), tp.ENABLED)


@query(_prevalence_sql(USERS, "ctype not in ('RespondedExistence','NotRespondedExistence')"))
def prevalence_users(spark, sf_dir):
    return _prevalence(logs.users(spark, sf_dir), tp.TRACE_BINARY)


def _measures_sql(cte: str, outcome: int) -> str:
    return f"""with {cte}, {CHECKS}, n as (select count(*)::bigint as nt, sum(len(t))::bigint as ne from tr where outcome = {outcome}),
q as (select ctype, a, b, sum(act)::bigint as n_act, sum(ful)::bigint as n_ful, count_if(act > 0)::bigint as t_act, count_if(act > 0 and ful = act)::bigint as t_sat
from chk where outcome = {outcome} group by 1, 2, 3)
select ctype, a, b, round(n_ful / greatest(1, n_act)::double, 9) as econf, round(n_act / ne::double, 9) as ecov, round(n_ful / ne::double, 9) as esupp,
round(t_sat / greatest(1, t_act)::double, 9) as tconf, round(t_act / nt::double, 9) as tcov, round(t_sat / nt::double, 9) as tsupp,
n_act, n_ful, t_act, t_sat, ne as n_events, nt as n_traces from q, n"""


def _measured(traces: DataFrame, weight: str, binary=tp.BINARY) -> DataFrame:
    return measures.measures(event_log.variants(traces), _cands(traces, binary), weight, binary)


def _measured_rounded(traces: DataFrame, weight: str) -> DataFrame:
    return _measured(traces, weight).select(
        "ctype", "a", "b", *[_r(c).alias(c) for c in ("econf", "ecov", "esupp", "tconf", "tcov", "tsupp")], "n_act", "n_ful", "t_act", "t_sat", "n_events", "n_traces")


@query(_measures_sql(CUSTOMER_ORDERS, 1))
def measures_customer_orders_positive(spark, sf_dir):
    return _measured_rounded(logs.customer_orders(spark, sf_dir), "n1")


@query(_measures_sql(USERS, 0))
def measures_users_negative(spark, sf_dir):
    return _measured_rounded(logs.users(spark, sf_dir), "n0")


@query(f"with {USERS}, {CHECKS} select case_id, ctype, a, b, sat::int as sat from chk where app and ctype in {ENABLED_SQL}")
def holds_users(spark, sf_dir):
    t = logs.users(spark, sf_dir)
    return measures.holds(t, _cands(t), ["case_id"])


@query(f"""with {USER_DAYS}, {CHECKS}, q as ({_PREVALENCE} where ctype in {ENABLED_SQL} group by 1, 2, 3),
n as (select count_if(outcome = 0) as a0, count_if(outcome = 1) as a1 from tr)
select ctype, a, b, round(n_sat0 / a0::double, 9) as supp0, round(n_sat1 / a1::double, 9) as supp1,
round(if(n_app0 > 0, n_sat0 / n_app0::double, 0), 9) as conf0, round(if(n_app1 > 0, n_sat1 / n_app1::double, 0), 9) as conf1 from q, n""")
def support_confidence(spark, sf_dir):
    t = logs.user_days(spark, sf_dir)
    s = measures.support_confidence(event_log.variants(t), _cands(t), tp.ENABLED)
    return s.select("ctype", "a", "b", *[_r(c).alias(c) for c in ("supp0", "supp1", "conf0", "conf1")])


@query(f"""with {USER_DAYS}, {CHECKS} select ctype, a, b, count_if(outcome = 1 and sat)::bigint as sat1, count_if(outcome = 1 and app and not sat)::bigint as vio1,
count_if(outcome = 0 and sat)::bigint as sat0, count_if(outcome = 0 and app and not sat)::bigint as vio0 from chk where ctype in {ENABLED_SQL} group by 1, 2, 3""")
def contingency_tables(spark, sf_dir):
    t = logs.user_days(spark, sf_dir)
    p = measures.class_prevalence(event_log.variants(t), _cands(t), tp.ENABLED)
    return p.select("ctype", "a", "b", F.col("n_sat1").alias("sat1"), (F.col("n_app1") - F.col("n_sat1")).alias("vio1"), F.col("n_sat0").alias("sat0"), (F.col("n_app0") - F.col("n_sat0")).alias("vio0"))


@query(f"""with {USER_DAYS}, {CHECKS}, q as ({_PREVALENCE} where ctype in {ENABLED_SQL} group by 1, 2, 3),
m as (select *, n_sat1::double as tp, n_sat0::double as fp, (n_app1 - n_sat1)::double as fn, (n_app0 - n_sat0)::double as tn from q),
s as (select *, tp / (tp + fp + 1e-10) as pr, tp / (tp + fn + 1e-10) as re, tn / (tn + fp + 1e-10) as sp from m)
select ctype, a, b, round(pr, 9) as precision, round(re, 9) as recall, round(2 * pr * re / (pr + re + 1e-10), 9) as f1, round((tp + tn) / (tp + tn + fp + fn + 1e-10), 9) as accuracy,
round((re + sp) / 2, 9) as balanced_accuracy, round(sp, 9) as specificity, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) + 1e-10), 9) as mcc, round((re + sp) / 2, 9) as auroc from s""")
def pattern_classifiers(spark, sf_dir):
    t = logs.user_days(spark, sf_dir)
    p = measures.class_prevalence(event_log.variants(t), _cands(t), tp.ENABLED).select("ctype", "a", "b", *significance.classifier_metrics())
    return p.select("ctype", "a", "b", *[_r(c).alias(c) for c in p.columns[3:]])


@query(_prevalence_sql(USER_DAYS, f"ctype in {ENABLED_SQL}") + " order by abs(p1 - p0) desc, ctype, a, b nulls first limit 20")
def top_differences(spark, sf_dir):
    """A top-k report: the 20 largest prevalence differences."""
    t = logs.user_days(spark, sf_dir)
    p = measures.class_prevalence(event_log.variants(t), _cands(t), tp.ENABLED).orderBy(F.desc(F.abs("delta")), "ctype", "a", F.asc_nulls_first("b")).limit(20)
    return p.select("ctype", "a", "b", "n_app0", "n_sat0", "n_app1", "n_sat1", _r("prev0").alias("prev0"), _r("prev1").alias("prev1"), _r("delta").alias("delta"))


# ---- pruning and set algebra ---------------------------------------------------------------------------


def _spec(spark, sf_dir, weight):
    return _measured(logs.customer_orders(spark, sf_dir), weight, tp.TRACE_BINARY)


def _fold_sql(name: str, steps, rule: str) -> str:
    """A fold over an ordered rule list (i, p, q) within each (a, b), as a recursive CTE; ``rule`` names what goes from
    the two sides' measures x and y, or null."""
    values = ", ".join(f"({i}, '{p}', '{q}')" for i, (p, q) in enumerate(steps, 1))
    return f"""{name}_rules(i, p, q) as (values {values}),
{name}_fold(i, a, b, gone) as (select 0, a, b, []::varchar[] from {name}_in where b is not null group by a, b
  union all select f.i + 1, f.a, f.b, case when x.ctype is null or y.ctype is null or list_contains(f.gone, r.p) or list_contains(f.gone, r.q) then f.gone
    else list_concat(f.gone, [x for x in [{rule}] if x is not null]) end
  from {name}_fold f join {name}_rules r on r.i = f.i + 1 left join {name}_in x on x.a = f.a and x.b = f.b and x.ctype = r.p left join {name}_in y on y.a = f.a and y.b = f.b and y.ctype = r.q),
{name}_out as (select k.* from {name}_in k where k.b is null or not exists (select 1 from {name}_fold f where f.i = {len(steps)} and f.a = k.a and f.b = k.b and list_contains(f.gone, k.ctype)))"""


def _most(p: str, q: str) -> str:
    return "(" + " and ".join(f"{p}.{m} <= {q}.{m}" for m in pruning.ORDER) + ")"


_SUBSUMPTION_RULE = f"if({_most('y', 'x')}, r.q, r.p)"
_EQUIVALENCE_RULE = f"if({_most('y', 'x')}, r.q, r.p)"
_NEGATION_RULE = f"case when {_most('y', 'x')} and not {_most('x', 'y')} then r.q when {_most('x', 'y')} and not {_most('y', 'x')} then r.p end"
#: The positive class's specification with its measures, for SQL.
_SPEC = f"""with recursive {CUSTOMER_ORDERS}, {CHECKS}, n as (select count(*)::bigint as nt, sum(len(t))::bigint as ne from tr where outcome = 1),
raw as (select ctype, a, b, sum(act)::bigint as n_act, sum(ful)::bigint as n_ful, count_if(act > 0)::bigint as t_act, count_if(act > 0 and ful = act)::bigint as t_sat
  from chk where outcome = 1 and ctype not in ('RespondedExistence','NotRespondedExistence') group by 1, 2, 3),
spec as materialized (select ctype, a, b, n_ful / greatest(1, n_act)::double as econf, n_ful / greatest(1, ne)::double as esupp, t_sat / greatest(1, t_act)::double as tconf, t_sat / greatest(1, nt)::double as tsupp from raw, n)"""


@query(f"{_SPEC}, s_in as (select * from spec), {_fold_sql('s', catalogues.SUBSUMPTION, _SUBSUMPTION_RULE)} select ctype, a, b from s_out")
def prune_subsumption(spark, sf_dir):
    return pruning.subsumption(_spec(spark, sf_dir, "n1")).select("ctype", "a", "b")


@query(f"{_SPEC}, e_in as (select * from spec), {_fold_sql('e', catalogues.EQUIVALENCE, _EQUIVALENCE_RULE)} select ctype, a, b from e_out")
def prune_equivalence(spark, sf_dir):
    return pruning.equivalence(_spec(spark, sf_dir, "n1")).select("ctype", "a", "b")


@query(f"{_SPEC}, g_in as (select * from spec), {_fold_sql('g', catalogues.NEGATION, _NEGATION_RULE)} select ctype, a, b from g_out")
def prune_negation(spark, sf_dir):
    return pruning.negation(_spec(spark, sf_dir, "n1")).select("ctype", "a", "b")


_STRONG = f"with {CUSTOMER_ORDERS}, {CHECKS}, k as (select ctype, a, b from chk where outcome = 1 and app is not null and ctype not in ('RespondedExistence','NotRespondedExistence') group by 1, 2, 3 having count_if(act > 0 and ful = act) / greatest(1, count_if(act > 0))::double >= 0.3)"


def _strong(spark, sf_dir):
    return _spec(spark, sf_dir, "n1").where(F.col("tconf") >= 0.3)


@query(_STRONG + """, f as (select *, 'Response' as e from k where ctype in ('Response','AlternateResponse','ChainResponse','Succession','AlternateSuccession','ChainSuccession')
union all select *, 'Precedence' from k where ctype in ('Precedence','AlternatePrecedence','ChainPrecedence','Succession','AlternateSuccession','ChainSuccession')),
gone as (select distinct p.e as ctype, p.a, q.b from f p join f q on p.e = q.e and p.b = q.a and p.a <> q.b)
select ctype, a, b from k where not exists (select 1 from gone g where g.ctype = k.ctype and g.a = k.a and g.b = k.b)""")
def prune_transitivity(spark, sf_dir):
    return pruning.transitivity(_strong(spark, sf_dir)).select("ctype", "a", "b")


#: Fixed values, written out for the SQL alone: (premise, premise, entailed).
_ENTAILED = """('AlternateResponse', 'ChainPrecedence', 'ChainResponse'), ('AlternatePrecedence', 'ChainResponse', 'ChainPrecedence'),
('Response', 'NotResponse', 'AlternateResponse'), ('Response', 'NotResponse', 'ChainResponse'), ('Precedence', 'NotResponse', 'AlternatePrecedence'),
('Precedence', 'NotResponse', 'ChainPrecedence'), ('AlternateResponse', 'NotResponse', 'ChainResponse'), ('AlternatePrecedence', 'NotResponse', 'ChainPrecedence'),
('ChainResponse', 'NotChainResponse', 'NotResponse'), ('Response', 'Precedence', 'Succession'), ('AlternateResponse', 'AlternatePrecedence', 'AlternateSuccession'),
('ChainResponse', 'ChainPrecedence', 'ChainSuccession'), ('NotResponse', 'NotPrecedence', 'NotSuccession'), ('NotChainResponse', 'NotChainPrecedence', 'NotChainSuccession'),
('Succession', 'NotSuccession', 'AlternateSuccession'), ('Succession', 'NotSuccession', 'ChainSuccession'), ('Succession', 'NotResponse', 'AlternateSuccession'),
('Succession', 'NotResponse', 'ChainSuccession'), ('AlternateSuccession', 'NotResponse', 'ChainSuccession'), ('ChainSuccession', 'NotChainSuccession', 'NotSuccession')"""


@query(_STRONG + f""", rel(p, q, e) as (values {_ENTAILED}),
gone as (select distinct r.e as ctype, x.a, x.b from rel r join k x on x.ctype = r.p join k y on y.ctype = r.q and y.a = x.a and y.b = x.b)
select ctype, a, b from k where not exists (select 1 from gone g where g.ctype = k.ctype and g.a = k.a and g.b = k.b)""")
def prune_entailment(spark, sf_dir):
    return pruning.entailment(_strong(spark, sf_dir)).select("ctype", "a", "b")


@query(f"""{_SPEC}, s_in as (select * from spec), {_fold_sql('s', catalogues.SUBSUMPTION, _SUBSUMPTION_RULE)},
e_in as (select * from s_out), {_fold_sql('e', catalogues.EQUIVALENCE, _EQUIVALENCE_RULE)},
g_in as (select * from e_out), {_fold_sql('g', catalogues.NEGATION, _NEGATION_RULE)},
f as (select *, 'Response' as e from g_out where ctype in ('Response','AlternateResponse','ChainResponse','Succession','AlternateSuccession','ChainSuccession')
  union all select *, 'Precedence' from g_out where ctype in ('Precedence','AlternatePrecedence','ChainPrecedence','Succession','AlternateSuccession','ChainSuccession')),
far as (select distinct p.e as ctype, p.a, q.b from f p join f q on p.e = q.e and p.b = q.a and p.a <> q.b),
t as (select * from g_out k where not exists (select 1 from far g where g.ctype = k.ctype and g.a = k.a and g.b = k.b)),
rel(p, q, e) as (values {_ENTAILED}),
gone as (select distinct r.e as ctype, x.a, x.b from rel r join t x on x.ctype = r.p join t y on y.ctype = r.q and y.a = x.a and y.b = x.b)
select ctype, a, b, round(econf, 9) as econf, round(esupp, 9) as esupp, round(tconf, 9) as tconf, round(tsupp, 9) as tsupp from t k
where not exists (select 1 from gone g where g.ctype = k.ctype and g.a = k.a and g.b = k.b)""")
def prune_all(spark, sf_dir):
    return pruning.prune(_spec(spark, sf_dir, "n1")).select("ctype", "a", "b", *[_r(c).alias(c) for c in pruning.ORDER])


@query(_STRONG + """, r as (select distinct 'Response' as family, a, b from k where ctype in ('Response','AlternateResponse','ChainResponse')
union select distinct 'Precedence', a, b from k where ctype in ('Precedence','AlternatePrecedence','ChainPrecedence'))
select x.family, x.a, x.b from r x join r y on x.family = y.family and x.a = y.b and x.b = y.a where x.a < x.b""")
def collapse_warnings(spark, sf_dir):
    return pruning.collapse_warnings(_strong(spark, sf_dir))


@query(_STRONG + """, o as (select row_number() over (order by ctype, a, b) as i, * from k)
select x.ctype, x.a, x.b, count(*)::bigint as n_neighbours from o x join o y on x.i <> y.i and (x.a = y.a or x.b = y.b or x.a = y.b or x.b = y.a) group by 1, 2, 3""")
def constraint_neighbourhoods(spark, sf_dir):
    return pruning.neighbourhood(_strong(spark, sf_dir))


def _two_specs(spark, sf_dir):
    t = logs.stored(logs.customer_orders(spark, sf_dir))
    # both classes in one pass over the variants
    sums = measures.pattern_sums(event_log.variants(t), _cands(t), "event", ["n1", "n0"], tp.ENABLED)
    sums = rules.stored(sums.select("ctype", "a", "b", *[f"{w}_{v}" for w in ("n1", "n0") for v in ("t_sat", "t_act")]), "sums")
    return [sums.where(F.expr(f"{w}_t_sat / double(greatest(1, {w}_t_act)) >= 0.3")).select("ctype", "a", "b") for w in ("n1", "n0")]


_SPECS = f"with {CUSTOMER_ORDERS}, {CHECKS}, k as (select outcome, ctype, a, b from chk where ctype in {ENABLED_SQL} group by 1, 2, 3, 4 having count_if(act > 0 and ful = act) / greatest(1, count_if(act > 0))::double >= 0.3), s as (select ctype, a, b, max((outcome = 1)::int) as x, max((outcome = 0)::int) as y from k group by 1, 2, 3)"


@query(_SPECS + " select case when x = 1 and y = 1 then 'shared' when x = 1 then 'positive_only' else 'negative_only' end as part, count(*)::bigint as n from s group by 1")
def specification_algebra(spark, sf_dir):
    pos, neg = _two_specs(spark, sf_dir)
    s = significance._sides(pos, neg, ["ctype", "a", "b"], [])
    part = F.when((F.col("x") == 1) & (F.col("y") == 1), "shared").when(F.col("x") == 1, "positive_only").otherwise("negative_only")
    return s.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(_SPECS + """ select sum(x)::bigint as n_a, sum(y)::bigint as n_b, sum(x * y)::bigint as shared, (sum(y) - sum(x * y))::bigint as gained, (sum(x) - sum(x * y))::bigint as lost,
round(sum(x * y) / count(*)::double, 9) as jaccard from s""")
def specification_jaccard(spark, sf_dir):
    pos, neg = _two_specs(spark, sf_dir)
    j = significance.jaccard(pos, neg, ["ctype", "a", "b"])
    return j.select(*[F.col(c).cast("long").alias(c) for c in ("n_a", "n_b", "shared", "gained", "lost")], _r("jaccard").alias("jaccard"))


@query(_SPECS + """, c as (select sum(x * y)::double as tp, sum((1 - x) * y)::double as fp, sum(x * (1 - y))::double as fn, sum(x)::double as na, sum(y) as nb, count(*) as u from s)
select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(tp / u, 9) as jaccard, round(fp / nullif(tp + fp, 0), 9) as fdr_ref, round(tp / nullif(tp + fp, 0), 9) as precision, round(tp / nullif(tp + fn, 0), 9) as recall,
round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) as f1, round(fp / nullif(na, 0), 9) as fp_burden, round(fn / nullif(na, 0), 9) as fn_burden, nb >= 10 as reliable from c""")
def specification_agreement(spark, sf_dir):
    pos, neg = _two_specs(spark, sf_dir)
    m = significance.reference_metrics(pos, neg, ["ctype", "a", "b"])
    return m.select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], *[_r(c).alias(c) for c in ("jaccard", "fdr_ref", "precision", "recall", "f1", "fp_burden", "fn_burden")], "reliable")


_FAMILY = "case when ctype like 'Not%' then 'Negative' when ctype in ('Init','End') then 'Unary' when ctype like '%Succession' then 'Succession' when ctype like '%Precedence' then 'Precedence' else 'Response' end"


@query(_SPECS + f""", f as (select {_FAMILY} as family, sum(x)::bigint as n_a, sum(y)::bigint as n_b, sum(x * y)::bigint as shared, count(*) as u from s group by 1)
select family, n_a, n_b, shared, round(shared / u::double, 9) as jaccard from f""")
def family_jaccard(spark, sf_dir):
    """Agreement of both classes' specifications by template family."""
    from .experiments import family_jaccard as by_family

    j = by_family(*_two_specs(spark, sf_dir))
    return j.select("family", *[F.col(c).cast("long").alias(c) for c in ("n_a", "n_b", "shared")], _r("jaccard").alias("jaccard"))


@query(f"""with {USER_DAYS}, {CHECKS}, q as ({_PREVALENCE} where ctype in {ENABLED_SQL} group by 1, 2, 3), n as (select count_if(outcome = 0) as c0, count_if(outcome = 1) as c1 from tr),
v as (select {_FAMILY} as family, coalesce(n_app0, 0) < 0.25::double * c0 or coalesce(n_app1, 0) < 0.25::double * c1 as vacuous from q, n)
select family, count(*)::bigint as n, count_if(vacuous)::bigint as n_vacuous, round(count_if(vacuous) / count(*)::double, 9) as rate from v group by 1""")
def vacuity_rates(spark, sf_dir):
    """Patterns that apply to less than a quarter of a class, by template family."""
    t = logs.user_days(spark, sf_dir)
    n0, n1 = t.agg(F.count_if(F.col("outcome") == 0), F.count_if(F.col("outcome") == 1)).first()
    v = significance.vacuity_rates(measures.class_prevalence(event_log.variants(t), _cands(t), tp.ENABLED), n0, n1, tp.family(), 0.25)
    return v.select("family", "n", "n_vacuous", _r("rate").alias("rate"))


# ---- resampling and perturbation -----------------------------------------------------------------------


@query(f"""with {CUSTOMER_ORDERS}, r as (select rep, case_id, outcome, row_number() over (partition by rep order by md5('42|' || rep || '|' || case_id), case_id) as k, sum(outcome) over (partition by rep) as n1 from tr, range(5) as g(rep))
select rep::int as rep, case_id, (k <= n1)::int as label from r""")
def permuted_labels(spark, sf_dir):
    return resampling.permuted_labels(logs.customer_orders(spark, sf_dir), 5)


@query(f"""with {USERS}, e as (select rep, case_id, outcome, unnest(t) as act, unnest(range(len(t))) as i from tr, range(3) as g(rep))
select rep::int as rep, case_id, outcome, string_agg(act, '>' order by md5('42|' || rep || '|' || case_id || '|' || i), i) as trace from e group by 1, 2, 3""")
def permuted_traces(spark, sf_dir):
    p = resampling.permuted_traces(logs.users(spark, sf_dir), 3)
    return p.select("rep", "case_id", "outcome", F.array_join("trace", ">").alias("trace"))


@query(f"""with {CUSTOMER_ORDERS}, r as (select rep, case_id, outcome, row_number() over (partition by rep order by md5('42|' || rep || '|' || case_id), case_id) as k, sum(outcome) over (partition by rep) as n1 from tr, range(2) as g(rep)),
e as (select rep, case_id, unnest(t) as act, unnest(range(len(t))) as i from tr, range(2) as g(rep)),
p as (select rep, case_id, string_agg(act, '>' order by md5('43|' || rep || '|' || case_id || '|' || i), i) as trace from e group by 1, 2)
select r.rep::int as rep, r.case_id, (k <= n1)::int as outcome, trace from r join p on r.rep = p.rep and r.case_id = p.case_id""")
def double_null_logs(spark, sf_dir):
    d = resampling.double_null(logs.customer_orders(spark, sf_dir), 2)
    return d.select("rep", "case_id", "outcome", F.array_join("trace", ">").alias("trace"))


_LABEL_NULL = f"""with {USER_DAYS}, {CHECKS}, r as (select rep, case_id, row_number() over (partition by rep order by md5('42|' || rep || '|' || case_id), case_id) as k, sum(outcome) over (partition by rep) as n1 from tr, range(20) as g(rep)),
l as (select rep, case_id, (k <= n1)::int as y from r),
d as (select rep, ctype, a, b, round(coalesce(sum(sat::int * y) / nullif(sum(app::int * y), 0)::double, 0) - coalesce(sum(sat::int * (1 - y)) / nullif(sum(app::int * (1 - y)), 0)::double, 0), 12) as d
  from chk join l using (case_id) where ctype in {ENABLED_SQL} group by 1, 2, 3, 4),
o as (select ctype, a, b, round(coalesce(sum(sat::int * outcome) / nullif(sum(app::int * outcome), 0)::double, 0) - coalesce(sum(sat::int * (1 - outcome)) / nullif(sum(app::int * (1 - outcome)), 0)::double, 0), 12) as delta
  from chk where ctype in {ENABLED_SQL} group by 1, 2, 3 having sum(app::int) > 0)"""


@query(_LABEL_NULL + """ select o.ctype, o.a, o.b, round(delta, 9) as delta, count_if(abs(d) >= abs(delta))::bigint as exceed_two, count_if(if(delta >= 0, d >= delta, d <= delta))::bigint as exceed_one,
round((1 + count_if(abs(d) >= abs(delta))) / 21.0::double, 9) as p_two from o join d on o.ctype = d.ctype and o.a = d.a and o.b is not distinct from d.b group by 1, 2, 3, delta""")
def label_permutation_test(spark, sf_dir):
    t = logs.user_days(spark, sf_dir)
    p = tests_of_difference.label_permutation(t, _cands(t), 20)
    return p.select("ctype", "a", "b", _r("delta").alias("delta"), "exceed_two", "exceed_one", _r("p_two").alias("p_two"))


@query(_LABEL_NULL + """, c as (select o.ctype, o.a, o.b, round(abs(delta), 9) as ediff, (1 + count_if(abs(d) >= abs(delta)))::bigint as count_c
from o join d on o.ctype = d.ctype and o.a = d.a and o.b is not distinct from d.b group by 1, 2, 3, delta)
select ctype, a, b, ediff, count_c, round(count_c / 20.0::double, 9) as p, round(count_c / 21.0::double, 9) as p_plus, count_c / 20.0 <= 0.05 as significant from c""")
def unsigned_difference_test(spark, sf_dir):
    t = logs.user_days(spark, sf_dir)
    p = tests_of_difference.difference_test(t, _cands(t), 20)
    return p.select("ctype", "a", "b", _r("ediff").alias("ediff"), "count_c", _r("p").alias("p"), _r("p_plus").alias("p_plus"), "significant")


#: (applicable, satisfied) of the enabled binary templates over a pair's statistics, written out for the SQL alone.
_ORDER_TESTS = {
    "Response": ("cx > 0", "cy > 0 and ly > lx"), "AlternateResponse": ("cx > 0", "gx = greatest(cx - 1, 0)"), "ChainResponse": ("cx > 0", "nb = cx"),
    "NotResponse": ("cx > 0 and cy > 0", "ly < fx"), "Succession": ("cx > 0 and cy > 0", "ly > lx and fx < fy"),
    "AlternateSuccession": ("cx > 0 and cy > 0", "gx = cx - 1 and gy = cy - 1"), "ChainSuccession": ("cx > 0 and cy > 0", "nb = cx and nb = cy"), "NotChainSuccession": ("cx > 0 and cy > 0", "nb = 0"),
}
#: 2000 logs of shuffled traces, and (-1) the log itself: a case is a distinct trace of a log, its outcome how many cases have it.
_ORDER_NULL = f"""with own as (select case_id, t from (with {CUSTOMER_ORDERS} select * from tr) where outcome = 1),
e as (select rep, case_id, unnest(t) as act, unnest(range(len(t))) as i from own, range(2000) as g(rep)),
n as (select rep, list(act order by md5('42|' || rep || '|' || case_id || '|' || i), i) as t from e group by rep, case_id union all select -1, t from own),
tr as (select rep as case_id, count(*) as outcome, t from n group by rep, t), {CHECKS[:CHECKS.index("chk as (")]}
w as (select case_id as rep, a, b, {", ".join(f"sum(outcome * coalesce({app}, false)::int) as app_{c}, sum(outcome * coalesce({app} and {sat}, false)::int) as sat_{c}" for c, (app, sat) in _ORDER_TESTS.items())} from st group by 1, 2, 3),
u as (select case_id as rep, act as a, sum(outcome) as n, sum(outcome * (t[1] = act)::int) as init, sum(outcome * (t[-1] = act)::int) as last from tr, al group by 1, 2),
q as ({" union all ".join(f"select rep, '{c}' as ctype, a, b, app_{c} as app, sat_{c} as sat from w" for c in _ORDER_TESTS)}
  union all select rep, 'Init', a, null, n, init from u union all select rep, 'End', a, null, n, last from u),
c as (select o.ctype, o.a, o.b, o.sat / o.app::double as prev, q.rep % 2 as half, (1 + count_if(q.sat >= o.sat)) / 1001.0::double as up, (1 + count_if(q.sat <= o.sat)) / 1001.0::double as low
  from q o join q on o.rep = -1 and q.rep >= 0 and o.app > 0 and o.ctype = q.ctype and o.a = q.a and o.b is not distinct from q.b group by all),
p as (select ctype, a, b, prev, half, if(ctype in ('NotResponse', 'NotChainSuccession'), least(1, 2 * least(up, low)), up) as p from c)
select ctype, a, b, round(any_value(prev), 9) as prev, round(max(p) filter (where half = 0), 9) as p_screen, round(max(p) filter (where half = 1), 9) as p_struct from p group by 1, 2, 3"""


@query(_ORDER_NULL)
def structural_permutation_test(spark, sf_dir):
    t = logs.stored(logs.customer_orders(spark, sf_dir).where("outcome = 1"))
    p = tests_of_difference.structural_permutation(t, _cands(t), 2000)
    return p.select("ctype", "a", "b", _r("prev").alias("prev"), _r("p_screen").alias("p_screen"), _r("p_struct").alias("p_struct"))


def _uniform_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::bigint / 4294967296.0::double"


@query(f"with {CUSTOMER_ORDERS} select case_id, if({_uniform_sql(chr(39) + '42' + chr(39), 'case_id')} < 0.1, 1 - outcome, outcome)::int as outcome from tr")
def label_noise(spark, sf_dir):
    return resampling.label_noise(logs.customer_orders(spark, sf_dir), 0.1).select("case_id", "outcome")


def _order_noise_sql(log: str, seed: int, rho: float, outcome: str = "outcome") -> str:
    """Adjacent swaps at drawn places, from the left, one after another."""
    return f"""with {log}, d as (select case_id, {outcome} as outcome, t, round_even({rho} * (len(t) - 1), 0)::int as k,
  list_sort([{{'h': md5('{seed}|' || case_id || '|' || i), 'i': i}} for i in range(len(t) - 1)]) as o from tr),
c as (select *, list_sort([x.i for x in list_slice(o, 1, k)]) as places from d)
select case_id, outcome, array_to_string(list_reduce(list_concat([t], [[i::varchar] for i in places]), lambda t, i: list_concat(list_concat(list_slice(t, 1, i[1]::int), [t[i[1]::int + 2], t[i[1]::int + 1]]), list_slice(t, i[1]::int + 3, len(t)))), '>') as trace from c"""


@query(_order_noise_sql(USERS, 42, 0.3))
def order_noise(spark, sf_dir):
    n = resampling.order_noise(logs.users(spark, sf_dir), 0.3)
    return n.select("case_id", "outcome", F.array_join("trace", ">").alias("trace"))


@query(_order_noise_sql(CUSTOMER_ORDERS, 43, 0.5, f"if({_uniform_sql(chr(39) + '42' + chr(39), 'case_id')} < 0.1, 1 - outcome, outcome)::int"))
def joint_noise(spark, sf_dir):
    n = resampling.joint_noise(logs.customer_orders(spark, sf_dir), 0.1, 0.5)
    return n.select("case_id", "outcome", F.array_join("trace", ">").alias("trace"))


@query(f"""with {USERS}, d as (select case_id, t, {_uniform_sql(chr(39) + '42' + chr(39), 'case_id')} < 0.5 as hit, list_sort([{{'h': md5('43|' || case_id || '|' || i), 'i': i}} for i in range(len(t))]) as o from tr)
select case_id, array_to_string(if(hit and len(t) >= 2, [if(j = o[1].i + 1, t[o[2].i + 1], if(j = o[2].i + 1, t[o[1].i + 1], t[j])) for j in range(1, len(t) + 1)], t), '>') as trace from d""")
def random_swap(spark, sf_dir):
    return resampling.random_swap(logs.users(spark, sf_dir), 0.5).select("case_id", F.array_join("trace", ">").alias("trace"))


_PICKED = "n as (select greatest(1, round_even(count(*) * 0.1, 0))::bigint as k from tr), p as (select case_id, outcome, t, row_number() over (order by md5('42|' || case_id), case_id) <= (select k from n) as hit from tr)"


@query(f"with {CUSTOMER_ORDERS}, {_PICKED} select case_id, if(hit, 1 - outcome, outcome)::int as outcome from p")
def flip_exact_share(spark, sf_dir):
    return resampling.flip_exactly(logs.customer_orders(spark, sf_dir), 0.1).select("case_id", "outcome")


@query(f"with {CUSTOMER_ORDERS}, {_PICKED} select case_id, array_to_string(if(hit, t[1:greatest(1, ceil(round(0.9 * len(t), 9)))::bigint], t), '>') as trace from p")
def truncate_share(spark, sf_dir):
    return resampling.truncate(logs.customer_orders(spark, sf_dir), 0.1).select("case_id", F.array_join("trace", ">").alias("trace"))


# ---- p-values and false discovery rate, on drawn p-values of parts -------------------------------------

_P = f"p as (select p_partkey as id, ({_uniform_sql(chr(39) + 'a' + chr(39), 'p_partkey')} + 1e-9) * if(p_partkey % 5 = 0, 0.002::double, 1::double) as p1, {_uniform_sql(chr(39) + 'b' + chr(39), 'p_partkey')} * if(p_partkey % 5 = 0, 0.01::double, 1::double) + 1e-9 as p2 from part)"


def _p_values(spark, sf_dir):
    part = logs.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    hit = F.col("id") % 5 == 0
    return part.select(
        "id", ((resampling.uniform(F.lit("a"), F.col("id")) + 1e-9) * F.when(hit, 0.002).otherwise(1.0)).alias("p1"),
        (resampling.uniform(F.lit("b"), F.col("id")) * F.when(hit, 0.01).otherwise(1.0) + 1e-9).alias("p2"),
    )


def _step_sql(c: str) -> str:
    return f"""with {_P}, r as (select *, row_number() over (order by p1, id) as rank, count(*) over () as m from p),
t as (select *, rank * 0.05::double / (m * {c}) as threshold from r), k as (select max(rank) filter (where p1 <= threshold) as k from t)
select id, rank::int as rank, round(threshold, 12) as threshold, coalesce(rank <= k, false) as reject from t, k"""


def _step(spark, sf_dir, dependent):
    return significance.step_up(_p_values(spark, sf_dir), "p1", ["id"], 0.05, dependent).select("id", "rank", F.round("threshold", 12).alias("threshold"), "reject")


@query(_step_sql("1"))
def fdr_step_up(spark, sf_dir):
    return _step(spark, sf_dir, False)


@query(_step_sql("(select sum(1.0::double / i) from range(1, (select count(*) + 1 from part)) as g(i))"))
def fdr_step_up_dependent(spark, sf_dir):
    return _step(spark, sf_dir, True)


@query(f"""with {_P}, r as (select *, row_number() over (order by p1, id) as rank, count(*) over () as m from p)
select id, round(least(1, min(0.8::double * m * p1 / rank) over (order by rank rows between current row and unbounded following)), 12) as q from r""")
def q_values(spark, sf_dir):
    return significance.q_values(_p_values(spark, sf_dir), "p1", ["id"], 0.8).select("id", F.round("q", 12).alias("q"))


@query(f"""with {_P} select id, round(exp(-x) * (1 + x), 12) as p_fisher, round(greatest(p1, p2), 12) as p_iut, round(-2 * (0.4::double * ln(p1) + 0.6::double * ln(p2)), 9) as t from (select *, -(ln(p1) + ln(p2)) as x from p)""")
def combined_evidence(spark, sf_dir):
    w = significance.weights()
    return _p_values(spark, sf_dir).select(
        "id", F.round(significance.fisher_combined("p1", "p2"), 12).alias("p_fisher"), F.round(significance.intersection_union("p1", "p2"), 12).alias("p_iut"),
        _r(significance.combined_statistic("p1", "p2", *w)).alias("t"))


@query(f"with {_P} select count(*)::bigint as m, round(corr(-ln(p1), -ln(p2)), 9) as rho from p")
def log_p_correlation(spark, sf_dir):
    return significance.log_p_correlation(_p_values(spark, sf_dir), "p1", "p2").select("m", _r("rho").alias("rho"))


@query(f"""with {_P}, r as (select greatest(-0.5, least(1.0, corr(-ln(p1), -ln(p2))))::double as r from p),
v as (select 4 * (0.16::double + 0.36::double) + 0.48::double * if(r >= 0, r * (3.25::double + 0.75::double * r), r * (3.27::double + 0.71::double * r)) as v from r),
x as (select id, -2 * (0.4::double * ln(p1) + 0.6::double * ln(p2)) / (v / 4) / 2 as x, 4 / v as a from p, v)
select id, round(1 - list_sum([exp((a + n) * ln(x) - x - lgamma(a + n + 1)) for n in range(300)]), 9) as p_conj from x""")
def analytic_combination(spark, sf_dir):
    p = _p_values(spark, sf_dir)
    rho = significance.log_p_correlation(p, "p1", "p2").first()["rho"]
    w = significance.weights()
    c, f = significance.moment_match(rho, *w)
    out = significance.analytic_p(p.withColumn("t", significance.combined_statistic("p1", "p2", *w)), "t", c, f)
    return out.select("id", _r("p_conj").alias("p_conj"))


@query(f"""with {_P}, g as (select round(0.05 * j, 2)::double as lam, j from range(1, 18) as r(j)), m as (select count(*) as m from p),
w as (select j, lam, count_if(p2 > lam)::double as w from p, g group by 1, 2), e as (select *, least(1, w / (m * (1 - lam))) as pi0 from w, m),
f as (select quantile_cont(pi0, 0.1) as floor from e), s as (select *, round(w / (m::double * m * pow(1 - lam, 2)) * (1 - w / m) + pow(pi0 - floor, 2), 15) as mse from e, f)
select m::bigint as m, round(lam, 9) as lam, round(pi0, 9) as pi0 from s order by mse, j limit 1""")
def null_share_bootstrap(spark, sf_dir):
    return significance.pi0_bootstrap(_p_values(spark, sf_dir), "p2").select("m", _r("lam").alias("lam"), _r("pi0").alias("pi0"))


@query(f"""with {_P}, m as (select count(*) as m from p), s as (select m, greatest(0.75::double / 50, 1.0::double / m) as step from m),
g as (select j, 0.05::double + step * j as lam, m from s, range(1, 60) as r(j) where 0.05::double + step * j <= 0.8 + 1e-12),
w as (select j, lam, m, count_if(p2 > lam)::double as w from p, g group by 1, 2, 3), e as (select *, least(1, w / (m * (1 - lam))) as pi0 from w),
v as (select *, round(pi0 + greatest(0, pi0 * (1 - (1 - lam) * pi0) / (m * (1 - lam))), 12) as psi from e), n as (select *, lead(psi) over (order by j) as next from v)
select m::bigint as m, round(lam, 9) as lam, round(pi0, 9) as pi0 from n where next is null or next >= psi order by j limit 1""")
def null_share_adaptive(spark, sf_dir):
    return significance.pi0_adaptive(_p_values(spark, sf_dir), "p2", 0.05).select("m", _r("lam").alias("lam"), _r("pi0").alias("pi0"))


@query(f"""with {_P} select id, case when not (p1 * p2 < 0.02) then case when p1 <= 0.05 then 'structural_only' else 'none' end when p1 <= 0.05 and p2 <= 0.05 then 'both'
when p2 <= 0.05 then 'discriminative_only' when p1 <= 0.05 then 'structural_only' else 'both' end as category from p""")
def evidence_taxonomy(spark, sf_dir):
    p = _p_values(spark, sf_dir).withColumn("significant", F.col("p1") * F.col("p2") < 0.02)
    return p.select("id", significance.taxonomy(p_order="p1", p_label="p2").alias("category"))


# ---- comparison methods --------------------------------------------------------------------------------


def _conf(spark, sf_dir):
    t = logs.user_days(spark, sf_dir)
    return measures.support_confidence(event_log.variants(t), _cands(t), tp.ENABLED)


_CONF = f"""with {USER_DAYS}, {CHECKS}, q as ({_PREVALENCE} where ctype in {ENABLED_SQL} group by 1, 2, 3),
c as (select *, if(n_app0 > 0, n_sat0 / n_app0::double, 0) as conf0, if(n_app1 > 0, n_sat1 / n_app1::double, 0) as conf1 from q)"""


@query(_CONF + " select ctype, a, b, round(abs(conf1 - conf0), 9) as delta_conf from c where abs(conf1 - conf0) >= 0.02 and (conf0 >= 0.01 or conf1 >= 0.01)")
def threshold_decision(spark, sf_dir):
    return comparison.threshold_decision(_conf(spark, sf_dir), 0.02).select("ctype", "a", "b", _r("delta_conf").alias("delta_conf"))


@query(_CONF + " select ctype, a, b, row_number() over (order by abs(conf1 - conf0) desc, greatest(conf0, conf1) desc, ctype, a, b nulls first)::int as place from c")
def difference_ranking(spark, sf_dir):
    return comparison.ranked_differences(_conf(spark, sf_dir)).select("ctype", "a", "b", "place")


@query(_CONF + """, k as (select least(floor(round(abs(conf1 - conf0) / 0.0001::double, 6)), 9000)::int as k from c where conf0 >= 0.01 or conf1 >= 0.01),
gr as (select j as g, count_if(k >= j)::bigint as r_obs from range(1, 9001) as r(j), k group by 1), b as (select max(g) filter (where r_obs >= 20) as best from gr)
select round(g * 0.0001::double, 6) as tau, r_obs, r_obs - 20 as overshoot, case when best is null then 'under_discovery_capped' when best = 9000 then 'over_discovery' else 'normal' end as pathology
from gr, b where g = coalesce(best, 1)""")
def calibrated_threshold(spark, sf_dir):
    return comparison.calibrate_threshold(_conf(spark, sf_dir), 20)


@query(_CONF + """, gr as (select tau::double as tau, least::double as least from (select unnest([0.001, 0.01, 0.02, 0.05]) as tau), (select unnest([0.0, 0.01, 0.5]) as least)),
n as (select tau, least, count_if(abs(conf1 - conf0) >= tau and (conf0 >= least or conf1 >= least))::bigint as n from c, gr group by 1, 2)
select tau, max(n) filter (where least = 0.0) as "0.0", max(n) filter (where least = 0.01) as "0.01", max(n) filter (where least = 0.5) as "0.5" from n group by 1""")
def threshold_scan(spark, sf_dir):
    return comparison.threshold_scan(_conf(spark, sf_dir), [0.001, 0.01, 0.02, 0.05], [0.0, 0.01, 0.5])


@query(_CONF + """, s as (select *, pow(conf1 - conf0, 2) as num, if(n_app0 > 0, conf0 * (1 - conf0) / n_app0, 0) + if(n_app1 > 0, conf1 * (1 - conf1) / n_app1, 0) as den from c),
f as (select *, case when den > 1e-12 then num / den when num <= 1e-12 then 0 else num / 1e-12 end as score from s)
select ctype, a, b, round(score, 6) as score, score >= 3.841458820694124 as significant from f""")
def fisher_scores(spark, sf_dir):
    c = _conf(spark, sf_dir).withColumn("score", comparison.fisher_score())
    return c.select("ctype", "a", "b", F.round("score", 6).alias("score"), (F.col("score") >= 3.841458820694124).alias("significant"))


def _normal_tail_sql(x: str) -> str:
    """Two-sided normal tail of sqrt(x), the chi-square tail of one degree of freedom: a series, or a continued fraction
    above 9, taken from its end."""
    z = f"sqrt({x})"
    series = f"list_sum([exp(-({x}) / 2 + i * ln({x}) - list_sum([ln(2 * j + 1.0::double) for j in range(1, i + 1)])) for i in range(1, 80)])"
    inner = f"list_reduce([{z} for k in range(61)], lambda f, s, k: s + (62 - k) / f)"
    return f"case when {x} <= 0 then 1 when {x} < 9 then 1 - sqrt(2 / pi()) * {z} * (exp(-({x}) / 2) + coalesce({series}, 0)) else 2 * exp(-({x}) / 2) / sqrt(2 * pi()) / {inner} end"


@query(f"""with {USER_DAYS}, {CHECKS}, q as ({_PREVALENCE} where ctype in {ENABLED_SQL} group by 1, 2, 3),
c as (select ctype, a, b, n_sat1::double as w, (n_app1 - n_sat1)::double as x, n_sat0::double as y, (n_app0 - n_sat0)::double as z from q),
m as (select *, w + x + y + z as n, (w + x) * (y + z) * (w + y) * (x + z) as margins from c),
e as (select *, if(margins > 0, n * pow(greatest(0, abs(w * z - x * y) - n / 2), 2) / greatest(margins, 1), 0) as chi2,
  least((w + x) * (w + y), (w + x) * (x + z), (y + z) * (w + y), (y + z) * (x + z)) / greatest(n, 1) < 5 as small_cells from m),
p as (select *, {_normal_tail_sql('chi2')} as p from e),
r as (select *, row_number() over (order by p, ctype, a, b nulls first) as rank, count(*) over () as k from p), l as (select max(rank) filter (where p <= rank * 0.05::double / k) as last from r)
select ctype, a, b, round(chi2, 6) as chi2, round(p, 7) as p, small_cells, coalesce(rank <= last, false) as reject from r, l""")
def contingency_tests(spark, sf_dir):
    t = logs.user_days(spark, sf_dir)
    p = comparison.contingency_test(measures.class_prevalence(event_log.variants(t), _cands(t), tp.ENABLED))
    return p.select("ctype", "a", "b", _r("chi2", 6).alias("chi2"), _r("p", 7).alias("p"), "small_cells", "reject")


def _null(spark, sf_dir):
    t = logs.user_days(spark, sf_dir)
    return tests_of_difference.label_permutation(t, _cands(t), 20, keep_null=True)


@query(_LABEL_NULL + """, u as (select abs(delta) as t, 1 as o, 0 as z from o union all select abs(d.d), 0, 1 from d where exists (select 1 from o where o.ctype = d.ctype and o.a = d.a and o.b is not distinct from d.b)),
lv as (select round(t, 12) as t, sum(o) as o, sum(z) as z from u group by 1), s as (select t, o, sum(o) over (order by t desc) as r, sum(z) over (order by t desc) / 20.0::double as v from lv)
select round(t, 9) as tau, r::bigint as r, round(least(1, v / greatest(r, 1)), 9) as fdp from s where o > 0 and least(1, v / greatest(r, 1)) <= 0.5 order by t limit 1""")
def pooled_null_threshold(spark, sf_dir):
    n = _null(spark, sf_dir)
    s = comparison.pooled_null_sweep(n, n.select(F.explode("null").alias("stat")), 20, 0.5)
    return s.select(_r("tau").alias("tau"), "r", _r("fdp").alias("fdp"))


@query(_LABEL_NULL + """, p as (select ctype, a, b, stddev_pop(abs(d.d)) as sd from d where exists (select 1 from o where o.ctype = d.ctype and o.a = d.a and o.b is not distinct from d.b) group by 1, 2, 3),
f as (select case when ctype like 'Not%' then 'Negative' when ctype in ('Init','End') then 'Unary' when ctype like '%Succession' then 'Succession' else 'Response' end as family, sd from p)
select family, round(avg(sd), 9) as mean, round(stddev_pop(sd), 9) as std, round(min(sd), 9) as min, round(max(sd), 9) as max, round(median(sd), 9) as median, count(*)::bigint as n from f group by 1""")
def null_spread_by_family(spark, sf_dir):
    n = _null(spark, sf_dir).select("ctype", "a", "b", F.explode("null").alias("stat"))
    s = comparison.null_spread_by_family(n, tp.family())
    return s.select("family", *[_r(c).alias(c) for c in ("mean", "std", "min", "max", "median")], "n")


@query(_LABEL_NULL + """, v as (select rep, count_if(abs(d) >= 0.05) as v from d where exists (select 1 from o where o.ctype = d.ctype and o.a = d.a and o.b is not distinct from d.b) group by 1),
m as (select greatest(1, count(*)) as m, greatest(1, count_if(abs(delta) >= 0.05)) as r from o)
select count(*)::bigint as b_null, round(avg(v), 9) as e_v, round(avg(v) / any_value(r), 9) as fdr_emp, round(avg(v) / any_value(m), 9) as pcer_emp, round(avg((v > 0)::int), 9) as fwer_emp, round(stddev_pop(v), 9) as v_std, max(v)::bigint as v_max, count_if(v = 0)::bigint as v_zero from v, m""")
def empirical_error_rates(spark, sf_dir):
    n = _null(spark, sf_dir).cache()
    tested, observed = n.agg(F.count(F.lit(1)), F.count_if(F.abs("delta") >= 0.05)).first()
    v = n.select(F.posexplode("null").alias("rep", "stat")).groupBy("rep").agg(F.count_if(F.abs("stat") >= 0.05).alias("v"))
    e = significance.empirical_error_rates(v, observed, tested)
    return e.select("b_null", *[_r(c).alias(c) for c in ("e_v", "fdr_emp", "pcer_emp", "fwer_emp", "v_std")], "v_max", "v_zero")


_OWN_P = """, x as (select o.ctype, o.a, o.b, delta, count_if(abs(d.d) >= abs(delta)) as k, stddev_pop(abs(d.d)) as sigma from o join d on o.ctype = d.ctype and o.a = d.a and o.b is not distinct from d.b group by 1, 2, 3, 4),
p as (select *, (1 + k) / 21.0::double as p, count(*) over () as m from x)"""


@query(_LABEL_NULL + """, n as (select * from d where exists (select 1 from o where o.ctype = d.ctype and o.a = d.a and o.b is not distinct from d.b)), w as (select stddev_pop(d) as pooled from n)
select ctype, a, b, round(stddev_pop(d), 7) as pattern_sd, round(any_value(pooled), 7) as pooled_sd, round(any_value(pooled) / nullif(stddev_pop(d), 0), 5) as inflation from n, w group by 1, 2, 3""")
def null_inflation(spark, sf_dir):
    """How far the pooled null of all patterns is from each pattern's own."""
    i = comparison.inflation(_null(spark, sf_dir).select("ctype", "a", "b", F.explode("null").alias("stat")))
    return i.select("ctype", "a", "b", _r("pattern_sd", 7).alias("pattern_sd"), _r("pooled_sd", 7).alias("pooled_sd"), _r("inflation", 5).alias("inflation"))


@query(_LABEL_NULL + _OWN_P + """, rk as (select *, row_number() over (order by p, ctype, a, b nulls first) as rank, 0.9::double * m * p as v from p),
q as (select *, least(1, min(v / rank) over (order by rank rows between current row and unbounded following)) as q from rk), c as (select max(p) filter (where q <= 0.5) as cut, median(sigma) as s0 from q)
select ctype, a, b, rank::int as rank, round(sigma, 7) as sigma, round(abs(delta) / (sigma + s0), 6) as d, round(v, 9) as false, round(q, 9) as q, coalesce(p <= cut, false) as significant from q, c""")
def per_pattern_fdr(spark, sf_dir):
    """False discoveries of the label test, each pattern against its own null."""
    out = significance.per_pattern_fdr(_null(spark, sf_dir), ["ctype", "a", "b"], 0.5, 0.9)
    return out.select("ctype", "a", "b", "rank", _r("sigma", 7).alias("sigma"), _r("d", 6).alias("d"), _r("false").alias("false"), _r("q").alias("q"), "significant")


@query(_LABEL_NULL + _OWN_P + """, z as (select abs(d.d) as z, d.ctype from d where exists (select 1 from o where o.ctype = d.ctype and o.a = d.a and o.b is not distinct from d.b)),
i as (select (select count(*) from z where z >= 0.05) / 20.0::double as pooled, (select coalesce(sum(k), 0) from p where abs(delta) >= 0.05) / 20.0::double as own),
f as (select avg(sigma) as s from p group by case when ctype like 'Not%' then 'Negative' when ctype in ('Init','End') then 'Unary' when ctype like '%Succession' then 'Succession' else 'Response' end),
lv as (select round(t, 12) as t, sum(o) as o, sum(z) as z from (select abs(delta) as t, 1 as o, 0 as z from p union all select z, 0, 1 from z) group by 1),
s as (select t, o, sum(o) over (order by t desc) as r, sum(z) over (order by t desc) / 20.0::double as v from lv),
w as (select r from s where o > 0 and least(1, v / greatest(r, 1)) <= 0.9 order by t limit 1)
select 0.05::double as tau, round(pooled, 9) as pooled, round(own, 9) as own, round(pooled / greatest(own, 1e-15), 6) as factor, (select round(max(s) / greatest(min(s), 1e-15), 6) from f) as spread_ratio,
coalesce((select r from w), 0)::bigint as pooled_found from i""")
def pooled_null_report(spark, sf_dir):
    """What pooling the nulls of all patterns costs."""
    n = _null(spark, sf_dir).cache()
    null = n.select("ctype", "a", "b", F.explode("null").alias("stat"))
    r = comparison.pooled_null_report(n, null, 20, 0.05, tp.family(), 0.9)
    return r.select("tau", _r("pooled").alias("pooled"), _r("own").alias("own"), _r("factor", 6).alias("factor"), _r("spread_ratio", 6).alias("spread_ratio"), "pooled_found")


def _pi0_sql(p: str) -> str:
    return f"""select '{p}' as axis, m::bigint as m, round(lam, 9) as lam, round(pi0, 9) as pi0, round(low, 9) as low, round(high, 9) as high from (
  with g as (select round(0.05 * j, 2)::double as lam, j from range(1, 18) as r(j)), m as (select count(*) as m from p), w as (select j, lam, count_if({p} > lam)::double as w from p, g group by 1, 2),
  e as (select *, least(1, w / (m * (1 - lam))) as pi0 from w, m), f as (select quantile_cont(pi0, 0.1) as floor, quantile_cont(pi0, 0.025) as low, quantile_cont(pi0, 0.975) as high from e)
  select *, round(w / (m::double * m * pow(1 - lam, 2)) * (1 - w / m) + pow(pi0 - floor, 2), 15) as mse from e, f order by mse, j limit 1)"""


@query(f"with {_P} select * from ({_pi0_sql('p1')}) union all select * from ({_pi0_sql('p2')})")
def null_share_ranges(spark, sf_dir):
    """The share of true nulls of both columns of p-values, with its range over the grid."""
    out = significance.pi0_range(_p_values(spark, sf_dir), ["p1", "p2"])
    return out.select("axis", "m", *[_r(c).alias(c) for c in ("lam", "pi0", "low", "high")])


@query(f"{_SPEC} select ctype, a, b, row_number() over (order by round(tconf, 12) desc, round(econf, 12) desc, round(tsupp, 12) desc, ctype, a, b nulls first)::int as place from spec")
def specification_order(spark, sf_dir):
    """The positive class's specification from the strongest constraint down; equal ones by name."""
    return pruning.by_strength(_spec(spark, sf_dir, "n1")).select("ctype", "a", "b", "place")


# ---- feature mining ------------------------------------------------------------------------------------


@query(f"with {USERS} select case_id, outcome, act as feature, count(*)::double as value from (select case_id, outcome, unnest(t) as act from tr) group by 1, 2, 3")
def activity_counts(spark, sf_dir):
    return mining.activity_counts(logs.users(spark, sf_dir))


@query(f"""with {CUSTOMER_ORDERS}, g as (select array_to_string(unnest([t[i:i + 2] for i in range(1, len(t) - 1)]), '>') as gram, case_id from tr)
select gram, count(*)::bigint as n, count(distinct case_id)::bigint as cases from g group by 1""")
def trigrams(spark, sf_dir):
    g = logs.customer_orders(spark, sf_dir).select("case_id", F.explode(mining.ngrams(3)).alias("g")).select("case_id", F.array_join("g", ">").alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("cases"))


@query(f"""with {CUSTOMER_ORDERS}, n as (select ceil(0.6 * count(*)) as need from tr), s as (select distinct case_id, unnest(t) as x from tr)
select x as items, count(*)::bigint as n from s group by 1 having count(*) >= (select need from n)
union all select p.x || ',' || q.x, count(*)::bigint from s p join s q on p.case_id = q.case_id and p.x < q.x group by 1 having count(*) >= (select need from n)""")
def frequent_itemsets(spark, sf_dir):
    return mining.frequent_itemsets(logs.customer_orders(spark, sf_dir), 0.6).select(F.array_join("items", ",").alias("items"), "n")


@query(f"""with {USERS}, f as (select case_id, outcome, act, count(*)::double as v from (select case_id, outcome, unnest(t) as act from tr) group by 1, 2, 3),
n as (select count_if(outcome = 0)::double as n0, count_if(outcome = 1)::double as n1 from tr),
s as (select act, sum(if(outcome = 0, v, 0)) / n0 as m0, sum(if(outcome = 1, v, 0)) / n1 as m1, sum(v) / (n0 + n1) as m, sum(if(outcome = 0, v * v, 0)) / n0 as q0, sum(if(outcome = 1, v * v, 0)) / n1 as q1, n0, n1 from f, n group by act, n0, n1)
select act as feature, round((n1 * pow(m1 - m, 2) + n0 * pow(m0 - m, 2)) / (n1 * (q1 - m1 * m1) + n0 * (q0 - m0 * m0)), 9) as score from s""")
def feature_scores(spark, sf_dir):
    t = logs.users(spark, sf_dir)
    return mining.fisher_scores(mining.activity_counts(t), t).select("feature", _r("score").alias("score"))


@query(f"""with {USERS}, f as (select outcome, act, count(*)::double as v from (select outcome, unnest(t) as act from tr) group by 1, 2), n as (select count_if(outcome = 0)::double as n0, count_if(outcome = 1)::double as n1 from tr),
d as (select act, round(sum(if(outcome = 1, v, 0)) / any_value(n1) - sum(if(outcome = 0, v, 0)) / any_value(n0), 12) as d from f, n group by 1) select count_if(d > 0)::bigint as n_plus, count_if(d < 0)::bigint as n_minus from d""")
def feature_signs(spark, sf_dir):
    """Activities that positive cases have more, and fewer, of."""
    t = logs.users(spark, sf_dir)
    return mining.sign_counts(mining.activity_counts(t), t)


@query()
def sequential_patterns(spark, sf_dir):
    t = logs.customer_orders(spark, sf_dir)
    return mining.discriminative(mining.sequential_patterns(t), t, 0.1)


@query(f"""with recursive {CUSTOMER_ORDERS}, {CHECKS}, f as (select array_to_string(tr.t, '>') as u, chk.outcome, ctype || '(' || concat_ws(', ', a, b) || ')' as feature, if(sat, 1, -1)::double as v from chk join tr on chk.case_id = tr.case_id where app and ctype in {ENABLED_SQL}),
n as (select count_if(outcome = 0)::double as n0, count_if(outcome = 1)::double as n1 from tr),
s as (select feature, n0, n1, sum(if(outcome = 0, v, 0)) / n0 as m0, sum(if(outcome = 1, v, 0)) / n1 as m1, sum(v) / (n0 + n1) as m, sum(if(outcome = 0, v * v, 0)) / n0 as q0, sum(if(outcome = 1, v * v, 0)) / n1 as q1 from f, n group by feature, n0, n1),
r as (select feature, n1 * pow(m1 - m, 2) + n0 * pow(m0 - m, 2) as num, n1 * greatest(0, q1 - m1 * m1) + n0 * greatest(0, q0 - m0 * m0) as den from s),
o as (select feature, row_number() over (order by round(case when den > 1e-12 then num / den when num <= 1e-12 then 0 else num / 1e-12 end, 9) desc, feature desc) as k from r),
g as (select distinct u, feature from f), un as (select distinct u from g),
bits as (select o.k, o.feature, list((g.u is not null)::int order by un.u) as on_units from o cross join un left join g on g.u = un.u and g.feature = o.feature group by 1, 2),
walk as (select 0::bigint as k, (select list(0 order by u) from un) as held, ''::varchar as feature, false as taken
  union all select b.k, if(x.take, [p[1] + p[2] for p in list_zip(w.held, b.on_units)], w.held), b.feature, x.take
  from walk w join bits b on b.k = w.k + 1, lateral (select len([p for p in list_zip(w.held, b.on_units) if p[2] = 1 and p[1] < 20]) > 0 as take) x)
select (row_number() over (order by k) - 1)::int as place, feature from walk where taken""")
def coverage_selection(spark, sf_dir):
    """Constraints that greedy coverage accepts, best first."""
    t = logs.customer_orders(spark, sf_dir)
    names = mining.select_by_coverage(mining.constraint_features(t, _cands(t)), t, 20)
    return spark.createDataFrame(list(enumerate(names)), "place int, feature string")


def _user_data(spark, sf_dir):
    data = mining.data_features(logs.read(spark, sf_dir, "events"), "user_id", "ts", ["value"], ["event_type"])
    return data.where(~F.col("feature").isin("value_first", "value_last", "value_avg"))


@query(f"""with {USERS}, {CHECKS}, e as (select user_id::varchar as case_id, * exclude (user_id) from events),
w as (select case_id, min(value) as mi, max(value) as ma, count(*)::double as n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as dur from e group by 1),
d as (select * from (select case_id, 'value_min' as feature, mi as value from w union all select case_id, 'value_max', ma from w union all select case_id, 'length', n from w
  union all select case_id, 'duration', dur from w union all select case_id, 'event_type==' || event_type, count(*)::double from e where event_type is not null group by 1, 2) where value <> 0),
k as (select feature, value, sign(value) as side, (row_number() over (partition by feature, sign(value) order by value) - 1) * 256 // count(*) over (partition by feature, sign(value)) as run from (select distinct feature, value from d)),
m as (select ctype, a, coalesce(b, '') as b, case_id, outcome from chk where sat and ctype in {ENABLED_SQL}),
n as (select ctype, a, b, count_if(outcome = 0) as n0, count_if(outcome = 1) as n1 from m group by all having n0 > 0 and n1 > 0 and n0 + n1 >= 4),
h as (select ctype, a, b, feature, side, run, n0, n1, count_if(outcome = 0) as c0, count_if(outcome = 1) as c1, min(value) as low, max(value) as high from m join n using (ctype, a, b) join d using (case_id) join k using (feature, value) group by all),
z as (select ctype, a, b, feature, n0, n1, c0, c1, low, high from h union all select ctype, a, b, feature, n0, n1, n0 - sum(c0), n1 - sum(c1), 0.0, 0.0 from h group by ctype, a, b, feature, n0, n1 having sum(c0) + sum(c1) < n0 + n1),
c as (select *, sum(c0) over v as l0, sum(c1) over v as l1, lead(low) over v as following from z window v as (partition by ctype, a, b, feature order by low)),
i as (select *, l0 + l1 as nl, n0 + n1 - l0 - l1 as nr, n0 + n1 as nn from c where following is not null),
g as (select ctype, a, b, feature, (high + following) / 2 as threshold, round((2.0 * n0 * n1 / nn - 2.0 * l0 * l1 / nl - 2.0 * (n0 - l0) * (n1 - l1) / nr) / nn, 9) as gain from i)
select ctype, a, nullif(b, '') as b, feature, round(threshold, 6) as threshold, gain from g where gain > 0 qualify row_number() over (partition by ctype, a, b order by gain desc, feature, threshold) = 1""")
def data_conditions(spark, sf_dir):
    """The data condition of every constraint over the users' event data."""
    t = logs.stored(logs.users(spark, sf_dir))
    c = mining.data_conditions(t, _cands(t), _user_data(spark, sf_dir))
    return c.select("ctype", "a", "b", "feature", F.round("threshold", 6).alias("threshold"), "gain")


@query()
def mined_rules(spark, sf_dir):
    """Rules of the final model on constraints and the users' activity counts."""
    t = logs.stored(logs.users(spark, sf_dir))
    found = mining.mined_rules(mining.encode(t, "ia+template", _cands(t)), t)
    return found.select("leaf", "rule", "length", "support", _r("precision").alias("precision"))


@query()
def null_mining_counts(spark, sf_dir):
    """Constraints that coverage selects, and those in the rules of a tree, on 200 double-null logs and (rep 200) on the log."""
    t = logs.stored(logs.users(spark, sf_dir))
    return mining.null_mining_counts(t, _cands(t), 200)


@query("""with b as (select user_id::varchar as case_id, value, ts, event_id, event_type from events),
w as (select case_id, min(value) as mi, max(value) as ma, avg(value) as av, count(*)::double as n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as dur from b group by 1)
select case_id, 'value_min' as feature, round(mi, 6) as value from w union all select case_id, 'value_max', round(ma, 6) from w union all select case_id, 'value_avg', round(av, 6) from w
union all select case_id, 'length', n from w union all select case_id, 'duration', round(dur, 6) from w union all select case_id, 'event_type==' || event_type, count(*)::double from b group by 1, 2""")
def data_features(spark, sf_dir):
    f = mining.data_features(logs.read(spark, sf_dir, "events"), "user_id", "ts", ["value"], ["event_type"])
    return f.where(~F.col("feature").isin("value_first", "value_last")).select("case_id", "feature", F.round("value", 6).alias("value"))


@query(f"""with {CUSTOMER_ORDERS}, {CHECKS}, q as ({_PREVALENCE} where ctype in {ENABLED_SQL} group by 1, 2, 3), n as (select count_if(outcome = 0) as c0, count_if(outcome = 1) as c1 from tr)
select ctype, a, b, case when n_sat1 >= greatest(1, ceil(0.3 * c1)) then 'positive' else 'negative' end as source from q, n
where n_sat1 >= greatest(1, ceil(0.3 * c1)) or (n_app1 = 0 and n_sat0 >= greatest(1, ceil(0.3 * c0)))""")
def declarative_features(spark, sf_dir):
    t = logs.customer_orders(spark, sf_dir)
    return mining.template_features(t, _cands(t), 0.3)


@query(f"""with {CUSTOMER_ORDERS}, r as (select case_id, outcome, row_number() over (partition by outcome order by md5('42|' || case_id), case_id) as k from tr)
select case_id, outcome, ((k - 1) % 10)::int as fold from r""")
def stratified_folds(spark, sf_dir):
    return mining.folds(logs.customer_orders(spark, sf_dir), 10)


@query()
def tree_cross_validation(spark, sf_dir):
    t = logs.stored(logs.users(spark, sf_dir))
    f = mining.activity_counts(t)
    names = sorted(r[0] for r in f.select("feature").distinct().collect())
    return mining.cross_validate(f, t, names)


# ---- whole jobs -------------------------------------------------------------------------


@query()
def full_protocol(spark, sf_dir):
    from .protocol import run

    t = logs.stored(logs.user_days(spark, sf_dir))
    out = run(t, _cands(t))
    return out.select("ctype", "a", "b", *[_r(c).alias(c) for c in ("delta", "p_disc", "p_struct", "t", "p_conj", "p_emp", "q")], "dominant", "significant", "category")


@query()
def null_error_rates(spark, sf_dir):
    from .experiments import error_rates

    t = logs.stored(logs.user_days(spark, sf_dir))
    e = error_rates(t, _cands(t), 200)
    return e.select("method", "r_obs", "b_null", *[_r(c).alias(c) for c in ("e_v", "fdr_emp", "pcer_emp", "fwer_emp", "bca_low", "bca_high", "fdr_low", "fdr_high")], "controls")


def _methods():
    from .experiments import fisher_method, threshold_method

    return {"threshold": threshold_method(), "fisher": fisher_method()}


_GRID_COLUMNS = ("eps", "rho", "method", "tp", "fp", "fn")


@query()
def perturbation_study(spark, sf_dir):
    from .experiments import perturbation_study as study, summarise

    t = logs.stored(logs.user_days(spark, sf_dir))
    s = study(t, _cands(t), {"threshold": _methods()["threshold"]})
    return summarise(s).select("family", "eps", "n", *[_r(c).alias(c) for c in ("jaccard", "fdr_ref", "pct_low", "pct_high")])


def _hits_sql(changed: list[tuple[str, str]]) -> str:
    """What both methods find on changed logs and the clean one.  ``changed``: (cell, SELECT of case_id, outcome and t)."""
    parts = " union all ".join(f"select '{cell}#' || case_id as case_id, outcome, t from ({text})" for cell, text in [("clean", f"with {USER_DAYS} select * from tr"), *changed])
    return f"""with tr as ({parts}), {CHECKS},
q as (select split_part(case_id, '#', 1) as cell, ctype, a, b, coalesce(sum(app::int) filter (where outcome = 0), 0) as a0, coalesce(sum(sat::int) filter (where outcome = 0), 0) as s0,
  coalesce(sum(app::int) filter (where outcome = 1), 0) as a1, coalesce(sum(sat::int) filter (where outcome = 1), 0) as s1 from chk where ctype in {ENABLED_SQL} group by 1, 2, 3, 4),
c as (select *, if(a0 > 0, s0 / a0::double, 0) as c0, if(a1 > 0, s1 / a1::double, 0) as c1 from q),
f as (select *, pow(c1 - c0, 2) as num, if(a0 > 0, c0 * (1 - c0) / a0, 0) + if(a1 > 0, c1 * (1 - c1) / a1, 0) as den from c),
hit as (select cell, 'threshold' as method, ctype, a, b from f where abs(c1 - c0) >= 0.02 and (c0 >= 0.01 or c1 >= 0.01)
  union all select cell, 'fisher', ctype, a, b from f where case when den > 1e-12 then num / den when num <= 1e-12 then 0 else num / 1e-12 end >= 3.841458820694124)"""


def _agreement_sql(changed: list[tuple[str, str]], columns: str = "*") -> str:
    """Both methods on changed logs against the clean one."""
    return _hits_sql(changed) + f""",
k as (select cell, method from (select distinct cell from q where cell <> 'clean'), (select unnest(['threshold', 'fisher']) as method)),
s as (select k.cell, k.method, h.ctype, h.a, h.b, max((h.cell = 'clean')::int) as x, max((h.cell <> 'clean')::int) as y from k join hit h on h.method = k.method and h.cell in ('clean', k.cell) group by 1, 2, 3, 4, 5),
m as (select k.cell, k.method, coalesce(sum(x * y), 0)::bigint as tp, coalesce(sum((1 - x) * y), 0)::bigint as fp, coalesce(sum(x * (1 - y)), 0)::bigint as fn from k left join s using (cell, method) group by 1, 2)
select {columns} from (select split_part(cell, '/', 1) as first, split_part(cell, '/', 2)::double as second, method, tp, fp, fn, round(if(tp + fp + fn = 0, 1, tp / (tp + fp + fn)::double), 9) as jaccard from m)"""


def _noisy_sql(log: str, seed: int, rho: float, label_seed: int, eps: float) -> str:
    noisy = _order_noise_sql(log, seed, rho, f"if({_uniform_sql(f"'{label_seed}'", 'case_id')} < {eps}, 1 - outcome, outcome)::int")
    return f"select case_id, outcome, string_split(trace, '>') as t from ({noisy})"


@query(_agreement_sql([(f"{e}/{r}", _noisy_sql(USER_DAYS, 42 + 1000 * i, r, 42 + j, e)) for i, r in enumerate((0.0, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)) for j, e in enumerate((0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5))], """
  first::double as eps, second as rho, method, tp, fp, fn, jaccard, round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 9) as f1, tp + fp >= 10 as reliable"""))
def noise_grid(spark, sf_dir):
    from .experiments import noise_grid as grid

    t = logs.stored(logs.user_days(spark, sf_dir))
    return grid(t, _cands(t), _methods()).select(*_GRID_COLUMNS, _r("jaccard").alias("jaccard"), _r("f1").alias("f1"), "reliable")


_SMALL_GRID = [(f"{e}/{r}", _noisy_sql(USER_DAYS, 42 + 1000 * i, r, 42 + j, e)) for i, r in enumerate((0.2, 1.0)) for j, e in enumerate((0.0, 0.1, 0.5))]


def _small_grid(spark, sf_dir):
    from .experiments import noise_grid as grid

    t = logs.stored(logs.user_days(spark, sf_dir))
    return grid(t, _cands(t), _methods(), (0.0, 0.1, 0.5), (0.2, 1.0))


@query("select second as rho, method, min(first::double) filter (where jaccard < 0.8) as inflection from (" + _agreement_sql(_SMALL_GRID) + ") group by 1, 2")
def noise_inflection(spark, sf_dir):
    """The first level of label noise at which a method's result is no longer close to the clean one."""
    g = _small_grid(spark, sf_dir).withColumn("key", F.struct("rho", "method"))
    return significance.inflection(g, "key", "eps", "jaccard").select("key.rho", "key.method", "inflection")


@query("""select first::double as eps, max(jaccard) filter (where second = 0.2) as "0.2", max(jaccard) filter (where second = 1.0) as "1.0" from (""" + _agreement_sql(_SMALL_GRID) + ") where method = 'threshold' group by 1")
def noise_pivot(spark, sf_dir):
    """The threshold method's agreement as a table of label noise by order noise."""
    p = files.metric_pivots(_small_grid(spark, sf_dir), ["jaccard"])["jaccard_threshold"]
    return p.select("eps", *[_r(F.col(f"`{c}`")).alias(c) for c in ("0.2", "1.0")])


def _perturbed_sql(family: str, eps: float, seed: int) -> str:
    log = f"with {USER_DAYS}"
    if family == "order":
        return f"""{log}, d as (select case_id, outcome, t, {_uniform_sql(f"'{seed}'", 'case_id')} < {eps} as hit, list_sort([{{'h': md5('{seed + 1}|' || case_id || '|' || i), 'i': i}} for i in range(len(t))]) as o from tr)
select case_id, outcome, if(hit and len(t) >= 2, [if(j = o[1].i + 1, t[o[2].i + 1], if(j = o[2].i + 1, t[o[1].i + 1], t[j])) for j in range(1, len(t) + 1)], t) as t from d"""
    picked = f"{log}, p as (select case_id, outcome, t, row_number() over (order by md5('{seed}|' || case_id), case_id) <= (select greatest(1, round_even(count(*) * {eps}, 0))::bigint from tr) as hit from tr)"
    if family == "labels":
        return f"{picked} select case_id, if(hit, 1 - outcome, outcome)::int as outcome, t from p"
    return f"{picked} select case_id, outcome, if(hit, t[1:greatest(1, ceil(round({1.0 - eps} * len(t), 9)))::bigint], t) as t from p"


@query(_agreement_sql([(f"{f}/{rep}", _perturbed_sql(f, 0.2, 42 + 100_000 * (k + 1) + 2000 + 7919 * rep)) for k, f in enumerate(resampling.PERTURBATIONS) for rep in range(2)]))
def perturbation_cells(spark, sf_dir):
    """Two repeats of each perturbation at one level, both methods."""
    from .experiments import perturbation_study as study

    t = logs.stored(logs.user_days(spark, sf_dir))
    s = study(t, _cands(t), _methods(), levels=(0.2,), repeats=2)
    return s.select(F.col("family").alias("first"), F.col("rep").cast("double").alias("second"), "method", "tp", "fp", "fn", _r("jaccard").alias("jaccard"))


@query(_hits_sql([(f"{f}/{rep}", _perturbed_sql(f, 0.2, 42 + 100_000 * (k + 1) + 2000 + 7919 * rep)) for k, f in enumerate(resampling.PERTURBATIONS) for rep in range(4)]) + f""",
k as (select cell, method, fam from (select distinct cell from q where cell <> 'clean'), (select unnest(['threshold', 'fisher']) as method), (select distinct {_FAMILY} as fam from q)),
s as (select k.cell, k.method, k.fam, h.ctype, h.a, h.b, max((h.cell = 'clean')::int) as x, max((h.cell <> 'clean')::int) as y from k join (select *, {_FAMILY} as fam from hit) h on h.method = k.method and h.fam = k.fam and h.cell in ('clean', k.cell) group by all),
m as (select k.cell, k.method, k.fam, coalesce(sum(x * y), 0) / greatest(count(s.x), 1)::double as part, count(s.x) as u from k left join s using (cell, method, fam) group by 1, 2, 3),
g as (select split_part(cell, '/', 1) as family, method, fam, list(j order by j) as x, count(*) as n, avg(j) as mean from (select *, if(u = 0, 1.0::double, part) as j from m) group by 1, 2, 3),
d as (select family, method, fam, n, mean, round(list_sum([x[1 + floor({_uniform_sql("'42'", 'family', "'0.2'", 'method', 'fam', 'd', 'i')} * n)::bigint] for i in range(n)]) / n::double, 12) as boot from g, range(1000) as r(d))
select family, 0.2::double as eps, method, fam as template_family, any_value(n)::bigint as n, round(any_value(mean), 9) as jaccard, round(quantile_cont(boot, 0.025), 9) as pct_low, round(quantile_cont(boot, 0.975), 9) as pct_high from d group by family, method, fam""")
def perturbation_families(spark, sf_dir):
    """Agreement by template family over four repeats of each perturbation at one level, with bootstrap intervals."""
    from .experiments import perturbation_study as study, summarise

    t = logs.stored(logs.user_days(spark, sf_dir))
    s = summarise(study(t, _cands(t), _methods(), levels=(0.2,), repeats=4, by_family=True))
    return s.select("family", "eps", "method", "template_family", "n", *[_r(c).alias(c) for c in ("jaccard", "pct_low", "pct_high")])


#: Double-null logs of a noisy log with inner labels and orders, for SQL: 3 outer, 9 inner label, 7 inner order replicates.
_CALIBRATION = f"""with own as ({_noisy_sql(USER_DAYS, 43, 0.3, 42, 0.1)}), o as (select unnest(range(3)) as o),
y as (select o, case_id, (row_number() over (partition by o order by md5('142|' || o || '|' || case_id), case_id) <= sum(outcome) over (partition by o))::int as outcome from own, o),
e as (select o, case_id, unnest(t) as act, unnest(range(len(t))) as i from own, o),
n as (select o, case_id, list(act order by md5('143|' || o || '|' || case_id || '|' || i), i) as t from e group by 1, 2),
ie as (select o, r, case_id, unnest(t) as act, unnest(range(len(t))) as i from n, (select unnest([1, 3, 5]) as r)),
tr as (select o || '#0#' || case_id as case_id, outcome, t from n join y using (o, case_id)
  union all select o || '#' || r || '#' || case_id, any_value(outcome), list(act order by md5('342|' || o || '|' || r || '|' || case_id || '|' || i), i) from ie join y using (o, case_id) group by o, r, case_id), {CHECKS},
h as (select split_part(case_id, '#', 1)::int as o, split_part(case_id, '#', 2)::int as r, split_part(case_id, '#', 3) as case_id, outcome, ctype, a, b, sat::int as sat from chk where app and ctype in {ENABLED_SQL}),
l as (select o, k, case_id, (row_number() over (partition by o, k order by md5('242|' || o || '|' || k || '|' || case_id), case_id) <= sum(outcome) over (partition by o, k))::int as z from y, range(9) as g(k)),
d as (select o, k, ctype, a, b, round(coalesce(sum(sat * z) / nullif(sum(z), 0)::double, 0) - coalesce(sum(sat * (1 - z)) / nullif(sum(1 - z), 0)::double, 0), 12) as d from h join l using (o, case_id) where r = 0 group by 1, 2, 3, 4, 5),
s as (select o, ctype, a, b, coalesce(sum(sat * outcome) / nullif(sum(outcome), 0)::double, 0) as p1, coalesce(sum(sat * (1 - outcome)) / nullif(sum(1 - outcome), 0)::double, 0) as p0 from h where r = 0 group by 1, 2, 3, 4),
pl as (select s.*, (1 + (select count(*) from d where d.o = s.o and d.ctype = s.ctype and d.a = s.a and d.b is not distinct from s.b and abs(d.d) >= abs(round(p1 - p0, 12)))) / 10.0::double as p_label from s),
c as (select o, r, outcome, ctype, a, b, sum(sat) as n from h group by 1, 2, 3, 4, 5, 6),
w as (select x.o, x.outcome, x.ctype, x.a, x.b, (1 + count_if(y.n >= x.n)) / 4.0::double as up, (1 + count_if(y.n <= x.n)) / 4.0::double as low
  from c x join c y on x.r = 0 and y.r > 0 and x.o = y.o and x.outcome = y.outcome and x.ctype = y.ctype and x.a = y.a and x.b is not distinct from y.b group by 1, 2, 3, 4, 5),
po as (select *, if(ctype in ('NotResponse', 'NotChainSuccession'), least(1, 2 * least(up, low)), up) as p from w),
f as (select pl.o, pl.ctype, pl.a, pl.b, p_label, coalesce(p, 1) as p_order from pl left join po on po.o = pl.o and po.outcome = (round(p1, 12) >= round(p0, 12))::int and po.ctype = pl.ctype and po.a = pl.a and po.b is not distinct from pl.b)
"""


def _noisy_calibration(spark, sf_dir):
    from .protocol import Budget, null_statistics

    t = logs.stored(resampling.joint_noise(logs.user_days(spark, sf_dir), 0.1, 0.3))
    return null_statistics(t, _cands(t), Budget(outer=3, inner_label=9, inner_order=7), 0.4, 0.6)


@query(_CALIBRATION + " select o::int as outer_rep, ctype, a, b, round(p_label, 9) as p_label, round(p_order, 9) as p_order, round(-2 * (0.4::double * ln(p_order) + 0.6::double * ln(p_label)), 9) as t from f")
def calibration_on_noisy_log(spark, sf_dir):
    """Null p-values and statistics of the protocol's calibration on a perturbed log."""
    return _noisy_calibration(spark, sf_dir).select(F.col("outer").alias("outer_rep"), "ctype", "a", "b", *[_r(c).alias(c) for c in ("p_label", "p_order", "t")])


@query(_CALIBRATION + """ select o::int as outer_rep, count_if(p_label <= 0.2)::bigint as v_label, count_if(p_order <= 0.3)::bigint as v_order, count_if(p_label <= 0.2 and p_order <= 0.3)::bigint as v_both, count(*)::bigint as m from f group by 1""")
def null_counts_of_permutation_tests(spark, sf_dir):
    """False discoveries of the label test, the order test and both on the double-null logs of a perturbed log."""
    label, order = F.col("p_label") <= 0.2, F.col("p_order") <= 0.3
    n = _noisy_calibration(spark, sf_dir).groupBy(F.col("outer").alias("outer_rep"))
    return n.agg(F.count_if(label).alias("v_label"), F.count_if(order).alias("v_order"), F.count_if(label & order).alias("v_both"), F.count(F.lit(1)).alias("m"))


_NULL_COUNTS = f"""with own as (select * from (with {USER_DAYS} select * from tr)),
y as (select r, case_id, (row_number() over (partition by r order by md5('42|' || r || '|' || case_id), case_id) <= sum(outcome) over (partition by r))::int as outcome from own, range(10) as g(r)),
e as (select r, case_id, unnest(t) as act, unnest(range(len(t))) as i from own, range(10) as g(r)),
n as (select r, case_id, list(act order by md5('43|' || r || '|' || case_id || '|' || i), i) as t from e group by 1, 2),
v as (select r, outcome, t, count(*) as k from (select r, outcome, t from n join y using (r, case_id) union all select 10, outcome, t from own) group by 1, 2, 3),
tr as (select array_to_string(t, '>') as case_id, 0 as outcome, t from (select distinct t from v)), {CHECKS},
q as (select r, ctype, a, b, coalesce(sum(k) filter (where app and v.outcome = 0), 0) as a0, coalesce(sum(k) filter (where sat and v.outcome = 0), 0) as s0, coalesce(sum(k) filter (where app and v.outcome = 1), 0) as a1,
  coalesce(sum(k) filter (where sat and v.outcome = 1), 0) as s1 from chk join v on chk.case_id = array_to_string(v.t, '>') where ctype in {ENABLED_SQL} group by 1, 2, 3, 4),
c as (select *, if(a0 > 0, s0 / a0::double, 0) as c0, if(a1 > 0, s1 / a1::double, 0) as c1 from q),
f as (select *, pow(c1 - c0, 2) as num, if(a0 > 0, c0 * (1 - c0) / a0, 0) + if(a1 > 0, c1 * (1 - c1) / a1, 0) as den from c),
m as (select r, count_if(abs(c1 - c0) >= 0.02 and (c0 >= 0.01 or c1 >= 0.01))::bigint as threshold, count_if(case when den > 1e-12 then num / den when num <= 1e-12 then 0 else num / 1e-12 end >= 3.841458820694124)::bigint as fisher from f group by 1)
select r::int as rep, 'threshold' as method, threshold as v from m union all select r::int, 'fisher', fisher from m"""


@query(_NULL_COUNTS)
def null_counts_of_methods(spark, sf_dir):
    """Discoveries of the threshold and Fisher methods on ten double-null logs, and (rep 10) on the log itself."""
    from .experiments import null_counts

    t = logs.stored(logs.user_days(spark, sf_dir))
    return null_counts(t, _cands(t), _methods(), 10)


@query(f"""with nc as ({_NULL_COUNTS}), g as (select method, list(v order by v) as x, count(*) as n, round(sum(v) / count(*)::double, 12) as mean from nc where rep < 10 group by 1),
b as (select method, n, mean, x, d, round(list_sum([x[1 + floor({_uniform_sql("'42'", 'method', 'd', 'i')} * n)::bigint] for i in range(n)]) / n::double, 12) as m from g, range(1000) as r(d))
select method, any_value(n)::int as n, any_value(mean) as mean, round(quantile_cont(m, 0.025), 9) as pct_low, round(quantile_cont(m, 0.975), 9) as pct_high, avg((m < mean)::int::double) as below,
  round(any_value(list_sum([pow(v - mean, 3) for v in x]) / (6 * pow(list_sum([pow(v - mean, 2) for v in x]), 1.5))), 9) as acceleration from b group by method""")
def null_count_intervals(spark, sf_dir):
    """Bootstrap intervals of the mean number of discoveries on ten double-null logs, with what accelerated ends are made of."""
    from ..operators import bootstrap
    from .experiments import null_counts

    t = logs.stored(logs.user_days(spark, sf_dir))
    null = null_counts(t, _cands(t), _methods(), 10).where("rep < 10")
    i = bootstrap.intervals(null, ["method"], "v")
    return i.select("method", "n", "mean", _r("pct_low").alias("pct_low"), _r("pct_high").alias("pct_high"), "below", _r("acceleration").alias("acceleration"))


@query("select p as premise_1, q as premise_2, e as conclusion, true as proven from (values ('Response(a, b)', 'Response(b, c)', 'Response(a, c)'), ('ChainResponse(a, b)', 'Precedence(a, b)', 'AlternateResponse(a, b)'), ('Succession(a, b)', 'NotSuccession(a, b)', 'ChainSuccession(a, b)')) v(p, q, e)")
def automata_entailment(spark, sf_dir):
    """Entailments proven by automata; the middle one needs the pairwise reading of alternation."""
    from ..operators.automata import entails

    rows = [(("Response", "a", "b"), ("Response", "b", "c"), ("Response", "a", "c")), (("ChainResponse", "a", "b"), ("Precedence", "a", "b"), ("AlternateResponse", "a", "b")), (("Succession", "a", "b"), ("NotSuccession", "a", "b"), ("ChainSuccession", "a", "b"))]
    text = lambda c: f"{c[0]}({c[1]}, {c[2]})"
    return spark.createDataFrame([(text(p), text(q), text(c), entails([p, q], c)) for p, q, c in rows], "premise_1 string, premise_2 string, conclusion string, proven boolean")


@query()
def entailment_pruning(spark, sf_dir):
    """What automata leave of the specification mined from positive cases; contradictory neighbours entail all."""
    from ..operators.automata import prune_entailed

    mined = sorted((tuple(r) for r in _two_specs(spark, sf_dir)[0].collect()), key=lambda c: (c[0], c[1], c[2] or ""))
    return spark.createDataFrame(prune_entailed(mined), "ctype string, a string, b string")


@query(f"""with e as (select user_id::varchar as u, event_type as act, ts from events where user_id is not null and event_type is not null and ts is not null),
b as (select *, case when ts <= lag(ts) over (partition by u order by ts, act) + interval 12 hours then 0 else 1 end as opens from e),
n as (select *, sum(opens) over (partition by u order by ts, act rows unbounded preceding) as session from b),
s as (select u, session, max(ts) + interval 12 hours as end_ts, list(act order by ts, act) as t from n group by 1, 2),
tr as (select u || '|' || session as case_id, 0 as outcome, t from s where end_ts <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from e)), {CHECKS}
select ctype, a, b, count(*)::bigint as applicable, sum(sat::int)::bigint as satisfied from chk where app and ctype in {ENABLED_SQL} group by 1, 2, 3""")
def streaming_verdicts(spark, sf_dir):
    """Verdicts of the user sessions that a stream over the events has closed; a batch that is run again overwrites its own."""
    from ..streaming.monitor import available_now, batch_sink

    static = logs.read(spark, sf_dir, "events")
    cands = measures.candidates(static.select(F.col("event_type").alias("act")).distinct())
    live = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parquet*")
    folder = shared_folder(spark, "stream")
    available_now(live, cands, batch_sink(f"{folder}/out"), f"{folder}/progress", "user_id", "event_type", "ts", gap="12 hours")
    v = spark.read.schema("case_id string, ctype string, a string, b string, sat int, batch long").parquet(f"{folder}/out")
    return v.groupBy("ctype", "a", "b").agg(F.count(F.lit(1)).alias("applicable"), F.sum("sat").cast("long").alias("satisfied"))


@query()
def composite_encoding(spark, sf_dir):
    """Number of cases and sum of values of every feature of a composite encoding."""
    t = logs.stored(logs.users(spark, sf_dir))
    data = mining.data_features(logs.read(spark, sf_dir, "events"), "user_id", "ts", ["value"], ["event_type"])
    e = mining.encode(t, "ia+data+conditional", _cands(t), data=data)
    return e.groupBy("feature").agg(F.count(F.lit(1)).alias("cases"), F.round(F.sum("value"), 4).alias("total"))


@query()
def error_control_tests(spark, sf_dir):
    """Whether null counts of the threshold method are compatible with error control at 5 %."""
    from .experiments import null_counts

    t = logs.stored(logs.user_days(spark, sf_dir))
    replicates = 200
    found = {r["rep"]: r["v"] for r in null_counts(t, _cands(t), {"threshold": _methods()["threshold"]}, replicates).collect()}  # one for each replicate
    r = significance.control_tests([found[i] for i in range(replicates)], found[replicates], 0.05)
    return spark.createDataFrame([tuple(round(v, 9) for v in r.values())], ", ".join(f"{k} double" for k in r))
