"""Reading and writing specifications, results and checkpoints."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates as tp

# Field names of the specification and result files, and the syntax of .decl lines.
SPEC_SCHEMA = "pattern_id string, constraint_type string, param_a string, param_b string"
_SIDE = (
    "struct<label:string,n_traces:bigint,n_constraints:bigint,constraints:array<struct<pattern_id:string,constraint_type:string,param_a:string,param_b:string,"
    "event_based:struct<confidence:double,coverage:double,support:double>,trace_based:struct<confidence:double,coverage:double,support:double>>>>"
)


# ---- .decl text ----------------------------------------------------------------------------------------


def read_decl(spark: SparkSession, path: str) -> DataFrame:
    """(ctype, a, b) of the constraint lines of a ``.decl`` file."""
    line = F.trim("value")
    parts = F.regexp_extract(line, r"^([A-Za-z]+)\[(.*)\]$", 2)
    name = F.regexp_extract(line, r"^([A-Za-z]+)\[(.*)\]$", 1)
    two = F.split(parts, ", ", 2)
    return spark.read.text(path).where(name != "").select(name.alias("ctype"), two[0].alias("a"), F.try_element_at(two, F.lit(2)).alias("b"))


def decl_lines(constraints: DataFrame, header: str) -> list[str]:
    """Header, activities, then constraints in template order (a specification is small)."""
    order = {n: i for i, n in enumerate((*tp.UNARY, *tp.BINARY))}
    rows = sorted(((order.get(r["ctype"], 99), r["a"], r["b"] or "", r["ctype"]) for r in constraints.select("ctype", "a", "b").collect()))
    acts = sorted({x for _, a, b, _ in rows for x in (a, b) if x})
    return [f"// {header}", "", *[f"activity {x}" for x in acts], "", *[f"{c}[{a}, {b}]" if b else f"{c}[{a}]" for _, a, b, c in rows]]


def write_decl(constraints: DataFrame, path: str, header: str) -> None:
    """One text file (through Spark, so any file system serves)."""
    spark = constraints.sparkSession
    rows = list(enumerate(decl_lines(constraints, header)))
    spark.createDataFrame(rows, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


# ---- specification and result JSON ---------------------------------------------------------------------


def spec_entries(measured: DataFrame):
    """Measured constraints as nested entries, rounded to 6 digits."""
    r = lambda c: F.round(c, 6)
    return measured.select(
        F.concat(F.col("ctype"), F.lit("("), F.concat_ws(", ", "a", "b"), F.lit(")")).alias("pattern_id"),
        F.col("ctype").alias("constraint_type"), F.col("a").alias("param_a"), F.col("b").alias("param_b"),
        F.struct(r("econf").alias("confidence"), r("ecov").alias("coverage"), r("esupp").alias("support")).alias("event_based"),
        F.struct(r("tconf").alias("confidence"), r("tcov").alias("coverage"), r("tsupp").alias("support")).alias("trace_based"),
        F.struct("n_act", "n_ful", "n_events", "t_act", "t_sat", "n_traces").alias("raw_counts"),
    )


def write_spec(positive: DataFrame, negative: DataFrame, path: str) -> None:
    """Both classes' specifications and their set algebra as one JSON document."""
    def side(df, label):
        e = spec_entries(df)
        return e.agg(F.count(F.lit(1)).alias("n_constraints"), F.max("raw_counts.n_traces").alias("n_traces"), F.sort_array(F.collect_list(F.struct(*e.columns))).alias("constraints")).select(
            F.struct(F.lit(label).alias("label"), "n_traces", "n_constraints", "constraints").alias(label))

    ids = lambda df: {f"{r['ctype']}({', '.join(x for x in (r['a'], r['b']) if x is not None)})" for r in df.select("ctype", "a", "b").collect()}
    p, n = ids(positive), ids(negative)
    algebra = {"n_shared": len(p & n), "n_Lpos_only": len(p - n), "n_Lneg_only": len(n - p), "shared": sorted(p & n), "Lpos_only": sorted(p - n), "Lneg_only": sorted(n - p)}
    out = side(positive, "Lpos").crossJoin(side(negative, "Lneg")).withColumn("set_algebra", F.from_json(F.lit(json.dumps(algebra)), "struct<n_shared:bigint,n_Lpos_only:bigint,n_Lneg_only:bigint,shared:array<string>,Lpos_only:array<string>,Lneg_only:array<string>>"))
    out.coalesce(1).write.mode("overwrite").json(path)


def read_spec(spark: SparkSession, path: str, allowed=(*tp.UNARY, *tp.ENABLED)) -> DataFrame:
    """(ctype, a, b, in_pos, in_neg): candidates of both classes with allowed templates, each once."""
    doc = spark.read.schema(f"Lpos {_SIDE}, Lneg {_SIDE}").option("multiLine", True).json(path)
    each = lambda c, k: doc.select(F.explode(f"{c}.constraints").alias("e"), F.lit(k).alias("side"))
    rows = each("Lpos", 1).union(each("Lneg", 0)).select(F.col("e.constraint_type").alias("ctype"), F.col("e.param_a").alias("a"), F.col("e.param_b").alias("b"), "side")
    return rows.where(F.col("ctype").isin(*allowed)).groupBy("ctype", "a", "b").agg((F.max("side") == 1).alias("in_pos"), (F.min("side") == 0).alias("in_neg"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(pattern_id, category): from the top-level field, else the nested one, else from the flags."""
    schema = "all_patterns array<struct<pattern_id:string,significance_category:string,storey_fdr:struct<significance_category:string>,significant:boolean,p_struct:double,p_disc:double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("all_patterns").alias("p")).select("p.*")
    flags = F.when(~F.coalesce("significant", F.lit(False)), "none").when((F.col("p_struct") <= 0.05) & (F.col("p_disc") <= 0.05), "both").when(F.col("p_disc") <= 0.05, "discriminative_only").otherwise("structural_only")
    return rows.select("pattern_id", F.coalesce("significance_category", "storey_fdr.significance_category", flags).alias("category"))


# ---- tables and resumable jobs -------------------------------------------------------------------------


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]) if form == "csv" else df
        writer = flat.write.mode("overwrite")
        (writer.option("header", True).csv if form == "csv" else getattr(writer, form))(f"{folder}/{name}")


def text_report(title: str, tables: dict[str, DataFrame], rows: int = 20) -> str:
    """A report of the first rows of each table (a limit is what it is for)."""
    out = [title, "=" * len(title)]
    for name, df in tables.items():
        head = df.limit(rows).collect()
        out += ["", name, "-" * len(name), " | ".join(df.columns), *[" | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in head]]
    return "\n".join(out)


def metric_pivots(rows: DataFrame, metrics: list[str], row: str = "eps", column: str = "rho", by: str = "method") -> dict[str, DataFrame]:
    """One row x column table for each metric and method."""
    levels = [r[0] for r in rows.select(column).distinct().orderBy(column).collect()]
    methods = [r[0] for r in rows.select(by).distinct().orderBy(by).collect()]
    return {f"{m}_{x}": rows.where(F.col(by) == x).groupBy(row).pivot(column, levels).agg(F.first(m)).orderBy(row) for m in metrics for x in methods}


def resume(jobs: DataFrame, done_path: str, keys: list[str]) -> DataFrame:
    """The jobs whose keys have no finished rows under ``done_path``."""
    try:
        done = jobs.sparkSession.read.parquet(done_path).select(*keys).distinct()
    except Exception as e:
        if re.search("PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA", str(e)):
            return jobs
        raise
    return jobs.join(done, keys, "left_anti")


def append_finished(rows: DataFrame, done_path: str, keys: list[str]) -> None:
    """Finished rows, one folder for each key; the commit protocol makes each write all or nothing."""
    rows.write.mode("append").partitionBy(*keys).parquet(done_path)
