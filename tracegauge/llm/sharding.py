"""Sharding by a k-d tree over metadata (DataFrame operators only).

The rows of a node are split at the weighted median of its widest metadata dimension, until every leaf
holds its share of the bytes.  A node that stands for k shards is split into k // 2 and k - k // 2, at
the quantile of that share, so any number of leaves comes out equal in bytes.  Medians are found over
all rows by histograms that narrow in on the cut: each pass sums bytes over (node, bucket), so what
reaches the driver is at most shards x BUCKETS rows, whatever the input.

Law: ``bytes``.  Equal texts may lie in different shards: one text may fill more than a shard.

Defined cases: a null text has no bytes (size 8, crc 0); null metadata sorts before all else; rows that
tie in a dimension, repeated rows too, are split by a row number; strings count by their first 7 bytes, so
a dimension whose values share these is never split on; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, filled, row_uid

BUCKETS = 256
SLOT_BUCKETS = 64
#: A cut may miss its quantile by this part of a shard's bytes.
TOLERANCE = 5e-4
DIMENSIONS = ("doc_id", "size", "source", "lang", "n_chars")


@dataclass
class Node:
    shards: int
    first: int
    column: str = ""
    cut: int = 0
    tie: int | None = None  # rows at the cut go left up to this row number; None: all do
    left: Node | None = None
    right: Node | None = None


def _number(field: T.StructField):
    """An order-preserving integer of a metadata column."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        lead = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0")
        c = F.conv(lead, 16, 10).cast("long")
    elif isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        c = F.floor(c.cast("double") * 1024)
    return F.coalesce(c.cast("long"), F.lit(-(2**62)))


def metadata(docs: DataFrame, dimensions=DIMENSIONS) -> tuple[DataFrame, list[str]]:
    fields = {f.name: f for f in docs.schema.fields}
    base = docs.select(
        row_uid().alias("uid"),
        F.col("doc_id"),
        (F.octet_length(filled()) + 8).cast("long").alias("size"),
        F.crc32(F.encode(filled(), "UTF-8")).alias("text_crc32"),
        *[_number(fields[d]).alias(f"dim_{d}") for d in dimensions if d in fields],
    )
    if "size" in dimensions:
        base = base.withColumn("dim_size", F.col("size"))
    # equal rows can be split by their number, so it is a dimension too, taken only when no other is wide
    return durable(base), [f"dim_{d}" for d in dimensions if f"dim_{d}" in base.columns]


def _shard(node: Node):
    if node.left is None:
        return F.lit(node.first)
    v = F.col(node.column)
    below = v <= node.cut if node.tie is None else (v < node.cut) | ((v == node.cut) & (F.col("uid") <= node.tie))
    return F.when(below, _shard(node.left)).otherwise(_shard(node.right))


def _narrow(meta: DataFrame, node_of, spans: dict[int, dict]) -> None:
    """Move each node's cut: one pass over all rows refines every node that still looks for it.

    A span is the range of values that holds the cut, with the bytes wanted from inside it.
    """
    while any(not s["found"] for s in spans.values()):
        bucket, value, inside = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(False)
        for first, s in spans.items():
            if s["found"]:
                continue
            v = F.col(s["column"])
            here = (F.col("_node") == first) & v.between(s["low"], s["high"])
            if s["fixed"] is not None:
                here &= F.col(s["fixed"][0]) == s["fixed"][1]
            step = (v.cast("double") - float(s["low"])) * (BUCKETS / (float(s["high"]) - float(s["low"]) + 1.0))
            inside = inside | here
            bucket = F.when(here, F.least(F.floor(step).cast("int"), F.lit(BUCKETS - 1))).otherwise(bucket)
            value = F.when(here, v).otherwise(value)
        rows = (
            meta.withColumn("_node", node_of).where(inside)
            .select("_node", bucket.alias("b"), value.alias("v"), "size")
            .groupBy("_node", "b").agg(F.sum("size").alias("bytes"), F.min("v").alias("low"), F.max("v").alias("high"))
            .collect()
        )
        for first, s in spans.items():
            if s["found"]:
                continue
            mine = sorted((r for r in rows if r["_node"] == first), key=lambda r: r["b"])
            before = 0
            for i, r in enumerate(mine):
                if before + r["bytes"] >= s["want"] or i == len(mine) - 1:
                    break
                before += r["bytes"]
            over, under = before + r["bytes"] - s["want"], s["want"] - before
            if over <= s["tolerance"]:
                s |= {"found": True, "at": r["high"]}
            elif under <= s["tolerance"] and i:
                s |= {"found": True, "at": mine[i - 1]["high"]}
            elif r["low"] == r["high"] and s["column"] == "uid":  # one row: to the nearer side
                s |= {"found": True, "at": r["low"] - (under < over)}
            elif r["low"] < r["high"]:
                s |= {"low": r["low"], "high": r["high"], "want": s["want"] - before}
            else:  # many rows tie at the cut: go on by row number among them
                s |= {"fixed": (s["column"], r["low"]), "column": "uid", "want": s["want"] - before}
                s["low"], s["high"] = 0, s["last_uid"]


def build_tree(meta: DataFrame, dims: list[str], shards: int) -> Node:
    root = Node(shards, 0)
    whole = meta.agg(
        F.max("uid").alias("last"), F.sum("size").alias("bytes"),
        *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))],
    ).first()
    if whole["last"] is None:
        return root
    scale = {d: max(1, whole[f"max_{d}"] - whole[f"min_{d}"]) for d in dims}
    tolerance = TOLERANCE * whole["bytes"] / shards
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        node_of = _shard(root)
        stats = {
            r["_node"]: r
            for r in meta.groupBy(node_of.alias("_node")).agg(
                F.sum("size").alias("bytes"), F.max("uid").alias("last"),
                *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))],
            ).collect()
        }
        spans: dict[int, dict] = {}
        for n in level:
            if (r := stats.get(n.first)) is None:
                continue  # no rows: its shards stay empty
            wide = max(dims, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / scale[d])
            if r[f"max_{wide}"] == r[f"min_{wide}"]:
                wide = "uid"
            low, high = (0, r["last"]) if wide == "uid" else (r[f"min_{wide}"], r[f"max_{wide}"])
            spans[n.first] = {
                "column": wide, "low": low, "high": high, "last_uid": r["last"], "fixed": None, "found": False,
                "want": r["bytes"] * (n.shards // 2) / n.shards, "tolerance": tolerance,
            }
        _narrow(meta, node_of, spans)
        below = []
        for n in level:
            if n.first not in spans:
                continue
            s, k = spans[n.first], n.shards // 2
            if s["fixed"] is None:
                n.column, n.cut, n.tie = s["column"], s["at"], None
            else:
                n.column, n.cut, n.tie = s["fixed"][0], s["fixed"][1], s["at"]
            n.left, n.right = Node(k, n.first), Node(n.shards - k, n.first + k)
            below += [n.left, n.right]
        level = below
    return root


def shard_documents(docs: DataFrame, shards: int = 24, dimensions=DIMENSIONS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (gapless within the shard), grown_shard (null)."""
    meta, dims = metadata(docs, dimensions)
    tree = build_tree(meta, dims, shards)
    placed = meta.select(
        "uid", "doc_id", "size", "text_crc32", _shard(tree).cast("int").alias("shard"),
        F.pmod(F.xxhash64("uid"), F.lit(SLOT_BUCKETS)).cast("int").alias("part"),
    )
    # a shard's slots are numbered in parts: at most shards x SLOT_BUCKETS offsets are broadcast
    order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    )
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid"))
    return placed.withColumn("_within", within).join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("_within") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
